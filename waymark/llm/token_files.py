"""Token ids in compressed files: canonical length-limited Huffman codes over blocks that are read independently.

Writing. Documents are dealt by doc_id ranges and put in order, encoded, and written as blocks of ids; global
counts of the ids give one code for all files, its lengths limited to MAX_BITS by the package-merge method;
blocks are then packed bit by bit. Reading. A block carries the bit offset of every STEP-th id, so its ids are
read in as many lanes as it has such checkpoints: each step looks up, for every lane at once, the next
MAX_BITS bits in a table that holds the id and the length of its code.

The format, one Parquet row per block: shard, block (ascending doc_id order: shards by number, then blocks),
doc_ids and lengths of its documents (ids with the end id), n_ids, checkpoints (uint32 bit offsets, little
endian), payload (bits, high bit first, padded to whole 32-bit words). `code` is a table of its own: the
length of each id's code, from which the canonical code follows.

Defined cases: a null or empty text is one id, the end id; rows with equal doc_id stand side by side, ordered
by their ids; a null doc_id comes first; a document longer than a block is a block by itself; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import encoding, texts, work

END_ID = 2
MAX_BITS = 16
STEP = 256
#: Ids of a block, about.
BLOCK_IDS = 1 << 17
#: Bytes of text that one shard holds, about, and the most shards: beyond them, shards grow instead.
SHARD_BYTES, MOST_SHARDS = 24 << 20, 50_000

IDS = "shard int, block int, doc_ids array<long>, lengths array<int>, ids binary"
BLOCKS = "shard int, block int, doc_ids array<long>, lengths array<int>, n_ids long, checkpoints binary, payload binary"
DOCS = "shard int, block int, place int, doc_id long, n_tokens long, ids_crc32 long"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits, by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    levels, row = [], weight
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        # Symbols before packages among equals; `is_symbol` says which of the merged row are symbols.
        at = np.searchsorted(weight, pairs, "right") + np.arange(len(pairs))
        is_symbol = np.ones(n + len(pairs), bool)
        is_symbol[at] = False
        row = np.empty(n + len(pairs))
        row[is_symbol], row[at] = weight, pairs
        levels.append(is_symbol)
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:take].sum())
        length[:symbols] += 1
        take = 2 * (take - symbols)
    length[:take] += 1
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code: codes of one length are consecutive, in the order of the ids."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    long = lengths[order].astype(np.int64)
    step = 1 << (MAX_BITS - long)
    codes[order] = (np.cumsum(step) - step) >> (MAX_BITS - long)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string of MAX_BITS bits the id whose code it begins with, and that code's length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    many = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    ids, long = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.int64)
    n = int(many.sum())
    ids[:n], long[:n] = np.repeat(order, many), np.repeat(lengths[order], many)
    return ids, long


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, step: int = STEP) -> tuple[bytes, bytes]:
    """Checkpoints and payload of one block."""
    long = lengths[ids].astype(np.int64)
    ends = np.cumsum(long)
    begins = ends - long
    bits = codes[ids].astype(np.uint64) << (64 - long - (begins & 31)).astype(np.uint64)
    words = np.zeros((int(ends[-1]) if len(ends) else 0) // 32 + 2)
    word = begins >> 5
    # The bits of different ids never overlap, so sums are unions; sums under 2**53 are exact in doubles.
    words += np.bincount(word, (bits >> np.uint64(32)).astype(np.float64), len(words))
    words += np.bincount(word + 1, (bits & np.uint64(0xFFFFFFFF)).astype(np.float64), len(words))
    return begins[::step].astype("<u4").tobytes(), words.astype(">u4").tobytes()


def unpack(payload: bytes, checkpoints: bytes, n: int, table: tuple[np.ndarray, np.ndarray], step: int = STEP) -> np.ndarray:
    """The ids of one block: all lanes advance together, an id a step."""
    raw = np.frombuffer(payload, ">u4").astype(np.uint64)
    pairs = (raw[:-1] << np.uint64(32)) | raw[1:]
    at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
    out = np.zeros((len(at), step), np.uint32)
    symbols, long = table
    shift = np.uint64(64 - MAX_BITS)
    mask = np.uint64((1 << MAX_BITS) - 1)
    last = n - (len(at) - 1) * step  # ids of the last lane
    for k in range(min(step, n)):
        if k == last:
            at = at[:-1]
            if not len(at):
                break
        key = ((pairs[at >> 5] >> (shift - (at & 31).astype(np.uint64))) & mask).astype(np.int64)
        out[: len(at), k] = symbols[key]
        at = at + long[key]
    return out.reshape(-1)[:n]


def _blocks(column: pa.Array, doc_ids: list, path: str, end: int, most: int):
    """Blocks of whole documents: ids of documents, lengths and ids."""
    own_ids, own_long, parts, n = [], [], [], 0
    for lo, ids, count in encoding.encoded(column, path, end):
        edges = np.concatenate([[0], np.cumsum(count)])
        first = 0
        while first < len(count):
            upto = max(first + 1, int(np.searchsorted(edges, edges[first] + most - n, "right")) - 1) if n < most else first
            if upto == first or (n and edges[min(upto, len(count))] - edges[first] + n > most):
                yield own_ids, own_long, np.concatenate(parts)
                own_ids, own_long, parts, n = [], [], [], 0
                continue
            upto = min(upto, len(count))
            own_ids += doc_ids[lo + first : lo + upto]
            own_long += count[first:upto].tolist()
            parts.append(ids[edges[first] : edges[upto]])
            n += int(edges[upto] - edges[first])
            first = upto
    if parts:
        yield own_ids, own_long, np.concatenate(parts)


def encode(docs: DataFrame, vocabulary: str = encoding.VOCABULARY, end: int = END_ID, block: int = BLOCK_IDS) -> DataFrame:
    """Blocks of ids in ascending doc_id order, written to the shared folder."""
    path = encoding.vocabulary(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-size // SHARD_BYTES)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for ids, long, tokens in _blocks(batch.column("text"), batch.column("doc_id").to_pylist(), path, end, block):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([long], pa.list_(pa.int32())), pa.array([tokens.astype("<u2").tobytes()], pa.binary())], names=["shard", "block", "doc_ids", "lengths", "ids"])
                number += 1

    # Equal ids are put in order by their texts, so that a rerun writes the same files.
    ordered = rows.repartitionByRange(int(shards), "doc_id").sortWithinPartitions("doc_id", "text")
    return work.written(ordered.mapInArrow(make, IDS), "ids", compression="zstd")


def counted(ids: DataFrame, size: int = 1 << 16) -> np.ndarray:
    """Global counts of the ids: each task counts its blocks, Spark adds up; at most one row for each id returns."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            buf, _ = texts.buffer(batch.column(0))
            total += np.bincount(buf.view("<u2") if buf.flags.c_contiguous else buf.copy().view("<u2"), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for id_, n in ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n")).collect():
        out[id_] = n
    return out


def write(docs: DataFrame, path: str, **options) -> None:
    """Token files at path/blocks and their code at path/code."""
    spark = docs.sparkSession
    ids = encode(docs, **options)
    lengths = code_lengths(counted(ids))
    used = np.flatnonzero(lengths)
    code = pd.DataFrame({"id": used.astype(np.int32), "bits": lengths[used].astype(np.int32)})
    spark.createDataFrame(code, "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(lengths)  # a byte for each id of the vocabulary

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = shared.value
        codes = canonical(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                tokens = np.frombuffer(batch.column("ids")[k].as_buffer(), "<u2")
                checkpoints, payload = pack(tokens, codes, lengths)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in ("shard", "block", "doc_ids", "lengths")), pa.array([len(tokens)], pa.int64()), pa.array([checkpoints], pa.binary()), pa.array([payload], pa.binary())], names=["shard", "block", "doc_ids", "lengths", "n_ids", "checkpoints", "payload"])

    ids.mapInArrow(squeeze, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def code_of(spark: SparkSession, path: str) -> np.ndarray:
    """The lengths of the codes: a row for each id of the vocabulary at most."""
    lengths = np.zeros(1 << MAX_BITS, np.uint8)
    for id_, bits in spark.read.parquet(f"{path}/code").collect():
        lengths[id_] = bits
    return lengths


def decoded(spark: SparkSession, path: str, each, schema: str) -> DataFrame:
    """Decode all blocks; each(batch row as dict, ids) returns the rows of one block as an Arrow batch."""
    shared = spark.sparkContext.broadcast(code_of(spark, path))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                yield each(row, unpack(row["payload"].as_py(), row["checkpoints"].as_py(), row["n_ids"].as_py(), table))

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(read, schema)


def _digest(row: dict, ids: np.ndarray) -> pa.RecordBatch:
    long = row["lengths"].values.to_numpy()
    raw = memoryview(ids.astype("<u4").tobytes())
    ends = np.cumsum(long.astype(np.int64))
    crc = np.array([zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), long.tolist())], np.int64)
    n = len(long)
    one = lambda c: pa.array(np.full(n, row[c].as_py(), np.int32))
    return pa.RecordBatch.from_arrays([one("shard"), one("block"), pa.array(np.arange(n, dtype=np.int32)), pa.array(row["doc_ids"].values), pa.array(long.astype(np.int64)), pa.array(crc)], names=["shard", "block", "place", "doc_id", "n_tokens", "ids_crc32"])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, all from the files at `path`."""
    docs = work.written(decoded(spark, path, _digest, DOCS), "token-docs")
    # One row per block is summed over all files in two steps: inside each shard, and over the shards.
    blocks = docs.groupBy("shard", "block").agg(F.sum("n_tokens").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before.orderBy("shard")), F.lit(0)).alias("shard_start"))
    blocks = blocks.select("shard", "block", F.coalesce(F.sum("n").over(before.partitionBy("shard").orderBy("block")), F.lit(0)).alias("block_start"))
    starts = blocks.join(shards.hint("shuffle_hash"), "shard")
    inside = before.partitionBy("shard", "block").orderBy("place")
    out = docs.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    out = out.join(starts.hint("shuffle_hash"), ["shard", "block"])
    return out.select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def run(docs: DataFrame) -> DataFrame:
    """Write token files of `docs` to a new place in the shared folder and read them back."""
    path = work.place(docs.sparkSession, "token-files")
    write(docs, path)
    return documents(docs.sparkSession, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(work.documents(spark, sf_dir))
