"""Best-fit packing of documents into token sequences of one length, by large-item matching.

A document is its ids and the end id; one longer than the capacity is cut into pieces of the capacity, the first of
which may be shorter. Sizes are whole numbers up to the capacity, so a packing is a statement about sizes alone: how
many bins hold which sizes. That plan is made from the histogram of sizes (a row for each size, whatever the corpus):

* Large pieces, above a third of the capacity, lie two in a bin at most. From the largest down, each is paired with the
  largest other one that fits beside it, which pairs as many as any matching does; what finds no partner has a bin alone.
* Smaller pieces, from the largest down, go to the smallest gap that holds them, as often as it does; new bins are
  opened when no gap is left.

Equal sizes are handled together: bins of equal contents are one entry with a count, and a size splits two entries
at most, so the plan has a few entries for each size. Pieces are then dealt to it by their rank among the pieces of their
size: a rank is the number of such pieces in earlier parts of the table (one row for each part and size) and in the
own part before it.

Defined cases: a null or empty text is the end id alone; rows with equal doc_id are packed each by itself; a null
doc_id stays null; an empty table gives no sequences; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import encoding, work

CAPACITY = 1024
END_ID = 2
#: Parts of the table whose ranks are broadcast at most: each has a number for each size, 16 MB in all; more are joined.
BROADCAST_PARTS = 1000
#: Bytes of ids for a partition of sequences, about.
PARTITION_BYTES = 24 << 20

PIECES = "part int, place int, doc_id long, piece int, start long, length int, ids binary"
SEQUENCES = "sequence_id long, doc_ids array<long>, pieces array<int>, starts array<long>, lengths array<int>, ids binary"
DIGEST = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(docs: DataFrame, vocabulary: str = encoding.VOCABULARY, end: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their ids; `place` numbers the pieces of one part that have one length."""
    path = encoding.vocabulary(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for lo, ids, count in encoding.encoded(batch.column("text"), path, end):
                many = -(-count // capacity)
                doc = np.repeat(np.arange(len(count)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                first = count - (many - 1) * capacity
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                # Number among equal lengths, in order: positions in a stable sort less the first position of the length.
                order = np.argsort(length, kind="stable")
                n = np.bincount(length, minlength=capacity + 1)
                place = np.empty(len(doc), np.int64)
                place[order] = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                place += seen[length]
                seen += n
                # Pieces of one document follow each other without a gap, so do documents: lengths alone cut the ids.
                edges = np.concatenate([[0], 2 * np.cumsum(length)]).astype(np.int64)
                body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(edges), pa.py_buffer(ids.astype("<u2"))]).cast(pa.binary())
                own = doc_ids.take(pa.array(doc + lo))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), part, np.int32)), pa.array(place.astype(np.int32)), own, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), body], names=["part", "place", "doc_id", "piece", "start", "length", "ids"])

    return work.written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES), "pieces", compression="zstd")


def plan(sizes: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Bins for a histogram {size: count}: (number of bins, ((size, times), ...) that each of them holds)."""
    left = {s: n for s, n in sizes.items() if n}
    gaps: dict[int, list[tuple[int, tuple]]] = {}  # gap: bins that have it

    def put(bins: int, held: tuple, gap: int) -> None:
        if bins:
            gaps.setdefault(gap, []).append((bins, held))

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    ascending = large[::-1]
    for s in large:
        while left[s]:
            # The largest partner that is left and fits, itself included if there are two.
            k = bisect.bisect_right(ascending, min(s, capacity - s)) - 1
            while k >= 0 and left[ascending[k]] < (2 if ascending[k] == s else 1):
                k -= 1
            if k < 0:
                put(left[s], ((s, 1),), capacity - s)
                left[s] = 0
                break
            other = ascending[k]
            bins = left[s] // 2 if other == s else min(left[s], left[other])
            put(bins, ((s, 2),) if other == s else ((s, 1), (other, 1)), capacity - s - other)
            left[s] -= bins
            left[other] -= bins
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        for gap in sorted(g for g in gaps if g >= s):
            entries, kept = gaps.pop(gap), []
            most = gap // s
            while entries:
                bins, held = entries.pop()
                full = min(bins, n // most)
                put(full, (*held, (s, most)), gap - s * most)
                n, bins = n - full * most, bins - full
                if bins and n:  # fewer than `most` are left: one bin takes them
                    put(1, (*held, (s, n)), gap - s * n)
                    n, bins = 0, bins - 1
                if bins:
                    kept.append((bins, held))
            if kept:
                gaps.setdefault(gap, []).extend(kept)
            if not n:
                break
        most = capacity // s
        put(n // most, ((s, most),), capacity - s * most)
        put(1 if n % most else 0, ((s, n % most),), capacity - s * (n % most))
    return [entry for gap in sorted(gaps) for entry in gaps[gap]]


def slots(bins: list[tuple[int, tuple]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """The plan by size: entries of ascending (size, rank) with the rank of their first piece, their first bin, pieces in
    a bin, and the place in the bin of the first of them."""
    rows, taken, first = [], [0] * (capacity + 1), 0
    for number, held in bins:
        offset = 0
        for s, times in held:
            rows.append((s, taken[s], first, times, offset))
            taken[s] += number * times
            offset += s * times
        first += number
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {name: table[:, k].copy() for k, name in enumerate(("size", "rank", "bin", "times", "offset"))}


def placed(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = table.sparkSession
    counts = work.written(table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    sizes = {s: n for s, n in counts.groupBy("length").agg(F.sum("n")).collect()}  # a row for each size
    at = slots(plan(sizes, capacity), capacity)
    shared = spark.sparkContext.broadcast(at)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    base = work.written(base.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("before")), "piece-ranks")
    how = "broadcast" if base.count() <= BROADCAST_PARTS else "shuffle_hash"
    ranked = table.join(base.hint(how), "part").withColumn("rank", F.col("place") + F.element_at("before", F.col("length"))).drop("before", "place", "part")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        top = int(at["rank"].max(initial=0)) + 1
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            top = max(top, int(rank.max(initial=0)) + 1)
            k = np.searchsorted(at["size"] * top + at["rank"], size * top + rank, "right") - 1
            j = rank - at["rank"][k]
            sequence, offset = at["bin"][k] + j // at["times"][k], at["offset"][k] + j % at["times"][k] * size
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset.astype(np.int32))], names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return ranked.mapInArrow(deal, "doc_id long, piece int, start long, length int, ids binary, sequence_id long, offset int")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences of pieces that come ordered by sequence and offset; the last one of a batch may go on in the next."""
    columns, rest = ("sequence_id", "doc_id", "piece", "start", "length", "ids"), None

    def made(table: pa.Table) -> pa.RecordBatch:
        sequence = table["sequence_id"].to_numpy()
        first = np.flatnonzero(np.diff(sequence, prepend=sequence[0] - 1))
        edges = pa.array(np.append(first, len(sequence)).astype(np.int32))
        body = table["ids"].combine_chunks().cast(pa.large_binary())
        _, offsets, data = body.buffers()
        ends = np.frombuffer(offsets, np.int64)[body.offset : body.offset + len(body) + 1]
        joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(ends[first], ends[-1])), data]).cast(pa.binary())
        lists = [pa.ListArray.from_arrays(edges, table[c].combine_chunks()) for c in columns[1:5]]
        return pa.RecordBatch.from_arrays([pa.array(sequence[first]), *lists, joined], names=["sequence_id", "doc_ids", "pieces", "starts", "lengths", "ids"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch.select(list(columns))])
        table = table if rest is None else pa.concat_tables([rest, table])
        sequence = table["sequence_id"].to_numpy()
        upto = int(np.searchsorted(sequence, sequence[-1]))
        if upto:
            yield made(table.slice(0, upto))
        rest = table.slice(upto)
    if rest is not None:
        yield made(rest)


def sequences(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """The packed sequences with their ids (two bytes each, little-endian), written to the shared folder: sequence_id,
    ids, and for each of their pieces in order doc_ids, pieces, starts (in the document) and lengths."""
    table = pieces(docs, capacity=capacity, **options)
    dealt = placed(table, capacity)
    # A piece that fills its sequence stays where it is; only the others are moved to meet.
    alone = dealt.where(F.col("length") == capacity).mapInArrow(_assemble, SEQUENCES)
    rest = 2 * (table.where(F.col("length") < capacity).agg(F.sum("length")).first()[0] or 0)
    met = dealt.where(F.col("length") < capacity).repartition(max(1, -(-rest // PARTITION_BYTES)), "sequence_id")
    met = met.sortWithinPartitions("sequence_id", "offset").mapInArrow(_assemble, SEQUENCES)
    return work.written(alone.unionByName(met), "sequences", compression="zstd")


def digest(packed: DataFrame) -> DataFrame:
    """A row for each piece that the sequences hold: where it lies, and the checksum of its ids there."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = np.diff(batch.column("lengths").offsets.to_numpy())
            doc_id, piece, start, length = (batch.column(c).flatten() for c in ("doc_ids", "pieces", "starts", "lengths"))
            long = length.to_numpy().astype(np.int64)
            first = np.cumsum(many) - many
            ends = np.cumsum(long)
            offset = ends - long
            crc, edges = np.zeros(len(long), np.int64), np.cumsum(np.append(0, many))
            for k, body in enumerate(batch.column("ids")):
                ids = memoryview(np.frombuffer(body.as_buffer(), "<u2").astype("<u4").tobytes())
                base = int(offset[edges[k]])
                for p in range(int(edges[k]), int(edges[k + 1])):
                    crc[p] = zlib.crc32(ids[4 * (int(offset[p]) - base) : 4 * (int(ends[p]) - base)])
            offset = offset - np.repeat(offset[first], many)
            sequence = batch.column("sequence_id").to_numpy()
            arrays = [doc_id, piece, start, pa.array(long), pa.array(crc), pa.array(np.repeat(sequence, many)), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return packed.mapInArrow(read, DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(sequences(work.documents(spark, sf_dir)))
