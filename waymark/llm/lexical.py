"""Ranked lexical search by pipelined term partitioning.

Index. Documents are taken in blocks of bounded bytes and number; a block's row holds its documents in ascending order of
doc_id, their lengths, its distinct terms and each term's postings (document, occurrences). The terms of all blocks with
their document frequencies, the number of documents and the number of terms complete the index.

Search. Items form bundles of bounded number. The items' terms have owners, by the share of documents that hold them:
owners of rare terms first. For each block, what an owner has for a bundle is one packed row: postings with their
integer values, the items that ask for each term, and for each item the most that later owners can add. A bundle then
passes from owner to owner: each stage is a cogroup on (block, bundle) of its sparse accumulators (item, document,
score) with the owner's row, which adds weight x value and passes on what may still be among the item's best of the
block. A document whose score and all that later owners can add stay under the score of the K-th is left out; its score
is below that of K others in its block whatever follows, so results are exact. The last owner adds the ids of
the documents and picks each item's best K of the block; the best K of all blocks follow by a window.

A block bounds the accumulators of a bundle, so neither a common term nor an item that meets all documents makes a
large group; blocks and rows grow with the corpus, not their size.

Defined cases: null and empty texts have no terms and are not counted; rows of one doc_id are ranked each by itself (a
null doc_id after others of its score); rows of one item_id are one item with the terms of all; null is an item_id like
any other; an item without terms, or whose terms no document holds, has no rows; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import sized
from . import texts, work

TERMS = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hits of an item.
BEST = 50
#: Bytes of text and documents of a block at most (a longer document is a block by itself).
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 4096
#: Items of a bundle, as a mean.
BUNDLE = 256
#: Owners: terms in up to these shares of all documents, the last one has the rest.
SHARES = (1 / 64, 1 / 16, 1 / 4)
#: Bytes of items' terms that are sent to all tasks at once; more take further passes over the index.
PASS_BYTES = 32 << 20

BLOCKS = "block long, doc_ids array<long>, n array<long>, held long, total long, terms array<string>, df array<int>, docs binary, tf binary"
OWNED = "owner int, block long, bundle long, slots int, n_docs int, weights array<long>, many array<int>, docs binary, value binary, n_items array<int>, items array<int>, after array<long>, doc_ids array<long>"
STATE = "block long, bundle long, many array<int>, docs binary, scores binary"
FOUND = "bundle long, slot int, doc_id long, score long"


@dataclass(frozen=True)
class Index:
    """blocks: BLOCKS; terms: term, df; n documents with terms, and all their terms with repeats."""

    blocks: DataFrame
    terms: DataFrame
    n: int
    total: int


def _block(number: int, doc_ids: pa.Array, column: pa.Array) -> pa.RecordBatch:
    """One block's row: the postings of all its terms, ordered by term and document."""
    buf, off = texts.buffer(column)
    low, starts, ends, first = texts.words(buf, off)
    docs, n = len(off) - 1, np.diff(first)
    place = np.empty(docs, np.int64)  # documents by ascending id, null last
    order = pc.sort_indices(doc_ids).to_numpy()
    place[order] = np.arange(docs)
    body = np.ascontiguousarray(low[low != 0])
    edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(body)]).dictionary_encode()
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * docs + np.repeat(place, n), return_counts=True)
    df = np.bincount(key // max(docs, 1), minlength=len(coded.dictionary))
    lists = [pa.array([x.tolist()], pa.list_(t)) for x, t in ((n[order], pa.int64()),)]
    terms = coded.dictionary.cast(pa.binary()).cast(pa.string())
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), one(doc_ids.take(pa.array(order))), *lists, pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()), one(terms), one(pa.array(df.astype(np.int32))),
         pa.array([(key % max(docs, 1)).astype("<u2").tobytes()], pa.binary()), pa.array([tf.astype("<u4").tobytes()], pa.binary())],
        names=["block", "doc_ids", "n", "held", "total", "terms", "df", "docs", "tf"],
    )


def index(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> Index:
    """The index of `docs` (doc_id, text), written to the shared folder; it serves any number of searches."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            return _block(number, table["doc_id"].combine_chunks(), table["text"].combine_chunks())

        for batch in batches:
            long = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            edges, lo = np.concatenate([[0], np.cumsum(long)]), 0
            while lo < batch.num_rows:
                room = block_docs - sum(b.num_rows for b in held)
                hi = min(lo + room, int(np.searchsorted(edges, edges[lo] + block_bytes - size, "right")) - 1)
                hi = max(hi, lo if held else lo + 1)  # a long document begins a block of its own
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
                    size += int(edges[hi] - edges[lo])
                    lo = hi
                if lo < batch.num_rows or size >= block_bytes:
                    yield done()
                    number, held, size = number + 1, [], 0
        if held:
            yield done()

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, BLOCKS)
    blocks = work.written(rows, "lexical-blocks", compression="zstd")
    terms = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    terms = work.written(terms.groupBy("term").agg(F.sum("df").alias("df")), "lexical-terms")
    n, total = blocks.agg(F.sum("held"), F.sum("total")).first()
    return Index(blocks, terms, n or 0, total or 0)


def asked(items: DataFrame, found: Index, shares: tuple[float, ...] = SHARES, bundle: int = BUNDLE) -> tuple[DataFrame, DataFrame]:
    """The items (item_id, bundle, slot, slots: its place in the bundle and the bundle's items), and what they ask for: term,
    weight, owner, bundle, slots, items (slots that ask for the term)."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERMS), 1)
    each = work.written(items.select("item_id", F.explode(F.array_distinct(words)).alias("term")).distinct(), "asked")
    ids = work.written(each.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    bundles = max(1, -(-ids.count() // bundle))
    in_bundle = Window.partitionBy("bundle")
    ids = ids.withColumn("bundle", F.expr(f"pmod(xxhash64(item), {bundles})")).withColumn("slot", F.row_number().over(in_bundle.orderBy("item")) - 1)
    ids = work.written(ids.withColumn("slots", F.count(F.lit(1)).over(in_bundle).cast("int")).drop("item"), "bundles")
    n = float(found.n)
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long")
    owner = F.lit(len(shares))
    for k, share in reversed(list(enumerate(shares))):
        owner = F.when(F.col("df") <= F.lit(share * n), k).otherwise(owner)
    each = each.withColumnRenamed("item_id", "asking").join(ids.hint("merge"), F.col("asking").eqNullSafe(F.col("item_id")))
    per = each.groupBy("term", "bundle").agg(F.sort_array(F.collect_list("slot")).alias("items"), F.first("slots").alias("slots"))
    known = found.terms.join(sized(each.select("term").distinct()), "term")
    return ids, work.written(per.join(sized(known), "term").select("term", weight.alias("weight"), owner.alias("owner"), "bundle", "slots", "items"), "owned-terms")


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + many), one after the other."""
    total = np.cumsum(many)
    return np.repeat(start - (total - many), many) + np.arange(int(total[-1]) if len(total) else 0)


def owned(found: Index, wanted: pa.Table, owners: int) -> DataFrame:
    """What the owners have for each block and bundle: OWNED, a row for each of the owners."""
    spark = found.blocks.sparkSession
    wanted = wanted.sort_by([("bundle", "ascending"), ("owner", "ascending"), ("term", "ascending")]).combine_chunks()
    shared, n, total = spark.sparkContext.broadcast(wanted), found.n, found.total

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        asked_terms = wanted["term"].combine_chunks().cast(pa.string())
        weight, owner, bundle, slots = (wanted[c].to_numpy() for c in ("weight", "owner", "bundle", "slots"))
        items = wanted["items"].combine_chunks()
        item_edges, items = items.offsets.to_numpy().astype(np.int64), items.values.to_numpy()
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                code = pc.index_in(asked_terms, value_set=row["terms"].values)
                at = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
                if not len(at):
                    continue
                code = code.drop_null().to_numpy()
                df = row["df"].values.to_numpy().astype(np.int64)
                begin = (np.cumsum(df) - df)[code]
                many = df[code]
                own = _ranges(begin, many)
                docs = np.frombuffer(row["docs"].as_buffer(), "<u2")[own]
                tf = np.frombuffer(row["tf"].as_buffer(), "<u4")[own].astype(np.int64)
                m = 50 + 50 * row["n"].values.to_numpy() * n // total
                value = 1_000_000_000 * tf // (1000 * tf + 20 * m[docs])
                edges = np.concatenate([[0], np.cumsum(many)])
                most = np.maximum.reduceat(value, edges[:-1]) * weight[at]
                for b in np.unique(bundle[at]).tolist():
                    lo, hi = np.searchsorted(bundle[at], [b, b + 1]).tolist()
                    gain = np.zeros((owners, int(slots[at[lo]])), np.int64)
                    n_items = item_edges[at + 1] - item_edges[at]
                    flat = items[_ranges(item_edges[at[lo:hi]], n_items[lo:hi])]
                    np.add.at(gain, (np.repeat(owner[at[lo:hi]], n_items[lo:hi]), flat), np.repeat(most[lo:hi], n_items[lo:hi]))
                    after = np.cumsum(gain[::-1], 0)[::-1] - gain
                    first_item = np.concatenate([[0], np.cumsum(n_items[lo:hi])])
                    for o in range(owners):
                        a, z = (lo + np.searchsorted(owner[at[lo:hi]], [o, o + 1])).tolist()
                        part = slice(int(edges[a]), int(edges[z]))
                        lists = [weight[at[a:z]].tolist(), many[a:z].tolist(), n_items[a:z].tolist(), flat[first_item[a - lo] : first_item[z - lo]].tolist(), after[o].tolist()]
                        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                        weights, counts, asks, who, later = (pa.array([x], pa.list_(t)) for x, t in zip(lists, types))
                        ids = batch.column("doc_ids").slice(k, 1) if o == owners - 1 else pa.array([[]], pa.list_(pa.int64()))
                        head = [pa.array([o], pa.int32()), batch.column("block").slice(k, 1), pa.array([b], pa.int64()), pa.array([gain.shape[1]], pa.int32()), pa.array([len(m)], pa.int32())]
                        body = [weights, counts, pa.array([docs[part].astype("<u2").tobytes()], pa.binary()), pa.array([value[part].astype("<u4").tobytes()], pa.binary()), asks, who, later, ids]
                        yield pa.RecordBatch.from_arrays([*head, *body], names=[c.split()[0] for c in OWNED.split(", ")])

    return found.blocks.select("block", "doc_ids", "n", "terms", "df", "docs", "tf").mapInArrow(pick, OWNED)


def _added(bundle: pa.Table, own: pa.Table) -> np.ndarray:
    """Scores of the bundle's items (rows) for the block's documents (columns) after the owner's contributions."""
    scores = np.zeros((own["slots"][0].as_py(), own["n_docs"][0].as_py()), np.int64)
    for row in range(bundle.num_rows):
        many = bundle["many"][row].values.to_numpy()
        docs = np.frombuffer(bundle["docs"][row].as_buffer(), "<u2")
        scores[np.repeat(np.arange(len(many)), many), docs] = np.frombuffer(bundle["scores"][row].as_buffer(), "<i8")
    for row in range(own.num_rows):
        docs, value = np.frombuffer(own["docs"][row].as_buffer(), "<u2"), np.frombuffer(own["value"][row].as_buffer(), "<u4").astype(np.int64)
        weights, many, n_items, items = (own[c][row].values.to_numpy() for c in ("weights", "many", "n_items", "items"))
        edge, at = np.cumsum(many).tolist(), np.cumsum(n_items).tolist()
        lo = first = 0
        for w, hi, upto in zip(weights.tolist(), edge, at):
            for item in items[first:upto].tolist():
                scores[item, docs[lo:hi]] += w * value[lo:hi]
            lo, first = hi, upto
    return scores


def _best(scores: np.ndarray, best: int) -> int:
    """The score of the best-th document, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - best)[len(scores) - best]) if len(scores) >= best else 0


def _stage(best: int):
    def step(key: tuple, bundle: pa.Table, own: pa.Table) -> pa.Table:
        scores = _added(bundle, own)
        after = sum(np.array(row.values.to_numpy(), np.int64) for row in own["after"])
        many, docs, kept = [], [], []
        for slot, row in enumerate(scores):
            # Left out is what cannot reach the best-th score of the block any more.
            least = _best(row, best)
            at = np.flatnonzero((row > 0) & (row + after[slot] >= least))
            many.append(len(at))
            docs.append(at.astype("<u2"))
            kept.append(row[at])
        body = [pa.array([many], pa.list_(pa.int32())), pa.array([np.concatenate(docs).tobytes()], pa.binary()), pa.array([np.concatenate(kept).astype("<i8").tobytes()], pa.binary())]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int64()), *body], names=["block", "bundle", "many", "docs", "scores"])

    return step


def _last(best: int):
    def step(key: tuple, bundle: pa.Table, own: pa.Table) -> pa.Table:
        scores = _added(bundle, own)
        slots, docs = [], []
        for slot, row in enumerate(scores):
            at = np.flatnonzero((row > 0) & (row >= _best(row, best)))
            at = at[np.argsort(-row[at], kind="stable")[:best]]  # equal scores by ascending doc_id, as documents lie
            slots.append(np.full(len(at), slot, np.int32))
            docs.append(at)
        slot, doc = np.concatenate(slots), np.concatenate(docs)
        ids = own["doc_ids"][0].values.take(pa.array(doc))
        return pa.table([pa.array(np.full(len(slot), key[1].as_py(), np.int64)), pa.array(slot), ids, pa.array(scores[slot, doc])], names=["bundle", "slot", "doc_id", "score"])

    return step


def search(found: Index, items: DataFrame, best: int = BEST, shares: tuple[float, ...] = SHARES, bundle: int = BUNDLE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents."""
    spark = items.sparkSession
    ids, wanted = asked(items, found, shares, bundle)
    owners = len(shares) + 1
    size = wanted.agg(F.sum(F.octet_length("term") + 4 * F.size("items") + 32)).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    path = work.place(spark, "owned")
    for k in range(passes):
        own = wanted.where(F.expr(f"pmod(xxhash64(term), {passes}) = {k}"))
        owned(found, own.toArrow(), owners).write.mode("append").partitionBy("owner").option("compression", "zstd").parquet(path)
    rows = spark.read.schema(OWNED).parquet(path)
    bundles = spark.createDataFrame([], STATE)  # no accumulators yet
    for o in range(owners):
        step, schema = (_last(best), FOUND) if o == owners - 1 else (_stage(best), STATE)
        own = rows.where(F.col("owner") == o).drop("owner")
        bundles = bundles.groupBy("block", "bundle").cogroup(own.groupBy("block", "bundle")).applyInArrow(step, schema)
    order = Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = bundles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return top.join(sized(ids.select("item_id", "bundle", "slot")), ["bundle", "slot"]).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(work.documents(spark, sf_dir)), work.table(spark, sf_dir, "benchmark"))
