"""Benchmark decontamination by Wu-Manber multi-pattern search.

The patterns are windows of ten consecutive words of benchmark items (an item of fewer, but not none, is one
window). Texts and patterns are brought to one form, lower-case words with one space around each, so a window
occurs exactly where its bytes occur. The search follows Wu and Manber: a shift table over blocks of B bytes
says how far the window of m bytes (the shortest pattern) may move without missing a pattern; where the shift
is 0, the block's hash selects a bucket of patterns; their first bytes and then all their bytes are compared.
A batch is searched in many lanes at once, each step of numpy moving every lane by its own shift. Patterns are
split into classes of length, so that a short one does not take the shifts from the long ones.

Patterns are held by every task, so they are cut into blocks of at most MAX_PATTERN_BYTES, a bound that is
checked; more patterns mean more blocks, each searched against all documents, and the hits are united.

Defined cases: a null or empty text has no words and is not contaminated; items of null text or no words have
no windows; items with a null id take no part; an item_id on several rows is one item with the windows of all;
windows that several items share count for each; repeated documents give a row each; empty tables give no rows
or no hits; other columns are ignored by `search` and kept by `clean`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import texts, work

WINDOW = 10
#: Bytes of windows that a task holds at a time.
MAX_PATTERN_BYTES = 32 << 20
_LANE = 1024
_TABLE_BITS = 20
_SPACE = 32
_DOC = 0
#: Least length of a class's patterns and the bytes of its blocks.
_CLASSES = ((48, 8), (16, 8), (8, 4), (3, 2))

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
SPANS = "row long, n_words long, item_id long, first_word int, last_word int"


class Matcher:
    """Tables of one length class: patterns are bytes objects of at least m bytes."""

    def __init__(self, patterns: list[bytes], m: int, block: int):
        self.patterns, self.m, self.block = patterns, min(map(len, patterns)), block
        assert self.m >= m >= block
        self.dtype = f"<u{block}"
        size = 1 << _TABLE_BITS
        self.shift = np.full(size, self.m - block + 1, np.int32)
        heads = np.array([list(p[: self.m]) for p in patterns], np.uint8)
        for j in range(self.m - block + 1):
            key = self.key(np.ascontiguousarray(heads[:, j : j + block]).view(self.dtype)[:, 0])
            np.minimum.at(self.shift, key, self.m - block - j)
        last = self.key(np.ascontiguousarray(heads[:, self.m - block : self.m]).view(self.dtype)[:, 0])
        self.order = np.argsort(last, kind="stable")
        self.bucket, self.first, self.count = np.unique(last[self.order], return_index=True, return_counts=True)
        self.prefix = np.ascontiguousarray(heads[:, :block]).view(self.dtype)[:, 0]
        self.bytes = [np.frombuffer(p, np.uint8) for p in patterns]
        self.length = np.array([len(p) for p in patterns])

    def key(self, block: np.ndarray) -> np.ndarray:
        return ((block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def search(self, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and pattern numbers of all occurrences."""
        n, m, b = len(out), self.m, self.block
        none = np.zeros(0, np.int64)
        if n < m:
            return none, none
        blocks = np.ndarray((n - b + 1,), self.dtype, buffer=out, strides=(1,))
        at = np.arange(0, n - m + 1, _LANE)
        end = np.minimum(at + _LANE, n - m + 1)
        found, keys = [none], [none]
        while len(at):
            key = self.key(blocks[at + (m - b)])
            step = self.shift[key]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
                keys.append(key[hit])
            at = at + np.maximum(step, 1)
            live = at < end
            if not live.all():
                at, end = at[live], end[live]
        at, key = np.concatenate(found), np.concatenate(keys)
        if not len(at):
            return none, none
        slot = np.searchsorted(self.bucket, key)
        count = self.count[slot]
        each = np.repeat(np.arange(len(at)), count)
        inner = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        pattern = self.order[np.repeat(self.first[slot], count) + inner]
        at = at[each]
        ok = (blocks[at] == self.prefix[pattern]) & (at + self.length[pattern] <= n)
        at, pattern = at[ok], pattern[ok]
        good = np.zeros(len(at), bool)
        by = np.argsort(pattern, kind="stable")
        edges = np.flatnonzero(np.diff(pattern[by], prepend=-1, append=-1)) if len(by) else none
        for lo, hi in zip(edges[:-1], edges[1:]):
            own = by[lo:hi]
            wanted = self.bytes[pattern[own[0]]]
            for part in range(0, len(own), 4096):
                some = own[part : part + 4096]
                good[some] = (out[at[some][:, None] + np.arange(len(wanted))] == wanted).all(1)
        return at[good], pattern[good]


class Patterns:
    """One block of patterns, ready to search: windows, the items of each and their numbers of words."""

    def __init__(self, windows: dict[bytes, set[int]]):
        self.matchers: list[tuple[Matcher, list[bytes]]] = []
        self.items = {w: sorted(i) for w, i in windows.items()}
        rest = sorted(self.items)
        for least, block in _CLASSES:
            own = [w for w in rest if len(w) >= least]
            rest = [w for w in rest if len(w) < least]
            if own:
                self.matchers.append((Matcher(own, least, block), own))

    def hits(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, bytes]]]:
        """Words of each document, and for each pattern that occurs: documents and first words (within the document)."""
        low, starts, ends, first = texts.words(buf, off)
        out, begins = canonical(low, starts, ends, first)
        found = []
        for matcher, names in self.matchers:
            at, pattern = matcher.search(out)
            if len(at):
                word = np.searchsorted(begins, at + 1)
                doc = np.searchsorted(first, word, "right") - 1
                by = np.argsort(pattern, kind="stable")
                cut = np.flatnonzero(np.diff(pattern[by])) + 1
                for own in np.split(by, cut):
                    found.append((doc[own], word[own] - first[doc[own]], names[pattern[own[0]]]))
        return np.diff(first), found


def canonical(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with one space before and after each, a zero byte before each document; and where each word begins."""
    length, docs = ends - starts, len(first) - 1
    doc = np.repeat(np.arange(docs), np.diff(first))
    begins = np.cumsum(length) - length + np.arange(len(length)) + 2 * (doc + 1)
    total = int(length.sum()) + len(length) + 2 * docs
    out = np.full(total, _SPACE, np.uint8)
    out[begins[first[:-1][np.diff(first) > 0]] - 2] = _DOC
    source = low[low != 0]
    spot = np.arange(len(source)) + np.repeat(begins - (np.cumsum(length) - length), length)
    out[spot] = source
    return out, begins


def windows_of(text: str | None, width: int = WINDOW) -> list[bytes]:
    """The windows of one benchmark item in canonical form."""
    low = texts.WORD[np.frombuffer((text or "").encode(), np.uint8)].tobytes()
    words = [w for w in low.split(b"\0") if w]
    if not words:
        return []
    return [b" " + b" ".join(words[k : k + width]) + b" " for k in range(max(1, len(words) - width + 1))]


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """window, item_id, block: distinct windows of all items, in blocks of bounded size."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), [windows_of(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "window": pa.array([w for f in found for w in f], pa.binary()),
                "item_id": pa.array([i for i, f in zip(ids, found) for _ in f], pa.int64()),
            })

    made = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), "text")
    made = made.mapInArrow(make, "window binary, item_id long").distinct()
    return work.written(made, "windows")


def blocks(made: DataFrame, most: int = MAX_PATTERN_BYTES) -> list[DataFrame]:
    """The windows with their items, cut by a hash of both into as many parts as keep each under `most` bytes, so that
    a window of very many items is cut, too; a part's size is checked."""
    total = made.agg(F.sum(F.length("window") + 64)).first()[0] or 0
    parts = max(1, -(-2 * total // most)) if total > most else 1
    return [made.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(parts)) == k) if parts > 1 else made for k in range(parts)]


def held(part: DataFrame, most: int = MAX_PATTERN_BYTES) -> Patterns:
    """A part's patterns, brought to the driver after its size was checked."""
    size = part.agg(F.sum(F.length("window") + 64)).first()[0] or 0
    if size > 2 * most:
        raise ValueError(f"a block of patterns has {size} bytes; raise `most`")
    found: dict[bytes, set[int]] = {}
    for window, item in part.collect():
        found.setdefault(bytes(window), set()).add(item)
    return Patterns(found)


def digest(items: set[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def search(docs: DataFrame, items: DataFrame, width: int = WINDOW, most: int = MAX_PATTERN_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    spark = docs.sparkSession
    work.prepare(spark)
    parts = blocks(windows(items, width), most)
    if len(parts) == 1:
        patterns = spark.sparkContext.broadcast(held(parts[0], most))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, n_hit, n_items, sha = _digests(batch.column("text"), patterns.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(sha, pa.string()), pa.array(n_hit > 0)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, RESULT)
    numbered = work.written(docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row")), "decontaminate", compression="zstd")
    spans = [_spans(numbered, spark.sparkContext.broadcast(held(p, most))) for p in parts]
    return _united(numbered, spans)


def _digests(column: pa.Array, patterns: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    buf, off = texts.buffer(column)
    docs = len(off) - 1
    n_words, n_hit, n_items = (np.zeros(docs, np.int64) for _ in range(3))
    clean = digest(set())
    sha = [clean] * docs
    for lo, hi in texts.slices(off):
        own = off[lo : hi + 1] - off[lo]
        words, found = patterns.hits(buf[off[lo] : off[hi]], own)
        n_words[lo:hi] = words
        if not found:
            continue
        base = np.cumsum(words) - words
        edge = np.zeros(int(words.sum()) + 1, np.int64)
        items: dict[int, set[int]] = {}
        for doc, word, window in found:
            np.add.at(edge, base[doc] + word, 1)
            np.add.at(edge, base[doc] + word + window.count(b" ") - 1, -1)
            for d in np.unique(doc).tolist():
                items.setdefault(d, set()).update(patterns.items[window])
        covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        n_hit[lo:hi] = covered[base + words] - covered[base]
        for d, some in items.items():
            n_items[lo + d], sha[lo + d] = len(some), digest(some)
    return n_words, n_hit, n_items, sha


def _spans(numbered: DataFrame, patterns) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy()
            buf, off = texts.buffer(batch.column("text"))
            for lo, hi in texts.slices(off):
                words, found = patterns.value.hits(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                none = np.zeros(0, np.int64)
                doc = np.concatenate([none, *(np.repeat(d, len(patterns.value.items[w])) for d, _, w in found)])
                item = np.concatenate([none, *(np.tile(patterns.value.items[w], len(d)) for d, _, w in found)])
                first = np.concatenate([none, *(np.repeat(k, len(patterns.value.items[w])) for _, k, w in found)])
                long = np.concatenate([none, *(np.full(len(d) * len(patterns.value.items[w]), w.count(b" ") - 1) for d, _, w in found)])
                yield pa.RecordBatch.from_arrays([pa.array(rows[lo + doc]), pa.array(words[doc]), pa.array(item), pa.array(first.astype(np.int32)), pa.array((first + long).astype(np.int32))], names=["row", "n_words", "item_id", "first_word", "last_word"])

    return numbered.select("row", "text").mapInArrow(scan, SPANS)


def _united(numbered: DataFrame, spans: list[DataFrame]) -> DataFrame:
    """Digests from spans of several blocks: hit words are counted over the union of a document's spans."""
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    every = work.written(every.distinct(), "spans")
    hit = every.select("row", F.explode(F.expr("sequence(first_word, last_word - 1)")).alias("word")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    ids = every.select("row", F.col("item_id").cast("string").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("ids"))
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = numbered.withColumn("n_words", F.regexp_count(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long")).drop("text")
    out = out.join(hit.hint("merge"), "row", "left").join(ids.hint("merge"), "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ","), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, in which no window of any item occurs. One block: one pass over the texts."""
    spark = docs.sparkSession
    work.prepare(spark)
    for part in blocks(windows(items, width)):
        patterns = spark.sparkContext.broadcast(held(part))

        def keep(batches: Iterator[pa.RecordBatch], patterns=patterns) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_hit = _digests(batch.column("text"), patterns.value)[1]
                yield batch.filter(pa.array(n_hit == 0))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(work.documents(spark, sf_dir), work.table(spark, sf_dir, "benchmark"))
