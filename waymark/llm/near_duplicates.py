"""MinHash near-dedup with BagMinHash: weighted-Jaccard signatures, banding, exact check, connected classes.

Signatures. A document is a multiset of shingles of five words; a shingle's count is its weight. Weights are
discretised into dyadic ranges [0,1), [1,2), [2,4), ...; every (shingle, range) owns a Poisson process in time
whose rate is the range's length, so ranges form a hierarchy that all documents share. Each point has a time, a
height inside its range and a component of the signature; a document of weight w sees the points below w. A
component's value is its earliest point: two documents agree in it with the probability of their weighted
Jaccard similarity. Points are made in the order of time and only until every component is settled: a horizon
is set from the document's total weight, and widened for the few documents that it leaves unsettled.

Linking. Rows of one text count as one (its smallest doc_id). Band values meet in groups. Pairs are checked on
the texts themselves: similarity of the multisets of shingles at least `threshold`. First each text is compared
with the smallest of a group, the one with which it shares most bands. That joins many near copies at a cost in
proportion to them. Groups that still hold several classes are compared member by member, classes against classes: a
group's largest class is one side, its other members are both sides, each side is dealt in blocks by a hash, and a
task gets two blocks of signatures. A pair is a candidate if one text is not much longer than the other and they agree
in so many components that fewer have a chance under 1e-6 at the threshold. Where a task has few candidates for its
members, it names them, and they are compared as in the first step. Where it has many (texts around one template),
it names the members alone: their shingles go to a task that compares them in place and returns links that join what
was not joined yet, less than one for each member. These links are checked on the texts as all others are, and a task
with a link that they refuse is done again without it, so what is linked does not depend on how full a group is. So no pair that meets in a band is left out but by that chance, no
group is in one task, and no list of all its pairs is made; arithmetic alone is quadratic, in members of different
classes. Links join classes by min-label propagation in Spark.

Defined cases: a text without words (null, empty, marks only) is never linked; a text of one to four words is
one shingle; repeated rows of one doc_id share its class; ties go to the smaller doc_id; null doc_ids are kept
and never linked; an empty table gives no rows; other columns are ignored by `classes`, kept by `distinct`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import texts, work

WIDTH = 5
THRESHOLD = 0.8
#: Bands of rows: a pair at the threshold misses all of them with probability under 1e-7.
BANDS, ROWS = 32, 4
SIZE = BANDS * ROWS
#: Standard deviations under the mean agreement at the threshold that a candidate may lie: a chance under 1e-6.
DEVIATIONS = 4.9
#: Members of a block, and shingles that they have, about; a task compares two. Candidates for each member that it names.
BLOCK, MASS, NAMED = 2048, 2 << 20, 4
U = np.uint64


def _unit(h: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1) from the upper bits of hashes."""
    return ((h >> U(12)).astype(np.float64) + 0.5) / float(1 << 52)


def weighted(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with counts, documents ascending."""
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    if not len(doc):
        return doc, shingle, np.zeros(0, np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    return doc[at], shingle[at], np.diff(at, append=len(doc))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, size: int = SIZE) -> np.ndarray:
    """(docs, size) uint64 values of BagMinHash: the hash of the point that is first in each component; 0 without shingles."""
    best = np.full(docs * size, np.inf)
    name = np.zeros(docs * size, U)
    if not len(doc):
        return name.reshape(docs, size)
    # One process for each element and dyadic range below its weight; `time` is that of its next point.
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1
    element = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, np.exp2(level - 1.0))
    rate = np.maximum(low, 1.0)
    owner, top = doc[element], weight[element].astype(np.float64)
    state = texts.mixed(shingle[element] + level.astype(U) * U(0x9E3779B97F4A7C15))
    time = -np.log(_unit(state)) / rate
    mass = np.bincount(doc, weight, docs)
    horizon = np.where(mass > 0, size * (np.log(size) + 4.0) / np.maximum(mass, 1.0), 0.0)
    rest = np.arange(len(element))
    while len(rest):
        todo = rest[time[rest] <= horizon[owner[rest]]]
        while len(todo):
            point = texts.mixed(state[todo] ^ U(0xA0761D6478BD642F))
            seen = low[todo] + rate[todo] * _unit(texts.mixed(point)) < top[todo]
            who, point = todo[seen], point[seen]
            spot = owner[who] * size + (point >> U(32)).astype(np.int64) % size
            better = time[who] < best[spot]
            spot, when, point = spot[better], time[who[better]], point[better]
            order = np.argsort(-when, kind="stable")  # the earliest is written last
            best[spot[order]], name[spot[order]] = when[order], point[order]
            state[todo] = texts.mixed(state[todo] + U(0xD1B54A32D192ED03))
            time[todo] -= np.log(_unit(state[todo])) / rate[todo]
            todo = todo[time[todo] <= horizon[owner[todo]]]
        unsettled = np.isinf(best).reshape(docs, size).any(1) & (mass > 0)
        horizon[unsettled] *= 2
        rest = rest[unsettled[owner[rest]]]
    return name.reshape(docs, size)


def band_keys(names: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """For each document the keys of its bands, and of each second band with the one after it."""
    docs = len(names)
    salt = texts.mixed(np.arange(bands * rows, dtype=U) + U(1))
    each = texts.mixed(names * (salt | U(1))).reshape(docs, bands, rows).sum(2, dtype=U)
    wide = each[:, 0::2] * U(3) + each[:, 1::2]
    tag = np.arange(bands + wide.shape[1], dtype=U)
    return texts.mixed(np.concatenate([each, wide], 1) + texts.mixed(tag + U(77)))


def _multisets(column: pa.Array, most: int = 3 << 20):
    """For runs of documents: first, number of documents, (document, shingle, count) arrays."""
    buf, off = texts.buffer(column)
    for lo, hi in texts.slices(off, most):
        low, starts, ends, first = texts.words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        shingle, doc = texts.shingles(texts.hashes(low, starts, ends), first, WIDTH)
        yield lo, hi - lo, weighted(doc, shingle)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, keys, digest, mass for each row: keys and digest are null for a text without words; digest has
    a byte of each component of the signature; mass is the number of shingles."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, (doc, shingle, weight) in _multisets(batch.column("text")):
                names = signatures(doc, shingle, weight, n)
                keys, digest = band_keys(names), (names >> U(40)).astype(np.uint8)
                some = np.zeros(n, bool)
                some[doc] = True
                flat = pa.array(keys[some].reshape(-1).view(np.int64))
                off = pa.array(np.concatenate([[0], np.cumsum(some * keys.shape[1])]).astype(np.int32), mask=np.append(~some, False))
                digests = pa.array([row.tobytes() if has else None for row, has in zip(digest, some)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), batch.column("text_key").slice(lo, n), pa.ListArray.from_arrays(off, flat), digests, pa.array(np.bincount(doc, weight, n).astype(np.int64))], names=["doc_id", "text_key", "keys", "digest", "mass"])

    rows = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"), "text")
    return rows.mapInArrow(make, "doc_id long, text_key binary, keys array<long>, digest binary, mass long")


def similarities(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of two columns of texts, row by row."""
    out = np.zeros(len(a))
    step = 256
    for at in range(0, len(a), step):
        parts = []
        for column in (a.slice(at, step), b.slice(at, step)):
            d, s, w = [], [], []
            for lo, _, (doc, shingle, weight) in _multisets(column):
                d.append(doc + lo), s.append(shingle), w.append(weight)
            parts.append([np.concatenate(x) if x else np.zeros(0, np.int64) for x in (d, s, w)])
        n = min(step, len(a) - at)
        doc, shingle, weight = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((shingle, doc))
        doc, shingle, weight = doc[order], shingle[order], weight[order]
        both = np.flatnonzero((doc[1:] == doc[:-1]) & (shingle[1:] == shingle[:-1]))
        shared = np.bincount(doc[both], np.minimum(weight[both], weight[both + 1]), n)
        total = np.bincount(doc, weight, n)
        out[at : at + n] = shared / np.maximum(total - shared, 1)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node that links reach) of a table of links (a, b): large-star and small-star
    steps in turn until nothing moves. Both are sums over neighbours, so a node with many links is no hot group."""
    edges = work.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    while True:
        # Large star: larger neighbours of each node go to the smallest of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours of each node, and itself, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u")
        small = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = work.written(small, "links")
        if _same(edges, new):
            return new.select(F.col("u").alias("node"), F.col("v").alias("label"))
        edges = new


def _same(a: DataFrame, b: DataFrame) -> bool:
    digest = [F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))]
    return tuple(a.agg(*digest).first()) == tuple(b.agg(*digest).first())


#: Pairs of one document that are checked by one task, about.
SALT_ROWS = 512


def checked(pairs: DataFrame, texts_of: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity is at least `threshold`. b may be one document for many a: its pairs are
    dealt by a salt, and its text goes to each of them."""
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    many = work.written(many.where("salts > 1"), "salts")
    salts = F.coalesce("salts", F.lit(1))
    salted = pairs.join(many.hint("merge"), "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), salts).cast("int"))
    right = texts_of.join(many.withColumnRenamed("b", "node").hint("merge"), "node", "left")
    right = right.select(F.col("node").alias("b"), F.col("text").alias("text_b"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    rows = salted.select("a", "b", "salt").join(right.hint("merge"), ["b", "salt"])
    rows = rows.join(texts_of.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = similarities(batch.column("text_a"), batch.column("text_b")) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def least_agreement(threshold: float, size: int = SIZE) -> int:
    """Components in which two texts at the threshold agree at least, but for DEVIATIONS; bytes agree by chance, too."""
    p = threshold + (1 - threshold) / 256
    return int(np.floor(size * p - DEVIATIONS * np.sqrt(size * p * (1 - p))))


def alike(digest: np.ndarray, label: np.ndarray, mass: np.ndarray, right: np.ndarray, threshold: float, most: int, step: int = 1 << 22) -> tuple[list, np.ndarray]:
    """Members of one task that may be alike: pairs (rows of left and right side) while they are `most` at most, and all
    members in such pairs. `step` bytes are compared at once, and no list of pairs outgrows `most`."""
    least = least_agreement(threshold)
    x = np.flatnonzero(~right)
    y = np.flatnonzero(right) if right.any() else x
    pairs, met, many = [], np.zeros(len(digest), bool), 0
    rows = max(1, step // max(1, digest[y].size))
    for lo in range(0, len(x), rows):
        i = x[lo : lo + rows]
        good = (digest[i][:, None, :] == digest[y][None, :, :]).sum(2, dtype=np.uint8) >= least
        good &= label[i][:, None] != label[y][None, :]
        good &= np.minimum(mass[i][:, None], mass[y][None, :]) >= threshold * np.maximum(mass[i][:, None], mass[y][None, :]) - 1e-9
        if y is x:
            good &= i[:, None] < y[None, :]
        met[i] |= good.any(1)
        met[y] |= good.any(0)
        many += int(good.sum())
        if many <= most:
            a, b = np.nonzero(good)
            pairs.append(np.stack([i[a], y[b]]))
    return (pairs if many <= most else []), met


def candidates(open_: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """For rows (key, node, label, digest, mass) of groups that hold several classes: pairs (a, b) of members of
    different classes that may be alike, and rows (key, r, x, node, label, right) of tasks that have many of them."""
    sizes = open_.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"), F.sum("mass").alias("mass"))
    sizes = sizes.groupBy("key").agg(F.sum("size").alias("n"), F.sum("mass").alias("mass"), F.max(F.struct("size", "label", "mass")).alias("top"))
    parts = lambda n, mass: F.greatest(F.ceil(n / BLOCK), F.ceil(mass / MASS)).cast("int")
    sizes = sizes.select("key", F.col("top.label").alias("most"), parts(F.col("top.size"), F.col("top.mass")).alias("wide"), parts(F.col("n") - F.col("top.size"), F.col("mass") - F.col("top.mass")).alias("rest"))
    sizes = work.written(sizes, "open-sizes")
    rows = open_.join(sizes.hint("merge"), "key").withColumn("main", F.col("label") == F.col("most"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("wide")).otherwise(F.col("rest"))).cast("int"))
    # Tasks of a group: (r, x) for two blocks of the rest, r <= x, and (r, rest + w) for one and a block of the largest class.
    own = F.sequence(F.lit(0), F.col("rest") + F.col("wide") - 1)
    from_rest = F.transform(own, lambda x: F.struct(F.least("block", x).alias("r"), F.greatest("block", x).alias("x")))
    from_main = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda r: F.struct(r.alias("r"), (F.col("rest") + F.col("block")).alias("x")))
    rows = rows.withColumn("task", F.explode(F.when(F.col("main"), from_main).otherwise(from_rest)))
    # In a task of two blocks the second one is the right side; in one of a block with itself it is both.
    right = F.when(F.col("main"), F.lit(True)).otherwise((F.col("block") == F.col("task.x")) & (F.col("task.r") != F.col("task.x")))
    member = F.struct("node", "label", right.alias("right"), "digest", "mass")
    # Dealt anew: rows lie by key after the join, and all tasks of a large group would stay in one place.
    tasks = rows.repartition("key", "task").groupBy("key", "task").agg(F.collect_list(member).alias("m"))
    tasks = tasks.select("key", F.col("task.r").alias("r"), F.col("task.x").alias("x"), *[F.col(f"m.{c}").alias(c) for c in ("node", "label", "right", "digest", "mass")])
    names = ["key", "r", "x", "node", "label", "right", "other"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                node, label, right, mass = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("node", "label", "right", "mass"))
                digest = texts.buffer(batch.column("digest")[k].values)[0].reshape(-1, SIZE)
                pairs, met = alike(digest, label, mass, right, threshold, NAMED * len(node))
                place = [batch.column(c)[k].as_py() for c in ("key", "r", "x")]
                if pairs or not met.any():
                    i, j = np.concatenate([np.zeros((2, 0), np.int64), *pairs], 1)
                    a, b = np.maximum(node[i], node[j]), np.minimum(node[i], node[j])
                    out.append((a, b, np.zeros(len(a), np.int64), np.zeros(len(a), bool), *(np.full(len(a), v) for v in (0, 0, 0)), np.zeros(len(a), bool)))
                else:
                    own = np.flatnonzero(met)
                    out.append((node[own], node[own], label[own], right[own], *(np.full(len(own), v) for v in place), np.ones(len(own), bool)))
            if out:
                a, b, label, right, key, r, x, many = (np.concatenate(c) for c in zip(*out))
                columns = [pa.array(key.astype(np.int64)), pa.array(r.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(a), pa.array(label), pa.array(right), pa.array(b, mask=many)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    found = tasks.mapInArrow(compare, "key long, r int, x int, node long, label long, right boolean, other long")
    found = work.written(found, "candidates")
    pairs = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    return pairs, found.where("other is null").drop("other")


def shingled(texts_of: DataFrame, bits: int = 32) -> DataFrame:
    """node, shingles of (node, text): the multiset as a set, each shingle hashed with its number among equal ones. Equal
    hashes of different shingles (`bits` wide) can only make two texts look more alike."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, (doc, shingle, weight) in _multisets(batch.column("text")):
                nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                own, where = texts.mixed(np.repeat(shingle, weight) + nth.astype(U) * U(0x9E3779B97F4A7C15)), np.repeat(doc, weight)
                cut = np.searchsorted(where, np.arange(n + 1))
                raw = pa.array([(own[a:z] >> U(64 - bits)).astype("<u4").tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, n), raw], names=["node", "shingles"])

    return texts_of.select("node", "text").mapInArrow(make, "node long, shingles binary")


def joins(node: np.ndarray, label: np.ndarray, right: np.ndarray, shingles: list[bytes], threshold: float, refused: frozenset = frozenset()) -> list[tuple[int, int]]:
    """Links (a, b) among members of one task that join classes which are not joined yet: members of the left side are
    compared with all of the right side (with each other if there is none), similarity from counts of shared shingles.
    Pairs in `refused` join nothing."""
    size = np.array([len(x) // 4 for x in shingles])
    _, feature = np.unique(np.frombuffer(b"".join(shingles), "<u4"), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])
    x = np.flatnonzero(~right)
    y = np.flatnonzero(right) if right.any() else x
    flat = feature if len(y) == len(size) else np.concatenate([feature[begin[j] : begin[j + 1]] for j in y])
    starts = np.concatenate([[0], np.cumsum(size[y])])[:-1]
    mark = np.zeros(feature.max(initial=0) + 1, np.int32)
    _, group = np.unique(label, return_inverse=True)
    out = []
    for i in x:
        own = feature[begin[i] : begin[i + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[flat], starts)
        mark[own] = 0
        for j in y[shared >= threshold * (size[i] + size[y] - shared) - 1e-9]:
            pair = (max(int(node[i]), int(node[j])), min(int(node[i]), int(node[j])))
            if group[i] != group[j] and pair not in refused:
                group[group == group[j]] = group[i]
                out.append(pair)
    return out


def compared(dense: DataFrame, texts_of: DataFrame, threshold: float, bits: int = 32) -> DataFrame:
    """Links (a, b) of the tasks (key, r, x) in `dense`, each confirmed on the texts."""
    place = ["key", "r", "x"]
    if dense.isEmpty():
        return dense.select(F.col("node").alias("a"), F.col("node").alias("b"))
    needed = work.written(dense.select("node").distinct(), "dense-nodes")
    own = work.written(shingled(texts_of.join(needed.hint("merge"), "node", "left_semi"), bits), "dense-shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                node, label, right = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("node", "label", "right"))
                refused = frozenset((p["a"], p["b"]) for p in batch.column("refused")[k].as_py() or ())
                found = joins(node, label, right, batch.column("shingles")[k].values.to_pylist(), threshold, refused)
                at = [pa.array([batch.column(c)[k].as_py()] * len(found), t) for c, t in zip(place, (pa.int64(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*at, pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=[*place, "a", "b"])

    refused = work.written(dense.limit(0).select(*place, F.col("node").alias("a"), F.col("node").alias("b")), "refused")
    todo, out = dense, None
    while True:
        tasks = todo.join(own.hint("merge"), "node").groupBy(*place).agg(F.collect_list(F.struct("node", "label", "right", "shingles")).alias("m"))
        known = refused.groupBy(*place).agg(F.collect_list(F.struct("a", "b")).alias("refused"))
        tasks = tasks.join(known.hint("merge"), place, "left")
        tasks = tasks.select(*place, *[F.col(f"m.{c}").alias(c) for c in ("node", "label", "right", "shingles")], "refused")
        found = work.written(tasks.mapInArrow(compare, "key long, r int, x int, a long, b long"), "dense-links")
        good = work.written(checked(found.select("a", "b").distinct(), texts_of, threshold), "dense-good")
        out = good if out is None else out.unionByName(good)
        wrong = work.written(found.join(good.hint("merge"), ["a", "b"], "left_anti").select(*place, "a", "b"), "wrong")
        if wrong.isEmpty():
            return out.distinct()
        # Once more without these, and only where they were met: what they seemed to join may be joined by others.
        refused = work.written(refused.unionByName(wrong), "refused")
        todo = dense.join(wrong.select(*place).distinct().hint("merge"), place, "left_semi")


def _labelled(met: DataFrame, labels: DataFrame) -> DataFrame:
    """met with each node's class as `label`."""
    return met.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id for each row: the smallest doc_id that its text is linked to, directly or through others."""
    work.prepare(docs.sparkSession)
    rows = work.written(signed(docs), "signed", compression="zstd")
    worded = rows.where("keys is not null and doc_id is not null")
    nodes = worded.groupBy("text_key").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("digest").alias("digest"), F.first("mass").alias("mass"))
    nodes = work.written(nodes, "nodes", compression="zstd")
    each = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    groups = each.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    groups = work.written(groups.select("key", "least"), "groups")
    met = work.written(each.join(groups.hint("merge"), "key"), "met")
    involved = work.written(met.groupBy("node").agg(F.count(F.lit(1)).alias("met")), "involved")
    own = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(involved.select("node").hint("merge"), "node", "left_semi")
    own = work.written(own.groupBy("node").agg(F.min("text").alias("text")), "met-texts", compression="zstd")
    # Each text with the smallest of the groups that it shares most of.
    votes = met.where("node > least").groupBy("node", "least").agg(F.count(F.lit(1)).alias("votes"))
    first = votes.groupBy("node").agg(F.max_by("least", F.struct("votes", -F.col("least"))).alias("least"))
    pairs = work.written(first.select(F.col("node").alias("a"), F.col("least").alias("b")), "pairs")
    links = work.written(checked(pairs, own, threshold), "links")
    labels = components(links)
    # What shares a pair of bands shares each of them.
    rest = work.written(_labelled(met.where(F.col("band") < BANDS).select("key", "node"), labels), "labelled")
    mark = F.sum(F.xxhash64("node").cast("decimal(38,0)"))
    sets = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), mark.alias("mark"), F.count(F.lit(1)).alias("n")).where("low < high")
    # Groups of the same members are compared once.
    sets = work.written(sets.groupBy("mark", "n").agg(F.min("key").alias("key")).select("key"), "open")
    rest = rest.join(sets.hint("merge"), "key").join(nodes.select("node", "digest", "mass").hint("merge"), "node")
    rest = work.written(rest.select("key", "node", "label", "digest", "mass"), "open-members")
    pairs, dense = candidates(rest, threshold)
    more = checked(work.written(pairs, "pairs"), own, threshold).unionByName(compared(dense, own, threshold))
    labels = components(links.unionByName(work.written(more, "links")))
    named = nodes.select("text_key", "node").join(labels.hint("merge"), "node", "left").select("text_key", F.coalesce("label", "node").alias("class_id"))
    out = worded.select("doc_id", "text_key").join(work.written(named, "named").hint("merge"), "text_key").select("doc_id", "class_id")
    return out.unionByName(rows.where("keys is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id")))


def distinct(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, the one with the smallest doc_id, with all columns; rows without doc_id stay."""
    found = work.written(classes(docs, threshold), "classes")
    keep, nth = work.unused(docs, "keep"), work.unused(docs, "nth")
    kept = work.written(found.where("doc_id = class_id").select(F.col("doc_id").alias(keep)).distinct(), "kept")
    rows = docs.join(kept.hint("merge"), F.col("doc_id") == F.col(keep), "left_semi")
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(nth) == 1).drop(nth)
    return rows.unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(work.documents(spark, sf_dir))
