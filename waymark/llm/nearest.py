"""Approximate nearest neighbours: a hierarchical k-means tree with best-bin-first search.

Largest inner product is brought to least distance: each vector gets one more component, the root of what its
squared norm lacks to the largest one; queries get 0. A tree of k-means splits is fitted on a bounded sample
on the driver; then every vector of the table is dealt to its leaf. Leaves of a large table hold more than SPLIT
vectors: each of them gets a subtree, fitted in Spark on a bounded sample of its own members, and so on, so that
leaves stay small at any size of the table. A search descends to the nearest child and keeps the others in a
priority queue, so leaves come in the order of their bins' distances; of each level it takes as many as were
needed, on a bounded set of calibration queries searched exhaustively, for RECALL of their true neighbours, and
goes on until the leaves taken hold k + 1 vectors. Exact scores in double precision on the original vectors decide
among what the leaves hold.

Equal vectors are one vector in the tree, known by its k + 1 smallest ids: more can't be among k neighbours,
so nothing is lost and a group of equal vectors, however large, is one row. Leaves are cut into packs of
bounded size, and the queries that visit a leaf into groups, so no leaf's members meet in one task.

Defined cases: a vector that is null, zero, or that holds null or non-finite components takes no part, as query or
candidate; vectors of one length are a table of their own, since others have no inner product with them (the
lengths are few: each is searched in turn); a null id takes no part; with
fewer than k candidates all are returned; ties go to the smaller id; rows with one id and vector count once,
rows with one id and several vectors as several candidates; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import work

K = 20
RECALL = 0.97
#: Sample on which the tree is fitted, and queries on which the visits are calibrated.
FIT_ROWS, CALIBRATION = 40_000, 256
BRANCH, LEAF = 16, 24
#: Leaves that a table has: about this times the root of its vectors, while the sample has LEAF vectors for each.
LEAVES = 0.5
#: Vectors of a pack and queries of a group.
PACK, GROUP = 1024, 256
#: Vectors that a leaf holds without a subtree; sample of a leaf on which that is fitted; levels of subtrees at most.
SPLIT, SUB_FIT, LEVELS = 8192, 4096, 4
#: Leaves have numbers from FIRST_LEAF on, those of a leaf's subtree from FAN times its number.
FIRST_LEAF, FAN = 1 << 20, 4096
FOUND = "query long, vec_id long, score double"


class Tree:
    """Centers as one matrix per node, leaves by number."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 3):
        self.rng, self.branch, self.least = np.random.default_rng(seed), branch, leaf
        self.centers: list[np.ndarray] = []
        self.children: list[list[int]] = []  # node number, or -1 - leaf
        self.leaves = 0
        self.root = self._split(x)

    def _split(self, x: np.ndarray) -> int:
        parts, centers = self._kmeans(x) if len(x) > self.least else (None, None)
        if parts is None or len(centers) < 2:
            self.leaves += 1
            return -self.leaves
        number = len(self.centers)
        self.centers.append(centers)
        self.children.append([])
        self.children[number] = [self._split(x[parts == k]) for k in range(len(centers))]
        return number

    def _kmeans(self, x: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
        centers = x[self.rng.choice(len(x), min(self.branch, len(x)), replace=False)]
        for _ in range(rounds):
            part = _closest(x, centers)
            kept = np.unique(part)
            centers = np.stack([x[part == k].mean(0) for k in kept])
        part = _closest(x, centers)
        kept, part = np.unique(part, return_inverse=True)
        return part, centers[kept]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by descent to the nearest child."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                part = _closest(x[rows], self.centers[node])
                todo += [(child, rows[part == k]) for k, child in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> tuple[list[int], list[float]]:
        """The first `most` leaves in best-bin-first order and their bins' distances, more of them while those taken
        hold under `least` vectors."""
        queue, out, far_of, tie, held = [(0.0, 0, self.root)], [], [], 0, 0
        while queue and (len(out) < most or held < least):
            near, _, node = heapq.heappop(queue)
            while node >= 0:
                gap = self.centers[node] - q
                far = np.einsum("ij,ij->i", gap, gap)
                best = int(far.argmin())
                for k, (d, child) in enumerate(zip(far.tolist(), self.children[node])):
                    if k != best:
                        tie += 1
                        heapq.heappush(queue, (d, tie, child))
                near, node = float(far[best]), self.children[node][best]
            out.append(-1 - node)
            far_of.append(near)
            held += int(sizes[-1 - node]) if sizes is not None else 0
        return out, far_of


def _closest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centers * centers).sum(1) / 2
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = (x[lo : lo + 4096] @ centers.T - half).argmax(1)
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of doubles, none of them null, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def usable(vectors: DataFrame, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """vec_id, v of the rows that take part, v as doubles."""
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """uid, v, ids: distinct vectors, each with its k + 1 smallest ids; uid is the smallest.

    Ids are ranked before they are gathered, with a limit that Spark applies in each task before the exchange.
    """
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("uid"), "v", "ids")


def _extended(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], 1)


def _score(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the order of the components, so that they don't depend on the batch."""
    return np.einsum("ij,kj->ik", q, x, optimize=False)


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest of each row, with all that tie with the last of them."""
    if score.shape[1] > k:
        return np.nonzero(score >= -np.partition(-score, k - 1, axis=1)[:, k - 1 : k])
    return np.nonzero(np.ones(score.shape, bool))


def _rows(ids: np.ndarray, uid: np.ndarray, score: np.ndarray, k: int) -> pa.RecordBatch:
    row, at = _best(score, k)
    return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(uid[at]), pa.array(score[row, at])], names=["query", "vec_id", "score"])


def grouped(rows: DataFrame, counts: DataFrame, size: int, number: str, ids: str, data: str) -> DataFrame:
    """node, `number`, `ids`, `data`: the (uid, v) of a node in lists of about `size`, dealt by a hash of the uid."""
    parts = counts.select("node", F.ceil(F.col("n") / size).cast("int").alias("parts"))
    dealt = rows.join(parts.hint("merge"), "node").withColumn(number, F.pmod(F.xxhash64("uid"), "parts").cast("int"))
    lists = dealt.groupBy("node", number).agg(F.collect_list(F.struct("uid", "v")).alias("m"))
    return lists.select("node", number, F.col("m.uid").alias(ids), F.flatten("m.v").alias(data))


def exhaustive(unique: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> dict[int, list[int]]:
    """True neighbours of a bounded set of queries: each task keeps its k best, one row per query and task."""
    shared = unique.sparkSession.sparkContext.broadcast((ids, q))
    width = q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for batch in batches:
            yield _rows(ids, batch.column("uid").to_numpy(), _score(q, _matrix(batch.column("v"), width)), k)

    found = unique.select("uid", "v").mapInArrow(run, FOUND)
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    out: dict[int, list[int]] = {}
    for query, uid in found.withColumn("nth", nth).where(F.col("nth") <= k).select("query", "vec_id").collect():
        out.setdefault(query, []).append(uid)
    return out


def quantile(ranks: list[int], recall: float) -> int:
    """Visits that find `recall` of the true neighbours: each is found once its leaf is visited, so they are a
    quantile of the places of these leaves."""
    return int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


def sized(index: DataFrame) -> DataFrame:
    return work.written(index.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "leaf-sizes")


def subtrees(index: DataFrame, sizes: DataFrame, top: float, width: int) -> DataFrame:
    """node, tree for the leaves of more than SPLIT vectors: fitted on about SUB_FIT members of each."""
    big = sizes.where(F.col("n") > SPLIT)
    draw = F.pmod(F.xxhash64("uid", F.lit(23)), F.lit(1 << 30)) * F.col("n") < F.lit(float(SUB_FIT << 30))
    some = index.join(big.hint("merge"), "node").where(draw).select("node", "n", "v")

    def fit(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("v").combine_chunks(), width)
        # Leaves of about a quarter of SPLIT, if the sample has LEAF vectors for each.
        leaf = max(LEAF, int(len(x) * SPLIT / 4 / table.column("n")[0].as_py()))
        return pa.table({"node": table.column("node").slice(0, 1), "tree": pa.array([pickle.dumps(Tree(_extended(x, top), leaf=leaf))], pa.binary())})

    return work.written(some.groupBy("node").applyInArrow(fit, "node long, tree binary"), "subtrees")


def split(index: DataFrame, sizes: DataFrame, trees: DataFrame, top: float, width: int) -> DataFrame:
    """index with the members of nodes that have a subtree dealt to its leaves."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                uid, data = (batch.column(c)[n].values for c in ("uids", "data"))
                x = data.to_numpy().reshape(-1, width)
                leaf = batch.column("node")[n].as_py() * FAN + pickle.loads(batch.column("tree")[n].as_py()).assign(_extended(x, top))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), data)
                yield pa.RecordBatch.from_arrays([uid, lists, pa.array(leaf)], names=["uid", "v", "node"])

    lists = grouped(index, sizes.where(F.col("n") > SPLIT), PACK, "pack", "uids", "data").join(trees.hint("merge"), "node")
    dealt = lists.select("node", "uids", "data", "tree").mapInArrow(deal, "uid long, v array<double>, node long")
    return work.written(index.join(trees.select("node").hint("merge"), "node", "left_anti").select("uid", "v", "node").unionByName(dealt), "leaves")


def descended(asked: DataFrame, wanted: DataFrame, trees: DataFrame, width: int) -> DataFrame:
    """asked (uid, node, far) with the leaves of subtrees in place of their nodes."""
    below = asked.join(trees.select("node").hint("merge"), "node", "left_semi")
    counts = work.written(below.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "asked-sizes")
    lists = grouped(below.join(wanted.hint("merge"), "uid"), counts, GROUP, "part", "q_ids", "q").join(trees.hint("merge"), "node")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                tree, node = pickle.loads(batch.column("tree")[n].as_py()), batch.column("node")[n].as_py()
                q = batch.column("q")[n].values.to_numpy().reshape(-1, width)
                found = [tree.visits(np.append(x, 0.0), tree.leaves) for x in q]
                ids = np.repeat(batch.column("q_ids")[n].values.to_numpy(), [len(leaf) for leaf, _ in found])
                leaf, far = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(node * FAN + leaf.astype(np.int64)), pa.array(far.astype(np.float64))], names=["uid", "node", "far"])

    down = lists.select("node", "q_ids", "q", "tree").mapInArrow(visit, "uid long, node long, far double")
    return asked.join(trees.select("node").hint("merge"), "node", "left_anti").select("uid", "node", "far").unionByName(down)


def search(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with other rows, nearest first."""
    spark = vectors.sparkSession
    work.prepare(spark)
    rows = work.written(usable(vectors), "vectors")
    widths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
    found = [_search(rows.where(F.size("v") == w), w, is_query, k, recall) for w in widths]
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if not found else found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(rows: DataFrame, width: int, is_query: Column, k: int, recall: float) -> DataFrame:
    spark = rows.sparkSession
    # Vectors are few bytes and much work: tasks are dealt by number, so that Spark does not merge them by size.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unique = work.written(distinct(rows, k).repartition(tasks, "uid"), "vectors-distinct")
    asked = work.written(rows.where(is_query).distinct(), "queries")
    sources = asked.join(unique.select("uid", "v").hint("merge"), "v").select(F.col("vec_id").alias("query_id"), "uid")
    sources = work.written(sources, "query-vectors")
    wanted = work.written(unique.select("uid", "v").join(sources.select("uid").distinct().hint("merge"), "uid", "left_semi"), "query-distinct")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    top, count = unique.agg(F.max(square), F.count(F.lit(1))).first()
    draw = F.xxhash64("uid", F.lit(11))
    fit = unique.orderBy(draw, "uid").limit(FIT_ROWS).select("v").toArrow().column("v").combine_chunks()
    leaf = max(LEAF, int(min(count, FIT_ROWS) / (LEAVES * count**0.5)))
    tree = Tree(_extended(_matrix(fit, width), top), leaf=leaf)
    shared = spark.sparkContext.broadcast((tree, top))  # FIT_ROWS vectors at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, top = shared.value
        for batch in batches:
            node = tree.assign(_extended(_matrix(batch.column("v"), width), top)) + FIRST_LEAF
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("v"), pa.array(node)], names=["uid", "v", "node"])

    index = work.written(unique.select("uid", "v").mapInArrow(deal, "uid long, v array<double>, node long"), "leaves")
    sizes = sized(index)
    held = np.zeros(tree.leaves, np.int64)
    for node, n in sizes.collect():  # a row for each leaf of the tree of the sample
        held[node - FIRST_LEAF] = n
    levels = 1
    while levels <= LEVELS and held.max(initial=0) > SPLIT * (SUB_FIT / LEAF) ** (levels - 1):
        levels += 1
    share = 1 - (1 - recall) / levels
    # Calibration: a bounded set of queries and their true neighbours, themselves left out, by a scan of all rows.
    probe = wanted.orderBy(draw, "uid").limit(CALIBRATION).toArrow()
    ids, q = probe.column("uid").to_numpy(), _matrix(probe.column("v").combine_chunks(), width)
    truth = [(query, u) for query, own in exhaustive(unique, ids, q, k + 1).items() for u in [u for u in own if u != query][:k]]
    true = work.written(spark.createDataFrame(truth, "asked long, uid long"), "true-neighbours")  # CALIBRATION * k rows at most

    def placed() -> DataFrame:
        """asked, node of each true neighbour."""
        return true.join(index.select("uid", "node").hint("merge"), "uid").select("asked", "node")

    order = {i: {leaf: n for n, leaf in enumerate(tree.visits(np.append(x, 0.0), tree.leaves)[0])} for i, x in zip(ids.tolist(), q)}
    ranks = [order[query][node - FIRST_LEAF] for query, node in placed().collect()]
    visits = quantile(ranks, share) if ranks else tree.leaves

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, _ = shared.value
        for batch in batches:
            found = [tree.visits(np.append(x, 0.0), visits, held, k + 1) for x in _matrix(batch.column("v"), width)]
            ids = np.repeat(batch.column("uid").to_numpy(), [len(leaf) for leaf, _ in found])
            leaf, far = (np.concatenate([np.zeros(0), *x]) for x in zip(*found)) if found else (np.zeros(0),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(leaf.astype(np.int64) + FIRST_LEAF), pa.array(far)], names=["uid", "node", "far"])

    met = work.written(wanted.repartition(tasks, "uid").mapInArrow(visit, "uid long, node long, far double"), "visits")
    for _ in range(levels - 1):
        trees = subtrees(index, sizes, top, width)
        index = split(index, sizes, trees, top, width)
        sizes = sized(index)
        place = Window.partitionBy("uid").orderBy("far", "node")
        met = descended(met, wanted, trees, width).join(sizes.hint("merge"), "node")
        met = met.withColumn("place", F.row_number().over(place)).withColumn("before", F.coalesce(F.sum("n").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        met = work.written(met, "visits")
        ranks = [r[0] - 1 for r in placed().join(met.withColumnRenamed("uid", "asked").hint("merge"), ["asked", "node"]).select("place").collect()]
        visits = quantile(ranks, share) if ranks else 1
        met = met.where((F.col("place") <= visits) | (F.col("before") < k + 1)).select("uid", "node", "far")
    # Lists of queries and of vectors of each leaf meet, so that no leaf's members and no leaf's queries are in one task.
    met = met.select("uid", "node")
    counts = work.written(met.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "asked-sizes")
    asked = grouped(met.join(wanted.hint("merge"), "uid"), counts, GROUP, "part", "q_ids", "q")
    parts = sizes.select("node", F.sequence(F.lit(0), F.ceil(F.col("n") / PACK).cast("int") - 1).alias("packs"))
    asked = asked.join(parts.hint("merge"), "node").select("node", F.explode("packs").alias("pack"), "q_ids", "q")
    pairs = asked.repartition(4 * tasks, "node", "pack").join(grouped(index, sizes, PACK, "pack", "uids", "data").repartition(4 * tasks, "node", "pack").hint("merge"), ["node", "pack"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                ids, uid = (batch.column(c)[n].values.to_numpy() for c in ("q_ids", "uids"))
                q, x = (batch.column(c)[n].values.to_numpy().reshape(-1, width) for c in ("q", "data"))
                yield _rows(ids, uid, _score(q, x), k + 1)

    found = pairs.mapInArrow(compare, FOUND)
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    found = work.written(found.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("query", F.col("vec_id").alias("uid"), "score"), "found")
    # Back from distinct vectors to rows: a vector's ids all have its score, and a query is no candidate of its own.
    named = found.join(unique.select("uid", "ids").hint("merge"), "uid").select("query", "score", F.explode("ids").alias("vec_id"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    named = work.written(named.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"), "named")
    lists = named.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("near"))
    out = sources.join(lists.withColumnRenamed("query", "uid").hint("merge"), "uid")
    kept = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(kept).alias("at", "n"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.minus")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(work.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
