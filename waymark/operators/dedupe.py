"""Duplicates: among ranked results, as pairs over a table, and as connected classes of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, text
from ..sources.store import sent, written
from .spatial import spread

#: Places of different names, layers or coordinates in one cell that are still compared pair by pair.
CROWDED = 128
#: Characters of a gram: names of fewer are alike only if equal.
GRAM = 4


def _near(a: Column, b: Column, meters: float) -> Column:
    """No farther than `meters` in one layer, nearer than half of it in two."""
    d = geo.haversine(a["lat"], a["lon"], b["lat"], b["lon"])
    return F.when(a["layer"] == b["layer"], d <= meters).otherwise(d < meters / 2)


def is_duplicate(a: Column, b: Column, meters: float) -> Column:
    """Same gid; same source and id; or similar names that are near."""
    same = (a["gid"] == b["gid"]) | ((a["source"] == b["source"]) & (a["source_id"] == b["source_id"]))
    return F.coalesce(same, F.lit(False)) | F.coalesce(text.names_similar(a["normal"], b["normal"]) & _near(a, b, meters), F.lit(False))


def _grams(name: Column) -> Column:
    """The distinct grams of a name; the name itself, marked, if it is too short to be held in another."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - GRAM + 1)), lambda k: F.substring(name, k, F.lit(GRAM)))
    return F.when(F.length(name) < GRAM, F.array(F.concat(F.lit("="), name))).otherwise(F.array_distinct(each))


def _contained(near: DataFrame, here: DataFrame, meters: float) -> DataFrame:
    """a, b: places l of `near` (cy, cx, l) whose name is held in that of a place r of `here` (cy, cx, r) of the same cell,
    and which are near each other. A name that holds l's holds all its grams, so l asks for the one that the fewest
    names of the cell hold, and asks nothing where one of its grams is held by none: rows follow true pairs."""
    cell = ["cy", "cx"]
    held = written(here.select(*cell, "r", F.explode(_grams(F.col("r.normal"))).alias("gram")))
    counts = held.groupBy(*cell, "gram").agg(F.count(F.lit(1)).alias("n"))
    asked = near.withColumn("grams", _grams(F.col("l.normal")))
    asked = asked.select(*cell, "l", F.size("grams").alias("many"), F.explode("grams").alias("gram")).join(counts.hint("shuffle_hash"), [*cell, "gram"])
    asked = asked.groupBy(*cell, "l").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count(F.lit(1)).alias("found"), F.first("many").alias("many"))
    asked = written(asked.where("found = many").drop("found", "many"))
    held, asked = spread(held, asked, [*cell, "gram"], "r._id")
    met = asked.join(held.hint("shuffle_hash"), [*cell, "gram", "part"])
    inside = F.when(F.length("l.normal") < GRAM, F.col("l.normal") == F.col("r.normal")).otherwise(F.contains("r.normal", "l.normal"))
    met = met.where((F.col("l._id") != F.col("r._id")) & inside).where(_near(F.col("l"), F.col("r"), meters))
    return met.select(F.least("l._id", "r._id").alias("a"), F.greatest("l._id", "r._id").alias("b"))


def results(hits: DataFrame, meters: float = 30.0, by: str = "query_id") -> DataFrame:
    """Per query, in the order of rank, hits that duplicate no hit kept before; with deduped_count. A query's hits are
    few (their number is the query's size), so they are folded in one array."""
    one = F.struct("rank", "gid", "source", "source_id", "layer", "lat", "lon", text.clean(F.lower("name")).alias("normal"), "_id")
    lists = hits.groupBy(by).agg(F.array_sort(F.collect_list(one)).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: is_duplicate(y, x, meters)), acc).otherwise(F.array_append(acc, x)))
    out = lists.withColumn("kept", kept)
    return out.select(by, (F.size("all") - F.size("kept")).alias("deduped_count"), F.posexplode("kept").alias("at", "k")).select(by, (F.col("at") + 1).alias("rank"), F.col("k._id").alias("_id"), "deduped_count")


def pairs(docs: DataFrame, meters: float = 30.0, crowded: int = CROWDED) -> DataFrame:
    """a, b (a < b): duplicates over a table. Equal gids and source ids are linked to their group's smallest; similar
    names meet in grid cells, of which each document has one and is looked for in nine. Documents of one name, layer
    and place are one there: the smallest is compared, and the others are linked to it. In a cell of more than `crowded`
    of them names meet on their rarest grams."""
    d = docs.withColumn("normal", text.clean(F.lower("name")))
    out = None
    for keys in (["gid"], ["source", "source_id"]):
        known = d.where(F.col(keys[0]).isNotNull() & F.col(keys[-1]).isNotNull())
        least = known.groupBy(*keys).agg(F.min("_id").alias("a"), F.max("_id").alias("most")).where("a < most").drop("most")
        one = known.select("_id", *keys).join(least.hint("merge"), keys).where("_id > a").select("a", F.col("_id").alias("b"))
        out = one if out is None else out.unionByName(one)
    size = geo.lat_rows(meters)
    cols = ("_id", "layer", "lat", "lon", "normal")
    same = ["normal", "layer", "lat", "lon"]
    valid = d.where(geo.valid_point(F.col("lat"), F.col("lon")))
    firsts = written(valid.groupBy(*same).agg(F.min("_id").alias("_id"), F.max("_id").alias("last")))
    # Equal places are duplicates whatever their ids; null and blank names are alike to nothing.
    behind = firsts.where((F.col("_id") < F.col("last")) & F.coalesce(text.names_similar(F.col("normal"), F.col("normal")), F.lit(False))).select(F.col("_id").alias("a"), *same)
    equal = valid.select("_id", *same).join(behind.hint("merge"), same).where("_id > a").select("a", F.col("_id").alias("b"))
    out = out.unionByName(equal)
    # A name that is null or blank meets nothing.
    here = firsts.where(F.coalesce(F.col("normal") != "", F.lit(False))).select(F.struct(*cols).alias("r"), geo.cell(F.col("lat"), size).alias("cy"), geo.cell(F.col("lon"), size).alias("cx"))
    reach = geo.lon_cells(F.col("r.lat"), meters, size)
    near = here.select(F.col("r").alias("l"), F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)).alias("cy"), "cx", reach.alias("reach")).withColumn("cx", F.explode(F.sequence(F.col("cx") - F.col("reach"), F.col("cx") + F.col("reach")))).drop("reach")
    full = written(here.groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("cy", "cx"))
    n = full.count()
    if n:
        split = lambda df, how: df.join(sent(full, n), ["cy", "cx"], how)
        out = out.unionByName(_contained(split(near, "left_semi"), split(here, "left_semi"), meters))
        near, here = split(near, "left_anti"), split(here, "left_anti")
    met = near.join(here.hint("shuffle_hash"), ["cy", "cx"]).where(F.col("l._id") < F.col("r._id"))
    met = met.where(text.names_similar(F.col("l.normal"), F.col("r.normal"))).where(_near(F.col("l"), F.col("r"), meters))
    return out.unionByName(met.select(F.col("l._id").alias("a"), F.col("r._id").alias("b"))).distinct()


def classes(links: DataFrame, write) -> DataFrame:
    """node, label: the smallest node that links (a, b) reach, by label propagation with pointer jumping. `write` cuts
    lineage: it stores a table and returns it."""
    both = write(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels = write(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "other").hint("merge"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(seen.hint("merge"), "node").select("node", F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = write(step.join(jump.hint("merge"), "label", "left").select("node", F.coalesce(F.least("label", "root"), "label").alias("label")))
        if new.join(labels.withColumnRenamed("label", "old").hint("merge"), "node").where("label <> old").isEmpty():
            return new
        labels = new


def better(by: list[str]) -> list[Column]:
    """The order in which rows of one class are preferred: confidence, a routable point, categories, more filled
    columns, smaller distance, then id."""
    filled = F.size(F.filter(F.array(*[F.col(c).cast("string") for c in by]), lambda x: x.isNotNull()))
    return [F.desc_nulls_last("confidence"), F.desc("has_routable"), F.desc("n_categories"), filled.desc(), F.asc_nulls_last("distance"), F.asc("_id")]


def table(docs: DataFrame, links: DataFrame, write, order: list[Column]) -> DataFrame:
    """One document for each class, the best; documents without links stay."""
    found = classes(links, write)
    rows = docs.join(found.withColumnRenamed("node", "_id").hint("merge"), "_id", "left").withColumn("label", F.coalesce("label", "_id"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where("nth = 1").drop("nth")
