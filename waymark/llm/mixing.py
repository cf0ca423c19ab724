"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets. Sources sorted by code point, null last, weigh WEIGHTS in turn and share all words of the corpus.
A source's target stops at MAX_EPOCHS times its size; what it gives up goes to the others by weight, until
none is above its cap. That is one water level: it begins as if no source were full and rises with the words that
full sources give up, a sum over the sources for each rise, until no further source is full. Each rise fills a
source at least, and few are needed in practice. Ranks of sources come from ranges of names, so that no step has
all sources in one task.

Sampling. Each document of a source is taken floor(target / size) times whole. What is then missing is taken
once more in the order of a seeded hash: documents whole while they fit, the one on the edge by the words
that are still missing. So a source's words meet its target to the word, and a rerun takes the same ones.
The running sum over a source is taken in two steps, over hash ranges and then inside each, so that a source
with a third of all rows is spread over as many tasks as its rows need.

Defined cases: a null text has no words; a document of no words is taken with 0 words (in `mixed` it is
repeated with its source's whole repetitions); null is a source of its own; ties of the hash (equal doc_id)
are put in order by a row number, equal rows being interchangeable; an empty table gives no rows; other
columns pass through `mixed` unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import work

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
WORDS = r"[^\x20\x09-\x0D]+"
#: Sources that are broadcast at most; each takes a name and four numbers.
BROADCAST_ROWS = 50_000
#: Rows of one hash range, as a mean.
RANGE_ROWS = 4000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, source_rows, target for a table of (source, size): one row per source."""
    per = work.written(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = placed(per, "source").withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs))
    per = work.written(per.drop("place"), "weights")
    total, level = per.agg(F.sum("source_size")).first()[0] or 0, 0.0
    full = F.col("cap") < F.col("weight") * F.lit(level)
    while True:
        kept, room = per.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        higher = (total - kept) / room if room else level
        if higher <= level:
            break
        level, full = higher, F.col("cap") < F.col("weight") * F.lit(higher)
    return per.select("source", "source_size", "source_rows", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def placed(rows: DataFrame, column: str) -> DataFrame:
    """rows with `place`: their number in the order of `column`, null last, from 0. Ranges of the column are numbered
    each by itself, and begin where those before them end."""
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    dealt = rows.repartitionByRange(ranges, F.col(column).asc_nulls_last()).withColumn("range", F.spark_partition_id())
    dealt = work.written(dealt, "ranges")
    sizes, before = dealt.groupBy("range").count().orderBy("range").collect(), 0  # a row for each RANGE_ROWS rows
    begins = []
    for r in sizes:
        begins.append((r["range"], before))
        before += r["count"]
    base = rows.sparkSession.createDataFrame(begins, "range int, begin long")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.col(column).asc_nulls_last())) - 1
    return dealt.withColumn("inside", inside).join(base.hint("shuffle_hash"), "range").withColumn("place", F.col("begin") + F.col("inside")).drop("range", "begin", "inside")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long"))


def plan(docs: DataFrame, seed: str = SEED, row: str | None = None) -> DataFrame:
    """doc_id, source, row, size, source_size, target, whole, taken. `row` numbers the rows, equal ids included:
    a column of `docs`, or numbers given here. The sizes are written out once, so that the texts are read once.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sizes = work.written(sized(docs).select("doc_id", "source", "size", draw.alias("draw"), number.alias("row")), "sizes")
    goal = work.written(targets(sizes), "targets")
    # One row per source: sent to all tasks while it is small, which is checked; else the rows are dealt by source.
    how = "broadcast" if goal.count() <= BROADCAST_ROWS else "shuffle_hash"
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = sizes.withColumn("key", key).join(goal.withColumn("key", key).drop("source").hint(how), "key")
    ranges = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / RANGE_ROWS))
    spot = F.conv(F.substring("draw", 1, 7), 16, 10).cast("double") / float(16**7)
    rows = rows.withColumn("range", F.floor(spot * ranges).cast("long")).drop("source_rows")
    sums = rows.groupBy("key", "range").agg(F.sum("size").alias("words"))
    by_range = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "range", F.coalesce(F.sum("words").over(by_range), F.lit(0)).alias("words_before"))
    inside = Window.partitionBy("key", "range").orderBy("draw", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums.hint("shuffle_hash"), ["key", "range"])
    rows = rows.withColumn("before", F.col("words_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.coalesce(F.floor(F.round(F.col("target")) / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    rows = rows.withColumn("whole", whole)
    rest = F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")
    more = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return rows.select("doc_id", "source", "row", "size", "source_size", "target", "whole", (F.col("whole") * F.col("size") + more).alias("taken"))


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of `docs`: each document as often as it is taken, the part on a source's
    edge as the first words that are still missing."""
    columns = docs.columns
    row, whole, size, taken, copy = (work.unused(docs, c) for c in ("row", "whole", "size", "taken", "copy"))
    kept = work.written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs", compression="zstd")
    how = plan(kept, seed, row).select(*[F.col(c).alias(to) for c, to in (("row", row), ("whole", whole), ("size", size), ("taken", taken))])
    rows = kept.join(how.hint("merge"), row, "left")
    part = F.col(taken) - F.col(whole) * F.col(size)
    times = F.when(F.coalesce(part, F.lit(0)) > 0, F.col(whole) + 1).otherwise(F.coalesce(F.col(whole), F.lit(0)))
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.lit(MAX_EPOCHS)))).where(F.col(copy) <= times)
    cut = (F.col(copy) > F.col(whole)) & (part < F.col(size))
    first = F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0)
    words = F.slice(F.split("text", r"[\x20\x09-\x0D]+"), 1, (part + (F.length(first) > 0).cast("int")).cast("int"))
    text = F.when(cut, F.array_join(words, " ")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(work.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
