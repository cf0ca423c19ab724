"""The labelled rows that a classifier is fitted on: a bounded sample, chosen by hash, never the held-out part."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import work

#: Bounds of the sample on which classifiers are fitted: rows, and bytes of text.
MAX_ROWS, MAX_BYTES = 3_000, 10 << 20
#: Of either label a tenth of the rows and bytes is drawn first; texts over this part of the bytes are drawn last.
FIRST, LONG = 10, 64


def held_out() -> Column:
    """Rows that nothing is learnt from: crc32 of doc_id as text, modulo 5, is 0. False for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = MAX_ROWS, most: int = MAX_BYTES) -> pd.DataFrame:
    """text, label of at most `rows` labelled rows and `most` bytes, on the driver, in the order of a hash of doc_id.

    Rows that do not fit are passed over, not the end of the sample; of a rare label a tenth of the bounds is kept free.
    A doc_id with several labels counts with the largest; null labels and null doc_ids take no part.
    """
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    own = own.withColumn("draw", F.xxhash64("doc_id"))
    sizes = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    sizes = own.join(sizes, "doc_id").where((F.col("n") <= most) & (F.col("rows") <= rows)).withColumn("long", F.col("n") > most // LONG)
    sizes = _first_draws(work.written(sizes, "sample-sizes"), rows)
    nth = F.row_number().over(Window.partitionBy("label").orderBy("long", "draw", "doc_id"))
    drawn = sizes.withColumn("nth", nth).where(F.col("nth") <= rows).select("doc_id", "label", "draw", "long", "n", "rows").toPandas()
    chosen = _chosen(drawn.sort_values(["long", "draw", "doc_id"]), rows, most)
    # At most `rows` ids: small enough for every task.
    ids = docs.sparkSession.createDataFrame([(int(i),) for i in chosen], "doc_id long")
    met = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id")
    found = met.toPandas().merge(drawn[["doc_id", "draw", "label"]], "left", "doc_id")
    return found.sort_values(["draw", "text"], kind="stable", na_position="first")[["text", "label"]].reset_index(drop=True)


def _first_draws(sizes: DataFrame, rows: int) -> DataFrame:
    """The rows with the least draws of each (label, long): `rows` at least, or all, and few more, whatever the number of
    rows or tasks. Draws are uniform, so a bound on them comes from counts; it is raised where it left too few."""
    count = lambda df: {(r.label, r.long): r.n for r in df.groupBy("label", "long").agg(F.count(F.lit(1)).alias("n")).collect()}
    many = count(sizes)
    share = {k: (rows + 8 * math.sqrt(rows) + 64) / n for k, n in many.items()}
    while True:
        keep = F.lit(False)
        for (label, long), part in share.items():
            most = F.lit(-(1 << 63) + int(part * (1 << 64))) if part < 1 else F.lit((1 << 63) - 1)
            keep = keep | ((F.col("label") == label) & (F.col("long") == long) & (F.col("draw") <= most))
        near = sizes.where(keep)
        kept = count(near)
        few = [k for k, n in many.items() if kept.get(k, 0) < min(rows, n)]
        if not few:
            return near
        share |= {k: 2 * share[k] for k in few}


def _chosen(drawn: pd.DataFrame, rows: int, most: int) -> list[int]:
    """doc_ids in the order given that fit, those that don't left out: first some of each label, then of all."""
    out: dict[int, None] = {}
    left = [rows, most]

    def take(part: pd.DataFrame, own: list[int]) -> None:
        for doc_id, n, count in zip(part["doc_id"], part["n"], part["rows"]):
            if doc_id not in out and count <= min(own[0], left[0]) and n <= min(own[1], left[1]):
                out[doc_id] = None
                for bound in (own, left) if own is not left else (left,):
                    bound[0], bound[1] = bound[0] - count, bound[1] - n

    for _, part in drawn.groupby("label", sort=True):
        take(part, [rows // FIRST, most // FIRST])
    take(drawn, left)
    return list(out)
