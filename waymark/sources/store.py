"""Where operators keep tables between steps: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def place(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; under a temporary folder only where that is unset and
    tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/waymark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write a table there and read it back."""
    path = place(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def finished(df: DataFrame) -> DataFrame:
    """As `written`; the shuffle files that the table took go with that, not when the driver happens to collect its
    garbage: a query of many steps has the files of one step on disk, not of all."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANED, None)
    conf.set(_CLEANED, "true")
    try:
        return written(df)
    finally:
        conf.unset(_CLEANED) if before is None else conf.set(_CLEANED, before)


#: Rows of a table that is sent to all tasks at most.
SMALL = 200_000


def sized(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A table to be joined by broadcast if it has `most` rows or fewer, else by shuffle: the size is counted, never
    estimated. Counting makes the table once more, so what is long in the making should be written first."""
    return df.hint("broadcast" if df.limit(most + 1).count() <= most else "merge")


def sent(df: DataFrame, rows: int, most: int = SMALL) -> DataFrame:
    """As `sized`, for a table whose rows are counted or bounded already."""
    return df.hint("broadcast" if rows <= most else "merge")


def settled(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A table that is written first and counted as written, so that it is made once."""
    kept = written(df)
    return sent(kept, kept.count(), most)
