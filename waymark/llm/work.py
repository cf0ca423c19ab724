"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..ship import ship


#: Rows of an Arrow batch: whole texts go to Python tasks, and a batch of Spark's default 10,000 is tens of MB.
BATCH_ROWS = "2000"


def prepare(spark: SparkSession) -> None:
    """Ship the package; make Arrow batches smaller unless the session sets their size itself."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def base(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only where it is unset and tasks run on this machine."""
    prepare(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{base(spark)}/waymark/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it. Spark's names of S3 are names of Hadoop's clients alone."""
    scheme, sep, rest = uri.partition("://")
    return fs.FileSystem.from_uri("s3://" + rest if sep and scheme in ("s3a", "s3n") else uri)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
