"""Versioned document tables: upserts, source-scoped deletes, guards, histories, publishing and rollback."""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import scalars
from ..sources.store import written

HISTORY = 200


def keep_last(docs: DataFrame, order: Column, id_: str = "_id") -> DataFrame:
    """The last row of each id in ingest order."""
    return docs.withColumn("__nth", F.row_number().over(Window.partitionBy(id_).orderBy(order.desc()))).where("__nth = 1").drop("__nth")


def upsert(target: DataFrame, new: DataFrame, order: Column, id_: str = "_id") -> DataFrame:
    """Target with the new rows put in by id; of several new rows of an id the last counts."""
    last = keep_last(new, order, id_)
    return target.join(last.select(id_), id_, "left_anti").unionByName(last.select(*target.columns))


#: Parts of a table that upserts rewrite one by one, and states of it that stay readable.
PARTS, STATES = 64, 3
#: Rows that a part should hold: a part is written by one task, which sorts it.
PART_ROWS = 500_000


def parts_for(rows: int, least: int = 8) -> int:
    """Parts of a table of so many rows: their number grows with it, and a part does not."""
    return max(least, -(-rows // PART_ROWS))


class PartTable:
    """A table in `parts` by a hash of the id, of which an upsert writes only those anew that have new rows.

    A state of the table is a manifest, a small file that names each part's folder. New folders are written first and
    the next manifest last, so a reader sees the table before an upsert or after it, and a crash between leaves a
    folder that nothing names. Manifests are numbered and never replaced: of two upserts at once the second finds
    its number taken and does its work again on the first one's state. The last STATES states keep their folders for
    readers that are under way. Defined cases: an upsert without rows makes no state; a table never written is None.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS, id_: str = "_id"):
        self.spark, self.root, self.parts, self.id_ = spark, root.rstrip("/"), parts, id_
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        folder = self.path(f"{self.root}/manifests")
        if not self.fs.exists(folder):
            return []
        return sorted(int(m[1]) for s in self.fs.listStatus(folder) if (m := re.fullmatch(r"(\d+)\.json", s.getPath().getName())))

    def _manifest(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{number}.json", wholetext=True).first()[0])

    def state(self) -> tuple[int, dict]:
        """Number and content of the newest state; 0 and no folders before the first."""
        numbers = self.numbers()
        return (numbers[-1], self._manifest(numbers[-1])) if numbers else (0, {"schema": None, "folders": {}})

    def _folders(self, state: dict, parts: list[int] | None = None) -> DataFrame | None:
        """Rows of a state, or of some of its parts."""
        chosen = [f for p, f in state["folders"].items() if parts is None or int(p) in parts]
        return self.spark.read.schema(StructType.fromJson(state["schema"])).parquet(*[f"{self.root}/{f}" for f in chosen]) if chosen else None

    def read(self) -> DataFrame | None:
        return self._folders(self.state()[1])

    def upsert(self, new: DataFrame, order: Column) -> None:
        """Put new rows in by id; of several rows of an id, those of the table included, the last by `order` counts."""
        last = written(keep_last(new, order, self.id_).withColumn("part", F.pmod(F.xxhash64(self.id_), F.lit(self.parts)).cast("int")))
        touched = sorted(r[0] for r in last.select("part").distinct().collect())  # at most `parts`
        while touched:
            number, state = self.state()
            rows, old = last, self._folders(state, touched)
            if old is not None:
                old = old.withColumn("part", F.pmod(F.xxhash64(self.id_), F.lit(self.parts)).cast("int"))
                rows = keep_last(last.unionByName(old), order, self.id_)
            folder = f"data-{uuid.uuid4().hex}"
            rows.repartitionById(len(touched), _nth(touched)).write.partitionBy("part").parquet(f"{self.root}/{folder}")
            folders = state["folders"] | {str(p): f"{folder}/part={p}" for p in touched}
            if self._commit(number + 1, {"schema": json.loads(new.schema.json()), "folders": folders}):
                return self._forget()
            self.fs.delete(self.path(f"{self.root}/{folder}"), True)

    def _commit(self, number: int, state: dict) -> bool:
        """Whether the state could be made the one with this number: written under another name, then renamed, which
        fails where the name is taken."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        draft = self.path(f"{self.root}/drafts/{uuid.uuid4().hex}.json")
        out = self.fs.create(draft, False)
        out.writeBytes(json.dumps(state))
        out.close()
        self.fs.mkdirs(self.path(f"{self.root}/manifests"))
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self.fs.getUri(), conf).rename(draft, self.path(f"{self.root}/manifests/{number}.json"), never)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self.fs.delete(draft, False)
            return False
        return True

    def _forget(self) -> None:
        """Remove states before the last STATES, and folders that only they name."""
        numbers = self.numbers()
        kept = {f for n in numbers[-STATES:] for f in self._manifest(n)["folders"].values()}
        for n in numbers[:-STATES]:
            for f in set(self._manifest(n)["folders"].values()) - kept:
                self.fs.delete(self.path(f"{self.root}/{f}"), True)
            self.fs.delete(self.path(f"{self.root}/manifests/{n}.json"), False)


def _nth(parts: list[int]) -> Column:
    """The place of a row's part among these, so that each has a task of its own."""
    return F.array_position(F.lit(parts), F.col("part")).cast("int") - 1


def delete(target: DataFrame, ids: DataFrame, source: str, id_: str = "_id") -> tuple[DataFrame, DataFrame]:
    """Target without the ids, and a report. Ids of other sources are refused; ids that are not there count as done."""
    own = F.col(id_).startswith(f"postgis:{source}:")
    kept = target.join(ids.where(own), id_, "left_anti")
    return kept, ids.select(id_, F.when(own, "deleted").otherwise("failed").alias("status"), F.when(~own, "cross_source_delete_rejected").alias("error"))


def delete_diff(previous: DataFrame, current: DataFrame, id_: str = "_id") -> DataFrame:
    """Ids that were there and are no longer."""
    return previous.select(id_).distinct().join(current.select(id_).distinct(), id_, "left_anti")


def write_seen(ids: DataFrame, path: str) -> None:
    """Replace the seen ids of the sources in `ids` (source_name, document_id), and of no other."""
    ids.distinct().repartition("source_name").sortWithinPartitions("source_name", "document_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_name").parquet(path)


def read_seen(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("document_id string, source_name string").parquet(path).select("source_name", "document_id")


RUN = "run_id string, source string, mode string, started_at timestamp, finished_at timestamp, status string, read long, indexed long, failed long, error string"


def append_runs(runs: DataFrame, path: str) -> None:
    """Append rows of RUN to a history: a run's start with status "running", later its end. Columns not given are null."""
    fields = [f.split(" ") for f in RUN.split(", ")]
    runs.select(*[F.col(c).cast(t).alias(c) if c in runs.columns else F.lit(None).cast(t).alias(c) for c, t in fields]).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str, most: int = HISTORY) -> DataFrame:
    """The newest runs of a history, each as it was told last: an end counts more than a start."""
    told = spark.read.schema(RUN).parquet(path)
    order = Window.partitionBy("run_id").orderBy(F.desc(F.col("finished_at").isNotNull()), F.desc("finished_at"))
    last = told.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return last.orderBy(F.desc("started_at"), "run_id").limit(most)


def write_state(state: DataFrame, path: str) -> None:
    """Replace the state table of the sources (source, last_success, last_indexed_count)."""
    state.write.mode("overwrite").parquet(path)


STATE = "source string, last_success timestamp, last_indexed_count long"


def read_state(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """The state of each configured source (a row of `sources`); nulls where there is none, or no table at all."""
    try:
        found = spark.read.schema(STATE).parquet(path)
    except AnalysisException:
        found = spark.createDataFrame([], STATE)
    return sources.join(found.hint("merge"), "source", "left")


def newest(history: DataFrame, time: str, id_: str, most: int = HISTORY) -> DataFrame:
    """The newest rows of a history, one for each id."""
    one = history.withColumn("__n", F.row_number().over(Window.partitionBy(id_).orderBy(F.desc(time)))).where("__n = 1").drop("__n")
    return one.orderBy(F.desc(time), id_).limit(most)


def latest(history: DataFrame, **equal: str) -> DataFrame:
    """The newest alias switch with given values, such as status="success"."""
    for c, v in equal.items():
        history = history.where(F.col(c) == v)
    return history.orderBy(F.desc("switched_at"), "switch_id").limit(1)


def rollback_candidates(switches: DataFrame) -> DataFrame:
    """Earlier targets of successful switches, newest first, each once, without the current one."""
    done = switches.where("status = 'success'")
    current = done.agg(F.max_by("target_index", F.struct("switched_at", "switch_id")).alias("current"))
    old = done.where("previous_read_index is not null").groupBy(F.col("previous_read_index").alias("target")).agg(F.max("switched_at").alias("last_used"))
    return old.crossJoin(F.broadcast(current)).where("target <> current").select("target", "last_used")  # one row


def count_drop(counts: DataFrame, ratio: float = 0.5, least: int = 100) -> DataFrame:
    """Adds drop_ratio and violation for (source, previous, current[, max_drop_ratio, allow_count_drop])."""
    limit = F.coalesce(F.col("max_drop_ratio"), F.lit(ratio)) if "max_drop_ratio" in counts.columns else F.lit(ratio)
    allowed = F.coalesce(F.col("allow_count_drop"), F.lit(False)) if "allow_count_drop" in counts.columns else F.lit(False)
    drop = scalars.percent_drop(F.col("previous"), F.col("current"))
    bad = ~allowed & (F.col("previous") >= least) & (drop > limit)
    return counts.withColumn("drop_ratio", drop).withColumn("violation", F.when(bad, "unexpected_source_drop"))


def failure_ratio(counts: DataFrame, ratio: float = 0.01) -> DataFrame:
    """Adds failed_ratio and violation for (source, read, failed); nothing read counts as all failed."""
    share = F.when(F.col("read") == 0, 1.0).otherwise(F.col("failed") / F.col("read"))
    return counts.withColumn("failed_ratio", share).withColumn("violation", F.when((F.col("failed") > 0) & (share > ratio), "failure_ratio_exceeded"))


def totals(runs: DataFrame) -> DataFrame:
    return runs.agg(*[F.sum(c).alias(c) for c in ("read", "indexed", "unique_ids", "failed", "deleted")])


def duplicate_ids(docs: DataFrame, id_: str = "_id") -> DataFrame:
    return docs.groupBy("source_config", id_).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def validate(docs: DataFrame, unique: int, failed: int, sample: Column | None = None) -> dict:
    """Whether a version may be published: it has documents, as many as expected, and a sample query finds one."""
    n = docs.count()
    problems = (["empty"] if n == 0 else []) + (["fewer_than_expected"] if n < max(1, unique - failed) else [])
    if n and sample is not None and docs.where(sample).limit(1).isEmpty():
        problems.append("sample_query_without_hit")
    return {"count": n, "valid": not problems, "problems": problems}


class Versions:
    """Blue/green tables in one folder: data in v=N, a pointer table that is replaced as a whole, a history of switches."""

    def __init__(self, spark: SparkSession, root: str, view: str):
        self.spark, self.root, self.view = spark, root.rstrip("/"), view

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def numbers(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return []
        return sorted(int(m[1]) for s in fs.listStatus(path(self.root)) if (m := re.fullmatch(r"v=(\d+)", s.getPath().getName())))

    def switches(self) -> DataFrame | None:
        fs, path = self._fs()
        return self.spark.read.json(f"{self.root}/switches") if fs.exists(path(f"{self.root}/switches")) else None

    def current(self) -> int | None:
        rows = self.switches()
        found = latest(rows, status="success").first() if rows is not None else None
        return found["target_index"] if found else None

    def write(self, docs: DataFrame, rows_per_file: int = 1_000_000) -> int:
        number = max([0, *self.numbers()]) + 1
        docs.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{self.root}/v={number}")
        return number

    def read(self, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v={number or self.current()}")

    def publish(self, number: int, unique: int, failed: int, as_of: str, sample: Column | None = None, kind: str = "publish") -> dict:
        """Validate, then point to the version: one appended row decides, so readers see the old or the new one."""
        report = validate(self.read(number), unique, failed, sample)
        row = {"switch_id": f"{kind}-{number}-{as_of}", "type": kind, "target_index": number, "previous_read_index": self.current(), "switched_at": as_of, "status": "success" if report["valid"] else "failed", "details_json": json.dumps(report)}
        self.spark.createDataFrame([row], "switch_id string, type string, target_index int, previous_read_index int, switched_at string, status string, details_json string").coalesce(1).write.mode("append").json(f"{self.root}/switches")
        if report["valid"]:
            self.read(number).createOrReplaceTempView(self.view)
        return report

    def rollback(self, as_of: str, target: int | None = None, dry_run: bool = False, sample: Column | None = None) -> int | None:
        """To the newest earlier version that passes validation, a sample query included; None if there is none. A
        version must hold something and find the sample: how many documents it should have is known of its own
        publication, which is asked for again."""
        rows = self.switches()
        if rows is None:
            return None
        wanted = [r["target"] for r in rollback_candidates(rows).orderBy(F.desc("last_used")).limit(HISTORY).collect()]
        there = set(self.numbers())
        for number in [n for n in wanted if n in there and target in (None, n)]:
            expected = self._expected(rows, number)
            if not validate(self.read(number), expected, 0, sample)["valid"]:
                continue
            if not dry_run:
                self.publish(number, expected, 0, as_of, sample, kind="rollback")
            return number
        return None

    @staticmethod
    def _expected(switches: DataFrame, number: int) -> int:
        """Documents that the version had when it was published last."""
        told = latest(switches.where(F.col("target_index") == number), status="success").first()
        return int(json.loads(told["details_json"])["count"]) if told else 0

    def verify(self, docs: DataFrame, check) -> object:
        """Write to a throw-away place beside the versions, run a check on it, remove it."""
        fs, path = self._fs()
        place = f"{self.root}/temporary"
        try:
            docs.write.mode("overwrite").parquet(place)
            return check(self.spark.read.parquet(place))
        finally:
            fs.delete(path(place), True)
