"""Token counts of flat, unindexed token files: a separator scan with a prefix scan over its blocks.

A flat file is nothing but ids of fixed width, each document's ids followed by the end-of-document id. Files
are cut into blocks of fixed size wherever that falls; a task reads one block's byte range and finds all
separators in it with one vectorised comparison. What crosses blocks is stitched by two running aggregates
over the blocks of a file, in Spark: the number of separators in earlier blocks numbers the documents, and the
last separator of earlier blocks is where a block's first document began.

Files are reached through pyarrow's filesystems by URI, so tasks read ranges of files of any size; they lie in
the shared folder. A task writes its file under its attempt's number and names it in its result: of two
attempts only the one that Spark commits is ever read.

Defined cases: an empty or null text is a document of 0 ids; what follows a file's last separator, if anything,
is a document with `terminated` false; an empty file has no documents; repeated documents and ids keep a row
each; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import encoding, work

#: The end-of-document id. A text that holds the separator's own string has this id, too: it is written as ESCAPED,
#: an id that no text has.
SEPARATOR, ESCAPED = 50256, 65535
WIDTH = np.dtype("<u2")
#: Ids of a block.
BLOCK = 1 << 20
BLOCKS_PER_TASK = 16


def write(docs: DataFrame, vocabulary: str = encoding.VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """Encode `docs` into flat files, one for each task. Returns uri, file_no, doc_no, doc_id: which document was
    written where, as a check on the scan; the files themselves hold ids alone."""
    work.prepare(docs.sparkSession)
    path, root = encoding.vocabulary(vocabulary), work.place(docs.sparkSession, "flat")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, done = TaskContext.get(), 0
        uri = f"{root}/ids-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        system, place = work.filesystem(uri)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        with system.open_output_stream(place) as out:
            for batch in batches:
                for _, ids, count in encoding.encoded(batch.column("text"), path):
                    ids = np.where(ids == separator, ESCAPED, ids)
                    out.write(np.insert(ids, np.cumsum(count), separator).astype(WIDTH).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([uri] * n, pa.string()), pa.array(np.full(n, task.partitionId(), np.int32)), pa.array(np.arange(done, done + n)), batch.column("doc_id")], names=["uri", "file_no", "doc_no", "doc_id"])
                done += n

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return work.written(rows.mapInArrow(make, "uri string, file_no int, doc_no long, doc_id long"), "flat-names")


def scan(files: DataFrame, separator: int = SEPARATOR, width: np.dtype = WIDTH, block: int = BLOCK) -> DataFrame:
    """uri, doc_no, start, n_tokens, terminated for every document of the files in `files.uri`; start counts ids."""
    work.prepare(files.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, place = work.filesystem(uri)
                n = system.get_file_info(place).size // width.itemsize
                first = np.arange(0, n, block)
                for k in range(0, len(first), 8192):
                    own = first[k : k + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * len(own), pa.string()), pa.array(own), pa.array(np.minimum(block, n - own))], names=["uri", "first", "n"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first, n in zip(*(batch.column(c).to_pylist() for c in ("uri", "first", "n"))):
                system, place = work.filesystem(uri)
                with system.open_input_file(place) as f:
                    ids = np.frombuffer(f.read_at(n * width.itemsize, first * width.itemsize), width)
                at = np.flatnonzero(ids == separator) + first
                yield pa.RecordBatch.from_arrays([pa.array([uri], pa.string()), pa.array([first]), pa.array([n]), pa.array([at], pa.list_(pa.int64()))], names=["uri", "first", "n", "ends"])

    # Blocks are dealt by their place, so that a long file's blocks go to many tasks.
    spread = files.select("uri").distinct().mapInArrow(cut, "uri string, first long, n long").repartition("uri", "first")
    blocks = work.written(spread.mapInArrow(find, "uri string, first long, n long, ends array<long>"), "separators")
    # The running aggregates see a row of sums for each block, never the separators themselves.
    sums = blocks.select("uri", "first", F.size("ends").alias("n_ends"), F.array_max("ends").alias("last_end"))
    before = Window.partitionBy("uri").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "uri", "first", "n_ends",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("end_before"),
        F.lead("first").over(Window.partitionBy("uri").orderBy("first")).isNull().alias("is_last"),
    )
    # Tasks are dealt by number of blocks: a block is a few bytes here and thousands of documents below.
    tasks = max(1, -(-blocks.count() // BLOCKS_PER_TASK))
    blocks = blocks.repartition(tasks, "uri", "first").join(work.written(sums, "block-sums").repartition(tasks, "uri", "first").hint("merge"), ["uri", "first"])
    begins = F.concat(F.array("end_before"), F.col("ends"))
    tail = F.col("is_last") & (F.element_at(begins, -1) < F.col("first") + F.col("n") - 1)
    ends = F.when(tail, F.concat("ends", F.array(F.col("first") + F.col("n")))).otherwise(F.col("ends"))
    found = blocks.select("uri", "docs_before", "n_ends", begins.alias("begins"), F.posexplode(ends).alias("k", "end"))
    start = F.element_at("begins", F.col("k") + 1) + 1
    return found.select("uri", (F.col("docs_before") + F.col("k")).alias("doc_no"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), (F.col("k") < F.col("n_ends")).alias("terminated"))


def complete(names: DataFrame, found: DataFrame) -> None:
    """Raise if the scan found more or fewer documents in a file than were written."""
    counts = [df.groupBy("uri").agg(F.count(F.lit(1)).alias(n)) for df, n in ((names, "written"), (found, "found"))]
    wrong = counts[0].join(counts[1], "uri", "full").where("not (written <=> found)").first()
    if wrong is not None:
        raise ValueError(f"{wrong.uri}: {wrong.found} documents found, {wrong.written} written")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = write(work.documents(spark, sf_dir))
    found = work.written(scan(names), "flat-docs")
    complete(names, found)
    return names.join(found.hint("merge"), ["uri", "doc_no"]).select("doc_id", "file_no", "doc_no", "start", "n_tokens", "terminated")
