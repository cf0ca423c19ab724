"""Documents to token files: the training-data pipeline, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.

Defined cases are those of the operators: a null or empty text passes toxicity by its score, is no near copy, leaks
nothing and is mixed with 0 words; rows of one doc_id are one document after near-duplicates, null doc_ids stay; empty
tables give empty results; without labels no document is rejected unless most are toxic; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import decontamination, mixing, near_duplicates, token_files, toxicity, work


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    return toxicity.clean(docs, toxicity.fitted(docs, work.table(spark, sf_dir, "labels")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies."""
    return near_duplicates.distinct(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    return decontamination.clean(docs, work.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target weight takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; where each document's ids stand in them."""
    return token_files.run(docs)


STAGES = [("toxicity", toxic), ("near_duplicates", near), ("decontamination", leaks), ("mixing", mix), ("token_files", tokens)]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = work.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = work.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
