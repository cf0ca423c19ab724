"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, lexical, mixing, near_duplicates, nearest, packing, quality, secrets, spelling, substrings, token_counts, token_files, toxicity
from . import sql

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": token_counts.query,
        "op2_substrings": substrings.query,
        "op3_token_files": token_files.query,
        "op4_secrets": secrets.query,
        "op5_quality": quality.query,
        "op6_decontamination": decontamination.query,
        "op7_near_duplicates": near_duplicates.query,
        "op8_toxicity": toxicity.query,
        "op9_mixing": mixing.query,
        "op10_nearest": nearest.query,
        "op11_spelling": spelling.query,
        "op12_lexical": lexical.query,
        "op13_packing": packing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_decontamination": sql.DECONTAMINATION,
        "op9_mixing": sql.MIXING,
        "op11_spelling": sql.SPELLING,
        "op12_lexical": sql.LEXICAL,
    }
