"""Duplicate pairs of crowded cells: names meet on their rarest grams, and no pair is lost."""

import random
import time

import pytest
from pyspark.sql import functions as F

from waymark.operators import dedupe

SCHEMA = "_id string, gid string, source string, source_id string, layer string, lat double, lon double, name string"


def _pairs(df, **options):
    rows = [(r.a, r.b) for r in dedupe.pairs(df, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_grams_find_what_comparing_all_finds(spark, seed):
    r = random.Random(seed)
    parts = ["abc", "abcd", "bcde", "cafe", "xy", "مقهى", "shop", "a", ""]
    rows = []
    for k in range(240):
        name = " ".join(r.choice(parts) for _ in range(r.randint(1, 3))) if k % 20 else r.choice([None, " ", "ab"])
        rows.append((f"d{k:03}", f"g{k}", "s", str(k), r.choice(["venue", "street", None]), 33.0 + r.randint(0, 5) * 0.0001, 44.0 + r.randint(0, 5) * 0.0001, name))
    df = spark.createDataFrame(rows, SCHEMA)
    every = _pairs(df, crowded=10**9)
    assert len(every) > 100
    assert _pairs(df, crowded=0) == every
    assert _pairs(df, crowded=15) == every  # some cells one way, some the other


def test_names_of_one_coordinate(spark):
    """20,000 different names at one place; 200 of them are held in one other each."""
    r = random.Random(5)
    names = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) + f" {k}" for k in range(19_800)]
    names += [f"{names[k]} cafe" for k in range(200)]
    rows = [(f"d{k:05}", f"g{k}", "s", str(k), "venue", 33.0, 44.0, n) for k, n in enumerate(names)]
    df = spark.createDataFrame(rows, SCHEMA)
    began = time.perf_counter()
    got = _pairs(df)
    assert {(f"d{k:05}", f"d{19_800 + k:05}") for k in range(200)} <= got
    # Random names are held in no other, so no pair is among them.
    assert all(int(b[1:]) >= 19_800 for _, b in got) and time.perf_counter() - began < 90


def test_asked_grams_are_the_rarest(spark):
    """All names share their first grams; rows that meet are the true pairs and each name with itself."""
    rows = [(f"d{k}", 33.0, 44.0, "venue", f"grand central hotel {1000 + k}") for k in range(400)]
    df = spark.createDataFrame(rows, "_id string, lat double, lon double, layer string, normal string")
    cell = [F.lit(0).alias("cy"), F.lit(0).alias("cx")]
    one = F.struct("_id", "layer", "lat", "lon", "normal")
    assert dedupe._contained(df.select(*cell, one.alias("l")), df.select(*cell, one.alias("r")), 30.0).count() == 0
