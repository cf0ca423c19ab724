"""Percentiles by selection against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import quality


def nearest(values, q):
    values = sorted(values)
    return values[min(len(values) - 1, max(0, math.ceil(q * len(values)) - 1))]


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_selection(spark, monkeypatch, bins):
    monkeypatch.setattr(quality, "BINS", bins)
    rng = random.Random(bins)
    groups = {"even": [rng.random() for _ in range(400)], "equal": [5.0] * 90, "one": [-3.0], "ties": [float(rng.randint(0, 3)) for _ in range(200)], "wide": [10.0 ** rng.uniform(-3, 6) for _ in range(200)], None: [-1.0, 0.0, 2.0], "huge": [-1.7e308, 1.7e308, 0.0, 1.0]}
    rows = [(g, 1, v) for g, vs in groups.items() for v in vs] + [("even", 1, None), ("even", 1, float("nan")), ("none", 1, None), (None, 2, 7.0), ("even", None, 4.0)]
    table = spark.createDataFrame(rows, "kind string, n int, v double").repartition(3)
    wanted = {"least": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "most": 1.0}
    got = {(r.kind, r.n): tuple(r[c] for c in wanted) for r in quality.percentiles(table, ["kind", "n"], "v", wanted).collect()}
    want = {(g, 1): tuple(nearest(vs, q) for q in wanted.values()) for g, vs in groups.items()} | {(None, 2): (7.0,) * 5, ("even", None): (4.0,) * 5}
    assert {k: v for k, v in got.items() if v[0] is not None} == want


def test_empty_groups_are_zero(spark):
    table = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "endpoint string, latency_ms double")
    got = {r.endpoint: tuple(r)[1:] for r in quality.latency(table, ["endpoint"]).collect()}
    assert got == {"a": (2, 1.0, 3.0, 3.0, 3.0), "b": (0, 0.0, 0.0, 0.0, 0.0)}
    assert quality.latency(table.limit(0), ["endpoint"]).count() == 0
