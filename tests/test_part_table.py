"""Upserts by parts: a reader sees the state before or after, whatever crashes and whoever else writes."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import sync


@pytest.fixture
def table(spark, tmp_path):
    return sync.PartTable(spark, f"file://{tmp_path}/t", parts=4)


def _new(spark, rows):
    return spark.createDataFrame(rows, "_id string, at long, v string")


def _rows(table):
    return {r._id: (r.at, r.v) for r in table.read().collect()}


def test_upserts_equal_a_dictionary_and_old_states_go(spark, table):
    r, want = random.Random(2), {}
    assert table.read() is None
    for n in range(5):
        rows = [(f"i{r.randint(0, 30)}", r.randint(0, 9) * 10 + n, f"v{n}") for _ in range(12)]
        for i, at, v in rows:
            want[i] = max(want.get(i, (-1, "")), (at, v))
        table.upsert(_new(spark, rows), F.struct("at", "v"))
        assert _rows(table) == want
    assert table.numbers() == [3, 4, 5]
    table.upsert(_new(spark, []), F.col("at"))
    assert table.numbers() == [3, 4, 5]


def test_untouched_parts_are_not_written_again(spark, table):
    table.upsert(_new(spark, [(f"i{k}", 0, "a") for k in range(40)]), F.col("at"))
    before = table.state()[1]["folders"]
    table.upsert(_new(spark, [("i1", 1, "b")]), F.col("at"))
    after = table.state()[1]["folders"]
    assert len(before) == 4 and sum(before[p] != after[p] for p in before) == 1


def test_a_reader_under_way_keeps_its_state(spark, table):
    table.upsert(_new(spark, [("a", 0, "old")]), F.col("at"))
    reader = table.read()
    table.upsert(_new(spark, [("a", 1, "new")]), F.col("at"))
    assert [r.v for r in reader.collect()] == ["old"] and _rows(table) == {"a": (1, "new")}


def test_a_crash_before_the_manifest_changes_nothing(spark, table, monkeypatch):
    table.upsert(_new(spark, [("a", 0, "old")]), F.col("at"))

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_commit", crash)
        with pytest.raises(RuntimeError):
            table.upsert(_new(spark, [("a", 1, "new"), ("b", 1, "new")]), F.col("at"))
    assert _rows(table) == {"a": (0, "old")}
    table.upsert(_new(spark, [("b", 2, "later")]), F.col("at"))
    assert _rows(table) == {"a": (0, "old"), "b": (2, "later")}


def test_of_two_upserts_at_once_neither_is_lost(spark, table, monkeypatch):
    table.upsert(_new(spark, [("a", 0, "x")]), F.col("at"))
    other, commit, done = sync.PartTable(spark, table.root, parts=4), table._commit, []

    def late(number, state):
        if not done:
            done.append(1)
            other.upsert(_new(spark, [("a", 5, "other"), ("c", 5, "other")]), F.col("at"))
        return commit(number, state)

    monkeypatch.setattr(table, "_commit", late)
    table.upsert(_new(spark, [("a", 3, "mine"), ("b", 3, "mine")]), F.col("at"))
    assert _rows(table) == {"a": (5, "other"), "b": (3, "mine"), "c": (5, "other")}
