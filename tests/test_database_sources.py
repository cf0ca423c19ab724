"""Databases as sources: JDBC on an in-memory database of the JVM, and the data source on a file of sqlite."""

import sqlite3
from contextlib import closing

import pytest
from pyspark.sql import functions as F

from waymark.sources import changes, spec
from waymark.streaming import streams

SCHEMA = "id long, name string, lat double"


@pytest.fixture(scope="module")
def derby(spark):
    url = "jdbc:derby:memory:places;create=true"
    spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    run = connection.createStatement()
    run.execute("create table places (id int primary key, name varchar(40), lon double, lat double)")
    for k in range(100):
        run.execute(f"insert into places values ({k}, 'place {k}', {'null' if k % 10 == 0 else 44.0}, 33.0)")
    connection.close()
    return url


def _spec(**options):
    return spec.SourceSpec(name="p", layer="venue", id_field="id", sql="select id as \"id\", name as \"name\", lon as \"lon\", lat as \"lat\" from places", **options)


def test_jdbc_scan(spark, derby):
    out = spec.scan_jdbc(spark, _spec(), derby, partition=("id", 0, 100, 4))
    assert out.rdd.getNumPartitions() == 4
    assert sorted(r.id for r in out.collect()) == [k for k in range(100) if k % 10]
    assert {"_lon", "_lat"} <= set(out.columns)
    plan = out.where("id > 90")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,90)" in plan and "IsNotNull(lon)" in plan  # the database filters
    assert out.where("id > 90").count() == 9


def test_jdbc_limit(spark, derby):
    assert spec.scan_jdbc(spark, _spec(), derby, limit=5).count() == 5
    assert spec.scan_jdbc(spark, _spec(test_limit=3), derby).count() == 3
    assert spec.scan_jdbc(spark, _spec(), derby, geometry=None).count() == 100
    with pytest.raises(ValueError):
        spec.scan_jdbc(spark, _spec(), derby, limit=-1)


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "places.db")
    with closing(sqlite3.connect(path)) as c:
        c.execute("create table places (id integer, name text, lat real)")
        c.commit()
    return path


def _add(path, rows):
    with closing(sqlite3.connect(path)) as c:
        c.executemany("insert into places values (?, ?, ?)", rows)
        c.commit()


def _options(path, **more):
    return {"module": "sqlite3", "database": path, "sql": "select * from places", "key": "id", **more}


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(changes.Changes)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def _read(spark, path, **more):
    return spark.read.format("waymark_changes").schema(SCHEMA).options(**_options(path, **more)).load()


def test_parts_hold_as_many_rows_however_keys_are_spread(source, database):
    _add(database, [(k if k < 50 else k * 10**12, f"n{k % 7}", None if k % 3 else 33.0) for k in range(103)] + [(None, "no key", 1.0)])
    df = _read(source, database, rows="20")
    sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    assert sizes == [3, 20, 20, 20, 20, 20]
    assert {r.name for r in df.collect()} == {f"n{k}" for k in range(7)}
    assert df.where("id >= 10 and id < 20 and name = 'n4' and lat is null").count() == len([k for k in range(10, 20) if k % 7 == 4 and k % 3])
    assert sorted(r.id for r in _read(source, database, rows="20", limit="30").collect()) == list(range(30))
    assert _read(source, database, limit="0").count() == 0 and _read(source, database, limit="1000").count() == 103


def test_filters_reach_the_statements():
    from pyspark.sql import datasource as ds

    table = changes.Table(_options("x"), _schema())
    filters = [ds.GreaterThan(("id",), 7), ds.EqualTo(("name",), "a"), ds.LessThan(("name",), "b"), ds.IsNotNull(("lat",)), ds.EqualTo(("lat",), 1.5)]
    assert list(changes._Batch(table).pushFilters(filters)) == filters  # Spark tests all of them again
    assert table.where == ['"id" > \0', '"name" = \0', '"lat" IS NOT NULL'] and table.values == [7, "a"]


def _schema():
    from pyspark.sql.types import DoubleType, LongType, StringType, StructType

    return StructType().add("id", LongType()).add("name", StringType()).add("lat", DoubleType())


def test_empty_tables_and_missing_options(source, database):
    assert _read(source, database).count() == 0
    with pytest.raises(ValueError):
        changes.Table({"module": "sqlite3"}, _schema())


def test_a_restarted_stream_reads_past_its_offset(source, database, tmp_path):
    seen = []

    def apply(batch, number):
        seen.append(sorted(r.id for r in batch.select("id").collect()))

    def run():
        stream = source.readStream.format("waymark_changes").schema(SCHEMA).options(**_options(database, rows="4")).load()
        streams.sync(stream, apply, str(tmp_path / "checkpoint"))

    _add(database, [(k, "a", 1.0) for k in range(10)])
    run()
    assert seen == [list(range(10))]
    # Changed below the offset: not read again.
    with closing(sqlite3.connect(database)) as c:
        c.execute("update places set name = 'old'")
        c.commit()
    _add(database, [(k, "b", 1.0) for k in range(10, 17)])
    run()
    assert seen[1:] == [list(range(10, 17))]
    run()
    assert len(seen) == 2
