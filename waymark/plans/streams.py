"""Queries over streams: the same functions on the finished table, and streams that are run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sync
from ..sources.store import place, written
from ..streaming import streams
from . import base


def _requests(spark, d):
    return base.requests(spark, d).withColumn("seconds", F.col("latency_ms") / 100)


def t3(spark, d):
    return streams.request_counts(_requests(spark, d))


def t4(spark, d):
    return streams.duration_histogram(_requests(spark, d), width="1 day")


def _runs(spark, d):
    return base.requests(spark, d).select(F.col("endpoint").alias("source"), "ts", F.when(F.col("k") % 4 == 0, "failed").otherwise("success").alias("status"), F.concat(F.repeat(F.lit("x"), 170), "event_id").alias("message"), "event_id")


def t5(spark, d):
    return streams.gauges(_runs(spark, d)).select("source", "last_success", "last_error", F.length("last_message").alias("n"))


def _stream(spark, table):
    """A table, written to the shared folder in several files, as a stream of one file a batch."""
    path = written(table.repartition(4)).inputFiles()[0].rpartition("/")[0]
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(path)


def t1(spark, d):
    """Incremental sync: micro-batches of orders are upserted into a table in parts by id, of which each batch rewrites
    those that it touches; what is left is the last row of each id."""
    rows = base.read(spark, d, "lineitem").select(F.concat(F.lit("postgis:lines:"), "l_orderkey").alias("_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    table = sync.PartTable(spark, place(spark, "synced"), parts=sync.parts_for(rows.count()))
    streams.sync(_stream(spark, rows), lambda batch, _: table.upsert(batch, order), place(spark, "checkpoint"))
    return table.read().select("_id", "l_linenumber", "l_partkey")


def t2(spark, d):
    """Orders twice over as a stream, each id kept once."""
    rows = base.read(spark, d, "orders").select(F.col("o_orderkey").alias("_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    kept = []
    streams.sync(streams.seen_ids(_stream(spark, rows.unionByName(rows))), lambda batch, _: kept.append(written(batch)), place(spark, "checkpoint"))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out.select("_id")


def t6(spark, d):
    rows = _runs(spark, d).where("status = 'success'").select("source", F.unix_timestamp("ts").cast("double").alias("at"), F.lit(1706659200.0).alias("as_of"))
    kept, key = [], "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = streams.freshness(_stream(spark, rows), 86400.0, timers=False).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", place(spark, "checkpoint")).foreachBatch(lambda b, n: kept.append(written(b.withColumn("n", F.lit(n))))).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out.groupBy("source").agg(F.max_by("stale", "n").alias("stale"))


_E = "WITH e AS (SELECT event_id, ts, event_type AS endpoint, value, (props->>'$.k')::INT AS k FROM events) "
QUERIES = {
    "t1_incremental_sync": (t1, "SELECT 'postgis:lines:' || l_orderkey AS _id, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1"),
    "t2_stream_seen_ids": (t2, "SELECT o_orderkey AS _id FROM orders"),
    "t3_request_counts": (t3, _E + "SELECT date_trunc('hour', ts) AS start, endpoint, CASE k % 10 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END AS status, count(*) AS requests FROM e GROUP BY 1, 2, 3"),
    "t4_duration_histogram": (t4, _E + "SELECT date_trunc('day', ts)::TIMESTAMP AS start, endpoint, le, count(*) FILTER (value / 100 <= le) AS requests FROM e, unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]::DOUBLE[]) AS b(le) GROUP BY 1, 2, 3"),
    "t5_gauges": (t5, _E + "SELECT endpoint AS source, max(ts) FILTER (k % 4 <> 0) AS last_success, max(ts) FILTER (k % 4 = 0) AS last_error, 160::INT AS n FROM e GROUP BY 1"),
    "t6_freshness_stream": (t6, _E + "SELECT endpoint AS source, 1706659200 - max(epoch_us(ts) // 1000000) > 86400 AS stale FROM e WHERE k % 4 <> 0 GROUP BY 1"),
}
