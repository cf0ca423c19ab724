"""A source that falls silent is reported as stale by a timer, with its true age."""

import time

from waymark.streaming import streams


def test_silent_source_becomes_stale(spark, tmp_path):
    rows = spark.createDataFrame([("a", 100.0, 101.0), ("b", 50.0, 101.0)], "source string, at double, as_of double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    key, seen = "spark.sql.streaming.stateStore.providerClass", []
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        runs = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        query = streams.freshness(runs, 20.0).writeStream.outputMode("update").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda batch, n: seen.extend(batch.collect())).start()
        try:
            until = time.time() + 150
            while time.time() < until and query.isActive and not any(r.source == "a" and r.stale for r in seen):
                time.sleep(0.5)
        finally:
            query.stop()
    finally:
        spark.conf.set(key, before)
    first = [r for r in seen if r.source == "a" and not r.stale]
    assert first and first[0].age_seconds == 1.0
    late = [r for r in seen if r.source == "a" and r.stale]
    assert late and all(20.0 < r.age_seconds < 170.0 for r in late)
    assert [r for r in seen if r.source == "b"][0].stale  # stale when it came
