"""What a review of larger tables found."""

import duckdb
from pyspark.sql import functions as F

from waymark.operators import geocode, rank, search, spatial
from waymark.plans import registry
from waymark.plans import search as search_plans

DATA = "/root/testdata/sf0.001"


def test_batch_summary_needs_no_search(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("a summary of statuses searches nothing")

    monkeypatch.setattr(geocode, "find", never)
    row = search_plans.a17(spark, DATA).first()
    assert row["total"] == row["ok"] + row["error"] and row["total"] > 0 and row["error"] > 0


def test_rollback_candidates_at_whole_seconds(spark, tmp_path):
    """A time without a fraction ends in zeros that are not trailing ones of a fraction."""
    rows = spark.range(8).select((F.col("id") * 50).alias("event_id"), F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 10000000 + (F.col("id") % 3) * 500000).alias("ts"), F.lit(1).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in registry.queries()["k8_rollback_candidates"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    con.execute(f"create view events as select * replace (ts::TIMESTAMP as ts) from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["k8_rollback_candidates"]).fetch_df()
    assert got == set(zip(want["target"], want["last_used"])) and len(got) == 7


def test_nearest_line_in_stages(spark, monkeypatch):
    """Smaller radii first, on dense roads, give what one join gives, near and far, in metres and in degrees."""
    points = spark.range(600).select(F.col("id").cast("string").alias("_id"), (44 + F.col("id") * 7919 % 10007 / 100070.0).alias("lon"), (33 + F.col("id") * 104729 % 10009 / 100090.0).alias("lat"))
    segs = spark.range(40).select(F.col("id").alias("road_id"), F.lit(0).alias("seg"), (44 + F.col("id") * 7 % 40 / 400.0).alias("x1"), (33 + F.col("id") * 13 % 40 / 400.0).alias("y1"))
    segs = segs.withColumns({"x2": F.col("x1") + 0.001, "y2": F.col("y1") - 0.0005})
    segs = segs.unionByName(segs.where("road_id < 5").withColumn("road_id", F.col("road_id") + 100))
    for mode in ("meters", "source_units"):
        joins, one = [], spatial._nearest_line
        monkeypatch.setattr(spatial, "_nearest_line", lambda *a: joins.append(a[2]) or one(*a))
        whole = {tuple(r) for r in spatial.nearest_line(points, segs, 800.0, radius_mode=mode).collect()}
        monkeypatch.setattr(spatial, "PAIRS", 100)
        parts = {tuple(r) for r in spatial.nearest_line(points, segs, 800.0, radius_mode=mode).collect()}
        monkeypatch.undo()
        assert joins[0] == 800.0 and len(joins) > 2 and joins[1] < joins[2]
        assert whole == parts and 0 < len(whole) < 600


def test_classes_and_back(spark):
    """Hits of one query and one document for all that are equal, nulls too, come back for each of them."""
    docs = spark.createDataFrame([(f"d{k:03}", "x" if k % 3 else None, "y" if k % 2 else "z") for k in range(60)], "_id string, a string, b string")
    queries = spark.createDataFrame([(k, ["y"] if k % 2 else ["z"]) for k in range(10)], "query_id long, tokens array<string>")
    q, back = search.shared_evaluation(queries, ["tokens"])
    found = search.classes(docs, ["a", "b"])
    assert {(r._id, r.members) for r in found.collect()} == {("d000", 10), ("d001", 20), ("d002", 20), ("d003", 10)}
    hits = q.crossJoin(found).where(F.array_contains("tokens", F.col("b"))).select("query_id", "_id", F.length("_id").alias("score"))
    assert hits.count() == 4
    got = [tuple(r) for r in search.expanded(hits, back, docs, found, ["a", "b"]).select("query_id", "_id").collect()]
    assert len(got) == 300 and set(got) == {(k, f"d{n:03}") for k in range(10) for n in range(60) if k % 2 == n % 2}


def test_nearest_join_in_stages(spark, monkeypatch):
    """The k nearest, from smaller radii first, are those of the whole join; lonely queries and short radii too."""
    places = spark.range(3000).select(F.col("id").cast("string").alias("_id"), F.lit("venue").alias("layer"), (44 + F.pow(F.col("id") * 7919 % 10007 / 10007.0, 3) / 10).alias("lon"), (33 + F.col("id") * 104729 % 10009 / 100090.0).alias("lat"))
    places = places.unionByName(places.where("cast(_id as int) < 200").withColumn("_id", F.concat(F.lit("copy"), "_id")))
    queries = spark.range(80).select(F.col("id").alias("query_id"), (44 + F.col("id") * 37 % 80 / 800.0).alias("q_lon"), (33 + F.col("id") * 11 % 80 / 800.0).alias("q_lat"), F.when(F.col("id") % 9 == 0, 50.0).otherwise(3000.0).alias("radius"))
    best = lambda hits: {tuple(r) for r in rank.nearby(hits, "distance", size=4).select("query_id", "rank", "_id", "distance").collect()}
    bounds, one = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda q, p, most: bounds.append(most) or one(q, p, most))
    monkeypatch.setattr(spatial, "HITS", 2)
    got = best(spatial.nearest_join(queries, places, 4, 3000.0))
    monkeypatch.undo()
    assert len(bounds) > 2 and bounds == sorted(bounds) and bounds[-1] == 3000.0
    assert got == best(spatial.radius_join(queries, places, 3000.0)) and len(got) > 200


def test_nearby_by_relevance_in_stages(spark, monkeypatch):
    """The best by relevance and by relevance and distance, from smaller radii first, are those of the whole join."""
    places = spark.range(3000).select(F.col("id").cast("string").alias("_id"), F.when(F.col("id") % 4 == 0, "street").otherwise("venue").alias("layer"), (44 + F.pow(F.col("id") * 7919 % 10007 / 10007.0, 3) / 10).alias("lon"), (33 + F.col("id") * 104729 % 10009 / 100090.0).alias("lat"), (F.col("id") % 5 / 10.0).alias("worth"))
    queries = spark.range(60).select(F.col("id").alias("query_id"), (44 + F.col("id") * 37 % 80 / 800.0).alias("q_lon"), (33 + F.col("id") * 11 % 80 / 800.0).alias("q_lat"), F.when(F.col("id") % 9 == 0, 50.0).otherwise(3000.0).alias("radius"))
    best = lambda hits: {tuple(r) for r in hits.select("query_id", "rank", "_id", "distance").collect()}
    for sort in ("relevance", "hybrid"):
        want = best(rank.nearby(spatial.radius_join(queries, places, 3000.0), sort, size=4, relevance=F.col("worth")))
        bounds, one = [], spatial.radius_join
        monkeypatch.setattr(spatial, "radius_join", lambda q, p, most: bounds.append((most, q.count())) or one(q, p, most))
        monkeypatch.setattr(spatial, "HITS", 20)
        got = best(rank.nearby_join(queries, places, sort, size=4, relevance=F.col("worth"), most=3000.0))
        monkeypatch.undo()
        assert len(bounds) > 2 and bounds[-1][1] < bounds[0][1] and got == want and len(got) > 150


def test_feature_debug_scores_no_hit_beyond_its_bounds(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("the best three need not all hits")

    monkeypatch.setattr(geocode, "scored", never)
    assert search_plans.p21(spark, DATA).where("rank > 3").isEmpty()
