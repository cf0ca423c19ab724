"""Queries over synchronisation, guards, statistics, duplicates and request quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dedupe, places, quality, sync
from . import base
from . import search as search_plans
from ..sources.store import place, written
from .places import _docs as source_docs
from .search import _S, docs

R6 = lambda x: F.round(x, 6)


def _orders(spark, d):
    return base.read(spark, d, "orders").select(F.concat(F.lit("postgis:orders:"), "o_orderkey").alias("_id"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("at"))


def _ids(spark, d):
    return base.read(spark, d, "lineitem").select(F.concat(F.lit("postgis:lines:"), "l_orderkey").alias("_id"), F.lit("lines").alias("source_config"), "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")


def k1(spark, d):
    o = _orders(spark, d)
    new = o.where("k % 7 = 0").withColumn("price", F.col("price") * 2).withColumn("seq", F.lit(1)).unionByName(o.where("k % 21 = 0").withColumn("price", F.lit(0.0)).withColumn("seq", F.lit(2)))
    return sync.upsert(o.where("k % 2 = 0").select("_id", "price"), new, F.col("seq")).select("_id", R6("price").alias("price"))


def k2(spark, d):
    o = _orders(spark, d)
    ids = o.where("k % 9 = 0").select(F.when(F.col("k") % 2 == 0, F.col("_id")).otherwise(F.concat(F.lit("postgis:other:"), "k")).alias("_id"))
    kept, report = sync.delete(o.select("_id"), ids, "orders")
    return report.groupBy("status", "error").agg(F.count(F.lit(1)).alias("n")).unionByName(kept.agg(F.lit("kept").alias("status"), F.lit(None).cast("string").alias("error"), F.count(F.lit(1)).alias("n")))


def j5(spark, d):
    o = _orders(spark, d)
    return sync.delete_diff(o.where("at < timestamp'2000-01-01'"), o.where("k % 3 <> 0"))


def u3(spark, d):
    o = _orders(spark, d)
    return sync.delete_diff(o.where("k % 3 <> 0"), o.where("at < timestamp'2000-01-01'"))


def w4(spark, d):
    last = sync.keep_last(_ids(spark, d), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return last.select("_id", "l_linenumber", "l_partkey")


def g8(spark, d):
    return sync.duplicate_ids(_ids(spark, d))


def a8(spark, d):
    return _ids(spark, d).groupBy("source_config").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("_id").alias("ids"))


def a18(spark, d):
    return _orders(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("ids"))


def _counts(spark, d):
    o = _orders(spark, d)
    c = o.groupBy("source").agg(F.count(F.lit(1)).alias("previous"), F.count_if(F.col("k") % 5 < F.when(F.col("source").startswith("1"), 2).otherwise(4)).alias("current"))
    return c.withColumn("max_drop_ratio", F.when(F.col("source").startswith("2"), 0.1)).withColumn("allow_count_drop", F.col("source").startswith("3"))


def g1(spark, d):
    return sync.count_drop(_counts(spark, d)).select("source", "previous", "current", R6("drop_ratio").alias("drop_ratio"), "violation")


def g2(spark, d):
    o = _orders(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("read"), F.count_if(F.col("source").startswith("1") & (F.col("k") % 50 == 0)).alias("failed"))
    return sync.failure_ratio(o).select("source", "read", "failed", R6("failed_ratio").alias("failed_ratio"), "violation")


def a7(spark, d):
    runs = _counts(spark, d).select(F.col("previous").alias("read"), F.col("current").alias("indexed"), F.col("current").alias("unique_ids"), (F.col("previous") - F.col("current")).alias("failed"), F.lit(0).alias("deleted"))
    return sync.totals(runs)


def k4(spark, d):
    """The ids of all sources are written, then those of two sources again: only these are replaced."""
    path = place(spark, "seen")
    ids = _orders(spark, d).select(F.col("source").alias("source_name"), F.col("_id").alias("document_id"), "k")
    sync.write_seen(ids.drop("k"), path)
    sync.write_seen(ids.where("source_name < '3' and k % 3 = 0").drop("k"), path)
    return sync.read_seen(spark, path).groupBy("source_name").agg(F.count(F.lit(1)).alias("ids"), F.min("document_id").alias("first"))


def _runs(spark, d):
    return base.requests(spark, d).select(F.col("event_id").cast("string").alias("run_id"), F.col("ts").alias("started_at"), F.col("endpoint").alias("source"), F.when(F.col("k") % 4 == 0, "failed").otherwise("success").alias("status"))


def k5(spark, d):
    """Runs are appended when they start and when they end; one in nine has not ended."""
    path = place(spark, "runs")
    runs = _runs(spark, d)
    sync.append_runs(runs.withColumn("status", F.lit("running")), path)
    ended = runs.where("cast(run_id as long) % 9 <> 0")
    sync.append_runs(ended.withColumns({"finished_at": F.col("started_at"), "error": F.when(F.col("status") == "failed", "lost")}), path)
    return sync.read_runs(spark, path).select("run_id", "source", "status", "error")


def _switches(spark, d):
    k = F.col("event_id")
    return base.requests(spark, d).select(F.format_string("s%08d", k).alias("switch_id"), F.col("endpoint").alias("type"), F.floor(k / 50).cast("int").alias("target_index"), F.when(k >= 50, F.floor(k / 50).cast("int") - 1).alias("previous_read_index"), F.col("ts").cast("string").alias("switched_at"), F.when(F.col("k") % 3 == 0, "failed").otherwise("success").alias("status"))


def k6(spark, d):
    return sync.latest(_switches(spark, d), status="success", type="view").select("switch_id", "target_index")


def k8(spark, d):
    return sync.rollback_candidates(_switches(spark, d)).select("target", "last_used")


def w8(spark, d):
    return sync.newest(_switches(spark, d), "switched_at", "switch_id", 200).select("switch_id")


def a1(spark, d):
    return quality.terms_count(docs(spark, d), "category", 5)


def a2(spark, d):
    return quality.breakdown(base.places(spark, d).where("country_a is null"), ["layer", "source_config", "segment"])


def a3(spark, d):
    p = base.places(spark, d).withColumn("admin_enrichment_reason", F.when(F.col("country_a").isNull() & (F.col("key") % 2 == 0), "no_covering_admin_boundary"))
    p = p.withColumn("indexed_at", F.timestamp_seconds(F.col("key")))
    return quality.index_stats(p, ("venue", "street", "address", "locality", "country"), ["segment", "country_a", "source", "source_config"])


def a4(spark, d):
    ids = docs(spark, d).select(F.col("category").alias("category_id")).distinct().unionByName(base.read(spark, d, "region").select(F.col("r_name").alias("category_id")))
    return quality.category_counts(docs(spark, d).withColumn("category_ids", F.array("category", "kind")), ids)


def a5(spark, d):
    return quality.status_counts(base.places(spark, d), "country_a")


def w7(spark, d):
    return quality.sample(base.places(spark, d), "segment", 3).select("segment", "_id")


def g4(spark, d):
    p = base.places(spark, d).withColumn("status", F.when(F.col("country_a").isNull(), "missing_country").otherwise("enriched"))
    counts = quality.status_counts(p, "status")
    return quality.sample(p, "status", 3).join(F.broadcast(counts), "status").select("status", "count", "_id")


def a10(spark, d):
    return quality.latency(base.requests(spark, d), ["endpoint"])


def _phased(spark, d):
    r = quality.cold_start(base.requests(spark, d), "event_id")
    return r.withColumn("counted", F.col("k") % 4 != 0)


def a11(spark, d):
    return quality.phases(_phased(spark, d))


def w10(spark, d):
    return quality.cold_start(base.requests(spark, d), "event_id").where("cold_start").select("endpoint", "event_id")


def w6(spark, d):
    return quality.slowest(base.requests(spark, d)).select("event_id", "latency_ms")


def _samples(spark, d):
    r = base.requests(spark, d)
    return r.select("endpoint", F.concat(F.lit("R"), F.col("user_id") % 5).alias("country"), F.concat(F.lit("q"), F.col("k") % 7).alias("query"), (F.col("status") == 200).alias("ok"), F.when(F.col("k") % 6 != 0, F.concat(F.lit("R"), F.col("k") % 5)).alias("top_country"), F.concat(F.lit("label"), "event_id").alias("top_label"), F.col("event_id").alias("seq"), "latency_ms", (F.col("event_id") % 4).alias("result_count"))


def a12(spark, d):
    out = quality.per_query(_samples(spark, d), ["endpoint", "country", "query"])
    return out.select("endpoint", "country", "query", "requests", "failures", "top_label", "mismatches", F.size("first_mismatches").alias("shown"), F.try_element_at("first_mismatches", F.lit(1))["seq"].alias("first_seq"))


def f19(spark, d):
    return _samples(spark, d).where(~F.col("top_country").eqNullSafe(F.col("country"))).groupBy("country").agg(F.count(F.lit(1)).alias("n"))


def f20(spark, d):
    s = _samples(spark, d)
    return s.where(~F.col("ok") | (F.col("result_count") < 1)).groupBy("endpoint").agg(F.count(F.lit(1)).alias("rejected"))


def a13(spark, d):
    return quality.missing_ratio(base.places(spark, d), "country_a").select("total", "missing", R6("ratio").alias("ratio"))


def _state(spark, d):
    return base.requests(spark, d).groupBy(F.concat_ws("-", "endpoint", F.col("user_id") % 10).alias("source")).agg(F.max(F.when(F.col("k") % 50 == 0, F.col("ts"))).alias("last_success"), F.count(F.lit(1)).alias("last_indexed_count"))


def a14(spark, d):
    return _state(spark, d).agg(F.max("last_success").alias("latest_success"))


def f16(spark, d):
    limits = _state(spark, d).where("source like '%1' or source like '%2'").select("source", F.lit(400000).alias("stale_after_seconds"))
    return quality.stale(_state(spark, d), limits, F.lit("2024-01-31 00:00:00")).select("source", "age_seconds", "threshold", "stale")


def g6(spark, d):
    out = f16(spark, d)
    drop = sync.count_drop(_counts(spark, d))
    return out.agg(F.count(F.lit(1)).alias("sources"), F.count_if("stale").alias("stale_sources"), (F.count_if("stale") == 0).alias("fresh")).crossJoin(F.broadcast(drop.agg((F.count("violation") > 0).alias("count_drop"))))  # one row each


def j12(spark, d):
    counts = base.requests(spark, d).where("status = 200").groupBy(F.concat_ws("-", "endpoint", F.col("user_id") % 10).alias("source")).agg(F.count(F.lit(1)).alias("documents"))
    return _state(spark, d).join(counts, "source", "left").select("source", "last_indexed_count", F.coalesce("documents", F.lit(0)).alias("documents"))


def s12(spark, d):
    """State tables are written and read for all configured sources, one of which has none."""
    path = place(spark, "state")
    sync.write_state(_state(spark, d), path)
    sources = base.requests(spark, d).select(F.explode(F.array(F.concat_ws("-", "endpoint", F.col("user_id") % 10), F.lit("nowhere"))).alias("source")).distinct()
    return sync.read_state(spark, path, sources).select("source", "last_success", "last_indexed_count")


def s11(spark, d):
    docs(spark, d).createOrReplaceTempView("waymark_read_alias")
    return spark.table("waymark_read_alias").groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


def s13(spark, d):
    r = base.requests(spark, d)
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return r.select("event_id", "user_id", nth.alias("index"))


def g3(spark, d):
    good, bad = places.split(source_docs(spark, d))
    report = sync.validate(good, good.select("_id").distinct().count() + bad.count(), bad.count(), F.col("layer") == "venue")
    return good.agg(F.count(F.lit(1)).alias("count"), F.lit(report["valid"]).alias("valid"))


def g7(spark, d):
    n = base.read(spark, d, "nation").join(base.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = n.groupBy(F.col("r_name").alias("country")).agg(F.array_sort(F.collect_list("n_name")).alias("cities")).withColumn("queries", F.array(F.lit("restaurant"), F.lit("hotel"), F.col("country")))
    return quality.tasks(c)


def g7_failures(spark, d):
    s = _samples(spark, d)
    per = quality.per_query(s, ["endpoint", "country", "query"])
    missing = quality.missing_ratio(base.places(spark, d), "country_a")
    return quality.failures(per, quality.latency(s, ["endpoint"]), {"view": 60.0, "click": 1e9, "purchase": 0.0}, missing).select("code", "endpoint", R6("detail").alias("detail"))


def g7_run(spark, d):
    """The matrix itself: the searches of all tasks are run, their hits counted and held against their countries."""
    c = docs(spark, d).groupBy(F.col("country_a").alias("country")).agg(F.array_sort(F.collect_set("locality")).alias("cities")).withColumn("queries", F.array(F.lit("bolt"), F.lit("red gear"), F.lit("nothing here")))
    tasks = quality.tasks(c).withColumn("query_id", F.concat_ws("|", "country", "city", "query", "endpoint"))
    out = quality.run_tasks(tasks, search_plans.index(spark, d), search_plans.dims(spark, d))
    return out.select("endpoint", "country", "city", "query", "result_count", "top_country")


def j6(spark, d):
    hits = base.requests(spark, d).select("event_id", F.col("user_id").alias("key"))
    return hits.join(base.places(spark, d).select("key", "name", "locality").hint("merge"), "key", "left").select("event_id", F.coalesce("name", F.lit("unknown")).alias("name"), "locality")


def f15(spark, d):
    p = F.create_map(F.lit("text"), F.col("endpoint"), F.lit("bad"), F.lit("x"), F.lit("lang"), F.when(F.col("k") % 2 == 0, "en").otherwise(""))
    m = quality.clean_parameters(p, ["text", "lang"])
    return base.requests(spark, d).select("event_id", F.size(m).alias("n"), F.try_element_at(m, F.lit("lang")).alias("lang"))


def _params(spark, d):
    k = F.col("event_id")
    s = lambda c: c.cast("string")
    return base.requests(spark, d).select(
        "event_id", F.when(k % 13 != 0, F.col("endpoint")).otherwise(" ").alias("text"), s(F.when(k % 7 == 0, 41).when(k % 7 == 1, 5)).alias("size"), s(F.when(k % 5 == 0, 33.3).when(k % 5 == 1, 95.0)).alias("focus.lat"), s(F.when(k % 5 < 2, 44.0)).alias("focus.lon"),
        s(F.when(k % 11 == 0, 44.0)).alias("rect.min_lon"), s(F.when(k % 22 == 0, 43.0)).alias("rect.max_lon"), s(F.when(k % 22 == 0, 33.0)).alias("rect.min_lat"), s(F.when(k % 22 == 0, 34.0)).alias("rect.max_lat"), F.when(k % 17 == 0, "upward").alias("sort"), s(F.when(k % 3 != 0, 33.0)).alias("point.lat"), F.lit("44").alias("point.lon"), F.when(k % 19 == 0, "maybe").alias("include_distance"),
    )


def f17(spark, d):
    return quality.validated(_params(spark, d)).select("event_id", "error", "parameter")


def f17_nearby(spark, d):
    return quality.validated(_params(spark, d), "nearby").groupBy("parameter").agg(F.count(F.lit(1)).alias("n"))


def _dup_docs(spark, d):
    t = docs(spark, d)
    copy = t.where("k % 10 = 0").withColumn("_id", F.concat("_id", F.lit("b"))).withColumn("lat", F.col("lat") + 0.0001).withColumn("layer", F.when(F.col("k") % 20 == 0, "x").otherwise(F.col("layer"))).withColumn("source_id", F.concat("source_id", F.lit("b")))
    same = t.where("k % 15 = 0").withColumn("_id", F.concat("_id", F.lit("c"))).withColumn("lat", F.col("lat") + 0.5)
    out = t.unionByName(copy).unionByName(same)
    return out.withColumn("gid", F.concat_ws(":", "source", "layer", "source_id"))


_DUP = """dd AS (SELECT _id, k, name, layer, lat, lon, k::VARCHAR AS source_id FROM s UNION ALL SELECT _id || 'b', k, name, CASE WHEN k % 20 = 0 THEN 'x' ELSE layer END, lat + 0.0001, lon, k || 'b' FROM s WHERE k % 10 = 0 UNION ALL SELECT _id || 'c', k, name, layer, lat + 0.5, lon, k::VARCHAR FROM s WHERE k % 15 = 0)"""


def d2(spark, d):
    return dedupe.pairs(_dup_docs(spark, d))


def d1(spark, d):
    """Result lists of some thirty documents, as many as there are documents for."""
    ranked = _dup_docs(spark, d).withColumn("query_id", F.floor(F.col("k") / 30)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_id")))
    return dedupe.results(ranked)


def d3(spark, d):
    t = _dup_docs(spark, d).withColumns({"confidence": F.lit(1.0), "has_routable": F.lit(False), "n_categories": F.lit(1), "distance": F.lit(0.0)})
    return dedupe.table(t, dedupe.pairs(t), written, dedupe.better(["name", "kind"])).select("_id", "label")


def d4(spark, d):
    t = docs(spark, d).withColumns({"confidence": F.when(F.col("k") % 3 == 0, 0.5).otherwise(0.9), "has_routable": F.col("k") % 2 == 0, "n_categories": F.lit(1), "distance": F.col("lat")})
    nth = F.row_number().over(Window.partitionBy("name").orderBy(*dedupe.better(["name", "kind"])))
    return t.withColumn("nth", nth).where("nth = 1").select("name", "_id")


_E = "e AS (SELECT event_id, ts, event_type AS endpoint, user_id, value AS latency_ms, (props->>'$.k')::INT AS k, CASE WHEN (props->>'$.k')::INT % 10 = 0 THEN 500 WHEN (props->>'$.k')::INT % 10 = 1 THEN 404 ELSE 200 END AS status FROM events)"
_O = "o AS (SELECT 'postgis:orders:' || o_orderkey AS _id, o_orderkey AS k, o_orderpriority AS source, o_totalprice AS price, o_orderdate AS day FROM orders)"
_CNT = "cnt AS (SELECT source, count(*) AS previous, count(*) FILTER (k % 5 < CASE WHEN source LIKE '1%' THEN 2 ELSE 4 END) AS current FROM o GROUP BY 1)"
_DROP = "(previous - current) / previous::DOUBLE"
_VIOL = f"CASE WHEN source NOT LIKE '3%' AND previous >= 100 AND {_DROP} > CASE WHEN source LIKE '2%' THEN 0.1 ELSE 0.5 END THEN 'unexpected_source_drop' END"
_SM = "sm AS (SELECT endpoint, 'R' || (user_id % 5) AS country, 'q' || (k % 7) AS query, status = 200 AS ok, CASE WHEN k % 6 <> 0 THEN 'R' || (k % 5) END AS top_country, 'label' || event_id AS top_label, event_id AS seq, latency_ms FROM e)"
_PQ = "pq AS (SELECT endpoint, country, query, count(*) AS requests, count(*) FILTER (NOT ok) AS failures, min_by(top_label, seq) FILTER (ok) AS top_label, count(*) FILTER (ok AND seq % 4 = 0) AS empty, count(*) FILTER (ok AND top_country IS DISTINCT FROM country) AS mismatches, min(seq) FILTER (ok AND top_country IS DISTINCT FROM country) AS first_seq FROM sm GROUP BY 1, 2, 3)"
_LAT = "count({v}) AS count, coalesce(quantile_disc({v}, 0.5), 0) AS p50, coalesce(quantile_disc({v}, 0.95), 0) AS p95, coalesce(quantile_disc({v}, 0.99), 0) AS p99, coalesce(max({v}), 0) AS max"
_ST = "st AS (SELECT endpoint || '-' || (user_id % 10) AS source, max(ts) FILTER (k % 50 = 0) AS last_success, count(*) AS last_indexed_count FROM e GROUP BY 1)"
_STALE = "sl AS (SELECT source, floor(epoch_us(TIMESTAMP '2024-01-31') / 1000000.0 - epoch_us(last_success) / 1000000.0)::BIGINT AS age_seconds, CASE WHEN source LIKE '%1' OR source LIKE '%2' THEN 400000 ELSE 86400 END AS threshold FROM st), sf AS (SELECT *, age_seconds IS NULL OR age_seconds > threshold AS stale FROM sl)"
_SW = "sw AS (SELECT printf('s%08d', event_id) AS switch_id, endpoint AS type, (event_id // 50)::INT AS target_index, CASE WHEN event_id >= 50 THEN (event_id // 50 - 1)::INT END AS previous_read_index, ts, CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'success' END AS status FROM e)"
_VAL = """CASE WHEN k % 22 = 11 THEN 'boundary.rect' WHEN k % 22 = 0 THEN 'boundary.rect' WHEN k % 5 = 1 THEN 'focus.lat' WHEN k % 7 = 0 THEN 'size' WHEN k % 13 = 0 THEN 'text' END"""
_NVAL = """CASE WHEN k % 3 = 0 THEN 'point.lat' WHEN k % 11 = 0 THEN 'boundary.rect' WHEN k % 7 = 0 THEN 'size' WHEN k % 17 = 0 THEN 'sort' WHEN k % 19 = 0 THEN 'include_distance' END"""


def _q(body: str, *ctes: str) -> str:
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body


QUERIES = {
    "k1_upsert_documents": (k1, _q("SELECT _id, round(CASE WHEN k % 21 = 0 THEN 0.0 WHEN k % 7 = 0 THEN price * 2 ELSE price END, 6) AS price FROM o WHERE k % 2 = 0 OR k % 7 = 0", _O)),
    "k2_delete_documents": (k2, _q("SELECT 'deleted' AS status, NULL::VARCHAR AS error, count(*) AS n FROM o WHERE k % 18 = 0 UNION ALL SELECT 'failed', 'cross_source_delete_rejected', count(*) FROM o WHERE k % 18 = 9 UNION ALL SELECT 'kept', NULL, count(*) FROM o WHERE k % 18 <> 0", _O)),
    "j5_delete_diff": (j5, _q("SELECT _id FROM o WHERE day < '2000-01-01' AND k % 3 = 0", _O)),
    "u3_id_except": (u3, _q("SELECT _id FROM o WHERE day >= '2000-01-01' AND k % 3 <> 0", _O)),
    "w4_keep_last_by_id": (w4, "SELECT 'postgis:lines:' || l_orderkey AS _id, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1"),
    "g8_duplicate_id_report": (g8, "SELECT 'lines' AS source_config, 'postgis:lines:' || l_orderkey AS _id, count(*) AS times FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1"),
    "a8_distinct_ids": (a8, "SELECT 'lines' AS source_config, count(*) AS rows, count(DISTINCT l_orderkey) AS ids FROM lineitem"),
    "a18_seen_id_counts": (a18, _q("SELECT source, count(*) AS ids FROM o GROUP BY 1", _O)),
    "g1_check_count_drop": (g1, _q(f"SELECT source, previous, current, round({_DROP}, 6) AS drop_ratio, {_VIOL} AS violation FROM cnt", _O, _CNT)),
    "g2_check_failure_ratio": (g2, _q("SELECT source, read, failed, round(failed / read::DOUBLE, 6) AS failed_ratio, CASE WHEN failed / read::DOUBLE > 0.01 THEN 'failure_ratio_exceeded' END AS violation FROM (SELECT source, count(*) AS read, count(*) FILTER (source LIKE '1%' AND k % 50 = 0) AS failed FROM o GROUP BY 1)", _O)),
    "a7_sync_totals": (a7, _q("SELECT sum(previous)::BIGINT AS read, sum(current)::BIGINT AS indexed, sum(current)::BIGINT AS unique_ids, sum(previous - current)::BIGINT AS failed, 0::BIGINT AS deleted FROM cnt", _O, _CNT)),
    "k4_write_seen_ids": (k4, _q("SELECT source AS source_name, count(*) AS ids, min(_id) AS first FROM o WHERE source >= '3' OR k % 3 = 0 GROUP BY 1", _O)),
    "k5_append_run_history": (k5, _q("SELECT event_id::VARCHAR AS run_id, endpoint AS source, CASE WHEN event_id % 9 = 0 THEN 'running' WHEN k % 4 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN event_id % 9 <> 0 AND k % 4 = 0 THEN 'lost' END AS error FROM e ORDER BY ts DESC, event_id::VARCHAR LIMIT 200", _E)),
    "k6_publish_history": (k6, _q("SELECT switch_id, target_index FROM sw WHERE status = 'success' AND type = 'view' ORDER BY ts DESC, switch_id LIMIT 1", _E, _SW)),
    "k8_rollback_candidates": (k8, _q("SELECT previous_read_index AS target, max(CASE WHEN contains(ts::VARCHAR, '.') THEN rtrim(rtrim(ts::VARCHAR, '0'), '.') ELSE ts::VARCHAR END) AS last_used FROM sw WHERE status = 'success' AND previous_read_index IS NOT NULL AND previous_read_index <> (SELECT max_by(target_index, (ts, switch_id)) FROM sw WHERE status = 'success') GROUP BY 1", _E, _SW)),
    "w8_newest_n_history": (w8, _q("SELECT switch_id FROM sw ORDER BY ts DESC, switch_id LIMIT 200", _E, _SW)),
    "a1_terms_count": (a1, _q("SELECT category AS value, count(*) AS count FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", _S)),
    "a2_missing_country_breakdown": (a2, base.sql("SELECT * FROM (SELECT 'layer' AS field, layer AS value, count(*) AS count FROM places WHERE country_a IS NULL GROUP BY 2 UNION ALL SELECT 'source_config', source_config, count(*) FROM places WHERE country_a IS NULL GROUP BY 2 UNION ALL SELECT 'segment', segment, count(*) FROM places WHERE country_a IS NULL GROUP BY 2)", "places")),
    "a3_index_stats": (a3, base.sql("SELECT * FROM (SELECT 'layer' AS field, v AS value, count(layer) AS count FROM (VALUES ('venue'), ('street'), ('address'), ('locality'), ('country')) AS l(v) LEFT JOIN places ON layer = v GROUP BY 2 UNION ALL SELECT 'segment', segment, count(*) FROM places GROUP BY 2 UNION ALL SELECT 'country_a', country_a, count(*) FROM places WHERE country_a IS NOT NULL GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM places GROUP BY 2 UNION ALL SELECT 'source_config', source_config, count(*) FROM places GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM places UNION ALL SELECT 'with_country', 'all', count(country_a) FROM places UNION ALL SELECT 'missing_country', 'all', count(*) FROM places WHERE country_a IS NULL UNION ALL SELECT 'last_indexed', 'all', max(key) FROM places UNION ALL SELECT 'missing_country_reason', CASE key % 2 WHEN 0 THEN 'no_covering_admin_boundary' ELSE 'unknown' END, count(*) FROM places WHERE country_a IS NULL GROUP BY 2)", "places")),
    "a4_category_counts": (a4, _q("SELECT category AS category_id, count(*) AS count FROM s GROUP BY 1 UNION ALL SELECT r_name, 0 FROM region", _S)),
    "a5_status_counts_with_missing": (a5, base.sql("SELECT coalesce(country_a, 'missing') AS status, count(*) AS count FROM places GROUP BY 1", "places")),
    "w7_top_hits_sample": (w7, base.sql("SELECT segment, _id FROM places QUALIFY row_number() OVER (PARTITION BY segment ORDER BY _id) <= 3", "places")),
    "g4_verify_enrichment": (g4, base.sql("SELECT status, count(*) OVER (PARTITION BY status) AS count, _id FROM (SELECT *, CASE WHEN country_a IS NULL THEN 'missing_country' ELSE 'enriched' END AS status FROM places) QUALIFY row_number() OVER (PARTITION BY status ORDER BY _id) <= 3", "places")),
    "a10_latency_summary": (a10, _q(f"SELECT endpoint, {_LAT.format(v='latency_ms')} FROM e GROUP BY 1", _E)),
    "a11_latency_by_endpoint": (a11, _q("SELECT endpoint, view, " + _LAT.format(v="v") + " FROM (SELECT endpoint, view, CASE view WHEN 'all' THEN CASE WHEN k % 4 <> 0 THEN latency_ms END WHEN 'cold' THEN CASE WHEN k % 4 <> 0 AND c THEN latency_ms END WHEN 'warm' THEN CASE WHEN k % 4 <> 0 AND NOT c THEN latency_ms END ELSE CASE WHEN k % 4 = 0 THEN latency_ms END END AS v FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY event_id) = 1 AS c FROM e), (VALUES ('all'), ('cold'), ('warm'), ('warm_up')) AS p(view)) GROUP BY 1, 2", _E)),
    "w10_cold_start_flag": (w10, _q("SELECT endpoint, min(event_id) AS event_id FROM e GROUP BY 1", _E)),
    "w6_slowest_n": (w6, _q("SELECT event_id, latency_ms FROM e ORDER BY latency_ms DESC, event_id LIMIT 10", _E)),
    "a12_per_query_aggregate": (a12, _q("SELECT endpoint, country, query, requests, failures, top_label, mismatches, least(20, mismatches)::INT AS shown, first_seq FROM pq", _E, _SM, _PQ)),
    "f19_country_mismatch": (f19, _q("SELECT country, count(*) AS n FROM sm WHERE top_country IS DISTINCT FROM country GROUP BY 1", _E, _SM)),
    "f20_reject_unusable_samples": (f20, _q("SELECT endpoint, count(*) AS rejected FROM sm WHERE NOT ok OR seq % 4 < 1 GROUP BY 1", _E, _SM)),
    "a13_missing_ratio": (a13, base.sql("SELECT count(*) AS total, count(*) FILTER (country_a IS NULL) AS missing, round(count(*) FILTER (country_a IS NULL) / count(*)::DOUBLE, 6) AS ratio FROM places", "places")),
    "a14_latest_success": (a14, _q("SELECT max(ts) AS latest_success FROM e WHERE k % 50 = 0", _E)),
    "f16_stale_sources": (f16, _q("SELECT source, age_seconds, threshold, stale FROM sf", _E, _ST, _STALE)),
    "g6_freshness_report": (g6, _q(f"SELECT count(*) AS sources, count(*) FILTER (stale) AS stale_sources, count(*) FILTER (stale) = 0 AS fresh, (SELECT count({_VIOL}) > 0 FROM cnt) AS count_drop FROM sf", _E, _ST, _STALE, _O, _CNT)),
    "j12_source_stats_join": (j12, _q("SELECT source, last_indexed_count, (SELECT count(*) FROM e WHERE status = 200 AND endpoint || '-' || (user_id % 10) = st.source) AS documents FROM st", _E, _ST)),
    "s12_read_sync_state": (s12, _q("SELECT * FROM st UNION ALL SELECT 'nowhere', NULL, NULL", _E, _ST)),
    "s11_read_documents": (s11, _q("SELECT layer, count(*) AS n FROM s GROUP BY 1", _S)),
    "s13_query_batch": (s13, _q("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS index FROM e", _E)),
    "g7_quality_matrix": (g7, "SELECT r_name AS country, n_name AS city, unnest(['restaurant', 'hotel', r_name]) AS query, endpoint FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('search'), ('autocomplete')) AS t(endpoint)"),
    "g7_quality_failures": (g7_failures, _q("SELECT 'request_failed' AS code, endpoint, failures::DOUBLE AS detail FROM pq WHERE failures > 0 UNION ALL SELECT 'country_filter_mismatch', endpoint, mismatches::DOUBLE FROM pq WHERE mismatches > 0 UNION ALL SELECT 'zero_results', endpoint, empty::DOUBLE FROM pq WHERE empty > 0 AND failures < requests UNION ALL SELECT 'missing_country_ratio_exceeded', 'index-stats', r FROM (SELECT round(count(*) FILTER (country_a IS NULL) / count(*)::DOUBLE, 6) AS r FROM places) WHERE r > 0.05 UNION ALL SELECT 'view_p95_latency_exceeded', 'view', p FROM (SELECT quantile_disc(latency_ms, 0.95) AS p FROM sm WHERE endpoint = 'view') WHERE p > 60", base.SQL["places"], _E, _SM, _PQ)),
    "j6_enrich_results": (j6, base.sql("SELECT event_id, coalesce(name, 'unknown') AS name, locality FROM events LEFT JOIN places ON user_id = key", "places")),
    "f15_clean_params": (f15, _q("SELECT event_id, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END::INT AS n, CASE WHEN k % 2 = 0 THEN 'en' END AS lang FROM e", _E)),
    "f17_validate_queries": (f17, f"SELECT event_id, CASE WHEN p IS NOT NULL THEN 'invalid_request' END AS error, p AS parameter FROM (SELECT event_id, {_VAL} AS p FROM (SELECT event_id, event_id AS k FROM events))"),
    "f17_validate_nearby": (f17_nearby, f"SELECT {_NVAL} AS parameter, count(*) AS n FROM (SELECT event_id AS k FROM events) GROUP BY 1"),
    "d2_duplicate_pairs": (d2, None),
    "d4_pick_better": (d4, _q("SELECT name, _id FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE WHEN k % 3 = 0 THEN 0.5 ELSE 0.9 END DESC, (k % 2 = 0) DESC, lat, _id) = 1", _S)),
}
_NEARD = base.sql_haversine("x.lat", "x.lon", "y.lat", "y.lon")
_SIMILAR = "(x.name = y.name OR (length(x.name) > 3 AND length(y.name) > 3 AND (contains(x.name, y.name) OR contains(y.name, x.name))))"
_PAIRS = f"""pr AS (SELECT a, b FROM (
 SELECT min(_id) OVER (PARTITION BY layer, source_id) AS a, _id AS b FROM dd UNION SELECT min(_id) OVER (PARTITION BY source_id), _id FROM dd
 UNION SELECT x._id, y._id FROM dd x JOIN dd y ON x._id < y._id AND abs(x.lat - y.lat) < 0.001 AND abs(x.lon - y.lon) < 0.001 WHERE {_SIMILAR} AND CASE WHEN x.layer = y.layer THEN {_NEARD} <= 30 ELSE {_NEARD} < 15 END) WHERE a < b)"""
QUERIES["d2_duplicate_pairs"] = (d2, _q("SELECT a, b FROM pr", _S, _DUP, _PAIRS))
QUERIES["d3_dedupe_table"] = (d3, "WITH RECURSIVE " + ", ".join((_S, _DUP, _PAIRS)) + """, bo AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), re(node, label) AS (SELECT _id, _id FROM dd UNION SELECT bo.b, re.label FROM re JOIN bo ON bo.a = re.node WHERE re.label < bo.b)
 SELECT node AS _id, node AS label FROM (SELECT node, min(label) AS label FROM re GROUP BY 1) WHERE node = label""")
QUERIES["d1_dedupe_results"] = (d1, "WITH RECURSIVE " + ", ".join((_S, _DUP)) + f""", o AS (SELECT k // 30 AS query_id, row_number() OVER (PARTITION BY k // 30 ORDER BY _id) AS rank, _id, {{'_id': _id, 'gid': 'osm:' || layer || ':' || source_id, 'source_id': source_id, 'layer': layer, 'lat': lat, 'lon': lon, 'name': name}} AS x FROM dd),
 st(query_id, rank, kept) AS (SELECT query_id, rank, [x] FROM o WHERE rank = 1 UNION ALL SELECT o.query_id, o.rank, CASE WHEN len(list_filter(kept, lambda y: y.gid = x.gid OR y.source_id = x.source_id OR ({_SIMILAR} AND CASE WHEN x.layer = y.layer THEN {_NEARD} <= 30 ELSE {_NEARD} < 15 END))) > 0 THEN kept ELSE list_append(kept, x) END FROM st JOIN o ON o.query_id = st.query_id AND o.rank = st.rank + 1),
 last AS (SELECT query_id, kept, rank - len(kept) AS deduped_count FROM st QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) = 1)
 SELECT query_id, CAST(generate_subscripts(kept, 1) AS INT) AS rank, unnest(kept)._id AS _id, CAST(deduped_count AS INT) AS deduped_count FROM last""")
QUERIES["g3_validate_version"] = g3
QUERIES["g7_run_matrix"] = g7_run
