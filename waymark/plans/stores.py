"""Queries that write and read back: versions, throw-away versions, reports, taxonomy and label files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intent, quality, sync
from ..sources.store import place, written
from . import base
from .quality import _samples
from .search import docs


def k7(spark, d):
    """Two versions of the parts' documents are published; the second is read through the view."""
    v = sync.Versions(spark, place(spark, "versions"), "waymark_published")
    t = docs(spark, d).select("_id", "name", "layer")
    for n, rows in enumerate((t.where("layer = 'venue'"), t)):
        v.publish(v.write(rows), 1, 0, f"2024-01-0{n + 1}T00:00:00", F.col("name").isNotNull())
    return spark.table("waymark_published").groupBy("layer").agg(F.count(F.lit(1)).alias("documents"))


def k8_rollback(spark, d):
    """As k7, then back to the first version."""
    v = sync.Versions(spark, place(spark, "versions"), "waymark_rolled_back")
    t = docs(spark, d).select("_id", "name", "layer")
    for n, rows in enumerate((t.where("layer = 'venue'"), t)):
        v.publish(v.write(rows), 1, 0, f"2024-01-0{n + 1}T00:00:00")
    v.rollback("2024-01-03T00:00:00", sample=F.col("name").isNotNull())
    return spark.table("waymark_rolled_back").groupBy("layer").agg(F.count(F.lit(1)).alias("documents"))


def k12(spark, d):
    """The enrichment report of a version that is written, checked and removed."""
    p = base.places(spark, d).withColumn("status", F.when(F.col("country_a").isNull(), "missing_country").otherwise("enriched"))
    v = sync.Versions(spark, place(spark, "versions"), "waymark_temporary")
    return v.verify(p, lambda t: written(quality.status_counts(t, "status")))


def k10(spark, d):
    """A report's tables as JSON files, one folder for each section, read back."""
    s = _samples(spark, d)
    root = place(spark, "report")
    quality.write_report({"per_query": quality.per_query(s, ["endpoint", "country", "query"]).drop("first_mismatches"), "per_endpoint": quality.latency(s, ["endpoint"]), "slowest": quality.slowest(s, id_="seq")}, root)
    return spark.read.schema("endpoint string, count long, p50 double, p95 double, p99 double, max double").json(f"{root}/per_endpoint")


def s9(spark, d):
    """A taxonomy file made of the parts' nouns, loaded into its dimensions."""
    cat = docs(spark, d).groupBy("category").agg(F.collect_set("grp").alias("g"), F.round(F.max("importance"), 3).alias("i"))
    one = F.struct(F.col("category").alias("id"), F.col("g").alias("intent_groups"), F.col("i").alias("importance"), F.struct(F.initcap("category").alias("en")).alias("names"), F.struct(F.array(F.concat("category", F.lit(" shop"))).alias("en")).alias("aliases"), F.array(F.struct(F.lit("noun").alias("key"), F.col("category").alias("value"))).alias("osm_tags"))
    path = place(spark, "taxonomy")
    cat.select(F.to_json(F.struct(F.array(one).alias("categories"))).alias("value")).write.text(path)
    dims = intent.load_taxonomy(spark, path, lines=True)
    return dims["dim_term"].where("type = 'category'").select("id", "term")


def s10(spark, d):
    """Entity files made of the parts' names, one line each, loaded as labels and aliases."""
    n = docs(spark, d).groupBy("category").agg(F.array_sort(F.collect_set("name")).alias("names"))
    one = F.struct(F.concat(F.lit("Q"), F.length("category")).alias("id"), F.struct(F.struct(F.col("category").alias("value")).alias("en")).alias("labels"), F.struct(F.transform("names", lambda x: F.struct(x.alias("value"))).alias("en")).alias("aliases"))
    path = place(spark, "entities")
    n.select(F.to_json(one).alias("value")).repartition(F.col("value")).write.option("maxRecordsPerFile", 1).text(path)
    return intent.wikidata_labels(spark, path).groupBy("qid", "lang", "kind").agg(F.count(F.lit(1)).alias("n"))


_L = "SELECT CASE p_partkey % 4 WHEN 0 THEN 'street' WHEN 1 THEN 'locality' ELSE 'venue' END AS layer, count(*) AS documents FROM part GROUP BY 1"
QUERIES = {
    "k7_publish_version": (k7, _L),
    "k8_rollback_version": (k8_rollback, f"SELECT * FROM ({_L}) WHERE layer = 'venue'"),
    "k12_verify_in_temp_version": (k12, base.sql("SELECT CASE WHEN country_a IS NULL THEN 'missing_country' ELSE 'enriched' END AS status, count(*) AS count FROM places GROUP BY 1", "places")),
    "k10_write_quality_report": (k10, "SELECT event_type AS endpoint, count(value) AS count, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max FROM events GROUP BY 1"),
    "s9_load_taxonomy": (s9, "SELECT DISTINCT c AS id, unnest([c, c || ' shop']) AS term FROM (SELECT split_part(lower(p_name), ' ', 2) AS c FROM part)"),
    "s10_load_wikidata_labels": (s10, "SELECT 'Q' || length(c) AS qid, 'en' AS lang, kind, CASE kind WHEN 'label' THEN count(DISTINCT c) ELSE count(DISTINCT n) END AS n FROM (SELECT split_part(lower(p_name), ' ', 2) AS c, lower(p_name) AS n FROM part), (VALUES ('label'), ('alias')) AS k(kind) GROUP BY 1, 3"),
}
