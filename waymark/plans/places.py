"""Queries over sources and place documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import features, places
from ..sources import spec as sources
from . import base

SPEC = sources.SourceSpec(
    name="osm_pois", layer="venue", id_field="osm_id", name_fields=("name", "name_en", "name_ar", "name_ku", "name_ckb"), category_fields=("amenity", "shop"),
    address_fields={"number": "housenumber", "street": "street", "zip": "postalcode"}, hierarchy_fields={"locality": "locality", "region": "region"}, addendum_fields=("amenity", "population"),
    popularity_field="population", layer_field="admin_level", layer_map={"4": "region", "8": "locality", "10": "neighbourhood"},
)

_RAW = f"""raw AS (
  SELECT CASE WHEN c_custkey % 29 = 0 THEN '' ELSE c_custkey::VARCHAR END AS osm_id, CASE WHEN c_custkey % 17 = 0 THEN '  ' WHEN c_custkey % 19 = 0 THEN NULL ELSE ' ' || c_name || ' ' END AS name,
   CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) END AS name_en, CASE WHEN c_custkey % 6 = 1 THEN 'اسم' || c_custkey END AS name_ar, NULL::VARCHAR AS name_ku, CASE WHEN c_custkey % 4 = 0 THEN 'k' || c_custkey END AS name_ckb,
   CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) END AS amenity, CASE WHEN c_custkey % 7 = 0 THEN ' Big  Shop ' END AS shop, CASE c_custkey % 6 WHEN 0 THEN 'primary' WHEN 1 THEN 'track' WHEN 2 THEN 'service' END AS highway,
   CASE c_custkey % 5 WHEN 0 THEN 'city' WHEN 1 THEN 'farm' WHEN 2 THEN 'hamlet' END AS place, CASE WHEN c_custkey % 8 < 6 THEN (c_custkey % 50)::VARCHAR END AS housenumber, 'Street ' || (c_custkey % 9) AS street, '' AS postalcode,
   n_name AS locality, r_name AS region, CASE c_custkey % 9 WHEN 0 THEN 'abc' WHEN 1 THEN '' ELSE (c_custkey * 3)::VARCHAR END AS population, CASE c_custkey % 5 WHEN 0 THEN '4' WHEN 1 THEN '8' WHEN 2 THEN '3' END AS admin_level,
   CASE WHEN c_custkey % 3 = 0 THEN 'administrative' ELSE 'park' END AS boundary, CASE WHEN c_custkey % 23 <> 0 THEN {base.SQL_LON.format('c_custkey')} END AS lon, {base.SQL_LAT.format('c_custkey')} AS lat, c_custkey AS k
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def raw(spark, d):
    """Rows like a map source's: blanks, missing names, coordinates and levels, tags as columns and as a map."""
    k = F.col("c_custkey")
    rows = base.read(spark, d, "customer").join(base.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(base.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(
        F.when(k % 29 == 0, "").otherwise(k.cast("string")).alias("osm_id"), F.when(k % 17 == 0, "  ").when(k % 19 == 0, None).otherwise(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("name"),
        F.when(k % 3 == 0, F.upper("c_name")).alias("name_en"), F.when(k % 6 == 1, F.concat(F.lit("اسم"), k)).alias("name_ar"), F.lit(None).cast("string").alias("name_ku"), F.when(k % 4 == 0, F.concat(F.lit("k"), k)).alias("name_ckb"),
        F.when(k % 2 == 0, F.lower("c_mktsegment")).alias("amenity"), F.when(k % 7 == 0, " Big  Shop ").alias("shop"), F.lit(None).cast("string").alias("tourism"), F.lit(None).cast("string").alias("leisure"), F.lit(None).cast("string").alias("office"),
        F.when(k % 6 == 0, "primary").when(k % 6 == 1, "track").when(k % 6 == 2, "service").alias("highway"), F.when(k % 5 == 0, "city").when(k % 5 == 1, "farm").when(k % 5 == 2, "hamlet").alias("place"),
        F.when(k % 8 < 6, (k % 50).cast("string")).alias("housenumber"), F.concat(F.lit("Street "), k % 9).alias("street"), F.lit("").alias("postalcode"), F.col("n_name").alias("locality"), F.col("r_name").alias("region"),
        F.when(k % 9 == 0, "abc").when(k % 9 == 1, "").otherwise((k * 3).cast("string")).alias("population"), F.when(k % 5 == 0, "4").when(k % 5 == 1, "8").when(k % 5 == 2, "3").alias("admin_level"),
        F.when(k % 3 == 0, "administrative").otherwise("park").alias("boundary"), F.when(k % 23 != 0, base.lon(k)).alias("lon"), base.lat(k).alias("lat"), k.alias("k"),
    )
    return rows.withColumn("tags", F.map_filter(F.create_map(F.lit("addr:housenumber"), F.col("housenumber"), F.lit("addr:street"), F.col("street"), F.lit("ISO3166-2"), F.col("locality")), lambda _, v: v.isNotNull()))


def _docs(spark, d):
    rows = raw(spark, d)
    return places.documents(rows.withColumn("_lon", F.col("lon")).withColumn("_lat", F.col("lat")), SPEC)


def _good(spark, d):
    return places.split(_docs(spark, d))[0]


_get = lambda m, k: F.try_element_at(m, F.lit(k)).alias(k)
_ERROR = "CASE WHEN trim(osm_id) = '' THEN 'missing_id' WHEN lon IS NULL THEN 'invalid_coordinates' WHEN nullif(trim(name), '') IS NULL THEN 'missing_name' END"
_LAYER = "CASE admin_level WHEN '4' THEN 'region' WHEN '8' THEN 'locality' ELSE 'venue' END"
_G = f"good AS (SELECT *, {_LAYER} AS layer FROM raw WHERE {_ERROR} IS NULL)"


def s1(spark, d):
    raw(spark, d).createOrReplaceTempView("waymark_source")
    spec = sources.SourceSpec(name="osm_pois", layer="venue", id_field="osm_id", sql="SELECT osm_id, name, lon, lat FROM waymark_source WHERE k > 10")
    return sources.scan(spark, spec).select("osm_id", "name", F.round("_lon", 6).alias("_lon"), F.round("_lat", 6).alias("_lat"))


def s2(spark, d):
    return sources.located(raw(spark, d), ("lon", "lat"), 25).agg(F.count(F.lit(1)).alias("n"))


def s3(spark, d):
    return sources.pois(raw(spark, d)).select("k", "name", "amenity", "shop")


def s4(spark, d):
    return sources.streets(raw(spark, d)).select("k", "highway")


def s5(spark, d):
    return sources.settlements(raw(spark, d)).select("k", "place", "population")


def s6(spark, d):
    return sources.admin_boundaries(raw(spark, d)).select("k", "admin_level", "region", "locality", "region_a")


def s7(spark, d):
    return sources.addresses(raw(spark, d)).select("k", "name", "housenumber", "street")


def s8(spark, d):
    raw(spark, d).createOrReplaceTempView("waymark_source")
    return sources.lookup(spark, "SELECT k, street FROM waymark_source WHERE street = :street AND k > :least", street="Street 3", least=40)


def p1(spark, d):
    return _docs(spark, d).select("source_id", *[_get("name", k) for k in ("default", "en", "ar", "ku", "ckb")])


def p2(spark, d):
    return raw(spark, d).select("k", places.layer(raw(spark, d), SPEC).alias("layer"))


def p3(spark, d):
    return _good(spark, d).select("_id", _get("source_tags", "amenity"), _get("source_tags", "shop"), F.size("source_tags").alias("n_tags"))


def p4(spark, d):
    return _good(spark, d).select("_id", _get("address_parts", "number"), _get("address_parts", "street"), _get("address_parts", "zip"))


def p5(spark, d):
    out = raw(spark, d)
    p = places.parents(out, SPEC)
    return out.select("k", scalars.first_of(p, "locality").alias("locality"), scalars.first_of(p, "region").alias("region"), F.size(p).alias("n"))


def p6(spark, d):
    return _good(spark, d).select("_id", "layer", scalars.first_of(F.col("parent"), "locality").alias("locality"), F.size("parent").alias("n_levels"))


def p7(spark, d):
    return _good(spark, d).select("_id", F.size("addendum").alias("n"), _get("addendum", "population"))


def p8(spark, d):
    return raw(spark, d).select("k", scalars.number(F.col("population")).alias("popularity"))


def p9(spark, d):
    return _docs(spark, d).select("_id", "source_id", "source_config", "source", "layer", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "popularity", "error")


def f1(spark, d):
    return _docs(spark, d).groupBy("error").agg(F.count(F.lit(1)).alias("documents"))


def k3(spark, d):
    return places.quarantine(places.split(_docs(spark, d))[1]).select("source_config", "stage", "id", "error")


def k11(spark, d):
    docs = _docs(spark, d)
    return docs.agg(F.count(F.lit(1)).alias("read"), F.count_if(F.col("error").isNull()).alias("indexed"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def p11(spark, d):
    return raw(spark, d).select("k", F.array_join(places.normalized_categories(F.array("shop", "amenity", F.lit(None).cast("string"), "shop", F.upper("amenity"))), "|").alias("categories"))


def p12(spark, d):
    parts = F.create_map(F.lit("street"), F.concat(F.lit("  "), "street"), F.lit("zip"), F.lit("  "), F.lit("number"), F.col("housenumber"))
    return raw(spark, d).select("k", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(places.normalized_address(parts))))).alias("address"))


def p13(spark, d):
    parent = F.create_map(F.lit("region"), F.array(F.lit(" x "), F.col("region"), F.lit("x"), F.lit("")), F.lit("county"), F.array(F.lit(" ")))
    return raw(spark, d).select("k", F.array_join(F.map_values(places.normalized_parent(parent))[0], "|").alias("region"), F.size(places.normalized_parent(parent)).alias("n"))


def p14(spark, d):
    return places.index_documents(_good(spark, d)).select("_id", "gid", "label", "locality", "region", F.array_join("category_ids", "|").alias("category_ids"), F.round("center_point.lat", 6).alias("lat"), F.get_json_object("addendum.postgis", "$.amenity").alias("amenity"))


def p15(spark, d):
    return raw(spark, d).select("k", places.label(F.col("name"), F.lit(" "), F.col("locality"), F.col("region"), F.col("locality")).alias("label"))


def p16(spark, d):
    return places.index_documents(_good(spark, d)).select("_id", *places.PROMOTED)


def u1(spark, d):
    a = _good(spark, d).where("layer = 'venue'").select("_id", "layer", "popularity")
    b = _good(spark, d).where("layer <> 'venue'").select("_id", "layer")
    return places.union(a, b).select("_id", "layer", "popularity")


def u2(spark, d):
    return raw(spark, d).select("k", F.array_join(scalars.distinct_values(F.array("locality", "region", F.lit(""), "amenity", "locality")), "|").alias("v"))


def p20(spark, d):
    extra = features.addendum(F.col("props"))
    return base.read(spark, d, "events").select("event_id", features.poi_field(extra, "k").alias("k"), features.poi_field(extra, "phone", F.col("event_type")).alias("phone"))


def p22(spark, d):
    parent = F.create_map(F.lit("region"), F.when(F.col("k") % 2 == 0, F.array("region")))
    return raw(spark, d).select("k", features.hierarchy(parent, "region", F.col("locality")).alias("region"))


def p23(spark, d):
    parts = F.map_filter(F.create_map(F.lit("street"), F.col("street"), F.lit("housenumber"), F.when(F.col("k") % 2 == 0, F.lit("h1")), F.lit("number"), F.col("housenumber"), F.lit("zip"), F.lit("9")), lambda _, v: v.isNotNull())
    return raw(spark, d).select("k", features.address(parts).alias("a")).select("k", "a.*")


def p24(spark, d):
    return _docs(spark, d).select("source_id", features.name_of(F.col("name")).alias("feature_name"))


def p25(spark, d):
    return raw(spark, d).select("k", features.joined(F.col("name"), F.col("locality"), F.col("region"), F.col("locality")).alias("label"))


def p26(spark, d):
    names = F.map_filter(F.create_map(F.lit("en"), F.col("name_en"), F.lit("ar"), F.col("name_ar")), lambda _, v: v.isNotNull())
    n, lab = features.in_language(names, F.concat_ws(", ", F.lit("X"), "locality", "region"), F.lit("EN-us"))
    return raw(spark, d).select("k", n.alias("name_preferred"), lab.alias("label_preferred"))


def p27(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, F.lit("not json")).otherwise(F.col("props"))
    m = features.addendum(text)
    return base.read(spark, d, "events").select("event_id", _get(m, "k"), _get(m, "raw"))


def p28(spark, d):
    docs = places.index_documents(_good(spark, d))
    return docs.select("_id", "layer", "label", F.coalesce("locality", scalars.first_of(F.col("parent"), "locality")).alias("locality"), F.coalesce("country_a", F.lit("missing")).alias("country_a"))


def p30(spark, d):
    return base.read(spark, d, "documents").select("doc_id", F.length(scalars.shortened(F.col("text"))).alias("n"), F.substring(scalars.shortened(F.col("text")), -3, 3).alias("tail"))


def f9(spark, d):
    from ..functions import geo

    lat = F.when(F.col("k") % 5 == 0, F.lit(95.0)).otherwise(F.col("lat"))
    return raw(spark, d).select("k", F.coalesce(geo.valid_point(lat, F.col("lon")), F.lit(False)).alias("valid"))


def f11(spark, d):
    return base.places(spark, d).where(F.col("country_a").isNull()).select("_id", "layer")


def x_scalars(spark, d):
    c = base.read(spark, d, "customer")
    return c.select("c_custkey", scalars.country_code(F.concat(F.lit(" r"), "c_nationkey")).alias("code"), scalars.lang_code(F.concat(F.lit("EN-"), "c_nationkey")).alias("lang"), scalars.gid(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("c_custkey").cast("string")).alias("gid"),
        F.round(scalars.percent_drop(F.col("c_custkey"), F.lit(10)), 6).alias("drop"), F.round(scalars.percent_drop(F.lit(0), F.lit(10)), 6).alias("none"))


def x25(spark, d):
    k = F.col("c_custkey")
    return base.read(spark, d, "customer").select("c_custkey", scalars.confidence(k % 4 == 0, k % 3 == 0, k % 2 == 0, k % 8 == 0).alias("confidence"))


def x26(spark, d):
    k = F.col("k")
    kind = scalars.match_type(F.when(k % 2 == 0, "5"), F.when(k % 3 == 0, "Main"), F.when(k % 5 == 0, "Town").otherwise(" "))
    return raw(spark, d).select("k", kind.alias("match_type"), scalars.match_confidence(kind).alias("confidence"))


def _q(body: str, good: bool = False) -> str:
    return f"WITH {_RAW}{', ' + _G if good else ''} {body}"


_N = "nullif(trim({0}), '')"
_POP = "CASE WHEN population ~ '^[0-9]+$' THEN population::DOUBLE END"
QUERIES = {
    "s1_source_scan": (s1, _q("SELECT osm_id, name, round(lon, 6) AS _lon, round(lat, 6) AS _lat FROM raw WHERE k > 10 AND lon IS NOT NULL")),
    "s2_source_limit": (s2, _q("SELECT count(*) AS n FROM (SELECT * FROM raw WHERE lon IS NOT NULL LIMIT 25)")),
    "s3_source_pois": (s3, _q("SELECT k, name, amenity, shop FROM raw WHERE name <> '' AND (amenity IS NOT NULL OR shop IS NOT NULL)")),
    "s4_source_streets": (s4, _q("SELECT k, highway FROM raw WHERE name <> '' AND highway IN ('primary', 'service')")),
    "s5_source_places": (s5, _q("SELECT k, place, population FROM raw WHERE name <> '' AND place IN ('city', 'hamlet')")),
    "s6_source_admin_boundaries": (s6, _q("SELECT k, admin_level, CASE WHEN admin_level = '4' THEN name END AS region, CASE WHEN admin_level = '8' THEN name END AS locality, CASE WHEN admin_level = '4' THEN locality END AS region_a FROM (SELECT * FROM raw WHERE name <> '' AND boundary = 'administrative' AND admin_level IN ('4', '8')) AS raw").replace("CASE WHEN admin_level = '4' THEN locality END", "CASE WHEN admin_level = '4' THEN raw.locality END").replace("CASE WHEN admin_level = '8' THEN name END AS locality", "CASE WHEN admin_level = '8' THEN raw.name END AS locality")),
    "s7_source_addresses": (s7, _q("SELECT k, housenumber AS name, housenumber, street FROM raw WHERE housenumber <> ''")),
    "s8_parameterised_lookup": (s8, _q("SELECT k, street FROM raw WHERE street = 'Street 3' AND k > 40")),
    "p1_build_names": (p1, _q(f"""SELECT osm_id AS source_id, {_N.format('name')} AS "default", {_N.format('name_en')} AS en, name_ar AS ar, name_ckb AS ku, name_ckb AS ckb FROM raw""")),
    "p2_resolve_layer": (p2, _q(f"SELECT k, {_LAYER} AS layer FROM raw")),
    "p3_collect_source_tags": (p3, _q("SELECT 'postgis:osm_pois:' || osm_id AS _id, amenity, trim(shop) AS shop, ((amenity IS NOT NULL)::INT + (shop IS NOT NULL)::INT)::INT AS n_tags FROM good", True)),
    "p4_map_address_parts": (p4, _q("SELECT 'postgis:osm_pois:' || osm_id AS _id, housenumber AS number, street, NULL::VARCHAR AS zip FROM good", True)),
    "p5_map_parent_fields": (p5, _q("SELECT k, locality, region, 2::INT AS n FROM raw")),
    "p6_self_hierarchy": (p6, _q("SELECT 'postgis:osm_pois:' || osm_id AS _id, layer, locality, 2::INT AS n_levels FROM good", True)),
    "p7_map_addendum": (p7, _q("SELECT 'postgis:osm_pois:' || osm_id AS _id, ((amenity IS NOT NULL)::INT + (population <> '')::INT)::INT AS n, nullif(population, '') AS population FROM good", True)),
    "p8_parse_popularity": (p8, _q(f"SELECT k, {_POP} AS popularity FROM raw")),
    "p9_to_domain_doc": (p9, _q(f"SELECT 'postgis:osm_pois:' || osm_id AS _id, osm_id AS source_id, 'osm_pois' AS source_config, 'osm' AS source, {_LAYER} AS layer, round(lat, 6) AS lat, round(lon, 6) AS lon, {_POP} AS popularity, {_ERROR} AS error FROM raw")),
    "f1_valid_row": (f1, _q(f"SELECT {_ERROR} AS error, count(*) AS documents FROM raw GROUP BY 1")),
    "k3_quarantine_rows": (k3, _q(f"SELECT 'osm_pois' AS source_config, 'transform' AS stage, osm_id AS id, {_ERROR} AS error FROM raw WHERE {_ERROR} IS NOT NULL QUALIFY row_number() OVER (ORDER BY osm_id NULLS FIRST, {_ERROR}) <= 20")),
    "k11_dry_run": (k11, _q(f"SELECT count(*) AS read, count(*) FILTER ({_ERROR} IS NULL) AS indexed, count(*) FILTER ({_ERROR} IS NOT NULL) AS failed FROM raw")),
    "p11_normalize_categories": (p11, _q("SELECT k, coalesce(CASE WHEN shop IS NOT NULL THEN 'big_shop' END || '|' || amenity, CASE WHEN shop IS NOT NULL THEN 'big_shop' END, amenity, '') AS categories FROM raw")),
    "p12_normalize_address": (p12, _q("""SELECT k, '{' || CASE WHEN housenumber IS NOT NULL THEN '"number":"' || housenumber || '",' ELSE '' END || '"street":"' || street || '"}' AS address FROM raw""")),
    "p13_normalize_parent": (p13, _q("SELECT k, 'x|' || region AS region, 1::INT AS n FROM raw")),
    "p14_build_index_document": (p14, _q("SELECT 'postgis:osm_pois:' || osm_id AS _id, 'osm:' || layer || ':' || osm_id AS gid, trim(name) || ', ' || locality || ', ' || region AS label, locality, region, coalesce(amenity || CASE WHEN shop IS NOT NULL THEN '|big_shop' ELSE '' END, CASE WHEN shop IS NOT NULL THEN 'big_shop' END, '') AS category_ids, round(lat, 6) AS lat, amenity FROM good", True)),
    "p15_document_label": (p15, _q("SELECT k, coalesce(nullif(trim(name), '') || ', ', '') || locality || ', ' || region AS label FROM raw")),
    "p16_promote_admin_fields": (p16, _q("SELECT 'postgis:osm_pois:' || osm_id AS _id, NULL::VARCHAR AS country, NULL::VARCHAR AS country_a, region, NULL::VARCHAR AS region_a, NULL::VARCHAR AS county, locality, NULL::VARCHAR AS localadmin, NULL::VARCHAR AS neighbourhood FROM good", True)),
    "u1_union_sources": (u1, _q(f"SELECT 'postgis:osm_pois:' || osm_id AS _id, layer, CASE WHEN layer = 'venue' THEN {_POP} END AS popularity FROM good", True)),
    "u2_distinct_values": (u2, _q("SELECT k, locality || '|' || region || coalesce('|' || amenity, '') AS v FROM raw")),
    "p20_feature_full": (p20, "SELECT event_id, props->>'$.k' AS k, event_type AS phone FROM events"),
    "p22_extract_hierarchy": (p22, _q("SELECT k, CASE WHEN k % 2 = 0 THEN region ELSE locality END AS region FROM raw")),
    "p23_extract_address_fields": (p23, _q("SELECT k, street, CASE WHEN k % 2 = 0 THEN 'h1' ELSE housenumber END AS housenumber, '9' AS postalcode FROM raw")),
    "p24_feature_name": (p24, _q("SELECT osm_id AS source_id, coalesce(nullif(trim(name), ''), name_en, name_ar, name_ckb) AS feature_name FROM raw")),
    "p25_feature_label": (p25, _q("SELECT k, coalesce(nullif(trim(name), '') || ', ', '') || locality || ', ' || region AS label FROM raw")),
    "p26_language_columns": (p26, _q("SELECT k, name_en AS name_preferred, name_en || ', ' || locality || ', ' || region AS label_preferred FROM raw")),
    "p27_parse_addendum": (p27, "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN props->>'$.k' END AS k, CASE WHEN event_id % 5 = 0 THEN 'not json' END AS raw FROM events"),
    "p28_explain_sample": (p28, _q("SELECT 'postgis:osm_pois:' || osm_id AS _id, layer, trim(name) || ', ' || locality || ', ' || region AS label, locality, 'missing' AS country_a FROM good", True)),
    "p30_sanitize_row": (p30, "SELECT doc_id, CASE WHEN length(text) > 500 THEN 503 ELSE length(text) END::INT AS n, CASE WHEN length(text) > 500 THEN '...' ELSE right(text, 3) END AS tail FROM documents"),
    "f9_valid_coordinates": (f9, _q("SELECT k, lon IS NOT NULL AND k % 5 <> 0 AS valid FROM raw")),
    "f11_missing_country": (f11, base.sql("SELECT _id, layer FROM places WHERE country_a IS NULL", "places")),
    "x19_to_x22_scalars": (x_scalars, """SELECT c_custkey, 'R' || c_nationkey AS code, 'en' AS lang, 'unknown:venue:' || c_custkey AS gid, CASE WHEN c_custkey = 0 THEN 0.0::DOUBLE ELSE round((c_custkey - 10) / c_custkey::DOUBLE, 6) END AS "drop", 0.0::DOUBLE AS "none" FROM customer"""),
    "x25_confidence": (x25, "SELECT c_custkey, CASE WHEN c_custkey % 8 = 0 THEN 0.9 WHEN c_custkey % 4 = 0 THEN 1.0 WHEN c_custkey % 3 = 0 THEN 0.65 WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM customer"),
    "x26_match_type": (x26, _q("SELECT k, m AS match_type, CASE m WHEN 'exact_address' THEN 1.0 WHEN 'street_only' THEN 0.7 WHEN 'locality_match' THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM (SELECT k, CASE WHEN k % 30 = 0 THEN 'exact_address' WHEN k % 3 = 0 THEN 'street_only' WHEN k % 5 = 0 THEN 'locality_match' ELSE 'partial_match' END AS m FROM raw)")),
}
