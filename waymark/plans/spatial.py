"""Queries over spatial joins: nearby, reverse, boundaries, roads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import enrich, features, rank, spatial
from ..sources.store import place
from . import base

R6 = lambda x: F.round(x, 6)
_D = base.sql_haversine("q_lat", "q_lon", "lat", "lon")
_NEAR = f"near AS (SELECT * FROM (SELECT asks.*, places.*, {_D} AS distance FROM asks JOIN places ON abs(lat - q_lat) <= 0.03 AND abs(lon - q_lon) <= 0.04) WHERE distance <= radius)"


def _near(spark, d):
    return spatial.radius_join(base.asks(spark, d), base.places(spark, d), most=3000.0)


def _nearest(spark, d, k):
    """What the k nearest venues of each query are chosen from."""
    return spatial.nearest_join(base.asks(spark, d), base.places(spark, d).where("layer = 'venue'"), k, most=3000.0)


def radius(spark, d):
    return _near(spark, d).select("query_id", "_id", R6("distance").alias("distance"))


def nearby_distance(spark, d):
    hits = rank.nearby(_nearest(spark, d, 10), "distance", layers=("venue",), size=10)
    return hits.select("query_id", "rank", "_id", geo.round2(F.col("distance")).alias("distance_meters"))


def _rated(spark, d):
    """Places, and how important their segments are."""
    return base.places(spark, d).select("_id", "layer", "lat", "lon", "segment").join(F.broadcast(base.segments(spark)), "segment")


def nearby_relevance(spark, d):
    hits = rank.nearby_join(base.asks(spark, d), _rated(spark, d), "relevance", layers=("venue",), size=10, relevance=F.col("importance"), most=3000.0)
    return hits.select("query_id", "rank", "_id", R6("importance").alias("score"))


def nearby_hybrid(spark, d):
    hits = rank.nearby_join(base.asks(spark, d), _rated(spark, d), "hybrid", layers=("venue",), size=10, relevance=F.col("importance"), most=3000.0)
    return hits.select("query_id", "rank", "_id", R6("score").alias("score"))


def reverse(spark, d):
    return rank.reverse(_near(spark, d), radius=1000.0, size=1).select("query_id", "rank", "_id", R6("distance").alias("distance"))


def closest(spark, d):
    """The closest point of all segments of the road that each place is nearest to."""
    roads = _snapped(spark, d).select("_id", "road_id").join(base.places(spark, d).select("_id", "lon", "lat").hint("merge"), "_id")
    met = roads.join(spatial.segments(base.roads(spark, d)).hint("merge"), "road_id")
    x, y = spatial.closest_point(F.col("lon"), F.col("lat"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return met.select("_id", "road_id", "seg", R6(x).alias("x"), R6(y).alias("y"))


_T = "least(1.0, greatest(0.0, (({px} - x1) * (x2 - x1) + ({py} - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))"


def _snapped(spark, d):
    return spatial.nearest_line(base.places(spark, d), spatial.segments(base.roads(spark, d)), 800.0)


def nearest_road(spark, d):
    return _snapped(spark, d).select("_id", "road_id", R6("snap_lon").alias("snap_lon"), R6("snap_lat").alias("snap_lat"), R6("snap_distance").alias("snap_distance"))


_T_P = _T.format(px="lon", py="lat")
_SNAP = f"""snap AS (
  SELECT * FROM (SELECT *, {base.sql_haversine('lat', 'lon', 'sy', 'sx')} AS dist FROM (
    SELECT places.*, road_id, seg, x1 + {_T_P} * (x2 - x1) AS sx, y1 + {_T_P} * (y2 - y1) AS sy FROM places JOIN roads
    ON lon BETWEEN least(x1, x2) - 0.02 AND greatest(x1, x2) + 0.02 AND lat BETWEEN least(y1, y2) - 0.02 AND greatest(y1, y2) + 0.02))
  WHERE dist <= 800 QUALIFY row_number() OVER (PARTITION BY _id ORDER BY dist, road_id, seg) = 1)"""


def routable(spark, d):
    out = enrich.routable(base.places(spark, d), _snapped(spark, d), layers=("venue", "address"))
    return out.select("_id", "routable_status", "routable_reason", "routable_source", R6("routable_lon").alias("routable_lon"), R6("routable_lat").alias("routable_lat"), R6("routable_distance").alias("routable_distance"))


def snap_eligible(spark, d):
    return base.places(spark, d).groupBy("layer").agg(F.count_if(enrich.snap_eligible(F.col("layer"), F.col("lat"), F.col("lon"), ("venue", "address"))).alias("eligible"), F.count(F.lit(1)).alias("places"))


def snap_stats(spark, d):
    out = enrich.routable(base.places(spark, d), _snapped(spark, d), layers=("venue", "address"))
    return enrich.snap_stats(out.withColumn("took", (F.substring_index("_id", ":", -1).cast("long") * 37 % 1009).cast("double")), "took")


# Boundaries: a 5 x 5 grid of squares at level 4, five bands at level 2, and a triangle and a square with a hole at level 8.
def _areas(spark, d):
    n = base.read(spark, d, "nation")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    box = lambda x, y, w, h: F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))
    k = F.col("n_nationkey")
    x, y = 44 + (k % 5) / F.lit(5.0), 33 + F.floor(k / 5) / F.lit(5.0)
    squares = n.select((k + 100).alias("area_id"), F.lit(4).alias("admin_level"), F.col("n_name").alias("name"), F.concat(F.lit("q"), k).alias("code"), F.lit(0.04).alias("area"), F.array(box(x, y, F.lit(0.2), F.lit(0.2))).alias("rings"))
    r = base.read(spark, d, "region")
    band = 33 + F.col("r_regionkey") / F.lit(5.0)
    bands = r.select(F.col("r_regionkey").alias("area_id"), F.lit(2).alias("admin_level"), F.col("r_name").alias("name"), F.concat(F.lit("r"), "r_regionkey").alias("code"), F.lit(0.2).alias("area"), F.array(box(F.lit(44.0), band, F.lit(1.0), F.lit(0.2))).alias("rings"))
    lit = lambda *p: F.array(*[point(F.lit(a), F.lit(b)) for a, b in p])
    one = spark.range(1)
    triangle = one.select(F.lit(900).alias("area_id"), F.lit(8).alias("admin_level"), F.lit("Triangle").alias("name"), F.lit("t").alias("code"), F.lit(0.18).alias("area"), F.array(lit((44.1, 33.1), (44.7, 33.1), (44.1, 33.7))).alias("rings"))
    hole = one.select(F.lit(901).alias("area_id"), F.lit(8).alias("admin_level"), F.lit("Ring").alias("name"), F.lit("h").alias("code"), F.lit(0.12).alias("area"), F.array(lit((44.5, 33.5), (44.9, 33.5), (44.9, 33.9), (44.5, 33.9)), lit((44.6, 33.6), (44.8, 33.6), (44.8, 33.8), (44.6, 33.8))).alias("rings"))
    return squares.unionByName(bands).unionByName(triangle).unionByName(hole)


_IN = """cover AS (
  SELECT _id, 100 + n_nationkey AS area_id, 4 AS admin_level, n_name AS aname, 'q' || n_nationkey AS code, 0.04 AS area FROM places JOIN nation
    ON lon >= 44 + (n_nationkey % 5) / 5.0::DOUBLE AND lon <= 44 + (n_nationkey % 5) / 5.0::DOUBLE + 0.2::DOUBLE
   AND lat >= 33 + (n_nationkey // 5) / 5.0::DOUBLE AND lat <= 33 + (n_nationkey // 5) / 5.0::DOUBLE + 0.2::DOUBLE
  UNION ALL SELECT _id, r_regionkey, 2, r_name, 'r' || r_regionkey, 0.2 FROM places JOIN region ON lon BETWEEN 44 AND 45 AND lat >= 33 + r_regionkey / 5.0::DOUBLE AND lat <= 33 + r_regionkey / 5.0::DOUBLE + 0.2::DOUBLE
  UNION ALL SELECT _id, 900, 8, 'Triangle', 't', 0.18 FROM places WHERE lon >= 44.1 AND lat >= 33.1 AND lon + lat <= 44.7 + 33.1
  UNION ALL SELECT _id, 901, 8, 'Ring', 'h', 0.12 FROM places WHERE lon BETWEEN 44.5 AND 44.9 AND lat BETWEEN 33.5 AND 33.9 AND NOT (lon > 44.6 AND lon < 44.8 AND lat > 33.6 AND lat < 33.8))"""


def in_polygon(spark, d):
    return spatial.point_in_polygon(base.places(spark, d), _areas(spark, d), 0.1).groupBy("area_id").agg(F.count(F.lit(1)).alias("points"), F.sum(F.substring_index("_id", ":", -1).cast("long")).alias("keys"))


def boundary_prefilter(spark, d):
    return enrich.boundaries(_areas(spark, d), (2, 4)).select("area_id", "admin_level", "name")


def admin_fold(spark, d):
    hits = spatial.point_in_polygon(base.places(spark, d), enrich.boundaries(_areas(spark, d), (2, 4, 8)), 0.1).join(F.broadcast(_areas(spark, d).drop("rings")), "area_id")
    return enrich.fold(hits, {2: ("country", "country_a"), 4: ("region", "region_a"), 8: ("locality", None)}).select("_id", "country", "country_a", "region", "region_a", "locality")


_FOLD = """fold AS (
  SELECT _id, max(aname) FILTER (admin_level = 2 AND k = 1) AS country, max(upper(code)) FILTER (admin_level = 2 AND k = 1) AS country_a, max(aname) FILTER (admin_level = 4 AND k = 1) AS region,
         max(upper(code)) FILTER (admin_level = 4 AND k = 1) AS region_a, max(aname) FILTER (admin_level = 8 AND k = 1) AS locality
  FROM (SELECT *, row_number() OVER (PARTITION BY _id, admin_level ORDER BY area, area_id) AS k FROM cover) GROUP BY _id)"""


def admin_status(spark, d):
    out = enrich.administrative(base.places(spark, d).select("_id", "lat", "lon", "country_a"), _areas(spark, d), {2: ("country", "country_a"), 4: ("region", "region_a"), 8: ("locality", None)}, 0.1)
    return out.select("_id", "country_a", "country", "region", "locality", "admin_enrichment_status", "admin_enrichment_reason")


def representative(spark, d):
    p = spatial.representative_point(F.lit("polygon"), F.col("rings"))
    return _areas(spark, d).select("area_id", p.alias("p")).select("area_id", R6("p.x").alias("x"), R6("p.y").alias("y"))


def feature_standard(spark, d):
    hits = rank.nearby(_nearest(spark, d, 5), "distance", layers=("venue",), size=5)
    return features.standard(hits).select("query_id", "rank", F.col("feature.gid").alias("gid"), F.col("feature.name").alias("name"), F.col("feature.label").alias("label"), F.col("feature.distance_meters").alias("distance_meters"))


def collections(spark, d):
    """FeatureCollections are written as text, one line for each query, and read back."""
    hits = features.standard(rank.nearby(_nearest(spark, d, 5), "distance", layers=("venue",), size=5))
    path = place(spark, "features")
    features.export(hits, path)
    told = spark.read.text(path).select(F.from_json("value", "type string, features array<struct<type:string,properties:struct<gid:string>>>").alias("c"))
    return told.select("c.type", F.size("c.features").alias("n_features"), F.col("c.features")[0]["properties"]["gid"].alias("first"))


QUERIES = {
    "j11_radius_join": (radius, base.sql(f", {_NEAR} SELECT query_id, _id, round(distance, 6) AS distance FROM near", "asks", "places")),
    "r11_nearby_distance": (nearby_distance, base.sql(f", {_NEAR} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, _id) AS INT) AS rank, _id, floor(distance * 100 + 0.5) / 100 AS distance_meters FROM near WHERE layer = 'venue' QUALIFY rank <= 10", "asks", "places")),
    "r12_nearby_relevance": (nearby_relevance, base.sql(f", {_NEAR} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY importance DESC, distance, _id) AS INT) AS rank, _id, round(importance, 6) AS score FROM near JOIN segments USING (segment) WHERE layer = 'venue' QUALIFY rank <= 10", "segments", "asks", "places")),
    "r13_nearby_hybrid": (nearby_hybrid, base.sql(f", {_NEAR}, h AS (SELECT *, importance + 2 * exp(-pow(greatest(0.0, distance - 100), 2) * ln(2) / pow(1000, 2)) AS score FROM near JOIN segments USING (segment) WHERE layer = 'venue') SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, _id) AS INT) AS rank, _id, round(score, 6) AS score FROM h QUALIFY rank <= 10", "segments", "asks", "places")),
    "r10_reverse_geocode": (reverse, base.sql(f", {_NEAR} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, _id) AS INT) AS rank, _id, round(distance, 6) AS distance FROM near WHERE distance <= 1000 QUALIFY rank <= 1", "asks", "places")),
    "j4_closest_point": (closest, base.sql(f", {_SNAP} SELECT p._id, r.road_id, r.seg, round(x1 + {_T.format(px='p.lon', py='p.lat')} * (x2 - x1), 6) AS x, round(y1 + {_T.format(px='p.lon', py='p.lat')} * (y2 - y1), 6) AS y FROM snap JOIN places p ON p._id = snap._id JOIN roads r ON r.road_id = snap.road_id", "roads", "places")),
    "j3_nearest_road": (nearest_road, base.sql(f", {_SNAP} SELECT _id, road_id, round(sx, 6) AS snap_lon, round(sy, 6) AS snap_lat, round(dist, 6) AS snap_distance FROM snap", "roads", "places")),
    "p18_routable_point": (routable, base.sql(f""", {_SNAP} SELECT p._id,
 CASE WHEN p.layer NOT IN ('venue', 'address') THEN 'not_applicable' WHEN s._id IS NOT NULL THEN 'snapped' ELSE 'centroid_fallback' END AS routable_status,
 CASE WHEN p.layer NOT IN ('venue', 'address') THEN 'layer_not_eligible' WHEN s._id IS NULL THEN 'no_road_found' END AS routable_reason,
 CASE WHEN p.layer IN ('venue', 'address') AND s._id IS NOT NULL THEN 'road' ELSE 'center' END AS routable_source,
 round(CASE WHEN p.layer IN ('venue', 'address') THEN coalesce(sx, p.lon) ELSE p.lon END, 6) AS routable_lon, round(CASE WHEN p.layer IN ('venue', 'address') THEN coalesce(sy, p.lat) ELSE p.lat END, 6) AS routable_lat,
 round(CASE WHEN p.layer IN ('venue', 'address') THEN dist END, 6) AS routable_distance FROM places p LEFT JOIN snap s ON p._id = s._id""", "roads", "places")),
    "f10_snap_eligible": (snap_eligible, base.sql("SELECT layer, count(*) FILTER (layer IN ('venue', 'address')) AS eligible, count(*) AS places FROM places GROUP BY layer", "places")),
    "a9_snap_stats": (snap_stats, base.sql(f""", {_SNAP}, r AS (SELECT CASE WHEN p.layer NOT IN ('venue', 'address') THEN 'not_applicable' WHEN s._id IS NOT NULL THEN 'snapped' ELSE 'centroid_fallback' END AS routable_status, CASE WHEN p.layer IN ('venue', 'address') THEN dist END AS dist, (p.key * 37 % 1009)::DOUBLE AS took FROM places p LEFT JOIN snap s ON p._id = s._id)
 SELECT routable_status, quantile_disc(took, 0.95) AS p95_duration, count(*) AS documents, floor(avg(dist) * 100 + 0.5) / 100 AS avg_distance, floor(max(dist) * 100 + 0.5) / 100 AS max_distance FROM r GROUP BY 1""", "roads", "places")),
    "j2_point_in_polygon": (in_polygon, base.sql(f", {_IN} SELECT area_id, count(*) AS points, sum(substr(_id, 18)::BIGINT)::BIGINT AS keys FROM cover GROUP BY 1", "places")),
    "f8_boundary_prefilter": (boundary_prefilter, "SELECT n_nationkey + 100 AS area_id, 4 AS admin_level, n_name AS name FROM nation UNION ALL SELECT r_regionkey, 2, r_name FROM region"),
    "a6_admin_fold": (admin_fold, base.sql(f", {_IN}, {_FOLD} SELECT * FROM fold", "places")),
    "g5_admin_status": (admin_status, base.sql(f""", {_IN}, {_FOLD} SELECT p._id, coalesce(p.country_a, f.country_a) AS country_a, country, f.region, f.locality,
 CASE WHEN coalesce(p.country_a, f.country_a) IS NOT NULL THEN 'enriched' ELSE 'missing_country' END AS admin_enrichment_status,
 CASE WHEN f._id IS NULL THEN 'no_covering_admin_boundary' WHEN coalesce(p.country_a, f.country_a) IS NULL THEN 'country_code_not_found' END AS admin_enrichment_reason FROM places p LEFT JOIN fold f ON p._id = f._id""", "places")),
    "p17_representative_point": (representative, "SELECT n_nationkey + 100 AS area_id, round(44 + (n_nationkey % 5) / 5.0 + 0.1, 6)::DOUBLE AS x, round(33 + (n_nationkey // 5) / 5.0 + 0.1, 6)::DOUBLE AS y FROM nation UNION ALL SELECT r_regionkey, 44.5, round(33 + r_regionkey / 5.0 + 0.1, 6)::DOUBLE FROM region UNION ALL SELECT 900, 44.25, 33.4 UNION ALL SELECT 901, 44.85, 33.7"),
    "p19_feature_standard": (feature_standard, base.sql(f", {_NEAR} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, _id) AS INT) AS rank, gid, name, name || ', ' || locality || ', ' || region AS label, floor(distance * 100 + 0.5) / 100 AS distance_meters FROM near WHERE layer = 'venue' QUALIFY rank <= 5", "asks", "places")),
    "k9_export_features": (collections, base.sql(f", {_NEAR}, r AS (SELECT query_id, gid, row_number() OVER (PARTITION BY query_id ORDER BY distance, _id) AS n FROM near WHERE layer = 'venue' QUALIFY n <= 5) SELECT 'FeatureCollection' AS type, count(*)::INT AS n_features, min_by(gid, n) AS first FROM r GROUP BY query_id", "asks", "places")),
}
