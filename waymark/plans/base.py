"""Tables of places, roads, boundaries and requests, derived from the star schema by integer arithmetic; and the
same derivations as SQL, so that each operator can be compared on equal inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lon(key: Column) -> Column:
    return 44 + (key.cast("long") * 7919 % 10007) / F.lit(10007.0)


def lat(key: Column) -> Column:
    return 33 + (key.cast("long") * 104729 % 10009) / F.lit(10009.0)


SQL_LON = "44 + (({0})::BIGINT * 7919 % 10007) / 10007.0::DOUBLE"
SQL_LAT = "33 + (({0})::BIGINT * 104729 % 10009) / 10009.0::DOUBLE"

# A taxonomy for the market segments and part types of the star schema.
SEGMENTS = (("AUTOMOBILE", "car_shop", "transport", 0.7), ("BUILDING", "hardware", "shopping", 0.5), ("FURNITURE", "furniture", "shopping", 0.6), ("MACHINERY", "machinery", "industry", 0.4), ("HOUSEHOLD", "household", "shopping", 0.8))


def segments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEGMENTS, "segment string, category string, intent_group string, importance double")


SQL = {
    "segments": "segments(segment, category, intent_group, importance) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in SEGMENTS) + ")",
    "places": f"""places AS (
  SELECT 'postgis:customer:' || c_custkey AS _id, 'osm:venue:' || c_custkey AS gid, c_custkey AS key, c_custkey::VARCHAR AS source_id, 'customer' AS source_config,
         'osm' AS source, CASE c_custkey % 5 WHEN 0 THEN 'street' WHEN 1 THEN 'address' ELSE 'venue' END AS layer, c_name AS name, c_mktsegment AS segment,
         {SQL_LON.format('c_custkey')} AS lon, {SQL_LAT.format('c_custkey')} AS lat,
         n_name AS locality, r_name AS region, CASE WHEN c_custkey % 11 <> 0 THEN 'R' || n_regionkey END AS country_a, c_acctbal AS popularity
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "asks": f"""asks AS (
  SELECT s_suppkey AS query_id, {SQL_LON.format('s_suppkey * 31 + 7')} AS q_lon, {SQL_LAT.format('s_suppkey * 31 + 7')} AS q_lat, 3000.0::DOUBLE AS radius FROM supplier)""",
    "roads": f"""roads AS (
  SELECT p_partkey AS road_id, seg, CASE seg WHEN 0 THEN x ELSE x + 0.004 END AS x1, CASE seg WHEN 0 THEN y ELSE y + 0.002 END AS y1,
         CASE seg WHEN 0 THEN x + 0.004 ELSE x + 0.006 END AS x2, CASE seg WHEN 0 THEN y + 0.002 ELSE y - 0.001 END AS y2
  FROM (SELECT p_partkey, {SQL_LON.format('p_partkey * 13')} AS x, {SQL_LAT.format('p_partkey * 13')} AS y FROM part), (VALUES (0), (1)) AS s(seg))""",
    "requests": """requests AS (
  SELECT event_id, ts, event_type AS endpoint, user_id, value AS latency_ms, CASE WHEN value IS NULL THEN NULL WHEN (props->>'$.k')::INT % 10 = 0 THEN 500 WHEN (props->>'$.k')::INT % 10 = 1 THEN 404 ELSE 200 END AS status,
         (props->>'$.k')::INT AS k FROM events)""",
}


def sql(body: str, *names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + body


def sql_haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(12742000.0::DOUBLE * atan2(sqrt({a}), sqrt(greatest(0.0, 1 - {a}))))"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        F.concat(F.lit("postgis:customer:"), key).alias("_id"), F.concat(F.lit("osm:venue:"), key).alias("gid"), key.alias("key"), key.cast("string").alias("source_id"),
        F.lit("customer").alias("source_config"), F.lit("osm").alias("source"),
        F.when(key % 5 == 0, "street").when(key % 5 == 1, "address").otherwise("venue").alias("layer"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), lon(key).alias("lon"), lat(key).alias("lat"),
        F.col("n_name").alias("locality"), F.col("r_name").alias("region"), F.when(key % 11 != 0, F.concat(F.lit("R"), F.col("n_regionkey"))).alias("country_a"), F.col("c_acctbal").alias("popularity"),
    )


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey") * 31 + 7
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), lon(key).alias("q_lon"), lat(key).alias("q_lat"), F.lit(3000.0).alias("radius"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """road_id and its vertices in order."""
    key = F.col("p_partkey") * 13
    x, y = lon(key), lat(key)
    point = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("road_id"), F.array(point(0, 0), point(0.004, 0.002), point(0.006, -0.001)).alias("line"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("value").isNull(), None).when(k % 10 == 0, 500).when(k % 10 == 1, 404).otherwise(200)
    return read(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("endpoint"), "user_id", F.col("value").alias("latency_ms"), status.alias("status"), k.alias("k"))
