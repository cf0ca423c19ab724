"""Sources: a declared SELECT and the mapping of its columns; readers for JDBC and for registered views."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags that make a point a place of interest, and the kinds of streets and places that are read.
POI_KEYS = ("amenity", "shop", "tourism", "leisure", "office")
HIGHWAYS = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service", "living_street", "pedestrian")
PLACES = ("city", "town", "village", "suburb", "neighbourhood", "hamlet")
ADMIN_COLUMNS = {"2": "country", "4": "region", "6": "county", "8": "locality", "9": "localadmin", "10": "neighbourhood"}


@dataclass(frozen=True)
class SourceSpec:
    """One source: which column is what. `sql` is a SELECT over the source's tables."""

    name: str
    layer: str
    id_field: str
    sql: str = ""
    source_label: str = "osm"
    name_fields: tuple[str, ...] = ("name",)
    category_fields: tuple[str, ...] = ()
    address_fields: dict[str, str] = field(default_factory=dict)
    hierarchy_fields: dict[str, str] = field(default_factory=dict)
    addendum_fields: tuple[str, ...] = ()
    popularity_field: str | None = None
    layer_field: str | None = None
    layer_map: dict[str, str] = field(default_factory=dict)
    test_limit: int | None = None
    max_drop_ratio: float | None = None
    max_failed_ratio: float | None = None
    allow_count_drop: bool = False
    stale_after_seconds: int | None = None


def scan(spark: SparkSession, spec: SourceSpec, limit: int | None = None, geometry: tuple[str, str] | None = ("lon", "lat")) -> DataFrame:
    """The rows of a source with _lon and _lat; rows without geometry are left out. spec.sql is run by Spark."""
    return located(spark.sql(spec.sql), geometry, limit if limit is not None else spec.test_limit)


def located(rows: DataFrame, geometry: tuple[str, str] | None, limit: int | None = None) -> DataFrame:
    if geometry:
        lon, lat = geometry
        rows = rows.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumn("_lon", F.col(lon).cast("double")).withColumn("_lat", F.col(lat).cast("double"))
    if limit is not None:
        if limit < 0:
            raise ValueError("a limit is a whole number, 0 at least")
        rows = rows.limit(limit)
    return rows


def scan_jdbc(spark: SparkSession, spec: SourceSpec, url: str, partition: tuple[str, int, int, int] | None = None, fetch: int = 10_000, limit: int | None = None, geometry: tuple[str, str] | None = ("lon", "lat"), **options: str) -> DataFrame:
    """The same over JDBC: the whole SELECT is pushed into the database, and so are the geometry's null tests, later
    filters and a limit; `partition` is (column, low, high, tasks)."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({spec.sql}) q", fetchsize=str(fetch), **options)
    if partition:
        column, low, high, tasks = partition
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(tasks))
    return located(reader.load(), geometry, limit if limit is not None else spec.test_limit)


def lookup(spark: SparkSession, sql: str, **parameters) -> DataFrame:
    """A parameterised read-only query: parameters are bound, never pasted."""
    return spark.sql(sql, args=parameters)


def tag(name: str, tags: str = "tags") -> Column:
    return F.try_element_at(F.col(tags), F.lit(name))


def _named() -> Column:
    return F.col("name").isNotNull() & (F.col("name") != "")


def pois(points: DataFrame) -> DataFrame:
    """Named points with any of the tags of a place of interest."""
    some = F.lit(False)
    for k in POI_KEYS:
        some = some | F.col(k).isNotNull()
    return points.where(_named() & some)


def streets(lines: DataFrame) -> DataFrame:
    return lines.where(_named() & F.col("highway").isin(*HIGHWAYS))


def settlements(points: DataFrame) -> DataFrame:
    return points.where(_named() & F.col("place").isin(*PLACES))


def admin_boundaries(polygons: DataFrame) -> DataFrame:
    """Named administrative areas; the name stands in the column of its level, codes of countries and regions too."""
    rows = polygons.where(_named() & (F.col("boundary") == "administrative") & F.col("admin_level").isin(*ADMIN_COLUMNS))
    for level, column in ADMIN_COLUMNS.items():
        rows = rows.withColumn(column, F.when(F.col("admin_level") == level, F.col("name")))
    return rows.withColumn("country_a", F.when(F.col("admin_level") == "2", tag("ISO3166-1:alpha2"))).withColumn("region_a", F.when(F.col("admin_level") == "4", tag("ISO3166-2")))


def addresses(points: DataFrame) -> DataFrame:
    """Points with a house number; the name is the house's name, else its number."""
    number = tag("addr:housenumber")
    rows = points.where(F.coalesce(number != "", F.lit(False)))
    return rows.withColumns({"name": F.coalesce(tag("addr:housename"), number), "housenumber": number, "street": tag("addr:street"), "postalcode": tag("addr:postcode"), "locality": tag("addr:city")})
