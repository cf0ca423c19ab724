"""Enrichment of documents by place: administrative hierarchy and a point on the road network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import spatial
from .quality import percentiles

LEVELS = {2: ("country", "country_a"), 4: ("region", "region_a"), 6: ("county", None), 8: ("locality", None), 9: ("localadmin", None), 10: ("neighbourhood", None)}


def boundaries(areas: DataFrame, levels: tuple[int, ...] = tuple(LEVELS)) -> DataFrame:
    """Boundaries that have a geometry and one of the levels: filtered before any join."""
    return areas.where(F.col("rings").isNotNull() & (F.size("rings") > 0) & F.col("admin_level").isin(*levels))


def fold(hits: DataFrame, levels: dict[int, tuple[str, str | None]] = LEVELS, id_: str = "_id") -> DataFrame:
    """One row per point: for each level the name (and the code, in upper case) of the smallest covering boundary."""
    first = lambda level, c: F.min_by(F.when(F.col("admin_level") == level, F.col(c)), F.when((F.col("admin_level") == level) & F.col(c).isNotNull(), F.struct("area", "area_id")))
    out = []
    for level, (name, code) in levels.items():
        out.append(first(level, "name").alias(name))
        if code:
            out.append(F.upper(first(level, "code")).alias(code))
    return hits.groupBy(id_).agg(*out)


def administrative(docs: DataFrame, areas: DataFrame, levels: dict[int, tuple[str, str | None]] = LEVELS, size: float = 0.25, id_: str = "_id") -> DataFrame:
    """Adds the hierarchy of covering boundaries, admin_enrichment_status and _reason. Values that a document has
    already win. Points equal to five decimals are looked up once."""
    valid = geo.finite(F.col("lat"), F.col("lon"))
    key = F.when(valid, geo.grid_key(F.col("lon"), F.col("lat")))
    docs = docs.withColumn("__grid", key)
    points = docs.where(valid).groupBy("__grid").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    own = boundaries(areas, tuple(levels))
    hits = spatial.point_in_polygon(points, own, size, id_="__grid").join(own.drop("rings").hint("shuffle_hash"), "area_id")
    names = [c for pair in levels.values() for c in pair if c]
    found = fold(hits, levels, "__grid").select("__grid", *[F.col(c).alias(f"__{c}") for c in names], F.lit(True).alias("__covered"))
    out = docs.join(found.hint("shuffle_hash"), "__grid", "left")
    for c in names:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"__{c}")) if c in docs.columns else F.col(f"__{c}"))
    has_code = F.col("country_a").isNotNull() if "country_a" in out.columns else F.lit(False)
    status = F.when(has_code, "enriched").otherwise("missing_country")
    reason = F.when(F.col("__grid").isNull(), "missing_coordinates").when(F.col("__covered").isNull(), "no_covering_admin_boundary").when(~has_code, "country_code_not_found")
    out = out.withColumn("admin_enrichment_status", status).withColumn("admin_enrichment_reason", reason)
    return out.drop("__grid", "__covered", *[f"__{c}" for c in names])


def unavailable(docs: DataFrame, disabled: bool) -> DataFrame:
    """Status of documents when no lookup takes place."""
    status, reason = ("admin_enrichment_disabled", "disabled_by_config") if disabled else ("missing_country", "boundary_source_not_configured")
    return docs.withColumn("admin_enrichment_status", F.lit(status)).withColumn("admin_enrichment_reason", F.lit(reason))


def snap_eligible(layer: Column, lat: Column, lon: Column, layers: tuple[str, ...] = ("venue", "address"), admin: tuple[str, ...] = ()) -> Column:
    return geo.finite(lat, lon) & layer.isin(*layers, *admin)


def routable(docs: DataFrame, snapped: DataFrame | None, layers: tuple[str, ...] = ("venue", "address"), fallback_to_center: bool = True, id_: str = "_id") -> DataFrame:
    """Adds routable_lon, _lat, _distance, _status, _reason, _source from a table of snaps (None: no road source)."""
    if snapped is None:
        out = docs.withColumns({c: F.lit(None).cast("double") for c in ("snap_lon", "snap_lat", "snap_distance")})
        missing = "roads_source_not_configured"
    else:
        out, missing = docs.join(snapped.select(id_, "snap_lon", "snap_lat", "snap_distance").hint("shuffle_hash"), id_, "left"), "no_road_found"
    eligible = snap_eligible(F.col("layer"), F.col("lat"), F.col("lon"), layers)
    hit = eligible & F.col("snap_lon").isNotNull()
    center = lambda c: F.when(hit, F.col(f"snap_{c}")).when(F.lit(fallback_to_center) | ~eligible, F.col(c))
    out = out.withColumns({
        "routable_status": F.when(~eligible, "not_applicable").when(hit, "snapped").otherwise("centroid_fallback" if fallback_to_center else missing),
        "routable_reason": F.when(~eligible, "layer_not_eligible").when(~hit, missing),
        "routable_source": F.when(hit, "road").otherwise("center"),
        "routable_lon": center("lon"),
        "routable_lat": center("lat"),
        "routable_distance": F.when(hit, F.col("snap_distance")),
    })
    return out.drop("snap_lon", "snap_lat", "snap_distance")


def snap_stats(docs: DataFrame, duration: str | None = None) -> DataFrame:
    """Documents, mean and largest distance by status; with a column of lookup durations also their 95th percentile
    by nearest rank."""
    out = docs.groupBy("routable_status").agg(F.count(F.lit(1)).alias("documents"), geo.round2(F.avg("routable_distance")).alias("avg_distance"), geo.round2(F.max("routable_distance")).alias("max_distance"))
    if duration is None:
        return out
    found = percentiles(docs, ["routable_status"], duration, {"p95_duration": 0.95}).withColumnRenamed("routable_status", "status")
    return out.join(found.hint("merge"), F.col("routable_status").eqNullSafe(F.col("status")), "left").drop("status")
