"""Source rows to place documents, all as column expressions of one projection each."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, scalars
from ..sources.spec import SourceSpec
from .features import joined

KURDISH_FIELDS = ("name_ku", "name:ku", "name_ckb", "name:ckb")
PROMOTED = ("country", "country_a", "region", "region_a", "county", "locality", "localadmin", "neighbourhood")
ADMIN_LAYERS = ("country", "region", "county", "locality", "localadmin", "neighbourhood")
_MAP = "map<string,string>"


def _text(df: DataFrame, name: str) -> Column:
    return scalars.blank_to_null(F.col(f"`{name}`").cast("string")) if name in df.columns else F.lit(None).cast("string")


def _map(pairs: dict[str, Column], kind: str = _MAP) -> Column:
    """A map of the entries whose values are there."""
    if not pairs:
        return F.create_map().cast(kind)
    return F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull()).cast(kind)


def names(df: DataFrame, fields: tuple[str, ...]) -> Column:
    """default from the first field alone; a language for each field that ends in one; the first value wins."""
    pairs = {"default": [_text(df, fields[0])]}
    for f in fields:
        code = re.search(r"(?:^|_)([a-z]{2,3})$", f)
        if code:
            pairs.setdefault(code[1], []).append(_text(df, f))
    for f in KURDISH_FIELDS:
        pairs.setdefault("ku", []).append(_text(df, f))
    return _map({k: F.coalesce(*v) for k, v in pairs.items()})


def layer(df: DataFrame, spec: SourceSpec) -> Column:
    if not spec.layer_field or not spec.layer_map:
        return F.lit(spec.layer)
    table = F.create_map(*[F.lit(x) for kv in spec.layer_map.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(spec.layer_field).cast("string")), F.lit(spec.layer))


def tags(df: DataFrame, spec: SourceSpec) -> Column:
    return _map({f: _text(df, f) for f in spec.category_fields})


def address_parts(df: DataFrame, spec: SourceSpec) -> Column:
    return _map({to: _text(df, f) for to, f in spec.address_fields.items()})


def parents(df: DataFrame, spec: SourceSpec) -> Column:
    """Hierarchy as arrays; a document of an administrative layer is its own parent there, if it has none."""
    pairs = {to: _text(df, f) for to, f in spec.hierarchy_fields.items()}
    return F.transform_values(_map(pairs), lambda _, v: F.array(v))


def self_hierarchy(parent: Column, layer: Column, name: Column) -> Column:
    own = layer.isin(*ADMIN_LAYERS) & name.isNotNull() & ~F.coalesce(F.map_contains_key(parent, layer), F.lit(False))
    return F.when(own, F.map_concat(parent, F.create_map(layer, F.array(name)))).otherwise(parent)


def addendum(df: DataFrame, spec: SourceSpec) -> Column:
    raw = lambda f: F.when(F.trim(F.col(f).cast("string")) != "", F.col(f).cast("string"))
    return _map({f: raw(f) for f in spec.addendum_fields if f in df.columns})


def problem(id_: Column, lat: Column, lon: Column, name: Column) -> Column:
    """Why a row can't be a document, null if it can."""
    return F.when(F.coalesce(F.trim(id_) == "", F.lit(True)), "missing_id").when(~geo.finite(lat, lon), "invalid_coordinates").when(name.isNull(), "missing_name")


def documents(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """Domain documents of a source, with `error` set for rows that can't be one."""
    record = F.col(spec.id_field).cast("string")
    out = df.select(
        F.concat_ws(":", F.lit("postgis"), F.lit(spec.name), record).alias("_id"), record.alias("source_id"), F.lit(spec.name).alias("source_config"), F.lit(spec.source_label).alias("source"),
        layer(df, spec).alias("layer"), names(df, spec.name_fields).alias("name"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"),
        tags(df, spec).alias("source_tags"), address_parts(df, spec).alias("address_parts"), parents(df, spec).alias("parent"),
        (scalars.number(F.col(spec.popularity_field).cast("string")) if spec.popularity_field else F.lit(None).cast("double")).alias("popularity"), addendum(df, spec).alias("addendum"),
    )
    default = F.try_element_at("name", F.lit("default"))
    out = out.withColumn("parent", self_hierarchy(F.col("parent"), F.col("layer"), default))
    return out.withColumn("error", problem(F.col("source_id"), F.col("lat"), F.col("lon"), default))


def split(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good documents, and the rows to put in quarantine."""
    return docs.where("error is null").drop("error"), docs.where("error is not null")


def quarantine(bad: DataFrame, most: int = 20) -> DataFrame:
    """stage, id, error, row of the first bad rows of each source, in the order of their ids."""
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("source_config").orderBy(F.col("source_id").asc_nulls_first(), "error"))
    kept = bad.withColumn("nth", nth).where(F.col("nth") <= most)
    return kept.select("source_config", F.lit("transform").alias("stage"), F.col("source_id").alias("id"), "error", scalars.shortened(F.to_json(F.struct("_id", "layer", "name"))).alias("row"))


def normalized_categories(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")), lambda c: c.isNotNull() & (c != "")))


def normalized_address(parts: Column) -> Column:
    return F.map_filter(F.transform_values(parts, lambda _, v: F.trim(v)), lambda _, v: v.isNotNull() & (v != ""))


def normalized_parent(parent: Column) -> Column:
    clean = lambda a: F.array_distinct(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return F.map_filter(F.transform_values(parent, lambda _, v: clean(v)), lambda _, v: F.size(v) > 0)


def promoted(parent: Column) -> dict[str, Column]:
    return {level: scalars.first_of(parent, level) for level in PROMOTED}


def label(name: Column, neighbourhood: Column, locality: Column, region: Column, country: Column) -> Column:
    return joined(name, neighbourhood, locality, region, country)


def index_documents(docs: DataFrame) -> DataFrame:
    """The documents that are searched: promoted hierarchy, label, gid, fallback categories, addendum as JSON."""
    out = docs.withColumn("address_parts", normalized_address(F.col("address_parts"))).withColumn("parent", normalized_parent(F.col("parent")))
    out = out.withColumns(promoted(F.col("parent")))
    default = F.coalesce(F.try_element_at("name", F.lit("default")), F.try_element_at(F.map_values("name"), F.lit(1)))
    raw = F.map_values("source_tags")
    ids = normalized_categories(F.concat(F.coalesce("category_ids", F.array().cast("array<string>")), raw) if "category_ids" in docs.columns else raw)
    center = F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lon"))
    return out.withColumns({
        "gid": scalars.gid(F.col("source"), F.col("layer"), F.col("source_id")),
        "phrase": F.col("name"),
        "label": label(default, F.col("neighbourhood"), F.col("locality"), F.col("region"), F.col("country")),
        "category": ids,
        "category_ids": ids,
        "center_point": center,
        "addendum": F.struct(F.to_json("addendum").alias("postgis")),
    })


def union(*sources: DataFrame) -> DataFrame:
    """All sources' documents as one table; columns that one lacks are null there."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
