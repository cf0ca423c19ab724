"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def number(c: Column) -> Column:
    """A finite number or null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def country_code(c: Column) -> Column:
    return F.upper(F.trim(c))


def lang_code(c: Column) -> Column:
    return F.lower(F.split_part(c, F.lit("-"), F.lit(1)))


def gid(source: Column, layer: Column, id_: Column) -> Column:
    return F.concat_ws(":", F.coalesce(source, F.lit("unknown")), F.coalesce(layer, F.lit("venue")), id_)


def percent_drop(previous: Column, current: Column) -> Column:
    return F.coalesce((previous - current) / F.nullif(previous, F.lit(0)), F.lit(0.0))


def staleness(as_of: Column, last: Column) -> Column:
    return F.floor(F.unix_micros(as_of.cast("timestamp")) / 1000000 - F.unix_micros(last.cast("timestamp")) / 1000000).cast("long")


def confidence(has_category: Column, has_group: Column, has_term: Column, autocomplete: Column) -> Column:
    """How sure an intent is: category terms most, then groups, then any term."""
    return F.when(has_category, F.when(autocomplete, 0.9).otherwise(1.0)).when(has_group, 0.65).when(has_term, 0.5).otherwise(0.0)


def match_type(house: Column, street: Column, locality: Column) -> Column:
    full = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return F.when(full(house) & full(street) & full(locality), "exact_address").when(full(street), "street_only").when(full(locality), "locality_match").otherwise("partial_match")


def match_confidence(kind: Column) -> Column:
    return F.when(kind == "exact_address", 1.0).when(kind == "street_only", 0.7).when(kind == "locality_match", 0.5).otherwise(0.3)


def shortened(c: Column, most: int = 500) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def first_of(m: Column, key: str) -> Column:
    """First element of a map's array, null if there is none."""
    return F.try_element_at(F.try_element_at(m, F.lit(key)), F.lit(1))


def distinct_values(a: Column) -> Column:
    """Ordered distinct, without nulls and blanks."""
    return F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != "")))
