"""Geometry on plain columns: distances, projections, grid cells, decay."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6371000.0
MERCATOR = 6378137.0


def finite(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def valid_point(lat: Column, lon: Column) -> Column:
    return finite(lat, lon) & lat.between(-90, 90) & lon.between(-180, 180)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH) -> Column:
    """Metres between two points; null if a coordinate is null or not finite."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(finite(lat1, lon1, lat2, lon2), F.lit(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a))))


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def grid_key(lon: Column, lat: Column, precision: int = 5) -> Column:
    return F.format_string(f"%.{precision}f:%.{precision}f", lon, lat)


def meters_to_units(m: Column, srid: int) -> Column:
    return m / 111000.0 if srid in (4326, 4269) else m


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * MERCATOR, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * MERCATOR


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR), F.degrees(F.atan(F.sinh(y / MERCATOR)))


def gauss(distance: Column, scale: float, offset: float = 0.0, decay: float = 0.5) -> Column:
    """1 up to `offset`, `decay` at offset + scale."""
    return F.exp(-F.pow(F.greatest(F.lit(0.0), distance - offset), 2) * math.log(1 / decay) / scale**2)


def steps(distance: Column, bounds: tuple[tuple[float, float], ...] = ((5000.0, 40.0), (25000.0, 15.0), (100000.0, 5.0))) -> Column:
    """Cumulative weights of distance rings."""
    out = F.lit(0.0)
    for bound, weight in bounds:
        out = out + F.when(distance <= bound, weight).otherwise(0.0)
    return out


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def lat_rows(radius_m: float) -> float:
    """Height in degrees of a grid row that a radius can't span twice."""
    return max(radius_m / 111000.0, 1e-4)


def lon_cells(lat: Column, radius_m: float, size: float) -> Column:
    """Cells to either side that a radius reaches at a latitude; a circle near a pole reaches all."""
    width = radius_m / (111000.0 * F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.9), F.abs(lat) + radius_m / 111000.0)))))
    return F.least(F.lit(math.ceil(360 / size)), F.ceil(width / size)).cast("long")


def z_order(lat: Column, lon: Column, bits: int = 16) -> Column:
    """A number that is near for places near each other: the bits of both coordinates in turn."""
    y = F.least(F.lit(2**bits - 1), F.floor((lat + 90) / 180 * 2**bits)).cast("long")
    x = F.least(F.lit(2**bits - 1), F.floor((lon + 180) / 360 * 2**bits)).cast("long")
    bit = lambda v, k: F.shiftleft(F.shiftright(v, k).bitwiseAND(F.lit(1).cast("long")), 2 * k)
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out + 2 * bit(y, k) + bit(x, k)
    return out
