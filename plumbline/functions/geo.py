"""Geometry on the unit sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def unit_sphere(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon.cast("double")), F.radians(lat.cast("double"))
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def chord(p: tuple[Column, Column, Column], q: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(p[1:], q[1:])), (p[0] - q[0]) * (p[0] - q[0])))


def arc_km(chord_length: Column) -> Column:
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), chord_length / 2))


def block_id(lon: Column, lat: Column, deg: float | Column) -> Column:
    """``floor(lon/deg)_floor(lat/deg)`` on doubles (decimals would put edges elsewhere)."""
    d = F.lit(float(deg)) if isinstance(deg, (int, float)) else deg.cast("double")
    return F.concat_ws("_", F.floor(lon.cast("double") / d).cast("string"), F.floor(lat.cast("double") / d).cast("string"))
