"""Distances, polygons and grid cells as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
KM_PER_DEGREE = 111.32
CELL = 0.5


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def cell(value: Column) -> Column:
    return F.floor(value / CELL)


def in_ring(x: str, y: str, ring: str) -> Column:
    """Even-odd rule over a closed ring (array<struct<x, y>>): a half-open edge to the right of the point flips it."""
    edges = f"zip_with(slice({ring}, 1, size({ring}) - 1), slice({ring}, 2, size({ring}) - 1), (i, j) -> (i.y > {y}) != (j.y > {y}) and {x} < (j.x - i.x) * ({y} - i.y) / nullif(j.y - i.y, 0) + i.x)"
    return F.expr(f"size(filter({edges}, e -> e)) % 2 = 1")


def bbox(rings: str) -> Column:
    """struct<x0, y0, x1, y1> around an array of rings; NULL where there is no point."""
    points = f"flatten({rings})"
    edge = lambda f, axis: F.expr(f"array_{f}(transform({points}, p -> p.{axis}))")
    return F.when(F.expr(f"size({points}) > 0"), F.struct(edge("min", "x").alias("x0"), edge("min", "y").alias("y0"), edge("max", "x").alias("x1"), edge("max", "y").alias("y1")))
