"""Polygons from GeoJSON geometry, points within them, and checks of built shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import geo
from ledgerline.operators.cover import points_in


def polygons(features: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """keys, part, shell, holes (closed rings of struct<x, y>) of each polygon in a GeoJSON geometry column; other kinds of geometry give no rows."""
    kind, text = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    one = F.from_json(text, "array<array<array<double>>>")
    many = F.from_json(text, "array<array<array<array<double>>>>")
    parts = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)
    rings = F.transform("_part", lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    rows = features.select(*keys, F.posexplode(parts).alias("part", "_part")).withColumn("_rings", rings)
    return rows.select(*keys, "part", F.get("_rings", F.lit(0)).alias("shell"), F.expr("slice(_rings, 2, greatest(size(_rings) - 1, 0))").alias("holes"))


def area_km2(shapes: DataFrame, keys: list[str], latitude: Column) -> DataFrame:
    """keys, km2: the areas of all polygons of a key, without their holes."""
    rows = shapes.withColumn("_lat", latitude)
    ring = lambda r: f"abs(aggregate(zip_with(slice({r}, 1, size({r}) - 1), slice({r}, 2, size({r}) - 1), (i, j) -> i.x * j.y - j.x * i.y), 0d, (n, t) -> n + t)) / 2"
    hollow = "aggregate(holes, 0d, (m, r) -> m + " + ring("r") + ")"
    scale = f"{geo.KM_PER_DEGREE} * {geo.KM_PER_DEGREE} * cos(radians(_lat))"
    return rows.groupBy(*keys).agg(F.sum(F.expr(f"({ring('shell')} - {hollow}) * {scale}")).alias("km2"))


def shape_errors(features: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """keys, part, problem: features whose geometry is missing, unreadable or no polygon (part NULL), and shells or holes that are empty, have fewer than four points, lack a coordinate or aren't closed."""
    kind = F.when(F.col(geometry).isNotNull(), F.try_variant_get(F.try_parse_json(geometry), "$.type", "string"))
    none = F.when(F.col(geometry).isNull(), "missing").when(kind.isNull(), "unreadable").when(~kind.isin("Polygon", "MultiPolygon"), "no polygon")
    parts = polygons(features, keys, geometry)
    rings = F.inline(F.transform(F.concat(F.array("shell"), "holes"), lambda r: F.struct(r.alias("_r"))))
    each = parts.select(*keys, "part", rings)
    ends = F.get("_r", F.lit(0)) != F.get("_r", F.size("_r") - 1)
    gap = F.exists("_r", lambda p: p["x"].isNull() | p["y"].isNull())
    problem = F.when(F.coalesce(F.size("_r"), F.lit(0)) <= 0, "empty").when(gap, "a coordinate is missing").when(F.size("_r") < 4, "too few points").when(ends, "not closed")
    found = each.withColumn("problem", problem).filter("problem is not null").select(*keys, F.col("part").cast("int").alias("part"), "problem").distinct()
    whole = features.withColumn("problem", none).filter("problem is not null").select(*keys, F.lit(None).cast("int").alias("part"), "problem")
    bare = features.filter(none.isNull()).select(*keys).join(parts.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(None).cast("int").alias("part"), F.lit("empty").alias("problem"))
    return whole.union(bare).union(found)


def feature_set_errors(features: DataFrame, expected: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """keys, side: keys without a feature (missing), features beyond the expected keys (beyond), and keys with several (repeated)."""
    have = features.groupBy(*keys).agg(F.count("*").alias("_n"))
    wanted = expected.select(*keys).distinct()
    lost, more = wanted.join(have, keys, "left_anti").select(*keys, F.lit("missing").alias("side")), have.join(wanted, keys, "left_anti").select(*keys, F.lit("beyond").alias("side"))
    return lost.union(more).union(have.filter("_n > 1").select(*keys, F.lit("repeated").alias("side")))


def area_changes(before: DataFrame, after: DataFrame, key: str, tolerance: float) -> DataFrame:
    """key, before, after: areas (key, km2) that differ by more than a share of the first, or stand on one side alone; the total has a NULL key."""
    both = before.select(key, F.col("km2").alias("before")).join(after.select(key, F.col("km2").alias("after")), key, "full")
    total = both.agg(F.lit(None).cast(before.schema[key].dataType).alias(key), F.sum("before").alias("before"), F.sum("after").alias("after"))
    off = F.coalesce(F.abs(F.col("after") - F.col("before")) > F.col("before") * tolerance, F.lit(True))
    return both.union(total).filter(off)


def registered_points(rows: DataFrame, shapes: DataFrame, point: str, area: str, kind: str, dropped: list[str], name: Column) -> DataFrame:
    """A point register's rows without the `dropped` kinds (a NULL kind is none of them), with their normal `name` and the area they lie in (NULL: outside every polygon)."""
    kept = rows.filter(F.coalesce(~F.col(kind).isin(dropped), F.lit(True))).withColumn("name", name)
    return kept.join(points_in(kept, shapes, point, area), point, "left")


def kinds(registers: dict[str, DataFrame], usable: Column) -> DataFrame:
    """kind, n, usable of several registers with the same columns, stacked."""
    stacked = None
    for kind, rows in registers.items():
        one = rows.withColumn("kind", F.lit(kind))
        stacked = one if stacked is None else stacked.unionByName(one, allowMissingColumns=True)
    return stacked.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(usable).alias("usable"))
