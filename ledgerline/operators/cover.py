"""Covers of polygons by square cells of several sizes, and points that meet polygons by equality of cells.

A polygon starts with the cells of one size around its box, at most four. A cell is quartered, its edges with it, until it needs few of them. Of the edges
of a cell's rings, those beside its range of y or left of it have no say for a point in it, and those right of it over its whole range of y always
flip the ring's parity: that is settled once for the cell. The others are kept with it. Where none of them touches the cell, the parity is the same in all of
it, so that the cell is `inside` and needs no edges, or is dropped. What is left are `border` cells, which carry their few edges alone; shells and holes go
through no shuffle: a polygon is quartered where it is read, on arrays of its edges.

Points outside the box of all shapes are dropped first. The rest meet the cover by equality of (level, x, y, salt), in the levels that the cover has; the salt
comes from the point's hash, so that the points of a crowded cell are dealt to SALTS tasks. In an inside cell a point needs no test, in a border cell it
is tried against the cell's edges by the very comparison that `geo.in_ring` makes, so that the result is the same as of trying all edges. That part
is columns alone.

A point on an edge is inside by the half-open even-odd rule. Rings that aren't closed are read as they are, within the box of the shell. Shapes without a shell, and points with
a NULL coordinate, give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cell of level n has sides of ROOT / 2 ** n degrees: powers of two, so that a point's cell is found without rounding.
ROOT = 8.0
#: A border cell with more edges than this is quartered, at most DEPTH times from where the polygon starts.
EDGES = 16
DEPTH = 8
SALTS = 4


def _edges(rings: list) -> np.ndarray:
    """ring, closed, x1, y1, x2, y2 of all edges that aren't level; level ones flip nothing."""
    found = []
    for i, ring in enumerate(rings):
        at = np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2)
        if len(at) > 1:
            n = len(at) - 1
            found.append(np.column_stack([np.full(n, i), np.full(n, (at[0] == at[-1]).all()), at[:-1], at[1:]]))
    all_ = np.concatenate(found) if found else np.zeros((0, 6))
    return all_[all_[:, 3] != all_[:, 5]]


def cells_of(shell: list, holes: list, edges: int = EDGES, depth: int = DEPTH) -> Iterator[tuple[int, int, int, np.ndarray, list[int]]]:
    """(level, cx, cy, edges that matter, rings whose parity is odd but for them) of one polygon; without edges the cell is inside."""
    corners = np.array([(p["x"], p["y"]) for p in shell], float)
    low, high = corners.min(axis=0), corners.max(axis=0)
    side = (high - low).max()
    first = min(30, math.floor(math.log2(ROOT / side))) if side > 0 else 30
    scale = 2.0**first / ROOT
    all_ = _edges([shell, *holes])
    stack = [(first, x, y, all_, frozenset()) for x in range(math.floor(low[0] * scale), math.floor(high[0] * scale) + 1) for y in range(math.floor(low[1] * scale), math.floor(high[1] * scale) + 1)]
    while stack:
        level, cx, cy, near, odd = stack.pop()
        size = ROOT / 2.0**level
        x0, y0, x1, y1 = cx * size, cy * size, (cx + 1) * size, (cy + 1) * size
        top, bottom = np.maximum(near[:, 3], near[:, 5]), np.minimum(near[:, 3], near[:, 5])
        # A little slack covers the rounding of the place where an edge is crossed.
        slack = 1e-9 * (1 + np.abs(near[:, 2]) + np.abs(near[:, 4]))
        right = np.minimum(near[:, 2], near[:, 4]) - slack > x1
        say = (top >= y0) & (bottom <= y1) & (np.maximum(near[:, 2], near[:, 4]) + slack >= x0)
        whole = say & right & (bottom <= y0) & (top >= y1)
        flips, rest = near[whole, 0], say & ~whole
        if (right[rest] & (near[rest, 1] > 0)).all():
            # No edge touches the cell: the parity at any height is that of the whole cell.
            middle = (y0 + y1) / 2
            cross = rest & ((near[:, 3] > middle) != (near[:, 5] > middle))
            flips, rest = np.concatenate([flips, near[cross, 0]]), np.zeros(len(near), bool)
        near = near[rest]
        for k, n in zip(*np.unique(flips, return_counts=True), strict=True):
            if n % 2:
                odd = odd ^ {int(k)}
        open_ = set(near[:, 0].astype(int).tolist())
        if (0 not in open_ and 0 not in odd) or any(k and k not in open_ for k in odd):
            continue  # outside the shell, or inside a hole, wherever in the cell
        if len(near) > edges and level < first + depth:
            stack += [(level + 1, 2 * cx + i, 2 * cy + j, near, odd) for i in (0, 1) for j in (0, 1)]
        else:
            yield level, cx, cy, near, sorted(odd)


def cover(shapes: DataFrame, area: str, edges: int = EDGES, depth: int = DEPTH) -> DataFrame:
    """area, level, cx, cy, inside, near, odd: the cells of `shapes` (area, shell, holes)."""

    kind = shapes.schema[area].dataType.simpleString()
    near = pa.list_(pa.struct([("ring", pa.int32()), *[(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")]]))

    def covered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                found = list(cells_of(batch.column("shell")[i].as_py(), batch.column("holes")[i].as_py() or [], edges, depth))
                lists = [[{"ring": int(e[0]), "x1": e[2], "y1": e[3], "x2": e[4], "y2": e[5]} for e in cell[3].tolist()] for cell in found]
                numbers = [pa.array([c[k] for c in found], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
                own = batch.column("area").take(pa.array([i] * len(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([own, *numbers, pa.array([not e for e in lists], pa.bool_()), pa.array(lists, near), pa.array([c[4] for c in found], pa.list_(pa.int32()))], ["area", "level", "cx", "cy", "inside", "near", "odd"])

    rows = shapes.filter("size(shell) > 0").select(F.col(area).alias("area"), "shell", "holes")
    return rows.mapInArrow(covered, f"area {kind}, level int, cx long, cy long, inside boolean, near array<struct<ring: int, x1: double, y1: double, x2: double, y2: double>>, odd array<int>")


def _inside(x: str, y: str) -> Column:
    """Whether the point is in the shell and in no hole, by the cell's edges and the parities that are settled."""
    flips = f"size(filter(near, e -> e.ring = k and (e.y1 > {y}) != (e.y2 > {y}) and {x} < (e.x2 - e.x1) * ({y} - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1)) % 2 = 1"
    rings = "array_distinct(concat(array(0), odd, transform(near, e -> e.ring)))"
    return F.expr(f"inside or forall({rings}, k -> (array_contains(odd, k) != ({flips})) = (k = 0))")


def points_in(points: DataFrame, shapes: DataFrame, point: str, area: str, lon: str = "lon", lat: str = "lat", salts: int = SALTS) -> DataFrame:
    """point, area (the smallest one) of the points that lie in a polygon and none of its holes."""
    cells = cover(shapes, area)
    # One number for each size of polygon, and four for the box of all.
    found = cells.agg(F.sort_array(F.collect_set("level")), *[f(F.expr(f"{c} * {ROOT}D * pow(2.0D, -level)")) for f, c in ((F.min, "cx"), (F.min, "cy"), (F.max, "(cx + 1)"), (F.max, "(cy + 1)"))]).first()
    levels, box = found[0], found[1:]
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    near = points.select(point, x.alias("_x"), y.alias("_y")).filter(F.col("_x").between(box[0], box[2]) & F.col("_y").between(box[1], box[3]) if levels else F.lit(False))
    near = near.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels]) if levels else F.array().cast("array<int>"))).withColumn("_scale", F.pow(F.lit(2.0), F.col("level").cast("double")) / ROOT)
    near = near.select(point, "_x", "_y", "level", F.floor(F.col("_x") * F.col("_scale")).alias("cx"), F.floor(F.col("_y") * F.col("_scale")).alias("cy"), F.pmod(F.xxhash64(point), F.lit(salts)).alias("_salt"))
    dealt = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    met = near.join(dealt, ["level", "cx", "cy", "_salt"]).filter(_inside("_x", "_y"))
    return met.groupBy(point).agg(F.min("area").alias(area))
