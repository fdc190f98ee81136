"""Rules at their edges, and points in polygons with covers of several cell sizes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import codes
from ledgerline.operators import cover, quality, relational, spatial
from ledgerline.sources import blocks, layout


def test_numbers_have_no_letters(spark):
    texts = ["7", "-1.5", "1e3", ".5", "3.", "1d", "7f", "0x10", "NaN", "Infinity", "1e", "", None, " 8 ", "１"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.orderBy("i").select(codes.number(F.col("t")).alias("n"), codes.cell_status(F.col("t")).alias("s"), codes.integral(F.col("t")).alias("w")).collect()
    assert [r["n"] for r in got] == [7.0, -1.5, 1000.0, 0.5, 3.0, *[None] * 8, 8.0, None]
    assert [r["s"] for r in got][5:8] == ["error"] * 3 and got[5]["w"] is None and got[2]["w"] == 1000
    assert sorted(r["i"] for r in quality.not_number("t")(rows).collect()) == [5, 6, 7, 8, 9, 10, 11, 12, 14]
    doubles = spark.createDataFrame([(1, 1e10), (2, 1e-7), (3, math.nan), (4, math.inf), (5, None)], "i int, t double")
    assert sorted(r["i"] for r in quality.not_number("t")(doubles).collect()) == [3, 4, 5]


def test_null_figures_break_rules(spark):
    rows = spark.createDataFrame([(1, 5.0, 5.0), (2, None, 5.0), (3, 5.0, None), (4, 9.0, 5.0)], "k int, a double, b double")
    keys = lambda rule: sorted(r["k"] for r in rule(rows).collect())
    assert keys(quality.outside("a", 0, 6)) == [2, 4] and keys(quality.outside("a", 0, 6, null_ok=True)) == [4]
    assert keys(quality.off_tolerance("a", "b", 0.1)) == [2, 3, 4] and keys(quality.off_tolerance("a", "b", 0.1, null_ok=True)) == [4]
    assert keys(quality.parts_beyond("a", ["b"])) == [2, 4] and keys(quality.parts_beyond("a", ["b"], null_ok=True)) == [4]


def test_totals_of_bands(spark):
    cells = [(1, [0.3, 0.1, 0.2]), (2, [0.3, 0.1, 0.3]), (3, [None, 1, 2]), (4, [9, 1, None]), (5, [0.5, 1, None]), (6, [1e20, 1e20, 1])]
    rows = spark.createDataFrame([("s", r, "b", i, None if v is None else str(v)) for r, vs in cells for i, v in enumerate(vs)], "sheet string, row int, band string, place int, value string")
    assert sorted(r["row"] for r in blocks.band_totals(rows, 0).collect()) == [2, 3, 5]


def test_kinds_that_are_null_stay(spark):
    shapes = spatial.polygons(spark.createDataFrame([(1, '{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]]]}')], "area int, geometry string"), ["area"])
    rows = spark.createDataFrame([(1, None, 1.0, 1.0), (2, "dental", 1.0, 1.0), (3, "other", 9.0, 1.0)], "p int, kind string, lon double, lat double")
    got = spatial.registered_points(rows, shapes, "p", "area", "kind", ["dental"], F.lit("-")).collect()
    assert {(r["p"], r["area"]) for r in got} == {(1, 1), (3, None)}


def test_shapes_of_every_kind(spark):
    rows = [
        (1, None), (2, "{"), (3, '{"type":"Point","coordinates":[1,2]}'), (4, '{"type":"Polygon","coordinates":[]}'), (5, '{"type":"Polygon","coordinates":[[]]}'), (6, '{"type":"MultiPolygon","coordinates":[]}'),
        (7, '{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,0]]]}'), (8, '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}'), (9, '{"type":"Polygon","coordinates":[[[0,0],[1,null],[1,1],[0,0]]]}'),
        (10, '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]],[[0,0],[1,0],[1,1],[0,1]]]}'), (11, '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'), (12, '{"coordinates":[]}'),
    ]
    got = spatial.shape_errors(spark.createDataFrame(rows, "k int, geometry string"), ["k"]).collect()
    assert sorted((r["k"], r["problem"]) for r in got) == [(1, "missing"), (2, "unreadable"), (3, "no polygon"), (4, "empty"), (5, "empty"), (6, "empty"), (7, "too few points"), (8, "not closed"), (9, "a coordinate is missing"), (10, "not closed"), (12, "unreadable")]
    found = spatial.feature_set_errors(spark.createDataFrame([(1,), (2,), (2,), (5,)], "k int"), spark.createDataFrame([(1,), (2,), (3,)], "k int"), ["k"])
    assert sorted(map(tuple, found.collect())) == [(2, "repeated"), (3, "missing"), (5, "beyond")]


def ring(rnd, x, y, r, n, wobble=0.03, closed=True):
    corners = [(x + r * (1 + wobble * rnd.uniform(-1, 1)) * math.cos(2 * math.pi * i / n), y + r * (1 + wobble * rnd.uniform(-1, 1)) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return corners + corners[:1] * closed


def inside(x, y, corners):
    found = False
    for (x1, y1), (x2, y2) in zip(corners, corners[1:], strict=False):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            found = not found
    return found


@pytest.mark.parametrize(("edges", "depth"), [(16, 8), (2, 5), (1000, 0)])
def test_points_in_covers(spark, monkeypatch, edges, depth):
    """Points everywhere, on corners and level with them; one crowded cell; holes, an open ring, a dot, polygons of very different sizes."""
    monkeypatch.setattr(cover.cover, "__defaults__", (edges, depth))
    rnd = random.Random(4)
    shapes = [
        (1, ring(rnd, 135, 35, 3, 200), [ring(rnd, 135, 35, 0.5, 20), ring(rnd, 136, 35.2, 0.3, 5)]), (2, ring(rnd, 140, 40, 0.01, 12), []), (3, ring(rnd, 139, 36, 20, 500, 0.02), [ring(rnd, 139, 36, 3, 50)]),
        (4, [(130.0, 30.0), (132.0, 30.0), (132.0, 32.0), (130.0, 32.0), (130.0, 30.0)], []), (5, [(1.0, 1.0)], []), (6, None, []), (8, [(136.0, 36.0), (136.0, 36.0)], None), (9, ring(rnd, -100, -35, 1, 8), [ring(rnd, -99.3, -35, 0.5, 9)]),
    ]
    corners = [p for s in shapes for p in (s[1] or [])]
    points = [(i, rnd.uniform(115, 162), rnd.uniform(14, 58)) for i in range(800)] + [(10_000 + i, rnd.uniform(134.9, 135.1), rnd.uniform(35.4, 35.6)) for i in range(2000)]
    points += [(20_000 + i, x, y) for i, (x, y) in enumerate(corners)] + [(30_000 + i, rnd.choice([130.0, 130.5, 132.0]), rnd.choice([30.0, 31.0, 32.0])) for i in range(40)] + [(40_000 + i, x, rnd.uniform(30, 40)) for i, (x, _) in enumerate(corners[:300])]
    points += [(50_000 + i, rnd.uniform(-102, -98), rnd.uniform(-37, -33)) for i in range(200)] + [(1, None, 3.0), (2, math.nan, 3.0), (3, math.inf, 3.0)]
    want = {}
    for p, x, y in points:
        areas = [a for a, shell, holes in shapes if shell and x is not None and math.isfinite(x) and inside(x, y, shell) and not any(inside(x, y, h) for h in holes or [])]
        if areas:
            want[p] = min(areas)
    kind = "area int, shell array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>"
    table, where = spark.createDataFrame(shapes, kind).repartition(3), spark.createDataFrame(points, "p int, lon double, lat double").repartition(4)
    found = cover.points_in(where, table, "p", "area")
    assert {r["p"]: r["area"] for r in found.collect()} == want
    assert cover.points_in(where, table.limit(0), "p", "area").count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and all("shell" not in line for line in plan.split("\n") if line.lstrip("+-: ").startswith("Join"))


def test_covers_have_cells_of_several_sizes():
    square = [{"x": x, "y": y} for x, y in [(0.1, 0.1), (7.9, 0.1), (7.9, 7.9), (0.1, 7.9), (0.1, 0.1)]]
    cells = list(cover.cells_of(square, [], edges=0, depth=4))
    whole = [c for c in cells if not len(c[3])]
    assert len({c[0] for c in whole}) > 1 and all(c[4] == [0] for c in whole)
    area = sum((cover.ROOT / 2.0 ** c[0]) ** 2 for c in whole)
    assert 0.6 * 7.8**2 < area <= 7.8**2


def test_vintages_that_must_agree(spark):
    rows = [("a", "r6", "need", 2025, 5), ("a", "r7", "need", 2025, 5), ("a", "r6", "plan", 2025, 4), ("b", "r7", "actual", 2024, 1)]
    table = spark.createDataFrame(rows, "k string, vintage string, measure string, year int, value int")
    picks, equal = {"plan": ("r6", "plan", 2025), "actual": ("r7", "actual", 2024)}, {"need": [("r6", "need", 2025), ("r7", "need", 2025)]}
    assert sorted(map(tuple, relational.vintage_measures(table, ["k"], picks, equal).collect())) == [("a", 4, None, 5), ("b", None, 1, None)]
    wrong = table.union(spark.createDataFrame([("b", "r6", "need", 2025, 3)], table.schema))
    with pytest.raises(Exception, match="need differs between vintages: k b"):
        relational.vintage_measures(wrong, ["k"], picks, equal).collect()


def test_drift_of_a_crosswalk(spark):
    status = relational.join_status(spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1,), (8,), (9,)], "k int"), ["k"])
    found = relational.crosswalk_drift(status, "k", spark.createDataFrame([(8, 2), (8, 5), (7, 2)], "old int, new int"))
    assert sorted(map(tuple, found.collect())) == [("left", "3", "uncovered"), ("left", "5", "stale"), ("right", "7", "stale"), ("right", "9", "uncovered")]


def test_headers_with_line_breaks(spark):
    cells = spark.createDataFrame([("s", 1, 1, "be\nds "), ("s", 2, 1, "a\r\nb"), ("s", 1, 2, None), ("s", 2, 2, "\n")], "sheet string, row int, col int, value string")
    assert {r["col"]: r["label"] for r in layout.header(cells, 1, 2).collect()} == {1: "beds/ab", 2: "beds/ab"}
