"""Edge cases of the base operators."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import codes, measures, text
from ledgerline.operators import linkage, quality, relational
from ledgerline.plans import exports
from ledgerline.sources import layout, tables
from ledgerline.streaming.events import tumbling_counts


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_cell_status(spark):
    got = column(spark, [None, "", " ", "-", "*", "not reported", "XXX", "12", "1.5", "NaN", "n/a"], "string", codes.cell_status)
    assert got == ["blank"] * 3 + ["source_dash", "not_disclosed", "not_reported", "not_calculated", "observed", "observed", "error", "error"]


def test_code(spark):
    assert column(spark, ["7", "07", "123", "x", None, "7.0"], "string", lambda v: codes.code(v, 2)) == ["07", "07", None, None, None, "07"]


def test_half_up_and_bins(spark):
    assert column(spark, [0.00005, -0.00005, None], "double", measures.half_up) == [0.0001, 0.0, None]
    assert column(spark, [0.5, 0.77, 1.0, 9.0, None], "double", lambda v: measures.fixed_bin(v, "ratio")) == [0, 1, 3, 6, None]


def test_ratio_by_zero(spark):
    row = spark.sql("select 3 a, 0 b, cast(null as int) c").select(measures.ratio(F.col("a"), F.col("b")), measures.ratio(F.col("a"), F.col("c")), measures.ratio_note(F.col("b"))).first()
    assert tuple(row) == (None, None, "denominator is 0")


def test_names(spark):
    assert column(spark, ["ＡＢ c-d", None], "string", lambda v: text.folded(text.nfkc(v))) == ["abcd", None]
    assert column(spark, ["redgreen", "redhouse"], "string", lambda v: text.without_terms(v, ["red", "green"])) == ["redgreen", "house"]


def test_join_status_and_override(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (3,)], "k int")
    assert sorted(map(tuple, relational.join_status(a, b, ["k"]).collect())) == [(1, "left_only"), (2, "matched"), (3, "right_only")]
    rows = spark.createDataFrame([(1, 5), (2, 6)], "k int, x int")
    assert sorted(map(tuple, relational.override(rows, spark.createDataFrame([(2, 9)], "k int, x int"), "k", "x").select("k", "x", "overridden").collect())) == [(1, 5, False), (2, 9, True)]


def test_quality(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (1, 3)], "g int, k int")
    checks = [quality.Check("key", quality.duplicates(["g", "k"])), quality.Check("gap", quality.gaps("g", "k", 1), fatal=False)]
    assert {r["check"]: r["violations"] for r in quality.report(rows, checks).collect()} == {"key": 1, "gap": 1}
    with pytest.raises(ValueError, match="key"):
        quality.enforce(rows, checks)


def test_contest_withdraws_both(spark):
    left = spark.createDataFrame([(1, "b", "n"), (2, "b", "n"), (3, "b", "m")], "left_id int, block string, name string")
    right = spark.createDataFrame([(10, "b", "n"), (11, "b", "m")], "right_id int, block string, name string")
    got = {r["left_id"]: (r["contested"], r["right_id"]) for r in linkage.contested(linkage.exact(left, right, "block", "name")).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 11)}


def test_layout(spark):
    cells = spark.createDataFrame([("s", 1, 1, "beds"), ("s", 1, 2, None), ("s", 2, 1, "a"), ("s", 2, 2, "b"), ("s", 3, 0, "k"), ("s", 3, 1, "5"), ("s", 3, 2, "6"), ("s", 4, 1, "note")], "sheet string, row int, col int, value string")
    assert sorted(map(tuple, layout.tidy(cells, (1, 2), 0).collect())) == [("s", "k", "beds/a", "5"), ("s", "k", "beds/b", "6")]


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b", None), ("a", "1")], "k string, v string")
    for name in "xy":
        exports.write_csv(rows, f"{tmp_path}/{name}", ["k"])
    read = lambda name: b"".join(p.read_bytes() for p in sorted((tmp_path / name).glob("part*")))
    assert read("x") == read("y")
    assert sorted(map(tuple, tables.csv_strings(spark, f"{tmp_path}/x").collect())) == [("a", "1"), ("b", None)]
    assert [r["bad_cells"] for r in tables.typed(spark.createDataFrame([("x",), ("1",)], "v string"), {"v": "int"}).collect()] == [["v"], []]


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(f"{tmp_path}/in")
    stream = tumbling_counts(spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, tumbling_counts(source).collect()))


def test_suffix_compares_names_once(spark):
    left = spark.createDataFrame([(i, "b", ["north clinic", "clinic", "other name"][i % 3]) for i in range(60)], "left_id int, block string, name string")
    right = spark.createDataFrame([(i, "b", "far north clinic") for i in range(40)] + [(99, "b", "other"), (98, "c", "x clinic"), (97, "b", None)], "right_id int, block string, name string")
    names = left.select("block", "name").distinct(), right.select("block", F.col("name").alias("other")).distinct()
    assert sorted(map(tuple, linkage._suffix_pairs(*names, 5).collect())) == [("b", "clinic", "far north clinic"), ("b", "north clinic", "far north clinic")]
    got = {r["left_id"]: (r["candidates"], r["right_id"]) for r in linkage.suffix(left, right, "block", "name").collect()}
    assert got == {i: (40, None) for i in range(60) if i % 3 < 2}
    right = right.filter("right_id in (7, 99)")
    assert {r["right_id"] for r in linkage.suffix(left, right, "block", "name").collect()} == {7}


def test_best_candidates_by_hand(spark):
    """The most similar name of the block by a scan of all, on the query's own tables and on short and odd names; one hot block."""
    import difflib
    import random

    from ledgerline.queries import _sides

    rnd = random.Random(4)
    name = lambda: "".join(rnd.choice("aabc é") for _ in range(rnd.randrange(0, 9)))
    odd = [[(i, rnd.choice(["hot", "hot", "b"]), name() if i % 20 else None) for i in range(150)] for _ in range(2)]
    tables = [_sides(spark, "/root/testdata/sf0.001"), tuple(spark.createDataFrame(rows, f"{side}_id int, block string, name string") for side, rows in zip(("left", "right"), odd))]
    for left, right in tables:
        rows, others = left.collect(), right.collect()
        want = {}
        for l in rows:
            scores = [(difflib.SequenceMatcher(None, l["name"], r["name"]).ratio(), -r["right_id"]) for r in others if r["block"] == l["block"] and r["name"] is not None] if l["name"] is not None else []
            if scores and max(scores)[0] >= 0.8:
                want[l["left_id"]] = (-max(scores)[1], round(max(scores)[0], 4))
        got = {r["left_id"]: (r["right_id"], round(r["score"], 4)) for r in linkage.fuzzy(left, right, "block", "name").collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items() if v}
        assert all(abs(got[k][1] - want[k][1]) <= 1e-4 for k in got)
        ends = {l["left_id"]: [r["right_id"] for r in others if r["block"] == l["block"] and l["name"] and r["name"] and l["name"] != r["name"] and min(len(l["name"]), len(r["name"])) >= 3 and (l["name"].endswith(r["name"]) or r["name"].endswith(l["name"]))] for l in rows}
        found = {r["left_id"]: (r["candidates"], r["right_id"]) for r in linkage.suffix(left, right, "block", "name", 3).collect()}
        assert found == {k: (len(v), v[0] if len(v) == 1 else None) for k, v in ends.items() if v}


def test_planted_gaps_and_flows(spark):
    """Missing numbers and edges, which the full tables hardly have."""
    turns = spark.createDataFrame([(1, t) for t in (0, 1, 4)] + [(2, t) for t in (0, 1, 1)] + [(3, 0), (3, 1)], "conv_id int, turn int")
    assert sorted(r["conv_id"] for r in quality.gaps("conv_id", "turn", 0)(turns).collect()) == [1, 2]
    from ledgerline.operators import flows

    places = spark.createDataFrame([(i,) for i in range(4)], "place int")
    edges = spark.createDataFrame([(0, 0, 5.0), (0, 1, 0.0), (0, 2, 2.0), (1, 3, 1.0)], "origin int, partner int, rate double")
    assert {r["place"]: r["status"] for r in flows.listed(places, edges, "origin", "partner", "rate", 0).collect()} == {0: "self", 1: "zero", 2: "listed", 3: "unlisted"}


def test_extremes_and_splits(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("b", 0), ("c", 0), ("d", 0), ("e", None)], "k string, v int")
    assert {(r["place"], r["k"], r["rate"]) for r in relational.rate_extremes(rows, "k", F.col("v") == 1).collect()} == {("lowest", "c", 0.0), ("highest", "a", 0.5)}
    assert relational.rate_extremes(rows.filter("k = 'z'"), "k", F.col("v") == 1).count() == 0
    pairs = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "x")], "p int, c string")
    assert [tuple(r) for r in relational.residual_splits(pairs, "p", "c", spark.createDataFrame([(1, "x"), (2, "x")], "p int, c string")).collect()] == [(1, "y")]


def test_points_of_documents(spark):
    """Elements and areas without a whole coordinate have no feature."""
    from ledgerline.plans import documents

    rows = spark.createDataFrame([(1, 130.0, 35.0), (2, None, 35.0), (3, 130.0, None)], "k int, lon double, lat double")
    assert [r["g"] and tuple(r["g"]) for r in rows.orderBy("k").select(documents.point(F.col("lon"), F.col("lat")).alias("g")).collect()] == [("Point", [130.0, 35.0]), None, None]
    nested = rows.groupBy().agg(F.collect_list(F.struct("k", "lon", "lat")).alias("items")).withColumn("area", F.lit("a"))
    assert [(r["area"], r["properties"]) for r in documents.point_features(nested, ["area"], "items", ["k"]).collect()] == [("a", {"k": "1"})]


def test_vintages_and_shards(spark, tmp_path):
    from ledgerline.plans import exports
    from ledgerline.sources import tables

    rows = spark.createDataFrame([("a", 1, "R6"), ("b", 0, "R7"), ("c", 0, "R7")], "area string, n int, fy string")
    rows.write.partitionBy("fy").parquet(f"{tmp_path}/v")
    one = tables.vintage(spark, f"{tmp_path}/v", "fy", "R7")
    assert {r["area"] for r in one.collect()} == {"b", "c"} and "PartitionFilters: [isnotnull(fy" in one._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="R8"):
        tables.vintage(spark, f"{tmp_path}/v", "fy", "R8")

    exports.write_shards(rows.withColumn("echo", F.when(F.col("area") == "c", "b").otherwise(F.col("area"))), f"{tmp_path}/s", "area")
    assert [r["n"] for r in exports.read_shard(spark, f"{tmp_path}/s", "area", "b", "echo").collect()] == [0]
    with pytest.raises(Exception, match="shard c holds b"):
        exports.read_shard(spark, f"{tmp_path}/s", "area", "c", "echo").collect()

    seen_rows, seen = quality.observe_zeros(rows, "zeros", ["n"])
    assert seen_rows.count() == 3 and seen.get == {"n": 2}


def test_adoption_and_nesting(spark):
    rows = spark.createDataFrame([(1, True, 1.0, 2.0), (2, False, 1.0, 2.0), (3, False, None, 2.0), (4, None, None, None)], "k int, gone boolean, own double, ref double")
    got = [tuple(r["a"]) for r in rows.orderBy("k").select(linkage.adopted(F.col("gone"), F.col("own"), F.col("ref")).alias("a")).collect()]
    assert got == [(None, "withdrawn"), (1.0, "register"), (2.0, "reference"), (None, "none")]
    nested = spark.createDataFrame([("01a", "01"), ("01a", "01"), ("02a", "01"), ("03a", "03"), ("03a", "04"), (None, "01"), ("05a", None)], "c string, p string")
    found = {(r["c"], r["parents"], r["unfit"]) for r in relational.nesting_errors(nested, "c", "p", F.startswith("c", "p")).collect()}
    assert found == {("02a", 1, 1), ("03a", 2, 1)}
    cells = spark.createDataFrame([(["a", "b"],), (["a"],), (["a", None],), (None,)], "cells array<string>")
    assert quality.ragged("cells", 2)(cells).count() == 3


def test_linkage_broadcasts_no_side(spark):
    """Spark takes the sides of these joins for small, as their files are; they grow with the registers, and the driver would hold what is broadcast."""
    from ledgerline.queries_reports import _registers

    left, right = _registers(spark, "/root/testdata/sf0.001")
    a, b = (rows.withColumn("block", F.col("area")) for rows in (left, right))
    letters = [linkage._letters(rows.select("block", F.col("name").alias(c)).distinct(), c) for rows, c in ((a, "name"), (b, "other"))]
    for rows in (linkage.tiers(left, right), linkage.fuzzy(a, b, "block", "name"), linkage.suffix(a, b, "block", "name"), linkage.exact(a, b, "block", "name"), linkage._like_pairs(*letters, 0.8)):
        assert "Broadcast" not in rows._jdf.queryExecution().toString()


def test_equal_names_meet_no_other(spark):
    """A name that stands on both sides is its own best; the others meet all that letters let reach the threshold, and long names have more letters than bits."""
    import difflib
    import random

    rnd = random.Random(7)
    long = ["".join(rnd.choice("abcdefgh🙂é ") for _ in range(150)) for _ in range(12)]
    typo = lambda t: t[:3] + rnd.choice("xyz") + t[4:]
    sides = [["", "red bolt 12", "red bolt 21", "new rod 5", None, *long[:4], *map(typo, long[4:])], ["", "red bolt 12", "red bolt 13", "new rod 6", None, *long]]
    left, right = (spark.createDataFrame([(i, "b", t) for i, t in enumerate(names)], f"{side}_id int, block string, name string") for side, names in zip(("left", "right"), sides))
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    best = {i: max((ratio(x, y), -j) for j, y in enumerate(sides[1]) if y is not None) for i, x in enumerate(sides[0]) if x is not None}
    got = {r["left_id"]: (r["right_id"], r["score"]) for r in linkage.fuzzy(left, right, "block", "name").collect()}
    assert got == {i: (-j, round(s, 4)) for i, (s, j) in best.items() if s >= 0.8}
    letters = [linkage._letters(rows.filter("name != ''").select("block", F.col("name").alias(c)), c) for rows, c in ((left, "name"), (right, "other"))]
    pairs = {(r["name"], r["other"]): r["bound"] for r in linkage._like_pairs(*letters, 0.8).collect()}
    common = lambda x, y: 2 * sum(min(x.count(c), y.count(c)) for c in set(x)) / (len(x) + len(y))
    want = {(x, y): common(x, y) for x in sides[0] if x for y in sides[1] if y and common(x, y) >= 0.8}
    assert pairs.keys() == want.keys() and all(abs(pairs[k] - want[k]) < 1e-9 for k in want)
