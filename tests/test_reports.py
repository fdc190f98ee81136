"""Names, addresses, linkage tiers, archives and rules on small cases."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import codes, measures, names, places
from ledgerline.operators import flows, linkage, quality, quantiles, relational
from ledgerline.plans import exports
from ledgerline.sources import archives, blocks, zips
from test_operators import column


def test_normal_name(spark):
    given = ["医療法人社団　森クリニック", "厚生連クリニック", "ＡＢＣ・Ｃｅｎｔｅｒ", "（財）北病院", "社会医療法人財団董仙会", "", None]
    assert column(spark, given, "string", names.normal_name) == ["森クリニック", "厚生連クリニック", "abccenter", "財北病院", "董仙会", "", None]
    assert column(spark, ["クリニック", "内科センタ", "森病院", ""], "string", names.type_words_only) == [True, True, False, True]


def test_municipality(spark):
    given = ["札幌市北区北1条", "札幌市12", "標津郡中標津町東", "文京区本郷", "赤磐市下市187", "昭和町河東443", "港北区小机町3211", "長崎県長崎市坂本", "三浦市1", "12", "", None]
    sure = ["札幌市北区", None, "中標津町", "文京区", "赤磐市", None, None, "長崎市", "三浦市", None, None, None]
    assert column(spark, given, "string", places.municipality) == [*sure[:5], "昭和町", *sure[6:]]
    assert column(spark, given, "string", lambda v: places.municipality(v, unsure=False)) == sure
    pairs = [("港北区小机町3", "横浜市港北区"), ("標津郡中標津町1", "中標津町"), ("龍ヶ崎市1", "龍ケ崎市"), ("四日市市1", "四日市市"), ("川柳町3", "越谷市"), ("赤磐市1", "岡山市"), ("", "岡山市"), ("赤磐市1", ""), (None, "x")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, m string").orderBy("i")
    got = [r[0] for r in rows.select(places.municipality_check(F.col("a"), F.col("m"))).collect()]
    assert got == ["", "", "", "", "municipality_not_in_address", "municipality_mismatch", *["municipality_not_in_address"], "municipality_mismatch", "municipality_not_in_address"]


def test_tiers(spark):
    town, near = "赤磐市", "赤磐市下市1"
    left = [
        (1, "A", "alpha hospital", town), (2, "A", "beta clinic", town), (3, "A", "beta clinic", town), (4, "A", "gamma", None), (5, "A", "delta house", town), (6, "A", "north epsilon", town),
        (7, "A", "zeta institute", town), (8, "A", "nothing alike", town), (9, "B", "alpha hospital", town), (10, "A", "theta place", "岡山市"), (11, "A", "south kappa", town), (12, "A", "west kappa", town),
    ]
    right = [
        (101, "A", "alpha hospital", near), (102, "A", "beta clinic", near), (103, "A", "gamma", near), (104, "A", "delta house", near), (105, "A", "delta house", near), (106, "A", "epsilon", near),
        (107, "A", "zeta institutes", near), (108, "A", "theta place", near), (109, "A", "kappa", near),
    ]
    rows = linkage.tiers(spark.createDataFrame(left, "left_id int, area string, name string, municipality string"), spark.createDataFrame(right, "right_id int, area string, name string, address string"))
    got = {r["left_id"]: tuple(r)[1:] for r in rows.collect()}
    assert got[1] == ("matched", "normalized_exact", "", 1, None, 101)
    # Both claim 102, so neither has it, and both find it again as a candidate.
    assert [got[i][0] for i in (2, 3)] == ["candidate_only"] * 2 and got[2][2] == got[3][2] == "contested_candidate" and got[2][5] == 102
    assert got[4][:3] == ("candidate_only", "none", "not_reported_facility")
    assert got[5][2] == "multiple_candidates_in_area" and got[5][5] == 104
    assert got[6] == ("matched", "normalized_suffix", "", 1, None, 106)
    assert got[7][:3] == ("candidate_only", "none", "no_name_match") and got[7][4:] == (0.9655, 107)
    assert got[8][:4] == ("unmatched", "none", "no_name_match", 0) and got[8][5] is None
    assert got[9][:4] == ("unmatched", "none", "outside_area_polygon", 1)
    assert got[10][2] == "municipality_mismatch"
    assert [got[i][2] for i in (11, 12)] == ["contested_candidate"] * 2


def test_references_and_audit(spark):
    left = spark.createDataFrame([(1, "r", "a", "赤磐市"), (2, "r", "b", None), (3, "r", "c", "赤磐市"), (4, "r", "d", "赤磐市"), (5, "r", "e", "赤磐市")], "left_id int, region string, name string, municipality string")
    right = spark.createDataFrame([(10, "r", "a", "赤磐市1"), (11, "r", "a", "岡山市北区1"), (12, "r", "b", "x"), (13, "r", "c", "岡山市北区1"), (14, "r", "d", "赤磐市1"), (15, "r", "d", "赤磐市2")], "right_id int, region string, name string, address string")
    got = {r["left_id"]: tuple(r)[1:] for r in linkage.references(left, right).collect()}
    assert got == {1: ("unique", 10), 2: ("unique_municipality_unverified", 12), 3: ("municipality_mismatch", None), 4: ("ambiguous", None), 5: ("none", None)}


def test_flow_groups(spark):
    groups = spark.createDataFrame([("a",), ("b",)], "g string")
    edges = spark.createDataFrame([("a", "x", 0.5, 1, "observed"), ("a", "a", 0.3, 2, "observed"), ("a", "y", 0.1, 3, "observed"), ("a", "z", None, 4, "error")], "g string, p string, rate double, rank int, status string")
    full = flows.every_group(groups, edges, ["g"], "p", "rate", "g", "status")
    got = {r["g"]: r for r in full.collect()}
    assert (got["a"]["self_rate"], got["a"]["self_rank"], len(got["a"]["partners"]), got["a"]["value_error_count"]) == (0.3, 2, 2, 1)
    assert (got["b"]["self_rate"], got["b"]["partners"], got["b"]["value_error_count"]) == (None, [], 0)
    assert sorted(map(tuple, flows.with_self(full, "g").collect())) == [("a", 1, "x", 0.5), ("a", 2, "a", 0.3), ("a", 3, "y", 0.1)]


def test_self_at_either_end(spark):
    groups = spark.createDataFrame([("a",)], "g string")
    for order in (["a"], ["a", "x"], ["x", "a"], ["x"]):
        edges = spark.createDataFrame([("a", p, 0.1, i + 1, "observed") for i, p in enumerate(order)], "g string, p string, rate double, rank int, status string")
        rows = flows.with_self(flows.every_group(groups, edges, ["g"], "p", "rate", "g", "status"), "g").orderBy("rank").collect()
        assert [r["partner"] for r in rows] == order


def test_blocks(spark):
    cells = spark.createDataFrame([("s", 1, 1, "1"), ("s", 2, 2, "h"), ("s", 3, 1, "3"), ("s", 4, 2, "g"), ("s", 9, 1, "note")], "sheet string, row int, col int, value string")
    placed = blocks.fixed_blocks(cells, 1, 2, 3)
    assert sorted(map(tuple, blocks.block_number_errors(placed, 3, 1, 1).collect())) == [("s", 1, 2, 3), ("s", 2, 3, None)]
    assert list(map(tuple, blocks.header_errors(placed, 1).collect())) == [("s", 1)]
    lists = spark.createDataFrame([(1, "01,02", "a, b"), (2, "03", "c,d")], "k int, c string, n string")
    assert sorted(map(str, map(tuple, blocks.code_pairs(lists, "c", "n").collect()))) == sorted(map(str, [(1, False, "01", "a"), (1, False, "02", "b"), (2, True, "03", "c"), (2, True, None, "d")]))


def test_labels(spark):
    assert [r and tuple(r) for r in column(spark, ["2015実績", "2015年との差", None], "string", codes.series_column)] == [("実績", 2015), None, None]
    assert [r and tuple(r) for r in column(spark, ["0101南渡島", "x"], "string", codes.sheet_name)] == [("0101", "南渡島"), None]
    assert column(spark, [1.0004, 1.03, 0.97, 1.0, None], "double", measures.change_text) == ["0.0%", "+3.0%", "-3.0%", "0.0%", None]
    assert column(spark, [0, 1, 6, 7], "int", lambda v: measures.ramp_places(v, 7)) == [[], [0], [0, 1, 2, 4, 5, 6], list(range(7))]


def test_zipped_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.csv", "﻿code,name\r\n01,\"a\nb\"\r\n02,\r\n".encode())
    assert [tuple(r)[2:] for r in zips.zipped_csv(spark, f"{tmp_path}/t.zip", ["name", "code"]).orderBy("row").collect()] == [(1, "a\nb", "01"), (2, None, "02")]
    features = [{"type": "Feature", "properties": {"k": i, "t": "}]," * i}, "geometry": {"type": "Point", "coordinates": [i, 0.5]}} for i in range(7_000)]
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("a.geojson", json.dumps({"type": "FeatureCollection", "features": features[:20]}, indent=2))
        z.writestr("b.geojson", json.dumps({"features": [dict(f, properties={"k": f["properties"]["k"]}) for f in features], "name": "x"}))
        z.writestr("c.txt", "no")
    rows = zips.zipped_features(spark, f"{tmp_path}/f.zip")
    assert {r["member"]: r["count"] for r in rows.groupBy("member").count().collect()} == {"a.geojson": 20, "b.geojson": 7_000}
    assert rows.select(F.sum(F.get_json_object("properties", "$.k").cast("int"))).first()[0] == sum(range(20)) + sum(range(7_000))
    (tmp_path / "p.geojson").write_text(json.dumps({"features": features[:3]}))
    assert [tuple(r) for r in archives.features(spark, f"{tmp_path}/p.geojson", "k int").orderBy("k").collect()] == [(0,), (1,), (2,)]
    hashes = archives.file_hashes(spark, f"{tmp_path}/t.zip", spark.createDataFrame([("t.zip", "0")], "file string, sha256 string"))
    assert [r["agrees"] for r in hashes.collect()] == [False]


def test_written_exports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    exports.write_with_meta(rows, f"{tmp_path}/t", ["k"], {"title": "é"})
    assert json.loads((tmp_path / "t.meta.json").read_text()) == {"title": "é", "fields": ["k", "v"], "rows": 2, "bytes": 14}
    assert (tmp_path / "t").read_bytes() == b"k,v\r\na,1\r\nb,\r\n"
    exports.write_shards(rows, f"{tmp_path}/s", "k")
    assert spark.read.schema("k string, v int").json(f"{tmp_path}/s").filter("k = 'a'").first()["v"] == 1


def test_rules(spark):
    rows = spark.createDataFrame([(1, 10, 4, 6), (2, 10, 4, 5), (3, 10, 4, None), (4, 3, 4, None)], "k int, t int, a int, b int")
    assert sorted(r["k"] for r in quality.parts_beyond("t", ["a", "b"])(rows).collect()) == [2, 4]
    assert sorted(map(tuple, quality.unlike(spark.createDataFrame([(1,), (9,)], "k int"))(rows.select("k").filter("k < 3")).collect())) == [(2, "new"), (9, "gone")]
    texts = spark.createDataFrame([("1",), ("-1",), ("x",), (None,), ("NaN",), ("Infinity",)], "v string")
    assert sorted(str(r["v"]) for r in quality.not_number("v", "not_negative")(texts).collect()) == ["-1", "Infinity", "NaN", "None", "x"]
    assert [r["quantile"] for r in quantiles.element(spark.createDataFrame([(1, v) for v in (5, 1, 1, 9)], "g int, v int"), ["g"], "v", 0.5).collect()] == [5]


@pytest.mark.parametrize("text, want", [('{"features": []}', []), ('{"a": 1, "features" : [ {"x": [1, 2]},\n{"y": "]"} ]}', [{"x": [1, 2]}, {"y": "]"}]), ('{"a": 1}', [])])
def test_array_items(text, want):
    assert list(zips.array_items(io.StringIO(text), "features")) == want


def test_keys_of_municipalities(spark):
    """An address and a municipality have one key in common if it lies there, else none."""
    import random

    rnd = random.Random(5)
    text = lambda: "".join(rnd.choice(["区", "市", "郡", "町", "ヶ", "ケ", "北", "1", "東京都", "🏥"]) for _ in range(rnd.randrange(0, 7)))
    addresses = spark.createDataFrame([(i, text() if i % 50 else None) for i in range(300)], "i int, address string")
    given = spark.createDataFrame([(j, text() if j % 50 else None) for j in range(300)], "j int, name string")
    fits = places.in_municipality(F.col("address"), F.col("name"))
    want = {(r["i"], r["j"]) for r in addresses.crossJoin(given).filter(fits).collect()}
    met = places.address_keys(addresses, "address", "key", F.lit(20)).join(places.name_keys(given, "name", "key"), "key").select("i", "j").collect()
    assert len(want) > 500 and len(met) == len(want) and {tuple(r) for r in met} == want


def test_references_make_no_product(spark):
    """A name with many rows on both sides, each point with an address of its own: no step makes their pairs; the rows are those of a scan of all."""
    towns, roads = ["文京区", "横浜市港北区", "中標津町", "龍ケ崎市", "岡山市", "", None], ["文京区", "港北区", "標津郡中標津町", "東京都龍ヶ崎市", "赤磐市"]
    left = [(i, "r" if i % 9 else None, "a" if i % 5 else f"only {i}", towns[i % 7]) for i in range(700)]
    right = [(i, "r", "a", f"{roads[i % 4]}{i}") for i in range(600)] + [(1000 + i, "r", f"only {i}", None if i % 3 == 0 else f"{roads[i % 5]}{i}") for i in range(0, 700, 10)]
    frames = spark.createDataFrame(left, "left_id int, region string, name string, municipality string"), spark.createDataFrame(right, "right_id int, region string, name string, address string")
    inside = {tuple(r) for r in frames[0].select("municipality").distinct().crossJoin(frames[1].select("address").distinct()).filter(places.in_municipality(F.col("address"), F.col("municipality"))).select("municipality", "address").collect()}
    want = {}
    for i, region, name, town in left:
        same = [(k, a) for k, r, n, a in right if (r, n) == (region, name)]
        fit = [k for k, a in same if (town, a) in inside or not town]
        status = "none" if not same else "municipality_mismatch" if not fit else "ambiguous" if len(fit) > 1 else "unique" if town else "unique_municipality_unverified"
        want[i] = (status, fit[0] if len(fit) == 1 else None)

    def made(plan):
        rows = plan.metrics().get("numOutputRows")
        yield rows.get().value() if "Join" in plan.nodeName() and rows.isDefined() else 0
        for k in range(plan.children().size()):
            yield from made(plan.children().apply(k))

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan's children are hidden in its stages
    try:
        found = linkage.references(*frames)
        got = {r["left_id"]: tuple(r)[1:] for r in found.collect()}
        most = max(made(found._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got == want and len({s for s, _ in got.values()}) == 5
    assert 700 <= most < 5_000, most
