"""Rules on the write path, and documents without a schema."""

import json
import logging
import os

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import quality
from ledgerline.plans import writing
from ledgerline.sources import documents_of


def test_both_policies(spark, tmp_path, caplog):
    rows = spark.createDataFrame([(i, i % 5, float(i)) for i in range(100)] + [(99, 1, None)], "k int, g int, v double").repartition(5)
    told = quality.Check("range", quality.outside("v", 0, 89), fatal=False)
    path = f"file://{tmp_path}/t"
    with caplog.at_level(logging.WARNING):
        found = writing.write_checked(rows, path, [told, quality.Check("group", quality.off_domain("g", [0, 1, 2, 3, 4])), quality.Check("many", quality.unexpected_count(101))])
    assert sorted(map(tuple, found.collect())) == [("group", 0, True, True), ("many", 0, True, True), ("range", 11, False, False)]
    assert spark.read.parquet(path).count() == 101 and "range: 11 rows" in caplog.text
    for fatal in (quality.Check("range", quality.outside("v", 0, 89)), quality.Check("key", quality.duplicates(["k"]))):
        with pytest.raises(ValueError, match=f"not written, as rules are broken: {fatal.name}"):
            writing.write_checked(rows.withColumn("g", F.lit(7)), path, [told, fatal])
        assert spark.read.parquet(path).filter("g = 7").count() == 0  # what was there stays
    writing.write_checked(rows.limit(3), path, [told])
    assert spark.read.parquet(path).count() == 3 and sorted(os.listdir(tmp_path)) == ["t"]
    none = writing.write_checked(rows.limit(0), f"{tmp_path}/none", [told, quality.Check("key", quality.duplicates(["k"]))])
    assert [r["passed"] for r in none.collect()] == [True, True] and spark.read.parquet(f"{tmp_path}/none").count() == 0


def test_row_rules_need_no_scan(spark, tmp_path):
    """The rows are computed once, for the write itself."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(1000).mapInArrow(count, "id long")
    writing.write_checked(rows, f"{tmp_path}/once", [quality.Check("a", quality.outside("id", 0, 10_000)), quality.Check("b", quality.outside("id", 0, 10), fatal=False)])
    assert seen.value == 1000


def test_fields_and_shapes(spark, tmp_path):
    docs = ['{"a": 1, "b": {"c": [1, "x", null]}}', '{"a": "1"}', '{"a": null, "b": 2.5}', "{", None, "[1, 2]", '{"a": 3, "b": {"c": []}}', "7"]
    rows = documents_of.parsed(spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "i int, t string"), "t")
    got = documents_of.with_fields(rows, {"a": ("$.a", "long"), "b": ("$.b", "double")})
    assert [r["a"] for r in got.orderBy("i").collect()] == [1, None, None, None, None, None, 3, None]
    assert {r["i"]: r["b"] for r in got.filter("b is not null").collect()} == {2: 2.5}
    found = {(r["i"], r["field"], r["problem"]) for r in documents_of.violations(got, ["i"]).collect()}
    assert found == {(0, "b", "mistyped"), (1, "a", "mistyped"), (1, "b", "absent"), (2, "a", "null"), (3, None, "unreadable"), (5, "a", "absent"), (5, "b", "absent"), (6, "b", "mistyped"), (7, "a", "absent"), (7, "b", "absent")}
    counts = {(r["path"], r["kind"]): r["n"] for r in documents_of.shapes(rows, 4).collect()}
    assert counts[("$", "object")] == 4 and counts[("$", "array")] == 1 and counts[("$", "bigint")] == 1 and counts[("$[*]", "bigint")] == 2
    assert counts[("$.a", "bigint")] == 2 and counts[("$.a", "string")] == 1 and counts[("$.a", "void")] == 1 and counts[("$.b.c", "array")] == 2
    assert counts[("$.b.c[*]", "bigint")] == counts[("$.b.c[*]", "string")] == counts[("$.b.c[*]", "void")] == 1
    (tmp_path / "d.json").write_text("\n".join([json.dumps({"k": 1}), "", "no", json.dumps({"k": 2, "z": "x"})]))
    lines = documents_of.read_lines(spark, str(tmp_path / "d.json"))
    assert (lines.count(), lines.filter("unreadable").count()) == (3, 1) and documents_of.common_schema(lines) == "OBJECT<k: BIGINT, z: STRING>"
    assert documents_of.shapes(rows.limit(0), 2).count() == 0
