"""Sheets taken apart in one pass."""

from ledgerline.sources import sheets


def test_relations_of_one_pass(spark):
    block = {"first_row": 2, "size": 2, "count": 3}
    relations = [
        sheets.Relation("names", fields={"number": (0, 0), "name": (0, 1)}, number="number", **block),
        sheets.Relation("beds", fields={"total": (1, 0), "a": (1, 1), "b": (1, 2)}, totals={"total": ["a", "b"]}, **block),
        sheets.Relation("list", first_row=20, fields={"key": (0, 0), "x": (0, 5), "y": (0, 6)}, key="key", totals={"x": ["y"]}),
    ]
    cells = [(2, 0, "1"), (2, 1, "A"), (3, 0, "0.3"), (3, 1, "0.1"), (3, 2, "0.2"), (6, 0, "4"), (6, 1, "C"), (6, 1, "D"), (7, 0, "9"), (7, 1, "5"), (7, 2, " "), (1, 0, "title"), (8, 0, "after"), (2, 7, "derived")]
    cells += [(20, 0, "k"), (20, 5, "2"), (20, 6, "2"), (21, 5, "note"), (5000, 0, "z"), (5000, 5, "7f"), (5000, 6, None)]
    table = spark.createDataFrame([("s", *c) for c in cells], "sheet string, row int, col int, value string").repartition(3)
    parsed = sheets.parse(table, relations)
    got = {tuple(r)[1:] for r in parsed.collect()}
    assert got == {
        ("names", 0, "number", "1", None), ("names", 0, "name", "A", None), ("names", 2, "number", "4", None), ("names", 2, "name", "C", None), ("names", 2, "name", "D", None),
        ("names", 1, "number", None, "is not the next number"), ("names", 2, "number", "4", "is not the next number"), ("names", 2, "name", "C", "stands twice"),
        ("beds", 0, "total", "0.3", None), ("beds", 0, "a", "0.1", None), ("beds", 0, "b", "0.2", None), ("beds", 2, "total", "9", None), ("beds", 2, "a", "5", None),
        ("list", 0, "key", "k", None), ("list", 0, "x", "2", None), ("list", 0, "y", "2", None), ("list", 4980, "key", "z", None), ("list", 4980, "x", "7f", None), ("list", 4980, "x", "7f", "is not the sum of its parts"),
    }
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == plan.count("LogicalRDD") == 1 and "Join" not in plan
    assert sheets.parse(table.limit(0), relations).count() == 0
