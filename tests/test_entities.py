"""Entity tables met without a shuffle, and the best candidate with few calls of the ratio."""

import difflib
import random

import pandas as pd
from pyspark.sql import functions as F

from ledgerline.operators import entities, linkage


def test_four_tables_without_a_shuffle(spark):
    rows = {
        "a": [(k, k * 10, float(k)) for k in range(30)], "b": [(k, k * 10, "x") for k in range(1, 30)], "c": [(k, k * 10 + (k == 5), None) for k in range(30)] + [(7, 70, None), (None, 1, None)],
        "d": [(k, None if k == 9 else k * 10, float(k)) for k in range(28)] + [(99, 1, 1.0)],
    }
    kinds = {"a": "k int, m int, v double", "b": "k int, m int, t string", "c": "k int, m int, v double", "d": "k int, m int, v double"}
    tables = {n: entities.bucketed(spark.createDataFrame(r, kinds[n]), f"met_{n}", "k", 4) for n, r in rows.items()}
    joined = entities.side_by_side(tables, "k", ["m"])
    assert joined.columns == ["k", "a", "b", "c", "d", "missing", "repeated", "differences"]
    collected = joined.collect()
    by = {r["k"]: r for r in collected}
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 3, plan
    assert len(by) == len(collected) == 30 and by[3]["missing"] == [] and by[3]["differences"] == {} and tuple(by[3]["b"]) == (30, "x") and by[0]["missing"] == ["b"] and by[0]["b"] is None
    assert by[7]["repeated"] == ["c"] and by[28]["missing"] == ["d"]
    assert by[5]["differences"] == {"m": {"a": "50", "b": "50", "c": "51", "d": "50"}} and by[9]["differences"]["m"]["d"] is None
    assert sorted(map(tuple, entities.beyond(tables, "k").collect()), key=str) == [(99, "d"), (None, "c")]
    found = {(r["k"], r["problem"]) for r in entities.disagreements(tables, "k", ["m"]).collect()}
    assert found == {(0, "missing in b"), (7, "repeated in c"), (28, "missing in d"), (29, "missing in d"), (5, "different m"), (9, "different m"), (None, "only in c"), (99, "only in d")}


def test_best_candidate_with_few_calls(spark, monkeypatch):
    """One block of names of like letters: the same rows as of all pairs, with a tenth of the calls that letters in common alone would let through."""
    rnd = random.Random(2)
    parts = ["saint", "mary", "north", "city", "general", "clinic", "care", "hill", "lake", "park"]
    name = lambda: "".join(rnd.sample(parts, 4))
    base = [name() for _ in range(250)]
    typo = lambda t: (lambda i: t[:i] + rnd.choice("abcxyz") + t[i + 1 :])(rnd.randrange(len(t)))
    left, right = [(i, "b", typo(rnd.choice(base))) for i in range(200)], [(i, "b", t) for i, t in enumerate(base)]
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        calls.add(len(a))
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    monkeypatch.setattr(linkage, "similarity", lambda a, b: counted(a, b))
    got = linkage.fuzzy(spark.createDataFrame(left, "left_id int, block string, name string"), spark.createDataFrame(right, "right_id int, block string, name string"), "block", "name")
    found = {r["left_id"]: (r["right_id"], r["score"]) for r in got.collect()}
    want, possible = {}, 0
    for i, _, x in left:
        best = max((difflib.SequenceMatcher(None, x, y).ratio(), -j) for j, _, y in right)
        possible += sum(difflib.SequenceMatcher(None, x, y).real_quick_ratio() >= 0.8 for _, _, y in right)
        if best[0] >= 0.8:
            want[i] = (-best[1], round(best[0], 4))
    assert {k: (v[0], round(v[1], 4)) for k, v in found.items()} == want
    assert calls.value * 10 < possible, (calls.value, possible)
