"""Exact sums and quantiles against fractions and Spark's own percentile, whatever the magnitudes, the partitioning and the skew."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import quantiles, sums

TINY = 5e-324


def groups():
    rnd = random.Random(1)
    kinds = [
        lambda: rnd.uniform(-1, 1) * 10.0 ** rnd.randrange(-300, 300),
        lambda: rnd.choice([1e300, -1e300, 1e-300, TINY, -TINY, 1.0]),
        lambda: rnd.choice([1.0, 2.0**-53, 2.0**-54, -(2.0**-53), 2.0**-106]),
        lambda: rnd.uniform(-1, 1) * TINY * rnd.randrange(1, 2**52),
        lambda: math.nextafter(2.0 ** rnd.choice([32, 64, -32, 0, 31, 96]), rnd.choice([0, 1e300])) * rnd.choice([1, -1]),
        lambda: float(rnd.randrange(-(10**18), 10**18)),
        lambda: rnd.choice([0.0, -0.0, None]),
    ]
    found = {g: [kinds[g % len(kinds)]() for _ in range(rnd.choice([1, 2, 3, 40]))] for g in range(140)}
    found |= {900: [1e-6] + [4e-17] * 1000, 901: [1e308, 1e308, -1e308], 902: [1e308, 1e308], 903: [math.inf, 1.0], 904: [math.inf, -math.inf], 905: [math.nan, 1.0], 906: [None], 907: [0.1] * 10}
    return found


def exact(values):
    values = [v for v in values if v is not None]
    if not values:
        return None
    if not all(map(math.isfinite, values)):
        return sum(values)
    total = sum(map(Fraction, values))
    try:
        return float(total)
    except OverflowError:
        return math.inf if total > 0 else -math.inf


@pytest.mark.parametrize("partitions", [1, 7])
def test_sums(spark, partitions):
    rows = [(g, v) for g, values in groups().items() for v in values]
    random.Random(partitions).shuffle(rows)
    table = spark.createDataFrame(rows, "g int, v double").repartition(partitions)
    got = {r["g"]: (r["s"], r["t"]) for r in sums.exact_sums(table, ["g"], {"s": F.col("v"), "t": -F.col("v")}).collect()}
    want = {g: exact(values) for g, values in groups().items()}
    assert got.keys() == want.keys()
    for g, w in want.items():
        assert got[g] == (None if w is None else pytest.approx(w, rel=0, abs=0, nan_ok=True), None if w is None else pytest.approx(-w, rel=0, abs=0, nan_ok=True)), g
    assert want[900] == math.fsum(groups()[900]) != 1e-6


def test_sums_without_groups_or_rows(spark):
    table = spark.createDataFrame([(None, 1e16), (None, 1.0), (None, -1e16)], "g int, v double")
    assert sums.exact_sums(table, [], {"s": F.col("v")}).first()["s"] == 1.0
    assert [tuple(r) for r in sums.exact_sums(table, ["g"], {"s": F.col("v")}).collect()] == [(None, 1.0)]
    assert sums.exact_sums(table.limit(0), ["g"], {"s": F.col("v")}).count() == 0


def test_order_keys(spark):
    rnd = random.Random(3)
    values = [0.0, TINY, 1e-310, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf] + [x for k in range(-1060, 1024, 13) for x in (2.0**k, math.nextafter(2.0**k, 0))]
    values = sorted({s * v for v in values + [rnd.uniform(0, 1) * 10.0 ** rnd.randrange(-300, 300) for _ in range(500)] for s in (1, -1)})
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", quantiles.order_key(F.col("v")).alias("k")).orderBy("i").collect()
    assert all(a["k"] <= b["k"] for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize(("bins", "few"), [(4096, 4096), (16, 5), (3, 1)])
def test_quantiles_of_a_hot_group(spark, monkeypatch, bins, few):
    """One group has most of the rows, and one value most of the group; some groups are one value or none."""
    monkeypatch.setattr(quantiles, "BINS", bins)
    monkeypatch.setattr(quantiles, "FEW", few)
    rnd = random.Random(1)
    rows = [("hot", rnd.choice([1.5, 1.5, 1.5, rnd.uniform(-5, 5), rnd.gauss(0, 1) * 10.0 ** rnd.randrange(-20, 20)])) for _ in range(9000)]
    rows += [("small", float(i)) for i in range(7)] + [(None, float(i % 3)) for i in range(50)] + [("nothing", None), ("nothing", math.nan), ("near", 1.0), ("near", math.nextafter(1.0, 2))]
    rows += [("ties", 3.0)] * 5000 + [("two", rnd.choice([1.0, math.nextafter(1.0, 2)])) for _ in range(5001)] + [("odd", v) for v in (-math.inf, math.inf, -0.0, 0.0, TINY)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(5)
    at = [0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1]
    want = table.filter("v is not null and not isnan(v)").groupBy("g").agg(F.count("*").alias("n"), F.percentile("v", F.array(*[F.lit(float(q)) for q in at])).alias("q"))
    got = quantiles.quantiles(table, ["g"], "v", at)
    assert {r["g"]: (r["n"], r["quantiles"]) for r in got.collect()} == {r["g"]: (r["n"], r["q"]) for r in want.collect()}


def test_quantiles_without_groups_or_rows(spark):
    table = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "g string, v double")
    assert [tuple(r) for r in quantiles.quantiles(table, [], "v", [0.5]).collect()] == [(2, [1.5])]
    assert quantiles.quantiles(table.limit(0), ["g"], "v", [0.5]).count() == 0
    assert {r["g"]: r["edges"] for r in quantiles.class_edges(table, ["g"], "v", 2).collect()} == {"a": [1.0] * 3, "b": [2.0] * 3, "c": [0.0] * 3}
    assert [tuple(r) for r in quantiles.element(table, ["g"], "v", 0.99).orderBy("g").collect()] == [("a", 1, 1.0), ("b", 1, 2.0)]
