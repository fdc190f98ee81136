"""Exact quantiles by rank selection in passes: counts of ranges, then only the range that holds the rank.

Doubles are mapped to whole numbers of the same order. A first pass takes each group's count, least and greatest; each further one divides the ranges that
hold a wanted rank into BINS equal parts, counts them ahead of the shuffle, and goes on with the part that holds it, until a range has no more than
FEW rows or is one number. The rows of the last ranges are counted by value and put in order. So a group is never in one task or buffer, however many
rows it has and however many of them are equal; what is shuffled are counts, and at most FEW values for each rank. All ranks of all
groups go through the same passes, of which there are six at most; groups of FEW rows or fewer need none.

NULL and NaN are no values. Groups without a value don't appear. -0.0 and 0.0 are one value.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.plans.lineage import cut

BINS = 4_096
FEW = 4_096


def order_key(x: Column) -> Column:
    """A long that rises with the double: sign, exponent, and the mantissa without its last two places (neighbouring doubles may share one)."""
    size = F.abs(x)
    small = size < 2.0**-1000  # subnormal ones too
    y = F.when(small, size * 2.0**200).otherwise(size)
    guess = F.least(F.lit(1023.0), F.floor(F.log2(y)).cast("double"))
    # The logarithm may miss a power of two by one.
    exponent = F.when(F.pow(F.lit(2.0), guess) > y, guess - 1).when((guess < 1023) & (F.pow(F.lit(2.0), guess + 1) <= y), guess + 1).otherwise(guess)
    mantissa = ((y / F.pow(F.lit(2.0), exponent) - 1) * 2.0**50).cast("long")
    key = F.shiftleft((exponent - F.when(small, 200).otherwise(0) + 1075).cast("long"), 50) + mantissa
    infinite = F.lit(2200 << 50)  # differences of keys fit a long
    return F.when(size == 0, F.lit(0)).otherwise(F.when(size == float("inf"), infinite).otherwise(key) * F.signum(x).cast("long"))


def _same(left: str, right: str, own: list[str]) -> Column:
    """Whether the group columns of two aliased tables are equal, NULLs too."""
    return functools.reduce(Column.__and__, [F.col(f"{left}.{g}").eqNullSafe(F.col(f"{right}.{g}")) for g in own])


def _open(prefix: str = "") -> Column:
    return (F.col(f"{prefix}_in") > FEW) & (F.col(f"{prefix}_hi") > F.col(f"{prefix}_lo"))


def elements(rows: DataFrame, keys: list[str], value: str, ranks: Column) -> DataFrame:
    """keys, n, rank, element: the element at each place of `ranks` (an array of longs from 0, an expression of n) among a group's ascending values."""
    x, groups = F.col(value).cast("double"), [F.col(k) for k in keys] or [F.lit(0)]
    own = [f"_g{i}" for i in range(len(groups))]
    values = rows.select(*[g.alias(name) for g, name in zip(groups, own, strict=True)], x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    values = cut(values.withColumn("_k", order_key(F.col("_x"))), "values")
    whole = values.groupBy(*own).agg(F.count("*").alias("n"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi")).filter("n > 0")
    state = whole.select(*own, "n", F.explode(F.array_distinct(ranks)).alias("rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.col("n").alias("_in"))
    state = cut(state.filter("rank >= 0 and rank < n"), "ranks")
    while not state.filter(_open()).isEmpty():
        # One range for each rank at most; the ranges of a group don't overlap, so that a row falls in one of them or none.
        ranges = state.filter(_open()).groupBy(*own).agg(F.collect_set(F.struct("_lo", "_hi")).alias("_ranges")).alias("r")
        found = values.alias("v").join(ranges, _same("v", "r", own)).select("v.*", F.get(F.filter("_ranges", lambda r: F.col("_k").between(r["_lo"], r["_hi"])), F.lit(0)).alias("_r"))
        step = F.expr(f"(_r._hi - _r._lo) div {BINS} + 1")
        counts = found.filter("_r is not null").groupBy(*own, F.col("_r._lo").alias("_lo"), F.expr("_r._hi").alias("_hi"), step.alias("_step"), F.expr("_k - _r._lo").alias("_off") - F.expr("_k - _r._lo") % step).count()
        counts = counts.toDF(*own, "_lo", "_hi", "_step", "_off", "_c")
        upto = F.sum("_c").over(Window.partitionBy(*own, "_lo").orderBy("_off"))  # BINS rows at most
        counts = counts.withColumn("_upto", upto).alias("c")
        hit = state.alias("s").join(counts, _same("s", "c", own) & (F.col("s._lo") == F.col("c._lo")) & _open("s."), "left")
        at = F.col("s.rank") - F.col("s._before")
        hit = hit.filter(F.col("c._c").isNull() | ((at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_c"))))
        low = F.col("s._lo") + F.coalesce("_off", F.lit(0))
        high = F.when(F.col("_off").isNull(), F.col("s._hi")).otherwise(F.least(F.col("s._hi"), low + F.col("_step") - 1))
        before = F.col("s._before") + F.coalesce(F.col("_upto") - F.col("_c"), F.lit(0))
        state = cut(hit.select(*[F.col(f"s.{g}") for g in own], "s.n", "s.rank", low.alias("_lo"), high.alias("_hi"), before.alias("_before"), F.coalesce("_c", "_in").alias("_in")), "ranks")
    ranges = state.groupBy(*own).agg(F.collect_set(F.struct("_lo", "_hi")).alias("_ranges")).alias("r")
    found = values.alias("v").join(ranges, _same("v", "r", own)).select("v.*", F.explode(F.filter("_ranges", lambda r: F.col("_k").between(r["_lo"], r["_hi"]))).alias("_r"))
    placed = found.groupBy(*own, F.col("_r._lo").alias("_lo"), F.col("_r._hi").alias("_hi"), "_x").agg(F.count("*").alias("_c"))
    placed = placed.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*own, "_lo", "_hi").orderBy("_x"))).alias("p")
    at = F.col("s.rank") - F.col("s._before")
    hit = state.alias("s").join(placed, _same("s", "p", own) & (F.col("s._lo") == F.col("p._lo")) & (F.col("s._hi") == F.col("p._hi")))
    hit = hit.filter((at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_c")))
    return hit.select(*[F.col(f"s.{g}").alias(k) for g, k in zip(own, keys)], "s.n", "s.rank", F.col("p._x").alias("element"))


def quantiles(rows: DataFrame, keys: list[str], value: str, fractions: list[float]) -> DataFrame:
    """keys, n, quantiles: the quantiles at `fractions` of each group by linear interpolation between the two nearest elements."""
    places = F.array(*[F.lit(float(q)) for q in fractions])
    position = lambda q: (F.col("n") - 1) * q
    ranks = F.flatten(F.transform(places, lambda q: F.array(F.floor(position(q)).cast("long"), F.ceil(position(q)).cast("long"))))
    found = elements(rows, keys, value, ranks)
    # Two elements for each fraction at most.
    found = found.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "element"))).alias("_at"))

    def between(q: Column) -> Column:
        p = position(q)
        low, high = F.floor(p).cast("long"), F.ceil(p).cast("long")
        a, b = F.col("_at")[low], F.col("_at")[high]
        return F.when((low == high) | (a == b), a).otherwise((high - p) * a + (p - low) * b)

    return found.select(*keys, "n", F.transform(places, between).alias("quantiles"))


def element(rows: DataFrame, keys: list[str], value: str, fraction: float) -> DataFrame:
    """keys, n, quantile: the element at place int(n * fraction) of each group's sorted values, without interpolation."""
    place = F.array(F.least(F.col("n") - 1, F.floor(F.col("n") * fraction)).cast("long"))
    return elements(rows, keys, value, place).select(*keys, "n", F.col("element").alias("quantile"))


def class_edges(rows: DataFrame, keys: list[str], value: str, classes: int = 7) -> DataFrame:
    """keys, edges: classes + 1 edges by linear interpolation; zeros for a group without values."""
    found = quantiles(rows, keys, value, [i / classes for i in range(classes + 1)]).alias("q")
    groups = rows.select(*keys).distinct().alias("g")
    both = groups.join(found, _same("g", "q", keys), "left")
    return both.select(*[F.col(f"g.{k}") for k in keys], F.coalesce("q.quantiles", F.array(*[F.lit(0.0)] * (classes + 1))).alias("edges"))
