"""Joins with a status, vintages side by side, roll-ups, complete grids, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.measures import ratio


def join_status(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Full outer join of two key sets: matched, left_only or right_only."""
    a = left.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(True))
    status = F.when(F.col("_a") & F.col("_b"), "matched").when(F.col("_a"), f"{names[0]}_only").otherwise(f"{names[1]}_only")
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def vintages(rows: DataFrame, keys: list[str], vintage: str, old, new, measure: Column) -> DataFrame:
    """One shuffle: the measure of two vintages side by side, their difference and whether they agree."""
    at = lambda v: F.sum(F.when(F.col(vintage) == v, measure))
    wide = rows.filter(F.col(vintage).isin(old, new)).groupBy(*keys).agg(at(old).alias("old_value"), at(new).alias("new_value"))
    return wide.withColumn("difference", F.col("new_value") - F.col("old_value"))


def reconcile(parts: DataFrame, totals: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Sums of parts against published totals: both values and whether they agree within a relative tolerance."""
    summed = parts.groupBy(*keys).agg(F.sum(value).alias("part_sum"))
    both = summed.join(totals.withColumnRenamed(value, "total"), keys, "full")
    gap = F.abs(F.col("part_sum") - F.col("total"))
    return both.withColumn("agrees", F.coalesce(gap <= tolerance * F.greatest(F.abs("part_sum"), F.abs("total")), F.lit(False)))


def complete_grid(rows: DataFrame, axes: list[DataFrame], keys: list[str]) -> DataFrame:
    """Every combination of small code lists, with the rows' columns or NULL."""
    grid = axes[0]
    for axis in axes[1:]:
        grid = grid.crossJoin(axis)  # code lists, whose product is the grid itself
    return grid.join(rows, keys, "left")


def override(rows: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """`column` with corrections (key, new value) applied and a flag where one was."""
    fixed = corrections.select(key, F.col(column).alias("_new"))
    return rows.join(fixed, key, "left").withColumn("overridden", F.col("_new").isNotNull()).withColumn(column, F.coalesce("_new", column)).drop("_new")


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank; Spark limits groups before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def one_to_one(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Tables with one row per key side by side: every key once, `missing` names the tables that lack it."""
    out = None
    for name, rows in tables.items():
        marked = rows.withColumn(f"_{name}", F.lit(True))
        out = marked if out is None else out.join(marked, key, "full")
    missing = F.array_compact(F.array(*[F.when(F.col(f"_{name}").isNull(), F.lit(name)) for name in tables]))
    return out.withColumn("missing", missing).drop(*[f"_{name}" for name in tables])


def corroborate(claims: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct claims with `confirmed`: whether the independent evidence has them too."""
    seen = evidence.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return claims.select(*keys).distinct().join(seen, keys, "left").select(*keys, F.col("_seen").isNotNull().alias("confirmed"))


def bijection_errors(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """side, value, n: values of either side that stand with several of the other."""

    def side(a: str, b: str) -> DataFrame:
        return pairs.groupBy(F.col(a).cast("string").alias("value")).agg(F.countDistinct(b).alias("n")).filter("n > 1").select(F.lit(a).alias("side"), "value", "n")

    return side(left, right).union(side(right, left))


def rate_extremes(rows: DataFrame, key: str, hit: Column) -> DataFrame:
    """place (lowest or highest), key, rate: the groups with the extreme shares of rows that `hit`; ties to the smaller key, no rows give none."""
    rates = rows.groupBy(key).agg(ratio(F.count_if(hit), F.count("*"), 6).alias("rate"))
    # Two rows of one struct each, so that no sort of the groups is needed.
    ends = rates.agg(F.min(F.struct("rate", key)).alias("_low"), F.min(F.struct((-F.col("rate")).alias("rate"), F.col(key))).alias("_high"))
    each = [F.struct(F.lit(name).alias("place"), F.col(f"{at}.{key}").alias(key), (F.col(f"{at}.rate") * sign).alias("rate")) for name, at, sign in (("lowest", "_low", 1), ("highest", "_high", -1))]
    return ends.select(F.inline(F.array(*each))).filter("rate is not null")


def residual_splits(rows: DataFrame, parent: str, child: str, verified: DataFrame) -> DataFrame:
    """parent, child: pairs of parents with several children that no row of `verified` confirms."""
    pairs = rows.select(parent, child).distinct()
    several = pairs.groupBy(parent).agg(F.count("*").alias("_n")).filter("_n > 1")
    return pairs.join(several, parent, "left_semi").join(verified.select(parent, child), [parent, child], "left_anti")


def nesting_errors(rows: DataFrame, child: str, parent: str, fits: Column) -> DataFrame:
    """child, parents, unfit: children that stand under several parents, or under one that `fits` says is not theirs."""
    pairs = rows.filter(F.col(child).isNotNull() & F.col(parent).isNotNull()).select(child, parent).distinct()
    found = pairs.groupBy(child).agg(F.count("*").alias("parents"), F.count_if(~F.coalesce(fits, F.lit(False))).alias("unfit"))
    return found.filter("parents > 1 or unfit > 0")


def vintage_measures(rows: DataFrame, keys: list[str], picks: dict[str, tuple[str, str, int]], equal: dict[str, list[tuple[str, str, int]]]) -> DataFrame:
    """keys, a column for each of `picks` (vintage, measure, year) and of `equal`: figures of several vintages side by side, from one shuffle.

    rows: keys, vintage, measure, year, value. The figures that a column of `equal` names must be one and the same (NULL is a figure of its own), or the row raises
    when it is read: no side is taken in silence.
    """
    at = lambda p: F.max(F.when((F.col("vintage") == p[0]) & (F.col("measure") == p[1]) & (F.col("year") == p[2]), F.col("value")))
    own = {name: at(p) for name, p in picks.items()} | {f"_{name}_{i}": at(p) for name, several in equal.items() for i, p in enumerate(several)}
    wide = rows.groupBy(*keys).agg(*[c.alias(name) for name, c in own.items()])
    for name, several in equal.items():
        same = F.lit(True)
        for i in range(1, len(several)):
            same = same & F.col(f"_{name}_0").eqNullSafe(F.col(f"_{name}_{i}"))
        where = F.concat_ws(", ", *[F.concat(F.lit(f"{k} "), F.col(k).cast("string")) for k in keys])
        wrong = F.raise_error(F.concat(F.lit(f"{name} differs between vintages: "), where)).cast(rows.schema["value"].dataType)
        wide = wide.withColumn(name, F.when(same, F.col(f"_{name}_0")).otherwise(wrong))
    return wide.select(*keys, *picks, *equal)


def crosswalk_drift(status: DataFrame, key: str, crosswalk: DataFrame, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """side, code, problem: where a crosswalk (old, new) doesn't cover what a join left over: status is of join_status(), whose left side has the new codes.

    Codes left over on either side must be those of the crosswalk's columns and no others: `uncovered` ones have no entry, `stale` ones are no longer left over.
    """
    found = None
    for side, column in ((names[0], "new"), (names[1], "old")):
        left = status.filter(F.col("status") == f"{side}_only").select(F.col(key).cast("string").alias("code"))
        mapped = crosswalk.select(F.col(column).cast("string").alias("code")).filter("code is not null").distinct()
        one = left.join(mapped, "code", "left_anti").withColumn("problem", F.lit("uncovered")).union(mapped.join(left, "code", "left_anti").withColumn("problem", F.lit("stale")))
        one = one.select(F.lit(side).alias("side"), "code", "problem")
        found = one if found is None else found.union(one)
    return found
