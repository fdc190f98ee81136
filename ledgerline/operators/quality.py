"""Data-quality rules as DataFrames of violations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerline.functions import codes


@dataclass(frozen=True)
class Check:
    """A named rule: a function from a table to the rows that break it."""

    name: str
    violations: Callable[[DataFrame], DataFrame]
    fatal: bool = True


@dataclass(frozen=True)
class RowRule:
    """A rule that looks at one row at a time: called with a table it gives the rows where `broken` is true; a report counts all such rules in one pass."""

    broken: Column

    def __call__(self, rows: DataFrame) -> DataFrame:
        return rows.filter(self.broken)


def duplicates(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(other: DataFrame, key: str, other_key: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.join(other.select(F.col(other_key).alias(key)).distinct(), key, "left_anti")


def dependency(left: str, right: str) -> Callable[[DataFrame], DataFrame]:
    """Values of `left` that stand with several values of `right`."""
    return lambda rows: rows.groupBy(left).agg(F.countDistinct(right).alias("n")).filter("n > 1")


def outside(column: str, low: float, high: float, null_ok: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Figures that aren't within the range; a NULL one isn't, unless null_ok."""
    return RowRule(F.coalesce(~F.col(column).between(low, high), F.lit(not null_ok)))


def gaps(group: str, order: str, first: int) -> Callable[[DataFrame], DataFrame]:
    """Groups whose numbers aren't first, first + 1, ... without repetition."""

    def find(rows: DataFrame) -> DataFrame:
        found = rows.groupBy(group).agg(F.min(order).cast("long").alias("low"), F.max(order).cast("long").alias("high"), F.count("*").alias("n"), F.countDistinct(order).alias("d"))
        return found.filter(f"low != {first} or high - low + 1 != n or d != n")

    return find


def report(rows: DataFrame, checks: list[Check]) -> DataFrame:
    """One row per rule: name, number of violations, passed. Rules of single rows share one scan."""
    found, single = None, [c for c in checks if isinstance(c.violations, RowRule)]
    if single:
        counted = rows.agg(*[F.count_if(c.violations.broken).alias(f"_{i}") for i, c in enumerate(single)])
        lines = [F.struct(F.lit(c.name).alias("check"), F.col(f"_{i}").alias("violations"), (F.col(f"_{i}") == 0).alias("passed"), F.lit(c.fatal).alias("fatal")) for i, c in enumerate(single)]
        found = counted.select(F.inline(F.array(*lines)))
    for c in checks:
        if any(c is s for s in single):
            continue
        one = c.violations(rows).agg(F.count("*").alias("violations")).select(F.lit(c.name).alias("check"), "violations", (F.col("violations") == 0).alias("passed"), F.lit(c.fatal).alias("fatal"))
        found = one if found is None else found.union(one)
    return found


def enforce(rows: DataFrame, checks: list[Check]) -> DataFrame:
    """The report; raises where a fatal rule is broken."""
    result = report(rows, checks)
    if broken := [r["check"] for r in result.filter("fatal and not passed").collect()]:
        raise ValueError(f"broken rules: {', '.join(broken)}")
    return result


def missing_cells(grid: DataFrame, keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Combinations of the grid that have no row, and rows beyond the grid."""

    def find(rows: DataFrame) -> DataFrame:
        have = rows.select(*keys).distinct()
        return grid.select(*keys).join(have, keys, "left_anti").withColumn("side", F.lit("missing")).union(have.join(grid, keys, "left_anti").withColumn("side", F.lit("beyond")))

    return find


def set_differences(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """key, absent_from: values that some of the sets have and others lack."""
    tagged = None
    for name, rows in sets.items():
        one = rows.select(key).distinct().withColumn("_set", F.lit(name))
        tagged = one if tagged is None else tagged.union(one)
    absent = F.array_sort(F.array_except(F.array(*map(F.lit, sets)), F.collect_set("_set")))
    return tagged.groupBy(key).agg(absent.alias("absent_from")).filter("size(absent_from) > 0")


def off_domain(column: str, values: list) -> Callable[[DataFrame], DataFrame]:
    return RowRule(F.col(column).isNotNull() & ~F.col(column).isin(values))


def not_number(column: str, sign: str = "any") -> Callable[[DataFrame], DataFrame]:
    """Rows that aren't a finite number; sign: any, not_negative or positive."""
    number = codes.number(F.col(column))
    low = {"any": F.lit(False), "not_negative": number < 0, "positive": number <= 0}[sign]
    return RowRule(number.isNull() | (F.abs(number) == float("inf")) | low)


def bad_code(column: str, width: int, prefix: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """Codes that aren't `width` digits, or don't start with the code in column `prefix`."""
    wrong = ~F.col(column).rlike(f"^[0-9]{{{width}}}$")
    return RowRule(F.coalesce(wrong | ~F.startswith(F.col(column), F.col(prefix)) if prefix else wrong, F.lit(True)))


def disagreements(other: DataFrame, key: str, columns: list[str]) -> Callable[[DataFrame], DataFrame]:
    """key, column, mine, theirs: attributes that differ between two tables (NULL equals NULL)."""

    def find(rows: DataFrame) -> DataFrame:
        theirs = other.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("mine"), F.col(f"_{c}").cast("string").alias("theirs")) for c in columns])
        both = rows.select(key, *columns).join(theirs, key).select(key, F.inline(F.filter(cells, lambda x: ~x["mine"].eqNullSafe(x["theirs"]))))
        return both

    return find


def one_without_other(left: Column, right: Column) -> Callable[[DataFrame], DataFrame]:
    """Rows where exactly one of two conditions holds; for a status and its value, or two that go together."""
    return RowRule(~left.eqNullSafe(right))


def parts_beyond(total: str, parts: list[str], null_ok: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Totals that aren't the sum of their parts; with a part missing, totals below the rest. A NULL total is none, unless null_ok."""
    known = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0)))
    some = F.concat(*[F.col(p).cast("string") for p in parts]).isNull()
    return RowRule(F.coalesce(F.when(some, F.col(total) < known).otherwise(F.col(total) != known), F.lit(not null_ok)))


def unexpected_count(expected: int) -> Callable[[DataFrame], DataFrame]:
    """One row with the count, if it isn't the expected one."""
    return lambda rows: rows.agg(F.count("*").alias("n")).filter(F.col("n") != expected)


def unlike(pinned: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The symmetric difference from a pinned set of rows with the same columns."""
    return lambda rows: rows.exceptAll(pinned).withColumn("side", F.lit("new")).union(pinned.exceptAll(rows).withColumn("side", F.lit("gone")))


def off_tolerance(left: str, right: str, relative: float, null_ok: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Rows whose two figures differ by more than a share of the second; a NULL one differs, unless null_ok."""
    return RowRule(F.coalesce(F.abs(F.col(left) - F.col(right)) > F.abs(F.col(right)) * relative, F.lit(not null_ok)))


def count_gaps(stated: DataFrame, details: DataFrame, key: str, count: str) -> DataFrame:
    """key, stated, found: a summary's counts that its detail rows don't bear out; to be reported, not raised."""
    found = details.groupBy(key).agg(F.count("*").alias("found"))
    both = stated.select(key, F.col(count).alias("stated")).join(found, key, "full").fillna(0, ["found"])
    return both.filter(~F.col("stated").eqNullSafe(F.col("found")))


def unexpected_counts(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """name, expected, n: counts (name, n) that differ from a table of expectations (name, expected), or stand on one side alone."""
    both = counts.select("name", "n").join(expected.select("name", "expected"), "name", "full")
    return both.filter(~F.col("expected").eqNullSafe(F.col("n"))).select("name", "expected", "n")


def examples(violations: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first n rows that break a rule, in a fixed order, for a report."""
    return violations.orderBy(*order).limit(n)


def ragged(cells: str, width: int) -> Callable[[DataFrame], DataFrame]:
    """Rows whose array of cells doesn't have `width` elements, or lacks one."""
    return RowRule(F.coalesce((F.size(cells) != width) | F.exists(cells, lambda c: c.isNull()), F.lit(True)))


def observe_zeros(rows: DataFrame, name: str, columns: list[str]) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that holds the number of zeros of each column once an action has read them: for logs, without a scan of its own."""
    seen = Observation(name)
    return rows.observe(seen, *[F.count_if(F.col(c) == 0).alias(c) for c in columns]), seen
