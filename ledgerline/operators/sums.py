"""Sums of doubles without rounding: the same result for any order and partitioning, equal to the exact sum rounded once.

A double is cut into three whole numbers of 32 bits or fewer, for bins of 32 binary places; the bin of the first is known from the exponent. Rows are
grouped by it and the whole numbers are added as longs in halves of 16 bits, ahead of the shuffle and without rounding: their sums fit a long for
2 ** 46 rows. A group has at most 70 such rows, which are folded into digits of 16 bits with their carries; the first digits, and whether anything
follows them, give the double nearest to the sum (ties to even). All of it is arithmetic of columns.

Doubles of any magnitude count, subnormal ones too. NULLs don't count; a group without any value has a NULL sum, one of zeros 0.0. With a NaN, or infinities of
both signs, the sum is NaN; with one infinity it is that infinity. A sum beyond the largest double is an infinity, whatever the order: sums on the way
can't overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary places of a bin, and of a digit.
BIN, DIGIT = 32, 16
#: Values below this are multiplied by 2 ** LIFT, so that no power on the way is below the smallest double.
SMALL, LIFT = 2.0**-512, 640
_INFINITE = float("inf")


def _power(exponent: Column) -> Column:
    """2 ** exponent, exactly."""
    return F.pow(F.lit(2.0), exponent.cast("double"))


def with_parts(rows: DataFrame, value: str) -> DataFrame:
    """`rows` with _bin (NULL where the value is NULL, 0 or not finite) and _p0, _p1, _p2: value = (_p0 + _p1 / 2 ** 32 + _p2 / 2 ** 64) * 2 ** (32 * _bin)."""
    x = F.col(value)
    small = F.abs(x) < SMALL
    finite = x.isNotNull() & (x != 0) & ~F.isnan(x) & (F.abs(x) < _INFINITE)
    rows = rows.withColumn("_y", F.when(finite, F.when(small, x * 2.0**LIFT).otherwise(x)))
    # The logarithm may miss a bin's edge by a little; three bins hold all 53 places all the same.
    rows = rows.withColumn("_b", F.floor(F.log2(F.abs("_y")) / BIN)).withColumn("_u", _power(F.col("_b") * BIN))
    rows = rows.withColumn("_p0", (F.col("_y") / F.col("_u")).cast("long")).withColumn("_r", (F.col("_y") - F.col("_p0") * F.col("_u")) / F.col("_u") * 2.0**BIN)
    rows = rows.withColumn("_p1", F.col("_r").cast("long")).withColumn("_p2", ((F.col("_r") - F.col("_p1")) * 2.0**BIN).cast("long"))
    return rows.withColumn("_bin", (F.col("_b") - F.when(small, LIFT // BIN).otherwise(0)).cast("int")).drop("_y", "_b", "_u", "_r")


def _folded(cells: str) -> Column:
    """The double nearest to the sum of s * 2 ** (16 * at) over an array of (at, s), which is not empty."""
    # From the lowest place up; four places more take what a long carries, one the sign.
    places = f"sequence(array_min(transform({cells}, c -> c.at)), array_max(transform({cells}, c -> c.at)) + 5)"
    digits = lambda sign: (
        f"aggregate({places}, named_struct('carry', 0L, 'd', cast(array() as array<int>)), (acc, k) -> named_struct("
        f"'carry', shiftright(acc.carry + {sign} coalesce(aggregate(filter({cells}, c -> c.at = k), 0L, (n, c) -> n + c.s), 0L), {DIGIT}), "
        f"'d', array_append(acc.d, cast((acc.carry + {sign} coalesce(aggregate(filter({cells}, c -> c.at = k), 0L, (n, c) -> n + c.s), 0L)) & {(1 << DIGIT) - 1} as int))))"
    )
    return F.expr(f"transform(array({digits('')}), r -> if(r.carry < 0, named_struct('sign', -1.0D, 'd', {digits('-')}.d), named_struct('sign', 1.0D, 'd', r.d)))[0]")


def _rounded(folded: str, lowest: str) -> Column:
    """The double of a sign and of digits from the lowest place up."""
    d = f"{folded}.d"
    top = f"aggregate(sequence(0, size({d}) - 1), -1, (m, i) -> if({d}[i] != 0, i, m))"
    at = lambda k: f"coalesce(get({d}, t - {k}), 0)"
    rest = f"if(exists(slice({d}, 1, greatest(t - 4, 0)), x -> x != 0), 0.5D, 0.0D)"
    front = f"({at(0)} * 4294967296.0D + {at(1)} * 65536.0D + {at(2)})"
    back = f"(({at(3)} * 65536.0D + {at(4)} + {rest}) / 4294967296.0D)"
    # Both are exact, so their sum is rounded once; the power is applied in two steps, neither of which rounds.
    power = f"{DIGIT} * ({lowest} + t - 2)"
    scaled = f"({front} + {back}) * pow(2.0D, greatest(-900, least(900, {power}))) * pow(2.0D, {power} - greatest(-900, least(900, {power})))"
    return F.expr(f"transform(array({top}), t -> if(t < 0, 0.0D, {folded}.sign * {scaled}))[0]")


def exact_sums(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """The keys and the exact sums, one row for each group (one row in all without keys)."""
    named = F.array(*[F.struct(F.lit(name).alias("_name"), value.cast("double").alias("_x")) for name, value in sums.items()])
    parts = with_parts(rows.select(*keys, F.inline(named)), "_x")
    halves = [half for i in range(3) for half in (F.sum(F.col(f"_p{i}").bitwiseAND((1 << DIGIT) - 1)).alias(f"_l{i}"), F.sum(F.shiftright(f"_p{i}", DIGIT)).alias(f"_h{i}"))]
    odd = F.when(F.isnan("_x") | (F.abs("_x") == _INFINITE), F.col("_x"))
    binned = parts.groupBy(*keys, "_name", "_bin").agg(F.count("_x").alias("_n"), F.sum(odd).alias("_odd"), *halves)
    cells = F.array(*[F.struct((F.col("_bin") * 2 - 2 * i + j).alias("at"), F.col(f"_{half}{i}").alias("s")) for i in range(3) for j, half in enumerate("lh")])
    whole = binned.groupBy(*keys, "_name").agg(
        F.sum("_n").alias("_n"), F.sum("_odd").alias("_odd"), F.flatten(F.collect_list(F.when(F.col("_bin").isNotNull(), cells))).alias("_cells")
    )
    whole = whole.withColumn("_low", F.array_min(F.transform("_cells", lambda c: c["at"]))).withColumn("_fold", F.when(F.size("_cells") > 0, _folded("_cells")))
    value = F.when(F.col("_n") == 0, None).when(F.col("_odd").isNotNull(), F.col("_odd")).when(F.size("_cells") == 0, F.lit(0.0)).otherwise(_rounded("_fold", "_low"))
    whole = whole.select(*keys, "_name", value.alias("_sum"))
    return whole.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_sum"))).alias(name) for name in sums])
