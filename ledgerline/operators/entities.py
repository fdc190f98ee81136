"""Entity tables side by side without a shuffle: tables bucketed and sorted by the entity's key, merged bucket by bucket.

Each table is written once, dealt into the same number of buckets by the key. The first table is the register: the others are reduced to one row for each key and
merged into it, all where the buckets are; who lacks a key or repeats it, and which shared measures disagree, come from the same pass as the joined
row. Keys beyond the register are found by anti-joins of the key columns, without a shuffle either. A key with many rows in one table is counted, not
multiplied. A null key meets nothing.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucketed(rows: DataFrame, name: str, key: str, buckets: int = 64) -> DataFrame:
    """`rows` as the catalogue's table `name`, in buckets by `key`: one shuffle, once, for all later joins."""
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)


def side_by_side(tables: dict[str, DataFrame], key: str, shared: list[str]) -> DataFrame:
    """One row for each key of the first table: key, a struct of each table's columns (NULL where it has no row), missing, repeated (names of tables), differences.

    differences: of the measures in `shared`, those that tables with the key state differently, as a map of measure to a map of table to value; NULL is a value of its own.
    Of repeated rows the smallest stands.
    """
    columns = {name: [c for c in rows.columns if c != key] for name, rows in tables.items()}
    each = [rows.groupBy(key).agg(F.min(F.struct(*columns[n])).alias(n), F.count(F.lit(1)).alias(f"_n_{n}")) for n, rows in tables.items()]
    # Both sides are bucketed, so that a merge needs no exchange; a broadcast would.
    met = functools.reduce(lambda left, right: left.join(right.hint("merge"), key, "left"), each)
    count = lambda n: F.coalesce(f"_n_{n}", F.lit(0))
    named = lambda test: F.array_compact(F.array(*[F.when(test(count(n)), F.lit(n)) for n in tables]))

    def said(measure: str) -> Column:
        values = [F.when(count(n) > 0, F.struct(F.lit(n).alias("key"), F.col(f"{n}.{measure}").cast("string").alias("value"))) for n in tables if measure in columns[n]]
        return F.array_compact(F.array(*values))

    stated = F.array(*[F.struct(F.lit(m).alias("key"), said(m).alias("value")) for m in shared])
    unlike = F.filter(stated, lambda s: F.exists(s["value"], lambda v: ~v["value"].eqNullSafe(F.get(s["value"], F.lit(0))["value"])))
    differences = F.map_from_entries(F.transform(unlike, lambda s: F.struct(s["key"], F.map_from_entries(s["value"]).alias("value"))))
    return met.select(key, *tables, named(lambda n: n == 0).alias("missing"), named(lambda n: n > 1).alias("repeated"), differences.alias("differences"))


def beyond(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """key, table: the keys of each other table that the first one lacks."""
    first, *others = tables
    keys = tables[first].select(key)
    return functools.reduce(DataFrame.union, [tables[n].select(key).join(keys.hint("merge"), key, "left_anti").groupBy(key).agg(F.lit(n).alias("table")) for n in others])


def disagreements(tables: dict[str, DataFrame], key: str, shared: list[str]) -> DataFrame:
    """key, problem: for each key of the first table the tables that lack it or repeat it and the measures that differ, and the keys beyond it."""
    told = [F.transform(c, functools.partial(lambda c, n: F.concat(F.lit(f"{c} in "), n), c)) for c in ("missing", "repeated")]
    differ = F.transform(F.map_keys("differences"), lambda m: F.concat(F.lit("different "), m))
    found = side_by_side(tables, key, shared).select(key, F.explode(F.concat(*told, differ)).alias("problem"))
    return found.union(beyond(tables, key).select(key, F.concat(F.lit("only in "), "table")))
