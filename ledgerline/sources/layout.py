"""Worksheets as a table of cells (sheet, row, col, value): headers, blocks and unpivoted measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.blocks import column_map


def header(cells: DataFrame, first: int, last: int) -> DataFrame:
    """sheet, col, label: the header rows' labels of a column, without the line breaks in them, merged cells filled from the left, joined by a slash."""
    rows = cells.filter(F.col("row").between(first, last)).withColumn("value", F.regexp_replace("value", "[\r\n]", ""))
    left = Window.partitionBy("sheet", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("value", F.last(F.when(F.trim("value") != "", F.trim("value")), ignorenulls=True).over(left)).filter("value is not null")
    parts = F.array_sort(F.collect_list(F.struct("row", "value")))
    return filled.groupBy("sheet", "col").agg(F.array_join(F.array_distinct(F.transform(parts, lambda p: p["value"])), "/").alias("label"))


def body(cells: DataFrame, first: int, key_col: int) -> DataFrame:
    """sheet, row, col, key, value from row `first` on; the key of a row stands in `key_col`, rows without one are no data."""
    rows = cells.filter(F.col("row") >= first)
    keys = rows.filter((F.col("col") == key_col) & (F.trim("value") != "")).select("sheet", "row", F.trim("value").alias("key"))
    return rows.filter(F.col("col") != key_col).join(keys, ["sheet", "row"])


def tidy(cells: DataFrame, header_rows: tuple[int, int], key_col: int) -> DataFrame:
    """One row per key and labelled column."""
    return body(cells, header_rows[1] + 1, key_col).join(header(cells, *header_rows), ["sheet", "col"]).select("sheet", "key", "label", "value")


def relations(cells: DataFrame, header_rows: tuple[int, int], key_col: int, classify: Column) -> DataFrame:
    """sheet, key, the members of the struct that `classify` makes of a column's label, value: the relations that stand side by side in a sheet.

    Columns that it finds none for (derived ones) go; a relation is then a filter on its name.
    """
    columns = column_map(header(cells, *header_rows), classify).withColumnRenamed("key", "_is").drop("label")
    return body(cells, header_rows[1] + 1, key_col).join(columns, ["sheet", "col"]).select("sheet", "key", "_is.*", "value")
