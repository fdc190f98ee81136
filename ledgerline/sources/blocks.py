"""Repeating blocks, lists and runs in tables of cells (sheet, row, col, value).

A layout is checked by data: each function returns rows, or the rows that break the layout, and never stops at the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import codes


def fixed_blocks(cells: DataFrame, first_row: int, size: int, count: int) -> DataFrame:
    """Cells with block (from 0) and place (row within the block); those outside the blocks go."""
    inside = cells.filter(F.col("row").between(first_row, first_row + size * count - 1))
    offset = F.col("row") - first_row
    return inside.withColumn("block", F.floor(offset / size).cast("int")).withColumn("place", (offset % size).cast("int"))


def block_number_errors(blocks: DataFrame, count: int, first_number: int, number_col: int) -> DataFrame:
    """sheet, block, expected, number: blocks whose first row doesn't hold the next number of the sequence."""
    wanted = blocks.select("sheet").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    numbers = blocks.filter((F.col("place") == 0) & (F.col("col") == number_col)).select("sheet", "block", F.col("value").try_cast("int").alias("number"))
    both = wanted.join(numbers, ["sheet", "block"], "left").withColumn("expected", F.col("block") + first_number)
    return both.filter(~F.col("expected").eqNullSafe(F.col("number"))).select("sheet", "block", "expected", "number")


def header_errors(blocks: DataFrame, place: int) -> DataFrame:
    """sheet, block: blocks whose row `place` differs from that of the sheet's first block."""
    parts = F.array_sort(F.collect_list(F.struct("col", "value")))
    signs = blocks.filter(F.col("place") == place).groupBy("sheet", "block").agg(F.sha2(F.to_json(parts), 256).alias("sign"))
    first = F.first("sign").over(Window.partitionBy("sheet").orderBy("block"))
    return signs.withColumn("_first", first).filter("sign != _first").select("sheet", "block")


def column_map(header: DataFrame, classify: Column) -> DataFrame:
    """Header cells with the key that `classify` finds; cells without one (derived columns) go."""
    return header.withColumn("key", classify).filter("key is not null")


def runs(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Maximal runs of consecutive numbers: group, low, high, n."""
    island = F.col(order) - F.row_number().over(Window.partitionBy(*group).orderBy(order))
    return rows.select(*group, order).distinct().withColumn("_run", island).groupBy(*group, "_run").agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n")).drop("_run")


def ranked_until_gap(rows: DataFrame, group: list[str], row: str, value: str) -> DataFrame:
    """Rows with a value, their rank within the group, and `late`: whether a blank row comes before them."""
    order = Window.partitionBy(*group).orderBy(row)
    filled = F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != "")
    marked = rows.withColumn("_filled", F.coalesce(filled, F.lit(False)))
    marked = marked.withColumn("late", F.max(~F.col("_filled")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("_filled").drop("_filled")
    return marked.withColumn("rank", F.row_number().over(order))


def until_double_blank(rows: DataFrame, group: list[str], row: str, value: str) -> DataFrame:
    """The rows before a group's first two blank rows in a row, blank ones apart."""
    order = Window.partitionBy(*group).orderBy(row)
    blank = F.coalesce(F.trim(F.col(value).cast("string")) == "", F.lit(True))
    marked = rows.withColumn("_blank", blank).withColumn("_stop", F.col("_blank") & F.lead("_blank", 1, False).over(order))
    marked = marked.withColumn("_over", F.max("_stop").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter("not _over and not _blank").drop("_blank", "_stop", "_over")


def code_pairs(rows: DataFrame, codes: str, names: str, separator: str = ",") -> DataFrame:
    """Lists of codes and names as one row per pair; `uneven` marks lists of different length, whose ends are NULL."""
    left, right = (F.transform(F.split(c, separator), lambda x: F.trim(x)) for c in (codes, names))
    zipped = rows.withColumn("uneven", F.size(left) != F.size(right)).withColumn("_pair", F.explode(F.arrays_zip(left.alias("code"), right.alias("name"))))
    return zipped.select(*[c for c in rows.columns if c not in (codes, names)], "uneven", F.col("_pair.code").alias("code"), F.col("_pair.name").alias("name"))


def expected_columns(spark: SparkSession, levels: list[list[str]], first: int) -> DataFrame:
    """col, labels: the columns that a header of nested levels has from column `first` on, the last level changing fastest."""
    found = [[]]
    for level in levels:
        found = [[*labels, one] for labels in found for one in level]
    return spark.createDataFrame([(first + i, labels) for i, labels in enumerate(found)], "col int, labels array<string>")


def resolved(header: DataFrame, expected: DataFrame) -> DataFrame:
    """sheet, col, labels, problem of header cells (sheet, col, labels) that the catalogue lacks, stand elsewhere, or are missing; NULL sheets: in no sheet."""
    sheets = header.select("sheet").distinct()
    wanted = sheets.join(expected.select(F.col("col").alias("at"), "labels"))  # a row for each column of a sheet
    both = header.join(wanted, ["sheet", "labels"], "full")
    problem = F.when(F.col("at").isNull(), "unexpected").when(F.col("col").isNull(), "missing").when(F.col("col") != F.col("at"), "elsewhere")
    return both.withColumn("problem", problem).filter("problem is not null").select("sheet", F.coalesce("col", "at").alias("col"), "labels", "problem")


def signature_outliers(header: DataFrame) -> DataFrame:
    """sheet, columns: sheets whose header (col, label) is not that of most sheets; of equally common ones the smallest digest counts."""
    parts = F.array_sort(F.collect_list(F.struct("col", "label")))
    signs = header.groupBy("sheet").agg(F.sha2(F.to_json(parts), 256).alias("sign"), F.count("*").alias("columns"))
    usual = signs.groupBy("sign").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "sign"))["sign"].alias("_usual"))  # one row
    return signs.join(F.broadcast(usual)).filter("sign != _usual").select("sheet", "columns")


def banded(cells: DataFrame, bands: dict[str, tuple[int, int]]) -> DataFrame:
    """Cells with band and place (column within it), of column bands that stand side by side with one meaning, name to (first, last); others go."""
    spans = F.array(*[F.struct(F.lit(name).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for name, (lo, hi) in bands.items()])
    hit = F.filter(spans, lambda s: F.col("col").between(s["lo"], s["hi"]))
    return cells.withColumn("_band", F.get(hit, F.lit(0))).filter("_band is not null").withColumn("band", F.col("_band.band")).withColumn("place", F.col("col") - F.col("_band.lo")).drop("_band")


def band_totals(cells: DataFrame, total_place: int) -> DataFrame:
    """sheet, row, band, total, parts: banded cells whose total (at `total_place`) isn't the sum of the others, within a relative 1e-9 of rounding.

    A missing total is none. With a part missing, or one that is no number, only a total below the rest is told of.
    """
    number, own = codes.number(F.col("value")), F.col("place") == total_place
    gaps = F.count_if(~own & number.isNull()).alias("_gaps")
    sums = cells.groupBy("sheet", "row", "band").agg(F.max(F.when(own, number)).alias("total"), F.sum(F.when(~own, number)).alias("parts"), F.sum(F.when(~own, F.abs(number))).alias("_size"), gaps)
    known = F.coalesce("parts", F.lit(0.0))
    slack = 1e-9 * F.greatest(F.abs("total"), F.coalesce("_size", F.lit(0.0)))
    off = F.when(F.col("_gaps") > 0, F.col("total") < known - slack).otherwise(F.abs(F.col("total") - known) > slack)
    return sums.filter(F.coalesce(off, F.lit(True))).drop("_size", "_gaps")
