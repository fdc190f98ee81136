"""Tables in, tables out: Parquet by name, CSV as strings first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vintage(spark: SparkSession, path: str, column: str, value: str) -> DataFrame:
    """One vintage of a table that is partitioned by vintage: the other folders are not read. Raises where it has no rows, as a missing vintage is an error."""
    rows = spark.read.parquet(path).filter(F.col(column) == value)
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows of {column} {value}")
    return rows


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, every column a string, an empty cell NULL."""
    return spark.read.option("header", True).option("nullValue", "").option("multiLine", True).csv(path)


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts by column; what doesn't fit goes to `bad_cells` (column names) instead of raising."""
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in types.items()]))
    return rows.withColumn("bad_cells", bad).withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})
