"""Plain feature files, and the digests of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """The `properties` (DDL) of a plain feature collection's features; geometry isn't read. A broken file raises."""
    schema = f"features array<struct<properties: struct<{properties}>>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.explode("features").alias("f")).select("f.properties.*")


def file_hashes(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """file, sha256 and, with `expected` (file, sha256), whether they agree (NULL: none recorded)."""
    found = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))
    if expected is None:
        return found
    return found.join(expected.select("file", F.col("sha256").alias("_recorded")), "file", "left").withColumn("agrees", F.col("sha256") == F.col("_recorded")).drop("_recorded")
