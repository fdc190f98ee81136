"""What outputs carry from their inputs: sources, caveats and known issues, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entries(json: Column) -> Column:
    """array<struct<label, value>> of a JSON object, or of a list of such objects in which `label` names each one."""
    listed = F.from_json(json, "array<map<string, string>>")
    named = F.transform(listed, lambda m: F.struct(F.try_element_at(m, F.lit("label")).alias("label"), F.coalesce(F.try_element_at(m, F.lit("value")), F.try_element_at(m, F.lit("source"))).alias("value")))
    pairs = F.transform(F.map_entries(F.from_json(json, "map<string, string>")), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("value")))
    return F.when(F.ltrim(json).startswith("["), named).otherwise(F.array_sort(pairs))


def carried(facts: DataFrame, lineage: DataFrame) -> DataFrame:
    """output, sources, caveats: all that an output's inputs state; facts: dataset, source, caveat; lineage: output, dataset."""
    return lineage.join(facts, "dataset", "left").groupBy("output").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("caveat")).alias("caveats"))


def disagreeing(facts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, values: what the rows of one key state differently, e.g. the source that several inputs name for one vintage."""
    said = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    each = facts.select(key, F.inline(said)).filter("value is not null").groupBy(key, "column").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return each.filter("size(values) > 1")


def source_of(facts: DataFrame, label: str) -> DataFrame:
    """The facts of one vintage; datasets that state none for it keep those without a vintage."""
    own = F.max(F.col("label") == label).over(Window.partitionBy("dataset"))
    marked = facts.withColumn("_own", F.coalesce(own, F.lit(False)))
    return marked.filter((F.col("label") == label) | (~F.col("_own") & F.col("label").isNull())).drop("_own")


def missing_vintages(rows: DataFrame, vintage: str, wanted: list, relation: str) -> DataFrame:
    """relation, vintage: the wanted vintages that a relation has no row of."""
    listed = rows.sparkSession.createDataFrame([(v,) for v in wanted], f"`{vintage}` {rows.schema[vintage].dataType.simpleString()}")
    return listed.join(rows.select(vintage).distinct(), vintage, "left_anti").select(F.lit(relation).alias("relation"), F.col(vintage).cast("string").alias("vintage"))
