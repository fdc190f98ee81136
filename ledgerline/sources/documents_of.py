"""Documents whose shape isn't known ahead: VARIANT columns, typed fields with what is wrong with them, and the shapes that there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parsed(rows: DataFrame, column: str) -> DataFrame:
    """`rows` with doc (the JSON text of `column` as VARIANT) and unreadable: whether there is a text that is no JSON. A NULL text is a NULL document."""
    return rows.withColumn("doc", F.try_parse_json(column)).withColumn("unreadable", F.col(column).isNotNull() & F.col("doc").isNull())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, doc, unreadable of JSON lines; empty lines go."""
    return parsed(spark.read.text(path).withColumnRenamed("value", "line").filter(F.trim("line") != ""), "line")


def with_fields(rows: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """`rows` (with doc) with a typed column for each field (name to path and type), and problems: a map of the fields that are absent, null or mistyped.

    A value of another type is NULL and told of, whether or not a cast could make something of it: a text is no number. A whole number is a fraction, not the other way round.
    """
    families = {"bigint": {"long", "int", "double"}, "decimal": {"double"}, "double": {"double"}, "float": {"double"}, "string": {"string"}, "boolean": {"boolean"}}
    problems = []
    for name, (path, kind) in fields.items():
        value = F.try_variant_get("doc", path, "variant")
        found = F.lower(F.regexp_extract(F.schema_of_variant(value), "^[A-Za-z]+", 0))
        fits = found.isin(*[f for f, kinds in families.items() if kind in kinds])
        typed = F.when(fits, F.try_variant_get("doc", path, kind))
        said = F.when(F.col("doc").isNull(), None).when(value.isNull(), "absent").when(F.is_variant_null(value), "null").when(typed.isNull(), "mistyped")
        problems.append(F.struct(F.lit(name).alias("key"), said.alias("value")))
        rows = rows.withColumn(name, typed)
    return rows.withColumn("problems", F.map_from_entries(F.filter(F.array(*problems), lambda p: p["value"].isNotNull())))


def violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, problem of the rows of with_fields(); field is NULL where the whole document can't be read."""
    each = F.when(F.col("unreadable"), F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit("unreadable").alias("problem"))))
    named = F.transform(F.map_entries("problems"), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("problem")))
    return rows.select(*keys, F.inline(F.coalesce(each, named)))


def shapes(rows: DataFrame, depth: int) -> DataFrame:
    """path, kind, n: how many values of each kind stand at each path of the documents, `depth` levels down; `[*]` is any element of a list.

    Each level is counted from the one above, which is exploded by one level alone; what is shuffled are counts.
    """
    level = rows.filter(F.col("doc").isNotNull()).select(F.lit("$").alias("path"), "doc")
    found = None
    for at in range(depth):
        one = level.select("path", "doc", F.lower(F.regexp_extract(F.schema_of_variant("doc"), "^[A-Za-z]+", 0)).alias("kind"))
        counts = one.groupBy("path", "kind").agg(F.count("*").alias("n"))
        found = counts if found is None else found.union(counts)
        if at + 1 < depth:
            inner = F.when(F.col("kind") == "object", F.transform(F.map_entries(F.try_variant_get("doc", "$", "map<string, variant>")), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("step"), e["value"].alias("doc"))))
            inner = inner.when(F.col("kind") == "array", F.transform(F.try_variant_get("doc", "$", "array<variant>"), lambda v: F.struct(F.lit("[*]").alias("step"), v.alias("doc"))))
            level = one.select("path", F.inline(inner)).select(F.concat("path", "step").alias("path"), "doc")
    return found


def common_schema(rows: DataFrame) -> str:
    """The one schema that all documents fit, as text; VARIANT where kinds differ."""
    return rows.agg(F.schema_of_variant_agg("doc")).first()[0]
