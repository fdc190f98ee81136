"""Deterministic exports: sorted CSV with a preamble, a side-car of counts and digests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.plans import texts


def digest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n and an order-free digest of `keys`: the sum of 52 bits of each row's SHA-256."""
    line = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    bits = F.conv(F.substring(F.sha2(line, 256), 1, 13), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.sum(bits).cast("string").alias("digest"))


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """Range-sorted part files, the same bytes in every run; NULL is an empty cell."""
    rows.orderBy(*order).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def preamble(facts: dict[str, str]) -> str:
    """Comment lines in front of an export; newlines are squashed to spaces."""
    return "".join(f"# {k}: {' '.join(v.split())}\r\n" for k, v in facts.items())


def csv_field(value: Column) -> Column:
    """A field as RFC 4180 wants it: quoted where a quote, comma or line break is in it; NULL is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lead(columns: list[str], facts: dict[str, str]) -> list[str]:
    """The comment lines and the header of a CSV text."""
    quoted = ['"' + c.replace('"', '""') + '"' if set(c) & set('",\r\n') else c for c in columns]
    return [*preamble(facts).split("\r\n")[:-1], ",".join(quoted)]


def csv_document(rows: DataFrame, columns: list[str], facts: dict[str, str], order: list[str], mark: bool = True) -> DataFrame:
    """part, at, key, line of a CSV text: comment lines and the header (part 0, ordered by `at`), then the rows (part 1, ordered by `key`, a struct of `order`); a byte order mark stands in front."""
    top = [(0, i, ("\ufeff" if mark and i == 0 else "") + line) for i, line in enumerate(csv_lead(columns, facts))]
    body = rows.select(F.lit(1).alias("part"), F.lit(None).cast("int").alias("at"), F.struct(*order).alias("key"), texts.lines_of(rows, columns, csv_field).alias("line"))
    lead = rows.sparkSession.createDataFrame(top, "part int, at int, line string").select("part", "at", F.lit(None).cast(body.schema["key"].dataType).alias("key"), "line")
    return lead.union(body)


def write_csv_text(rows: DataFrame, path: str, columns: list[str], facts: dict[str, str], order: list[str], mark: bool = True, cells: str | None = None) -> dict[str, int]:
    """csv_document() as one file, with the rows and bytes counted while writing; `cells` is an array column in place of `columns`, and a row of another width raises."""
    return texts.write_text(rows, path, order, texts.lines_of(rows, columns, csv_field, cells), csv_lead(columns, facts), mark)


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One line of CSV per row."""
    return rows.select(F.concat_ws(",", *[csv_field(F.col(c)) for c in columns]).alias("line"))


def json_lines(rows: DataFrame, key: str) -> DataFrame:
    """One compact JSON object per row, with its key."""
    return rows.select(key, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))


def write_shards(rows: DataFrame, path: str, key: str) -> None:
    """A folder per key, replaced as a whole; readers of one key read one folder."""
    rows.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def read_shard(spark: SparkSession, path: str, key: str, value: str, echo: str) -> DataFrame:
    """The rows of one key's folder; a row whose own `echo` names another key raises when it is read."""
    rows = spark.read.json(path).filter(F.col(key) == value)
    wrong = F.raise_error(F.concat(F.lit(f"shard {value} holds "), F.coalesce(F.col(echo).cast("string"), F.lit("no key"))))
    return rows.withColumn(echo, F.when(F.col(echo).cast("string").eqNullSafe(F.lit(value)), F.col(echo)).otherwise(wrong.cast(rows.schema[echo].dataType)))


def write_with_meta(rows: DataFrame, path: str, order: list[str], facts: dict) -> None:
    """A CSV file of the rows in order, and beside it `path`.meta.json with the facts, the columns and the rows and bytes that were counted while writing."""
    counts = write_csv_text(rows, path, rows.columns, {}, order, mark=False)
    with open(f"{texts.mounted(path)}.meta.json", "w") as out:
        json.dump({**facts, "fields": rows.columns, **counts}, out, ensure_ascii=False, sort_keys=True)


def issues_for(issues: DataFrame, scope: str, value: str, default: str) -> DataFrame:
    """Known issues (id, scope map, ...) that concern a table or vintage; those without this scope count as `default`."""
    return issues.filter(F.coalesce(F.try_element_at("scope", F.lit(scope)), F.lit(default)) == value)


def by_source(files: DataFrame) -> DataFrame:
    """source, files: the export files (file, sources array) of each source; files of none stand under derived::name."""
    sources = F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.array(F.concat(F.lit("derived::"), "file")))
    return files.select("file", F.explode(sources).alias("source")).groupBy("source").agg(F.array_sort(F.collect_set("file")).alias("files"))
