"""Documents for readers: an envelope with one compact line per key, feature collections, summaries, report text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def envelope(rows: DataFrame, order: list[str], facts: dict, name: str = "areas") -> DataFrame:
    """position, line: a JSON document whose first line holds the facts, then one compact object per row, in order.

    position orders the lines: its first part is 0, 1 or 2 for the head, the rows and the tail. A comma stands before every row but the first.
    """
    spark = rows.sparkSession
    head = json.dumps({"metadata": facts}, ensure_ascii=False, separators=(",", ":"))[:-1] + f',"{name}":['
    item = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    keys = F.struct(*order)
    first = rows.agg(F.min(keys).alias("_first"))  # one row
    body = rows.crossJoin(F.broadcast(first)).select(F.lit(1).alias("part"), keys.alias("at"), F.concat(F.when(keys == F.col("_first"), "").otherwise(","), item).alias("line"))
    ends = spark.createDataFrame([(0, head), (2, "]}")], "part int, line string").select("part", F.lit(None).cast(body.schema["at"].dataType).alias("at"), "line")
    return ends.union(body)


def write_document(document: DataFrame, path: str) -> None:
    """The lines of envelope() as text, range-sorted: the parts in the order of their names are the document."""
    document.orderBy("part", "at").select("line").write.mode("overwrite").text(path)


def features(rows: DataFrame, properties: list[str], geometry: Column) -> DataFrame:
    """type, properties, geometry: rows as GeoJSON features, for envelope(.., name="features") with type and other members as facts."""
    return rows.select(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))


def point(lon: Column, lat: Column) -> Column:
    """A GeoJSON point; NULL where a coordinate is missing."""
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def point_features(nested: DataFrame, keys: list[str], array: str, optional: list[str]) -> DataFrame:
    """keys, properties (a map without missing values), geometry of the elements of `array` that have a coordinate."""
    item = nested.select(*keys, F.explode(array).alias("_i")).select(*keys, "_i.*").filter("lon is not null and lat is not null")
    pairs = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))) for c in optional]))
    return item.select(*keys, F.map_from_entries(pairs).alias("properties"), point(F.col("lon"), F.col("lat")).alias("geometry"))


def summary(nested: DataFrame, array: str) -> DataFrame:
    """A document's rows without their child array, whose size stays."""
    return nested.withColumn(f"{array}_count", F.size(array)).drop(array)


def regrouped_differences(rows: DataFrame, nested: DataFrame, keys: list[str], array: str) -> DataFrame:
    """side and the columns of `rows`: what a nested document lost or made up, by opening it again."""
    rest = [c for c in rows.columns if c not in keys]
    again = nested.select(*keys, F.explode(array).alias("_i")).select(*keys, *[F.col(f"_i.{c}") for c in rest])
    one = rows.select(*keys, *rest)
    return one.exceptAll(again).withColumn("side", F.lit("lost")).union(again.exceptAll(one).withColumn("side", F.lit("made up")))


def report(title: str, tables: dict[str, DataFrame], examples: int = 10) -> DataFrame:
    """section, at, line: Markdown with a table for each aggregate, at most `examples` of its rows, in the order of their cells, and the count of all."""
    out = None
    for number, (heading, rows) in enumerate(tables.items()):
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
        line = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
        # Limited before the window, so that a task sees the examples alone.
        shown = line.orderBy("line").limit(examples).withColumn("at", F.row_number().over(Window.orderBy("line")) + 3)
        head = [f"## {heading}" if number or not title else f"# {title}\n\n## {heading}", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
        top = rows.sparkSession.createDataFrame(list(enumerate(head)), "at int, line string")
        count = rows.agg(F.concat(F.lit("rows: "), F.count("*").cast("string")).alias("line"))
        part = top.select("at", "line").union(count.select(F.lit(3), "line")).union(shown.select("at", "line")).select(F.lit(number).alias("section"), "at", "line")
        out = part if out is None else out.union(part)
    return out


def file_name(parts: list[Column], suffix: str) -> Column:
    """An export's name: its parts joined by underscores, with what file systems don't take replaced by hyphens."""
    return F.concat(F.regexp_replace(F.concat_ws("_", *parts), r'[\\/:*?"<>|\s]+', "-"), F.lit(f".{suffix}"))


def in_order(value: Column, order: list) -> Column:
    """A value's place in a fixed order, for sorting; unlisted ones come last."""
    place = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(place > 0, place).otherwise(len(order) + 1).cast("int")


#: Measures of a region or area table by family: name to (how it is made, unit).
FAMILIES = {"bed": ["actual", "need", "difference", "ratio"], "demand": ["value", "base", "ratio"], "change": ["old", "new", "difference", "ratio"]}


def table_of(family: str, rows: DataFrame, keys: list[str], ratio) -> DataFrame:
    """The table of a metric family at the grain of `keys`: rows has the two counts that the family compares; ratio(part, whole) rounds their quotient."""
    columns = FAMILIES[family]
    if family == "bed":
        a, b = "actual", "need"
    elif family == "demand":
        a, b = "value", "base"
    else:
        a, b = "new", "old"
    out = rows.withColumn("difference", F.col(a) - F.col(b)).withColumn("ratio", ratio(F.col(a), F.col(b)))
    return out.select(*keys, *columns)


def long_of(family: str, table: DataFrame, keys: list[str]) -> DataFrame:
    """dataset, keys, measure, value: the same table with one row per measure."""
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in FAMILIES[family]])
    return table.select(F.lit(family).alias("dataset"), *keys, F.inline(measures))


#: Units of measures; others are counts.
UNITS = {"ratio": "ratio"}


def details(rows: DataFrame, keys: list[str], families: dict[str, dict[str, str]], years: dict[str, str], ratio, note) -> DataFrame:
    """dataset, keys, measure, unit, year, value, note: the tables of several metric families at one grain, a row for each measure, from one pass over `rows`.

    families: for each family, the columns of `rows` that hold its two counts, the one that the other is compared with last, e.g. {"change": {"new": "n1996", "old": "n1995"}}.
    years: the vintage of a column. A count has its own column's year; a difference or ratio has both, where they differ. ratio(part, whole) rounds a quotient,
    note(whole) says why there is none.
    """
    cells = []
    for family, columns in families.items():
        (first, a), (second, b) = columns.items()
        both = years[a] if years[a] == years[b] else f"{years[b]}/{years[a]}"
        made = {first: (F.col(a), years[a]), second: (F.col(b), years[b]), "difference": (F.col(a) - F.col(b), both), "ratio": (ratio(F.col(a), F.col(b)), both)}
        for measure in FAMILIES[family]:
            value, year = made[measure]
            said = note(F.col(b)) if measure == "ratio" else F.lit("")
            cells.append(F.struct(F.lit(family).alias("dataset"), F.lit(measure).alias("measure"), F.lit(UNITS.get(measure, "count")).alias("unit"), F.lit(year).alias("year"), value.cast("double").alias("value"), said.alias("note")))
    return rows.select(*keys, F.inline(F.array(*cells)))


def bundle_text(sources: DataFrame) -> DataFrame:
    """source, at, line: a bundle's table of contents, each source with the files made from it (source, files array)."""
    lines = F.concat(F.array(F.concat(F.lit("## "), "source")), F.transform("files", lambda f: F.concat(F.lit("- "), f)))
    return sources.select("source", F.posexplode(lines).alias("at", "line"))


def placed(rows: DataFrame, group: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their place in a fixed order within their group, e.g. by in_order() of a label and a number that is kept as text."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
