"""Codes and cells of report tables: zero-padded keys, sentinels, ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code(value: Column, width: int) -> Column:
    """Digits only, padded with zeros to `width`; NULL where nothing or too much is left."""
    digits = F.regexp_replace(value.cast("string"), r"\.0$", "")
    ok = digits.rlike(r"^[0-9]+$") & (F.length(digits) <= width)
    return F.when(ok, F.lpad(digits, width, "0"))


#: What counts as a number's text: digits with a point and an exponent, no type letters, words or hexadecimals.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(literal: Column) -> Column:
    """The double that a text states, or a numeric column's own value; NULL for anything else, so for `1d` and `NaN`."""
    text = F.trim(literal.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def cell_status(literal: Column) -> Column:
    """observed, blank, or what a sentinel says; anything else is an error."""
    text = F.trim(literal)
    return (
        F.when(literal.isNull() | (text == ""), "blank")
        .when(text == "-", "source_dash")
        .when(text == "*", "not_disclosed")
        .when(text == "not reported", "not_reported")
        .when(text == "XXX", "not_calculated")
        .when(text.rlike(NUMBER), "observed")
        .otherwise("error")
    )


def observed(literal: Column) -> Column:
    """The number of an observed cell, else NULL."""
    return F.when(cell_status(literal) == "observed", number(literal))


#: Box that a usable coordinate lies strictly within (fixed values): latitudes, longitudes.
LATITUDES, LONGITUDES = (20.0, 46.0), (122.0, 154.0)


def integral(value: Column) -> Column:
    """A long from an integer or a float without a fraction, as number or text; else NULL."""
    whole = number(value)
    return F.when((whole == F.floor(whole)) & (F.abs(whole) < 2.0**53), whole.cast("long"))


def number_code(value: Column, width: int, low: int, high: int) -> Column:
    """`value` as digits of a fixed width, where it is integral and from low to high; else NULL."""
    whole = integral(value)
    return F.when(whole.between(low, high), F.format_string(f"%0{width}d", whole))


def persons(ten_thousands: Column) -> Column:
    """Persons from units of 10,000, halves to even; NULL where the figure has more than four decimals."""
    scaled = ten_thousands.cast("double") * 10_000
    return F.when(F.abs(scaled - F.rint(scaled)) < 1e-6, F.rint(scaled).cast("long"))


def rate_or_literal(literal: Column, low: float, high: float) -> Column:
    """struct<value, literal, bad>: a number within the range, else the literal alone; bad marks numbers outside."""
    stated = number(literal)
    fits = stated.between(low, high)
    return F.struct(F.when(fits, stated).alias("value"), literal.alias("literal"), F.coalesce(stated.isNotNull() & ~fits, F.lit(False)).alias("bad"))


def year_of_label(label: Column) -> Column:
    """The year of a label like 2030年度（...）; NULL where it doesn't start with one."""
    return F.regexp_extract(F.trim(F.regexp_replace(label, r"[\r\n]", "")), r"^(\d{4})年度", 1).try_cast("int")


def series_column(label: Column) -> Column:
    """struct<series, year> of a header like 2015実績, 2026見込量 or 2025必要数; NULL for derived columns."""
    pattern = "^([0-9]{4})(実績|見込量|必要数)$"
    return F.when(label.rlike(pattern), F.struct(F.regexp_extract(label, pattern, 2).alias("series"), F.regexp_extract(label, pattern, 1).cast("int").alias("year")))


def sheet_name(name: Column) -> Column:
    """struct<code, rest> of a sheet named by digits and a title; NULL for others."""
    pattern = r"^(\d+)(.+)$"
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).alias("code"), F.regexp_extract(name, pattern, 2).alias("rest")))


def usable_coordinate(latitude: Column, longitude: Column) -> Column:
    """struct<lon, lat> of two texts; NULL for blanks, words, 0/0 and whatever lies outside the box."""
    lat, lon = F.trim(latitude).try_cast("double"), F.trim(longitude).try_cast("double")
    inside = (lat > LATITUDES[0]) & (lat < LATITUDES[1]) & (lon > LONGITUDES[0]) & (lon < LONGITUDES[1])
    return F.when(inside, F.struct(lon.alias("lon"), lat.alias("lat")))


def prefixed_group(name: Column, prefixes: dict[str, str], other: str) -> Column:
    """The group of the first prefix (prefix to group) that a metric's name has."""
    out = None
    for prefix, group in prefixes.items():
        hit = F.startswith(name, F.lit(prefix))
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise(other)


def recoded(label: Column, keys: dict[str, str]) -> Column:
    """The key of a label; NULL for one that isn't listed."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in keys.items() for x in pair]), label)


def present_struct(rows_columns: list[str], wanted: list[str]) -> Column:
    """A struct of those of the wanted columns that a table has, in their order."""
    return F.struct(*[c for c in wanted if c in rows_columns])
