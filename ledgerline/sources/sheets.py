"""Whole sheets in one pass: several relations by their block and column maps, with the layout they break.

Sheets are cells (sheet, row, col, value). A relation says where its units are (rows from a first one on, or blocks of rows) and which cell of a unit holds which
field. Every cell is looked up in all relations at once and dealt to the units it belongs to, so that any number of relations costs one scan and one shuffle;
a unit has no more cells than its relation has fields. Rules are checked where a unit is together: its number in a sequence, totals against
their parts, cells that stand twice. Units of a counted relation that have no cell are told of as well.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import codes


@dataclass(frozen=True)
class Relation:
    """fields: name to (row within the unit, column). size: rows of a unit; count: how many units there are (None: to the end of the sheet).

    key: the field that a unit must have, else it is no data. number: the field that counts first_number, first_number + 1, ...; totals: field to its parts.
    """

    name: str
    first_row: int
    fields: dict[str, tuple[int, int]]
    size: int = 1
    count: int | None = None
    key: str | None = None
    number: str | None = None
    first_number: int = 1
    totals: dict[str, list[str]] = field(default_factory=dict)


_CELL = "struct<relation: string, unit: int, field: string, value: string>"
_OUT = "struct<key: string, value: string, problem: string>"


def _dealt(relation: Relation) -> Column:
    """The units of a relation that a cell belongs to: its own; and from the cell of a number all, so that a unit without cells is missed."""
    offset = F.col("row") - relation.first_row
    unit, place = F.floor(offset / relation.size).cast("int"), (offset % relation.size).cast("int")
    inside = (offset >= 0) & (F.lit(True) if relation.count is None else unit < relation.count)
    names = functools.reduce(lambda found, f: found.when((place == f[1][0]) & (F.col("col") == f[1][1]), f[0]), list(relation.fields.items())[1:], F.when(*_first(relation, place)))
    cell = lambda u, f, v: F.struct(F.lit(relation.name).alias("relation"), u.alias("unit"), f.alias("field"), v.alias("value")).cast(_CELL)
    own = F.when(inside & names.isNotNull(), F.array(cell(unit, names, F.col("value"))))
    own = F.coalesce(own, F.array().cast(f"array<{_CELL}>"))
    if relation.number and relation.count:
        all_ = F.transform(F.sequence(F.lit(0), F.lit(relation.count - 1)), lambda u: cell(u, F.lit(None).cast("string"), F.lit(None).cast("string")))
        return F.concat(own, F.when(inside & (names == relation.number), all_).otherwise(F.array().cast(f"array<{_CELL}>")))
    return own


def _first(relation: Relation, place: Column) -> tuple[Column, str]:
    name, (row, col) = next(iter(relation.fields.items()))
    return (place == row) & (F.col("col") == col), name


def _found(relation: Relation) -> Column:
    """The fields of a unit, and what is wrong with it, from its cells `_c` (field, value)."""
    value = lambda f: F.get(F.filter("_c", lambda c: c["field"] == f), F.lit(0))["value"]
    filled = F.filter("_c", lambda c: F.coalesce(F.trim(c["value"]) != "", F.lit(False)) & c["field"].isNotNull())
    data = F.transform(filled, lambda c: F.struct(c["field"].alias("key"), c["value"].alias("value"), F.lit(None).cast("string").alias("problem")))
    problem = lambda test, key, stated, said: F.when(test, F.struct(F.lit(key).alias("key"), stated.cast("string").alias("value"), F.lit(said).alias("problem")).cast(_OUT))
    told = []
    for f in relation.fields:
        told.append(problem(F.size(F.filter("_c", functools.partial(lambda f, c: c["field"] == f, f))) > 1, f, value(f), "stands twice"))
    if relation.number:
        wanted = F.col("unit") + relation.first_number
        told.append(problem(~codes.integral(value(relation.number)).eqNullSafe(wanted.cast("long")), relation.number, value(relation.number), "is not the next number"))
    for total, parts in relation.totals.items():
        numbers = [codes.number(value(p)) for p in parts]
        known = functools.reduce(lambda a, b: a + b, [F.coalesce(n, F.lit(0.0)) for n in numbers])
        size = functools.reduce(lambda a, b: a + b, [F.coalesce(F.abs(n), F.lit(0.0)) for n in numbers])
        gap = functools.reduce(lambda a, b: a | b, [n.isNull() for n in numbers])
        stated = codes.number(value(total))
        slack = 1e-9 * F.greatest(F.abs(stated), size)
        off = F.coalesce(F.when(gap, stated < known - slack).otherwise(F.abs(stated - known) > slack), F.lit(True))
        told.append(problem(off, total, value(total), "is not the sum of its parts"))
    out = F.concat(data, F.array_compact(F.array(*told)))
    if relation.key:
        out = F.when(F.coalesce(F.trim(value(relation.key)) != "", F.lit(False)), out)
    return out.cast(f"array<{_OUT}>")


def parse(cells: DataFrame, relations: list[Relation]) -> DataFrame:
    """sheet, relation, unit, key, value, problem: the fields of all relations, and rows with a problem for what breaks their layout."""
    dealt = cells.select("sheet", F.inline(F.concat(*[_dealt(r) for r in relations])))
    units = dealt.groupBy("sheet", "relation", "unit").agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("_c"))
    first, *rest = relations
    found = functools.reduce(lambda made, r: made.when(F.col("relation") == r.name, _found(r)), rest, F.when(F.col("relation") == first.name, _found(first)))
    return units.select("sheet", "relation", "unit", F.inline(found))
