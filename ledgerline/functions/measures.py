"""Derived measures: ratios with a note where they can't be computed, rounding, bins and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower edges of the seven classes of each indicator (fixed values).
EDGES = {
    "ratio": [0.77, 0.87, 0.95, 1.05, 1.15, 1.3],
    "demand": [0.67, 0.83, 0.95, 1.05, 1.2, 1.5],
    "yoy": [0.85, 0.93, 0.98, 1.02, 1.075, 1.18],
    "flow": [0.01, 0.03, 0.05, 0.1, 0.2, 0.4],
}


def half_up(value: Column, digits: int = 4) -> Column:
    """Rounds halves upwards, also below zero."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded; NULL where whole is 0 or either is NULL."""
    return half_up(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def ratio_note(whole: Column) -> Column:
    return F.when(whole == 0, "denominator is 0").otherwise("")


def fixed_bin(value: Column, kind: str) -> Column:
    """How many edges are at or below the value, 0 to 6; NULL for NULL."""
    edges = F.array(*[F.lit(float(e)) for e in EDGES[kind]])
    return F.when(value.isNotNull(), F.size(F.filter(edges, lambda e: e <= value)))


def quantile_class(value: Column, edges: Column) -> Column:
    """Class of a value among ascending edges (an array column)."""
    return F.when(value.isNotNull(), F.size(F.filter(edges, lambda e: e <= value)))


def distinct_edges(edges: Column) -> Column:
    """Ascending edges without repetition, two at least."""
    once = F.array_distinct(edges)
    one = F.coalesce(F.get(once, 0), F.lit(0.0))
    return F.when(F.size(once) >= 2, once).otherwise(F.array(one, one))


def ramp_places(classes: Column, colours: int) -> Column:
    """Which of `colours` ramp colours to use for so many classes: evenly spaced, both ends included."""
    evenly = F.transform(F.sequence(F.lit(0), classes - 1), lambda i: F.floor(F.try_divide(i * (colours - 1), classes - 1) + 0.5).cast("int"))
    return F.when(classes <= 0, F.array().cast("array<int>")).when(classes == 1, F.array(F.lit(0))).otherwise(evenly)


def change_text(ratio: Column) -> Column:
    """A ratio as signed change in percent; the sign follows the rounded figure, so that 0.0% has none."""
    change = half_up((ratio - 1) * 100, 1)
    return F.when(change == 0, "0.0%").when(change.isNotNull(), F.format_string("%+.1f%%", change))


def share_text(part: Column, whole: Column) -> Column:
    """part of whole in percent with one decimal; a dash where whole is 0."""
    share = half_up(F.try_divide(part * 100.0, whole.cast("double")), 1)
    return F.when(whole == 0, "-").when(share.isNotNull(), F.format_string("%.1f%%", share))
