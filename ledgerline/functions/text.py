"""Names: normal forms, and similarity that built-in functions don't offer."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc(text: Column) -> Column:
    """Unicode compatibility form; the one step that Spark's functions lack."""

    @F.pandas_udf("string")
    def work(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return work(text)


def folded(text: Column) -> Column:
    """Lower case without white space and symbols."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def without_terms(name: Column, terms: list[str]) -> Column:
    """Removes terms, longest first; a name that would vanish stays."""
    out = name
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        out = F.replace(out, F.lit(term), F.lit(""))
    return F.when(out == "", name).otherwise(out)


def similarity(left: Column, right: Column) -> Column:
    """Ratcliff/Obershelp ratio, which is asymmetric: keep (left, right)."""

    @F.pandas_udf("double")
    def work(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype=float)

    return work(left, right)
