"""Every base query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import ledgerline.queries_documents  # noqa: F401
import ledgerline.queries_reports  # noqa: F401
from ledgerline.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return ""
    if isinstance(value, bool) or str(value) in ("True", "False"):
        return str(value)
    try:
        return f"{float(value):.9g}"
    except (TypeError, ValueError):
        return str(value)


def rows(frame, columns):
    return sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    mine = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(mine)
        return
    theirs = duck.sql(ORACLES[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert rows(mine, columns) == rows(theirs, columns)


def test_no_products(spark):
    """Joins on keys never become products."""
    for name in ("ratio_by_area_function", "od_flow_breakdown", "point_in_polygon_grid", "link_suffix_tier"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
