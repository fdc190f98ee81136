"""The queries of these operators against their SQL."""

import duckdb
import pandas as pd
import pytest

from ledgerline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine, theirs = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    # pandas makes nullable integers floats in one of the two.
    plain = lambda v: "" if pd.isna(v) else str(v) if isinstance(v, (str, bool)) else str(int(v)) if v == int(v) else repr(float(v))
    rows = lambda f: sorted(tuple(map(plain, r)) for r in f[columns].astype(object).itertuples(index=False))
    assert rows(mine) == rows(theirs)
