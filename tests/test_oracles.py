"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tallymark.plans import intake, manifests, monitoring, places, proofs, proposals, queries, regions, reviews, scores, service

PLANS = (queries, proposals, manifests, regions, reviews, monitoring, places, proofs, scores, service, intake)
QUERIES, ORACLES = ({k: x for own in PLANS for k, x in getattr(own, kind).items()} for kind in ("QUERIES", "ORACLES"))
SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def _plain(x):
    """Columns of whole numbers with nulls come as floats from one side."""
    if not pd.api.types.is_scalar(x):
        return x
    return None if pd.isna(x) else int(x) if isinstance(x, float) and x.is_integer() else x


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr([_plain(x) for x in row]) for row in df.values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)
