"""Every query of the ledger library against its SQL on the smallest tables, and properties."""

import datetime
import math
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from ledgerloom.operators import forecast, history
from ledgerloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 4)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(catalog.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_upsert_is_idempotent(spark):
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    once = history.upsert(old, new, ["k"])
    assert sorted(history.upsert(once, new, ["k"]).collect()) == sorted(once.collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_models():
    trend = np.arange(36.0)
    assert np.allclose(forecast.autoregress(trend, 3), [36, 37, 38])
    season = np.tile(np.arange(12.0) + 5, 3)
    assert np.abs(forecast.smooth(season, 6) - season[:6]).max() < 1.5
