"""Every query with SQL equals it on the small tables."""

import datetime as dt
import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quarry import queries as relational

relational.load()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and value != value) or str(value) == "NaT":
        return None
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):  # pandas reads one engine's dates as timestamps
        return str(pd.Timestamp(value))
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, np.integer, np.floating)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6f}"
    return str(value)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in row) for row in df.astype(object).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(relational.SQL))
def test_equals_sql(name, spark, data, duck):
    mine = relational.QUERIES[name](spark, data).toPandas()
    theirs = duck.execute(relational.SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_registry_and_entry(spark):
    import __spark_entry__ as entry

    assert set(relational.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["invoice_number", "supplier_name", "invoice_date", "total_amount"]
