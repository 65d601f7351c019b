import glob
import os
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SMALL = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, (float, np.floating)) and x != x):
        return "-"
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating, Decimal)):
        return f"{float(x):.6f}"
    if isinstance(x, pd.Timestamp):
        return str(x.tz_localize(None) if x.tzinfo else x)
    return str(x)


def table(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(SMALL + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


CORE = [n for n in entry.queries() if not (n[0] == "p" and n[1:2].isdigit())]


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    if name in entry.oracle_sql():
        assert table(got) == table(duck.sql(entry.oracle_sql()[name]).df())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
