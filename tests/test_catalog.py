import duckdb
import numpy as np
import pandas as pd
import pytest

from quern.plans import catalog, oracles

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return base


def rows(frame):
    def plain(x):
        """Nullable integers come as floats from one side or the other."""
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return None
        if isinstance(x, bool | np.bool_):
            return bool(x)
        if isinstance(x, int | float | np.number):
            return int(x) if x == int(x) else round(float(x), 9)
        return str(x)
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr([plain(x) for x in r]) for r in frame.itertuples(index=False, name=None))


def test_each_query_has_sql():
    assert catalog.queries().keys() == oracles.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(duck.execute(oracles.oracle_sql()[name]).df())
