"""Every registered query against its oracle SQL on the smallest sample."""
import datetime
import math
from pathlib import Path

import pytest

from cargolake import catalog
from cargolake.catalog.views import TABLES
from support import DATA

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def oracle():
    if not Path(DATA).exists():
        pytest.skip("sample tables are not there")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(rows, columns):
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.9g}")
        return str(v) if isinstance(v, datetime.date) else v
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, oracle, name):
    df = catalog.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = oracle.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical(rows, df.columns) == canonical(want.fetchall(), want.columns)
