"""Driver contract and the oracle sweep (every SQL-checked query vs DuckDB)."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001

ORACLE = E.oracle_sql()
_SPARK_TO_DUCK = {"string": "VARCHAR", "date": "DATE", "int": "INTEGER", "bigint": "BIGINT",
                  "double": "DOUBLE", "boolean": "BOOLEAN"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 32 and df.columns[:3] == ["holiday", "date", "is_public"]


def test_every_oracle_key_is_a_query():
    assert set(ORACLE) <= set(E.queries())
    assert len(ORACLE) >= 40


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in sorted(f.removesuffix(".parquet") for f in os.listdir(SF001)):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t)}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    o_names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(o_names)
    spark_types = {k: _SPARK_TO_DUCK.get(v, v.upper()) for k, v in df.dtypes}
    assert spark_types == {d[0]: str(d[1]) for d in res.description}
    assert _rows(df.columns, s_rows) == _rows(o_names, res.fetchall())
