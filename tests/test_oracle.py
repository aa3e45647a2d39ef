"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or value is np.nan or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer, float, np.floating, Decimal)):
        return round(float(value), 6)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(map(plain, value))
    return str(value)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(map(plain, r)) for r in zip(*(table[n].to_pylist() for n in names))), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got = rows(__spark_entry__.queries()[name](spark, str(DATA)).toArrow())
    want = rows(duck.execute(SQL[name]).to_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(__spark_entry__.queries())
