"""Every query with SQL gives DuckDB's rows; every other one gives rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = {k: v for k, v in entry.queries().items() if not k.startswith("op") or not k[2].isdigit()}
CORE.pop("pipeline", None)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    df = CORE[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr)
    assert got
    if sql := entry.oracle_sql().get(name):
        quoted = ", ".join(f'"{n}"' for n in names)
        want = sorted((tuple(plain(v) for v in r) for r in duck.execute(f"SELECT {quoted} FROM ({sql})").fetchall()), key=repr)
        assert got == want
