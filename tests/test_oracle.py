import glob
import math

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    got = entry.queries()[name](spark, DIR)
    columns = sorted(got.columns)
    result = db.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert plain(map(tuple, got.select(*columns).collect())) == plain(result)
