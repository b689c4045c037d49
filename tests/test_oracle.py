"""Every query with an SQL oracle against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    sql = entry.oracle_sql()[name]
    names = [r[0] for r in con.execute(f"describe {sql}").fetchall()]
    want = [dict(zip(names, r, strict=True)) for r in con.execute(sql).fetchall()]
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    key = lambda r: repr(tuple(plain(r[c]) for c in sorted(names)))
    assert sorted(map(key, (r.asDict() for r in df.collect()))) == sorted(map(key, want))


def test_entry(spark):
    assert entry.entry(spark).count() == 10
