import math
import os

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = __spark_entry__.oracle_sql()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 9)
    return v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    df = __spark_entry__.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = con.execute(SQL[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    want = sorted((tuple(plain(r[at[c]]) for c in cols) for r in cur.fetchall()), key=str)
    assert sorted(at) == cols and got == want


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["book", "requests", "done"] and df.count() > 0


def test_html_blocks_query(spark, sf):
    rows = __spark_entry__.queries()["q03_html_blocks"](spark, sf)
    assert rows.columns == ["d", "b", "tag", "text", "skipped"] and rows.where("tag = 'li'").count() > 0
