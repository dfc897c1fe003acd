"""Every registered query against its DuckDB SQL, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = want.select(*[f'"{c}"' for c in columns]).fetchall()
    assert Counter(map(repr, map(tuple, got.select(*columns).collect()))) == Counter(map(repr, rows))


def test_entry(spark):
    assert entry.entry(spark).count() == 5 * spark.read.parquet(f"{DATA}/documents.parquet").count()
