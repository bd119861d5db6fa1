"""Every query that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from veilspark.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted(repr([str(r[c]) for c in columns]) for r in df.collect())
    got = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    theirs = sorted(repr([str(r[names.index(c)]) for c in columns]) for r in got.fetchall())
    assert ours == theirs
