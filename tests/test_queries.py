"""Every registered query of the message operators against its SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from airlock.plans.oracle import ORACLE_SQL
from airlock.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(str, r)) for r in df.astype(object).where(df.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, oracle, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = oracle.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    assert {r.label for r in entry_module.entry(spark).collect()} <= {"low", "medium", "high"}
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
