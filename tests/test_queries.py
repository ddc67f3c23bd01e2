"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerlark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    text = lambda x: str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    if name in registry.ORACLE:
        expected = duck.execute(registry.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
