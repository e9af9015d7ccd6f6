"""Every registered query of the library against its SQL twin on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from lodestone.plans import catalogue, commands, operations, ordered, projects, registry, relational, scalars, textual  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    return con


def plain(frame: pd.DataFrame) -> list:
    def value(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, list):
            return str([value(y) for y in x])
        if x is None or x is pd.NA or x != x:
            return "null"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(value(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_imports_without_the_optional_part():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
