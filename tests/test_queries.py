"""Every registered query of the library runs, and agrees with its SQL twin."""

import os
from collections import Counter

import duckdb
import pytest

from pagemill.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    return round(x, 6) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{os.path.join(sf_dir, name)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    frame = registry.queries()[name](spark, sf_dir)
    columns, rows = sorted(frame.columns), frame.collect()
    if name not in registry.oracle_sql():
        assert columns
        return
    duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in duck.description]
    assert sorted(names) == columns
    want = [dict(zip(names, r, strict=True)) for r in duck.fetchall()]
    assert Counter(tuple(value(r[c]) for c in columns) for r in rows) == Counter(tuple(value(r[c]) for c in columns) for r in want)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
