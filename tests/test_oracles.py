"""Every registered query against its oracle on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from factloom.plans import registry

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
entry.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def canonical(columns, rows):
    """Rows by sorted column names: numbers as floats, other values as text."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: v if v is None else float(v) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v)
    return sorted([tuple(plain(r[k]) for k in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    got = registry.queries()[name](spark, DIR)
    run = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in run.description]
    assert sorted(got.columns) == sorted(names)
    a, b = canonical(got.columns, [tuple(r) for r in got.collect()]), canonical(names, run.fetchall())
    assert len(a) == len(b), (len(a), len(b), a[:3], b[:3])
    assert a == b, [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3]


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() >= 0
