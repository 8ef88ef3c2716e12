"""Every query of the catalogue against its SQL twin; those without one have their own tests."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from dyadspark.plans.catalogue import ORACLES, QUERIES

FOLDER = os.environ.get("CATALOGUE_DIR", "/root/testdata/sf0.001")
NULL = "\x00"


@pytest.fixture(scope="module")
def twins():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def same(value):
    return NULL if value is None else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, twins, name):
    got = QUERIES[name](spark, FOLDER)
    found = twins.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    order = [columns.index(c) for c in sorted(columns)]
    want = sorted([tuple(r[k] for k in order) for r in found.fetchall()], key=repr)
    have = sorted([tuple(r) for r in got.select(*sorted(columns)).collect()], key=repr)
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert tuple(map(same, a)) == tuple(map(same, b))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_twin(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert rows


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["f_idx", "name", "value"]
