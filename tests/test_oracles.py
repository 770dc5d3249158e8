"""Every registered query against its SQL, on the whole test tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from callstream.plans.catalog import QUERIES
from callstream.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def tables(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def ordered(names, rows):
    names = list(names)
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted([tuple(r[i] for i in order) for r in rows], key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, tables, sf_dir, name):
    expected = tables.execute(ORACLES[name])
    expected = ordered([c[0] for c in expected.description], expected.fetchall())
    found = QUERIES[name](spark, sf_dir)
    found = ordered(found.columns, [tuple(r) for r in found.collect()])
    assert found[0] == expected[0]
    assert len(found[1]) == len(expected[1])
    assert found[1] == expected[1]


def test_entry(spark):
    assert driver.entry(spark).columns == [
        "original_crime_type_name",
        "disposition_description",
        "count",
    ]
