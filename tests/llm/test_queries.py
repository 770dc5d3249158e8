"""The registered queries against their SQL, on the whole smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from callstream.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    expected = connection.execute(ORACLES[name])
    columns = sorted(c[0] for c in expected.description)
    order = [[c[0] for c in expected.description].index(c) for c in columns]
    rows = sorted([tuple(r[i] for i in order) for r in expected.fetchall()], key=repr)
    found = QUERIES[name](spark, SF_DIR).select(*columns)
    assert sorted([tuple(r) for r in found.collect()], key=repr) == rows


def test_every_operator_has_a_query():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
