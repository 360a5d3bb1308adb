"""Queries with SQL against it on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from sonorant.llm import base_queries
from sonorant.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want, got = con.sql(ORACLES[name]), QUERIES[name](spark, sf)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == sorted(want.select(*names).fetchall(), key=repr)


def test_registry_has_every_operator():
    assert {n.split("_")[0] for n in QUERIES if n not in base_queries.QUERIES} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}
