"""Every query of the catalogue against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from sonorant.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(names, records):
    def plain(v):
        return None if v is None or v != v else v

    return sorted([tuple(plain(r[n]) for n in names) for r in records], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    names = sorted(got.columns)
    want = con.sql(ORACLES[name])
    assert names == sorted(want.columns)
    assert rows(names, [r.asDict() for r in got.collect()]) == rows(names, [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"pipeline_report"}))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1


def test_entry_module():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark, sf):
    assert QUERIES["word_ranges_merged"](spark, sf).count() > 0
