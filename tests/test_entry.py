"""The registry is whole and its flagship query runs."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry


def test_oracles_name_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and {"doc_id", "score", "rank"} == set(rows[0].asDict())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["links_read", "link_map_roundtrip", "doc_info_roundtrip", "ranks_file", "top_file"])
def test_formats_come_back(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("customer", "orders", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet'")
    got = entry.queries()[name](spark, d)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
