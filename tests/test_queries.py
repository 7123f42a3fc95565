"""Every trace query against its SQL, and the entry."""

from __future__ import annotations

import pytest

import __spark_entry__
from tests.conftest import SMALL, plain
from tracequarry import queries as q


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    frame = q.QUERIES[name](spark, SMALL)
    got = frame.collect()
    if name in q.ORACLES:
        answer = duck.execute(q.ORACLES[name])
        columns, want = [c[0] for c in answer.description], answer.fetchall()
        assert sorted(frame.columns) == sorted(columns)
        assert plain(frame.columns, got) == plain(columns, want)
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(q.ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", ["global_timeline", "interval_merge", "interval_overlap_pairs", "lane_timeline", "top_gaps"])
def test_lanes_with_parts_of_a_minute(spark, tmp_path, name):
    """Quantities between whole numbers, nulls and negative ones; no two equal intervals, whose order the SQL leaves open."""
    import duckdb

    con = duckdb.connect()
    con.execute(
        f"""CREATE TABLE lineitem AS SELECT * REPLACE (CASE l_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN -l_quantity ELSE l_quantity + l_orderkey % 4 * 0.25 END AS l_quantity,
        CASE WHEN l_orderkey % 13 > 0 THEN l_suppkey END AS l_suppkey, CASE WHEN l_orderkey % 11 > 0 THEN l_shipdate END AS l_shipdate) FROM '{SMALL}/lineitem.parquet'"""
    )
    con.execute("CREATE OR REPLACE TABLE lineitem AS SELECT DISTINCT ON (l_suppkey, l_shipdate, round_even(l_quantity, 0)) * FROM lineitem")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    frame, answer = q.QUERIES[name](spark, str(tmp_path)), con.execute(q.ORACLES[name])
    columns, want = [c[0] for c in answer.description], answer.fetchall()
    assert want and plain(frame.columns, frame.collect()) == plain(columns, want)
