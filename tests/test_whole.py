"""Queries over whole tables, against brute force on rows that small tables lack."""

import math
from datetime import datetime, timedelta

import pytest

from brontide.catalog import QUERIES


def test_reduces_all_orders(spark, tmp_path):
    rows = [(k, k, ("1-URGENT", "5-LOW")[k % 2], 1000.0 * k) for k in range(1, 400)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderpriority"]: r["prod"] for r in QUERIES["d3_udf_reduce"](spark, str(tmp_path)).collect()}
    assert got == {p: pytest.approx(math.prod(1 + 1e-9 * r[3] for r in rows if r[2] == p), abs=1e-6) for p in ("1-URGENT", "5-LOW")}


def test_searches_all_edges(spark, tmp_path):
    pairs = [(1, 1), (1, 1), (900, 1), (900, 2), (5000, 2), (7000, 3), (1, 1000), (2, 1000)]
    spark.createDataFrame(pairs, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    hops, edge = {1: 0}, [(a, -b) for a, b in pairs] + [(-b, a) for a, b in pairs]
    for n in range(1, 4):
        hops = {v: n for u, v in edge if u in hops} | hops
    got = {r["node"]: r["hops"] for r in QUERIES["m4_bfs"](spark, str(tmp_path)).collect()}
    assert got == hops and 900 in got and 5000 not in got


def test_interpolates_every_user(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = [(7, 0, 1.0), (7, 3, 4.0), (8, 2, 10.0), (8, 4, 20.0), (8, 4, 40.0), (9, 5, 3.0)]
    rows = [(i, start + timedelta(hours=h, minutes=i), u, "click", v, "{}") for i, (u, h, v) in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r["user_id"], (r["bucket"] // 3_600_000_000_000) - 473_352, r["value"]) for r in QUERIES["w6_interpolate"](spark, str(tmp_path)).collect())
    assert got == [(7, 0, 1.0), (7, 1, 2.0), (7, 2, 3.0), (7, 3, 4.0), (8, 2, 10.0), (8, 3, 20.0), (8, 4, 30.0), (9, 5, 3.0)]
