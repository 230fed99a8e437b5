"""Queries read all rows of their tables, whatever their ids; small fixtures against brute force."""

from __future__ import annotations

import datetime as dt
import heapq
import math

import pytest

from floodlake.plans import fixtures, network_queries
from floodlake.policy import DEFAULT

ORDERS = [(k, k * 7 % 1500, "FOP"[k % 3], 1.0, dt.date(1996, 1, 1), f"{k % 5 + 1}-X") for k in (*range(0, 14_999, 97), *range(15_001, 150_000, 463))]


@pytest.fixture(scope="module")
def large_ids(spark, tmp_path_factory):
    """A folder whose orders have ids below and above 15,000, with few nations and suppliers."""
    folder = str(tmp_path_factory.mktemp("ids"))
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(i, f"S{i}", i % 25, 1.0) for i in range(30)], "s_suppkey long, s_name string, s_nationkey long, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(i, f"N{i}", i % 5) for i in range(25)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{folder}/nation.parquet")
    return folder


def _edges_by_hand():
    """(segment, start, end, seconds) of the directed edges of all orders that aren't pending."""
    out = []
    for k, c, status, _, _, priority in ORDERS:
        speed = DEFAULT.speeds.get({"1": "primary", "2": "secondary", "3": "residential", "4": "track", "5": "footway"}[priority[0]])
        if status == "P" or speed is None:
            continue
        a = (c % 24 * 100, k % 24 * 100)
        b = (a[0] + 100, a[1]) if (c + k) % 2 == 0 else (a[0], a[1] + 100)
        ways = [(a, b)] if k % 7 == 0 else [(b, a)] if k % 7 == 1 else [(a, b), (b, a)]
        out += [(str(k), s, t, 100 * 3.6 / speed) for s, t in ways]
    return out


def _name(p):
    return f"{p[0] * 100},{p[1] * 100}"


def test_network_reads_all_orders(spark, large_ids):
    lattice = fixtures.load(spark, large_ids, "lattice")
    assert {int(r.segment_id) for r in lattice.collect()} == {o[0] for o in ORDERS if o[2] != "P"}
    got = sorted((r.segment_id, r.src, r.dst) for r in network_queries.road_edges(spark, large_ids).collect())
    assert got == sorted((s, _name(a), _name(b)) for s, a, b, _ in _edges_by_hand())


def test_search_over_all_orders_by_hand(spark, large_ids):
    into = {}
    for _, a, b, t in _edges_by_hand():
        into.setdefault(_name(b), []).append((_name(a), t))
    best = {}
    queue = [(0.0, _name((n * 7 % 24 * 100, n * 5 % 24 * 100))) for n in range(0, 25, 9)]
    heapq.heapify(queue)
    while queue:
        t, at = heapq.heappop(queue)
        if at not in best:
            best[at] = t
            for other, more in into.get(at, []):
                heapq.heappush(queue, (t + more, other))
    got = {r.node: r.time_s for r in network_queries.shortest_access(spark, large_ids).collect()}
    assert got.keys() == best.keys() and all(abs(got[n] - best[n]) < 1e-5 for n in best)


def test_points_snap_to_all_orders_by_hand(spark, large_ids):
    edges = _edges_by_hand()
    got = {r.feature_id: r for r in network_queries.snap_points(spark, large_ids).collect()}
    for i in range(30):
        x, y = i * 173 % 2500 + 0.5, i * 311 % 2600 + 0.5
        near = []
        for _, a, b, _ in edges:
            f = max(0.0, min(1.0, ((x - a[0]) * (b[0] - a[0]) + (y - a[1]) * (b[1] - a[1])) / 10_000))
            near.append(math.hypot(x - a[0] - f * (b[0] - a[0]), y - a[1] - f * (b[1] - a[1])))
        least = min(near)
        assert got[str(i)].kind == "none" if least > DEFAULT.max_snap_m else abs(got[str(i)].distance_m - least) < 1e-5
