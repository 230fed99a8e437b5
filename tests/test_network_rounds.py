"""Searches that follow their frontier: rings of cells around points, and stored rounds of routes."""

from __future__ import annotations

import glob
import math
import random

from pyspark.sql import functions as F

from floodlake.operators import features, network, regions, state

EDGE = "request_id int, src struct<cx:long,cy:long>, dst struct<cx:long,cy:long>, segment_id string, parent_road_id string, status string, length_m double, time_s double"


def _edge(request, a, b, name, seconds, status="OPEN"):
    (x1, y1), (x2, y2) = a, b
    return (request, {"cx": x1 * 100, "cy": y1 * 100}, {"cx": x2 * 100, "cy": y2 * 100}, name, name, status, math.hypot(x2 - x1, y2 - y1), float(seconds))


def _nearest(x, y, edges):
    best = math.inf
    for _, a, b, *_ in edges:
        x1, y1, x2, y2 = a["cx"] / 100, a["cy"] / 100, b["cx"] / 100, b["cy"] / 100
        t = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        best = min(best, math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)))
    return best


def test_points_find_the_nearest_road_by_rings(spark, monkeypatch):
    """A dense town, a lone long road and nothing in between; in town a point meets only the roads around it."""
    r = random.Random(2)
    town = [_edge(1, (x := r.randrange(1500), y := r.randrange(1500)), (x + r.randrange(5, 30), y + r.randrange(-20, 20)), f"t{i}", 1) for i in range(3000)]
    edges = [*town, _edge(1, (-4000, 3000), (6000, 4000), "long", 1), _edge(2, (0, 0), (10, 10), "other", 1)]
    spots = [(1, f"p{i}", r.uniform(0, 1500), r.uniform(0, 1500)) for i in range(60)] + [(1, f"q{i}", r.uniform(-3000, 5000), r.uniform(1500, 4500)) for i in range(60)] + [(2, "far", 400.0, 300.0), (3, "none", 0.0, 0.0)]
    met = []
    near = network._near_cells
    monkeypatch.setattr(network, "_near_cells", lambda points, *rest: met.append(near(points, *rest).groupBy("feature_id").count()) or near(points, *rest))
    frame = spark.createDataFrame(edges, EDGE)
    got = {p.feature_id: p for p in network.snap_points(spark.createDataFrame(spots, "request_id int, feature_id string, x double, y double"), frame).collect()}
    for request, name, x, y in spots:
        far = _nearest(x, y, [e for e in edges if e[0] == request])
        if far > 500:
            assert got[name].kind == "none" and got[name].distance_m is None and got[name].node is None
        else:
            assert abs(got[name].distance_m - far) < 1e-9, name
    rows = {}
    for counts in met:
        for c in counts.where("feature_id LIKE 'p%'").collect():
            rows[c.feature_id] = rows.get(c.feature_id, 0) + c["count"]
    # All roads within the reach would be some 1,000 a point.
    assert sum(rows.values()) / 60 < 150


def test_routes_write_what_their_frontier_touches(spark, monkeypatch):
    """Along a road of many squares each round rewrites a few of them, and the routes are those of a search by hand."""
    monkeypatch.setattr(network, "SQUARE_M", 500)
    sizes = []
    rewrite = state.PartTable.rewrite

    def noted(self, rows, parts):
        out = rewrite(self, rows, parts)
        sizes.append((len(parts), out.count(), len(glob.glob(f"{self.path.removeprefix('file:')}/v{self.last}/part=*"))))
        return out

    monkeypatch.setattr(state.PartTable, "rewrite", noted)
    road = [e for i in range(16) for e in (_edge(7, ((i + 1) * 100, 0), (i * 100, 0), f"r{i}", 5 + i % 3, "BLOCKED" if i == 8 else "OPEN"),)]
    short = [_edge(7, (1200, 0), (400, 0), "leap", 36), _edge(8, (100, 0), (0, 0), "else", 1)]
    edges = spark.createDataFrame([*road, *short], EDGE)
    sources = spark.createDataFrame([(7, {"cx": 0, "cy": 0}, "s"), (8, {"cx": 0, "cy": 0}, "t")], "request_id int, node struct<cx:long,cy:long>, source_id string")
    got = {(r.request_id, r.node.cx // 100): (r.time_s, r.source_id, r.length_m, tuple(r.blockers)) for r in network.shortest_access(edges, sources, width_s=20.0).collect()}
    time = [0.0]
    for i in range(16):
        time.append(min(time[-1] + 5 + i % 3, time[4] + 36 if i == 11 else math.inf))
    for i in range(17):
        seconds, source, length, blocked = got[7, i * 100]
        assert abs(seconds - time[i]) < 1e-9 and source == "s" and length == i * 100
        assert blocked == (("r8",) if 9 <= i <= 11 else ())
    assert got[8, 100] == (1.0, "t", 100.0, ()) and len(got) == 19
    rounds = sizes[2:]  # the edges and the sources come first
    assert max(parts for parts, *_ in rounds) <= 6 and sum(rows for _, rows, _ in rounds) < len(rounds) * 20


def test_versions_as_of_each_event(spark):
    at = lambda day, clock="12:00:00": f"2024-01-{day:02d} {clock}"
    rows = [
        ("a", 1, at(1), 0, "a1"), ("a", 2, at(3), 0, "a2"), ("a", 3, at(3, "23:59:59"), 0, "a3"), ("a", 4, at(3, "23:59:59.5"), 0, "a4"), ("a", 5, at(8), 1, "a5"),
        ("b", 6, at(5), 0, "b1"), ("c", 7, at(20), 0, "c1"), ("d", 8, at(2), 1, "d1"), ("d", 9, at(4, "00:00:00"), 0, "d2"), ("e", 10, None, 0, "e1"),
    ]
    versions = spark.createDataFrame(rows, "feature_id string, version long, ts string, deleted int, value string").select("feature_id", "version", F.col("ts").cast("timestamp_ntz").alias("version_ts"), "deleted", "value")
    days = {0: 1, 1: 2, 2: 4, 3: 4, 4: 5, 5: 9, 6: 31, 7: None}
    events = spark.createDataFrame([(k, f"2024-01-{d:02d}" if d else None) for k, d in days.items()], "request_id int, day string").select("request_id", F.col("day").cast("date").alias("event_date"))
    out = features.snapshot_asof(versions, events)
    got = {k: set() for k in days}
    for r in out.collect():
        got[r.request_id].add(r.value)
    assert got == {0: set(), 1: {"a1"}, 2: {"a3"}, 3: {"a3"}, 4: {"a4", "d2"}, 5: {"b1", "d2"}, 6: {"b1", "c1", "d2"}, 7: set()}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    assert features.snapshot_asof(versions, events.limit(0)).count() == 0 and features.snapshot_asof(versions.limit(0), events).count() == 0


def test_rings_are_ranked_across_blocks(spark):
    """A ring of cells around a hole, many blocks long, and two cells that touch at a corner."""
    frame = [(1, y, x) for y in range(30) for x in range(30) if y in (0, 29) or x in (0, 29)]
    cells = spark.createDataFrame([*frame, (1, 40, 40), (1, 41, 41), (2, 5, 5)], "grid_id int, y int, x int")
    rings = regions.region_rings(regions.boundary_edges(regions.label_regions(cells, 64, 8))).collect()
    got = {(r.grid_id, r.region, r.ring): [(p.x, p.y) for p in r.points] for r in rings}
    assert [len(p) for _, p in sorted(got.items())] == [4, 4, 4, 4, 4]
    outer, inner = got[1, 0, 0], got[1, 0, 1]
    assert outer[0] == (0, 0) and {*outer} == {(0, 0), (30, 0), (30, 30), (0, 30)} and {*inner} == {(1, 1), (29, 1), (29, 29), (1, 29)}
    turn = lambda p: sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2
    assert turn(outer) == -turn([(0, 0), (0, 30), (30, 30), (30, 0)]) or abs(turn(outer)) == 900
    assert turn(outer) * turn(inner) < 0


def test_routes_inside_a_square_take_one_round(spark, monkeypatch):
    """F8, F9, F15, F18, F19, F20: a long way inside one square is one round, whatever number of nodes it passes."""
    rounds = []
    rewrite = state.PartTable.rewrite
    monkeypatch.setattr(state.PartTable, "rewrite", lambda self, rows, parts: rounds.append(parts) or rewrite(self, rows, parts))
    edges = spark.createDataFrame([_edge(1, ((i + 1) * 50, 0), (i * 50, 0), f"r{i}", 9) for i in range(40)], EDGE)
    sources = spark.createDataFrame([(1, {"cx": 0, "cy": 0}, "s")], "request_id int, node struct<cx:long,cy:long>, source_id string")
    got = {r.node.cx // 5000: r.time_s for r in network.shortest_access(edges, sources).collect()}
    assert got == {i: 9.0 * i for i in range(41)} and len(rounds) == 3
