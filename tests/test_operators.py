"""Small examples with known results."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodlake.functions import geo
from floodlake.operators import exposure, features, network, pixels, records, regions, scenes, tiles
from floodlake.policy import Policy


def test_policy_ladder_and_checks():
    assert Policy().windows == [12, 24, 48, 96]
    with pytest.raises(ValueError):
        Policy(weight_overlap=0.5)
    with pytest.raises(ValueError):
        Policy(tile_size=100)


def _scene(day: int, scene_id: str, **more):
    at = dt.datetime(2026, 9, 10, 12) + dt.timedelta(days=day)
    row = {"request_id": 1, "scene_id": scene_id, "platform": "s1a", "acquired_at": at, "product_type": "GRD", "instrument_mode": "IW", "polarizations": ["VH", "VV"], "orbit_direction": "ASCENDING", "relative_orbit": 10, "aoi_coverage_fraction": 1.0, "xmin": 0.0, "ymin": 0.0, "xmax": 1.0, "ymax": 1.0}
    return row | more


SCENE = "request_id int, scene_id string, platform string, acquired_at timestamp_ntz, product_type string, instrument_mode string, polarizations array<string>, orbit_direction string, relative_orbit int, aoi_coverage_fraction double, xmin double, ymin double, xmax double, ymax double"


def _pairing(spark, *rows):
    s = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCENE.replace("array<string>", "x").split(", ")) for r in rows], SCENE)
    r = spark.createDataFrame([(1, dt.date(2026, 9, 10))], "request_id int, event_date date")
    return s, r


def test_pair_found_only_at_the_second_window(spark):
    s, r = _pairing(spark, _scene(-20, "pre"), _scene(20, "post"))
    row = scenes.adaptive_pairing(s, r).first()
    assert (row.status, row.window_days, row.pre_id, row.post_id) == ("PAIRED", 24, "pre", "post")


def test_pair_ties_go_to_the_smaller_ids(spark):
    s, r = _pairing(spark, _scene(-3, "b-pre"), _scene(-3, "a-pre"), _scene(3, "b-post"), _scene(3, "a-post"))
    row = scenes.adaptive_pairing(s, r).first()
    assert (row.pre_id, row.post_id) == ("a-pre", "a-post")


def test_pair_rejections(spark):
    s, r = _pairing(spark, _scene(-3, "pre"), _scene(3, "post", relative_orbit=55))
    assert scenes.scene_pairs(s, r).first().reasons == ["mismatched_relative_orbit"]
    s, r = _pairing(spark, _scene(-3, "pre", aoi_coverage_fraction=0.2), _scene(3, "post"))
    assert scenes.adaptive_pairing(s, r).first().status == "S1_INSUFFICIENT_AOI_COVERAGE"
    s, r = _pairing(spark, _scene(0, "same-day"))
    assert scenes.adaptive_pairing(s, r).first().status == "S1_NO_VALID_PAIR"


def test_cloud_limit_is_a_percentage(spark):
    with pytest.raises(ValueError):
        scenes.filter_scenes(spark.range(1), max_cloud_cover=101)


def _grid(spark, n: int, value):
    return spark.createDataFrame([(0, y, x, float(value(y, x))) for y in range(n) for x in range(n)], "grid_id int, y int, x int, elevation double")


@pytest.mark.parametrize("size, expected", [(1.0, math.sqrt(13)), (10.0, math.sqrt(0.13))])
def test_slope_of_a_plane(spark, size, expected):
    rows = pixels.slope_horn(_grid(spark, 10, lambda y, x: 3 * y + 2 * x), size, size).collect()
    inner = [r.slope for r in rows if 0 < r.y < 9 and 0 < r.x < 9]
    assert len(inner) == 64 and all(abs(v - expected) < 1e-9 for v in inner)
    assert sum(r.slope is None for r in rows) == 36


def test_one_region_of_a_square(spark):
    cells = spark.createDataFrame([(0, y, x, 1, 0.8) for y in range(5, 15) for x in range(6, 16)], "grid_id int, y int, x int, mask int, probability double")
    for block in (512, 4):
        row = regions.flood_regions(cells, 20, 0.0001, block=block).collect()
        assert len(row) == 1 and row[0].cells == 100 and abs(row[0].area_km2 - 0.01) < 1e-12 and abs(row[0].mean_probability - 0.8) < 1e-12
    rings = regions.region_rings(regions.boundary_edges(regions.label_regions(cells, 20))).collect()
    assert [[(p.x, p.y) for p in r.points] for r in rings] == [[(6, 5), (6, 15), (16, 15), (16, 5)]] or len(rings[0].points) == 4


def test_spiral_region_is_one(spark):
    on = {(0, x) for x in range(9)} | {(y, 8) for y in range(9)} | {(8, x) for x in range(9)} | {(y, 0) for y in range(2, 9)} | {(2, x) for x in range(7)} | {(y, 6) for y in range(2, 7)}
    cells = spark.createDataFrame([(0, y, x) for y, x in on], "grid_id int, y int, x int")
    for block in (512, 3):
        assert {r.region for r in regions.label_regions(cells, 9, block).select("region").distinct().collect()} == {0}


def test_tiles_reject_a_wrong_scorer(spark):
    p = spark.createDataFrame([(0, 0, 0, True, 0.0, 0.0, 0.0, 0.0, 0.0)], "grid_id int, y int, x int, valid boolean, pre_vv_n double, pre_vh_n double, post_vv_n double, post_vh_n double, slope_n double")
    with pytest.raises(Exception, match="not"):
        tiles.score_tiles(p, lambda a, b: np.zeros((2, 2))).collect()
    with pytest.raises(Exception, match="outside"):
        tiles.score_tiles(p, lambda a, b: a[0] + 2).collect()


def _flood(spark, wet, size: int = 12):
    return spark.createDataFrame([(0, y, x, int((y, x) in wet)) for y in range(size) for x in range(size)], "grid_id int, y int, x int, mask int")


def test_half_flooded_building(spark):
    b = spark.createDataFrame([("b", 0, 5.0, 0.0, 15.0, 10.0)], "feature_id string, grid_id int, xmin double, ymin double, xmax double, ymax double")
    row = exposure.building_exposure(b, _flood(spark, {(0, 1)}), 10.0).first()
    assert row.overlap_m2 == 50 and row.fraction == 0.5 and row.affected
    none = exposure.building_summary(exposure.building_exposure(b.limit(0), _flood(spark, set()), 10.0)).first()
    assert none.total_count == 0 and none.affected_fraction == 0


ROAD = "feature_id string, grid_id int, x1 double, y1 double, x2 double, y2 double, highway string, oneway string, maxspeed string, bridge string, tunnel string"


def test_road_is_cut_at_the_flood(spark):
    road = spark.createDataFrame([("r", 0, 0.0, 5.0, 100.0, 5.0, "residential", None, None, None, None)], ROAD)
    rows = exposure.road_segments(road, _flood(spark, {(0, 4), (0, 5)}), 10.0).orderBy("seq").collect()
    assert [(r.status, round(r.length_m, 9)) for r in rows] == [("OPEN", 40), ("BLOCKED", 20), ("OPEN", 40)]
    assert abs(exposure.road_summary(exposure.road_segments(road, _flood(spark, {(0, 4), (0, 5)}), 10.0)).first().blocked_km - 0.02) < 1e-12
    dark = exposure.road_segments(road, _flood(spark, set(), 3), 10.0).collect()
    assert [r.status for r in dark] == ["UNKNOWN_COVERAGE"]


def test_diagonal_road_keeps_its_length(spark):
    road = spark.createDataFrame([("r", 0, 3.0, 7.0, 93.0, 61.0, "residential", None, None, None, None)], ROAD)
    rows = exposure.road_segments(road, _flood(spark, {(2, 3), (2, 4), (4, 6), (5, 8)}), 10.0).collect()
    assert abs(sum(r.length_m for r in rows) - math.hypot(90, 54)) < 1e-6


def test_bridge_near_the_flood(spark):
    bridge = spark.createDataFrame([("b", 0, 0.0, 5.0, 100.0, 5.0, "primary", None, None, "yes", None)], ROAD)
    assert exposure.bridge_exposure(bridge, _flood(spark, {(2, 5)}), 10.0).first().status == "AFFECTED"
    assert exposure.bridge_exposure(bridge, _flood(spark, {(3, 5)}), 10.0).first().status == "NOT_AFFECTED"


SEGMENT = "request_id int, segment_id string, parent_road_id string, x1 double, y1 double, x2 double, y2 double, highway string, oneway string, maxspeed string, status string"


def _network(spark, *rows):
    return network.road_edges(spark.createDataFrame([(1, f"s{i}", f"p{i}", *r) for i, r in enumerate(rows)], SEGMENT))


def _status(spark, edges, home=(100.0, 0.0)):
    source = spark.createDataFrame([(1, "s", 0.0, 0.0)], "request_id int, source_id string, x double, y double").select("request_id", "source_id", network.node(F.col("x"), F.col("y")).alias("node"))
    h = spark.createDataFrame([(1, "h", "Home", *home)], "request_id int, feature_id string, name string, x double, y double").select("request_id", "feature_id", "name", network.node(F.col("x"), F.col("y")).alias("node"))
    return network.settlement_access(h, network.shortest_access(edges, source), network.shortest_access(network.post_event_edges(edges), source)).first()


def test_detour_and_cut_off(spark):
    direct = (0.0, 0.0, 100.0, 0.0, "residential", None, None, "BLOCKED")
    around = [(0.0, 0.0, 0.0, 50.0, "residential", None, None, "OPEN"), (0.0, 50.0, 100.0, 50.0, "residential", None, None, "OPEN"), (100.0, 50.0, 100.0, 0.0, "residential", None, None, "OPEN")]
    row = _status(spark, _network(spark, direct, *around))
    assert (row.status, row.before_m, row.after_m, row.blockers) == ("DETOUR", 100, 200, ["p0"])
    row = _status(spark, _network(spark, direct))
    assert (row.status, row.blockers) == ("CUT_OFF", ["p0"])
    assert _status(spark, _network(spark, direct), home=(900.0, 900.0)).status == "NO_BASELINE_ACCESS"


def test_one_way_and_strict_policy(spark):
    edges = _network(spark, (0.0, 0.0, 100.0, 0.0, "residential", "yes", None, "POTENTIALLY_BLOCKED"), (0.0, 9.0, 100.0, 9.0, "footway", None, None, "OPEN"))
    assert edges.count() == 1
    assert network.post_event_edges(edges).count() == 1 and network.post_event_edges(edges, strict=True).count() == 0


def test_point_snaps_to_an_edge_and_splits_it(spark):
    edges = _network(spark, (0.0, 0.0, 100.0, 0.0, "residential", None, None, "OPEN"))
    p = spark.createDataFrame([(1, "p", 50.0, 5.0), (1, "far", 5000.0, 5.0)], "request_id int, feature_id string, x double, y double")
    snapped = {r.feature_id: r for r in network.snap_points(p, edges).collect()}
    assert snapped["p"].kind == "edge" and snapped["p"].distance_m == 5 and snapped["far"].kind == "none"
    parts = network.split_edges(edges, network.snap_points(p, edges)).collect()
    assert sorted(r.length_m for r in parts) == [50, 50, 50, 50]


def test_speeds(spark):
    rows = spark.createDataFrame([("30 mph",), ("40;60",), ("walk",), ("0",), (None,)], "t string").select(geo.speed_kmh(F.col("t"), F.lit(30.0)).alias("v")).collect()
    assert [round(r.v, 3) for r in rows] == [48.28, 40, 30, 30, 30]


def test_small_square_on_the_equator(spark):
    row = spark.range(1).select(geo.ring_km2(F.array(*map(F.lit, (0.0, 0.02, 0.02, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 0.02, 0.02)))).alias("a")).first()
    assert abs(row.a - 4.9236) < 1e-3


def test_evaluation_scores(spark):
    cells = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 1)] + [(0, 0)] * 11 + [(None, 1)], "predicted int, reference int")
    row = records.mask_evaluation(cells, 1.0).first()
    assert (row.tp, row.fp, row.fn, row.tn, row.iou, row.f1, row.precision, row.recall) == (3, 1, 1, 11, 0.6, 0.75, 0.75, 0.75)


def test_secrets_are_masked(spark):
    row = spark.createDataFrame([("password=hunter2 token: abc Bearer xyz",)], "t string").select(records.redact(F.col("t")).alias("t")).first()
    assert "hunter2" not in row.t and "abc" not in row.t and "xyz" not in row.t


def test_category_is_tested_on_kind(spark):
    rows = spark.createDataFrame([("polygon", {"building": "yes"}), ("point", {"building": "yes"}), ("line", {"highway": "x"}), ("point", {"amenity": "clinic"}), ("point", {"natural": "tree"})], "kind string, tags map<string,string>")
    assert [r.c for r in rows.select(features.category("tags", F.col("kind")).alias("c")).collect()] == ["building", None, "road", "healthcare", None]


def test_equally_quick_routes_follow_source_then_next_node(spark):
    """Against a search in Python, on a grid whose routes tie often."""
    rng = random.Random(3)
    edges = []
    for x in range(6):
        for y in range(6):
            for nx, ny in ((x + 1, y), (x, y + 1)):
                if nx < 6 and ny < 6:
                    status = rng.choice(["OPEN", "OPEN", "BLOCKED"])
                    for a, b in (((x, y), (nx, ny)), ((nx, ny), (x, y))):
                        edges.append((a, b, float(rng.choice([10, 10, 20])), 100.0 + rng.randrange(3), status, f"r{x}{y}{nx}"))
    rows = [(0, b[0], b[1], a[0], a[1], t, m, s, r) for a, b, t, m, s, r in edges]  # an edge src to dst is used from dst's source on
    frame = spark.createDataFrame(rows, "request_id int, sx long, sy long, dx long, dy long, time_s double, length_m double, status string, parent_road_id string")
    point = lambda p: F.struct(F.col(f"{p}x").alias("cx"), F.col(f"{p}y").alias("cy"))
    frame = frame.select("request_id", point("s").alias("src"), point("d").alias("dst"), "time_s", "length_m", "status", "parent_road_id")
    starts = {(0, 0): "b", (5, 5): "a", (0, 5): "c"}
    sources = spark.createDataFrame([(0, x, y, n) for (x, y), n in starts.items()], "request_id int, sx long, sy long, source_id string").select("request_id", point("s").alias("node"), "source_id")
    got = {(r.node.cx, r.node.cy): (r.time_s, r.source_id, round(r.length_m, 3), tuple(r.blockers)) for r in network.shortest_access(frame, sources).collect()}
    time = {n: 0.0 for n in starts}
    for _ in range(60):
        for a, b, t, *_ in edges:
            if a in time and time[a] + t < time.get(b, 1e9):
                time[b] = time[a] + t
    best = {}
    for n in sorted(time, key=time.get):
        if n in starts:
            best[n] = (0.0, starts[n], 0.0, ())
            continue
        offers = [(best[a][1], a, m, s, r) for a, b, t, m, s, r in edges if b == n and a in best and abs(time[a] + t - time[n]) < 1e-9]
        source, a, m, s, r = min(offers)
        roads = set(best[a][3]) | ({r} if s == "BLOCKED" else set())
        best[n] = (time[n], source, round(best[a][2] + m, 3), tuple(sorted(roads)))
    assert got == best


def test_share_of_a_bridge_corridor(spark):
    """Against points sampled in the corridor; the switch asks for that share."""
    rng = random.Random(5)
    wet = {(rng.randrange(12), rng.randrange(12)) for _ in range(30)}
    lines = {"a": (20.0, 55.0, 95.0, 55.0), "b": (25.0, 30.0, 85.0, 90.0), "c": (60.0, 95.0, 40.0, 20.0), "d": (50.0, 50.0, 50.0, 90.0)}
    bridges = spark.createDataFrame([(n, 0, *p, "primary", None, None, "yes", None) for n, p in lines.items()], ROAD)
    got = {r.feature_id: r for r in exposure.bridge_exposure(bridges, _flood(spark, wet), 10.0).collect()}
    strict = {r.feature_id: r for r in exposure.bridge_exposure(bridges, _flood(spark, wet), 10.0, Policy(bridge_block_on_contact=False, bridge_overlap_fraction=0.25)).collect()}
    for name, (x1, y1, x2, y2) in lines.items():
        gy, gx = np.mgrid[-30:150:0.25, -30:150:0.25] + 0.125
        t = np.clip(((gx - x1) * (x2 - x1) + (gy - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0, 1)
        inside = np.hypot(gx - x1 - t * (x2 - x1), gy - y1 - t * (y2 - y1)) <= 20
        flooded = np.isin(np.floor(gy / 10) * 1000 + np.floor(gx / 10), [y * 1000 + x for y, x in wet])
        share = (inside & flooded).sum() / inside.sum()
        assert abs(got[name].overlap_fraction - share) < 0.004 and got[name].status == "AFFECTED"
        assert strict[name].status == ("AFFECTED" if got[name].overlap_fraction >= 0.25 else "NOT_AFFECTED")


def test_cells_along_a_line_are_its_own(spark):
    """Every cell that the line crosses is asked for, and few others."""
    lines = [("a", 3.0, 7.0, 912.0, 655.0), ("b", 500.5, 800.5, 20.5, 11.5), ("c", 5.0, 5.0, 5.0, 305.0), ("d", -40.0, 20.0, 333.0, -71.0)]
    frame = spark.createDataFrame(lines, "feature_id string, x1 double, y1 double, x2 double, y2 double")
    got = {(r.feature_id, r.cy, r.cx) for r in exposure.crossed_cells(frame, 10.0).collect()}
    for name, x1, y1, x2, y2 in lines:
        t = np.linspace(0, 1, 20_001)[1:-1]
        want = {(name, int(y), int(x)) for y, x in zip(np.floor((y1 + (y2 - y1) * t) / 10), np.floor((x1 + (x2 - x1) * t) / 10), strict=True)}
        assert want <= got
        assert sum(k[0] == name for k in got) <= 4 * len(want)


def test_polygon_with_a_hole_is_rasterised(spark):
    rings = [[(3.0, 4.0), (97.0, 22.0), (70.0, 91.0), (41.0, 55.0), (12.0, 88.0)], [(40.0, 25.0), (66.0, 33.0), (52.0, 48.0)]]
    sides = [("p", *a, *b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    got = {(r.cy, r.cx) for r in exposure.rasterize(spark.createDataFrame(sides, "feature_id string, x1 double, y1 double, x2 double, y2 double"), 5.0).collect()}
    want = set()
    for cy in range(-2, 25):
        for cx in range(-2, 25):
            px, py = cx * 5 + 2.5, cy * 5 + 2.5
            if sum((y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 for _, x1, y1, x2, y2 in sides) % 2:
                want.add((cy, cx))
    assert got == want


def test_rings_give_back_their_edges(spark):
    rng = random.Random(8)
    cells = spark.createDataFrame([(g, y, x) for g in (0, 1) for y in range(14) for x in range(14) if rng.random() < 0.6], "grid_id int, y int, x int")
    edges = regions.boundary_edges(regions.label_regions(cells, 14, 5)).cache()
    want = sorted((e.grid_id, e.region, e.x1, e.y1, e.x2, e.y2) for e in edges.collect())
    got = []
    for r in regions.region_rings(edges).collect():
        for p, q in zip(r.points, r.points[1:] + r.points[:1], strict=True):
            n = abs(q.x - p.x) + abs(q.y - p.y)
            dx, dy = (q.x - p.x) // n, (q.y - p.y) // n
            got += [(r.grid_id, r.region, p.x + i * dx, p.y + i * dy, p.x + (i + 1) * dx, p.y + (i + 1) * dy) for i in range(n)]
    assert sorted(got) == want


def test_first_source_of_a_node(spark):
    at = spark.createDataFrame([(1, "b", 2, 0), (1, "a", 9, 0), (1, "c", 1, 5), (1, "d", 0, None)], "request_id int, source_id string, seq int, cx int").withColumn("node", F.when(F.col("cx").isNotNull(), F.struct("cx")))
    assert {(r.node.cx, r.source_id) for r in network.sources_by_node(at, "seq").collect()} == {(0, "b"), (5, "c")}
    assert {(r.node.cx, r.source_id) for r in network.sources_by_node(at).collect()} == {(0, "a"), (5, "c")}


def test_place_beside_a_road_is_routed_along_it(spark):
    row = lambda i, status, *ends: (1, f"s{i}", f"p{i}", *ends, "residential", None, None, status)
    places = spark.createDataFrame([(1, "town", "T", 0.0, 0.0, False, True), (1, "home", "H", 50.0, 5.0, True, False), (1, "far", "F", 9000.0, 0.0, True, False)], "request_id int, feature_id string, name string, x double, y double, settlement boolean, source boolean")
    for status, expected in (("OPEN", "CONNECTED"), ("BLOCKED", "CUT_OFF")):
        segments = spark.createDataFrame([row(0, status, 0.0, 0.0, 100.0, 0.0), row(1, "OPEN", 0.0, 0.0, 0.0, 40.0)], SEGMENT)
        got = {r.feature_id: r for r in network.access_of_places(segments, places).collect()}
        assert (got["home"].status, got["home"].before_m) == (expected, 50) and got["far"].status == "NO_BASELINE_ACCESS"
        assert got["far"].reason == "no road node within 500 m" and got["home"].before_source == "town"
    # A town whose only road is closed is no source after the event, not even for itself.
    shut = spark.createDataFrame([row(0, "BLOCKED", 0.0, 0.0, 100.0, 0.0)], SEGMENT)
    assert network.access_of_places(shut, places.where("feature_id = 'town'").withColumn("settlement", F.lit(True))).first().status == "CUT_OFF"


def test_manifest_names_scenes_and_last_states(spark):
    artifacts = spark.createDataFrame([(1, "b", "x"), (1, "a", "y")], "request_id int, path string, sha256 string")
    requests = spark.createDataFrame([(1, dt.date(2026, 1, 1)), (2, dt.date(2026, 1, 2))], "request_id int, event_date date")
    pairs = spark.createDataFrame([(1, "p", "q")], "request_id int, pre_id string, post_id string")
    stages = spark.createDataFrame([(1, "OSM", "RUNNING", 1), (1, "OSM", "SUCCEEDED", 2)], "request_id int, stage string, status string, seq int")
    rows = {r.request_id: r for r in records.run_manifest(artifacts, requests, pairs, stages).collect()}
    assert [a.path for a in rows[1].artifacts] == ["a", "b"] and tuple(rows[1].selected_scenes) == ("p", "q") and [tuple(s) for s in rows[1].stages] == [("OSM", "SUCCEEDED")]
    assert rows[2].artifacts is None and rows[2].selected_scenes is None


def _area(ring):
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def test_rings_are_taken_apart_where_they_cross():
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert features.loops(square) == [square]
    assert sorted(map(_area, features.loops([(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]))) == [1, 1]
    # Two squares that meet in a corner, drawn in one go; a spike; points on a line; too few.
    assert sorted(map(_area, features.loops([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0), (0.0, 1.0)]))) == [1, 1]
    assert [_area(r) for r in features.loops([(0.0, 0.0), (2.0, 0.0), (3.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])] == [4]
    assert features.loops([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]) == features.loops([(0.0, 0.0), (1.0, 1.0)]) == features.loops([]) == []


DRAWN = "request_id int, osm_type string, osm_id long, kind string, tags map<string,string>, points array<struct<x:double,y:double>>"


def test_shapes_are_cut_at_their_area(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for i in range(60):  # a convex ring's cut area by counting fine cells
        at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(5))
        cx, cy, r = rng.uniform(-3, 13), rng.uniform(-3, 13), rng.uniform(1, 6)
        ring = [(cx + r * math.cos(t), cy + r * math.sin(t)) for t in at]
        rows.append((1, "way", i, "polygon", {"building": "yes"}, ring))
        g = (np.arange(400) + 0.5) / 40
        x, y = np.meshgrid(g, g)
        want[i] = np.logical_and.reduce([(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]).sum() / 1600
    rows += [(1, "way", 100, "line", {"highway": "track"}, [(-5.0, 1.0), (5.0, 1.0), (5.0, 20.0), (6.0, 20.0), (6.0, 9.0)]), (1, "way", 101, "line", {"highway": "track"}, [(-5.0, -5.0), (-1.0, 20.0)])]
    rows += [(1, "node", 102, "point", {"place": "town", "name": None}, [(10.0, 0.0)]), (1, "node", 103, "point", {}, [(10.5, 0.0)]), (1, "node", 104, None, {}, None)]
    rows += [(2, "node", 105, "point", {"place": "town"}, [(1.0, 1.0)]), (1, "way", 106, "polygon", {"building": "yes"}, [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)]), (1, "node", 107, "point", {}, [(3.0, 3.0)])]
    box = spark.createDataFrame([(1, 1, 1, 9, 9)], "request_id int, xmin int, ymin int, xmax int, ymax int")
    out = features.normalize_features(features.clip_parts(features.repair(spark.createDataFrame(rows, DRAWN)), box, 1.0)).cache()
    got = {r.osm_id: r for r in out.collect()}
    for i, area in want.items():
        assert sum(_area([tuple(p) for p in ring]) for ring in got[i].parts) == pytest.approx(area, abs=0.15)
    assert [[tuple(p) for p in line] for line in got[100].parts] == [[(0, 1), (5, 1)], [(5, 1), (5, 10)], [(6, 10), (6, 9)]] and got[100].clipped
    assert {i: got[i].outcome for i in range(101, 108)} == {101: "dropped_empty", 102: "retained", 103: "dropped_empty", 104: "dropped_empty", 105: "dropped_empty", 106: "dropped_empty", 107: "ignored"}
    assert not got[102].clipped and got[102].tags == {"place": "town"} and got[106].repaired
    q = features.feature_quality(out).first()
    assert (q.rows, q.ignored, q.repaired) == (len(rows), 1, 1) and q.clipped == sum(r.clipped for r in got.values())
    empty = features.normalize_features(features.clip_parts(features.repair(spark.createDataFrame([], DRAWN)), box, 1.0))
    assert tuple(features.feature_quality(empty).first()) == (0, 0, 0, 0, 0, 0)


def test_degrees_come_back_from_metres(spark):
    rng = random.Random(10)
    places = spark.createDataFrame([(rng.uniform(-180, 180), rng.uniform(-79, 83)) for _ in range(300)], "lon double, lat double").withColumn("epsg", geo.utm_epsg(F.col("lon"), F.col("lat")))
    east, north = geo.utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    lon, lat = geo.lon_lat(F.col("east"), F.col("north"), F.col("epsg"))
    for r in places.withColumns({"east": east, "north": north}).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert r.a == pytest.approx(r.lon, abs=1e-8) and r.b == pytest.approx(r.lat, abs=1e-8)


def test_near_pairs_hold_the_first_of_all_pairs(spark):
    """Many scenes of few kinds, equal gaps among them: the first pairs are those of all, from far fewer."""
    rng = random.Random(4)
    rows = [(k % 3, f"s{k:03d}", f"2020-01-{rng.randrange(1, 29):02d} 06:00:00", rng.choice(["p", "q"]), rng.choice(["GRD", None]), "IW", rng.choice([["VV"], None]), rng.choice(["A", "D"]), rng.choice([1, 2]), rng.choice([0.1, 0.9, 1.0, None]), 0.0, 0.0, 1.0, 1.0) for k in range(240)]
    found = spark.createDataFrame(rows, "request_id int, scene_id string, at string, platform string, product_type string, instrument_mode string, polarizations array<string>, orbit_direction string, relative_orbit int, aoi_coverage_fraction double, xmin double, ymin double, xmax double, ymax double")
    found = found.withColumn("acquired_at", F.col("at").cast("timestamp_ntz")).drop("at")
    requests = spark.createDataFrame([(i, "2020-01-15") for i in range(4)], "request_id int, day string").select("request_id", F.col("day").cast("date").alias("event_date"))
    every, near = scenes.scene_pairs(found, requests), scenes.near_pairs(found, requests, most=5).cache()
    for pairs in (every, every.where("FALSE")):
        best = scenes.best_pair(scenes.score_pairs(pairs, F.lit(30)))
        got, want = ([(r.request_id, r["rank"], r.pre.scene_id, r.post.scene_id, tuple(r.reasons)) for r in scenes.pair_alternatives(p, best, 5).orderBy("request_id", "rank").collect()] for p in (near, every))
        assert got == want and len(got) == 15
    assert near.count() < every.count() / 3
    key = lambda df: sorted((r.request_id, r.pre.scene_id, r.post.scene_id) for r in df.collect())
    assert key(scenes.valid_pairs(found, requests)) == key(every.where("size(reasons) = 0"))


def test_polar_codes_forth_and_back(spark):
    """The worked example of the projection's standard, true length on the true parallel, and the way back."""
    rng = random.Random(11)
    places = [(50.0, -75.0, 3031), (45.0, 70.0, 3413), *((rng.uniform(-180, 180), rng.choice([-1, 1]) * rng.uniform(60, 89.99), 0) for _ in range(100))]
    rows = spark.createDataFrame([(lon, lat, epsg or (3413 if lat > 0 else 3031)) for lon, lat, epsg in places], "lon double, lat double, epsg int")
    east, north = geo.metric(F.col("lon"), F.col("lat"), F.col("epsg"))
    lon, lat = geo.degrees(F.col("east"), F.col("north"), F.col("epsg"))
    got = rows.withColumns({"east": east, "north": north}).select("*", lon.alias("a"), lat.alias("b")).collect()
    by = {(r.lon, r.lat): r for r in got}
    south, true = by[50.0, -75.0], by[45.0, 70.0]
    assert south.east == pytest.approx(1255380.79, abs=0.01) and south.north == pytest.approx(1053389.56, abs=0.01)
    sine = math.sin(math.radians(70))
    assert true.east == pytest.approx(geo.A * math.cos(math.radians(70)) / math.sqrt(1 - geo.E2 * sine * sine), abs=1e-3) and true.north == pytest.approx(0, abs=1e-6)
    for r in got:
        assert r.a == pytest.approx(r.lon, abs=1e-7) and r.b == pytest.approx(r.lat, abs=1e-9)
    assert rows.select(geo.polar(F.col("lon"), F.col("lat"), F.lit(32633))[0].alias("e")).where("e IS NOT NULL").count() == 0


def test_rasters_of_other_cells_are_compared(spark):
    """A 4 x 4 prediction of 10 m cells on a 2 x 2 reference of 20 m; unknown cells of either side are left out."""
    grid = "grid_id int, y int, x int, value double"
    predicted = spark.createDataFrame([(1, y, x, None if (y, x) == (0, 3) else float(y < 2)) for y in range(4) for x in range(4)], grid)
    reference = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 1, 0.0), (1, 1, 0, 0.5), (1, 1, 1, None), (2, 0, 0, 1.0)], grid)
    row = records.compare_rasters(predicted, reference, 10, 20).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (4, 3, 4, 0) and row.predicted_km2 == pytest.approx(0.0007)
    moved = records.compare_rasters(predicted, reference, 10, 20, (0.0, -20.0)).first()
    assert (moved.tp, moved.fp, moved.fn, moved.tn) == (3, 0, 4, 0)


def test_leading_pairs_hold_the_best_of_all(spark):
    """F2, F3: gaps beyond the window, equal scores and unknown platforms or coverage; scenes that cannot win are not paired."""
    rng = random.Random(8)
    rows = [(k % 3, f"s{k:03d}", f"2020-01-{rng.randrange(1, 29):02d} {rng.choice(['06', '18'])}:00:00", rng.choice(["p", "q"] if k % 3 else [None, "p"]), "GRD", "IW", ["VV"], rng.choice(["A", "D"]), 1, rng.choice([0.1, 0.8, 0.9, 1.0, None] if k % 3 < 2 else [None]), float(k % 2), 0.0, k % 2 + 2.0, 1.0) for k in range(300)]
    found = spark.createDataFrame(rows, "request_id int, scene_id string, at string, platform string, product_type string, instrument_mode string, polarizations array<string>, orbit_direction string, relative_orbit int, aoi_coverage_fraction double, xmin double, ymin double, xmax double, ymax double")
    found = found.withColumn("acquired_at", F.col("at").cast("timestamp_ntz")).drop("at")
    requests = spark.createDataFrame([(i, "2020-01-15") for i in range(4)], "request_id int, day string").select("request_id", F.col("day").cast("date").alias("event_date"))
    for window, weights in ((14, Policy()), (6, Policy()), (14, Policy(weight_post_closeness=0.0, weight_overlap=0.5))):
        every, few = scenes.scene_pairs(found, requests, days=window), scenes.leading_pairs(found, requests, window, weights)
        got, want = ([(r.request_id, r.pre.scene_id, r.post.scene_id, r.score) for r in scenes.best_pair(scenes.score_pairs(p, F.lit(window), weights)).orderBy("request_id").collect()] for p in (few, every))
        assert got == want and len(got) == 3 and few.count() < scenes.valid_pairs(found, requests, days=window).count() / 2
    # pairs are dealt out by kinds, not by request alone.
    plan = scenes.scene_pairs(found, requests)._jdf.queryExecution().executedPlan().toString()
    assert "post_kind" in plan
