"""Overlay of concave, hollow, many-part and crossing shapes against brute force."""

from __future__ import annotations

import itertools
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from floodlake.operators import exposure
from floodlake.operators import features as ft
from floodlake.operators import overlay as ov
from floodlake.plans import overlay_queries

RINGS = "array<array<struct<x:double,y:double>>>"
U = [[(0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 10), (0, 10)]]
HOLLOW = [[(1, 1), (21, 2), (19, 17), (2, 15)], [(5, 5), (6, 12), (14, 11), (13, 6)]]
MANY = [[(0, 0), (4, 1), (2, 5)], [(8, 8), (15, 9), (12, 14)]]
SLAB, WIDTH = 4.0, 5.0


def _edges(rings):
    return [(*a, *b) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)]


def _area(rings):
    return sum(x1 * y2 - x2 * y1 for x1, y1, x2, y2 in _edges(rings)) / 2


def _common(one, two):
    """Area common to turned rings: what lies below both of each pair of edges, signed by their directions."""
    total, base = 0.0, min(y for r in one + two for _, y in r)
    for e, f in itertools.product(_edges(one), _edges(two)):
        u, v = max(min(e[0], e[2]), min(f[0], f[2])), min(max(e[0], e[2]), max(f[0], f[2]))
        if u < v:
            at = lambda g, x: g[1] + (g[3] - g[1]) * (x - g[0]) / (g[2] - g[0])
            du, dv = at(e, u) - at(f, u), at(e, v) - at(f, v)
            stops = [u, u + (v - u) * du / (du - dv), v] if du * dv < 0 else [u, v]
            below = sum((q - p) * (min(at(e, (p + q) / 2), at(f, (p + q) / 2)) - base) for p, q in itertools.pairwise(stops))
            total += below * (1 if e[0] > e[2] else -1) * (1 if f[0] > f[2] else -1)
    return total


def _inside(x, y, rings):
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in _edges(rings)) % 2 == 1


@pytest.fixture(scope="module")
def shapes():
    r = random.Random(1)
    out = []
    for i, rings in enumerate([U, HOLLOW, MANY] * 5):
        dx, dy, k = r.uniform(-20, 30), r.uniform(-20, 30), r.choice([1, 2, 0.5])
        out.append((i, [[(x * k + dx, y * k + dy) for x, y in ring] for ring in rings]))
    return out


def _frame(spark, shapes):
    rows = [(i, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for i, rings in shapes]
    return spark.createDataFrame(rows, f"id int, rings {RINGS}")


@pytest.fixture(scope="module")
def parts(spark, shapes):
    return ov.trapezoids(ov.ring_edges(_frame(spark, shapes), ["id"]), ["id"], SLAB).withColumn("k", F.lit(1)).cache()


def _areas(parts, *by):
    return {tuple(r)[:-1]: r.m2 for r in parts.groupBy(*by).agg(F.sum(ov.area()).alias("m2")).collect()}


def test_trapezoids_keep_areas_and_cells(spark, shapes, parts):
    assert _areas(parts, "id") == {(i,): pytest.approx(_area(rings)) for i, rings in shapes}
    plain = ov.trapezoids(ov.ring_edges(_frame(spark, shapes), ["id"]), ["id"], SLAB, crossing=False)
    assert _areas(plain, "id") == {(i,): pytest.approx(_area(rings)) for i, rings in shapes}
    cells = {(r.id, r.cy, r.cx): r.area for r in ov.cell_areas(parts, ["id"], SLAB).collect()}
    for i, rings in shapes[:6]:
        xs, ys = zip(*(p for ring in rings for p in ring), strict=True)
        for cy, cx in itertools.product(range(int(min(ys) // 4), int(max(ys) // 4) + 1), range(int(min(xs) // 4), int(max(xs) // 4) + 1)):
            box = [[(cx * 4, cy * 4), (cx * 4 + 4, cy * 4), (cx * 4 + 4, cy * 4 + 4), (cx * 4, cy * 4 + 4)]]
            assert cells.get((i, cy, cx), 0) == pytest.approx(_common(rings, box), abs=1e-8)


def test_intersections_of_all_pairs(shapes, parts):
    both = ov.intersection(parts, parts.withColumnRenamed("id", "other"), ["k"], WIDTH)
    got = _areas(both, "id", "other")
    want = {(i, j): _common(a, b) for (i, a), (j, b) in itertools.product(shapes, shapes)}
    assert len(got) > 60
    for pair, m2 in want.items():
        assert got.get(pair, 0) == pytest.approx(m2, abs=1e-7)


def test_crossing_and_overlapping_rings(spark):
    tie, squares = [[(0, 0), (4, 4), (4, 0), (0, 4)]], [[(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 2), (6, 2), (6, 6), (2, 6)]]
    edges = ov.ring_edges(_frame(spark, [(1, tie), (2, squares)]), ["id"])
    assert _areas(ov.trapezoids(edges, ["id"], 3.0), "id") == {(1,): pytest.approx(8), (2,): pytest.approx(24)}
    assert _areas(ov.trapezoids(edges, ["id"], 3.0, union=True), "id") == {(1,): pytest.approx(8), (2,): pytest.approx(28)}


def test_share_of_a_hollow_area(spark):
    area = ov.ring_edges(_frame(spark, [(1, HOLLOW)]), ["id"])
    box = [[(0, 0), (10, 0), (10, 30), (0, 30)]]
    seen = ov.ring_edges(_frame(spark, [(1, box), (2, [[(100, 100), (110, 100), (100, 110)]]), (3, [[(-50, -50), (90, -50), (90, 90), (-50, 90)]])]), ["id"]).withColumn("scene", F.col("id")).withColumn("id", F.lit(1))
    got = {r.scene: r.fraction for r in ov.covered_share(seen, area, ["id"], ["scene"], SLAB, WIDTH).collect()}
    assert got == {1: pytest.approx(_common(box, HOLLOW) / _area(HOLLOW)), 2: 0, 3: pytest.approx(1)}
    none = ov.covered_share(seen, area.limit(0), ["id"], ["scene"], SLAB, WIDTH).collect()
    assert sorted(r.fraction for r in none) == [0, 0, 0]


def test_exposure_of_a_concave_building(spark):
    """The cells between the arms of a U are wet and touch no part of it."""
    edges = ov.ring_edges(_frame(spark, [(1, U)]), ["id"]).select(F.lit(0).alias("grid_id"), F.col("id").cast("string").alias("feature_id"), "x1", "y1", "x2", "y2")
    flood = spark.createDataFrame([(0, y, x, 1 if 3 <= x < 7 and y >= 3 else 0) for y in range(12) for x in range(12)], "grid_id int, y int, x int, mask int")
    dry = exposure.shape_exposure(edges, flood, 1).first()
    assert (dry.footprint_m2, dry.overlap_m2, dry.affected) == (pytest.approx(72), 0, False)
    wet = exposure.shape_exposure(edges, flood.withColumn("mask", F.when((F.col("x") < 3) & (F.col("y") < 6), 1).otherwise(F.col("mask"))), 1).first()
    assert (wet.overlap_m2, wet.fraction, wet.affected) == (pytest.approx(18), pytest.approx(0.25), True)


def test_features_are_cut_at_a_bent_area(spark):
    at = lambda *points: [{"x": float(x), "y": float(y)} for x, y in points]
    rows = [
        (1, "box", "polygon", [at((2, 5), (8, 5), (8, 8), (2, 8))]), (1, "in", "polygon", [at((4, 0.5), (6, 0.5), (6, 2))]), (1, "out", "polygon", [at((4, 5), (6, 5), (5, 9))]),
        (1, "across", "line", [at((-5, 6), (15, 6))]), (1, "bent", "line", [at((1, 1), (1, 9), (5, 9))]), (1, "on", "point", [at((5, 1))]), (1, "off", "point", [at((5, 6))]), (1, "edge", "point", [at((10, 4))]),
        (2, "elsewhere", "point", [at((5, 1))]), (1, "none", None, []),
    ]
    features = spark.createDataFrame(rows, f"request_id int, feature_id string, kind string, parts {RINGS}")
    area = ov.trapezoids(ov.ring_edges(_frame(spark, [(1, U)]), ["id"]).withColumnRenamed("id", "request_id"), ["request_id"], SLAB)
    total = lambda f: F.aggregate("parts", F.lit(0.0), lambda s, p: s + f(p))
    size = F.when(F.col("kind") == "polygon", total(ft.ring_area)).when(F.col("kind") == "line", total(ft.line_length)).otherwise(F.size("parts"))
    got = {r.feature_id: (round(r["size"], 9), r.n, r.clipped) for r in ov.clip_features(features, area, ["request_id"], SLAB, WIDTH).select("feature_id", size.alias("size"), F.size("parts").alias("n"), "clipped").collect()}
    assert got.pop("box")[::2] == (6, True) and got.pop("in")[::2] == (1.5, False)
    assert got == {"out": (0, 0, True), "across": (6, 2, True), "bent": (10, 2, True), "on": (1, 1, False), "off": (0, 0, True), "edge": (1, 1, False), "elsewhere": (0, 0, True), "none": (0, 0, False)}


def test_a_sliver_beyond_is_no_clip(spark):
    """as in SQL, a polygon counts as clipped only if more than 1e-9 of its area lies beyond."""
    box = [[(0, 0), (10, 0), (10, 8), (0, 8)]]
    parts = ov.trapezoids(ov.ring_edges(_frame(spark, [(1, box)]), ["id"]).withColumnRenamed("id", "request_id"), ["request_id"], SLAB)
    rows = [(1, str(lost), "polygon", [[{"x": float(x), "y": float(y)} for x, y in ((1, 1), (10 + lost * 9, 1), (10 + lost * 9, 7), (1, 7))]]) for lost in (0, 4e-10, 4e-9, 0.1)]
    features = spark.createDataFrame(rows, f"request_id int, feature_id string, kind string, parts {RINGS}")
    got = {float(r.feature_id): r.clipped for r in ov.clip_features(features, parts, ["request_id"], SLAB, WIDTH).collect()}
    assert got == {0: False, 4e-10: False, 4e-9: True, 0.1: True}


def test_areas_far_from_the_origin_keep_their_digits(spark):
    """sizes are rounded to six digits, so the products of large coordinates must not take the digits behind them."""
    rings = [[(x + a, y + b) for a, b in ((0.0, 0.0), (17.1, 1.3), (12.7, 21.9), (3.3, 9.1))] for x, y in ((0.0, 0.0), (851.3, 907.7), (500_000.1, 2_500_000.7))]
    exact = [abs(float(sum(Fraction(a) * Fraction(d) - Fraction(c) * Fraction(b) for (a, b), (c, d) in zip(r, r[1:] + r[:1], strict=True)) / 2)) for r in rings]
    got = _frame(spark, [(i, [r]) for i, r in enumerate([*rings, []])]).select("id", ft.ring_area(F.get("rings", 0)).alias("m2")).collect()
    assert [r.m2 for r in sorted(got)] == [*[pytest.approx(m2, rel=0, abs=1e-12) for m2 in exact], 0]


def test_buffer_of_a_bent_area(spark):
    """Points within the distance, and no others; a convex ring's buffer has the area that follows from its length."""
    box = [[(0, 0), (10, 0), (10, 6), (0, 6)]]
    edges = ov.ring_edges(_frame(spark, [(1, U), (2, box), (3, HOLLOW)]), ["id"])
    wide = ov.buffered(edges, ["id"], 2.5, SLAB).cache()
    circle = 64 * math.sin(math.pi / 64) * math.cos(math.pi / 64) * 2.5**2
    assert _areas(wide.where("id = 2"), "id") == {(2,): pytest.approx(60 + 32 * 2.5 + circle)}
    r = random.Random(5)
    spots = [(i, r.uniform(-5, 26), r.uniform(-5, 22)) for i in range(400)]

    def apart(x, y, rings):
        if _inside(x, y, rings):
            return 0.0
        out = []
        for x1, y1, x2, y2 in _edges(rings):
            t = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
            out.append(math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)))
        return min(out)

    points = spark.createDataFrame([(i, k, x, y) for i, x, y in spots for k in (1, 3)], "spot int, id int, x double, y double")
    got = {(p.spot, p.id) for p in ov.points_inside(points, wide, ["spot", "id"], ["id"], SLAB, WIDTH).collect()}
    for i, x, y in spots:
        for k, rings in ((1, U), (3, HOLLOW)):
            far = apart(x, y, rings)
            if abs(far - 2.5) > 0.01:  # round corners have 64 sides
                assert ((i, k) in got) == (far < 2.5)


def test_slabs_are_swept_in_batches_without_joins(spark, monkeypatch):
    """F1, F16: edges pass a task once, in order of their slab; batches that cut a slab change nothing."""
    star = [[(20 * math.cos(i * 2.399), 20 * math.sin(i * 2.399)) for i in range(41)]]
    edges = ov.ring_edges(_frame(spark, [(1, star), (2, [[(0, 0), (9, 1), (3, 8)]]), (3, star)]), ["id"])
    parts = ov.trapezoids(edges, ["id"], 3.0)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    whole = sorted(tuple(r) for r in parts.collect())
    import pyarrow as pa

    rows = []
    mapped = spark.createDataFrame([], parts.schema)
    monkeypatch.setattr(type(mapped), "mapInArrow", lambda df, *_: rows.append(df.toPandas()) or mapped)
    ov.trapezoids(edges, ["id"], 3.0)
    t = pa.Table.from_pandas(rows[0].sort_values(["id", "slab"]), preserve_index=False)
    monkeypatch.setattr(ov, "EDGES", 10)
    monkeypatch.setattr(ov, "PAIRS", 7)
    got = [tuple(r.values()) for b in ov._swept(iter(t.to_batches(4)), ["id", "slab"], True, False) for r in b.to_pylist()]
    assert len(whole) > 500 and sorted(got) == whole


def test_equal_footprints_are_cut_once(spark, monkeypatch):
    """the work goes by the different shapes, all others take the result of their like."""
    box = lambda x: [(x, 0.0, x + 2, 0.0), (x + 2, 0.0, x + 2, 2.0), (x + 2, 2.0, x, 2.0), (x, 2.0, x, 0.0)]
    shapes = spark.createDataFrame([(1, f"s{i}", *e) for i in range(60) for e in box(float(i % 2))], "r int, id string, x1 double, y1 double, x2 double, y2 double")
    areas = spark.createDataFrame([(1, *e) for e in box(1.0)], "r int, x1 double, y1 double, x2 double, y2 double")
    seen = []
    whole = ov.trapezoids
    monkeypatch.setattr(ov, "trapezoids", lambda edges, keys, *a, **k: seen.append(edges.count()) or whole(edges, keys, *a, **k))
    got = {r.id: r.fraction for r in ov.covered_share(shapes, areas, ["r"], ["id"], 0.5, 1.0).collect()}
    assert got == {f"s{i}": pytest.approx(1.0 if i % 2 else 0.5) for i in range(60)} and sorted(seen) == [4, 8]


def test_borders_come_in_one_pass(spark):
    """the edges that SQL has, and the grids aren't looked for once an edge."""
    from conftest import SMALL

    grids = spark.range(3).selectExpr("CAST(id AS INT) AS request_id")
    want = overlay_queries._edges(spark, overlay_queries._BORDERS, grids=grids.withColumnRenamed("request_id", "grid_id")).collect()
    assert sorted(overlay_queries._borders(grids).collect()) == sorted(want) and len(want) == 24
    plan = overlay_queries.clip_to_shape(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 24


def test_what_is_dealt_to_buckets_is_never_broadcast(spark):
    """a long line or a wide shape makes many rows, however few bytes Spark takes them for."""
    parts = spark.sql("SELECT * FROM VALUES (1, 0L, 0D, 4D, 0D, 0D, 9000D, 9000D), (1, 1L, 4D, 8D, 0D, 0D, 9000D, 9000D) AS t(k, slab, y0, y1, l0, l1, r0, r1)")
    lines = spark.sql("SELECT * FROM VALUES (1, 'a', -5D, 1D, 8000D, 7D), (1, 'b', 1D, 9D, 5D, 20D) AS t(k, id, x1, y1, x2, y2)")
    points = spark.sql("SELECT * FROM VALUES (1, 'a', 1D, 1D), (1, 'b', 1D, 9D) AS t(k, id, x, y)")
    both = ov.intersection(parts, parts.withColumn("other", F.col("slab")), ["k"], WIDTH)
    inside, spots = ov.clip_lines(lines, parts, ["k", "id"], ["k"], SLAB, WIDTH), ov.points_inside(points, parts, ["k", "id"], ["k"], SLAB, WIDTH)
    for df in (both, inside, spots):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "HashJoin" not in plan
    assert both.count() == 2 and [r.id for r in inside.collect()] == ["a"] and [r.id for r in spots.collect()] == ["a"]
