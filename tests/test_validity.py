"""Validity of polygons against known shapes and every pair of edges."""

from __future__ import annotations

import math
import random
import time

from floodlake.operators import validity

SHAPES = "id long, polygons array<array<array<struct<x: double, y: double>>>>"


def _box(x1, y1, x2, y2):
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]


def _found(spark, shapes):
    frame = spark.createDataFrame(list(enumerate(shapes)), SHAPES)
    return {r.id: r.fault for r in validity.faults(frame, "id").collect()}


def test_known_shapes(spark):
    square, hole = _box(0.0, 0.0, 10.0, 10.0), _box(2.0, 2.0, 4.0, 4.0)
    fine = [
        [[square]], [[[*square, square[0]]]], [[square, hole]], [[square, hole, _box(5.0, 5.0, 6.0, 6.0)]], [[square], [_box(20.0, 0.0, 30.0, 10.0)]],
        [[square, hole], [_box(2.5, 2.5, 3.5, 3.5)]],  # an island in a hole
        [[square], [_box(10.0, 10.0, 12.0, 12.0)]],  # parts that touch in a corner
        [[square, [(0.0, 5.0), (3.0, 4.0), (3.0, 6.0)]]],  # a hole that touches its outer ring in a point
        [[[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 2.0), (0.0, 10.0)]]], None, [], [[]], [[[]]], [[[(1.0, 1.0)] * 4]], [[[(0.0, 0.0), (0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (4.0, 4.0)]]],
    ]
    crossing = [
        [[[(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]]],
        [[square, _box(8.0, 8.0, 12.0, 9.0)]],
        [[square], [_box(5.0, 5.0, 15.0, 15.0)]],
        [[square], [_box(10.0, 2.0, 12.0, 5.0)]],  # parts along one another
        [[[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 0.0), (0.0, 10.0)]]],  # a corner on an edge of its own ring
        [[[(0.0, 0.0), (4.0, 0.0), (6.0, 0.0), (4.0, 0.0), (4.0, 4.0)]]],  # there and back
        [[square], [square]],
        [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0), (0.0, 1.0)]]],  # a point met twice
    ]
    misplaced = [[[square, _box(20.0, 2.0, 22.0, 4.0)]], [[square, hole, _box(2.5, 2.5, 3.0, 3.0)]], [[square], [hole]], [[_box(2.0, 2.0, 3.0, 3.0), square]]]
    # Rings that cross just in corners: all edges are tested, not one of each ring.
    diamond = [(-2.0, 5.0), (5.0, -2.0), (12.0, 5.0), (5.0, 12.0)]
    misplaced.append([[diamond, [(5.0, 12.0), (3.0, 14.0), (3.0, 5.0)]]])
    got = _found(spark, fine + crossing + misplaced)
    n, m = len(fine), len(fine) + len(crossing)
    assert not [i for i in got if i < n]
    assert {i: got.get(i) for i in range(n, m)} == {i: "crossing" for i in range(n, m)}
    assert all(i in got for i in range(m, m + len(misplaced))) and [got[i] for i in range(m, m + 4)] == ["misplaced"] * 4
    assert _found(spark, []) == {}


def test_rings_against_all_pairs_of_edges(spark):
    def bad(ring):
        ring = [p for i, p in enumerate(ring) if p != ring[i - 1]]
        n = len(ring)
        turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        on = lambda p, a, b: turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])
        for i in range(n if n >= 3 else 0):
            a, b = ring[i], ring[(i + 1) % n]
            c = ring[(i + 2) % n]
            if turn(a, b, c) == 0 and (a[0] - b[0]) * (c[0] - b[0]) + (a[1] - b[1]) * (c[1] - b[1]) > 0:
                return True
            for j in range(i + 2, n - (i == 0)):
                c, d = ring[j], ring[(j + 1) % n]
                if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0 or on(a, c, d) or on(b, c, d) or on(c, a, b) or on(d, a, b):
                    return True
        return False

    rng = random.Random(3)
    rings = [[(float(rng.randint(0, 5)), float(rng.randint(0, 5))) for _ in range(rng.randint(3, 7))] for _ in range(600)]
    for _ in range(100):
        spin = sorted(rng.random() * 2 * math.pi for _ in range(40))
        ring = [(math.cos(a) * (1 + rng.random()), math.sin(a) * (1 + rng.random())) for a in spin]
        rings.append(ring)
    got = _found(spark, [[[r]] for r in rings])
    want = {i for i, r in enumerate(rings) if bad(r)}
    assert set(got) == want and 100 < len(want) < 690


def test_a_ring_of_many_points(spark):
    n = 100_000
    star = [(math.cos(2 * math.pi * i / n) * (2 + i % 2 / 1000), math.sin(2 * math.pi * i / n) * (2 + i % 2 / 1000)) for i in range(n)]
    far = 2 * math.pi * 5300 / n
    knot = [*star[:5000], (math.cos(far) * 2.0005, math.sin(far) * 2.0005), *star[5001:]]
    began = time.perf_counter()
    assert _found(spark, [[[star]], [[knot]]]) == {1: "crossing"}
    assert time.perf_counter() - began < 120


def test_areas_of_interest_in_parts(spark):
    from datetime import date

    from pyspark.sql import functions as F

    from floodlake.operators import features

    outer, hole = _box(0.0, 0.0, 0.3, 0.3), _box(0.1, 0.1, 0.2, 0.2)
    day = date(2024, 1, 1)
    rows = [
        (0, "Polygon", [[outer]], day), (1, "Polygon", [[outer, hole]], day), (2, "MultiPolygon", [[outer], [_box(1.0, 0.0, 1.3, 0.3)]], day), (3, "MultiPolygon", [[outer], [hole]], day), (4, "Polygon", [[[(0.0, 0.0), (0.3, 0.3), (0.3, 0.0), (0.0, 0.3)]]], day),
        (5, None, [[outer]], day), (6, "Point", [[outer]], day), (7, "Polygon", None, day), (8, "Polygon", [], day), (9, "Polygon", [[]], day), (10, "Polygon", [[outer[:2]]], day), (11, "Polygon", [[_box(-181.0, 0.0, -180.0, 0.3)]], day), (12, "Polygon", [[outer]], date(2025, 1, 1)),
        (13, "Polygon", [[_box(0.0, 0.0, 9.0, 9.0)]], day), (14, "Polygon", [[outer], [_box(1.0, 0.0, 1.3, 0.3)]], day), (0, "Polygon", [[outer]], day),
    ]
    frame = spark.createDataFrame(rows, "request_id int, kind string, polygons array<array<array<struct<x: double, y: double>>>>, event_date date").withColumn("shape", F.lit("own"))
    got = {r.request_id: r for r in features.validate_areas(frame, F.lit("2024-06-01").cast("date")).collect()}
    assert features.validate_areas(frame).count() == len(rows) and {r.shape for r in got.values()} == {"own"}
    assert {i: r.reject_code for i, r in got.items()} == {
        0: None, 1: None, 2: None, 3: "INVALID_TOPOLOGY", 4: "INVALID_TOPOLOGY", 5: "UNPARSABLE", 6: "NOT_A_POLYGON", 7: "NOT_A_POLYGON", 8: "NOT_A_POLYGON", 9: "NOT_A_POLYGON", 10: "NOT_A_POLYGON", 11: "OUT_OF_BOUNDS", 12: "EVENT_IN_FUTURE", 13: "AREA_OUT_OF_LIMITS", 14: "NOT_A_POLYGON",
    }
    assert math.isclose(got[1].area_km2, got[0].area_km2 * 8 / 9, rel_tol=1e-4) and math.isclose(got[2].area_km2, 2 * got[0].area_km2, rel_tol=1e-9)
    assert (got[2].xmin, got[2].xmax, got[2].ymin, got[2].ymax) == (0.0, 1.3, 0.0, 0.3)
    assert features.validate_areas(frame.limit(0)).count() == 0
