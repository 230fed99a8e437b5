"""Steps whose work or memory once grew faster than it had to."""

from __future__ import annotations

import os
import random
import re

import pyarrow as pa
import pytest

from compare import compare, connect
from floodlake.operators import exposure, features, regions
from floodlake.plans import ORACLES, record_queries

LARGER = "/root/testdata/sf0.01"


def test_report_works_on_the_grids_it_reports(spark, tmp_path, monkeypatch):
    """One request: of two grids only its own goes through the exposure of roads, and the report is that of SQL."""
    for name in os.listdir(LARGER):
        if name != "nation.parquet":
            os.symlink(f"{LARGER}/{name}", tmp_path / name)
    spark.read.parquet(f"{LARGER}/nation.parquet").where("n_nationkey = 1").write.parquet(f"{tmp_path}/nation.parquet")
    seen, real = [], exposure.road_segments
    monkeypatch.setattr(exposure, "road_segments", lambda roads, flood, *more: seen.append((roads, flood)) or real(roads, flood, *more))
    report = record_queries.report_metrics(spark, str(tmp_path))
    assert compare(report, connect(str(tmp_path)), ORACLES["report_metrics"]) == ""
    assert [{r.grid_id for r in rows.select("grid_id").distinct().collect()} for rows in seen[0]] == [{1}, {1}]


POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def test_only_unsound_rings_are_taken_apart_alone(monkeypatch):
    """A batch of rings comes out as if each went through ``loops``, but those that cross nothing don't."""
    rng, real, alone = random.Random(7), features.loops, []
    rings = [[(float(rng.randint(0, 9)), float(rng.randint(0, 9)) + rng.choice([0, rng.random()])) for _ in range(rng.choice([0, 1, 2, 3, 4, 4, 6, 70]))] for _ in range(600)]
    squares = [[(i, 0.0), (i + 2.0, 0.0), (i + 2.0, 2.0), (i, 2.0)] for i in range(1000)]
    monkeypatch.setattr(features, "loops", lambda ring: alone.append(ring) or real(ring))
    kinds = ["polygon"] * 1600 + ["line", None, "point"]
    given = [*rings, *squares, [(0.0, 0.0), (1.0, 1.0)], [(0.0, 0.0)], None]
    shapes = [None if r is None else [{"x": x, "y": y} for x, y in r] for r in given]
    parts, repaired = features._repaired(pa.array(kinds), pa.array(shapes, POINTS))
    want = [real(r) if k == "polygon" else [r] if k and r else [] for k, r in zip(kinds, given, strict=True)]
    assert [[[(p["x"], p["y"]) for p in ring] for ring in of] for of in parts.to_pylist()] == want
    assert repaired.tolist() == [k == "polygon" and bool(r) and [len(x) for x in w] != [len(r)] for k, r, w in zip(kinds, given, want, strict=True)]
    assert alone and not any(ring in squares for ring in alone)


def test_drawn_shapes_are_dealt_out(spark):
    """Work on each shape isn't left to the few tasks that read the tables."""
    plan = record_queries.feature_extract(spark, LARGER)._jdf.queryExecution().toString()
    assert "RepartitionByExpression" in plan and plan.index("MapInArrow") < plan.index("RepartitionByExpression")


def test_rings_are_chained_inside_squares(spark, monkeypatch):
    """Squares of any size give the same rings; rings inside one square need no rounds over their edges."""
    rng = random.Random(11)
    cells = [(g, y, x) for g in (0, 1) for y in range(24) for x in range(24) if rng.random() < 0.6 or y in (3, 20) or x in (3, 20)]
    edges = regions.boundary_edges(regions.label_regions(spark.createDataFrame(cells, "grid_id int, y int, x int"), 24, 9)).cache()
    rounds, real = [], regions.checkpointed
    monkeypatch.setattr(regions, "checkpointed", lambda df: rounds.append("next" in df.columns and "same" in df.columns) or real(df))
    found = []
    for block in (2, 5, 24, 512):
        rounds.clear()
        found.append({(r.grid_id, r.region, r.ring): [(p.x, p.y) for p in r.points] for r in regions.region_rings(edges, block).collect()})
        assert sum(rounds) > 3 if block == 2 else sum(rounds) <= 1 if block == 512 else True
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) > 20 and max(map(len, found[0].values())) > 100
    ends = set()
    for (grid, region, _), points in found[0].items():
        for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
            n = abs(x2 - x1) + abs(y2 - y1)
            ends |= {(grid, region, x1 + (x2 - x1) // n * i, y1 + (y2 - y1) // n * i, x1 + (x2 - x1) // n * (i + 1), y1 + (y2 - y1) // n * (i + 1)) for i in range(n)}
    assert ends == {tuple(r) for r in edges.select("grid_id", "region", "x1", "y1", "x2", "y2").collect()}


def test_features_are_dealt_out_before_they_make_cells(spark):
    """No task makes the cells of all the features that one file holds."""
    box = "grid_id int, feature_id string, xmin double, ymin double, xmax double, ymax double"
    built = spark.createDataFrame([(0, str(i), i * 3.0, 1.0, i * 3.0 + 25, 19.0) for i in range(40)], box)
    flood = spark.createDataFrame([(0, y, x, (x + y) % 2) for y in range(3) for x in range(20)], "grid_id int, y int, x int, mask int")
    exposed = exposure.building_exposure(built, flood, 10.0)
    for plan in (exposed, exposure.hazard_candidates(built, flood, 10.0)):
        said = plan._jdf.queryExecution().toString().partition("== Optimized Logical Plan ==")[2]
        lines = said.partition("== Physical Plan ==")[0].splitlines()
        makes = [i for i, line in enumerate(lines) if "Generate explode" in line]
        assert makes and "RepartitionByExpression" in "".join(lines[max(makes) : max(makes) + 4])
    wet = [(10.0 * x, 10.0 * y) for y in range(3) for x in range(20) if (x + y) % 2]
    for r in exposed.collect():
        want = sum(max(0.0, min(r.xmax, x + 10) - max(r.xmin, x)) * max(0.0, min(r.ymax, y + 10) - max(r.ymin, y)) for x, y in wet)
        assert r.overlap_m2 == want and r.footprint_m2 == 450.0


def test_cells_of_features_are_never_broadcast(spark):
    """One wide building and one long bridge make many cells, however few bytes Spark takes them for."""
    built = spark.sql("SELECT * FROM VALUES (0, 'b', 0D, 0D, 3000D, 2000D) AS t(grid_id, feature_id, xmin, ymin, xmax, ymax)")
    bridges = spark.sql("SELECT * FROM VALUES (0, 'g', 5D, 5D, 4005D, 3005D) AS t(grid_id, feature_id, x1, y1, x2, y2)")
    edges = spark.sql("SELECT * FROM VALUES (0, 's', 0D, 0D, 70D, 0D), (0, 's', 70D, 0D, 0D, 90D), (0, 's', 0D, 90D, 0D, 0D) AS t(grid_id, feature_id, x1, y1, x2, y2)")
    flood = spark.sql("SELECT CAST(id % 1 AS INT) AS grid_id, CAST(id DIV 56 * 7 AS INT) AS y, CAST(id % 56 * 9 AS INT) AS x, CAST((id DIV 56 * 7 + id % 56 * 9) % 2 AS INT) AS mask FROM range(58 * 56)")
    exposed, crossing = exposure.building_exposure(built, flood, 10.0), exposure.bridge_exposure(bridges, flood, 10.0)
    for df in (exposed, crossing, exposure.impact_features(exposed, crossing), exposure.hazard_candidates(built, flood, 10.0), exposure.shape_exposure(edges, flood, 10.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SortMergeJoin \[grid_id#\d+, cy#\d+, cx#\d+\]", plan) and not re.search(r"HashJoin \[grid_id#\d+, cy#\d+, cx#\d+\]", plan)
    wet = sum((y + x) % 2 for y in range(0, 200, 7) for x in range(0, 300, 9))
    got = {r.kind: r for r in exposure.impact_features(exposed, crossing).collect()}
    assert got["building"].overlap_fraction == pytest.approx(wet / 60_000) and got["bridge"].classification == "AFFECTED"
