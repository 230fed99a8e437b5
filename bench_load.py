"""

Scale n lays n copies of the load side by side, each on its own grid of 5 m
cells; cells are known where roads and buildings lie, and 100 m around.
"""

from __future__ import annotations

import json
import os
import time

from floodlake.operators import exposure, network
from floodlake.session import local_session

ROADS, BUILDINGS, CELL = 5000, 25000, 5


def main() -> None:
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "load")
    out = {}
    for scale in map(int, os.environ.get("BENCH_SCALES", "1,10").split(",")):
        flood = spark.range(scale * 440 * 440).selectExpr("CAST(id DIV 193600 AS INT) AS grid_id", "CAST(id % 193600 DIV 440 - 20 AS INT) AS y", "CAST(id % 440 - 20 AS INT) AS x")
        flood = flood.selectExpr("*", f"CAST(y >= 0 AND x * {CELL} BETWEEN 150 AND 1380 AND x * {CELL} % 150 < 35 AS INT) AS mask").cache()
        flood.count()
        number = f"CAST(id DIV {ROADS} AS INT) AS grid_id", "CAST(id AS STRING) AS feature_id"
        roads = spark.range(scale * ROADS).selectExpr(*number, f"40D * (id % {ROADS} % 50) AS x1", f"20D * (id % {ROADS} DIV 50) AS y1")
        roads = roads.selectExpr("*", "x1 + 38 AS x2", "y1 AS y2", "'residential' AS highway", *[f"CAST(NULL AS STRING) AS {c}" for c in ("oneway", "maxspeed", "bridge", "tunnel")])
        built = spark.range(scale * BUILDINGS).selectExpr(f"CAST(id DIV {BUILDINGS} AS INT) AS grid_id", number[1], f"10D * (id % {BUILDINGS} % 200) AS xmin", f"10D * (id % {BUILDINGS} DIV 200) AS ymin").selectExpr("*", "xmin + 8 AS xmax", "ymin + 8 AS ymax")
        began = time.perf_counter()
        summary = exposure.building_summary(exposure.building_exposure(built, flood, CELL)).first()
        at_buildings = time.perf_counter()
        segments = exposure.road_segments(roads, flood, CELL).withColumnRenamed("grid_id", "request_id").cache()
        n_segments = segments.count()
        at_roads = time.perf_counter()
        edges = network.road_edges(segments).cache()
        n_before, n_after = edges.count(), network.post_event_edges(edges).count()
        at_edges = time.perf_counter()
        out[f"{scale}x"] = {
            "buildings": summary.total_count, "affected": summary.affected_count, "segments": n_segments, "edges_before": n_before, "edges_after": n_after,
            "exposure_s": round(at_buildings - began, 3), "roads_s": round(at_roads - at_buildings, 3), "graphs_s": round(at_edges - at_roads, 3),
        }
        for df in (flood, segments, edges):
            df.unpersist()
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
