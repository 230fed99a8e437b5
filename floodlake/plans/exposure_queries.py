"""Queries over features on the flood grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exposure as ex
from .fixtures import CELL, load, with_tables


def _flood(spark: SparkSession, sf_dir: str, **given: DataFrame) -> DataFrame:
    """Cells of the flood, those of every 37th code unknown."""
    return load(spark, sf_dir, "flood", **given).where("(y * 96 + x) % 37 <> 0")


def hazard_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.hazard_candidates(load(spark, sf_dir, "buildings"), _flood(spark, sf_dir), CELL).select("feature_id")


def building_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.building_exposure(load(spark, sf_dir, "buildings"), _flood(spark, sf_dir), CELL).select("feature_id", "footprint_m2", "overlap_m2", F.round("fraction", 9).alias("fraction"), "affected")


def building_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.building_summary(ex.building_exposure(load(spark, sf_dir, "buildings"), _flood(spark, sf_dir), CELL)).withColumn("affected_fraction", F.round("affected_fraction", 9))


def _segments(spark: SparkSession, sf_dir: str, **given: DataFrame) -> DataFrame:
    return ex.road_segments(load(spark, sf_dir, "roads", **given), _flood(spark, sf_dir, **given), CELL)


def road_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("segment_id", "status", F.round("length_m", 6).alias("length_m"), "highway", "bridge")


def road_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ex.road_summary(_segments(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) if c.endswith("_km") else c for c in s.columns])


def bridge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "roads").where(ex.is_bridge()).select("feature_id")


def _bridges(spark: SparkSession, sf_dir: str, **given: DataFrame) -> DataFrame:
    return ex.bridge_exposure(load(spark, sf_dir, "roads", **given).where(ex.is_bridge()), _flood(spark, sf_dir, **given), CELL)


def bridge_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bridges(spark, sf_dir).select("feature_id", "status", F.round("overlap_fraction", 6).alias("overlap_fraction"))


def bridge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.bridge_summary(_bridges(spark, sf_dir))


def by_grid(spark: SparkSession, sf_dir: str, **given: DataFrame) -> DataFrame:
    """Per grid: buildings, roads and bridges, those affected, and kilometres by status."""
    buildings = ex.building_summary(ex.building_exposure(load(spark, sf_dir, "buildings", **given), _flood(spark, sf_dir, **given), CELL), ["grid_id"]).select("grid_id", F.col("total_count").alias("buildings"), F.col("affected_count").alias("affected_buildings"))
    roads = ex.road_summary(_segments(spark, sf_dir, **given), ["grid_id"]).drop("segments")
    bridges = ex.bridge_summary(_bridges(spark, sf_dir, **given), ["grid_id"]).withColumnRenamed("affected", "affected_bridges")
    return buildings.join(roads, "grid_id", "full").join(bridges, "grid_id", "full")


def impact_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = ex.building_exposure(load(spark, sf_dir, "buildings"), _flood(spark, sf_dir), CELL)
    out = ex.impact_features(built, _bridges(spark, sf_dir))
    corner = F.get("points", 0)
    return out.select("kind", "feature_id", F.size("points").alias("corners"), corner["x"].alias("x"), corner["y"].alias("y"), "classification", F.round("overlap_fraction", 6).alias("overlap_fraction"), "claim_level")


_RINGS = "SELECT CAST(p_partkey AS STRING) AS feature_id, CAST(p_partkey * 37 % 931 AS DOUBLE) AS ax, CAST(p_partkey * 53 % 937 AS DOUBLE) AS ay, CAST(10 + p_size AS DOUBLE) AS w, CAST(15 + p_size % 23 AS DOUBLE) AS h FROM {part}"
_EDGES = """SELECT feature_id, ax AS x1, ay AS y1, ax + w AS x2, ay + 3 AS y2 FROM rings UNION ALL SELECT feature_id, ax + w, ay + 3, ax + w / 2, ay + h FROM rings UNION ALL SELECT feature_id, ax + w / 2, ay + h, ax, ay FROM rings"""


def rasterize_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = spark.sql(_RINGS, part=load(spark, sf_dir, "part"))
    return ex.rasterize(spark.sql(_EDGES.replace("FROM rings", "FROM {rings}"), rings=rings), CELL).select("feature_id", "cy", "cx")


def road_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.geo import speed_kmh
    from ..policy import DEFAULT

    speeds = F.create_map(*[F.lit(x) for pair in DEFAULT.speeds.items() for x in pair])
    return load(spark, sf_dir, "roads").select("feature_id", F.round(speed_kmh(F.col("maxspeed"), F.try_element_at(speeds, F.col("highway"))), 6).alias("speed_kmh"))


_KNOWN = with_tables("flood", "buildings", "roads") + ", known AS (SELECT grid_id, y, x, mask FROM flood WHERE (y * 96 + x) % 37 <> 0)"
_BUILT = _KNOWN + """, wet AS (SELECT feature_id, sum((least(xmax, x * 10 + 10) - greatest(xmin, x * 10)) * (least(ymax, y * 10 + 10) - greatest(ymin, y * 10))) AS m2
    FROM buildings JOIN known ON known.grid_id = buildings.grid_id AND mask = 1 AND x * 10 < xmax AND x * 10 + 10 > xmin AND y * 10 < ymax AND y * 10 + 10 > ymin GROUP BY feature_id),
    built AS (SELECT feature_id, (xmax - xmin) * (ymax - ymin) AS area, coalesce(m2, 0) AS m2 FROM buildings LEFT JOIN wet USING (feature_id))"""
_SEGMENTS = _KNOWN + """, along AS (SELECT grid_id, feature_id, highway, bridge, tunnel, CASE WHEN y1 = y2 THEN x1 ELSE y1 END AS p, CASE WHEN y1 = y2 THEN x2 ELSE y2 END AS q, CASE WHEN y1 = y2 THEN 1 ELSE 0 END AS flat, CAST(floor(x1 / 10) AS INT) AS fx, CAST(floor(y1 / 10) AS INT) AS fy FROM roads),
    steps AS (SELECT *, unnest(range(CAST(floor(p / 10) AS INT), CAST(floor(q / 10) AS INT) + 1)) AS k FROM along),
    met AS (SELECT s.*, greatest(p, k * 10) AS a, least(q, k * 10 + 10) AS b, m.mask FROM steps s LEFT JOIN known m ON m.grid_id = s.grid_id AND m.y = CASE WHEN flat = 1 THEN fy ELSE k END AND m.x = CASE WHEN flat = 1 THEN k ELSE fx END),
    marked AS (SELECT *, coalesce(mask, 0) AS wet, CASE WHEN coalesce(mask, 0) = lag(coalesce(mask, 0)) OVER (PARTITION BY feature_id ORDER BY k) THEN 0 ELSE 1 END AS new FROM met),
    islands AS (SELECT *, sum(new) OVER (PARTITION BY feature_id ORDER BY k) AS island FROM marked),
    pieces AS (SELECT feature_id || ':' || (island - 1) AS segment_id, CASE WHEN bool_or(mask IS NULL) THEN 'UNKNOWN_COVERAGE' WHEN max(wet) = 1 THEN 'BLOCKED' ELSE 'OPEN' END AS status, max(b) - min(a) AS m, any_value(highway) AS highway,
      bool_or(coalesce(bridge, 'no') NOT IN ('no', 'false', '0') AND coalesce(tunnel, '') NOT IN ('yes', 'true', '1')) AS bridge FROM islands GROUP BY feature_id, island)"""
_BRIDGES = _KNOWN + """, judged AS (SELECT feature_id, grid_id, x1, y1, x2, y2, EXISTS (SELECT 1 FROM known WHERE known.grid_id = roads.grid_id AND mask = 1 AND
      sqrt(power(greatest(0, x * 10 - x2, x1 - x * 10 - 10), 2) + power(greatest(0, y * 10 - y2, y1 - y * 10 - 10), 2)) < 20) AS hit
    FROM roads WHERE coalesce(bridge, 'no') NOT IN ('no', 'false', '0') AND coalesce(tunnel, '') NOT IN ('yes', 'true', '1'))"""

#: Share of the corridor that is wet: the corridor's sides cut where they enter or leave it, so that each part has its area by its middle.
_SHARES = _BRIDGES + """, wet_cells AS (SELECT grid_id, y, x FROM known WHERE mask = 1),
    corners AS (SELECT j.feature_id, grid_id, side * 33 + i AS k, CASE side WHEN 0 THEN x2 ELSE x1 END + 20 * cos(atan2(y2 - y1, x2 - x1) + (side - 0.5::DOUBLE) * pi() + i * pi() / 32) AS px,
      CASE side WHEN 0 THEN y2 ELSE y1 END + 20 * sin(atan2(y2 - y1, x2 - x1) + (side - 0.5::DOUBLE) * pi() + i * pi() / 32) AS py FROM judged j, (SELECT unnest([0, 1]) AS side), (SELECT unnest(range(0, 33)) AS i) WHERE hit),
    sides AS (SELECT feature_id, grid_id, px AS ax, py AS ay, coalesce(lead(px) OVER w, first_value(px) OVER w) AS bx, coalesce(lead(py) OVER w, first_value(py) OVER w) AS "by" FROM corners WINDOW w AS (PARTITION BY feature_id ORDER BY k)),
    near_cells AS (SELECT feature_id, c.* FROM judged j JOIN wet_cells c ON c.grid_id = j.grid_id AND c.x * 10 < j.x2 + 20 AND c.x * 10 + 10 > j.x1 - 20 AND c.y * 10 < j.y2 + 20 AND c.y * 10 + 10 > j.y1 - 20 WHERE hit),
    lines AS (SELECT n.feature_id, n.y, n.x, s.ax, s.ay, s.bx, s."by", greatest(least(ax, bx), n.x * 10) AS u, least(greatest(ax, bx), n.x * 10 + 10) AS v FROM near_cells n JOIN sides s ON s.feature_id = n.feature_id AND least(ax, bx) < n.x * 10 + 10 AND greatest(ax, bx) > n.x * 10),
    cut AS (SELECT *, ("by" - ay) / (bx - ax) AS m FROM lines WHERE v > u AND abs(bx - ax) > 1e-12),
    steps AS (SELECT *, list_sort(list_distinct(list_filter([u, v, CASE WHEN m <> 0 THEN ax + (y * 10 - ay) / m END, CASE WHEN m <> 0 THEN ax + (y * 10 + 10 - ay) / m END], lambda p: p BETWEEN u AND v))) AS p FROM cut),
    parts AS (SELECT *, unnest(p[:-2]) AS p0, unnest(p[2:]) AS p1 FROM steps),
    sums AS (SELECT feature_id, sum((p1 - p0) * (greatest(y * 10, least(y * 10 + 10, ay + m * ((p0 + p1) / 2 - ax))) - y * 10) * CASE WHEN bx < ax THEN 1 ELSE -1 END) AS m2 FROM parts GROUP BY feature_id)"""

QUERIES = {f.__name__: f for f in (hazard_candidates, building_exposure, building_summary, road_segments, road_summary, bridge_filter, bridge_exposure, bridge_summary, impact_features, rasterize_polygons, road_speed)}
ORACLES = {
    "hazard_candidates": _BUILT + " SELECT feature_id FROM wet",
    "building_exposure": _BUILT + " SELECT feature_id, area AS footprint_m2, m2 AS overlap_m2, round(m2 / area, 9) AS fraction, m2 > 0 AND m2 / area >= 0.1 AS affected FROM built",
    "building_summary": _BUILT + """ SELECT count(*) AS total_count, count(*) FILTER (m2 > 0 AND m2 / area >= 0.1) AS affected_count, sum(area) AS total_m2, sum(area) FILTER (m2 > 0 AND m2 / area >= 0.1) AS affected_m2,
        round(count(*) FILTER (m2 > 0 AND m2 / area >= 0.1) / count(*), 9) AS affected_fraction FROM built""",
    "road_segments": _SEGMENTS + " SELECT segment_id, status, round(m, 6) AS length_m, highway, bridge FROM pieces",
    "road_summary": _SEGMENTS + " SELECT round(sum(m) FILTER (status = 'OPEN') / 1000, 6) AS open_km, 0.0::DOUBLE AS potentially_blocked_km, round(coalesce(sum(m) FILTER (status = 'BLOCKED'), 0) / 1000, 6) AS blocked_km, round(coalesce(sum(m) FILTER (status = 'UNKNOWN_COVERAGE'), 0) / 1000, 6) AS unknown_coverage_km, count(*) AS segments FROM pieces",
    "bridge_filter": with_tables("roads") + " SELECT feature_id FROM roads WHERE coalesce(bridge, 'no') NOT IN ('no', 'false', '0') AND coalesce(tunnel, '') NOT IN ('yes', 'true', '1')",
    "bridge_exposure": _SHARES + " SELECT feature_id, CASE WHEN hit THEN 'AFFECTED' ELSE 'NOT_AFFECTED' END AS status, round(coalesce(m2, 0) / (40 * ((x2 - x1) + (y2 - y1)) + 400 * 32 * sin(pi() / 32)), 6) AS overlap_fraction FROM judged LEFT JOIN sums USING (feature_id)",
    "bridge_summary": _BRIDGES + " SELECT count(*) AS bridges, count(*) FILTER (hit) AS affected FROM judged",
    "impact_features": _SHARES + ", " + _BUILT.removeprefix(_KNOWN + ", ") + f""" SELECT 'building' AS kind, feature_id, 4 AS corners, xmin AS x, ymin AS y, CASE WHEN m2 > 0 AND m2 / area >= 0.1 THEN 'AFFECTED' ELSE 'NOT_AFFECTED' END AS classification, round(m2 / area, 6) AS overlap_fraction, '{ex.CLAIM}' AS claim_level FROM built JOIN buildings USING (feature_id)
        UNION ALL SELECT 'bridge', feature_id, 2, x1, y1, CASE WHEN hit THEN 'AFFECTED' ELSE 'NOT_AFFECTED' END, round(coalesce(sums.m2, 0) / (40 * ((x2 - x1) + (y2 - y1)) + 400 * 32 * sin(pi() / 32)), 6), '{ex.CLAIM}' FROM judged LEFT JOIN sums USING (feature_id)""",
    "rasterize_polygons": f"""WITH rings AS ({_RINGS.format(part='part')}), edges AS ({_EDGES}), boxes AS (SELECT feature_id, min(x1) AS a, max(x1) AS b, min(y1) AS c, max(y1) AS d FROM edges GROUP BY feature_id),
        ys AS (SELECT *, unnest(range(CAST(floor(c / 10) AS INT), CAST(ceil(d / 10) AS INT))) AS cy FROM boxes), cells AS (SELECT *, unnest(range(CAST(floor(a / 10) AS INT), CAST(ceil(b / 10) AS INT))) AS cx FROM ys)
        SELECT feature_id, CAST(cy AS INT) AS cy, CAST(cx AS INT) AS cx FROM cells JOIN edges USING (feature_id) GROUP BY feature_id, cy, cx
        HAVING count(*) FILTER (((y1 > cy * 10 + 5) <> (y2 > cy * 10 + 5)) AND cx * 10 + 5 < (x2 - x1) * (cy * 10 + 5 - y1) / (y2 - y1) + x1) % 2 = 1""",
    "road_speed": with_tables("roads") + """ SELECT feature_id, round(CASE maxspeed WHEN '50' THEN 50 WHEN '30 mph' THEN 30 * 1.609344::DOUBLE WHEN '40;60' THEN 40 ELSE CASE highway WHEN 'primary' THEN 60 WHEN 'residential' THEN 30 WHEN 'track' THEN 15 END END, 6) AS speed_kmh FROM roads""",
}
#: DuckDB SQL for the rows of ``by_grid``, in three parts.
BY_GRID = {
    "b": _BUILT + " SELECT grid_id, count(*) AS buildings, count(*) FILTER (m2 > 0 AND m2 / area >= 0.1) AS affected_buildings FROM built JOIN buildings USING (feature_id) GROUP BY grid_id",
    "r": _SEGMENTS + """ SELECT grid_id, coalesce(sum(m) FILTER (status = 'OPEN'), 0) / 1000 AS open_km, 0.0::DOUBLE AS potentially_blocked_km, coalesce(sum(m) FILTER (status = 'BLOCKED'), 0) / 1000 AS blocked_km,
        coalesce(sum(m) FILTER (status = 'UNKNOWN_COVERAGE'), 0) / 1000 AS unknown_coverage_km FROM pieces JOIN roads ON roads.feature_id = split_part(segment_id, ':', 1) GROUP BY grid_id""",
    "g": _BRIDGES + " SELECT grid_id, count(*) AS bridges, count(*) FILTER (hit) AS affected_bridges FROM judged GROUP BY grid_id",
}
