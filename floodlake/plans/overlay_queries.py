"""Queries over concave, hollow and many-part shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exposure as ex
from ..operators import features as ft
from ..operators import overlay as ov
from .fixtures import CELL, PARTS_A_GRID, load, with_tables


def _ring(columns: str, table: str, points: list[tuple[str, str]], where: str = "TRUE") -> str:
    """The edges of one ring of each row of a table, for both engines."""
    ends = zip(points, points[1:] + points[:1], strict=True)
    return " UNION ALL ".join(f"SELECT {columns}, CAST({a} AS DOUBLE) AS x1, CAST({b} AS DOUBLE) AS y1, CAST({c} AS DOUBLE) AS x2, CAST({d} AS DOUBLE) AS y2 FROM {table} WHERE {where}" for (a, b), (c, d) in ends)


#: Each part as a leaning U, every third with a hole in its base, every fifth with a second part beside it.
_PLOTS = f"SELECT CAST(p_partkey AS STRING) AS feature_id, p_partkey AS k, CAST(floor(p_partkey / {PARTS_A_GRID}) AS INT) AS grid_id, CAST(p_partkey * 37 % 911 AS DOUBLE) AS ax, CAST(p_partkey * 53 % 907 AS DOUBLE) AS ay, CAST(10 + p_size AS DOUBLE) * 11 / 10 AS w, CAST(16 + p_size % 23 AS DOUBLE) * 13 / 12 AS h FROM {{part}}"
_LEAN = lambda x, y: (f"ax + w * {x} + h * {y} / 8", f"ay + h * {y} + w * {x} / 16")
_U = [_LEAN(x, y) for x, y in ((0, 0), (1, 0), (1, 1), (0.75, 1), (0.75, 0.25), (0.25, 0.25), (0.25, 1), (0, 1))]
_HOLE = [_LEAN(x, y) for x, y in ((0.25, 0.0625), (0.5, 0.1875), (0.75, 0.0625))]
_BESIDE = [_LEAN(x, y) for x, y in ((1.25, 0), (1.75, 0.5), (1.25, 0.75))]
_OF_PLOT = "feature_id, grid_id"
_SHAPES = " UNION ALL ".join([_ring(_OF_PLOT, "plots", _U), _ring(_OF_PLOT, "plots", _HOLE, "k % 3 = 0"), _ring(_OF_PLOT, "plots", _BESIDE, "k % 5 = 0")])

#: Each request asks about a bent band with a hole; a scene's footprint is a leaning box with a notch.
_ASKED = "SELECT request_id, (xmin + xmax) / 2 AS ax, (ymin + ymax) / 2 AS ay, CAST(1 AS DOUBLE) AS w FROM scene_boxes"
_AREAS = " UNION ALL ".join([
    _ring("request_id", "asked", [(f"ax + {x}", f"ay + {y}") for x, y in ((-0.5, -0.5), (0.5, -0.375), (0.375, 0.5), (-0.25, 0.375), (0.0625, 0.0625))]),
    _ring("request_id", "asked", [(f"ax + {x}", f"ay + {y}") for x, y in ((0.125, -0.25), (0.1875, -0.0625), (0.3125, -0.1875))]),
])
_FOOTPRINTS = _ring("request_id, scene_id", "scenes", [("xmin", "ymin"), ("xmax", "ymin + 0.125"), ("xmax - 0.0625", "ymax"), ("xmin + 0.5625", "ymax - 0.125"), ("xmin + 0.4375", "ymin + 0.5"), ("xmin + 0.3125", "ymax - 0.0625"), ("xmin - 0.0625", "ymax - 0.125")])

#: The area that every grid is clipped to, in metres: a bent band around a pond.
_BAND = [(100.25, 150.5), (820.75, 90.25), (700.5, 830.25), (480.25, 420.75), (180.5, 800.5)]
_POND = [(420.25, 200.5), (460.5, 330.25), (560.75, 240.5)]
_BORDERS = " UNION ALL ".join(_ring("grid_id AS request_id", "grids", [(str(x), str(y)) for x, y in ring]) for ring in (_BAND, _POND))


def _edges(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    for name in tables:
        sql = sql.replace(f"FROM {name} ", "FROM {" + name + "} ")
    return spark.sql(sql, **tables)


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, _SHAPES, plots=spark.sql(_PLOTS, part=load(spark, sf_dir, "part")))


def shape_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    flood = load(spark, sf_dir, "flood").where("(y * 96 + x) % 37 <> 0")
    out = ex.shape_exposure(_shapes(spark, sf_dir), flood, CELL)
    return out.select("feature_id", *[F.round(c, 6).alias(c) for c in ("footprint_m2", "overlap_m2", "fraction")])


def footprint_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.sql(_ASKED.replace("FROM scene_boxes", "FROM {boxes}"), boxes=load(spark, sf_dir, "scene_boxes"))
    areas, footprints = _edges(spark, _AREAS, asked=asked), _edges(spark, _FOOTPRINTS, scenes=load(spark, sf_dir, "scenes"))
    return ov.covered_share(footprints, areas, ["request_id"], ["scene_id"], 0.25, 0.5).select("request_id", "scene_id", F.round("fraction", 9).alias("fraction"))


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes, roads and places as features of their grid's request."""
    at = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    row = lambda df, kind, parts: df.select(F.col("request_id").cast("int").alias("request_id"), F.concat(F.lit(f"{kind}/"), "feature_id").alias("feature_id"), F.lit(kind).alias("kind"), parts.alias("parts"))
    plots = spark.sql(_PLOTS, part=load(spark, sf_dir, "part"))
    ring = lambda points: F.array(*[F.struct(F.expr(x).alias("x"), F.expr(y).alias("y")) for x, y in points])
    none = F.slice(F.array(ring(_U)), 1, 0)
    rings = F.concat(F.array(ring(_U)), F.when(F.expr("k % 3 = 0"), F.array(ring(_HOLE))).otherwise(none), F.when(F.expr("k % 5 = 0"), F.array(ring(_BESIDE))).otherwise(none))
    roads, places = load(spark, sf_dir, "roads").withColumnRenamed("grid_id", "request_id"), load(spark, sf_dir, "places")
    out = row(plots.withColumnRenamed("grid_id", "request_id"), "polygon", rings)
    return out.unionByName(row(roads, "line", F.array(F.array(at("x1", "y1"), at("x2", "y2"))))).unionByName(row(places, "point", F.array(F.array(at("x", "y")))))


def _borders(requests: DataFrame) -> DataFrame:
    """``_BORDERS`` of each request, all edges in one pass: a pass for each edge would fill the driver with plans."""
    ends = [(*a, *b) for ring in (_BAND, _POND) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    edges = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), e, strict=True)]) for e in ends])
    return requests.select("request_id", F.explode(edges).alias("e")).select("request_id", "e.*")


def clip_to_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = _drawn(spark, sf_dir)
    borders = _borders(drawn.select("request_id").distinct())
    out = ov.clip_features(drawn, ov.trapezoids(borders, ["request_id"], 50.0), ["request_id"], 50.0, 50.0)
    total = lambda f: F.aggregate("parts", F.lit(0.0), lambda s, p: s + f(p))
    size = F.when(F.col("kind") == "polygon", total(ft.ring_area)).when(F.col("kind") == "line", total(ft.line_length)).otherwise(F.size("parts").cast("double"))
    return out.select("feature_id", "request_id", F.round(size, 6).alias("size"), "clipped")


def _below(u: str, v: str, lo: str, hi: str, c: str) -> str:
    """SQL: what lies below both an even slope from lo to hi and the height c, between u and v."""
    return f"({v} - {u}) * CASE WHEN {hi} <= {c} THEN ({lo} + {hi}) / 2 WHEN {lo} >= {c} THEN {c} ELSE {c} - power({c} - {lo}, 2) / (2 * ({hi} - {lo})) END"


def _common(a: str, b: str, on: str, by: str) -> str:
    """SQL: area common to shapes of turned edges, as the sum over pairs of edges of what lies below both, signed by their directions."""
    return f"""SELECT {by}, sum(sa * sb * ((v - u) * (bu + bv) / 2 + {_below('u', 'v', 'least(au - bu, av - bv)', 'greatest(au - bu, av - bv)', '0')})) AS m2 FROM (
      SELECT {by}, u, v, sa, sb, ay1 + am * (u - ax1) AS au, ay1 + am * (v - ax1) AS av, by1 + bm * (u - bx1) AS bu, by1 + bm * (v - bx1) AS bv FROM (
        SELECT {by}, greatest(least(p.x1, p.x2), least(q.x1, q.x2)) AS u, least(greatest(p.x1, p.x2), greatest(q.x1, q.x2)) AS v, CASE WHEN p.x1 > p.x2 THEN 1 ELSE -1 END AS sa, CASE WHEN q.x1 > q.x2 THEN 1 ELSE -1 END AS sb,
          p.x1 AS ax1, p.y1 AS ay1, (p.y2 - p.y1) / (p.x2 - p.x1) AS am, q.x1 AS bx1, q.y1 AS by1, (q.y2 - q.y1) / (q.x2 - q.x1) AS bm FROM {a} p JOIN {b} q ON {on} AND p.x1 <> p.x2 AND q.x1 <> q.x2
          AND least(p.x1, p.x2) < greatest(q.x1, q.x2) AND least(q.x1, q.x2) < greatest(p.x1, p.x2))) GROUP BY {by}"""


_PLOTTED = f"plots AS ({_PLOTS.format(part='part')}), shapes AS ({_SHAPES})"
_WET = "wet_cells AS (SELECT grid_id, CAST(x * 10 AS DOUBLE) AS x0, CAST(y * 10 AS DOUBLE) AS y0 FROM flood WHERE (y * 96 + x) % 37 <> 0 AND mask = 1)"
_HIT = f"""spans AS (SELECT feature_id, grid_id, min(x1) AS xa, max(x1) AS xb, min(y1) AS ya, max(y1) AS yb FROM shapes GROUP BY ALL),
    met AS (SELECT s.feature_id, c.x0, c.y0 FROM spans s JOIN wet_cells c ON c.grid_id = s.grid_id AND x0 < xb AND x0 + 10 > xa AND y0 < yb AND y0 + 10 > ya),
    cut AS (SELECT feature_id, y0, CASE WHEN x1 > x2 THEN 1 ELSE -1 END AS s, greatest(least(x1, x2), x0) AS u, least(greatest(x1, x2), x0 + 10) AS v, x1, y1, (y2 - y1) / (x2 - x1) AS m FROM met JOIN shapes USING (feature_id) WHERE x1 <> x2 AND least(x1, x2) < x0 + 10 AND greatest(x1, x2) > x0),
    slopes AS (SELECT *, least(y1 + m * (u - x1), y1 + m * (v - x1)) AS lo, greatest(y1 + m * (u - x1), y1 + m * (v - x1)) AS hi FROM cut),
    flooded AS (SELECT feature_id, sum(s * ({_below('u', 'v', 'lo', 'hi', '(y0 + 10)')} - {_below('u', 'v', 'lo', 'hi', 'y0')})) AS m2 FROM slopes GROUP BY feature_id),
    sizes AS (SELECT feature_id, sum(x1 * y2 - x2 * y1) / 2 AS area FROM shapes GROUP BY feature_id)"""
_CLIP = f"""grids AS (SELECT DISTINCT grid_id FROM plots UNION SELECT grid_id FROM roads UNION SELECT request_id FROM places), borders AS ({_BORDERS}), sizes AS (SELECT feature_id, any_value(grid_id) AS request_id, sum(x1 * y2 - x2 * y1) / 2 AS area FROM shapes GROUP BY feature_id),
    common AS ({_common('shapes', 'borders', 'q.request_id = p.grid_id', 'feature_id')}),
    ends AS (SELECT feature_id, grid_id AS request_id, x1, y1, x2, y2 FROM roads),
    hits AS (SELECT l.feature_id, ((b.x1 - l.x1) * (b.y2 - b.y1) - (b.y1 - l.y1) * (b.x2 - b.x1)) / ((l.x2 - l.x1) * (b.y2 - b.y1) - (l.y2 - l.y1) * (b.x2 - b.x1)) AS t,
      ((b.x1 - l.x1) * (l.y2 - l.y1) - (b.y1 - l.y1) * (l.x2 - l.x1)) / ((l.x2 - l.x1) * (b.y2 - b.y1) - (l.y2 - l.y1) * (b.x2 - b.x1)) AS w FROM ends l JOIN borders b ON b.request_id = l.request_id),
    ts AS (SELECT feature_id, 0.0::DOUBLE AS t FROM ends UNION ALL SELECT feature_id, 1.0::DOUBLE FROM ends UNION ALL SELECT feature_id, t FROM hits WHERE t > 0 AND t < 1 AND w BETWEEN 0 AND 1),
    steps AS (SELECT *, lead(t) OVER (PARTITION BY feature_id ORDER BY t) AS t1 FROM ts),
    mids AS (SELECT l.feature_id, l.request_id, t1 - t AS d, x1 + (x2 - x1) * (t + t1) / 2 AS mx, y1 + (y2 - y1) * (t + t1) / 2 AS my, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS m FROM steps JOIN ends l ON l.feature_id = steps.feature_id WHERE t1 > t),
    along AS (SELECT m.feature_id, d, m, count(*) FILTER ((b.y1 > my) <> (b.y2 > my) AND mx < (b.x2 - b.x1) * (my - b.y1) / (b.y2 - b.y1) + b.x1) % 2 AS within FROM mids m JOIN borders b ON b.request_id = m.request_id GROUP BY m.feature_id, mx, my, d, m),
    lengths AS (SELECT feature_id, sum(d * m) FILTER (within = 1) AS size, sum(d) FILTER (within = 1) AS share FROM along GROUP BY feature_id),
    spots AS (SELECT feature_id, count(*) FILTER ((b.y1 > y) <> (b.y2 > y) AND x < (b.x2 - b.x1) * (y - b.y1) / (b.y2 - b.y1) + b.x1) % 2 AS size FROM places p JOIN borders b ON b.request_id = p.request_id GROUP BY feature_id)"""

QUERIES = {f.__name__: f for f in (shape_exposure, footprint_coverage, clip_to_shape)}
ORACLES = {
    "shape_exposure": with_tables("flood") + f", {_PLOTTED}, {_WET}, {_HIT} SELECT feature_id, round(area, 6) AS footprint_m2, round(coalesce(m2, 0), 6) AS overlap_m2, round(coalesce(m2, 0) / area, 6) AS fraction FROM sizes LEFT JOIN flooded USING (feature_id)",
    "footprint_coverage": with_tables("scenes", "scene_boxes") + f""", asked AS ({_ASKED}), areas AS ({_AREAS}), footprints AS ({_FOOTPRINTS}), sizes AS (SELECT request_id, sum(x1 * y2 - x2 * y1) / 2 AS area FROM areas GROUP BY request_id),
        common AS ({_common('footprints', 'areas', 'p.request_id = q.request_id', 'scene_id')}) SELECT request_id, scene_id, round(least(1, coalesce(m2, 0) / area), 9) AS fraction FROM scenes JOIN sizes USING (request_id) LEFT JOIN common USING (scene_id)""",
    "clip_to_shape": with_tables("roads", "places") + f""", {_PLOTTED}, {_CLIP}
        SELECT 'polygon/' || feature_id AS feature_id, request_id, round(coalesce(m2, 0), 6) AS size, coalesce(m2, 0) < area * (1 - 1e-9) AS clipped FROM sizes LEFT JOIN common USING (feature_id)
        UNION ALL SELECT 'line/' || feature_id, request_id, round(coalesce(size, 0), 6), coalesce(share, 0) < 1 - 1e-9 FROM ends LEFT JOIN lengths USING (feature_id)
        UNION ALL SELECT 'point/' || feature_id, request_id, CAST(size AS DOUBLE), size = 0 FROM places JOIN spots USING (feature_id)""",
}
