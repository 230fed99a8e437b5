"""Queries over pixel tables and regions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pixels as px
from ..operators import regions as rg
from ..operators import tiles
from ..policy import Policy
from .fixtures import CELL, SIDE, load, with_tables

KM2 = 0.0001
SMALL_TILES = Policy(tile_size=48, tile_overlap=8)


def _pixels(spark: SparkSession, sf_dir: str, **given: DataFrame) -> DataFrame:
    return load(spark, sf_dir, "pixels", **given).withColumn("valid", px.valid(F.col("pre_vv"), F.col("pre_vh"), F.col("post_vv"), F.col("post_vh")))


def pixel_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).select("grid_id", "y", "x", "valid")


def band_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = spark.sql(_BANDS, supplier=load(spark, sf_dir, "supplier"))
    return px.select_bands(catalog).select("grid_id", "suffix", "matches", "band")


_BANDS = "SELECT CAST(s_suppkey % 23 AS INT) AS grid_id, s_suppkey AS band, CASE s_suppkey % 4 WHEN 0 THEN 'Band-Sigma0_VV' WHEN 1 THEN 'x_sigma0-vh' WHEN 2 THEN 'Elevation' ELSE 'slope' END AS name FROM {supplier}"
_GRIDS = """SELECT CAST(n_nationkey / 3 AS INT) AS grid_id, n_name AS role, CAST(CASE WHEN n_nationkey % 7 = 0 THEN 4326 ELSE 32631 END AS INT) AS epsg, CAST(CASE WHEN n_nationkey % 5 = 0 THEN 100 ELSE 96 END AS INT) AS width, 96 AS height,
    CAST(0 AS DOUBLE) AS x0, CAST(CASE WHEN n_nationkey % 4 = 0 THEN 10 ELSE 0 END AS DOUBLE) AS y0, CAST(10 AS DOUBLE) AS dx, CAST(-10 AS DOUBLE) AS dy FROM {nation}"""


def grid_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = spark.sql(_GRIDS.replace("n_nationkey / 3", "n_nationkey div 3"), nation=load(spark, sf_dir, "nation"))
    return px.grid_mismatch(grids)


def band_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pixels")
    part = lambda *bands: p.select(*px.CELL, *bands, px.valid(*map(F.col, bands)).alias("valid"))
    aligned = px.align_bands(part("pre_vv", "pre_vh").where("x % 5 <> 0"), part("post_vv", "post_vh"), part("elevation").where("y % 7 <> 0"))
    return aligned.select("grid_id", "y", "x", "pre_vv", "post_vh", "elevation", "valid")


def _targets(p: DataFrame) -> DataFrame:
    at = lambda axis: (F.col(axis) * 2 + 0.25).alias("s" + axis)
    return p.where("y < 48 AND x < 48").select(*px.CELL, at("y"), at("x"))


def grid_resample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pixels")
    return px.resample(p, _targets(p), "post_vh").select("grid_id", "y", "x", F.round("post_vh", 8).alias("value"))


def grid_resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pixels")
    return px.resample(p, _targets(p), "post_vh", categorical=True).select("grid_id", "y", "x", F.round("post_vh", 8).alias("value"))


def slope_horn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.slope_horn(load(spark, sf_dir, "pixels"), 10.0, 10.0).select("grid_id", "y", "x", F.round("slope", 6).alias("slope"))


def normalize_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.normalize_bands(_pixels(spark, sf_dir)).select("grid_id", "y", "x", *[F.round(f"{b}_n", 6).alias(f"{b}_n") for b in ("pre_vv", "pre_vh", "post_vv", "post_vh")])


def score_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.score_pixels(_pixels(spark, sf_dir)).select("grid_id", "y", "x", F.round("probability", 6).alias("probability"))


def _masked(spark: SparkSession, sf_dir: str, **given: DataFrame) -> DataFrame:
    return px.flood_mask(px.score_pixels(_pixels(spark, sf_dir, **given)))


def flood_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir).select("grid_id", "y", "x", "mask")


def flood_summary(spark: SparkSession, sf_dir: str, **given: DataFrame) -> DataFrame:
    return px.flood_summary(_masked(spark, sf_dir, **given), 100.0).withColumns({"valid_fraction": F.round("valid_fraction", 6), "flooded_km2": F.round("flooded_km2", 6)})


def flood_grid_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.export_grid(_masked(spark, sf_dir)).select("grid_id", "y", "x", F.round("probability", 6).alias("probability"), "mask")


def tile_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.tile_members(load(spark, sf_dir, "pixels").select(*px.CELL), SMALL_TILES).groupBy("grid_id", "ty", "tx").agg(F.count("*").alias("cells"), F.count_if("core").alias("core_cells"))


def tile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer that looks at each cell alone, so the tiles together must give what the cells give."""
    ready = px.normalize_bands(_pixels(spark, sf_dir).withColumn("slope", F.lit(0.0)))

    def scorer(pre: np.ndarray, post: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(post[0] - pre[0]))

    return tiles.score_tiles(ready, scorer, SMALL_TILES).select("grid_id", "y", "x", F.round("probability", 4).alias("probability"))


def flood_regions(spark: SparkSession, sf_dir: str, **given: DataFrame) -> DataFrame:
    return _measured(rg.flood_regions(load(spark, sf_dir, "flood", **given), SIDE, KM2, block=32))


def flood_regions_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(rg.flood_regions(load(spark, sf_dir, "flood"), SIDE, KM2, block=32, merge=False))


def _measured(regions: DataFrame) -> DataFrame:
    return regions.select("grid_id", "region", "cells", F.round("area_km2", 6).alias("area_km2"), F.round("mean_probability", 10).alias("mean_probability"), F.round("max_probability", 6).alias("max_probability"))


def change_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir).withColumn("mask", (F.col("probability") >= 0.5).cast("int"))
    return rg.change_regions(p, SIDE, KM2).select("grid_id", "region", "cells", F.round("mean_change", 6).alias("mean_change"), F.round("score", 6).alias("score"), "confidence")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.label_regions(load(spark, sf_dir, "flood").where("mask = 1").select(*px.CELL), SIDE, 32)


def region_boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.boundary_edges(_labelled(spark, sf_dir)).select("grid_id", "region", "x1", "y1", "x2", "y2")


def region_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.region_rings(rg.boundary_edges(_labelled(spark, sf_dir))).select("grid_id", "region", "ring", F.size("points").alias("corners"))


def region_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners and extent in degrees of each region; grids lie 0 to 70 km east of zone 31's middle."""
    labelled = _labelled(spark, sf_dir)
    at = F.lit(500_000.0) + F.col("grid_id") % 8 * 10_000.0
    grids = load(spark, sf_dir, "flood").select("grid_id").distinct().select("grid_id", F.lit(32631).alias("epsg"), at.alias("x0"), F.lit(4_000_000.0).alias("y0"), F.lit(float(CELL)).alias("size"))
    out = rg.outlines(rg.region_rings(rg.boundary_edges(labelled)), grids).groupBy("grid_id", "region")

    def end(best, of, c):
        return F.round(best(of(F.transform("outline", lambda p: p[c]))), 6)

    west, east, south, north = (end(F.min, F.array_min, "lon"), end(F.max, F.array_max, "lon"), end(F.min, F.array_min, "lat"), end(F.max, F.array_max, "lat"))
    return out.agg(F.sum(F.size("outline")).alias("corners"), west.alias("west"), east.alias("east"), south.alias("south"), north.alias("north"))


_OK = "(pre_vv <> -9999 AND pre_vh <> -9999 AND post_vv <> -9999 AND post_vh <> -9999)"
_PROB = f"CASE WHEN {_OK} THEN 1 / (1 + exp(0.8 * (10 * log10(post_vv) - 10 * log10(pre_vv) + 3))) END"
_MASKED = with_tables("pixels") + f", scored AS (SELECT grid_id, y, x, {_PROB} AS p FROM pixels), masked AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 WHEN p IS NOT NULL THEN 0 END AS mask FROM scored)"


def _reach(cells: str, near: str = "TRUE") -> str:
    """DuckDB: the smallest cell code that each cell reaches through cells beside it."""
    return f""", on_cells AS ({cells}), walk AS (SELECT grid_id, code AS origin, code FROM on_cells UNION
        SELECT walk.grid_id, origin, b.code FROM walk JOIN on_cells a ON a.grid_id = walk.grid_id AND a.code = walk.code JOIN on_cells b ON b.grid_id = a.grid_id AND ((b.y = a.y AND abs(b.x - a.x) = 1) OR (b.x = a.x AND abs(b.y - a.y) = 1)) AND {near}),
        labels AS (SELECT grid_id, code, min(origin) AS region FROM walk GROUP BY grid_id, code)"""


_FLOODED = "SELECT grid_id, y * 96 + x AS code, y, x, probability FROM flood WHERE mask = 1"
_REGIONS = " SELECT grid_id, CAST(region AS BIGINT) AS region, count(*) AS cells, round(count(*) * 0.0001, 6) AS area_km2, round(avg(probability), 10) AS mean_probability, round(max(probability), 6) AS max_probability FROM on_cells JOIN labels USING (grid_id, code) GROUP BY grid_id, region HAVING count(*) * 0.0001::DOUBLE >= 0.001::DOUBLE"
_DB = "abs(10 * log10(post_vv) - 10 * log10(pre_vv))"

QUERIES = {f.__name__: f for f in (
    pixel_validity, band_select, grid_mismatch, band_align, grid_resample_bilinear, grid_resample_nearest, slope_horn, normalize_bands, score_pixels, flood_mask, flood_summary,
    flood_grid_export, tile_assign, tile_scores, flood_regions, flood_regions_windowed, change_regions, region_boundary_edges, region_rings, region_outlines,
)}
_EDGES = with_tables("flood") + _reach(_FLOODED) + """, sides AS (SELECT unnest([-1, 0, 1, 0]) AS dy, unnest([0, 1, 0, -1]) AS dx, unnest([1, 1, 0, 0]) AS ax, unnest([0, 1, 1, 0]) AS ay, unnest([0, 1, 1, 0]) AS bx, unnest([0, 0, 1, 1]) AS "by"),
    edges AS (SELECT grid_id, CAST(region AS BIGINT) AS region, c.x + ax AS x1, c.y + ay AS y1, c.x + bx AS x2, c.y + "by" AS y2 FROM on_cells c JOIN labels USING (grid_id, code) CROSS JOIN sides WHERE NOT EXISTS (SELECT 1 FROM on_cells d WHERE d.grid_id = c.grid_id AND d.y = c.y + dy AND d.x = c.x + dx))"""
#: Corners are where a side comes in along one axis and goes out along the other; where two corners touch, two go out.  Degrees by the textbook
#: series in the footpoint latitude (Snyder), not by the one the operator takes; the two agree to well under a millimetre this near to the middle.
_FOOT = """, ends AS (SELECT grid_id, region, x1 AS x, y1 AS y, CASE WHEN y1 = y2 THEN 1 ELSE 0 END AS flat, 1 AS out FROM edges UNION ALL SELECT grid_id, region, x2, y2, CASE WHEN y1 = y2 THEN 1 ELSE 0 END, 0 FROM edges),
    met AS (SELECT grid_id, region, x, y, CASE WHEN sum(out) = 2 THEN 2 WHEN min(flat) <> max(flat) THEN 1 ELSE 0 END AS corners FROM ends GROUP BY grid_id, region, x, y),
    c AS (SELECT 6378137.0::DOUBLE AS a, 1 / 298.257223563::DOUBLE AS f),
    k AS (SELECT a, f * (2 - f) AS e2, f * (2 - f) / (1 - f * (2 - f)) AS ep, (1 - sqrt(1 - f * (2 - f))) / (1 + sqrt(1 - f * (2 - f))) AS e1 FROM c),
    m AS (SELECT met.*, k.*, (4000000 - y * 10) / 0.9996::DOUBLE / (a * (1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256 - 175 * e2 ** 4 / 16384)) AS mu, (grid_id % 8 * 10000 + x * 10) / 0.9996::DOUBLE AS east FROM met, k),
    f AS (SELECT *, mu + (3 * e1 / 2 - 27 * e1 ** 3 / 32) * sin(2 * mu) + (21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32) * sin(4 * mu) + 151 * e1 ** 3 / 96 * sin(6 * mu) + 1097 * e1 ** 4 / 512 * sin(8 * mu) AS p FROM m),
    g AS (SELECT *, ep * cos(p) ** 2 AS c1, tan(p) ** 2 AS t1, a / sqrt(1 - e2 * sin(p) ** 2) AS n1, a * (1 - e2) / (1 - e2 * sin(p) ** 2) ** 1.5 AS r1 FROM f),
    h AS (SELECT *, east / n1 AS d FROM g),
    w AS (SELECT grid_id, region, corners, degrees(p - n1 * tan(p) / r1 * (d ** 2 / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 ** 2 - 9 * ep) * d ** 4 / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1 ** 2 - 252 * ep - 3 * c1 ** 2) * d ** 6 / 720)) AS lat,
      3 + degrees((d - (1 + 2 * t1 + c1) * d ** 3 / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 ** 2 + 8 * ep + 24 * t1 ** 2) * d ** 5 / 120) / cos(p)) AS lon FROM h)"""
#: Each side is followed by the one that leaves where it ends, by the sharper turn where two do; the smallest code is handed along a ring until it is known all round.
_RINGS = """, coded AS (SELECT *, (x1 * 100000 + y1) * 4 + CASE WHEN x2 > x1 THEN 0 WHEN y2 > y1 THEN 1 WHEN x2 < x1 THEN 2 ELSE 3 END AS code FROM edges),
    ways AS (SELECT a.grid_id, a.region, a.code, b.code AS next, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS turn FROM coded a JOIN coded b ON b.grid_id = a.grid_id AND b.region = a.region AND b.x1 = a.x2 AND b.y1 = a.y2),
    follow AS (SELECT grid_id, region, code, arg_min(next, turn) AS next, min(turn) AS turn FROM ways GROUP BY ALL),
    ring(grid_id, region, code, label) USING KEY (grid_id, region, code) AS (SELECT grid_id, region, code, code FROM follow
      UNION SELECT f.grid_id, f.region, f.next, min(r.label) FROM ring r JOIN follow f ON f.grid_id = r.grid_id AND f.region = r.region AND f.code = r.code
        JOIN recurring.ring q ON q.grid_id = f.grid_id AND q.region = f.region AND q.code = f.next WHERE r.label < q.label GROUP BY f.grid_id, f.region, f.next)"""
ORACLES = {
    "pixel_validity": with_tables("pixels") + f" SELECT grid_id, y, x, {_OK} AS valid FROM pixels",
    "band_select": f"""WITH c AS ({_BANDS.format(supplier='supplier')}), s AS (SELECT unnest(['sigma0_vv', 'sigma0_vh', 'elevation']) AS suffix)
        SELECT grid_id, suffix, count(*) FILTER (ends_with(replace(lower(name), '-', '_'), suffix)) AS matches,
        CASE WHEN count(*) FILTER (ends_with(replace(lower(name), '-', '_'), suffix)) = 1 THEN min(CASE WHEN ends_with(replace(lower(name), '-', '_'), suffix) THEN band END) END AS band FROM c, s GROUP BY grid_id, suffix""",
    "grid_mismatch": f"""WITH g AS ({_GRIDS.replace('n_nationkey / 3', 'n_nationkey // 3').format(nation='nation')}),
        f AS (SELECT *, first_value(epsg) OVER w AS f1, first_value(width) OVER w AS f2, first_value(y0) OVER w AS f3 FROM g WINDOW w AS (PARTITION BY grid_id ORDER BY role))
        SELECT grid_id, role, 'differs_epsg' AS problem FROM f WHERE epsg <> f1 UNION ALL SELECT grid_id, role, 'differs_width' FROM f WHERE width <> f2
        UNION ALL SELECT grid_id, role, 'differs_y0' FROM f WHERE y0 <> f3 UNION ALL SELECT grid_id, role, 'not_metric' FROM f WHERE epsg = 4326""",
    "band_align": with_tables("pixels") + " SELECT grid_id, y, x, pre_vv, post_vh, elevation, post_vh <> -9999 AS valid FROM pixels WHERE x % 5 <> 0 AND y % 7 <> 0",
    "grid_resample_bilinear": with_tables("pixels") + """, t AS (SELECT grid_id, y, x FROM pixels WHERE y < 48 AND x < 48), c AS (SELECT grid_id, y, x, post_vh AS v FROM pixels WHERE post_vh <> -9999), w AS (SELECT unnest([0, 1]) AS d, unnest([0.75::DOUBLE, 0.25::DOUBLE]) AS f)
        SELECT t.grid_id, t.y, t.x, round(sum(v * a.f * b.f) / sum(CASE WHEN v IS NOT NULL THEN a.f * b.f END), 8) AS value FROM t CROSS JOIN w a CROSS JOIN w b LEFT JOIN c ON c.grid_id = t.grid_id AND c.y = t.y * 2 + a.d AND c.x = t.x * 2 + b.d GROUP BY t.grid_id, t.y, t.x""",
    "grid_resample_nearest": with_tables("pixels") + " SELECT t.grid_id, t.y, t.x, round(c.post_vh, 8) AS value FROM pixels t LEFT JOIN pixels c ON c.grid_id = t.grid_id AND c.y = t.y * 2 AND c.x = t.x * 2 AND c.post_vh <> -9999 WHERE t.y < 48 AND t.x < 48",
    "slope_horn": with_tables("pixels") + """, w AS (SELECT dy, dx FROM (SELECT unnest([-1, 0, 1]) AS dy) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx)),
        g AS (SELECT p.grid_id, p.y, p.x, count(q.elevation) AS n, sum(q.elevation * w.dx * (2 - abs(w.dy))) / 80 AS gx, sum(q.elevation * w.dy * (2 - abs(w.dx))) / 80 AS gy FROM pixels p CROSS JOIN w LEFT JOIN pixels q ON q.grid_id = p.grid_id AND q.y = p.y + w.dy AND q.x = p.x + w.dx GROUP BY p.grid_id, p.y, p.x)
        SELECT grid_id, y, x, CASE WHEN n = 9 THEN round(sqrt(gx * gx + gy * gy), 6) END AS slope FROM g""",
    "normalize_bands": with_tables("pixels") + " SELECT grid_id, y, x, " + ", ".join(f"CASE WHEN {_OK} THEN round((greatest(0, least({b}, 0.15::DOUBLE)) - {m}::DOUBLE) / {s}::DOUBLE, 6) ELSE 0 END AS {b}_n" for b, m, s in (("pre_vv", 0.0953, 0.0427), ("pre_vh", 0.0264, 0.0215), ("post_vv", 0.0953, 0.0427), ("post_vh", 0.0264, 0.0215))) + " FROM pixels",
    "score_pixels": _MASKED + " SELECT grid_id, y, x, round(p, 6) AS probability FROM masked",
    "flood_mask": _MASKED + " SELECT grid_id, y, x, mask FROM masked",
    "flood_summary": _MASKED + " SELECT grid_id, count(*) AS pixels, count(mask) AS valid_pixels, count(*) FILTER (mask = 1) AS flooded_pixels, round(count(mask) / count(*), 6) AS valid_fraction, round(count(*) FILTER (mask = 1) * 100 / 1e6, 6) AS flooded_km2 FROM masked GROUP BY grid_id",
    "flood_grid_export": _MASKED + " SELECT grid_id, y, x, coalesce(round(p, 6), -9999) AS probability, coalesce(mask, 255) AS mask FROM masked",
    "tile_assign": with_tables("pixels") + """, t AS (SELECT unnest(range(0, 4)) AS k), m AS (SELECT grid_id, a.k AS ty, b.k AS tx, y // 32 = a.k AND x // 32 = b.k AS core FROM pixels, t a, t b WHERE y BETWEEN a.k * 32 - 8 AND a.k * 32 + 39 AND x BETWEEN b.k * 32 - 8 AND b.k * 32 + 39)
        SELECT grid_id, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx, count(*) AS cells, count(*) FILTER (core) AS core_cells FROM m GROUP BY grid_id, ty, tx""",
    "tile_scores": with_tables("pixels") + f" SELECT grid_id, y, x, CASE WHEN {_OK} THEN round(1 / (1 + exp((least(post_vv, 0.15::DOUBLE) - least(pre_vv, 0.15::DOUBLE)) / 0.0427::DOUBLE)), 4) END AS probability FROM pixels",
    "flood_regions": with_tables("flood") + _reach(_FLOODED) + _REGIONS,
    "flood_regions_windowed": with_tables("flood") + _reach(_FLOODED, "a.y // 32 = b.y // 32 AND a.x // 32 = b.x // 32") + _REGIONS,
    "change_regions": with_tables("pixels") + _reach(f"SELECT grid_id, y * 96 + x AS code, y, x, {_DB} AS db FROM pixels WHERE {_OK} AND probability < 0.5 AND {_DB} >= 3")
        + " SELECT grid_id, CAST(region AS BIGINT) AS region, count(*) AS cells, round(avg(db), 6) AS mean_change, round(least(1, avg(db) / 6), 6) AS score, CASE WHEN avg(db) / 6 < 0.5 THEN 'low' WHEN avg(db) / 6 < 0.75 THEN 'medium' ELSE 'high' END AS confidence FROM on_cells JOIN labels USING (grid_id, code) GROUP BY grid_id, region HAVING count(*) * 0.0001::DOUBLE >= 0.001::DOUBLE",
    "region_boundary_edges": _EDGES + " SELECT * FROM edges",
    "region_rings": _EDGES + _RINGS + " SELECT grid_id, region, CAST(dense_rank() OVER (PARTITION BY grid_id, region ORDER BY label) - 1 AS INT) AS ring, CAST(corners AS INT) AS corners FROM (SELECT grid_id, region, label, count(*) FILTER (turn <> 0) AS corners FROM ring JOIN follow USING (grid_id, region, code) GROUP BY ALL)",
    "region_outlines": _EDGES + _FOOT + " SELECT grid_id, region, CAST(sum(corners) AS BIGINT) AS corners, round(min(lon), 6) AS west, round(max(lon), 6) AS east, round(min(lat), 6) AS south, round(max(lat), 6) AS north FROM w GROUP BY grid_id, region",
}
