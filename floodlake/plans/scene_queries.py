"""Queries over scenes and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scenes as op
from ..policy import DEFAULT
from .fixtures import load, with_tables

A, B = 6378137.0, 6356752.314245179


def _strip(lat: str) -> str:
    """DuckDB: area of a strip of one radian up to a latitude."""
    e2 = 0.0066943799901413165
    e = 0.0818191908426215
    s = f"sin(radians({lat}))"
    return f"({B}::DOUBLE * {B}::DOUBLE / 2 * ({s} / (1 - {e2}::DOUBLE * {s} * {s}) + ln((1 + {e}::DOUBLE * {s}) / (1 - {e}::DOUBLE * {s})) / (2 * {e}::DOUBLE)))"


def _rectangle(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"(CASE WHEN {x1} > {x0} AND {y1} > {y0} THEN radians({x1} - {x0}) * ({_strip(y1)} - {_strip(y0)}) / 1e6 ELSE 0 END)"


_ITEM = """concat('{{"id":"', o_orderkey, '","properties":{{', CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE concat('"datetime":"1996-01-', CASE WHEN o_custkey % 28 < 9 THEN '0' ELSE '' END, o_custkey % 28 + 1, 'T01:02:03Z",') END,
    CASE o_custkey % 3 WHEN 0 THEN '"platform":"S1A",' WHEN 1 THEN '"platform":"s1b",' ELSE '' END,
    CASE o_orderkey % 4 WHEN 0 THEN '"sar:product_type":"grd",' WHEN 1 THEN '"product:type":"Slc",' WHEN 2 THEN '"productType":"ocn",' ELSE '' END,
    CASE o_orderkey % 3 WHEN 0 THEN '"sar:polarizations":["vv","vh","vv"],' WHEN 1 THEN '"polarization":"hh",' ELSE '' END,
    '"eo:cloud_cover":', o_orderkey % 100, '}},"assets":{{"a":{{"href":"h', o_orderkey, '","roles":["overview"]}}',
    CASE WHEN o_orderkey % 2 = 0 THEN concat(',"b":{{"href":"d', o_orderkey, '","roles":["data"]}}') ELSE '' END, '}}}}')"""


def scene_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.sql(f"SELECT CAST(o_custkey % 25 AS INT) AS request_id, {_ITEM} AS item FROM {{orders}}", orders=load(spark, sf_dir, "orders"))
    scenes, _ = op.normalize_scene_items(items)
    return scenes.select("request_id", "scene_id", "platform", F.date_format("acquired_at", "yyyy-MM-dd HH:mm:ss").alias("acquired_at"), "product_type", F.array_join("polarizations", ",").alias("polarizations"), "cloud_cover", "asset_href")


SCENE_NORMALIZE = """SELECT CAST(o_custkey % 25 AS INT) AS request_id, CAST(o_orderkey AS VARCHAR) AS scene_id, CASE o_custkey % 3 WHEN 0 THEN 's1a' WHEN 1 THEN 's1b' ELSE 'unknown' END AS platform,
    strftime(make_date(1996, 1, CAST(o_custkey % 28 + 1 AS INT)), '%Y-%m-%d') || ' 01:02:03' AS acquired_at, CASE o_orderkey % 4 WHEN 0 THEN 'GRD' WHEN 1 THEN 'SLC' WHEN 2 THEN 'OCN' END AS product_type,
    CASE o_orderkey % 3 WHEN 0 THEN 'VH,VV' WHEN 1 THEN 'HH' ELSE '' END AS polarizations, CAST(o_orderkey % 100 AS DOUBLE) AS cloud_cover,
    CASE WHEN o_orderkey % 2 = 0 THEN 'd' ELSE 'h' END || o_orderkey AS asset_href FROM orders WHERE o_orderkey % 19 <> 0"""


def event_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.in_event_window(load(spark, sf_dir, "scenes"), load(spark, sf_dir, "requests"), 12).select("request_id", "scene_id")


def scene_property_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.filter_scenes(load(spark, sf_dir, "scenes"), {"instrument_mode": "IW", "orbit_direction": "ASCENDING"}, {"relative_orbit": 4}, 40.0).select("request_id", "scene_id", "cloud_cover")


def scene_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "scenes")
    twice = s.unionByName(s.where("ingest_seq % 3 = 0").withColumn("ingest_seq", F.col("ingest_seq") + 10_000_000).withColumn("platform", F.lit("again")))
    return op.dedupe_scenes(twice).select("request_id", "scene_id", "platform")


def scene_aoi_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "scenes").drop("aoi_coverage_fraction")
    return op.scene_coverage(s, load(spark, sf_dir, "scene_boxes")).select("request_id", "scene_id", F.round("aoi_coverage_fraction", 6).alias("coverage"))


def scene_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = op.scene_pairs(load(spark, sf_dir, "scenes"), load(spark, sf_dir, "requests"), days=12)
    return pairs.select("request_id", F.col("pre.scene_id").alias("pre_id"), F.col("post.scene_id").alias("post_id"), F.array_join("reasons", ",").alias("reasons"), "pre_days", "post_days")


def _scored(spark: SparkSession, sf_dir: str, days: int = 48) -> DataFrame:
    pairs = op.leading_pairs(load(spark, sf_dir, "scenes"), load(spark, sf_dir, "requests"), days)
    return op.score_pairs(pairs, F.lit(days))


def best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = op.best_pair(_scored(spark, sf_dir))
    return best.select("request_id", F.col("pre.scene_id").alias("pre_id"), F.col("post.scene_id").alias("post_id"), F.round("footprint_overlap", 6).alias("overlap"), F.round("score", 6).alias("score"))


def pair_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = load(spark, sf_dir, "scenes"), load(spark, sf_dir, "requests")
    best = op.best_pair(op.score_pairs(op.leading_pairs(*tables, 12), F.lit(12)))
    alternatives = op.pair_alternatives(op.near_pairs(*tables, days=12), best)
    return alternatives.select("request_id", "rank", F.col("pre.scene_id").alias("pre_id"), F.col("post.scene_id").alias("post_id"), F.array_join("reasons", ",").alias("reasons"))


def adaptive_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.adaptive_pairing(load(spark, sf_dir, "scenes"), load(spark, sf_dir, "requests")).withColumn("score", F.round("score", 6))


def pair_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = load(spark, sf_dir, "scenes"), load(spark, sf_dir, "requests")
    return op.pair_failures(s, r, 12)


def pair_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.pair_warnings(op.best_pair(_scored(spark, sf_dir)), F.lit(48)).select("request_id", F.array_join("warnings", ",").alias("warnings"))


def _pairs_sql(days: int) -> str:
    """DuckDB: the pairs within so many days, with reasons, criteria and score."""
    reasons = []
    for c in ("instrument_mode", "polarizations", "orbit_direction", "relative_orbit", "product_type"):
        reasons.append(f"CASE WHEN a.{c} IS NULL OR b.{c} IS NULL THEN 'missing_{c}' WHEN a.{c} <> b.{c} THEN 'mismatched_{c}' END")
    reasons += [f"CASE WHEN {s}.aoi_coverage_fraction < 0.8 THEN 'insufficient_aoi_coverage_{n}' END" for s, n in (("a", "pre"), ("b", "post"))]
    common = _rectangle("greatest(a.xmin, b.xmin)", "greatest(a.ymin, b.ymin)", "least(a.xmax, b.xmax)", "least(a.ymax, b.ymax)")
    whole = [_rectangle(*[f"{s}.{c}" for c in ("xmin", "ymin", "xmax", "ymax")]) for s in "ab"]
    return with_tables("requests", "scenes") + f""",
found AS (SELECT r.request_id, r.event_date, a.scene_id AS pre_id, b.scene_id AS post_id, a.platform AS pa, b.platform AS pb, array_to_string(list_filter([{', '.join(reasons)}], lambda x: x IS NOT NULL), ',') AS reasons,
    CAST(r.event_date - CAST(a.acquired_at AS DATE) AS INT) AS pre_days, CAST(CAST(b.acquired_at AS DATE) - r.event_date AS INT) AS post_days,
    greatest(0, epoch(CAST(r.event_date AS TIMESTAMP)) - epoch(a.acquired_at)) / 86400 AS pre_gap, greatest(0, epoch(b.acquired_at) - epoch(CAST(r.event_date AS TIMESTAMP))) / 86400 AS post_gap,
    {common} / ({whole[0]} + {whole[1]} - {common}) AS overlap, least(a.aoi_coverage_fraction, b.aoi_coverage_fraction) AS coverage
  FROM requests r JOIN scenes a ON a.request_id = r.request_id AND CAST(a.acquired_at AS DATE) < r.event_date AND CAST(a.acquired_at AS DATE) >= r.event_date - {days}
  JOIN scenes b ON b.request_id = r.request_id AND CAST(b.acquired_at AS DATE) > r.event_date AND CAST(b.acquired_at AS DATE) <= r.event_date + {days})"""


def _score_sql(window: str) -> str:
    return f"least(1, greatest(0, overlap * 0.25::DOUBLE + greatest(0, 1 - pre_gap / {window}) * 0.25::DOUBLE + greatest(0, 1 - post_gap / {window}) * 0.25::DOUBLE + CASE WHEN pa = pb THEN 0.1::DOUBLE ELSE 0 END + coverage * 0.15::DOUBLE))"


_BEST = f", ranked AS (SELECT *, {_score_sql('48')} AS score, row_number() OVER (PARTITION BY request_id ORDER BY {_score_sql('48')} DESC, pre_id, post_id) AS k FROM found WHERE reasons = '')"

QUERIES = {f.__name__: f for f in (scene_normalize, event_window_filter, scene_property_filter, scene_dedupe, scene_aoi_coverage, scene_pairs, best_pair, pair_alternatives, adaptive_pairing, pair_failures, pair_warnings)}
ORACLES = {
    "scene_normalize": SCENE_NORMALIZE,
    "event_window_filter": with_tables("requests", "scenes") + " SELECT request_id, scene_id FROM scenes JOIN requests USING (request_id) WHERE abs(date_diff('day', CAST(event_date AS DATE), CAST(acquired_at AS DATE))) <= 12",
    "scene_property_filter": with_tables("scenes") + " SELECT request_id, scene_id, cloud_cover FROM scenes WHERE instrument_mode = 'IW' AND orbit_direction = 'ASCENDING' AND relative_orbit <= 4 AND cloud_cover <= 40",
    "scene_dedupe": with_tables("scenes") + " SELECT request_id, scene_id, CASE WHEN ingest_seq % 3 = 0 THEN 'again' ELSE platform END AS platform FROM scenes",
    "scene_aoi_coverage": with_tables("scenes", "scene_boxes") + f""" SELECT s.request_id, scene_id, round(least(1, {_rectangle('greatest(s.xmin, b.xmin)', 'greatest(s.ymin, b.ymin)', 'least(s.xmax, b.xmax)', 'least(s.ymax, b.ymax)')}
        / {_rectangle('b.xmin', 'b.ymin', 'b.xmax', 'b.ymax')}), 6) AS coverage FROM scenes s JOIN scene_boxes b ON s.request_id = b.request_id""",
    "scene_pairs": _pairs_sql(12) + " SELECT request_id, pre_id, post_id, reasons, pre_days, post_days FROM found",
    "best_pair": _pairs_sql(48) + _BEST + " SELECT request_id, pre_id, post_id, round(overlap, 6) AS overlap, round(score, 6) AS score FROM ranked WHERE k = 1",
    "pair_alternatives": _pairs_sql(12) + f""", scored AS (SELECT *, {_score_sql('12')} AS score FROM found),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pre_id, post_id) AS k FROM scored WHERE reasons = '') WHERE k = 1),
        rest AS (SELECT s.*, row_number() OVER (PARTITION BY s.request_id ORDER BY CASE WHEN reasons = '' THEN 0 ELSE len(string_split(reasons, ',')) END, pre_days + post_days, pre_id, post_id) AS rank
          FROM scored s WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.request_id = s.request_id AND b.pre_id = s.pre_id AND b.post_id = s.post_id))
        SELECT request_id, CAST(rank AS INT) AS rank, pre_id, post_id, CASE WHEN reasons = '' THEN 'lower_score_than_selected' ELSE reasons END AS reasons FROM rest WHERE rank <= 20""",
    "adaptive_pairing": _pairs_sql(96) + f""", fitted AS (SELECT *, CASE WHEN greatest(pre_days, post_days) <= 12 THEN 12 WHEN greatest(pre_days, post_days) <= 24 THEN 24 WHEN greatest(pre_days, post_days) <= 48 THEN 48 ELSE 96 END AS fits FROM found),
        first_window AS (SELECT request_id, min(fits) AS w FROM fitted WHERE reasons = '' GROUP BY request_id),
        scored AS (SELECT f.*, w, {_score_sql('w')} AS score FROM fitted f JOIN first_window USING (request_id) WHERE reasons = '' AND fits <= w),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pre_id, post_id) AS k FROM scored) WHERE k = 1),
        seen AS (SELECT DISTINCT request_id FROM scenes JOIN requests USING (request_id) WHERE CAST(acquired_at AS DATE) BETWEEN event_date - 96 AND event_date + 96),
        short AS (SELECT request_id, bool_and(list_aggregate(list_transform(string_split(reasons, ','), lambda x: starts_with(x, 'insufficient_aoi')), 'bool_and')) AS only_short FROM found GROUP BY request_id)
        SELECT r.request_id, CASE WHEN b.score IS NOT NULL THEN 'PAIRED' WHEN seen.request_id IS NULL THEN 'NO_S1_SCENES' WHEN coalesce(only_short, false) THEN 'S1_INSUFFICIENT_AOI_COVERAGE' ELSE 'S1_NO_VALID_PAIR' END AS status,
          CAST(w AS INT) AS window_days, pre_id, post_id, round(score, 6) AS score
        FROM requests r LEFT JOIN best b ON b.request_id = r.request_id LEFT JOIN seen ON seen.request_id = r.request_id LEFT JOIN short ON short.request_id = r.request_id""",
    "pair_failures": _pairs_sql(12) + """, seen AS (SELECT request_id, count(*) AS n FROM scenes JOIN requests USING (request_id) WHERE CAST(acquired_at AS DATE) BETWEEN event_date - 12 AND event_date + 12 GROUP BY request_id),
        short AS (SELECT request_id, count(*) AS n, bool_and(list_aggregate(list_transform(string_split(reasons, ','), lambda x: starts_with(x, 'insufficient_aoi')), 'bool_and')) AS only_short FROM found GROUP BY request_id)
        SELECT r.request_id, CASE WHEN seen.n IS NULL THEN 'NO_S1_SCENES' WHEN coalesce(only_short, false) THEN 'S1_INSUFFICIENT_AOI_COVERAGE' ELSE 'S1_NO_VALID_PAIR' END AS failure, CAST(coalesce(seen.n, 0) AS BIGINT) AS scenes, CAST(coalesce(short.n, 0) AS BIGINT) AS pairs
        FROM requests r LEFT JOIN seen ON seen.request_id = r.request_id LEFT JOIN short ON short.request_id = r.request_id""",
    "pair_warnings": _pairs_sql(48) + _BEST + """ SELECT request_id, array_to_string(list_filter([CASE WHEN pa <> pb THEN 'platforms_differ' END, CASE WHEN least(pre_gap, 48) + least(post_gap, 48) > 24 THEN 'long_gap' END], lambda x: x IS NOT NULL), ',') AS warnings FROM ranked WHERE k = 1""",
}
