"""Domain tables derived from the generic tables, in SQL that Spark and DuckDB both run.

The generic tables hold orders, parts and events; these SELECTs read them as
scenes, pixels, features and so on, by whole-number arithmetic, so both engines
derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Cell side in metres of the pixel tables, and cells of a side.
CELL, SIDE = 10, 96
#: Orders whose lines fill one grid, and the parts and customers that lie on it; more rows make more grids.
ORDERS_A_GRID, PARTS_A_GRID, CUSTOMERS_A_GRID = 8192, 1024, 800
#: Orders that make one road network, and the suppliers that lie on it.
ORDERS_A_NETWORK, SUPPLIERS_A_NETWORK = 8192, 64

TABLES: dict[str, str] = {
    "requests": "SELECT CAST(n_nationkey AS INT) AS request_id, DATE '1996-01-01' + CAST(n_nationkey * 67 AS INT) AS event_date FROM {nation}",
    "scenes": """SELECT CAST(o_custkey % 25 AS INT) AS request_id, CAST(o_orderkey AS STRING) AS scene_id, o_orderkey AS ingest_seq,
        CASE o_custkey % 3 WHEN 0 THEN 's1a' WHEN 1 THEN 's1b' ELSE 's1c' END AS platform,
        o_orderdate + INTERVAL '1' SECOND * CAST(o_orderkey % 86400 AS INT) AS acquired_at, 'GRD' AS product_type,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'IW' END AS instrument_mode,
        split(CASE WHEN o_orderkey % 5 = 0 THEN 'VV' ELSE 'VH,VV' END, ',') AS polarizations,
        CASE o_orderstatus WHEN 'F' THEN 'ASCENDING' ELSE 'DESCENDING' END AS orbit_direction,
        CAST(o_custkey % 7 AS INT) AS relative_orbit, CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 AS aoi_coverage_fraction,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) END AS cloud_cover,
        CAST((o_custkey % 25) * 4 + o_orderkey % 7 AS DOUBLE) / 10 AS xmin, CAST((o_custkey % 25) * 2 + o_orderkey % 5 AS DOUBLE) / 10 AS ymin,
        CAST((o_custkey % 25) * 4 + o_orderkey % 7 + 10 AS DOUBLE) / 10 AS xmax, CAST((o_custkey % 25) * 2 + o_orderkey % 5 + 8 AS DOUBLE) / 10 AS ymax
        FROM {orders}""",
    "scene_boxes": """SELECT request_id, CAST(request_id * 4 + 3 AS DOUBLE) / 10 AS xmin, CAST(request_id * 2 + 2 AS DOUBLE) / 10 AS ymin,
        CAST(request_id * 4 + 12 AS DOUBLE) / 10 AS xmax, CAST(request_id * 2 + 11 AS DOUBLE) / 10 AS ymax FROM (SELECT CAST(n_nationkey AS INT) AS request_id FROM {nation}) x""",
    "cells": f"""SELECT CAST(floor(l_orderkey / {ORDERS_A_GRID}) AS INT) AS grid_id, CAST(l_orderkey % 96 AS INT) AS y, CAST(l_partkey % 96 AS INT) AS x, CAST(sum(l_linenumber) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS n
        FROM {{lineitem}} GROUP BY 1, 2, 3""",
    "pixels": """SELECT grid_id, y, x, CAST(s * 13 % 97 + 3 AS DOUBLE) / 1000 AS pre_vv, CAST(s * 7 % 53 + 2 AS DOUBLE) / 1000 AS pre_vh,
        CAST(s * 29 % 101 + 3 AS DOUBLE) / 1000 AS post_vv, CASE WHEN (s + n) % 31 = 0 THEN CAST(-9999 AS DOUBLE) ELSE CAST(s * 11 % 59 + 2 AS DOUBLE) / 1000 END AS post_vh,
        CAST(3 * y + 2 * x + s % 5 AS DOUBLE) AS elevation, CAST((s * 7 + n * 13) % 101 AS DOUBLE) / 100 AS probability FROM cells""",
    "flood": "SELECT grid_id, y, x, probability, CAST(CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS INT) AS mask FROM pixels",
    "buildings": f"""SELECT CAST(p_partkey AS STRING) AS feature_id, CAST(floor(p_partkey / {PARTS_A_GRID}) AS INT) AS grid_id, CAST(p_partkey * 37 % 931 + 1 AS DOUBLE) AS xmin, CAST(p_partkey * 53 % 937 + 3 AS DOUBLE) AS ymin,
        CAST(p_partkey * 37 % 931 + 5 + p_size % 17 AS DOUBLE) AS xmax, CAST(p_partkey * 53 % 937 + 8 + p_size % 13 AS DOUBLE) AS ymax FROM {{part}}""",
    "roads": f"""SELECT CAST(c_custkey AS STRING) AS feature_id, CAST(floor(c_custkey / {CUSTOMERS_A_GRID}) AS INT) AS grid_id, CAST(c_custkey * 31 % 911 AS DOUBLE) + 0.25 AS x1, CAST(c_custkey * 47 % 907 AS DOUBLE) + 0.25 AS y1,
        CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey * 31 % 911 + 20 + c_custkey % 50 AS DOUBLE) + 0.25 ELSE CAST(c_custkey * 31 % 911 AS DOUBLE) + 0.25 END AS x2,
        CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey * 47 % 907 AS DOUBLE) + 0.25 ELSE CAST(c_custkey * 47 % 907 + 20 + c_custkey % 50 AS DOUBLE) + 0.25 END AS y2,
        CASE c_custkey % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' WHEN 2 THEN 'track' ELSE 'cycleway' END AS highway,
        CASE c_custkey % 9 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' ELSE NULL END AS oneway,
        CASE c_custkey % 6 WHEN 0 THEN '50' WHEN 1 THEN '30 mph' WHEN 2 THEN 'signals' WHEN 3 THEN '40;60' ELSE NULL END AS maxspeed,
        CASE c_custkey % 8 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE NULL END AS bridge, CASE c_custkey % 16 WHEN 0 THEN 'yes' ELSE NULL END AS tunnel FROM {{customer}}""",
    "lattice": f"""SELECT CAST(floor(o_orderkey / {ORDERS_A_NETWORK}) AS INT) AS request_id, CAST(o_orderkey AS STRING) AS segment_id, CAST(o_custkey AS STRING) AS parent_road_id,
        CAST(o_custkey % 24 * 100 AS DOUBLE) AS x1, CAST(o_orderkey % 24 * 100 AS DOUBLE) AS y1,
        CAST(o_custkey % 24 * 100 + CASE WHEN (o_custkey + o_orderkey) % 2 = 0 THEN 100 ELSE 0 END AS DOUBLE) AS x2, CAST(o_orderkey % 24 * 100 + CASE WHEN (o_custkey + o_orderkey) % 2 = 0 THEN 0 ELSE 100 END AS DOUBLE) AS y2,
        CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'primary' WHEN '2' THEN 'secondary' WHEN '3' THEN 'residential' WHEN '4' THEN 'track' ELSE 'footway' END AS highway,
        CASE WHEN o_orderkey % 7 = 0 THEN 'yes' WHEN o_orderkey % 7 = 1 THEN '-1' ELSE NULL END AS oneway, CAST(NULL AS STRING) AS maxspeed,
        CASE WHEN o_custkey % 24 IN (5, 11) AND o_orderkey % 24 <> 3 THEN 'BLOCKED' WHEN o_custkey % 24 = 17 AND o_orderkey % 24 > 20 THEN 'BLOCKED' WHEN o_custkey % 11 = 1 THEN 'UNKNOWN_COVERAGE' WHEN o_custkey % 11 = 2 THEN 'POTENTIALLY_BLOCKED' ELSE 'OPEN' END AS status
        FROM {{orders}}""",
    "places": f"""SELECT CAST(floor(s_suppkey / {SUPPLIERS_A_NETWORK}) AS INT) AS request_id, CAST(s_suppkey AS STRING) AS feature_id, s_name AS name, CAST(s_suppkey * 173 % 2500 AS DOUBLE) + 0.5 AS x, CAST(s_suppkey * 311 % 2600 AS DOUBLE) + 0.5 AS y,
        CASE s_suppkey % 10 WHEN 0 THEN 'healthcare' ELSE 'settlement' END AS category, CASE s_suppkey % 5 WHEN 1 THEN 'town' WHEN 2 THEN 'village' WHEN 3 THEN 'hamlet' ELSE 'suburb' END AS place
        FROM {{supplier}}""",
    "versions": """SELECT CAST(user_id AS STRING) AS feature_id, event_id AS version, ts AS version_ts, CASE WHEN event_type = 'logout' OR event_id % 13 = 0 THEN 1 ELSE 0 END AS deleted, value FROM {events}""",
    "stage_log": "SELECT CAST(user_id AS STRING) AS job_id, event_type AS stage, ts AS started_at, event_id AS seq, CASE event_id % 7 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'QUEUED' WHEN 2 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, CAST(event_id % 101 AS INT) AS percent FROM {events}",
    "artifacts": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a.geojson' WHEN 1 THEN 'b.json' WHEN 2 THEN 'c.HTML' WHEN 3 THEN 'd.tif' ELSE 'e.bin' END AS name, html FROM {pages}",
}
#: Tables that a table is derived from, beside the generic ones.
NEEDS = {"pixels": ["cells"], "flood": ["pixels"]}
GENERIC = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


def with_tables(*names: str) -> str:
    """``WITH name AS (...)`` for DuckDB, in order of need, ending in a comma-free list."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({TABLES[n].format(**{g: g for g in GENERIC})})" for n in order)


def load(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A derived or generic table; those ``given`` are taken as they are, also by what is derived from them."""
    if name in given:
        return given[name]
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = TABLES[name]
    tables = {g: load(spark, sf_dir, g, **given) for g in GENERIC if "{" + g + "}" in sql}
    for other in NEEDS.get(name, []):
        sql = sql.replace(f"FROM {other}", "FROM {" + other + "}")
        tables[other] = load(spark, sf_dir, other, **given)
    return spark.sql(sql, **tables)


def asked(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Those rows of tables that lie on a grid, or in a network, that a request has the number of: what a report per request is made of."""
    requests = load(spark, sf_dir, "requests").select("request_id")
    out = {}
    for name in names:
        rows = load(spark, sf_dir, name)
        key = "grid_id" if "grid_id" in rows.columns else "request_id"
        out[name] = rows.join(requests.withColumnRenamed("request_id", key), key, "left_semi")
    return out
