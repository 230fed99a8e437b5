"""Queries over the road network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import network as nw
from .fixtures import load, with_tables


def _edges(spark: SparkSession, sf_dir: str, **given: DataFrame) -> DataFrame:
    return nw.road_edges(load(spark, sf_dir, "lattice", **given))


def _name(n: str) -> Column:
    """A node's name, its request in front."""
    return F.concat_ws(":", "request_id", nw.node_name(F.col(n)))


def _named(edges: DataFrame) -> DataFrame:
    return edges.select("segment_id", _name("src").alias("src"), _name("dst").alias("dst"), "status", F.round("length_m", 6).alias("length_m"), F.round("time_s", 6).alias("time_s"))


def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_edges(spark, sf_dir))


def post_event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(nw.post_event_edges(_edges(spark, sf_dir), strict=True))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "places")


def access_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(_places(spark, sf_dir)).select("feature_id", "category", "place")


def _sources(places: DataFrame) -> DataFrame:
    return places.where("category = 'healthcare' OR category = 'settlement' AND place IN ('town', 'city')")


def snap_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapped = nw.snap_points(_places(spark, sf_dir), _edges(spark, sf_dir))
    return snapped.select("feature_id", "kind", F.when(F.col("node").isNotNull(), _name("node")).alias("node"), F.round("distance_m", 6).alias("distance_m"))


def split_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    parts = nw.split_edges(edges, nw.snap_points(_places(spark, sf_dir), edges))
    return parts.groupBy("segment_id").agg(F.count("*").alias("parts"), F.round(F.sum("length_m"), 6).alias("length_m"), F.round(F.sum("time_s"), 6).alias("time_s"))


#: Three places of help in each network.
_STARTS = "SELECT request_id, CAST(n_nationkey AS STRING) AS source_id, CAST(n_nationkey * 7 % 24 * 100 AS DOUBLE) AS x, CAST(n_nationkey * 5 % 24 * 100 AS DOUBLE) AS y FROM (SELECT DISTINCT request_id FROM {lattice}) q JOIN {nation} ON n_nationkey IN (0, 9, 18)"


def _starts(spark: SparkSession, sf_dir: str, **given: DataFrame) -> DataFrame:
    s = spark.sql(_STARTS, nation=load(spark, sf_dir, "nation"), lattice=load(spark, sf_dir, "lattice", **given))
    return s.select("request_id", "source_id", nw.node(F.col("x"), F.col("y")).alias("node"))


def shortest_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = nw.shortest_access(_edges(spark, sf_dir), _starts(spark, sf_dir))
    return got.select(_name("node").alias("node"), F.round("time_s", 6).alias("time_s"))


def _access(spark: SparkSession, sf_dir: str, **given: DataFrame) -> DataFrame:
    edges, starts = _edges(spark, sf_dir, **given), _starts(spark, sf_dir, **given)
    before, after = nw.shortest_access(edges, starts), nw.shortest_access(nw.post_event_edges(edges), starts)
    nodes = edges.select("request_id", "dst").union(edges.select("request_id", "src")).distinct()
    homes = nodes.select("request_id", _name("dst").alias("feature_id"), F.lit(None).cast("string").alias("name"), F.col("dst").alias("node"))
    return nw.settlement_access(homes, before, after)


def settlement_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _access(spark, sf_dir).select("feature_id", "status", F.round("before_time_s", 6).alias("before_time_s"), F.round("after_time_s", 6).alias("after_time_s"))


def connectivity_summary(spark: SparkSession, sf_dir: str, **given: DataFrame) -> DataFrame:
    return nw.connectivity_summary(_access(spark, sf_dir, **given))


def route_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only: routes of equal time differ between engines."""
    return _access(spark, sf_dir).where("size(blockers) > 0").select("feature_id", F.array_join("blockers", ",").alias("blockers"))


def most_affected_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.most_affected(_access(spark, sf_dir)).select("request_id", "rank", "feature_id", "status")


def access_sources_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source of each node in input order, that is by number."""
    places = _places(spark, sf_dir)
    at = nw.snap_points(_sources(places), _edges(spark, sf_dir)).select("request_id", "node", F.col("feature_id").alias("source_id"), F.col("feature_id").cast("long").alias("seq"))
    return nw.sources_by_node(at, "seq").select(_name("node").alias("node"), "source_id")


def places_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements routed to towns and healthcare over the roads they are snapped to, before and after the event."""
    source = F.expr("category = 'healthcare' OR category = 'settlement' AND place IN ('town', 'city')")
    places = _places(spark, sf_dir).withColumns({"settlement": F.col("category") == "settlement", "source": source})
    got = nw.access_of_places(load(spark, sf_dir, "lattice"), places)
    return got.select("feature_id", F.round("before_time_s", 4).alias("before_time_s"), F.round("after_time_s", 4).alias("after_time_s"))


_DIRECTED = with_tables("lattice", "places") + f""", starts AS ({_STARTS.format(nation='nation', lattice='lattice')}),
    drive AS (SELECT *, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS m, CASE highway WHEN 'primary' THEN 60 WHEN 'secondary' THEN 50 WHEN 'residential' THEN 30 WHEN 'track' THEN 15 END AS v FROM lattice WHERE highway <> 'footway'),
    edges AS (SELECT request_id, segment_id, request_id || ':' || CAST(x1 * 100 AS BIGINT) || ',' || CAST(y1 * 100 AS BIGINT) AS src, request_id || ':' || CAST(x2 * 100 AS BIGINT) || ',' || CAST(y2 * 100 AS BIGINT) AS dst, status, m, m * 3.6 / v AS t, x1, y1, x2, y2 FROM drive WHERE coalesce(oneway, 'no') <> '-1'
      UNION ALL SELECT request_id, segment_id, request_id || ':' || CAST(x2 * 100 AS BIGINT) || ',' || CAST(y2 * 100 AS BIGINT), request_id || ':' || CAST(x1 * 100 AS BIGINT) || ',' || CAST(y1 * 100 AS BIGINT), status, m, m * 3.6 / v, x2, y2, x1, y1 FROM drive WHERE coalesce(oneway, 'no') <> 'yes')"""
_SNAPPED = _DIRECTED + """, near AS (SELECT feature_id, p.x, p.y, e.*, greatest(0, least(1, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / (m * m))) AS f FROM places p JOIN edges e ON e.request_id = p.request_id),
    ranged AS (SELECT *, x1 + f * (x2 - x1) AS fx, y1 + f * (y2 - y1) AS fy, sqrt(power(x - x1, 2) + power(y - y1, 2)) AS nd FROM near),
    both_ends AS (SELECT feature_id, sqrt(power(x - fx, 2) + power(y - fy, 2)) AS ed, fx, fy, segment_id, nd, x1, y1 FROM ranged),
    best AS (SELECT feature_id, min({'d': nd, 'x': x1, 'y': y1}) AS n, min({'d': ed, 'x': fx, 'y': fy, 's': segment_id}) AS e FROM both_ends GROUP BY feature_id),
    other_end AS (SELECT p.feature_id, min({'d': sqrt(power(p.x - x2, 2) + power(p.y - y2, 2)), 'x': x2, 'y': y2}) AS n FROM places p JOIN edges ON edges.request_id = p.request_id GROUP BY p.feature_id),
    snapped AS (SELECT p.feature_id, p.request_id, least(b.n, o.n) AS n, e FROM places p LEFT JOIN best b ON b.feature_id = p.feature_id LEFT JOIN other_end o ON o.feature_id = p.feature_id)"""


_FROM_STARTS = "SELECT request_id || ':' || CAST(x * 100 AS BIGINT) || ',' || CAST(y * 100 AS BIGINT) AS node, 0.0::DOUBLE AS t FROM starts"


def _search(name: str, where: str = "TRUE", edges: str = "edges", begin: str = _FROM_STARTS) -> str:
    return f""", {name}(node, t) USING KEY (node) AS ({begin}
      UNION SELECT e.src, min(d.t + e.t) FROM {name} d JOIN {edges} e ON e.dst = d.node LEFT JOIN recurring.{name} r ON r.node = e.src WHERE {where} AND (r.t IS NULL OR d.t + e.t < r.t - 1e-9) GROUP BY e.src)"""


_OPEN = "e.status NOT IN ('BLOCKED', 'UNKNOWN_COVERAGE')"
QUERIES = {f.__name__: f for f in (road_edges, post_event_edges, access_sources, snap_points, split_edges, shortest_access, settlement_access, connectivity_summary, route_blockers, most_affected_settlements, access_sources_by_node, places_access)}
ORACLES = {
    "road_edges": _DIRECTED + " SELECT segment_id, src, dst, status, round(m, 6) AS length_m, round(t, 6) AS time_s FROM edges",
    "post_event_edges": _DIRECTED + " SELECT segment_id, src, dst, status, round(m, 6) AS length_m, round(t, 6) AS time_s FROM edges WHERE status NOT IN ('BLOCKED', 'UNKNOWN_COVERAGE', 'POTENTIALLY_BLOCKED')",
    "access_sources": with_tables("places") + " SELECT feature_id, category, place FROM places WHERE category = 'healthcare' OR place = 'town'",
    "snap_points": _SNAPPED + """ SELECT feature_id, CASE WHEN n IS NULL OR least(n.d, e.d) > 500 THEN 'none' WHEN n.d <= e.d THEN 'node' ELSE 'edge' END AS kind,
        CASE WHEN n IS NULL OR least(n.d, e.d) > 500 THEN NULL WHEN n.d <= e.d THEN request_id || ':' || CAST(round_even(n.x * 100, 0) AS BIGINT) || ',' || CAST(round_even(n.y * 100, 0) AS BIGINT) ELSE request_id || ':' || CAST(round_even(e.x * 100, 0) AS BIGINT) || ',' || CAST(round_even(e.y * 100, 0) AS BIGINT) END AS node,
        CASE WHEN least(n.d, e.d) <= 500 THEN round(least(n.d, e.d), 6) END AS distance_m FROM snapped""",
    "split_edges": _SNAPPED + """, cuts AS (SELECT DISTINCT e.s AS segment_id, e.x AS cx, e.y AS cy FROM snapped WHERE e.d <= 500 AND n.d > e.d),
        inner_cuts AS (SELECT segment_id, src, dst, count(DISTINCT (cx, cy)) AS k FROM edges JOIN cuts USING (segment_id) GROUP BY ALL)
        SELECT segment_id, CAST(sum(1 + coalesce(k, 0)) AS BIGINT) AS parts, round(sum(m), 6) AS length_m, round(sum(t), 6) AS time_s FROM edges LEFT JOIN inner_cuts USING (segment_id, src, dst) GROUP BY segment_id""",
    "shortest_access": _DIRECTED + _search("d") + " SELECT node, round(t, 6) AS time_s FROM d",
    "settlement_access": "",
    "connectivity_summary": "",
}
_ACCESS = _DIRECTED + _search("b") + _search("a", _OPEN) + """, homes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
    judged AS (SELECT h.node, b.t AS bt, a.t AS aft, CASE WHEN b.t IS NULL THEN 'NO_BASELINE_ACCESS' WHEN a.t IS NULL THEN 'CUT_OFF' WHEN b.t > 0 AND a.t / b.t > 1.25 THEN 'DETOUR' ELSE 'CONNECTED' END AS status FROM homes h LEFT JOIN b ON b.node = h.node LEFT JOIN a ON a.node = h.node)"""
ORACLES["settlement_access"] = _ACCESS + " SELECT node AS feature_id, status, round(bt, 6) AS before_time_s, round(aft, 6) AS after_time_s FROM judged"
ORACLES["connectivity_summary"] = _ACCESS + " SELECT CAST(split_part(node, ':', 1) AS INT) AS request_id, count(*) AS settlements, count(*) FILTER (status = 'CONNECTED') AS connected, count(*) FILTER (status = 'DETOUR') AS detour, count(*) FILTER (status = 'CUT_OFF') AS cut_off, count(*) FILTER (status = 'NO_BASELINE_ACCESS') AS no_baseline_access FROM judged GROUP BY 1"

_PLACED = _SNAPPED + """, placed AS (SELECT s.feature_id, s.request_id, p.category, p.place, coalesce(e.d <= 500 AND n.d > e.d, FALSE) AS inside, e.s AS segment_id, CAST(round_even(e.x * 100, 0) AS BIGINT) AS cx, CAST(round_even(e.y * 100, 0) AS BIGINT) AS cy,
      CASE WHEN n IS NULL OR least(n.d, e.d) > 500 THEN NULL WHEN n.d <= e.d THEN s.request_id || ':' || CAST(round_even(n.x * 100, 0) AS BIGINT) || ',' || CAST(round_even(n.y * 100, 0) AS BIGINT) ELSE s.request_id || ':' || CAST(round_even(e.x * 100, 0) AS BIGINT) || ',' || CAST(round_even(e.y * 100, 0) AS BIGINT) END AS node
      FROM snapped s JOIN places p ON p.feature_id = s.feature_id),
    origins AS (SELECT * FROM placed WHERE node IS NOT NULL AND (category = 'healthcare' OR place = 'town'))"""
_SPLIT = _PLACED + """, marks AS (SELECT DISTINCT segment_id, cx, cy FROM placed WHERE inside),
    stops AS (SELECT segment_id, src, dst, status, t, 0.0::DOUBLE AS f, src AS node FROM edges UNION ALL SELECT segment_id, src, dst, status, t, 1.0, dst FROM edges
      UNION ALL SELECT * FROM (SELECT e.segment_id, src, dst, status, t, ((cx - x1 * 100) * (x2 - x1) + (cy - y1 * 100) * (y2 - y1)) / (m * m * 100) AS f, e.request_id || ':' || cx || ',' || cy FROM edges e JOIN marks k ON k.segment_id = e.segment_id) WHERE f > 0 AND f < 1),
    halves AS (SELECT node AS src, lead(node) OVER w AS dst, status, t * (lead(f) OVER w - f) AS t FROM stops WINDOW w AS (PARTITION BY segment_id, src, dst ORDER BY f)),
    split AS (SELECT * FROM halves WHERE dst IS NOT NULL), still AS (SELECT * FROM split WHERE status NOT IN ('BLOCKED', 'UNKNOWN_COVERAGE'))"""
ORACLES["access_sources_by_node"] = _PLACED + " SELECT node, arg_min(feature_id, CAST(feature_id AS BIGINT)) AS source_id FROM origins GROUP BY node"
ORACLES["places_access"] = (
    _SPLIT + _search("b", edges="split", begin="SELECT DISTINCT node, 0.0::DOUBLE AS t FROM origins") + _search("a", edges="still", begin="SELECT DISTINCT node, 0.0::DOUBLE AS t FROM origins WHERE node IN (SELECT src FROM still UNION SELECT dst FROM still)")
    + " SELECT p.feature_id, round(b.t, 4) AS before_time_s, round(a.t, 4) AS after_time_s FROM placed p LEFT JOIN b ON b.node = p.node LEFT JOIN a ON a.node = p.node WHERE category = 'settlement'"
)
