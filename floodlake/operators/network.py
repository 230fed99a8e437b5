"""Road graphs and access before and after an event, for many requests at once.

Nodes are pairs of whole centimetres, so no key is a rounded double.  The
search goes over all requests and sources together: each round follows what
improved last inside the squares of the map, keeps the least state per node,
and ends when nothing improved.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import speed_kmh
from ..policy import DEFAULT, Policy
from .exposure import SHORT, crossed_cells
from .regions import checkpointed
from .state import PartTable

CM = 100


def node(x: Column, y: Column) -> Column:
    """A node key: the point in whole centimetres, halves to even."""
    return F.struct(F.bround(x * CM).cast("long").alias("cx"), F.bround(y * CM).cast("long").alias("cy"))


def node_name(n: Column) -> Column:
    return F.concat_ws(",", n["cx"].cast("string"), n["cy"].cast("string"))


def _speeds(policy: Policy) -> Column:
    return F.create_map(*[F.lit(x) for pair in policy.speeds.items() for x in pair])


def road_edges(segments: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Directed edges of straight segments: one way or both, with length and time.

    Classes without a default speed aren't drivable.  Of equal segments from
    node to node the last by id counts.
    """
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    s = segments.withColumn("default", F.try_element_at(_speeds(policy), F.col("highway"))).where("default IS NOT NULL").withColumn("length_m", length).where("length_m > 0")
    s = s.withColumn("time_s", F.col("length_m") / (speed_kmh(F.col("maxspeed"), F.col("default")) / 3.6))
    a, b = node(F.col("x1"), F.col("y1")), node(F.col("x2"), F.col("y2"))
    way = F.lower(F.coalesce("oneway", F.lit("no")))
    forward, back = F.struct(a.alias("src"), b.alias("dst")), F.struct(b.alias("src"), a.alias("dst"))
    ways = F.when(way.isin("yes", "true", "1"), F.array(forward)).when(way == "-1", F.array(back)).otherwise(F.array(forward, back))
    kept = ["request_id", "segment_id", "parent_road_id", "status", "length_m", "time_s"]
    out = s.select(*kept, F.explode(ways).alias("w")).select(*kept, "w.src", "w.dst")
    order = Window.partitionBy("request_id", "src", "dst", "segment_id").orderBy(F.desc("length_m"), "parent_road_id")
    return out.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def post_event_edges(edges: DataFrame, strict: bool = False) -> DataFrame:
    """Edges left after the event; ``strict`` also drops potentially blocked ones.  Nodes without edges vanish with them."""
    gone = ["BLOCKED", "UNKNOWN_COVERAGE", *(["POTENTIALLY_BLOCKED"] if strict else [])]
    return edges.where(~F.col("status").isin(*gone))


def _near_cells(points: DataFrame, cells: DataFrame, size: float, inner: int, outer: int, reach: float) -> DataFrame:
    """Pairs of open ``points`` and the edges in cells from ``inner`` to ``outer`` steps away that may still be nearer than their best."""
    offset = F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in range(-outer, outer + 1) for j in range(-outer, outer + 1) if max(abs(i), abs(j)) > inner or inner == outer == 0]))
    asked = points.select("*", offset.alias("o")).withColumns({"cy": (F.floor(F.col("y") / size) + F.col("o.dy")).cast("int"), "cx": (F.floor(F.col("x") / size) + F.col("o.dx")).cast("int")}).drop("o")
    gap = lambda v, c: F.greatest(F.col(c) * size - F.col(v), F.lit(0.0), F.col(v) - (F.col(c) + 1) * size)
    asked = asked.where(F.hypot(gap("x", "cx"), gap("y", "cy")) <= F.least(F.lit(float(reach)), F.coalesce("e.d", F.lit(float(reach)))))
    return asked.join(cells, ["request_id", "cy", "cx"])


def snap_points(points: DataFrame, edges: DataFrame, policy: Policy = DEFAULT, size: float | None = None) -> DataFrame:
    """Each point's place on the graph: the nearest node, or the nearest point of an edge if that is nearer, within reach.

    Edges lie in the fine square cells (``size`` wide, a sixteenth of the reach
    unless given) that they cross.  A point asks its own cell and the eight around, then rings of cells further
    out, twice as far each time; it is done when what it has found is nearer
    than anything beyond its last ring can be, so in a dense town it meets only
    the edges around it.
    """
    reach = policy.max_snap_m
    size = size or reach / 16
    at = lambda c: F.col(c) / CM
    # Of segments on the same line the least id wins all ties below, so the others needn't meet the points.
    e = edges.groupBy("request_id", "src", "dst").agg(F.min("segment_id").alias("segment_id"))
    e = e.select("request_id", "segment_id", *[at(f"{n}.{c}").alias(f"{n}_{c[1]}") for n in ("src", "dst") for c in ("cx", "cy")])
    lines = e.withColumns({"x1": F.col("src_x"), "y1": F.col("src_y"), "x2": F.col("dst_x"), "y2": F.col("dst_y")})
    # A line on the border of two cells is found in either.
    cells = checkpointed(crossed_cells(lines, size, SHORT).select("request_id", "cy", "cx", "segment_id", "src_x", "src_y", "dst_x", "dst_y"))
    dx, dy = F.col("dst_x") - F.col("src_x"), F.col("dst_y") - F.col("src_y")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("src_x")) * dx + (F.col("y") - F.col("src_y")) * dy) / (dx * dx + dy * dy)))
    fx, fy = F.col("src_x") + t * dx, F.col("src_y") + t * dy
    edge = F.struct(F.hypot(F.col("x") - fx, F.col("y") - fy).alias("d"), fx.alias("px"), fy.alias("py"), "segment_id", "src_x", "src_y", t.alias("t"))
    ends = lambda n: F.struct(F.hypot(F.col("x") - F.col(f"{n}_x"), F.col("y") - F.col(f"{n}_y")).alias("d"), F.col(f"{n}_x").alias("px"), F.col(f"{n}_y").alias("py"))
    key = ["request_id", "feature_id"]
    place = "struct<d:double,px:double,py:double>"
    best = F.lit(None).cast("struct<d:double,px:double,py:double,segment_id:string,src_x:double,src_y:double,t:double>")
    left = points.select(*key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(None).cast(place).alias("n"), best.alias("e"))
    done, inner, outer = None, 0, 1
    while True:
        near = _near_cells(left, cells, size, inner if inner else -1, outer, reach)
        found = near.groupBy(*key).agg(F.min(F.least(ends("src"), ends("dst"))).alias("n2"), F.min(edge).alias("e2"))
        # What lies beyond the square of rings is at least as far as its nearest side.
        side = lambda v: F.least(F.col(v) - (F.floor(F.col(v) / size) - outer) * size, (F.floor(F.col(v) / size) + outer + 1) * size - F.col(v))  # noqa: E731, B023
        beyond = F.least(side("x"), side("y"))
        now = left.join(found, key, "left").withColumns({"n": F.least("n", "n2"), "e": F.least("e", "e2"), "open": (beyond <= reach) & F.coalesce(beyond <= F.col("e2.d"), F.lit(True)) & F.coalesce(beyond <= F.col("e.d"), F.lit(True))})
        now = checkpointed(now.drop("n2", "e2"))
        shut = now.where("NOT open").drop("open")
        done = shut if done is None else done.unionByName(shut)
        left = now.where("open").drop("open")
        if left.isEmpty():
            break
        inner, outer = outer, 2 * outer
    least = F.least("n.d", "e.d")
    kind = F.when(least.isNull() | (least > reach), "none").when(F.col("n.d") <= F.col("e.d"), "node").otherwise("edge")
    chosen = F.when(kind == "node", node(F.col("n.px"), F.col("n.py"))).when(kind == "edge", node(F.col("e.px"), F.col("e.py")))
    return done.select(*key, kind.alias("kind"), chosen.alias("node"), F.when(kind != "none", least).alias("distance_m"), F.when(kind == "edge", F.col("e.segment_id")).alias("segment_id"))


def split_edges(edges: DataFrame, snapped: DataFrame) -> DataFrame:
    """Edges cut where points were snapped inside them; length and time go by the share of each part."""
    cuts = snapped.where("kind = 'edge'").select("request_id", "segment_id", F.col("node").alias("cut")).distinct()
    dx, dy = F.col("dst.cx") - F.col("src.cx"), F.col("dst.cy") - F.col("src.cy")
    part = ((F.col("cut.cx") - F.col("src.cx")) * dx + (F.col("cut.cy") - F.col("src.cy")) * dy) / (dx * dx + dy * dy)
    key = ["request_id", "segment_id", "src", "dst"]
    hit = edges.join(cuts, ["request_id", "segment_id"]).withColumn("f", part).where("f > 0 AND f < 1")
    by_edge = hit.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("f", "cut"))).alias("cuts"))
    out = edges.join(by_edge, key, "left")
    stop = lambda f, n: F.struct(f.alias("f"), n.alias("cut"))
    stops = F.concat(F.array(stop(F.lit(0.0), F.col("src"))), F.coalesce("cuts", F.array().cast("array<struct<f:double,cut:struct<cx:bigint,cy:bigint>>>")), F.array(stop(F.lit(1.0), F.col("dst"))))
    out = out.withColumn("stops", stops).select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("stops") - 2), lambda i: F.struct(F.get("stops", i).alias("a"), F.get("stops", i + 1).alias("b")))).alias("piece", "s"))
    share = F.col("s.b.f") - F.col("s.a.f")
    return out.select("request_id", "segment_id", "parent_road_id", "status", (F.col("length_m") * share).alias("length_m"), (F.col("time_s") * share).alias("time_s"), F.col("s.a.cut").alias("src"), F.col("s.b.cut").alias("dst"), "piece")


#: Side of the squares of nodes that are stored together, in metres, and the number of parts that squares are dealt to.
SQUARE_M, PARTS = 5000, 64


def _part(n: str) -> Column:
    """The part of a node: nodes of one square of one request share it."""
    side = lambda c: F.floor(F.col(f"{n}.{c}") / (SQUARE_M * CM))
    return F.pmod(F.xxhash64("request_id", side("cx"), side("cy")), F.lit(PARTS)).cast("int")


#: Columns of nodes and of edges as a square's search takes them: of an edge, c is where it begins, p where it ends.
_FLAT = ["request_id", "sx", "sy", "cx", "cy", "px", "py", "t", "m", "name", "roads", "open"]


def _ranked(t: float, source: str | None, pred: tuple[int, int]) -> tuple:
    return math.floor(t * 1e6 + 0.5), source is not None, source or "", pred


def _search_square(group: pa.Table, limit: float, side: int) -> pa.Table:
    """The nodes of one square after the search inside it, and the best offers to nodes beyond (``own`` is false).

    Nodes that changed are followed, nearest first, as far as ``limit``; those further on stay open.
    """
    into: dict[tuple, list] = {}
    at: dict[tuple, tuple] = {}
    beyond: dict[tuple, tuple] = {}
    waits: set[tuple] = set()
    request, square = group["request_id"][0].as_py(), (group["sx"][0].as_py(), group["sy"][0].as_py())
    for cx, cy, px, py, t, m, name, roads, waiting in zip(*[group[c].to_pylist() for c in _FLAT[3:]], strict=True):
        if roads is None:
            into.setdefault((px, py), []).append(((cx, cy), t, m, name, (cx // side, cy // side) == square))
        else:
            at[cx, cy] = _ranked(t, name, (px, py)), t, name, (px, py), m, roads
            if waiting:
                waits.add((cx, cy))
    heap = [(at[n][0], n) for n in waits if at[n][1] < limit]
    heapq.heapify(heap)
    while heap:
        rank, n = heapq.heappop(heap)
        if n not in waits or at[n][0] != rank:
            continue
        waits.discard(n)
        _, t, source, _, m, roads = at[n]
        for begin, seconds, metres, road, own in into.get(n, ()):
            shut = roads if road is None else sorted({*roads, road})
            offer = _ranked(t + seconds, source, n), t + seconds, source, n, m + metres, shut
            known = at if own else beyond
            old = known.get(begin)
            # A route through the same next node that has changed further on takes the place of the old one.
            if old is None or offer[0] < old[0] or offer[0] == old[0] and (_mm(offer[4]), shut) != (_mm(old[4]), old[5]):
                known[begin] = offer
                if own:
                    waits.add(begin)
                    if offer[1] < limit:
                        heapq.heappush(heap, (offer[0], begin))
    rows = [(n, v, n in waits, True) for n, v in at.items()] + [(n, v, True, False) for n, v in beyond.items()]
    out = [[request] * len(rows), *[[n[i] for n, *_ in rows] for i in (0, 1)], *[[v[3][i] for _, v, *_ in rows] for i in (0, 1)]]
    out += [[v[i] for _, v, *_ in rows] for i in (1, 4, 2, 5)] + [[r[i] for r in rows] for i in (2, 3)]
    types = [group.schema.field(c).type for c in ("request_id", *_FLAT[3:])]
    return pa.table([pa.array(x, t) for x, t in zip(out, [*types, pa.bool_()], strict=True)], ["request_id", *_FLAT[3:], "own"])


def _searcher(limit: float, side: int) -> Callable[[pa.Table], pa.Table]:
    return lambda group: _search_square(group, limit, side)


def _mm(metres: float) -> int:
    return math.floor(metres * 1e3 + 0.5)


def shortest_access(edges: DataFrame, sources: DataFrame, max_rounds: int = 10_000, width_s: float | None = None) -> DataFrame:
    """(request_id, node, time_s, source_id, length_m, blockers) of each node that reaches a source ``(request_id, node, source_id)``.

    Time decides (to the microsecond), then source and next node.  Length and the
    roads on the way that the event closes are carried along, so routes aren't
    rebuilt; what changes at a node is offered again along its routes.

    The map is dealt into squares.  A round follows what changed inside each
    square to its end, over all requests and squares side by side, and offers
    what reaches the border to the squares beyond; so rounds go by squares
    passed, not by nodes.  With ``width_s``, a round goes on only to the end of
    the nearest span of so many seconds.  What is known of the nodes is stored
    in parts by squares, and a round reads and rewrites only the parts that its
    squares lie in or have edges to.
    """
    spark = edges.sparkSession
    closed = F.col("status").isin("BLOCKED", "POTENTIALLY_BLOCKED", "UNKNOWN_COVERAGE") & (F.coalesce("parent_road_id", F.lit("")) != "")
    cost = F.struct("time_s", "length_m", F.when(closed, F.col("parent_road_id")).alias("road"))
    # Of parallel edges the quickest counts.
    best = edges.groupBy("request_id", "src", "dst").agg(F.min(cost).alias("c"))
    every = list(range(PARTS))
    stored = PartTable(spark, best.schema, PARTS).rewrite(best.withColumn("part", _part("dst")), every)
    # Parts next to each other, as many as there are pairs of parts at most.
    beside: dict[int, set[int]] = {}
    for r in stored.select("part", _part("src").alias("to")).distinct().collect():
        beside.setdefault(r.part, set()).add(r.to)
    begin = F.struct(F.lit(0.0).alias("t"), "source_id", F.col("node").alias("pred"), F.lit(0.0).alias("m"), F.array().cast("array<string>").alias("roads"))
    first = sources.groupBy("request_id", "node").agg(F.min("source_id").alias("source_id")).select("request_id", "node", begin.alias("s"), F.lit(True).alias("open"))
    known = PartTable(spark, first.schema, PARTS)
    rank = lambda c: F.struct(F.floor(F.col(f"{c}.t") * 1e6 + 0.5), f"{c}.source_id", f"{c}.pred")
    waiting: dict[int, float] = {}

    def write(rows: DataFrame, parts: list[int]) -> None:
        """Rewrite some parts, and note on the way which have rows, and their nearest changed nodes."""
        noted = Observation()
        mine = lambda p: F.col("part") == p
        known.rewrite(rows.observe(noted, *[F.min(F.when(mine(p) & F.col("open"), F.col("s.t"))).alias(f"due{p}") for p in parts], *[F.bool_or(mine(p)).alias(f"some{p}") for p in parts]), parts)
        found = noted.get
        for p in parts:
            waiting.pop(p, None)
            if found[f"due{p}"] is not None:
                waiting[p] = found[f"due{p}"]
        known.keep([p for p in parts if found[f"some{p}"]], parts)

    side = SQUARE_M * CM
    square = lambda n: [F.floor(F.col(f"{n}.{c}") / side).alias(f"s{c[1]}") for c in ("cx", "cy")]
    point = lambda n, p: [F.col(f"{n}.{c}").alias(f"{p}{c[1]}") for c in ("cx", "cy")]
    none = F.lit(None)
    write(first.withColumn("part", _part("node")), every)
    for _ in range(max_rounds):
        if not waiting:
            return known.read().select("request_id", "node", F.col("s.t").alias("time_s"), F.col("s.source_id").alias("source_id"), F.col("s.m").alias("length_m"), F.col("s.roads").alias("blockers"))
        limit = (math.floor(min(waiting.values()) / width_s) + 1) * width_s if width_s else math.inf
        at = [p for p, t in waiting.items() if t < limit]
        nodes = known.read(at).select("request_id", *square("node"), *point("node", "c"), *point("s.pred", "p"), "s.t", "s.m", F.col("s.source_id").alias("name"), "s.roads", "open")
        ways = stored.where(F.col("part").isin(at)).select("request_id", *square("dst"), *point("src", "c"), *point("dst", "p"), F.col("c.time_s").alias("t"), F.col("c.length_m").alias("m"), F.col("c.road").alias("name"), none.cast("array<string>").alias("roads"), none.cast("boolean").alias("open"))
        flat = nodes.unionByName(ways)
        plain = T.StructType([*[T.StructField(f.name, f.dataType) for f in flat.schema if f.name not in ("sx", "sy")], T.StructField("own", T.BooleanType())])
        met = flat.groupBy("request_id", "sx", "sy").applyInArrow(_searcher(limit, side), plain)
        state = F.struct("t", F.col("name").alias("source_id"), F.struct(F.col("px").alias("cx"), F.col("py").alias("cy")).alias("pred"), "m", "roads")
        met = met.select("request_id", F.struct("cx", "cy").alias("node"), state.alias("s"), "open", "own")
        touched = sorted({*at, *(q for p in at for q in beside.get(p, ()))})
        rest = known.read([p for p in touched if p not in at]).select("request_id", "node", "s", "open", F.lit(True).alias("own"))
        mine, offered = F.when(F.col("own"), F.struct("s", "open")), ~F.col("own")
        both = met.unionByName(rest).groupBy("request_id", "node").agg(F.first(mine, ignorenulls=True).alias("k"), F.min_by(F.when(offered, F.col("s")), F.when(offered, rank("s"))).alias("offer"))
        both = both.select("request_id", "node", "k.s", "k.open", "offer")
        again = (rank("offer") == rank("s")) & ((F.floor(F.col("offer.m") * 1e3 + 0.5) != F.floor(F.col("s.m") * 1e3 + 0.5)) | (F.col("offer.roads") != F.col("s.roads")))
        better = F.col("offer").isNotNull() & (F.col("s").isNull() | (rank("offer") < rank("s")) | again)
        write(both.select("request_id", "node", F.when(better, F.col("offer")).otherwise(F.col("s")).alias("s"), (better | F.coalesce("open", F.lit(False))).alias("open"), _part("node").alias("part")), touched)
    raise RuntimeError(f"the search did not end in {max_rounds} rounds")


def sources_by_node(sources: DataFrame, order: str = "source_id") -> DataFrame:
    """(request_id, node, source_id): of the sources ``(request_id, node, source_id, ...)`` at a node the first by ``order``; those off the graph are left out."""
    first = F.min_by("source_id", F.struct(order, "source_id"))
    return sources.where("node IS NOT NULL").groupBy("request_id", "node").agg(first.alias("source_id"))


def access_of_places(segments: DataFrame, places: DataFrame, policy: Policy = DEFAULT, strict: bool = False) -> DataFrame:
    """Status of all ``places(request_id, feature_id, name, x, y, settlement, source)``, by routes over the roads they were snapped to.

    Places snap to the roads before the event, which are split there; booleans
    say who asks and who is a source.  A source whose roads are all closed is
    no source after the event.
    """
    edges = checkpointed(road_edges(segments, policy))
    snapped = checkpointed(snap_points(places, edges, policy))
    parts = checkpointed(split_edges(edges, snapped))
    left = post_event_edges(parts, strict)
    at = snapped.select("request_id", "feature_id", "node").join(places, ["request_id", "feature_id"])
    sources = sources_by_node(at.where("source").select("request_id", "node", F.col("feature_id").alias("source_id")))
    open_nodes = left.select("request_id", F.col("src").alias("node")).union(left.select("request_id", "dst"))
    before, after = shortest_access(parts, sources), shortest_access(left, sources.join(open_nodes, ["request_id", "node"], "left_semi"))
    return settlement_access(at.where("settlement").select("request_id", "feature_id", "name", "node"), before, after, policy=policy)


def settlement_access(settlements: DataFrame, before: DataFrame, after: DataFrame, any_source: bool = True, policy: Policy = DEFAULT) -> DataFrame:
    """Status of each settlement ``(request_id, feature_id, name, node)`` by its routes before and after."""
    way = lambda r, n: r.select("request_id", "node", F.col("time_s").alias(f"{n}_time_s"), F.col("length_m").alias(f"{n}_m"), F.col("source_id").alias(f"{n}_source"), F.col("blockers").alias(f"{n}_blockers"))
    out = settlements.join(way(before, "before"), ["request_id", "node"], "left").join(way(after, "after"), ["request_id", "node"], "left")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(1.0))
    by_length, by_time = share(F.col("after_m"), F.col("before_m")), share(F.col("after_time_s"), F.col("before_time_s"))
    detour = (by_length > policy.detour_ratio) | (by_time > policy.detour_ratio)
    none = F.col("before_time_s").isNull()
    status = F.when(none, "NO_BASELINE_ACCESS").when(F.col("after_time_s").isNull(), "CUT_OFF").when(detour, "DETOUR").otherwise("CONNECTED")
    reason = F.when(F.col("node").isNull(), f"no road node within {policy.max_snap_m:g} m").when(none & F.lit(not any_source), "no source on the network").when(none, "no route before the event")
    hit = F.col("after_time_s").isNotNull() & ~none
    return out.select(
        "request_id", "feature_id", "name", status.alias("status"), reason.alias("reason"), "before_m", "after_m", "before_time_s", "after_time_s",
        F.when(hit, by_length).alias("detour_ratio"), "before_source", "after_source", F.when(status.isin("CUT_OFF", "DETOUR"), F.col("before_blockers")).alias("blockers"),
    )


def connectivity_summary(access: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return access.groupBy("request_id").agg(F.count("*").alias("settlements"), n("CONNECTED"), n("DETOUR"), n("CUT_OFF"), n("NO_BASELINE_ACCESS"))


def most_affected(access: DataFrame, most: int = 5) -> DataFrame:
    """Per request the settlements that are cut off or have the largest detours."""
    name = F.coalesce("name", "feature_id")
    order = Window.partitionBy("request_id").orderBy(F.when(F.col("status") == "CUT_OFF", 0).otherwise(1), F.desc(F.coalesce("detour_ratio", F.lit(0.0))), name, "feature_id")
    return access.where("status IN ('CUT_OFF', 'DETOUR')").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
