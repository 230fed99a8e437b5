"""Overlay of general polygons by scan beams.

A shape is the set of its rings' edges: outer rings, holes and further parts
alike.  Edges are dealt to horizontal slabs; in a slab, the heights at which
edges begin, end or cross bound beams, and inside a beam the active edges, in
order, open and close trapezoids.  So concave, hollow, multi-part and crossing
shapes all become disjoint trapezoids, and areas and clips of trapezoids have
closed forms.  Nothing needs the edges of a whole shape in one place, only
those that meet in one slab.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .regions import checkpointed

#: Columns of a trapezoid between heights y0 and y1: left and right at the lower and the upper height.
SIDES = ["y0", "y1", "l0", "l1", "r0", "r1"]
#: Columns of an edge in a slab: its ends, and between which heights it is in the slab.
LINE = ["x1", "y1", "x2", "y2", "low", "high"]
#: Edges that a task sweeps at once (more if they are of one group), and pairs of edges that it compares at once.
EDGES, PAIRS = 50_000, 1_000_000
#: Share of a polygon's area, or part of a line's edge, up to which what lies beyond counts as none.
NONE_BEYOND = 1e-9


def ring_edges(shapes: DataFrame, keys: Sequence[str], rings: str = "rings") -> DataFrame:
    """(keys, x1, y1, x2, y2): the edges of the open rings ``array<array<struct<x, y>>>`` of each shape.

    Rings of fewer than three points, null or empty ones have no edges; a
    ring that repeats its first point at the end is the same ring.
    """
    ring = shapes.select(*keys, F.explode(rings).alias("ring")).where("size(ring) >= 3")
    edges = ring.select(*keys, F.explode(F.transform("ring", lambda p, i: F.struct(p.alias("a"), F.coalesce(F.get("ring", i + 1), F.get("ring", 0)).alias("b")))).alias("e"))
    return edges.select(*keys, F.col("e.a.x").cast("double").alias("x1"), F.col("e.a.y").cast("double").alias("y1"), F.col("e.b.x").cast("double").alias("x2"), F.col("e.b.y").cast("double").alias("y2"))


def _repeated(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 0, 3): which of them each item is of, (0, 0, 2, 2, 2), and its number there, (0, 1, 0, 1, 2)."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def _crossings(group: np.ndarray, line: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(group, y) where two edges of one group cross inside both."""
    slope = (line["x2"] - line["x1"]) / (line["y2"] - line["y1"])
    base = line["x1"] - slope * line["y1"]
    # Each edge meets those behind it in its group.
    ends = np.searchsorted(group, group, "right")
    later = ends - np.arange(len(group)) - 1
    upto = np.cumsum(later)
    groups, heights, begin = [], [], 0
    while begin < len(group):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
        i, n = _repeated(later[begin:end])
        i += begin
        j = i + 1 + n
        y = (base[j] - base[i]) / (slope[i] - slope[j])
        met = (y > np.maximum(line["low"][i], line["low"][j])) & (y < np.minimum(line["high"][i], line["high"][j]))
        groups.append(group[i[met]])
        heights.append(y[met])
        begin = end
    return np.concatenate(groups), np.concatenate(heights)


def _beams(group: np.ndarray, line: dict[str, np.ndarray], turn: np.ndarray, crossing: bool, union: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """The trapezoids of whole groups of edges, as an edge of the group of each, and ``SIDES``."""
    n = len(group)
    more = _crossings(group, line) if crossing else (group[:0], line["low"][:0])
    of, y = np.concatenate([group, group, more[0]]), np.concatenate([line["low"], line["high"], more[1]])
    order = np.lexsort((y, of))
    new = np.ones(len(of), bool)
    new[1:] = (of[order][1:] != of[order][:-1]) | (y[order][1:] != y[order][:-1])
    number = np.empty(len(of), np.int64)
    number[order] = np.cumsum(new) - 1
    stop = y[order][new]
    # An edge is active in the beams from its lower end to its upper one.
    edge, ahead = _repeated(number[n : 2 * n] - number[:n])
    beam = number[:n][edge] + ahead
    low, top = stop[beam], stop[beam + 1]
    x1, y1, x2, y2 = (line[c][edge] for c in LINE[:4])
    at = lambda y: x1 + (x2 - x1) * (y - y1) / (y2 - y1)
    a, b = at(low), at(top)
    order = np.lexsort((turn[edge], b, a, at((low + top) / 2), beam))
    edge, beam, low, top, a, b = edge[order], beam[order], low[order], top[order], a[order], b[order]
    first = np.searchsorted(beam, beam, "left")
    if union:
        wound = np.cumsum(turn[edge])
        wound -= (wound - turn[edge])[first]
        inside = wound != 0
        kept = inside != (wound - turn[edge] != 0)
        edge, beam, low, top, a, b, opens = edge[kept], beam[kept], low[kept], top[kept], a[kept], b[kept], inside[kept]
    else:
        opens = (np.arange(len(beam)) - first) % 2 == 0
    i = np.flatnonzero(opens[:-1] & (beam[1:] == beam[:-1]))
    return edge[i], [low[i], top[i], a[i], b[i], a[i + 1], b[i + 1]]


def _swept(batches: Iterator[pa.RecordBatch], by: Sequence[str], crossing: bool, union: bool) -> Iterator[pa.RecordBatch]:
    """Trapezoids of edges that come group by group; a group's last edges wait for the next batch."""
    held: list[pa.RecordBatch] = []

    def swept(t: pa.Table) -> Iterator[pa.RecordBatch]:
        line = {c: t[c].to_numpy() for c in LINE}
        with np.errstate(all="ignore"):
            edge, sides = _beams(np.cumsum(_begins(t, by)) - 1, line, t["turn"].to_numpy().astype(np.int64), crossing, union)
        out = pa.table([*[t[c].take(pa.array(edge)) for c in by], *[pa.array(s) for s in sides]], [*by, *SIDES])
        yield from out.combine_chunks().to_batches(100_000)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= EDGES:
            t = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(_begins(t, by))[-1])
            if last:
                yield from swept(t.slice(0, last).combine_chunks())
            held = t.slice(last).to_batches()
    if sum(b.num_rows for b in held):
        yield from swept(pa.Table.from_batches(held).combine_chunks())


def _begins(t: pa.Table, by: Sequence[str]) -> np.ndarray:
    """Whether a row is the first of its group."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in by:
        v = t[c].combine_chunks()
        differ = pc.fill_null(pc.not_equal(v[1:], v[:-1]), False).to_numpy(zero_copy_only=False)
        none = pc.is_null(v).to_numpy(zero_copy_only=False)
        new[1:] |= differ | (none[1:] != none[:-1])
    return new


def trapezoids(edges: DataFrame, keys: Sequence[str], height: float, *, crossing: bool = True, union: bool = False) -> DataFrame:
    """(keys, slab, y0, y1, l0, l1, r0, r1): the inside of each shape of ``edges(keys, x1, y1, x2, y2)``.

    Inside is what an odd number of edges leaves to one side; with ``union``,
    what any of several like-turned rings encloses.  Slabs are ``height`` high,
    and no trapezoid reaches over one.  ``crossing=False`` saves the search for
    crossings where edges are known to meet at their ends only.
    """
    by = [*keys, "slab"]
    up = F.col("y1") < F.col("y2")
    # Level edges bound no area between two heights.
    e = edges.where("y1 <> y2").select(
        *keys, *[F.when(up, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(f"{c}1") for c in "xy"], *[F.when(up, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(f"{c}2") for c in "xy"],
        F.when(up, 1).otherwise(-1).alias("turn"),
    )
    first = F.floor(F.col("y1") / height)
    e = e.withColumn("slab", F.explode(F.sequence(first, F.greatest(first, F.ceil(F.col("y2") / height) - 1))))
    e = e.withColumns({"low": F.greatest("y1", F.col("slab") * height), "high": F.least("y2", (F.col("slab") + 1) * height)}).where("low < high")
    e = e.where("x1 IS NOT NULL AND x2 IS NOT NULL").select(*by, *LINE, "turn")
    out = T.StructType([*[e.schema[c] for c in by], *[T.StructField(c, T.DoubleType()) for c in SIDES]])
    return e.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda batches: _swept(batches, by, crossing, union), out)


def area() -> Column:
    """Area of a trapezoid."""
    return (F.col("y1") - F.col("y0")) * (F.col("r0") - F.col("l0") + F.col("r1") - F.col("l1")) / 2


def _clamped(p: Column, q: Column, low: Column, high: Column) -> Column:
    """Mean of a value clamped to [low, high] that goes evenly from p to q."""
    clamp = lambda v: F.greatest(low, F.least(high, v))
    # The integral of the clamped value from low on.
    whole = lambda v: F.when(v < low, low * (v - low)).when(v > high, (high * high - low * low) / 2 + high * (v - high)).otherwise((v * v - low * low) / 2)
    inside = (F.least(p, q) >= low) & (F.greatest(p, q) <= high)
    return F.when(inside | (F.abs(q - p) < 1e-9), (clamp(p) + clamp(q)) / 2).otherwise((whole(q) - whole(p)) / (q - p))


def cell_areas(parts: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """(keys, cy, cx, area): how much of each shape lies in each cell; ``parts`` are trapezoids of slabs as high as a cell."""
    low, high = F.least("l0", "l1"), F.greatest("r0", "r1")
    first = F.floor(low / size).cast("int")
    cells = parts.withColumn("cx", F.explode(F.sequence(first, F.greatest(first, F.ceil(high / size).cast("int") - 1))))
    a, b = F.col("cx") * F.lit(float(size)), (F.col("cx") + 1) * F.lit(float(size))
    wide = _clamped(F.col("r0"), F.col("r1"), a, b) - _clamped(F.col("l0"), F.col("l1"), a, b)
    return cells.groupBy(*keys, F.col("slab").cast("int").alias("cy"), "cx").agg(F.sum((F.col("y1") - F.col("y0")) * wide).alias("area"))


def _common(batches: Iterator[pa.RecordBatch], own: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """What the two trapezoids of each row have in common, as trapezoids."""
    for t in batches:
        if not t.num_rows:
            continue
        v = {c: t[c].to_numpy() for c in t.schema.names if c not in own}
        low, high = np.maximum(v["a_y0"], v["b_y0"]), np.minimum(v["a_y1"], v["b_y1"])

        def at(side: str, end: str, y: np.ndarray, i: np.ndarray | slice = slice(None), v: dict[str, np.ndarray] = v) -> np.ndarray:
            p, q, y0, y1 = (v[f"{side}_{c}"][i] for c in (f"{end}0", f"{end}1", "y0", "y1"))
            return p + (q - p) * (y - y0) / (y1 - y0)

        # Between the heights where two sides meet, the same two bound what is common.
        lines = {(side, end): (at(side, end, low), at(side, end, high)) for side in "ab" for end in "lr"}
        stops = [low, high]
        with np.errstate(all="ignore"):
            for end in "lr":
                for other in "lr":
                    d0, d1 = (lines["a", end][n] - lines["b", other][n] for n in (0, 1))
                    y = low + (high - low) * (d0 / (d0 - d1))
                    stops.append(np.where((y > low) & (y < high), y, high))
        stops = np.sort(np.stack(stops, 1), 1)
        i, n = np.nonzero(stops[:, :-1] < stops[:, 1:])
        y0, y1 = stops[i, n], stops[i, n + 1]
        l0, l1 = (np.maximum(at("a", "l", y, i), at("b", "l", y, i)) for y in (y0, y1))
        r0, r1 = (np.minimum(at("a", "r", y, i), at("b", "r", y, i)) for y in (y0, y1))
        kept = l0 + l1 < r0 + r1
        found = [x[kept] for x in (y0, y1, l0, l1, np.maximum(l0, r0), np.maximum(l1, r1))]
        i = pa.array(i[kept])
        yield pa.RecordBatch.from_arrays([*[t[c].take(i) for c in own], *[pa.array(x) for x in found]], [*own, *SIDES])


def intersection(left: DataFrame, right: DataFrame, on: Sequence[str], width: float) -> DataFrame:
    """Trapezoids of what is common to shapes of both sides, with the columns of both.

    Both sides' trapezoids are of slabs equally high; those of equal ``on`` and
    slab meet in buckets ``width`` wide, a pair just in the bucket where the
    later of them begins.  They are merged: Spark takes what was dealt to
    buckets for as small as the shapes, and would broadcast it.
    """
    def dealt(parts: DataFrame, mark: str) -> DataFrame:
        first, last = F.floor(F.least("l0", "l1") / width), F.floor(F.greatest("r0", "r1") / width)
        named = parts.select(*[F.col(c).alias(c if c in (*on, "slab") or c not in SIDES else f"{mark}{c}") for c in parts.columns], first.alias(f"{mark}first"), F.explode(F.sequence(first, last)).alias("bucket"))
        return named

    both = dealt(left, "a_").join(dealt(right, "b_").hint("merge"), [*on, "slab", "bucket"]).where(F.col("bucket") == F.greatest("a_first", "b_first"))
    apart = lambda p, q: F.least(f"{p}_l0", f"{p}_l1") >= F.greatest(f"{q}_r0", f"{q}_r1")
    both = both.where((F.greatest("a_y0", "b_y0") < F.least("a_y1", "b_y1")) & ~apart("a", "b") & ~apart("b", "a"))
    sides = [f"{p}_{c}" for p in "ab" for c in SIDES]
    own = [c for c in both.columns if c not in ("a_first", "b_first", "bucket", *sides)]
    both = both.select(*own, *sides)
    out = T.StructType([*[both.schema[c] for c in own], *[T.StructField(c, T.DoubleType()) for c in SIDES]])
    return both.mapInArrow(lambda batches: _common(batches, own), out)


def outline() -> Column:
    """A trapezoid's corners, against the clock, each once."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return F.array_distinct(F.array(at("l0", "y0"), at("r0", "y0"), at("r1", "y1"), at("l1", "y1")))


def clip_lines(lines: DataFrame, parts: DataFrame, keys: Sequence[str], on: Sequence[str], height: float, width: float) -> DataFrame:
    """(keys, t0, t1): the stretches of straight ``lines(keys, x1, y1, x2, y2)`` inside the shapes of ``parts``.

    Each stretch is as long as the line stays inside, whatever number of
    trapezoids it passes.  Lines and trapezoids of equal ``on`` meet in slabs
    and buckets.
    """
    span = lambda a, b, size: F.explode(F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size)))
    dealt = lines.withColumn("slab", span("y1", "y2", height)).withColumn("bucket", span("x1", "x2", width))
    named = parts.select(*on, "slab", *[F.col(c).alias(f"b_{c}") for c in SIDES], F.explode(F.sequence(F.floor(F.least("l0", "l1") / width), F.floor(F.greatest("r0", "r1") / width))).alias("bucket"))
    # A level line on the border of two slabs asks the lower one, too.
    border = F.when((F.col("y1") == F.col("y2")) & (F.col("y1") == F.col("slab") * height), F.array(F.col("slab"), F.col("slab") - 1)).otherwise(F.array("slab"))
    both = dealt.withColumn("slab", F.explode(border)).join(named.hint("merge"), [*on, "slab", "bucket"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    b0, b1 = F.col("b_y0"), F.col("b_y1")
    # Depth inside each of the four sides is even along the line: from f0 at its begin to f1 at its end.
    low, high = F.lit(0.0), F.lit(1.0)
    depth = {"bottom": lambda x, y: y - b0, "top": lambda x, y: b1 - y}
    for end, sign in (("l", 1.0), ("r", -1.0)):
        depth[end] = lambda x, y, end=end, sign=sign: sign * ((x - F.col(f"b_{end}0")) * (b1 - b0) - (F.col(f"b_{end}1") - F.col(f"b_{end}0")) * (y - b0))
    for f in depth.values():
        f0, f1 = f(F.col("x1"), F.col("y1")), f(F.col("x1") + dx, F.col("y1") + dy)
        t = F.try_divide(f0, f0 - f1)
        low = F.greatest(low, F.when((f0 < 0) & (f1 < 0), F.lit(2.0)).when(f0 < 0, t).otherwise(F.lit(0.0)))
        high = F.least(high, F.when((f0 < 0) & (f1 < 0), F.lit(-1.0)).when(f1 < 0, t).otherwise(F.lit(1.0)))
    inside = both.select(*keys, low.alias("t0"), high.alias("t1")).where("t0 < t1").distinct()
    order = Window.partitionBy(*keys).orderBy("t0", "t1")
    reached = F.max("t1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = inside.withColumn("new", F.coalesce((F.col("t0") - reached > 1e-12).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order))
    return runs.groupBy(*keys, "run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("run")


def points_inside(points: DataFrame, parts: DataFrame, keys: Sequence[str], on: Sequence[str], height: float, width: float) -> DataFrame:
    """The ``keys`` of ``points(keys, x, y)`` inside the shapes of ``parts`` or on their border."""
    dealt = points.withColumns({"slab": F.floor(F.col("y") / height), "bucket": F.floor(F.col("x") / width)})
    # A point on the border of two slabs may touch the lower one only.
    border = F.when(F.col("y") == F.col("slab") * height, F.array(F.col("slab"), F.col("slab") - 1)).otherwise(F.array("slab"))
    named = parts.select(*on, "slab", *[F.col(c).alias(f"b_{c}") for c in SIDES], F.explode(F.sequence(F.floor(F.least("l0", "l1") / width), F.floor(F.greatest("r0", "r1") / width))).alias("bucket"))
    both = dealt.withColumn("slab", F.explode(border)).join(named.hint("merge"), [*on, "slab", "bucket"])
    at = lambda end: F.col(f"b_{end}0") + (F.col(f"b_{end}1") - F.col(f"b_{end}0")) * (F.col("y") - F.col("b_y0")) / (F.col("b_y1") - F.col("b_y0"))
    return both.where((F.col("y") >= F.col("b_y0")) & (F.col("y") <= F.col("b_y1")) & (F.col("x") >= at("l")) & (F.col("x") <= at("r"))).select(*keys).distinct()


def covered_share(shapes: DataFrame, areas: DataFrame, on: Sequence[str], keys: Sequence[str], height: float, width: float) -> DataFrame:
    """(on, keys, fraction) of each shape: the share of the area asked about that it covers, at most 1; 0 where that has no area.

    Both sides hold edges: ``shapes(on, keys, x1..y2)``, ``areas(on, x1..y2)``.
    """
    asked = trapezoids(areas, on, height)
    # Equal shapes, such as scenes of one orbit have, are cut once.
    drawn = shapes.groupBy(*on, *keys).agg(F.array_sort(F.collect_list(F.struct(*LINE[:4]))).alias("edges"))
    unlike = checkpointed(drawn.select(*on, "edges").distinct().withColumn("like", F.monotonically_increasing_id()))
    edges = unlike.select(*on, "like", F.explode("edges").alias("e")).select(*on, "like", "e.*")
    common = intersection(trapezoids(edges, [*on, "like"], height), asked, on, width).groupBy("like").agg(F.sum(area()).alias("common"))
    whole = asked.groupBy(*on).agg(F.sum(area()).alias("whole"))
    cut = unlike.join(common, "like", "left").join(whole, list(on), "left")
    rows = drawn.join(cut.drop("like"), [*on, "edges"], "left")
    share = F.when(F.col("whole") > 0, F.least(F.lit(1.0), F.coalesce("common", F.lit(0.0)) / F.col("whole"))).otherwise(F.lit(0.0))
    return rows.select(*on, *keys, share.alias("fraction"))


def buffered(areas: DataFrame, keys: Sequence[str], distance: float, height: float, quarter: int = 16) -> DataFrame:
    """Trapezoids of what lies within ``distance`` of the shapes of ``areas(keys, x1..y2)``; round corners have ``4 * quarter`` sides.

    The shape's own trapezoids and a capsule around each of its edges, as one union.
    """
    own = trapezoids(areas, keys, height)
    heading = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))

    def half(end: str, begin: float) -> Column:
        angle = lambda i: heading + F.lit(begin) + i * (math.pi / 2 / quarter)
        return F.transform(F.sequence(F.lit(0), F.lit(2 * quarter)), lambda i: F.struct((F.col(f"x{end}") + distance * F.cos(angle(i))).alias("x"), (F.col(f"y{end}") + distance * F.sin(angle(i))).alias("y")))

    capsule = areas.select(*keys, F.array(F.concat(half("2", -math.pi / 2), half("1", math.pi / 2))).alias("rings"))
    rings = own.select(*keys, F.array(outline()).alias("rings")).unionByName(capsule)
    return trapezoids(ring_edges(rings, keys), keys, height, union=True)


def clip_features(features: DataFrame, parts: DataFrame, on: Sequence[str], height: float, width: float) -> DataFrame:
    """``features(on, feature_id, kind, parts)`` with parts cut at the shapes of trapezoids ``parts``, and whether any lay beyond.

    Polygons (rings, holes among them) become trapezoids, lines their stretches
    inside, points stay or go; what lies wholly beyond has no parts left.
    """
    keys = [*on, "feature_id"]
    rows = features.select(*keys, "kind", "parts")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    shape = "array<struct<x:double,y:double>>"
    # Polygons.
    edges = ring_edges(rows.where("kind = 'polygon'"), keys, "parts")
    own = trapezoids(edges, keys, height)
    cut = intersection(own, parts, on, width)
    sizes = own.groupBy(*keys).agg(F.sum(area()).alias("whole"))
    polygons = cut.groupBy(*keys).agg(F.collect_list(outline().cast(shape)).alias("left"), F.sum(area()).alias("held")).join(sizes, keys)
    polygons = polygons.select(*keys, "left", (F.col("held") < F.col("whole") * (1 - NONE_BEYOND)).alias("beyond"))
    # Lines: edges one by one, in order.
    line = rows.where("kind = 'line'").select(*keys, F.posexplode(F.flatten(F.transform("parts", lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 2, F.lit(0))), lambda i: F.struct(F.get(p, i).alias("a"), F.get(p, i + 1).alias("b")))))).alias("at", "e")).where("e.b IS NOT NULL")
    line = line.select(*keys, "at", *[F.col(f"e.{e}.{c}").cast("double").alias(f"{c}{n}") for e, n in (("a", "1"), ("b", "2")) for c in "xy"])
    inside = clip_lines(line, parts, [*keys, "at"], on, height, width).join(line.hint("merge"), [*keys, "at"])
    move = lambda t: point(F.col("x1") + (F.col("x2") - F.col("x1")) * F.col(t), F.col("y1") + (F.col("y2") - F.col("y1")) * F.col(t))
    stretches = inside.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "t0", F.array(move("t0"), move("t1")).alias("line")))).alias("s"), F.sum(F.col("t1") - F.col("t0")).alias("held"))
    lines = stretches.join(line.groupBy(*keys).agg(F.count("*").alias("whole")), keys).select(*keys, F.transform("s", lambda s: s["line"]).cast(f"array<{shape}>").alias("left"), (F.col("held") < F.col("whole") - NONE_BEYOND).alias("beyond"))
    # Points.
    spots = rows.where("kind = 'point'").select(*keys, F.posexplode("parts").alias("at", "p")).select(*keys, "at", F.get("p", 0)["x"].cast("double").alias("x"), F.get("p", 0)["y"].cast("double").alias("y"))
    kept = points_inside(spots, parts, [*keys, "at"], on, height, width).join(spots.hint("merge"), [*keys, "at"])
    points = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.array(point(F.col("x"), F.col("y"))))).alias("left")).join(spots.groupBy(*keys).agg(F.count("*").alias("whole")), keys)
    points = points.select(*keys, F.col("left").cast(f"array<{shape}>").alias("left"), (F.size("left") < F.col("whole")).alias("beyond"))
    found = polygons.select(*keys, F.col("left").cast(f"array<{shape}>").alias("left"), "beyond").unionByName(lines).unionByName(points)
    out = features.join(found, keys, "left")
    had = F.coalesce(F.size("parts") > 0, F.lit(False))
    return out.select(*[F.coalesce("left", F.array().cast(f"array<{shape}>")).alias(c) if c == "parts" else c for c in features.columns], (had & F.coalesce("beyond", F.lit(True))).alias("clipped"))
