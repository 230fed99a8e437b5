"""Exposure of features to the flood, as equi-joins on grid cells.

The flood is a set of cells, so "feature and flood" is the sum over wet cells of
"feature and cell".  A feature asks for the cells of its box by key; nothing is
compared with all of the other side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy import DEFAULT, Policy
from .overlay import area, cell_areas, trapezoids

#: Pieces of road shorter than this are not cut off (metres).
SHORT = 1e-6
# Fixed value: what a layer of impacts claims.
CLAIM = "potential exposure, not confirmed damage"
#: Columns of a feature's box.
BOX = ["xmin", "ymin", "xmax", "ymax"]
#: Sides of a quarter of the round ends of corridors.
QUARTER = 16


def _span(low: Column, high: Column, size: float) -> Column:
    """Cells that an interval of positive length meets; of an interval without length, its own."""
    first = F.floor(low / size).cast("int")
    return F.sequence(first, F.greatest(first, F.ceil(high / size).cast("int") - 1))


def _dealt(features: DataFrame) -> DataFrame:
    """Features dealt out by their keys: each makes many rows of cells, and few files hold many features."""
    return features.repartition("grid_id", "feature_id")


def touched_cells(features: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """``features`` with xmin..ymax, once for each cell (cy, cx) of the box widened by ``margin``."""
    m = F.lit(margin)
    out = features.withColumn("cy", F.explode(_span(F.col("ymin") - m, F.col("ymax") + m, size)))
    return out.withColumn("cx", F.explode(_span(F.col("xmin") - m, F.col("xmax") + m, size)))


def crossed_cells(lines: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """Straight ``lines`` x1..y2 with their box, once for each cell (cy, cx) that may lie within ``margin`` of them.

    Each row of cells asks only for the columns that the line meets there, so a
    long slanted line makes cells by its length and not by its box.
    """
    m = F.lit(margin)
    boxed = lines.withColumns({"xmin": F.least("x1", "x2"), "xmax": F.greatest("x1", "x2"), "ymin": F.least("y1", "y2"), "ymax": F.greatest("y1", "y2")})
    out = boxed.withColumn("cy", F.explode(_span(F.col("ymin") - m, F.col("ymax") + m, size)))
    d = F.col("y2") - F.col("y1")
    low, high = F.col("cy") * size - m - F.col("y1"), (F.col("cy") + 1) * size + m - F.col("y1")
    t0 = F.when(d == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(low / d, high / d)))
    t1 = F.when(d == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(low / d, high / d)))
    at = lambda t: F.col("x1") + (F.col("x2") - F.col("x1")) * t
    # One column more on both sides than computed, within the box, so that rounding loses none.
    box0 = F.floor((F.col("xmin") - m) / size).cast("int")
    box1 = F.greatest(box0, F.ceil((F.col("xmax") + m) / size).cast("int") - 1)
    first = F.floor((F.least(at(t0), at(t1)) - m) / size).cast("int") - 1
    last = F.floor((F.greatest(at(t0), at(t1)) + m) / size).cast("int") + 1
    return out.withColumn("cx", F.explode(F.sequence(F.greatest(first, box0), F.least(last, box1))))


def _wet(flood: DataFrame) -> DataFrame:
    """Keys of wet cells, to be merged with cells of features: Spark guesses those as small as the features, and would broadcast them."""
    return flood.where("mask = 1").select("grid_id", F.col("y").alias("cy"), F.col("x").alias("cx")).hint("merge")


def hazard_candidates(features: DataFrame, flood: DataFrame, size: float) -> DataFrame:
    """Features whose box meets a wet cell."""
    ids = touched_cells(_dealt(features.select("grid_id", "feature_id", *BOX)), size).select("grid_id", "feature_id", "cy", "cx").join(_wet(flood), ["grid_id", "cy", "cx"], "left_semi").select("grid_id", "feature_id").distinct()
    return features.join(ids, ["grid_id", "feature_id"], "left_semi")


def building_exposure(buildings: DataFrame, flood: DataFrame, size: float, policy: Policy = DEFAULT) -> DataFrame:
    """Footprint and flooded area of rectangular buildings, the flooded share, and whether it makes them affected."""
    # Only an area goes on with each cell.
    met = touched_cells(_dealt(buildings.select("grid_id", "feature_id", *BOX)), size)
    wide = F.least(F.col("xmax"), (F.col("cx") + 1) * size) - F.greatest(F.col("xmin"), F.col("cx") * size)
    high = F.least(F.col("ymax"), (F.col("cy") + 1) * size) - F.greatest(F.col("ymin"), F.col("cy") * size)
    met = met.select("grid_id", "feature_id", "cy", "cx", (F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))).alias("m2"))
    wet = met.join(_wet(flood), ["grid_id", "cy", "cx"]).groupBy("grid_id", "feature_id").agg(F.sum("m2").alias("overlap_m2"))
    out = buildings.join(wet, ["grid_id", "feature_id"], "left").withColumn("overlap_m2", F.coalesce("overlap_m2", F.lit(0.0)))
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    out = out.withColumn("footprint_m2", area).withColumn("fraction", F.when(area > 0, F.col("overlap_m2") / area).otherwise(F.lit(0.0)))
    return out.withColumn("affected", (F.col("overlap_m2") > 0) & (F.col("fraction") >= policy.building_fraction))


def shape_exposure(edges: DataFrame, flood: DataFrame, size: float, policy: Policy = DEFAULT) -> DataFrame:
    """``building_exposure`` of concave, hollow and many-part footprints, given as ``edges(grid_id, feature_id, x1, y1, x2, y2)`` of their rings."""
    keys = ["grid_id", "feature_id"]
    parts = trapezoids(edges, keys, size)
    wet = cell_areas(parts, keys, size).join(_wet(flood), ["grid_id", "cy", "cx"]).groupBy(*keys).agg(F.sum("area").alias("overlap_m2"))
    out = edges.select(*keys).distinct().join(parts.groupBy(*keys).agg(F.sum(area()).alias("footprint_m2")), keys, "left").join(wet, keys, "left")
    out = out.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("footprint_m2", "overlap_m2")])
    out = out.withColumn("fraction", F.when(F.col("footprint_m2") > 0, F.col("overlap_m2") / F.col("footprint_m2")).otherwise(F.lit(0.0)))
    return out.withColumn("affected", (F.col("overlap_m2") > 0) & (F.col("fraction") >= policy.building_fraction))


def building_summary(exposed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and footprint areas, of all or ``by`` columns; without those, one row of zeros for no buildings."""
    hit = F.col("affected")
    return exposed.groupBy(*by).agg(
        F.count("*").alias("total_count"), F.count_if(hit).alias("affected_count"), F.coalesce(F.sum("footprint_m2"), F.lit(0.0)).alias("total_m2"),
        F.coalesce(F.sum(F.when(hit, F.col("footprint_m2"))), F.lit(0.0)).alias("affected_m2"), F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("affected_fraction"),
    )


def _inside(size: float) -> tuple[Column, Column]:
    """The part [t0, t1] of the segment (x1, y1)-(x2, y2) that lies in cell (cy, cx); empty if t0 > t1."""
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    for a, b, c in (("x1", "x2", "cx"), ("y1", "y2", "cy")):
        d = F.col(b) - F.col(a)
        near, far = F.col(c) * size - F.col(a), (F.col(c) + 1) * size - F.col(a)
        still = d == 0
        off = still & ((near > 0) | (far < 0))
        low.append(F.when(off, F.lit(2.0)).when(still, F.lit(0.0)).otherwise(F.least(near / d, far / d)))
        high.append(F.when(off, F.lit(-1.0)).when(still, F.lit(1.0)).otherwise(F.greatest(near / d, far / d)))
    return F.greatest(*low), F.least(*high)


def road_segments(roads: DataFrame, flood: DataFrame, size: float, policy: Policy = DEFAULT) -> DataFrame:
    """Straight roads cut where they enter or leave the flood, each piece with its status.

    ``flood`` holds the known cells (mask 0 or 1); a piece that crosses an
    unknown one is UNKNOWN_COVERAGE.  Pieces are numbered from 0 along a road.
    """
    keys = ["grid_id", "feature_id"]
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    boxed = roads.withColumn("length", length)
    t0, t1 = _inside(size)
    crossed = crossed_cells(_dealt(boxed.select(*keys, "length", "x1", "y1", "x2", "y2")), size).withColumns({"t0": t0, "t1": t1}).where("t1 > t0").select(*keys, "length", "cy", "cx", "t0", "t1")
    known = flood.where("mask IS NOT NULL").select("grid_id", F.col("y").alias("cy"), F.col("x").alias("cx"), "mask")
    crossed = crossed.join(known, ["grid_id", "cy", "cx"], "left").select(*keys, "length", "t0", "t1", "mask")
    order = Window.partitionBy(*keys).orderBy("t0", "t1")
    before = F.max("t1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    wet = crossed.where("mask = 1").withColumn("new", F.coalesce(((F.col("t0") - before) * F.col("length") > SHORT).cast("int"), F.lit(1)))
    wet = wet.withColumn("island", F.sum("new").over(order)).groupBy(*keys, "island").agg(F.min("t0").alias("a"), F.max("t1").alias("b"))
    ways = wet.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("wet"))
    unknown = crossed.where("mask IS NULL").groupBy(*keys).agg(F.collect_list(F.struct(F.col("t0").alias("a"), F.col("t1").alias("b"))).alias("unknown"))
    part = "array<struct<a:double,b:double>>"
    out = boxed.where("length > 0").join(ways, keys, "left").join(unknown, keys, "left")
    out = out.withColumns({"wet": F.coalesce("wet", F.array().cast(part)), "unknown": F.coalesce("unknown", F.array().cast(part))})
    ends = F.concat(F.array(F.lit(0.0)), F.flatten(F.transform("wet", lambda w: F.array(w["a"], w["b"]))), F.array(F.lit(1.0)))
    out = out.withColumn("ends", F.array_sort(ends))
    piece = F.transform(F.sequence(F.lit(0), F.size("ends") - 2), lambda i: F.struct(F.get("ends", i).alias("a"), F.get("ends", i + 1).alias("b")))
    long = F.filter(piece, lambda p: (p["b"] - p["a"]) * F.col("length") > SHORT)
    out = out.select("*", F.posexplode(long).alias("seq", "piece"))
    shared = lambda w: F.greatest(F.lit(0.0), F.least(w["b"], F.col("piece.b")) - F.greatest(w["a"], F.col("piece.a")))
    span = F.col("piece.b") - F.col("piece.a")
    fraction = F.least(F.lit(1.0), F.aggregate("wet", F.lit(0.0), lambda s, w: s + shared(w)) / span)
    dark = F.exists("unknown", lambda w: shared(w) * F.col("length") > SHORT)
    status = F.when(dark, "UNKNOWN_COVERAGE").when(fraction >= policy.road_blocked_fraction, "BLOCKED").when(fraction >= policy.road_potential_fraction, "POTENTIALLY_BLOCKED").otherwise("OPEN")
    at = lambda c, t: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * t
    return out.select(
        "grid_id", F.concat_ws(":", "feature_id", "seq").alias("segment_id"), F.col("feature_id").alias("parent_road_id"), "seq",
        *[at(c, F.col(f"piece.{e}")).alias(f"{c}{n}") for e, n in (("a", "1"), ("b", "2")) for c in "xy"],
        "highway", "oneway", "maxspeed", is_bridge().alias("bridge"), status.alias("status"), (span * F.col("length")).alias("length_m"), fraction.alias("flood_overlap_fraction"),
    )


def is_bridge() -> Column:
    """Whether tags bridge and tunnel make a bridge; without a tunnel tag it still is."""
    return ~F.coalesce("bridge", F.lit("no")).isin("no", "false", "0") & ~F.coalesce("tunnel", F.lit("")).isin("yes", "true", "1")


def road_summary(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Kilometres by status, and the number of segments, of all or ``by`` columns."""
    km = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("length_m"))), F.lit(0.0)) / 1000
    return segments.groupBy(*by).agg(*[km(s).alias(f"{s.lower()}_km") for s in ("OPEN", "POTENTIALLY_BLOCKED", "BLOCKED", "UNKNOWN_COVERAGE")], F.count("*").alias("segments"))


def _point_to_segment(px: Column, py: Column) -> Column:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - F.col("x1")) * dx + (py - F.col("y1")) * dy) / square)))
    return F.hypot(px - F.col("x1") - t * dx, py - F.col("y1") - t * dy)


def _corridor(margin: float, quarter: int = QUARTER) -> Column:
    """The outline of a straight line x1..y2 widened by ``margin``: two half circles of ``2 * quarter`` sides each."""
    heading = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))

    def half(end: str, begin: float) -> Column:
        angle = lambda i: heading + F.lit(begin) + i * (math.pi / 2 / quarter)
        return F.transform(F.sequence(F.lit(0), F.lit(2 * quarter)), lambda i: F.struct((F.col(f"x{end}") + margin * F.cos(angle(i))).alias("x"), (F.col(f"y{end}") + margin * F.sin(angle(i))).alias("y")))

    return F.concat(half("2", -math.pi / 2), half("1", math.pi / 2))


def _area_in_cell(outline: Column, size: float) -> Column:
    """Area of an outline (points against the clock) inside cell (cy, cx): the height clamped to the cell, integrated along each side."""
    x0, y0 = F.col("cx") * size, F.col("cy") * size
    x1, y1 = x0 + size, y0 + size
    clamp = lambda v, a, b: F.greatest(a, F.least(b, v))
    whole = lambda v: F.when(v < y0, y0 * v).when(v > y1, y1 * v + (y0 * y0 - y1 * y1) / 2).otherwise((v * v + y0 * y0) / 2)

    def side(i: Column) -> Column:
        a, b = F.get(outline, i), F.get(outline, (i + 1) % F.size(outline))
        xa, xb = clamp(a["x"], x0, x1), clamp(b["x"], x0, x1)
        slope = F.when(a["x"] == b["x"], F.lit(0.0)).otherwise((b["y"] - a["y"]) / (b["x"] - a["x"]))
        ya, yb = a["y"] + slope * (xa - a["x"]), a["y"] + slope * (xb - a["x"])
        mean = F.when(F.abs(yb - ya) < 1e-6, clamp((ya + yb) / 2, y0, y1)).otherwise((whole(yb) - whole(ya)) / (yb - ya))
        return F.when(xa == xb, F.lit(0.0)).otherwise((xa - xb) * (mean - y0))

    return F.aggregate(F.sequence(F.lit(0), F.size(outline) - 1), F.lit(0.0), lambda s, i: s + side(i))


def bridge_exposure(bridges: DataFrame, flood: DataFrame, size: float, policy: Policy = DEFAULT) -> DataFrame:
    """Straight bridges with the distance to the nearest wet cell in reach, and what share of their corridor is wet.

    AFFECTED if a wet cell lies within the corridor and, unless any contact
    blocks, the share reaches ``bridge_overlap_fraction``.
    """
    keys = ["grid_id", "feature_id"]
    hit = crossed_cells(_dealt(bridges.select(*keys, "x1", "y1", "x2", "y2")), size, policy.bridge_buffer_m).join(_wet(flood), ["grid_id", "cy", "cx"])
    t0, t1 = _inside(size)
    corners = [_point_to_segment((F.col("cx") + i) * size, (F.col("cy") + j) * size) for i in (0, 1) for j in (0, 1)]
    to_cell = lambda x, y: F.hypot(F.greatest(F.col("cx") * size - x, F.lit(0.0), x - (F.col("cx") + 1) * size), F.greatest(F.col("cy") * size - y, F.lit(0.0), y - (F.col("cy") + 1) * size))
    apart = F.when(t1 >= t0, F.lit(0.0)).otherwise(F.least(*corners, to_cell(F.col("x1"), F.col("y1")), to_cell(F.col("x2"), F.col("y2"))))
    near = hit.withColumn("apart", apart).withColumn("_outline", F.when(F.col("apart") < policy.bridge_buffer_m, _corridor(policy.bridge_buffer_m)))
    wet = F.when(F.col("_outline").isNotNull(), F.greatest(F.lit(0.0), _area_in_cell(F.col("_outline"), size)))
    near = near.groupBy(*keys).agg(F.min("apart").alias("distance_m"), F.sum(wet).alias("overlap_m2"))
    round_ends = 2 * QUARTER * math.sin(math.pi / 2 / QUARTER) * policy.bridge_buffer_m**2
    corridor = 2 * policy.bridge_buffer_m * F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) + round_ends
    out = bridges.join(near, keys, "left").withColumn("overlap_m2", F.coalesce("overlap_m2", F.lit(0.0)))
    out = out.withColumn("overlap_fraction", F.when(corridor > 0, F.col("overlap_m2") / corridor).otherwise(F.lit(0.0)))
    hit_at_all = F.coalesce(F.col("distance_m") < policy.bridge_buffer_m, F.lit(False))
    enough = F.lit(policy.bridge_block_on_contact) | (F.col("overlap_fraction") >= policy.bridge_overlap_fraction)
    return out.withColumn("status", F.when(hit_at_all & enough, "AFFECTED").otherwise("NOT_AFFECTED"))


def bridge_summary(exposed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bridges and affected ones, of all or ``by`` columns."""
    return exposed.groupBy(*by).agg(F.count("*").alias("bridges"), F.count_if(F.col("status") == "AFFECTED").alias("affected"))


def rasterize(edges: DataFrame, size: float) -> DataFrame:
    """(feature_id, cy, cx): cells whose centre lies inside the polygon of ``edges(feature_id, x1, y1, x2, y2)``; holes are edges like others.

    Each edge of the closed rings gives one crossing for every row of centres it
    meets; crossings of a row, in order, open and close runs of cells.
    """
    py = (F.col("cy") + 0.5) * size
    rows = F.sequence(F.floor(F.least("y1", "y2") / size).cast("int") - 1, F.ceil(F.greatest("y1", "y2") / size).cast("int"))
    met = edges.withColumn("cy", F.explode(rows)).where((F.col("y1") > py) != (F.col("y2") > py))
    crossing = (F.col("x2") - F.col("x1")) * (py - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    order = Window.partitionBy("feature_id", "cy").orderBy("begin")
    runs = met.select("feature_id", "cy", crossing.alias("begin")).withColumns({"end": F.lead("begin").over(order), "n": F.row_number().over(order)}).where("n % 2 = 1")
    px = lambda c: (c + 0.5) * size
    cells = F.filter(F.sequence(F.floor(F.col("begin") / size).cast("int") - 1, F.ceil(F.col("end") / size).cast("int")), lambda c: (px(c) >= F.col("begin")) & (px(c) < F.col("end")))
    return runs.select("feature_id", "cy", F.explode(cells).alias("cx"))


def impact_features(buildings: DataFrame, bridges: DataFrame) -> DataFrame:
    """Exposed buildings and bridges as features of one layer: shape, class, share under water, and what the layer claims."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    box = F.array(point("xmin", "ymin"), point("xmax", "ymin"), point("xmax", "ymax"), point("xmin", "ymax"))
    built = buildings.select("grid_id", "feature_id", F.lit("building").alias("kind"), box.alias("points"), F.when(F.col("affected"), "AFFECTED").otherwise("NOT_AFFECTED").alias("classification"), F.col("fraction").alias("overlap_fraction"))
    crossing = bridges.select("grid_id", "feature_id", F.lit("bridge").alias("kind"), F.array(point("x1", "y1"), point("x2", "y2")).alias("points"), F.col("status").alias("classification"), "overlap_fraction")
    return built.unionByName(crossing).withColumn("claim_level", F.lit(CLAIM))
