"""Validity of polygons by a sweep over cells, as column work.

The edges of a shape are dealt to the cells of a grid of its own, and only
edges that share a cell are held against one another.  The cells are as fine as
the edges are short: an edge is dealt to about two of them, whatever the number
of edges.  Shapes whose edges all span much of it have n edges in about n cells,
so dealing takes at most some n ** 1.5 rows.  Whether rings lie inside others
follows from the edges to the left of a point in its row of cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edges of a shape for each cell of its grid, at most, if they were spread evenly.
EDGES_OF_A_CELL = 4
#: Cells are wider than they should be by this share of the shape, so that rounding parts no edges that meet.
MARGIN = 1e-9
#: Where on an edge it is tested for lying inside other rings; an uneven share, so as not to hit corners of regular shapes.
SPOT = 0.3819660112501051


def shape_edges(shapes: DataFrame, keys: Sequence[str], polygons: str = "polygons") -> DataFrame:
    """(keys, part, ring, n, of, x1, y1, x2, y2): the edges of ``polygons``, an array of parts, each an array of rings of points.

    The first ring of a part is its outer one.  Points that repeat the one
    before, and a last point that repeats the first, count once; rings of
    fewer than three points then have no edges.
    """
    part = shapes.select(*keys, F.posexplode(polygons).alias("part", "loops"))
    ring = part.select(*keys, "part", F.posexplode("loops").alias("ring", "points"))
    before = lambda i: F.get("points", F.when(i == 0, F.size("points") - 1).otherwise(i - 1))
    ring = ring.withColumn("points", F.filter("points", lambda p, i: p != before(i))).where("size(points) >= 3")
    after = lambda i: F.coalesce(F.get("points", i + 1), F.get("points", 0))
    edge = ring.select(*keys, "part", "ring", F.size("points").alias("of"), F.posexplode(F.transform("points", lambda p, i: F.struct(p.alias("a"), after(i).alias("b")))).alias("n", "e"))
    return edge.select(*keys, "part", "ring", "n", "of", *[F.col(f"e.{end}.{c}").cast("double").alias(f"{c}{i}") for i, end in ((1, "a"), (2, "b")) for c in "xy"])


def _gridded(shapes: DataFrame, key: str, polygons: str) -> DataFrame:
    """The edges of shapes with the corner, cell sizes and number of rings of their shape's grid.

    How fine the grid is follows from the points as they come; it decides the work, not the result.
    """
    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    rings = some(F.flatten(some(F.col(polygons))))
    flat = shapes.select(key, polygons, F.size(rings).alias("rings"), some(F.flatten(rings)).alias("flat")).where("size(flat) >= 3")
    for c in "xy":
        values = F.transform("flat", (lambda p: p["x"].cast("double")) if c == "x" else (lambda p: p["y"].cast("double")))
        flat = flat.withColumn(f"{c}v", values).withColumns({f"{c}0": F.array_min(f"{c}v"), f"{c}w": F.array_max(f"{c}v") - F.array_min(f"{c}v")})
        steps = F.zip_with(F.slice(f"{c}v", 2, F.size("flat") - 1), F.slice(f"{c}v", 1, F.size("flat") - 1), lambda p, q: F.abs(p - q))
        # How many times the edges together go from one side to the other.
        flat = flat.withColumn(f"{c}l", F.coalesce(F.try_divide(F.aggregate(steps, F.lit(0.0), lambda s, v: s + v), F.col(f"{c}w")), F.lit(0.0)))
    side = F.ceil(F.greatest(F.sqrt(F.size("flat") / EDGES_OF_A_CELL), F.size("flat") / F.greatest(F.col("xl") + F.col("yl"), F.lit(1.0))))
    # A flat shape has one row or column of cells.
    size = [F.when(F.col(f"{c}w") > 0, F.col(f"{c}w") / side).otherwise(1.0).alias(f"{c}s") for c in "xy"]
    return shape_edges(flat.select(key, polygons, "rings", "x0", "y0", *size), [key, "rings", "x0", "y0", "xs", "ys"], polygons)


def _cells(axis: str, low: Column, high: Column) -> Column:
    at = lambda v: F.floor((v - F.col(f"{axis}0")) / F.col(f"{axis}s"))
    return F.sequence(at(low - MARGIN * F.col(f"{axis}s")), at(high + MARGIN * F.col(f"{axis}s")))


def _turn(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> Column:
    """Above 0 if the way from a over b to c turns left, 0 if it goes straight."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _meetings(grid: DataFrame, key: str) -> DataFrame:
    """Keys of shapes whose edges cross, or meet where rings mustn't."""
    dealt = grid.withColumn("cx", F.explode(_cells("x", F.least("x1", "x2"), F.greatest("x1", "x2"))))
    # The stretch of the edge above its column of cells.
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(x - F.col("x1"), F.col("x2") - F.col("x1"))))
    y = lambda x: F.col("y1") + (F.col("y2") - F.col("y1")) * share(x)
    left, right = (y(F.col("x0") + (F.col("cx") + by) * F.col("xs")) for by in (-MARGIN, 1 + MARGIN))
    level = F.col("x1") == F.col("x2")
    low, high = (F.when(level, f("y1", "y2")).otherwise(f(left, right)) for f in (F.least, F.greatest))
    dealt = dealt.withColumn("cy", F.explode(_cells("y", low, high))).select(key, "cx", "cy", "part", "ring", "n", "of", "x1", "y1", "x2", "y2")
    other = dealt.select(key, "cx", "cy", *[F.col(c).alias(f"o_{c}") for c in ("part", "ring", "n", "x1", "y1", "x2", "y2")])
    both = dealt.join(other, [key, "cx", "cy"]).where(F.struct("part", "ring", "n") < F.struct("o_part", "o_ring", "o_n"))
    a, b, c, d = ((F.col(f"{p}x{i}"), F.col(f"{p}y{i}")) for p in ("", "o_") for i in (1, 2))
    t = [_turn(c, d, a), _turn(c, d, b), _turn(a, b, c), _turn(a, b, d)]
    crossing = (F.signum(t[0]) * F.signum(t[1]) < 0) & (F.signum(t[2]) * F.signum(t[3]) < 0)
    between = lambda p, q, r: (p[0] >= F.least(q[0], r[0])) & (p[0] <= F.greatest(q[0], r[0])) & (p[1] >= F.least(q[1], r[1])) & (p[1] <= F.greatest(q[1], r[1]))
    touching = ((t[0] == 0) & between(a, c, d)) | ((t[1] == 0) & between(b, c, d)) | ((t[2] == 0) & between(c, a, b)) | ((t[3] == 0) & between(d, a, b))
    straight = (t[0] == 0) & (t[1] == 0)
    common = lambda i: F.least(F.greatest(a[i], b[i]), F.greatest(c[i], d[i])) - F.greatest(F.least(a[i], b[i]), F.least(c[i], d[i]))
    along = straight & (F.greatest(common(0), common(1)) > 0) & (F.least(common(0), common(1)) >= 0)
    same = (F.col("part") == F.col("o_part")) & (F.col("ring") == F.col("o_ring"))
    beside = same & ((F.col("o_n") - F.col("n") == 1) | (F.col("o_n") - F.col("n") == F.col("of") - 1))
    return both.where(crossing | along | (touching & same & ~beside)).select(key)


def _misplaced(grid: DataFrame, key: str) -> DataFrame:
    """Keys of shapes of several rings with holes outside their part, holes in holes, or parts inside parts."""
    several = grid.where("rings > 1")
    spot = {c: F.col(f"{c}1") + SPOT * (F.col(f"{c}2") - F.col(f"{c}1")) for c in "xy"}
    points = several.select(key, "part", "ring", "n", spot["x"].alias("px"), spot["y"].alias("py"), F.floor((spot["y"] - F.col("y0")) / F.col("ys")).alias("cy"))
    walls = several.where("y1 <> y2").withColumn("cy", F.explode(_cells("y", F.least("y1", "y2"), F.greatest("y1", "y2")))).select(key, "cy", F.col("part").alias("o_part"), F.col("ring").alias("o_ring"), "x1", "y1", "x2", "y2")
    passed = points.join(walls, [key, "cy"]).where("(part <> o_part OR ring <> o_ring) AND (y1 > py) <> (y2 > py) AND x1 + (x2 - x1) * (py - y1) / (y2 - y1) < px")
    odd = passed.groupBy(key, "part", "ring", "n", "o_part", "o_ring").agg((F.count("*") % 2).alias("odd")).where("odd = 1")
    inside = odd.groupBy(key, "part", "ring", "n", "o_part").agg(F.count("*").alias("all"), F.count_if(F.col("o_ring") == 0).alias("outer"))
    nested = inside.where("part <> o_part AND ring = 0 AND all % 2 = 1").select(key)
    held = inside.where("part = o_part AND ring > 0 AND all = 1 AND outer = 1").select(key, "part", "ring", "n")
    return nested.unionAll(points.where("ring > 0").join(held, [key, "part", "ring", "n"], "left_anti").select(key))


def faults(shapes: DataFrame, key: str, polygons: str = "polygons") -> DataFrame:
    """(key, fault) of the invalid ones of ``shapes(key, polygons)``, each key once; ``crossing`` goes before ``misplaced``.

    Crossing: edges cross or run along one another, or a ring touches itself.
    Misplaced: a hole isn't inside the outer ring of its part, or is in another
    hole of it, or a part lies inside another one and in none of its holes.
    Rings may touch other rings in points.  Null and empty shapes, and rings
    without three different points, have no edges and so no faults; that rings
    which touch may cut the inside in two is not looked for.
    """
    grid = _gridded(shapes, key, polygons)
    found = _meetings(grid, key).select(key, F.lit("crossing").alias("fault")).unionAll(_misplaced(grid, key).select(key, F.lit("misplaced").alias("fault")))
    return found.groupBy(key).agg(F.min("fault").alias("fault"))
