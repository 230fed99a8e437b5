"""Connected regions of cells, their measures and outlines.

Cells are labelled inside square blocks of bounded size, each in one task.
Labels of touching cells of neighbouring blocks are then merged on a small
graph of labels, by rounds of minimum propagation with shortcuts.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import degrees as metres_to_degrees
from ..policy import DEFAULT, Policy
from .pixels import CELL, decibel_change

#: Cells of a block's side.
BLOCK = 512


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder named by spark.checkpoint.dir; a local one is made only where that is unset on one machine."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="floodlake-"))
    return df.checkpoint()


def _block_labels(group: pa.Table) -> pa.Table:
    """4-connected groups of a block's cells; a label is the smallest cell code of its group."""
    y, x = group["y"].to_numpy(), group["x"].to_numpy()
    y0, x0 = int(y.min()), int(x.min())
    label = np.full((int(y.max()) - y0 + 3, int(x.max()) - x0 + 3), np.iinfo(np.int64).max)
    at = (y - y0 + 1, x - x0 + 1)
    label[at] = group["code"].to_numpy()
    on = label < np.iinfo(np.int64).max
    while True:
        before = label
        low = label.copy()
        for axis in (0, 1):
            for way in (1, -1):
                low = np.where(on, np.minimum(low, np.roll(label, way, axis)), low)
        # Runs along rows and columns take their minimum at once, so rounds follow turns and not cells.
        for axis in (0, 1):
            for flip in (False, True):
                view = np.flip(low, axis) if flip else low
                run = np.moveaxis(view, axis, 0)
                for i in range(1, run.shape[0]):
                    run[i] = np.where(np.moveaxis(np.flip(on, axis) if flip else on, axis, 0)[i], np.minimum(run[i], run[i - 1]), run[i])
        label = np.where(on, low, label)
        if (label == before).all():
            break
    return group.append_column("label", pa.array(label[at]))


def merge_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(label, region): the smallest label that edges ``(a, b)`` reach from each."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    at = both.groupBy(F.col("a").alias("label")).agg(F.least(F.min("b"), F.first("a")).alias("region"))
    for _ in range(max_rounds):
        at = checkpointed(at)
        near = both.join(at.select(F.col("label").alias("b"), F.col("region").alias("r")), "b").groupBy(F.col("a").alias("label")).agg(F.min("r").alias("r"))
        hop = at.select(F.col("label").alias("region"), F.col("region").alias("j"))
        new = at.join(near, "label").join(hop, "region", "left").select("label", F.col("region").alias("old"), F.least("region", "r", F.coalesce("j", "region")).alias("region"))
        new = checkpointed(new)
        changed = new.where("old <> region").limit(1).count()
        at = new.select("label", "region")
        if not changed:
            return at
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def label_regions(cells: DataFrame, width: int, block: int = BLOCK, merge: bool = True) -> DataFrame:
    """``cells(grid_id, y, x, ...)`` with region: the smallest cell code ``y * width + x`` of its 4-connected group.

    With ``merge=False`` regions end at block borders.
    """
    code = (F.col("y").cast("long") * width + F.col("x")).alias("code")
    blocks = [F.floor(F.col("y") / block).cast("int").alias("by"), F.floor(F.col("x") / block).cast("int").alias("bx")]
    plain = cells.select(*CELL, code, *blocks)
    labels = plain.groupBy("grid_id", "by", "bx").applyInArrow(_block_labels, T.StructType([*plain.schema, T.StructField("label", T.LongType())]))
    if not merge:
        return cells.join(labels.select(*CELL, F.col("label").alias("region")), CELL)
    labels = checkpointed(labels)
    borders = []
    for dy, dx in ((1, 0), (0, 1)):
        rim = F.col("y") % block == block - 1 if dy else F.col("x") % block == block - 1
        a = labels.where(rim).select("grid_id", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.col("label").alias("a"))
        borders.append(a.join(labels.select(*CELL, F.col("label").alias("b")), CELL).select("grid_id", "a", "b"))
    edges = borders[0].union(borders[1]).distinct()
    # Grids are told apart by pairing each label with its grid.
    keyed = edges.select(F.struct("grid_id", "a").alias("a"), F.struct("grid_id", F.col("b").alias("a")).alias("b"))
    merged = merge_labels(keyed).select(F.col("label.grid_id").alias("grid_id"), F.col("label.a").alias("label"), F.col("region.a").alias("region"))
    out = labels.join(merged, ["grid_id", "label"], "left").select(*CELL, F.coalesce("region", "label").alias("region"))
    # Cells without more columns aren't read again.
    return out if set(cells.columns) == set(CELL) else cells.join(out, CELL)


def flood_regions(masked: DataFrame, width: int, cell_km2: float, policy: Policy = DEFAULT, block: int = BLOCK, merge: bool = True) -> DataFrame:
    """Regions of flooded cells: number, cells, area, mean and largest probability; small ones are dropped."""
    labelled = label_regions(masked.where("mask = 1 AND probability IS NOT NULL"), width, block, merge)
    out = labelled.groupBy("grid_id", "region").agg(F.count("*").alias("cells"), F.avg("probability").alias("mean_probability"), F.max("probability").alias("max_probability"))
    return out.withColumn("area_km2", F.col("cells") * cell_km2).where(F.col("area_km2") >= policy.minimum_region_km2)


def change_regions(pixels: DataFrame, width: int, cell_km2: float, policy: Policy = DEFAULT) -> DataFrame:
    """Regions outside the flood whose VV backscatter changed: mean change, score and class."""
    sound = F.col("valid") & (F.col("pre_vv") > 0) & (F.col("post_vv") > 0) & (F.col("pre_vh") > 0) & (F.col("post_vh") > 0) & (F.col("mask") == 0)
    change = F.abs(decibel_change(F.col("pre_vv"), F.col("post_vv")))
    labelled = label_regions(pixels.where(sound).withColumn("change", change).where(F.col("change") >= policy.change_threshold_db), width)
    out = labelled.groupBy("grid_id", "region").agg(F.count("*").alias("cells"), F.avg("change").alias("mean_change"))
    out = out.withColumn("area_km2", F.col("cells") * cell_km2).where(F.col("area_km2") >= policy.minimum_region_km2)
    score = F.least(F.lit(1.0), F.col("mean_change") / (2 * policy.change_threshold_db))
    return out.withColumn("score", score).withColumn("confidence", F.when(score < 0.5, "low").when(score < 0.75, "medium").otherwise("high"))


def boundary_edges(labelled: DataFrame) -> DataFrame:
    """(grid_id, region, x1, y1, x2, y2): cell sides without a cell of the region beyond, with the region on the left."""
    sides = {(-1, 0): (1, 0, 0, 0), (0, 1): (1, 1, 1, 0), (1, 0): (0, 1, 1, 1), (0, -1): (0, 0, 0, 1)}
    asked = F.explode(F.array(*[
        F.struct((F.col("y") + dy).alias("ny"), (F.col("x") + dx).alias("nx"), *[(F.col(c) + d).alias(n) for c, d, n in zip("xyxy", ends, ("x1", "y1", "x2", "y2"), strict=True)])
        for (dy, dx), ends in sides.items()
    ]))
    near = labelled.select("grid_id", "region", asked.alias("s")).select("grid_id", "region", "s.*")
    there = labelled.select("grid_id", "region", F.col("y").alias("ny"), F.col("x").alias("nx"))
    return near.join(there, ["grid_id", "region", "ny", "nx"], "left_anti").select("grid_id", "region", "x1", "y1", "x2", "y2")


def _chains(group: pa.Table) -> pa.Table:
    """Edges of a block with the chain that each is on, named by its first edge, and how far along it lies.

    A chain follows edges inside the block.  A ring that stays inside is one
    chain, which begins at its least code.
    """
    keys = np.stack([group["region"].to_numpy(), group["code"].to_numpy()], axis=1)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    n = len(order)
    _, region = np.unique(keys[order, 0], return_inverse=True)
    # Numbers in order of region and code, so the least number of a ring is its least code.
    codes, nexts = keys[order, 1], group["next"].to_numpy()[order]
    _, rank = np.unique(np.concatenate([codes, nexts]), return_inverse=True)
    label = region * (int(rank.max()) + 1) + rank[:n]
    wanted = region * (int(rank.max()) + 1) + rank[n:]
    at = np.minimum(np.searchsorted(label, wanted), n - 1)
    inside = label[at] == wanted
    before = np.full(n, -1)
    before[at[inside]] = np.flatnonzero(inside)
    # Backwards by doubling: the least edge passed and how far back the first edge, or on a closed ring the least one, lies.
    head, back, least, hop = np.where(before < 0, np.arange(n), before), (before >= 0).astype(np.int64), np.arange(n), 1
    least_back = np.zeros(n, np.int64)
    while hop <= n:
        farther = least[head] < least
        least, least_back = np.where(farther, least[head], least), np.where(farther, back + least_back[head], least_back)
        back, head = back + back[head], head[head]
        hop *= 2
    closed = before[head] >= 0
    first, steps = np.where(closed, least, head), np.where(closed, least_back, back)
    chain, along = np.empty(n, np.int64), np.empty(n, np.int64)
    chain[order], along[order] = codes[first], steps
    return group.append_column("chain", pa.array(chain)).append_column("along", pa.array(along))


def ring_corners(edges: DataFrame, max_rounds: int = 40, block: int = BLOCK) -> DataFrame:
    """(grid_id, region, ring, at, x, y): the corners of each region's rings in order, by list ranking.

    Every boundary edge points to the one that follows it.  Edges that follow
    one another inside a square of ``block`` cells make a chain, found square by
    square; a ring inside one square is a chain of its own and done.  By pointer
    doubling each other chain learns the first edge of its ring and how many
    steps ahead that is; a round joins all those chains once, so a ring of n
    chains takes about log n rounds, and no region is ever one group.  Rings are
    numbered, and begin, by their first point in the order of x, then y.
    """
    keys = ["grid_id", "region"]
    way = F.when(F.col("x2") > F.col("x1"), 0).when(F.col("y2") > F.col("y1"), 1).when(F.col("x2") < F.col("x1"), 2).otherwise(3)
    # An edge's code goes by its first point; of two edges that leave a point, by their direction.
    code = ((F.col("x1").cast("long") + (1 << 28)) * (1 << 31) + F.col("y1") + (1 << 28)) * 4 + way
    coded = edges.select(*keys, code.alias("code"), "x1", "y1", "x2", "y2")
    after = coded.select(*keys, F.col("code").alias("next"), F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x2").alias("x3"), F.col("y2").alias("y3"))
    # Where two corners touch, turn towards the cell just left, so that rings don't cross.
    turn = (F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y2")) - (F.col("y2") - F.col("y1")) * (F.col("x3") - F.col("x2"))
    ways = coded.join(after, [*keys, "x2", "y2"]).groupBy(*keys, "code").agg(F.min(F.struct(turn.alias("turn"), "next")).alias("w"), *[F.first(c).alias(c) for c in ("x1", "y1", "x2", "y2")])
    squares = [F.floor(F.col(c) / block).cast("int").alias(s) for c, s in (("y1", "by"), ("x1", "bx"))]
    # A corner is where the way turns.
    links = ways.select(*keys, "code", F.col("w.next").alias("next"), F.col("x2").alias("x"), F.col("y2").alias("y"), (F.col("w.turn") != 0).alias("corner"), *squares)
    along = T.StructType([*links.schema, T.StructField("chain", T.LongType()), T.StructField("along", T.LongType())])
    links = checkpointed(links.groupBy("grid_id", "by", "bx").applyInArrow(_chains, along))

    # Of a chain: its edges, the least code among them and how far along that is, and the chain behind it, whose first edge is ``next``.
    last = F.max_by("next", "along")
    chains = links.groupBy(*keys, F.col("chain").alias("code")).agg(last.alias("next"), F.min(F.struct("code", "along")).alias("low"), F.count("*").alias("n"))
    chains = checkpointed(chains.select(*keys, "code", "next", F.col("low.code").alias("first"), F.col("low.along").alias("steps"), "n"))
    closed = chains.where("next = code").select(*keys, "code", "first", "steps", F.col("n").alias("around"))
    # The same of 2^k chains from each on.
    rows = chains.where("next <> code")
    for _ in range(max_rounds):
        there = rows.select(*keys, F.col("code").alias("next"), F.col("next").alias("next2"), F.col("first").alias("first2"), F.col("steps").alias("steps2"), F.col("n").alias("n2"))
        nearer = F.col("first") <= F.col("first2")
        rows = rows.join(there, [*keys, "next"]).select(*keys, "code", F.col("next2").alias("next"), F.least("first", "first2").alias("first"), F.when(nearer, F.col("steps")).otherwise(F.col("n") + F.col("steps2")).alias("steps"), (F.col("n") + F.col("n2")).alias("n"), (F.col("first") == F.col("first2")).alias("same"))
        rows = checkpointed(rows)
        if rows.where("NOT same").isEmpty():
            break
        rows = rows.drop("same")
    else:
        raise RuntimeError(f"rings did not settle in {max_rounds} rounds")
    around = rows.join(chains.select(*keys, "code", F.col("n").alias("own")), [*keys, "code"]).groupBy(*keys, "first").agg(F.sum("own").alias("around"))
    crossing = rows.select(*keys, "code", "first", "steps").join(around, [*keys, "first"]).select(*keys, "code", "first", "steps", "around")
    found = closed.unionByName(crossing)
    ring = F.dense_rank().over(Window.partitionBy(*keys).orderBy("first")) - 1
    numbers = found.select(*keys, "first").distinct().withColumn("ring", ring)
    found = found.join(numbers, [*keys, "first"]).select(*keys, F.col("code").alias("chain"), "ring", F.col("steps").alias("ahead"), "around")
    # Steps from an edge on to the first one.  The corner at its end: that of the edge before the first is the ring's first point, then comes the first edge's own.
    steps = F.pmod(F.col("ahead") - F.col("along"), F.col("around"))
    at = F.when(steps == 1, F.lit(-(1 << 62))).when(steps == 0, F.lit(-(1 << 61))).otherwise(-steps)
    return links.where("corner").join(found, [*keys, "chain"]).select(*keys, "ring", at.alias("at"), "x", "y")


def region_rings(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(grid_id, region, ring, points): boundary edges chained to closed rings, corners only, the first point not repeated."""
    corners = ring_corners(edges, block=block).groupBy("grid_id", "region", "ring").agg(F.array_sort(F.collect_list(F.struct("at", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")))).alias("c"))
    return corners.select("grid_id", "region", "ring", F.transform("c", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("points"))


def outlines(rings: DataFrame, grids: DataFrame) -> DataFrame:
    """``region_rings`` with their corners' degrees: outline, an array of lon and lat.

    ``grids(grid_id, epsg, x0, y0, size)`` place each grid: its upper left
    corner in metres and its cell side.  Rings of other grids are left out.
    """
    east = lambda p: F.col("x0") + p["x"] * F.col("size")
    north = lambda p: F.col("y0") - p["y"] * F.col("size")

    def degrees(p: Column) -> Column:
        lon, lat = metres_to_degrees(east(p), north(p), F.col("epsg"))
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    return rings.join(grids, "grid_id").select(*rings.columns, F.transform("points", degrees).alias("outline"))
