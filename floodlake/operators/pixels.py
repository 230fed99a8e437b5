"""Pixel tables: one row per cell (grid_id, y, x), y down and x to the right.

Cell-wise work is column arithmetic; neighbourhoods are windows along rows and
columns of the grid, so a grid of any size is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy import DEFAULT, Policy

NODATA, MASK_NODATA = -9999.0, 255
CELL = ["grid_id", "y", "x"]


def valid(*bands: Column) -> Column:
    """Whether all bands hold a value: not null, a finite number, and not nodata."""
    out = F.lit(True)
    for band in bands:
        out = out & band.isNotNull() & ~F.isnan(band) & (F.abs(band) < float("inf")) & (band != NODATA)
    return F.coalesce(out, F.lit(False))


def select_bands(catalog: DataFrame, suffixes: Sequence[str] = ("sigma0_vv", "sigma0_vh", "elevation")) -> DataFrame:
    """(grid_id, suffix, band, matches): the band of each grid whose folded name ends in the suffix; band is null unless exactly one does."""
    wanted = F.explode(F.array(*map(F.lit, suffixes)))
    named = catalog.withColumn("folded", F.replace(F.lower("name"), F.lit("-"), F.lit("_"))).select("grid_id", "band", "folded", wanted.alias("suffix"))
    hit = F.endswith("folded", F.col("suffix"))
    out = named.groupBy("grid_id", "suffix").agg(F.count_if(hit).alias("matches"), F.min(F.when(hit, F.col("band"))).alias("band"))
    return out.withColumn("band", F.when(F.col("matches") == 1, F.col("band")))


def grid_mismatch(grids: DataFrame) -> DataFrame:
    """(grid_id, role, problem): grids that differ from the first of their id, or aren't in metres."""
    fields = ["epsg", "width", "height", "x0", "y0", "dx", "dy"]
    first = F.first(F.struct(*fields)).over(Window.partitionBy("grid_id").orderBy("role"))
    x = grids.withColumn("_f", first)
    found = [F.when(~F.col(c).eqNullSafe(F.col(f"_f.{c}")), F.lit(f"differs_{c}")) for c in fields]
    metric = F.col("epsg").between(32601, 32660) | F.col("epsg").between(32701, 32760) | F.col("epsg").isin(3413, 3031)
    found.append(F.when(~metric, F.lit("not_metric")))
    return x.select("grid_id", "role", F.explode(F.filter(F.array(*found), lambda p: p.isNotNull())).alias("problem"))


def align_bands(*tables: DataFrame) -> DataFrame:
    """Cells that all tables hold, valid where all of them are."""
    out = tables[0].withColumnRenamed("valid", "_v0")
    for i, t in enumerate(tables[1:], 1):
        out = out.join(t.withColumnRenamed("valid", f"_v{i}"), CELL)
    every = F.lit(True)
    for i in range(len(tables)):
        every = every & F.col(f"_v{i}")
    return out.withColumn("valid", every).drop(*[f"_v{i}" for i in range(len(tables))])


def resample(source: DataFrame, targets: DataFrame, value: str, categorical: bool = False) -> DataFrame:
    """Values of ``source`` at target cells ``(grid_id, y, x, sy, sx)``, whose centres lie at (sy, sx) in source cells.

    Nearest for categories, else bilinear over the valid ones of four cells;
    null where none is.  Each target asks for its cells by key, so this is an
    equi-join.
    """
    if categorical:
        asked = targets.select(*CELL, F.floor(F.col("sy") + 0.5).cast("int").alias("qy"), F.floor(F.col("sx") + 0.5).cast("int").alias("qx"), F.lit(1.0).alias("w"))
    else:
        y0, x0 = F.floor("sy"), F.floor("sx")
        fy, fx = F.col("sy") - y0, F.col("sx") - x0
        corner = lambda dy, dx: F.struct((y0 + dy).cast("int").alias("qy"), (x0 + dx).cast("int").alias("qx"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w"))
        asked = targets.select(*CELL, F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).alias("c")).select(*CELL, "c.*").where("w > 0")
    cells = source.select("grid_id", F.col("y").alias("qy"), F.col("x").alias("qx"), F.col(value).alias("_v")).where(valid(F.col("_v")))
    got = asked.join(cells, ["grid_id", "qy", "qx"], "left")
    weight = F.sum(F.when(F.col("_v").isNotNull(), F.col("w")))
    return got.groupBy(*CELL).agg((F.sum(F.col("_v") * F.col("w")) / weight).alias(value))


def slope_horn(dem: DataFrame, dx: float, dy: float) -> DataFrame:
    """Rise over run by Horn's 3 x 3 weights; null where one of the nine cells is missing or invalid."""
    row = Window.partitionBy("grid_id", "y").orderBy("x")
    col = Window.partitionBy("grid_id", "x").orderBy("y")
    z = dem.where(valid(F.col("elevation"))).select(*CELL, "elevation")

    def beside(w, axis: str, value: str) -> tuple[Column, Column]:
        near = F.col(axis)
        before = F.when(F.lag(axis).over(w) == near - 1, F.lag(value).over(w))
        after = F.when(F.lead(axis).over(w) == near + 1, F.lead(value).over(w))
        return before, after

    left, right = beside(row, "x", "elevation")
    flat = z.withColumns({"_across": right - left, "_sum": left + 2 * F.col("elevation") + right})
    up, down = beside(col, "y", "_across")
    above, below = beside(col, "y", "_sum")
    slopes = flat.withColumns({"_gx": (up + 2 * F.col("_across") + down) / (8 * dx), "_gy": (below - above) / (8 * dy)})
    return slopes.select(*CELL, F.hypot("_gx", "_gy").alias("slope"))


def normalize_bands(pixels: DataFrame, bands: Sequence[str] = ("pre_vv", "pre_vh", "post_vv", "post_vh"), policy: Policy = DEFAULT) -> DataFrame:
    """Standardised inputs: backscatter clipped, invalid cells at the mean, that is 0."""
    out = {}
    for band in bands:
        at = 0 if band.endswith("vv") else 1
        clipped = F.greatest(F.lit(0.0), F.least(F.col(band), F.lit(policy.backscatter_clip)))
        out[f"{band}_n"] = F.when(F.col("valid"), (clipped - policy.input_mean[at]) / policy.input_std[at]).otherwise(F.lit(0.0))
    if "slope" in pixels.columns:
        out["slope_n"] = F.when(F.col("valid"), (F.col("slope") - policy.slope_mean) / policy.slope_std).otherwise(F.lit(0.0))
    return pixels.withColumns(out)


def decibel_change(pre: Column, post: Column) -> Column:
    return 10 * F.log10(post) - 10 * F.log10(pre)


def score_pixels(pixels: DataFrame, centre_db: float = -3.0, slope: float = 0.8) -> DataFrame:
    """Default scorer: a falling VV backscatter means water; logistic in its change in dB, null where invalid."""
    change = decibel_change(F.col("pre_vv"), F.col("post_vv"))
    usable = F.col("valid") & (F.col("pre_vv") > 0) & (F.col("post_vv") > 0)
    return pixels.withColumn("probability", F.when(usable, 1 / (1 + F.exp(slope * (change - centre_db)))))


def flood_mask(scored: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """1 where flooded, 0 where not, null where unknown."""
    return scored.withColumn("mask", F.when(F.col("probability").isNotNull(), (F.col("probability") >= policy.flood_threshold).cast("int")))


def flood_summary(masked: DataFrame, pixel_area_m2: float) -> DataFrame:
    """Per grid: cells, valid and flooded ones, their share, and the flooded area."""
    known, wet = F.count("mask"), F.count_if(F.col("mask") == 1)
    return masked.groupBy("grid_id").agg(
        F.count("*").alias("pixels"), known.alias("valid_pixels"), wet.alias("flooded_pixels"),
        (known / F.count("*")).alias("valid_fraction"), (wet * pixel_area_m2 / 1e6).alias("flooded_km2"),
    )


def export_grid(masked: DataFrame) -> DataFrame:
    """The written form: nodata values instead of nulls."""
    return masked.select(*CELL, F.coalesce("probability", F.lit(NODATA)).alias("probability"), F.coalesce("mask", F.lit(MASK_NODATA)).alias("mask"))


def write_flood_grid(masked: DataFrame, path: str) -> None:
    export_grid(masked).write.partitionBy("grid_id").parquet(path)


def tile_members(cells: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(cell, ty, tx, core): the tiles whose core or surroundings hold each cell; cores part the grid."""
    core = policy.tile_size - 2 * policy.tile_overlap
    halo = policy.tile_overlap

    def span(axis: str) -> Column:
        return F.sequence(F.greatest(F.lit(0), F.floor((F.col(axis) - halo) / core)).cast("int"), F.floor((F.col(axis) + halo) / core).cast("int"))

    out = cells.select("*", F.explode(span("y")).alias("ty")).select("*", F.explode(span("x")).alias("tx"))
    inside = (F.floor(F.col("y") / core) == F.col("ty")) & (F.floor(F.col("x") / core) == F.col("tx"))
    return out.withColumn("core", inside)
