"""Scoring of tiles by a user's model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..policy import DEFAULT, Policy
from .pixels import tile_members

#: Takes two stacks (VV, VH, slope) of the tile's size, before and after, and returns probabilities of that size.
Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]
_INPUTS = ["pre_vv_n", "pre_vh_n", "post_vv_n", "post_vh_n", "slope_n"]


def score_tiles(pixels: DataFrame, scorer: Scorer, policy: Policy = DEFAULT) -> DataFrame:
    """(grid_id, y, x, probability) of all cells; null where not valid.

    A task holds one tile of fixed size at a time.  Cells outside the grid and
    invalid cells are 0, the mean.  A result of another size or outside [0, 1]
    is an error.  Only a tile's core is kept.
    """
    size, halo = policy.tile_size, policy.tile_overlap
    core = size - 2 * halo

    def run(group: pa.Table) -> pa.Table:
        ty, tx = group["ty"][0].as_py(), group["tx"][0].as_py()
        y, x = group["y"].to_numpy(), group["x"].to_numpy()
        stack = np.zeros((5, size, size), dtype=np.float32)
        for i, name in enumerate(_INPUTS):
            stack[i, y - ty * core + halo, x - tx * core + halo] = group[name].to_numpy()
        out = np.asarray(scorer(stack[[0, 1, 4]], stack[[2, 3, 4]]))
        if out.shape != (size, size):
            raise ValueError(f"the scorer returned {out.shape}, not {(size, size)}")
        if not (np.isfinite(out).all() and out.min() >= 0 and out.max() <= 1):
            raise ValueError("the scorer returned values outside [0, 1]")
        kept = group.filter(group["core"])
        p = out[kept["y"].to_numpy() - ty * core + halo, kept["x"].to_numpy() - tx * core + halo].astype(np.float64)
        return pa.table({"grid_id": kept["grid_id"], "y": kept["y"], "x": kept["x"], "probability": pa.array(p, mask=~kept["valid"].to_numpy())})

    members = tile_members(pixels.select("grid_id", "y", "x", "valid", *_INPUTS), policy)
    return members.groupBy("grid_id", "ty", "tx").applyInArrow(run, pixels.select("grid_id", "y", "x").schema.add("probability", "double"))
