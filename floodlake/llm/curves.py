"""Approximate nearest neighbours along shifted space-filling curves.

Unit vectors are projected to a few dimensions, once for each of several
orderings (other directions, other shifts), and each projection is put in the
order of a Hilbert curve.  Every ordering is cut into ranges of keys with about
equally many vectors; a query visits its own range and the ones next to it, in
every ordering, and the candidates of all orderings are merged and ranked by
their exact cosine.

Equal vectors are one point with its smallest ids, so copies cost nothing.
Ranges are fitted on at most ``SAMPLE`` vectors; all vectors are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import stored

#: Dimensions of a projection, and bits of each.
DIMENSIONS, BITS = 6, 8
ORDERINGS = 16
#: Vectors that a range holds at least, and ranges of an ordering at most.
RANGE, RANGES = 64, 48
#: Ranges visited on each side of a query's own.
BESIDE = 1
#: Vectors (about) that projections and ranges are fitted on.
SAMPLE = 10_000
#: Vectors in one task's block of a range.
BLOCK = 4096


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of integer points, row by row, below 2 ** (bits * dimensions).

    Public method (Skilling, 2004): undo the excess work of the Gray code from
    the highest bit down, encode, and interleave the bits.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def directions(dim: int, ordering: int) -> np.ndarray:
    """Orthogonal projection directions of one ordering, the same wherever they are made."""
    made = np.random.default_rng([dim, ordering]).standard_normal((dim, min(DIMENSIONS, dim)))
    return np.linalg.qr(made)[0]


class Index:
    """Grid lines and range ends of every ordering, fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, ranges: int, orderings: int = ORDERINGS) -> None:
        self.dim = sample.shape[1]
        self.ranges = ranges
        self.grid: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        cells = 1 << BITS
        for o in range(orderings):
            shift = (o / orderings) / cells  # the curves are shifted against one another by parts of a cell
            lines = np.quantile(sample @ directions(self.dim, o), np.clip(np.arange(1, cells) / cells - shift, 0, 1), axis=0)
            self.grid.append(lines)
            keys = self.keys(sample, o)
            self.ends.append(np.quantile(keys, np.arange(1, ranges) / ranges).astype(np.int64))

    def keys(self, unit: np.ndarray, ordering: int) -> np.ndarray:
        p = unit @ directions(self.dim, ordering)
        cell = np.column_stack([np.searchsorted(self.grid[ordering][:, j], p[:, j]) for j in range(p.shape[1])])
        return hilbert(cell, BITS)

    def place(self, unit: np.ndarray) -> np.ndarray:
        """The range of each vector in each ordering."""
        return np.column_stack([np.searchsorted(self.ends[o], self.keys(unit, o), side="right") for o in range(len(self.ends))])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or zero, and all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def nearest(vectors: DataFrame, asked: Column, k: int = 5, orderings: int = ORDERINGS, beside: int = BESIDE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row of ``vectors(vec_id, embedding)`` where ``asked``.

    Nearest first, ties to the smaller vec_id; a row is not its own neighbour.
    Rows with a null id, or whose vector is not ``usable``, take no part.  Only
    vectors of the same length are compared.  Rows that repeat wholly count
    once.  Fewer candidates give fewer rows; an empty table gives none.
    Columns besides vec_id and embedding are ignored.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.xxhash64("embedding").alias("point"), F.coalesce(asked, F.lit(False)).alias("asked"))
    points = stored(rows.groupBy("point").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.bool_or("asked").alias("asked")))
    rows = rows.select("vec_id", "point", "asked").distinct()
    order = Window.partitionBy("point").orderBy("vec_id")
    # The k + 1 smallest ids stand for a point; Spark takes them from each task before it shuffles.
    ids = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("point").agg(F.collect_list("vec_id").alias("ids"))
    found = None
    for r in points.groupBy(F.size("embedding").alias("dim")).count().orderBy("dim").collect():
        part = _search(points.where(F.size("embedding") == r.dim), r.dim, r["count"], k, orderings, beside)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    once = found.groupBy("query", "point", "least").agg(F.max("score").alias("score"))
    best = once.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least"))).where(F.col("n") <= k + 1)
    listed = best.join(ids, "point").select("query", "score", F.explode("ids").alias("vec_id"))
    queries = rows.where("asked").select(F.col("vec_id").alias("query_id"), F.col("point").alias("query"))
    pairs = queries.join(listed, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _search(points: DataFrame, dim: int, n: int, k: int, orderings: int, beside: int) -> DataFrame:
    """(query, point, least, score): the k + 1 best of each visited block."""
    ranges = int(np.clip(n // RANGE, 1, RANGES))
    part = F.pmod(F.xxhash64("point"), F.lit(1 << 30)) / float(1 << 30)
    sample = _matrix(points.where(part < SAMPLE / n).select("embedding").toArrow()["embedding"], dim)
    if not len(sample):
        sample = _matrix(points.limit(SAMPLE).select("embedding").toArrow()["embedding"], dim)
    shared = points.sparkSession.sparkContext.broadcast(Index(_unit(sample), ranges, orderings))
    # Ranges grow with the table; tasks don't: a range is split into blocks of vectors and blocks of queries.
    blocks = max(1, -(-n // (ranges * BLOCK)))
    turns = max(1, blocks // 8)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if not len(batch):
                continue
            own = index.place(_unit(_matrix(batch.column("embedding"), dim)))
            code = batch.column("point").to_numpy().view(np.uint64)
            block = ((code >> np.uint64(8)) % np.uint64(blocks)).astype(np.int64)
            turn = ((code >> np.uint64(24)) % np.uint64(turns)).astype(np.int64)
            asks = np.flatnonzero(batch.column("asked").to_numpy(zero_copy_only=False))
            for o in range(own.shape[1]):
                for t in range(turns):
                    yield _placed(batch, np.arange(len(batch)), o, own[:, o], block, np.full(len(batch), t), False)
                for side in range(-beside, beside + 1):
                    near = own[asks, o] + side
                    ok = (near >= 0) & (near < ranges)
                    for b in range(blocks):
                        yield _placed(batch, asks[ok], o, near[ok], np.full(ok.sum(), b), turn[asks[ok]], True)

    placed = points.mapInArrow(place, "ordering int, range int, block int, turn int, query boolean, point long, least long, embedding array<float>")

    def scan(group: pa.Table) -> pa.Table:
        is_query = group["query"].to_numpy()
        point, least = group["point"].to_numpy(), group["least"].to_numpy()
        x = _matrix(group["embedding"], dim)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        q, c = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        c = c[np.argsort(least[c], kind="stable")]
        out = []
        for at in range(0, len(q) if len(c) else 0, 512):
            mine = q[at : at + 512]
            score = (x[mine] @ x[c].T) / (norm[mine][:, None] * norm[c][None, :])
            top = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
            out.append((np.repeat(point[mine], top.shape[1]), point[c][top].ravel(), least[c][top].ravel(), np.take_along_axis(score, top, 1).ravel()))
        names = ["query", "point", "least", "score"]
        if not out:
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names})
        return pa.table([pa.array(np.concatenate(v)) for v in zip(*out, strict=True)], names=names)

    return placed.groupBy("ordering", "range", "block", "turn").applyInArrow(scan, "query long, point long, least long, score double")


def _placed(batch: pa.RecordBatch, rows: np.ndarray, ordering: int, where: np.ndarray, block: np.ndarray, turn: np.ndarray, query: bool) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, ordering, np.int32)), *(pa.array(v.astype(np.int32)) for v in (where, block, turn)), pa.array(np.full(n, query)), *(batch.column(c).take(pa.array(rows)) for c in ("point", "least", "embedding"))],
        names=["ordering", "range", "block", "turn", "query", "point", "least", "embedding"],
    )
