"""Well-known binary in Arrow columns, decoded by numpy for all rows of a batch at once.

Every row holds a cursor over its bytes.  A turn of the loop reads, for all
rows that aren't done, the next header: of a geometry or of a ring.  How many
geometries a row still owes is one number, so collections may nest.  Turns are
as many as the row with most headers has; points are read at the end, all
together.  Points of a multipoint lie at equal distances and take one turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The geometry codes of the format.
POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)
KINDS = np.array([None, "point", "line", "polygon", "point", "line", "polygon", "collection"], dtype=object)

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_POINT_TYPE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_PART_TYPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("rings", T.ArrayType(T.ArrayType(_POINT_TYPE)))])


class _Bytes:
    """Numbers at any place of a run of bytes, in either order."""

    def __init__(self, data: np.ndarray) -> None:
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.data = padded
        self.words = np.ndarray((len(data) + 5,), "<u4", padded, strides=(1,))
        self.longs = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def uint(self, at: np.ndarray, big: np.ndarray) -> np.ndarray:
        v = self.words[at]
        return np.where(big, v.byteswap(), v).astype(np.int64)

    def double(self, at: np.ndarray, big: np.ndarray) -> np.ndarray:
        v = self.longs[at]
        return np.where(big, v.byteswap(), v).astype("<u8").view(np.float64)


def _code(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Geometry code, coordinates of a point, and whether a reference number follows, of both ways to mark height and measure."""
    flags, plain = (raw >> 29) & 7, raw & 0x1FFFFFFF
    thousand = plain // 1000
    more = np.maximum(np.array([0, 1, 1, 2])[np.minimum(thousand, 3)], (flags >> 2 & 1) + (flags >> 1 & 1))
    return np.where(thousand > 3, 0, plain % 1000), 2 + more, (flags & 1).astype(bool)


def parse(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Kinds of the geometries of a binary column, and their parts ``(kind, rings)``; null for bytes that hold none.

    Lines and points are parts of one ring.  Rings of polygons are open and
    their first one is the outer one; parts without points, or whose point has
    no numbers, are left out.  Heights and measures are skipped.
    """
    if column.type != pa.large_binary():
        column = column.cast(pa.large_binary())
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: ends[-1]] if raw is not None and n else np.zeros(0, np.uint8)
    bytes_ = _Bytes(data)
    at, end = ends[:-1].copy(), ends[1:]
    bad = np.asarray(column.is_null().to_numpy(zero_copy_only=False)).copy()
    top = np.zeros(n, np.int64)
    todo = np.ones(n, np.int64)  # geometries that a row still owes
    rings = np.zeros(n, np.int64)  # rings that its open polygon still owes
    wide, big = np.full(n, 2), np.zeros(n, bool)
    part = np.zeros(n, np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # row, part, code
    runs: list[tuple[np.ndarray, ...]] = []  # row, part, first byte, points, coordinates, order, closed
    live = np.flatnonzero(~bad)

    def keep(rows: np.ndarray, first: np.ndarray, points: np.ndarray, closed: bool) -> np.ndarray:
        """Notes runs of points that lie inside their rows; returns which do."""
        fits = points <= (end[rows] - first) // (8 * wide[rows])
        bad[rows[~fits]] = True
        rows, first, points = rows[fits], first[fits], points[fits]
        runs.append((rows, part[rows] - 1, first, points, wide[rows], big[rows], np.full(len(rows), closed)))
        at[rows] = first + points * 8 * wide[rows]
        return fits

    while len(live):
        ring = live[rings[live] > 0]
        if len(ring):
            short = at[ring] + 4 > end[ring]
            bad[ring[short]] = True
            ring = ring[~short]
            rings[ring] -= 1
            keep(ring, at[ring] + 4, bytes_.uint(at[ring], big[ring]), True)
        head = live[(rings[live] == 0) & ~np.isin(live, ring)]
        short = at[head] + 5 > end[head]
        bad[head[short]] = True
        head = head[~short]
        order = bytes_.data[at[head]]
        big[head] = order == 0
        code, dims, numbered = _code(bytes_.uint(at[head] + 1, big[head]))
        wide[head] = dims
        bad[head[(order > 1) | (code < POINT) | (code > COLLECTION)]] = True
        at[head] += 5 + 4 * numbered
        first_of_row = top[head] == 0
        top[head[first_of_row]] = code[first_of_row]
        todo[head] -= 1
        single = code <= POLYGON
        part[head[single]] += 1
        parts.append((head[single], part[head[single]] - 1, code[single]))
        sizes = np.ones(len(head), np.int64)
        counted = code != POINT
        short = counted & (at[head] + 4 > end[head])
        bad[head[short]] = True
        some = counted & ~short
        sizes[some] = bytes_.uint(at[head[some]], big[head[some]])
        at[head[some]] += 4
        straight = ((code == POINT) | (code == LINE)) & ~short
        keep(head[straight], at[head[straight]], sizes[straight], False)
        surface = (code == POLYGON) & ~short
        rings[head[surface]] = sizes[surface]
        many = (code > POLYGON) & ~short
        # Each geometry takes five bytes at least.
        over = many & (sizes > (end[head] - at[head]) // 5)
        bad[head[over]] = True
        many &= ~over
        alike = many & (code == MULTIPOINT) & (sizes > 0)
        if alike.any():
            _points_at_once(bytes_, head[alike], sizes[alike], at, end, wide, part, parts, runs, todo)
        owing = many & ~alike
        todo[head[owing]] += sizes[owing]
        live = live[~bad[live] & ((todo[live] > 0) | (rings[live] > 0))]
    return _build(bytes_, n, bad, top, parts, runs)


def _points_at_once(bytes_: _Bytes, rows: np.ndarray, sizes: np.ndarray, at: np.ndarray, end: np.ndarray, wide: np.ndarray, part: np.ndarray, parts: list, runs: list, todo: np.ndarray) -> None:
    """Takes the points of multipoints whose points all have the same short header; the others are owed one by one."""
    step = 5 + 8 * wide[rows]
    fits = sizes <= (end[rows] - at[rows]) // step
    owner = np.repeat(np.arange(len(rows))[fits], sizes[fits])
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(sizes[fits]) - sizes[fits], sizes[fits])
    place = at[rows[owner]] + nth * step[owner]
    order = bytes_.data[place]
    code, dims, numbered = _code(bytes_.uint(place + 1, order == 0))
    odd = (order > 1) | (code != POINT) | (dims != wide[rows[owner]]) | numbered
    fits[np.unique(owner[odd])] = False
    taken = fits[owner]
    owner, nth, place, order = owner[taken], nth[taken], place[taken], order[taken]
    row = rows[owner]
    parts.append((row, part[row] + nth, np.full(len(row), POINT)))
    runs.append((row, part[row] + nth, place + 5, np.ones(len(row), np.int64), wide[row], order == 0, np.zeros(len(row), bool)))
    part[rows[fits]] += sizes[fits]
    at[rows[fits]] += sizes[fits] * step[fits]
    todo[rows[~fits]] += sizes[~fits]


def _offsets(owner: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)


def _build(bytes_: _Bytes, n: int, bad: np.ndarray, top: np.ndarray, parts: list, runs: list) -> tuple[pa.Array, pa.Array]:
    """Arrow lists from the runs of points found, in the order of rows, parts and rings."""
    row, part, first, points, wide, big, closed = (np.concatenate([r[i] for r in runs]) if runs else np.zeros(0, np.int64) for i in range(7))
    p_row, p_part, p_code = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    order = np.lexsort((first, part, row))
    order = order[~bad[row[order]]]
    row, part, first, points, wide, big, closed = (v[order] for v in (row, part, first, points, wide, big.astype(bool), closed.astype(bool)))
    owner = np.repeat(np.arange(len(row)), points)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(points) - points, points)
    place = first[owner] + nth * 8 * wide[owner]
    x, y = bytes_.double(place, big[owner]), bytes_.double(place + 8, big[owner])
    # A ring that ends where it began is open without its last point; points without numbers are none.
    begin = np.cumsum(points) - points
    last = np.maximum(begin + points - 1, 0)
    again = closed & (points > 0)
    again[again] = (x[begin[again]] == x[last[again]]) & (y[begin[again]] == y[last[again]])
    kept = ~(np.isnan(x) | np.isnan(y))
    kept[last[again]] = False
    owner, x, y = owner[kept], x[kept], y[kept]
    left = np.bincount(owner, minlength=len(row))
    full = left > 0
    number = np.cumsum(full) - 1
    row, part, owner = row[full], part[full], number[owner]
    ring_ends = _offsets(owner, len(row))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
    part_of = np.cumsum(new) - 1
    part_row, part_no = row[new], part[new]
    shape = np.lexsort((p_part, p_row))
    key = lambda r, p: r * (1 << 32) + p
    code = p_code[shape][np.searchsorted(key(p_row[shape], p_part[shape]), key(part_row, part_no))].astype(np.int64) if len(part_row) else np.zeros(0, np.int64)
    rings = pa.ListArray.from_arrays(pa.array(ring_ends), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], fields=list(_POINT)))
    whole = pa.ListArray.from_arrays(pa.array(_offsets(part_of, len(part_row))), rings)
    items = pa.StructArray.from_arrays([pa.array(KINDS[code], pa.string()), whole], names=["kind", "rings"])
    none = bad | (np.bincount(part_row, minlength=n) == 0)
    ends = _offsets(part_row, n)
    out = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(none, False)), items)
    return pa.array(np.where(none, None, KINDS[top]), pa.string()), out


def decode(extract: DataFrame, column: str = "geom") -> DataFrame:
    """``extract`` with kind (point, line, polygon, collection, or null) and parts in place of its WKB column.

    ``parts`` is an array of ``(kind, rings)``, each ring an array of points:
    the rings of a polygon are open, the first one is its outer one; points and
    lines have one ring each.  Multiparts have the kind of their parts.  Null
    bytes, bytes that break off or hold no such geometry, and geometries
    without any point give nulls; what follows a whole geometry is ignored.
    """
    keep = [c for c in extract.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, parts = parse(batch.column(column))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), kind, parts], names=[*keep, "kind", "parts"])

    return extract.mapInArrow(run, T.StructType([*extract.select(*[f"`{c}`" for c in keep]).schema, T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(_PART_TYPE))]))
