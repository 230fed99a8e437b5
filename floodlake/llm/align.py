"""Alignment of two tokenizers over the same bytes, by divide and conquer at shared cuts.

A cut is shared where tokens of both sides end.  ``shared_cuts`` takes a
document as one interval of tokens, probes token ends from the middle outward,
bisects the other side for each, splits the interval at the shared end nearest
to the middle, and goes on with both halves.  An interval without a shared end
inside is a leaf: one group.  All intervals of many documents are probed side
by side in numpy.

Corpus-wide, an id pair counts the documents that hold it linked.  Counts are
shipped to the tasks in shards of bounded size, one pass over the kept links
each, so their number is not limited.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import parts
from .frames import stored
from .subwords import byte_encoder, byte_tokens, piece_encoder, piece_tokens, pieces, spread

#: Pairs whose counts one pass ships to the tasks at most, with 9 bytes each.
PAIRS = 2_000_000
#: A pair of ids is (id of A << this) + id of B.
SHIFT = 32


def shared_cuts(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the A tokens, and of the B tokens, that end at a shared cut, both ascending.

    ``a`` and ``b`` are the ends of all tokens, ascending over all documents;
    document i has tokens first_a[i] to before first_a[i + 1], likewise in B,
    and its last tokens end together.
    """
    some = np.flatnonzero(first_a[1:] > first_a[:-1])
    low_a, high_a, low_b, high_b = first_a[some], first_a[some + 1], first_b[some], first_b[some + 1]
    cuts_a, cuts_b = [high_a - 1], [high_b - 1]
    width = np.zeros(len(some), np.int64)
    while len(low_a):
        # Only an interval with two tokens on either side can have a cut inside.
        inside = (high_a - low_a > 1) & (high_b - low_b > 1)
        low_a, high_a, low_b, high_b, width = (x[inside] for x in (low_a, high_a, low_b, high_b, width))
        if not len(low_a):
            break
        middle = (low_a + high_a - 2) >> 1
        left, right = np.maximum(middle - width, low_a), np.minimum(middle + width + 1, high_a - 1)
        size = right - left
        probe = spread(left, size)
        owner = np.repeat(np.arange(len(size)), size)
        # The ends ascend over all documents, so this bisects each interval's own stretch of B.
        found = np.searchsorted(b, a[probe])
        far = np.where(b[found] == a[probe], 2 * np.abs(probe - middle[owner]) + (probe > middle[owner]), np.iinfo(np.int64).max)
        begin = np.cumsum(size) - size
        best = np.minimum.reduceat(far, begin)
        hit = best < np.iinfo(np.int64).max
        step = best[hit]
        cut_a = middle[hit] + np.where(step & 1, step >> 1, -(step >> 1))
        cut_b = found[begin[hit] + cut_a - left[hit]]
        cuts_a.append(cut_a)
        cuts_b.append(cut_b)
        # Without a hit the search goes on outward until the interval is spent; then it is a leaf.
        more = ~hit & ((left > low_a) | (right < high_a - 1))
        wider = 4 * width[more] + 2
        fresh = np.zeros(len(cut_a), np.int64)
        low_a, high_a, low_b, high_b, width = (
            np.concatenate(x)
            for x in (
                (low_a[hit], cut_a + 1, low_a[more]), (cut_a + 1, high_a[hit], high_a[more]),
                (low_b[hit], cut_b + 1, low_b[more]), (cut_b + 1, high_b[hit], high_b[more]),
                (fresh, fresh, wider),
            )
        )
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


class _Side:
    """The bytes of one tokenizer's ids."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spread(self.start[ids], self.size[ids])]


@dataclass
class Aligned:
    """Some documents' tokens, groups and links; ``first_*`` part them by document."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    cuts_a: np.ndarray
    cuts_b: np.ndarray
    first_cut: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    link_doc: np.ndarray

    def spelled(self) -> list[bytes]:
        """Each document's groups, ``a1,a2|b1;a3|b2,b3``."""
        # A group's B tokens stand behind its A tokens: each token moves on by what the other side has before it.
        group_a = np.concatenate([[0], self.cuts_a + 1])
        group_b = np.concatenate([[0], self.cuts_b + 1])
        place_a = np.arange(len(self.a)) + np.repeat(group_b[:-1], np.diff(group_a))
        place_b = np.arange(len(self.b)) + np.repeat(group_a[1:], np.diff(group_b))
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        ids[place_a], ids[place_b] = self.a, self.b
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[place_a[self.cuts_a]], mark[place_b[self.cuts_b]] = ord("|"), ord(";")
        digits, size = _decimals(ids, mark)
        ends = np.concatenate([[0], np.cumsum(size)])[self.first_a + self.first_b]
        raw = digits.tobytes()
        return [raw[x : max(x, y - 1)] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _decimals(ids: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of at most six digits in decimal, each followed by its mark, and how long each is."""
    table = np.zeros((len(ids), 7), np.uint8)
    rest = ids.astype(np.int32)
    for i in range(5, -1, -1):
        table[:, i] = rest % 10 + 48
        rest //= 10
    table[:, 6] = mark
    size = 2 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 6))
    return table[np.arange(7) >= (7 - size)[:, None]], size


class Aligner:
    """Tokenises and aligns slices of texts; each text comes with the space in front."""

    def __init__(self, path_a: str | None = None, path_b: str | None = None) -> None:
        self.encode_a, self.encode_b = byte_encoder(path_a, plain=True), piece_encoder(path_b)
        self.side_a, self.side_b = _Side(byte_tokens(path_a)), _Side(piece_tokens(path_b))

    def align(self, row: int, data: np.ndarray, text: np.ndarray) -> Aligned:
        words = pieces(row, data, text)
        a, n_a = self.encode_a.encode(words)
        b, n_b = self.encode_b.encode(words)
        right = _same(self.side_a, a, n_a, data, text) & _same(self.side_b, b, n_b, data, text)
        a, b = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)]
        n_a, n_b = np.where(right, n_a, 0), np.where(right, n_b, 0)
        first_a, first_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        end_a, end_b = np.cumsum(self.side_a.size[a]), np.cumsum(self.side_b.size[b])
        cuts_a, cuts_b = shared_cuts(end_a, end_b, first_a, first_b)
        # Two tokens overlap in one stretch, which ends where one of them ends; shared ends count once.
        alone = np.ones(len(a), bool)
        alone[cuts_a] = False
        alone = np.flatnonzero(alone)
        link_a = np.concatenate([np.searchsorted(end_a, end_b), alone])
        link_b = np.concatenate([np.arange(len(b)), np.searchsorted(end_b, end_a[alone])])
        doc = np.repeat(np.arange(len(n_b)), n_b)[link_b]
        return Aligned(a, b, first_a, first_b, cuts_a, cuts_b, np.searchsorted(cuts_a, first_a), link_a, link_b, doc)


@lru_cache(maxsize=1)
def _aligner(path_a: str | None, path_b: str | None) -> Aligner:
    """One for all tasks of a worker."""
    return Aligner(path_a, path_b)


def _same(side: _Side, ids: np.ndarray, n: np.ndarray, data: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For which texts the joined bytes of the tokens are the text's own."""
    size = side.size[ids]
    have = np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])])
    right = have == np.diff(text)
    if right.all():
        differ = np.flatnonzero(side.joined(ids) != data)
        right[np.searchsorted(text, differ, side="right") - 1] = False
        return right & (n > 0)
    own = np.repeat(right, n)
    kept = np.repeat(right, np.diff(text))
    at = np.flatnonzero(kept)
    differ = at[side.joined(ids[own]) != data[at]]
    right[np.searchsorted(text, differ, side="right") - 1] = False
    return right & (n > 0)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, *, digests: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, groups, pairs and times.

    ``groups`` spells the ids of each group in order, ``a1,a2|b1;a3|b2,b3``; with
    ``digests`` there is ``groups_sha256`` instead.  ``pairs`` holds the
    distinct linked id pairs, (A << 32) + B, and ``times`` how often each is
    linked.  A null or empty text, or one whose tokens on either side don't
    join to its bytes with a space in front, has no tokens, zeros, and '' for
    groups and digest.  Rows that repeat are documents of their own; columns
    besides doc_id and text are ignored; an empty table gives an empty result.
    """
    name = "groups_sha256" if digests else "groups"
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(c, T.LongType()) for c in _COUNTS],
        T.StructField(name, T.StringType()),
        T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            for row, data, text in parts(batch.column("text")):
                found = aligner.align(row, data, text)
                n = len(text) - 1
                spelt = found.spelled()
                said = [hashlib.sha256(x).hexdigest() if x else "" for x in spelt] if digests else [x.decode() for x in spelt]
                pair = (found.a[found.link_a].astype(np.int64) << SHIFT) + found.b[found.link_b]
                order = np.lexsort([pair, found.link_doc])
                pair, doc = pair[order], found.link_doc[order]
                fresh = np.ones(len(pair), bool)
                fresh[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(fresh)
                times = np.diff(np.append(at, len(pair))).astype(np.int32)
                ends = pa.array(np.searchsorted(doc[at], np.arange(n + 1)).astype(np.int32))
                counts = [np.diff(found.first_a), np.diff(found.first_b), np.diff(found.first_cut), np.bincount(doc, minlength=n)]
                columns = [batch.column("doc_id").slice(row, n), *[pa.array(x.astype(np.int64)) for x in counts], pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pa.array(pair[at])), pa.ListArray.from_arrays(ends, pa.array(times))], names=schema.names)

    some = F.length("text") > 0
    spaced = F.when(some, F.concat(F.lit(" "), F.col("text")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced.alias("text")).mapInArrow(run, schema)


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents each pair is linked, and whether no pair of its A id has more."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, count = np.unique(batch.column("pairs").flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(count)], names=["pair", "count"])

    counts = aligned.select("pairs").mapInArrow(gather, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    counts = stored(counts)
    most = counts.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("count").alias("most"))
    return counts.join(most, F.shiftright(counts["pair"], SHIFT) == most["a"]).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame, most: int = PAIRS) -> DataFrame:
    """``aligned`` without pairs and times, with n_best and count_sum.

    ``n_best``: links whose pair's count is its A id's highest, ties included;
    ``count_sum``: the counts of all links together.
    """
    spark = aligned.sparkSession
    counts = stored(counts)
    shards = max(1, -(-counts.count() // most))
    out = aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for shard in range(shards):
        # Each shard's size is about ``most``, as pairs are dealt by hash.
        mine = counts if shards == 1 else counts.where(F.pmod(F.xxhash64("pair"), F.lit(shards)) == shard)
        got = mine.toArrow()
        order = np.argsort(got["pair"].to_numpy())
        shared = spark.sparkContext.broadcast((got["pair"].to_numpy()[order], got["count"].to_numpy()[order], got["best"].to_numpy()[order]))
        out = _scored(out, shared)
    return out.drop("pairs", "times")


def _scored(aligned: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = shared.value
        for batch in batches:
            pairs = batch.column("pairs")
            flat, times = pairs.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            known = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            ends = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
            more = {}
            for name, value in (("n_best", best), ("count_sum", count)):
                one = np.where(known, value[at], 0) * times if len(keys) else np.zeros(len(flat), np.int64)
                more[name] = pa.array(batch.column(name).to_numpy() + np.diff(np.concatenate([[0], np.cumsum(one, dtype=np.int64)])[ends]))
            yield pa.RecordBatch.from_arrays([more.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    return aligned.mapInArrow(run, aligned.schema)


def link_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, *, digests: bool = True) -> DataFrame:
    """Alignment with corpus-wide counts: texts are read once, what is found is kept in the shared folder."""
    aligned = stored(align_documents(docs, path_a, path_b, digests=digests))
    return score_links(aligned, count_pairs(aligned))
