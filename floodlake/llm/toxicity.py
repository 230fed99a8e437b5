"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary training texts, with
absolute discounting.  A class's bigram backs off to the continuation counts
of its word, these to those of the word's stems (its first 8, 7, 6, 5 and 4
bytes), and these to continuation counts that both classes share.  At each
level a class's estimate is interpolated in the logarithm with that of the next
level, by how many standard deviations the classes' counts lie apart: what a
class has hardly seen is judged by what is known of its kin, and at last by
what favours neither class.  A text's evidence is the difference of its two
log-likelihoods per word, for the whole text and for its most toxic stretch of
``STRETCH`` words; a logistic curve over these and the length, fitted on
training rows that the counts leave out, turns it into a score.

Counting and smoothing are Spark aggregations over labelled texts.  The models
hold at most ``MAX_NGRAMS`` n-grams, those whose estimates lie farthest from
what they back off to; that bounds what is broadcast, and all others back off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext
from .frames import fold, stored

#: Labelled rows of each class that the counts are taken from, about (by a hash of the id).
MAX_ROWS = 20_000
#: N-grams that the models keep: those that change most evidence against their backoff.
MAX_NGRAMS = 400_000
#: Evidence over all its occurrences below which an n-gram is left to its backoff.
LEAST = 0.02
#: Pairs rarer than this can't lie far enough apart to weigh anything.
MIN_COUNT = 6
DISCOUNT = 0.75
STRETCH = 32
#: Standard deviations between the classes at which a level weighs as much as all it backs off to; the value that
#: serves the fold of the curve best is taken.  Pairs need six times as many: copies of a text repeat its pairs, but
#: add no continuation of a word.
CHANCE = (4.0, 5.0, 6.0, 8.0)
OF_PAIRS = 6.0
#: Words that a task remembers, so as not to give their stems again.
SEEN = 1 << 20
#: Bytes of a word's stems, longest first; 0 is the word itself.
LEVELS = (0, 8, 7, 6, 5, 4)


@dataclass
class Model:
    """Differences of the classes' log-likelihoods of words and stems, and of pairs; a column for each of ``CHANCE``."""

    words: bytetext.Lookup
    word_ratio: np.ndarray
    pairs: bytetext.Lookup
    pair_ratio: np.ndarray
    weights: np.ndarray

    def at(self, i: int) -> Model:
        """The model that one value of ``CHANCE`` gives."""
        return Model(self.words, self.word_ratio[:, i : i + 1].copy(), self.pairs, self.pair_ratio[:, i : i + 1].copy(), np.zeros(6))

    def ratios(self, w: bytetext.Words) -> np.ndarray:
        """Of each word: the difference of its log-likelihoods, toxic less ordinary."""
        ratio = np.zeros(len(w.start), dtype=np.float64)
        if not len(ratio):
            return ratio
        hashes = w.hashes()
        open_ = np.arange(len(ratio))
        for level, length in enumerate(LEVELS):
            at = self.words.find(unit_key((w.prefixes(length) if length else hashes)[open_], level))
            ratio[open_[at >= 0]] = self.word_ratio[at[at >= 0], 0]
            open_ = open_[at < 0]
        at = self.pairs.find(bytetext.join_hash(_left(w, hashes), hashes))
        ratio[at >= 0] = self.pair_ratio[at[at >= 0], 0]
        return ratio

    def evidence(self, w: bytetext.Words) -> np.ndarray:
        """Per text: mean ratio, largest mean of a stretch, and log of the length."""
        ratio = self.ratios(w)
        total = np.concatenate([[0.0], np.cumsum(ratio)])
        n = w.counts()
        first, last = w.first[:-1], w.first[1:]
        mean = (total[last] - total[first]) / np.maximum(n, 1)
        most = mean.copy()
        if len(ratio):
            stop = np.minimum(np.arange(len(ratio)) + STRETCH, np.repeat(last, n))
            stretch = (total[stop] - total[np.minimum(np.arange(len(ratio)), np.maximum(stop - STRETCH, np.repeat(first, n)))]) / STRETCH
            full = n > 0
            most[full] = np.maximum.reduceat(stretch, first[full])
        return np.column_stack([mean, most, np.log1p(n)])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = np.clip(_terms(evidence) @ self.weights, -40, 40)
        return 1 / (1 + np.exp(-z))


def unit_key(units: np.ndarray, level: int) -> np.ndarray:
    """Keys of the words or stems of one level."""
    return units ^ np.uint64(level)


def _left(w: bytetext.Words, hashes: np.ndarray) -> np.ndarray:
    """The word before each word, 0 at the start of a text."""
    left = np.concatenate([[np.uint64(0)], hashes[:-1]])
    left[w.first[:-1][w.counts() > 0]] = 0
    return left


def _terms(e: np.ndarray) -> np.ndarray:
    mean, most, length = e.T
    return np.column_stack([np.ones(len(e)), mean * 10, most * 10, length, np.tanh(mean * np.expm1(length) / 20), np.tanh(mean * np.expm1(length) / 5)])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, left, word, n): each slice's pairs of a word and the word before it (0 at the start), counted."""
    for batch in batches:
        toxic = np.asarray(batch.column("toxic").to_pylist(), dtype=np.int32)
        for w in bytetext.slices(batch.column("text"), lower=True):
            if not len(w.start):
                continue
            word = w.hashes()
            left = _left(w, word)
            label = toxic[w.row + w.owner()]
            _, at, inverse = np.unique(bytetext.join_hash(left, word) + label.astype(np.uint64), return_index=True, return_inverse=True)
            n = np.bincount(inverse)
            yield pa.RecordBatch.from_arrays([pa.array(label[at]), *(pa.array(bytetext.signed(x[at])) for x in (left, word)), pa.array(n.astype(np.int64))], names=["toxic", "left", "word", "n"])


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, stems): the hashes of words and of their stems, in the order of ``LEVELS``; few words twice in a task."""
    seen = np.zeros(0, dtype=np.uint64)
    for batch in batches:
        for w in bytetext.slices(batch.column("text"), lower=True):
            word, at = np.unique(w.hashes(), return_index=True)
            new = ~np.isin(word, seen)
            word, at = word[new], at[new]
            seen = np.concatenate([seen if len(seen) < SEEN else seen[:0], word])
            stems = np.column_stack([word, *(w.prefixes(n)[at] for n in LEVELS[1:])])
            lists = pa.ListArray.from_arrays(np.arange(0, stems.size + 1, len(LEVELS), dtype=np.int32), pa.array(bytetext.signed(stems.ravel())))
            yield pa.RecordBatch.from_arrays([pa.array(bytetext.signed(word)), lists], names=["word", "stems"])


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic) of labelled documents outside fold 0 of 5, and how many labels each class has there.

    If a class has more than ``max_rows`` labels, about so many are taken by a
    hash of the id.  The ids taken are thus bounded, and broadcast.
    """
    marks = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold(F.col("doc_id"), 5) != 0)
    marks = stored(marks)
    sizes = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    kept = F.when(F.col("toxic") == 1, part < max_rows / max(sizes.get(1, 1), 1)).otherwise(part < max_rows / max(sizes.get(0, 1), 1))
    return stored(docs.select("doc_id", "text").join(F.broadcast(marks.where(kept)), "doc_id")), sizes


def fit(rows: DataFrame, sizes: dict[int, int], max_rows: int = MAX_ROWS, max_ngrams: int = MAX_NGRAMS, discount: float = DISCOUNT) -> Model:
    """Fit both models and the curve on what ``training_rows`` gives.

    Texts of fold 1 fit the curve, the others are counted.  With no rows, or
    rows of one class, every score is the share of toxic rows (one half if
    there are none).
    """
    classes = {r.toxic for r in rows.select("toxic").distinct().collect()}
    if len(classes) < 2:
        share = min(max(1.0 * (1 in classes), 1e-6), 1 - 1e-6) if classes else 0.5
        none, empty = bytetext.Lookup(np.zeros(0, np.uint64)), np.zeros((0, 1))
        return Model(none, empty, none, empty, np.array([np.log(share / (1 - share)), 0, 0, 0, 0, 0]))
    texts = rows.where(fold(F.col("doc_id"), 5) != 1).select("text", "toxic")
    counted = texts.mapInArrow(_pairs, "toxic int, left long, word long, n long")
    of_class = [F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    pairs = stored(counted.groupBy("left", "word").agg(*of_class))
    stems = texts.select("text").mapInArrow(_stems, "word long, stems array<long>").dropDuplicates(["word"])
    model = smooth(pairs, stems, max_ngrams, discount)
    held = rows.where(fold(F.col("doc_id"), 5) == 1)
    # Each class stands for all its labelled rows, whatever share of them was taken.
    stand = {c: max(1.0, sizes.get(c, 0) / max_rows) for c in (0, 1)}
    best, least = model.at(0), np.inf
    for i in range(len(CHANCE)):
        tried = model.at(i)
        points = _evidence(held.select("text", "toxic"), tried, ["toxic"]).toArrow()
        e = np.column_stack([np.asarray(points[c].to_numpy(), dtype=float) for c in ("mean", "most", "length")]) if len(points) else np.zeros((0, 3))
        y = np.asarray(points["toxic"].to_numpy(), dtype=float)
        weight = np.where(y == 1, stand[1], stand[0])
        tried.weights = _logistic(_terms(e), y, weight)
        p = np.clip(tried.score(e), 1e-9, 1 - 1e-9)
        loss = -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()
        if loss < least:
            best, least = tried, loss
    return best


def _apart(n0: Column, n1: Column, all0: Column, all1: Column) -> Column:
    """How many standard deviations n1 of n0 + n1 lies from its share all1 of all0 + all1."""
    expected = (n0 + n1) * all1 / F.greatest(all0 + all1, F.lit(1))
    return F.abs(n1 - expected) / F.sqrt(expected + 1)


def _weigh(z: Column, chance: float) -> Column:
    """The share of an estimate against what it backs off to."""
    return F.pow(z, 4) / (F.pow(z, 4) + chance**4)


def smooth(pairs: DataFrame, stems: DataFrame, max_ngrams: int, d: float) -> Model:
    """Kneser-Ney estimates of both classes from ``pairs(left, word, n0, n1)`` and ``stems(word, stems)``."""
    spared = lambda n: F.least(n, F.lit(d))  # noqa: E731  what the discount takes of a count
    words = pairs.groupBy("word").agg(F.count("*").alias("k"), *[F.count_if(F.col(f"n{c}") > 0).alias(f"k{c}") for c in (0, 1)], *[F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)])
    words = words.join(stems, "word").select("k", "k0", "k1", "n0", "n1", *[F.get("stems", j).alias(f"u{j}") for j in range(len(LEVELS))])
    # Stems nest, so after one shuffle by the shortest all levels' counts are sums where the rows lie.
    last = len(LEVELS) - 1
    words = words.repartition(f"u{last}")
    level = lambda j: Window.partitionBy(*[f"u{i}" for i in range(last, j - 1, -1)])
    counts = {f"{name}_{j}": F.sum(name).over(level(j)) for j in range(len(LEVELS)) for name in ("k", "k0", "k1", "n0", "n1")}
    firsts = {f"first_{j}": F.col("u0") == F.min("u0").over(level(j)) for j in range(len(LEVELS))}
    words = stored(words.select(*[f"u{j}" for j in range(len(LEVELS))], *[c.alias(n) for n, c in (counts | firsts).items()]))
    whole = words.agg(*[F.sum(f"{k}_0").alias(k) for k in ("k", "k0", "k1")], *[F.sum(F.when(F.col(f"first_{j}"), spared(F.col(f"k{c}_{j}")))).alias(f"d{c}_{j}") for j in range(len(LEVELS)) for c in (0, 1)]).first()
    all_ = {k: float(max(whole[k] or 0, 1)) for k in ("k", "k0", "k1")}
    lower: list[Column] = [F.lit(0.0)] * len(CHANCE)
    p: list[Column] = []
    for j in range(last, -1, -1):
        share = F.col(f"k_{j}") / (all_["k"] if j == last else F.col(f"k_{j + 1}"))
        base = [share if j == last else F.col(f"p{c}_{j + 1}") * share for c in (0, 1)]
        p = [F.greatest(F.col(f"k{c}_{j}") - d, F.lit(0.0)) / all_[f"k{c}"] + base[c] * ((whole[f"d{c}_{j}"] or 0.0) / all_[f"k{c}"]) for c in (0, 1)]
        words = words.withColumns({f"p{c}_{j}": p[c] for c in (0, 1)})
        z = _apart(F.col(f"k0_{j}"), F.col(f"k1_{j}"), F.lit(all_["k0"]), F.lit(all_["k1"]))
        ratio = F.log(F.col(f"p1_{j}")) - F.log(F.col(f"p0_{j}"))
        words = words.withColumn(f"z_{j}", z).withColumns({f"r{i}_{j}": _weigh(F.col(f"z_{j}"), x) * ratio + (1 - _weigh(F.col(f"z_{j}"), x)) * lower[i] for i, x in enumerate(CHANCE)})
        lower = [F.col(f"r{i}_{j}") for i in range(len(CHANCE))]
    words = stored(words)
    names = [f"r{i}" for i in range(len(CHANCE))]
    gains = lambda now, then, n: F.greatest(*[F.abs(a - b) for a, b in zip(now, then, strict=True)]) * n
    below = lambda j: [F.col(f"r{i}_{j + 1}") if j < last else F.lit(0.0) for i in range(len(CHANCE))]
    units = F.explode(F.array(*[F.struct(
        F.lit(j).alias("level"), F.col(f"u{j}").alias("unit"), F.col(f"first_{j}").alias("first"), *[F.col(f"r{i}_{j}").alias(f"r{i}") for i in range(len(CHANCE))],
        gains([F.col(f"r{i}_{j}") for i in range(len(CHANCE))], below(j), F.col(f"n0_{j}") + F.col(f"n1_{j}")).alias("gain"),
    ) for j in range(len(LEVELS))]))
    top = words.select(units.alias("x")).select("x.*").where(f"first AND gain > {LEAST}").orderBy(F.desc("gain"), "level", "unit").limit(max_ngrams // 2).drop("gain", "first").toArrow()
    table = lambda t: np.column_stack([np.asarray(t[c].to_numpy(), dtype=np.float64) for c in names])
    index = bytetext.Lookup(top["unit"].to_numpy().view(np.uint64) ^ top["level"].to_numpy().astype(np.uint64))
    lefts = pairs.groupBy("left").agg(*[F.sum(f"n{c}").alias(f"h{c}") for c in (0, 1)], *[F.sum(spared(F.col(f"n{c}"))).alias(f"t{c}") for c in (0, 1)])
    often = pairs.where(F.col("n0") + F.col("n1") >= MIN_COUNT)
    both = often.join(lefts, "left").join(words.select(F.col("u0").alias("word"), "p0_0", "p1_0", "z_0", *[f"r{i}_0" for i in range(len(CHANCE))]), "word")
    q = []
    for c in (0, 1):
        own = (F.greatest(F.col(f"n{c}") - d, F.lit(0.0)) + F.col(f"t{c}") * F.col(f"p{c}_0")) / F.greatest(F.col(f"h{c}"), F.lit(1))
        q.append(F.when(F.col(f"h{c}") > 0, own).otherwise(F.col(f"p{c}_0")))
    # A pair weighs no more than its word lets it.
    both = both.withColumn("ratio", F.log(q[1]) - F.log(q[0])).withColumn("z", F.least(_apart(F.col("n0"), F.col("n1"), F.col("h0"), F.col("h1")), 2 * F.col("z_0")))
    own = [F.col(f"r{i}_0") for i in range(len(CHANCE))]
    both = both.withColumns({f"r{i}": _weigh(F.col("z"), OF_PAIRS * x) * F.col("ratio") + (1 - _weigh(F.col("z"), OF_PAIRS * x)) * own[i] for i, x in enumerate(CHANCE)})
    both = both.withColumn("gain", gains([F.col(n) for n in names], own, F.col("n0") + F.col("n1"))).where(f"gain > {LEAST}")
    found = both.orderBy(F.desc("gain"), "left", "word").limit(max_ngrams // 2).select("left", "word", *names).toArrow()
    keys = bytetext.join_hash(*(found[c].to_numpy().view(np.uint64) for c in ("left", "word")))
    return Model(index, table(top), bytetext.Lookup(keys), table(found), np.zeros(6))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _evidence(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with mean, most and length besides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.evidence(w) for w in bytetext.slices(batch.column("text"), lower=True)]
            e = np.concatenate(parts) if parts else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(e[:, i]) for i in range(3))], names=[*keep, "mean", "most", "length"])

    schema = docs.select(*keep).schema.add("mean", "double").add("most", "double").add("length", "double")
    return docs.mapInArrow(run, schema)


def score_texts(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score and predicted besides; the text alone decides.

    Null and empty texts get the score of a text without evidence.  Rows that
    repeat are scored each for itself; an empty table gives an empty result.
    Columns called score, predicted, mean, most or length are replaced.
    """
    own = [c for c in docs.columns if c not in ("score", "predicted", "mean", "most", "length") and (keep is None or c in keep)]
    out = _evidence(docs, model, own)
    # The curve is applied in column arithmetic, so every engine node agrees on it.
    weights = [float(x) for x in model.weights]
    mean, most, length = F.col("mean"), F.col("most"), F.col("length")
    total = mean * F.expm1(length)
    terms = [F.lit(1.0), mean * 10, most * 10, length, F.tanh(total / 20), F.tanh(total / 5)]
    z = sum((t * w for t, w in zip(terms[1:], weights[1:], strict=True)), terms[0] * weights[0])
    out = out.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0)))))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("mean", "most", "length")
