"""LM scoring with a gated recurrent network and a class-factored softmax.

Tokens are lower-cased words and one end per text.  The model gives each the
probability of its class after all that came before it in the text, times its
probability inside the class:

* the ``LEARNED`` most frequent tokens lie in classes of equal size, with a
  learned softmax inside;
* the next ones, up to ``FREQUENT``, lie in classes by spelling and frequency,
  and all others, known or not, in classes by spelling alone; inside these a
  token weighs by its count plus one, and a token never seen by one.

Counts, class totals and vocabulary come from all training texts by Spark
aggregation.  The network is trained on every training text once, by truncated
backpropagation in numpy: hashes deal the texts to ``ROUNDS`` rounds; in each,
every task trains on its texts from the same start, and the tasks' weights are
averaged level by level, at most ``FAN_IN`` of them together.  Output
biases start from the counts, so the first guess is the unigram model.  Texts
are scored whole: the state is carried from window to window.

Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .frames import fold, order_key, stored

LEARNED, CLASS_SIZE = 1024, 32
#: Tokens whose counts are sent to every task: the most frequent ones, a fixed number.
FREQUENT = 1 << 16
#: Spellings (see ``_spelling``), and steps of frequency among the frequent but not learned.
SPELLINGS, STEPS = 6, 3
HIDDEN = 16
#: Tokens over which errors flow back, and texts trained side by side.
WINDOW, STREAMS = 32, 256
ROUNDS = 3
#: Tasks whose weights meet in one group of a level of averages.
FAN_IN = 64
#: Tokens that a task lays out and trains on at a time, so its memory doesn't grow with its share of the table.
PORTION = 1 << 20
#: Tokens of each text that scoring takes in one window, and words scored together; the state is carried on.
SPAN, TOGETHER = 16, 3_000_000
RATE = 0.01
END = np.uint64(0xE0F0E0F0E0F0E0F1)


def _spelling(w: bytetext.Words) -> np.ndarray:
    """A class for each word from its bytes: plain ASCII, umlauts, or other letters; and whether it ends in a letter or digit."""
    mark = np.zeros(len(w.data) + 1, dtype=np.int64)
    np.cumsum(w.data >= 0x80, out=mark[1:])
    wide = mark[w.end] > mark[w.start]
    np.cumsum(np.isin(w.data, (0xA4, 0xB6, 0xBC, 0x9F)), out=mark[1:])
    umlaut = wide & (mark[w.end] > mark[w.start])
    last = w.data[w.end - 1]
    open_end = (last >= 0x80) | ((last >= 0x61) & (last <= 0x7A)) | ((last >= 0x30) & (last <= 0x39))
    return (wide.astype(np.int64) + umlaut) * 2 + open_end


def _tokens(w: bytetext.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes with an end after each text, spellings, and where each text begins."""
    first = w.first + np.arange(w.n_texts + 1)
    h = np.full(first[-1], END, dtype=np.uint64)
    spelling = np.zeros(first[-1], dtype=np.int64)
    at = np.arange(len(w.start)) + w.owner()
    h[at] = w.hashes()
    spelling[at] = _spelling(w)
    return h, spelling, first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, spelling, n) of each few slices."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> pa.RecordBatch:
        h = np.concatenate([x[0] for x in held])
        s = np.concatenate([x[1] for x in held])
        word, at, n = np.unique(h, return_index=True, return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(bytetext.signed(word)), pa.array(s[at].astype(np.int32)), pa.array(n.astype(np.int64))], names=["h", "spelling", "n"])

    for batch in batches:
        for w in bytetext.slices(batch.column("text"), lower=True):
            h, spelling, _ = _tokens(w)
            held.append((h, spelling.astype(np.int8)))
            if sum(len(x[0]) for x in held) > 2_000_000:
                yield summed()
    if held:
        yield summed()


@dataclass
class Vocabulary:
    """What every task knows of the counts; ``total`` tokens, ``distinct`` ones."""

    hashes: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    rest_total: np.ndarray
    rest_distinct: np.ndarray
    spelling: np.ndarray

    def __post_init__(self) -> None:
        n = len(self.hashes)
        self.lookup = bytetext.Lookup(self.hashes)
        self.learned = min(LEARNED, n)
        self.n_learned = -(-LEARNED // CLASS_SIZE)
        rank = np.arange(n)
        step = np.clip(np.log2(np.maximum(rank, 1) / LEARNED) * STEPS / np.log2(FREQUENT / LEARNED), 0, STEPS - 1).astype(np.int64)
        middle = self.n_learned + self.spelling * STEPS + step
        self.token_class = np.where(rank < self.learned, rank // CLASS_SIZE, middle)
        self.n_middle = SPELLINGS * STEPS
        self.n_classes = self.n_learned + self.n_middle + SPELLINGS
        mass = np.bincount(self.token_class, weights=self.counts, minlength=self.n_classes)
        mass[self.n_learned + self.n_middle :] = self.rest_total + self.rest_distinct + 1
        self.class_mass = mass + 1.0
        # log10 probability inside the class, where counts decide it.
        middle_mass = np.bincount(self.token_class, weights=self.counts, minlength=self.n_classes)
        self.inside = np.where(rank < self.learned, 0.0, np.log10(np.maximum(self.counts, 1) / np.maximum(middle_mass[self.token_class], 1)))
        self.base = np.log10((self.counts + 1) / (self.total + self.distinct + 1))

    def classes(self, index: np.ndarray, spelling: np.ndarray) -> np.ndarray:
        """The class of each token; index -1 is a token that isn't frequent."""
        return np.where(index >= 0, self.token_class[index], self.n_learned + self.n_middle + spelling) if len(self.hashes) else self.n_learned + self.n_middle + spelling

    def inputs(self, index: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Rows of the input table: learned tokens each their own, others by class."""
        return np.where((index >= 0) & (index < self.learned), index, LEARNED + classes - self.n_learned)


def count_tokens(docs: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """Counts (h, c) of all tokens of ``docs(text)``, as a stored table, and what every task needs of them."""
    counts = stored(docs.select("text").mapInArrow(_count, "h long, spelling int, n long").groupBy("h").agg(F.sum("n").alias("c"), F.max("spelling").alias("spelling")))
    top = counts.orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()
    c = top["c"].to_numpy().astype(np.float64)
    per = {r.spelling: r for r in counts.groupBy("spelling").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    spelling = top["spelling"].to_numpy().astype(np.int64)
    total = np.array([per[s].c if s in per else 0 for s in range(SPELLINGS)], dtype=np.float64) - np.bincount(spelling, weights=c, minlength=SPELLINGS)
    distinct = np.array([per[s].v if s in per else 0 for s in range(SPELLINGS)], dtype=np.float64) - np.bincount(spelling, minlength=SPELLINGS)
    vocabulary = Vocabulary(top["h"].to_numpy().view(np.uint64), c, sum(r.c for r in per.values()), sum(r.v for r in per.values()), total, distinct, spelling)
    return counts.select("h", "c"), vocabulary


class Network:
    """The weights, in one float32 vector, and passes through them."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray | None = None) -> None:
        v, h = vocabulary, HIDDEN
        self.n_classes, self.n_learned, self.start = v.n_classes, v.n_learned, LEARNED + v.n_classes - v.n_learned
        # Inputs: learned tokens, the other classes, and the start of a text.
        shapes = {"x": (LEARNED + v.n_classes - v.n_learned + 1, 3 * h), "u": (h, 3 * h), "c": (h, v.n_classes), "cb": (v.n_classes,), "w": (v.n_learned, h, CLASS_SIZE), "wb": (v.n_learned, CLASS_SIZE)}
        ends = np.cumsum([int(np.prod(s)) for s in shapes.values()])
        if weights is None:
            rng = np.random.default_rng(5)
            weights = rng.normal(0, 0.1, ends[-1]).astype(np.float32)
        self.weights = weights
        self.part = {k: weights[e - int(np.prod(s)) : e].reshape(s) for (k, s), e in zip(shapes.items(), ends, strict=True)}

    def start_from_counts(self, v: Vocabulary) -> None:
        self.part["cb"][:] = np.log(v.class_mass / v.class_mass.sum())
        inside = np.full(self.n_learned * CLASS_SIZE, -20.0)
        inside[: v.learned] = np.log(v.counts[: v.learned] + 1)
        self.part["wb"][:] = inside.reshape(self.n_learned, CLASS_SIZE)
        self.part["c"] *= 0.1
        self.part["w"] *= 0.1

    def states(self, inputs: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States before and after each input (T, B, H), and gates; ``keep`` is 0 where a text begins."""
        n = HIDDEN
        t_len, b = inputs.shape
        before, after = np.empty((2, t_len, b, n), dtype=np.float32)
        gates = np.empty((t_len, b, 3 * n), dtype=np.float32)
        # The logistic function is a tanh of half its argument.
        halves = np.repeat(np.array([0.5, 1.0], dtype=np.float32), [2 * n, n])
        x = (self.part["x"] * halves)[inputs]
        u = self.part["u"] * halves
        u_zr, u_n = np.ascontiguousarray(u[:, : 2 * n]), np.ascontiguousarray(u[:, 2 * n :])
        half = np.float32(0.5)
        begins = keep.min(axis=1) < 1 if keep is not None else np.zeros(t_len, dtype=bool)
        for t in range(t_len):
            if begins[t]:
                h = h * keep[t][:, None]
            before[t] = h
            zr = np.dot(h, u_zr)
            zr += x[t, :, : 2 * n]
            np.tanh(zr, out=zr)
            zr *= half
            zr += half
            new = np.dot(zr[:, n:] * h, u_n)
            new += x[t, :, 2 * n :]
            np.tanh(new, out=new)
            gates[t, :, : 2 * n], gates[t, :, 2 * n :] = zr, new
            h = h + zr[:, :n] * (new - h)
            after[t] = h
        return before, after, gates

    def log_classes(self, states: np.ndarray) -> np.ndarray:
        z = states @ self.part["c"] + self.part["cb"]
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z

    def log_inside(self, states: np.ndarray, classes: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """log probability of each learned token inside its class."""
        out = np.empty(len(states), dtype=np.float32)
        order = np.argsort(classes, kind="stable")
        ends = np.searchsorted(classes[order], np.arange(self.n_learned + 1))
        for c in range(self.n_learned):
            at = order[ends[c] : ends[c + 1]]
            if len(at):
                z = states[at] @ self.part["w"][c] + self.part["wb"][c]
                top = z.max(axis=1)
                out[at] = z[np.arange(len(at)), slots[at]] - top - np.log(np.exp(z - top[:, None]).sum(axis=1))
        return out

    def learn_window(self, inputs: np.ndarray, classes: np.ndarray, tokens: np.ndarray, h: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """One window: the gradient of the mean log loss, the carried state, and the loss.

        ``inputs`` are the tokens before those of ``classes`` and ``tokens``, which are predicted.
        """
        n = HIDDEN
        grad = Network.__new__(Network)
        grad.weights = np.zeros_like(self.weights)
        at = 0
        grad.part = {}
        for k, p in self.part.items():
            grad.part[k] = grad.weights[at : at + p.size].reshape(p.shape)
            at += p.size
        before, after, gates = self.states(inputs, h, keep)
        t_len, b = inputs.shape
        s = after.reshape(-1, n)
        c = classes.reshape(-1)
        m = len(c)
        d = s @ self.part["c"]
        d += self.part["cb"]
        # States lie within 1, so the weights bound the exponents; the largest is taken off only where they could overflow.
        if float(np.abs(self.part["c"]).sum(axis=0).max() + np.abs(self.part["cb"]).max()) > 60:
            d -= d.max(axis=1, keepdims=True)
        np.exp(d, out=d)
        d /= d.sum(axis=1, keepdims=True)
        loss = -np.log(np.maximum(d[np.arange(m), c], 1e-30)).sum()
        d[np.arange(m), c] -= 1
        d *= np.float32(1 / m)
        grad.part["c"][:] = s.T @ d
        grad.part["cb"][:] = d.sum(axis=0)
        ds = d @ self.part["c"].T
        # Tokens of one class lie together, each class has a softmax of its own.
        own = np.argsort(c, kind="stable")
        ends = np.searchsorted(c[own], np.arange(self.n_learned + 1))
        own = own[: ends[-1]]
        mine, slots = s[own], tokens.reshape(-1)[own] % CLASS_SIZE
        back_in = np.empty_like(mine)
        far = float(np.abs(self.part["w"]).sum(axis=1).max() + np.abs(self.part["wb"]).max()) > 60
        for k in np.flatnonzero(np.diff(ends)):
            rows = slice(ends[k], ends[k + 1])
            p = mine[rows] @ self.part["w"][k]
            p += self.part["wb"][k]
            if far:
                p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(axis=1, keepdims=True)
            hit = np.arange(len(p)), slots[rows]
            loss -= np.log(np.maximum(p[hit], 1e-30)).sum()
            p[hit] -= 1
            p *= np.float32(1 / m)
            grad.part["w"][k] = mine[rows].T @ p
            grad.part["wb"][k] = p.sum(axis=0)
            back_in[rows] = p @ self.part["w"][k].T
        ds[own] += back_in
        ds = ds.reshape(t_len, b, n)
        dx = np.empty((t_len, b, 3 * n), dtype=np.float32)
        u = self.part["u"]
        z, r, new = (np.ascontiguousarray(gates[:, :, at : at + n]) for at in (0, n, 2 * n))
        # What each step's error is multiplied by on its way to the gates, for all steps at once.
        by_new, by_z, by_r, hold = z * (1 - new * new), (new - before) * z * (1 - z), before * r * (1 - r), 1 - z
        back_n, back_zr = np.ascontiguousarray(u[:, 2 * n :].T), np.ascontiguousarray(u[:, : 2 * n].T)
        begins = keep.min(axis=1) < 1
        back = np.zeros((b, n), dtype=np.float32)
        for t in range(t_len - 1, -1, -1):
            back = back + ds[t]
            one = dx[t]
            np.multiply(back, by_new[t], out=one[:, 2 * n :])
            d_rh = np.dot(one[:, 2 * n :], back_n)
            np.multiply(back, by_z[t], out=one[:, :n])
            np.multiply(d_rh, by_r[t], out=one[:, n : 2 * n])
            back *= hold[t]
            d_rh *= r[t]
            back += d_rh
            back += np.dot(one[:, : 2 * n], back_zr)
            if begins[t]:
                back = back * keep[t][:, None]
        flat, old = dx.reshape(-1, 3 * n), before.reshape(-1, n)
        grad.part["u"][:, : 2 * n] = old.T @ flat[:, : 2 * n]
        grad.part["u"][:, 2 * n :] = (r * before).reshape(-1, n).T @ flat[:, 2 * n :]
        order = np.argsort(inputs.reshape(-1), kind="stable")
        which = inputs.reshape(-1)[order]
        starts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        grad.part["x"][which[starts]] = np.add.reduceat(flat[order], starts, axis=0)
        return grad.weights, after[-1], float(loss) / m


def _encode(w: bytetext.Words, v: Vocabulary) -> tuple[np.ndarray, ...]:
    h, spelling, first = _tokens(w)
    index = v.lookup.find(h)
    classes = v.classes(index, spelling)
    return h, index, classes, v.inputs(index, classes), first


def _portions(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """All texts of the batches, encoded, in lists of ``PORTION`` tokens or a slice more."""
    parts, size = [], 0
    for batch in batches:
        for w in bytetext.slices(batch.column("text"), lower=True):
            parts.append(_encode(w, v))
            size += len(parts[-1][3])
            if size >= PORTION:
                yield parts
                parts, size = [], 0
    if parts:
        yield parts


def _train(batches: Iterator[pa.RecordBatch], v: Vocabulary, weights: np.ndarray, rate: float) -> tuple[np.ndarray, int]:
    """Weights after one pass over all of the task's texts, laid out in parallel streams, and their tokens."""
    net = Network(v, weights.copy())
    m, s = np.zeros_like(net.weights), np.zeros_like(net.weights)
    step = tokens = 0
    for parts in _portions(batches, v):
        inputs = np.concatenate([p[3] for p in parts])
        classes, index = np.concatenate([p[2] for p in parts]), np.concatenate([p[1] for p in parts])
        starts = np.zeros(len(inputs), dtype=bool)
        at = 0
        for p in parts:
            starts[p[4][:-1] + at] = True
            at += len(p[3])
        previous = np.where(starts, net.start, np.concatenate([inputs[:1], inputs[:-1]]))
        flat = previous, classes, np.maximum(index, 0), (~starts).astype(np.float32)
        streams = max(1, min(STREAMS, len(inputs) // WINDOW))
        even = len(inputs) // streams * streams
        # What the streams leave over, fewer tokens than there are streams, is a stream of its own.
        for laid in ([x[:even].reshape(streams, -1).T for x in flat], [x[even:].reshape(1, -1).T for x in flat]):
            previous, classes, index, keep = laid
            h = np.zeros((previous.shape[1], HIDDEN), dtype=np.float32)
            for t in range(0, len(previous), WINDOW):
                cut = slice(t, t + WINDOW)
                g, h, _ = net.learn_window(previous[cut], classes[cut], index[cut], h, keep[cut])
                g *= min(1.0, 1.0 / max(float(np.sqrt(np.dot(g, g))), 1e-9))
                step += 1
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                net.weights -= (rate / (1 - 0.9**step)) * m / (np.sqrt(s * (1 / (1 - 0.99**step))) + 1e-6)
            tokens += previous.size
    return net.weights, tokens


def _average(task: int, group: pd.DataFrame) -> pd.DataFrame:
    tokens = group["tokens"].to_numpy(dtype=np.float64)
    total = sum(np.frombuffer(b, dtype=np.float32).astype(np.float64) * n for b, n in zip(group["weights"], tokens, strict=True))
    return pd.DataFrame({"task": [task], "tokens": [int(tokens.sum())], "weights": [(total / max(tokens.sum(), 1)).astype(np.float32).tobytes()]})


def averaged(trained: DataFrame, fan_in: int = FAN_IN) -> np.ndarray | None:
    """Mean by tokens of the weights of ``trained(task, tokens, weights)``; none if there are no rows.

    Level by level, those of ``fan_in`` tasks that follow one another meet, so
    no group is larger, however many tasks have trained.  What tasks have
    learned is stored first: a lost executor costs no training.
    """
    rows = stored(trained)
    last = rows.agg(F.max("task")).first()[0]
    if last is None:
        return None
    while True:
        up = F.floor(F.col("task") / fan_in).cast("int").alias("task")
        rows = rows.groupBy(up).applyInPandas(lambda k, g: _average(int(k[0]), g), "task int, tokens long, weights binary")
        last //= fan_in
        if not last:
            return np.frombuffer(rows.first().weights, dtype=np.float32).copy()


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Train on all of ``docs(text)``, each text in one round: tasks train side by side, their weights are averaged after every round."""
    spark = docs.sparkSession
    net = Network(vocabulary)
    net.start_from_counts(vocabulary)
    weights = net.weights
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((vocabulary, weights, RATE / (1 + r)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            v, start, rate = shared.value
            new, tokens = _train(batches, v, start, rate)
            if tokens:
                yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int32()), "tokens": [tokens], "weights": [new.tobytes()]})

        turn = docs.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r).select("text")
        found = averaged(turn.mapInArrow(run, "task int, tokens long, weights binary"))
        if found is not None:
            weights = found
    return weights


def _score_batch(w_list: list[bytetext.Words], v: Vocabulary, net: Network) -> Iterator[tuple[np.ndarray, ...]]:
    """For the texts of some slices: log10 score, base and known tokens without the rare ones, and rare tokens (text, h, n, class)."""
    parts = [_encode(w, v) for w in w_list]
    n_texts = sum(w.n_texts for w in w_list)
    inputs, classes, index = (np.concatenate([p[i].astype(np.int32) for p in parts]) for i in (3, 2, 1))
    h = np.concatenate([p[0] for p in parts])
    sizes = np.concatenate([np.diff(p[4]) for p in parts])
    first = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(-sizes, kind="stable")
    total = np.zeros(n_texts)
    state = np.zeros((n_texts, HIDDEN), dtype=np.float32)  # in the order of length
    begin, size = first[:-1][order], sizes[order]
    for t in range(0, int(size[0]) if n_texts else 0, SPAN):
        live = int(np.searchsorted(-size, -t, side="left"))
        span = min(SPAN, int(size[0]) - t)
        at = np.minimum(begin[:live] + t + np.arange(span)[:, None], first[-1] - 1)
        inside = np.arange(span)[:, None] + t < size[:live]
        before = inputs[np.maximum(at - 1, 0)]
        if t == 0:
            before[0] = net.start
        _, after, _ = net.states(before, state[:live])
        s = after[inside]
        state[:live] = after[-1]
        c, i = classes[at][inside], index[at][inside]
        value = net.log_classes(s)[np.arange(len(s)), c]
        own = np.flatnonzero((i >= 0) & (i < v.learned))
        value[own] += net.log_inside(s[own], c[own], i[own] % CLASS_SIZE)
        text = np.broadcast_to(order[:live], inside.shape)[inside]
        total += np.bincount(text, weights=value, minlength=n_texts)
    total /= np.log(10)
    owner = np.repeat(np.arange(n_texts), sizes)
    common = index >= 0
    if len(v.hashes):
        total += np.bincount(owner[common], weights=v.inside[index[common]], minlength=n_texts)
        base = np.bincount(owner[common], weights=v.base[index[common]], minlength=n_texts)
    else:
        base = np.zeros(n_texts)
    known = np.bincount(owner[common], minlength=n_texts)
    rare = np.flatnonzero(~common)
    pair = np.lexsort((h[rare], owner[rare]))
    rare = rare[pair]
    new = np.ones(len(rare), dtype=bool)
    new[1:] = (h[rare][1:] != h[rare][:-1]) | (owner[rare][1:] != owner[rare][:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(rare)))
    yield sizes, total, base, known, owner[rare[at]], h[rare[at]], n, classes[rare[at]] - v.n_learned - v.n_middle


def score_documents(docs: DataFrame, trained: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of whole texts: ``score`` by the network,
    ``base_score`` by counts plus one.  The model learns from the texts whose
    crc32 of the id modulo 7 is not 2.  A null text is empty and has one token,
    the end; a null id counts as the empty text in the fold.  Rows that repeat
    are scored each for itself; columns besides doc_id and text are ignored; an
    empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = fold(F.col("doc_id"), 7) == 2
    learning = docs.where(~held)
    counts, v = count_tokens(learning)
    weights = train(learning.select("text"), v)
    shared = docs.sparkSession.sparkContext.broadcast((v, weights))
    keyed = docs.select(order_key(F.col("doc_id")).alias("ord"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, weights = shared.value
        net = Network(v, weights)
        for batch in batches:
            ids, marks = batch.column("ord").to_numpy(), batch.column("mark").to_numpy()
            held: list[bytetext.Words] = []
            size = 0
            for w in bytetext.slices(batch.column("text"), lower=True):
                held.append(w)
                size += len(w.start)
                if size > TOGETHER:
                    yield from _rows(held, ids, marks, v, net)
                    held, size = [], 0
            if held:
                yield from _rows(held, ids, marks, v, net)

    flat = keyed.mapInArrow(run, "ord long, mark long, spread long, h long, n long, spelling int, n_tokens long, known long, base double, score double")
    # Rare tokens get their counts by a join; rows of texts, whose h is null, are spread by a key of their own.
    joined = flat.join(counts.withColumnRenamed("h", "spread"), "spread", "left").withColumn("c", F.when(F.col("h").isNotNull(), F.coalesce("c", F.lit(0))))
    room = F.element_at(F.array(*[F.lit(float(a + b + 1)) for a, b in zip(v.rest_total, v.rest_distinct, strict=True)]), F.col("spelling") + 1)
    rare = F.col("h").isNotNull()
    whole = float(v.total + v.distinct + 1)
    per = joined.groupBy("ord", "mark").agg(
        F.count_if(~rare).alias("rows"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.when(rare, F.when(F.col("c") > 0, F.col("n")).otherwise(0)).otherwise(F.col("known"))).alias("n_known"),
        F.sum(F.when(rare, F.col("n") * F.log10((F.col("c") + 1) / whole)).otherwise(F.col("base"))).alias("base_score"),
        F.sum(F.when(rare, F.col("n") * F.log10((F.col("c") + 1) / room)).otherwise(F.col("score"))).alias("score"),
    )
    doc_id = F.when(F.col("ord") != (1 << 63) - 1, F.col("ord"))
    each = per.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return each.select(
        doc_id.alias("doc_id"), (fold(doc_id, 7) == 2).alias("held_out"),
        *[(F.col(c) / F.col("rows")).cast("long").alias(c) for c in ("n_tokens", "n_known")],
        F.lit(int(v.total)).cast("long").alias("train_tokens"),
        (F.col("base_score") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"),
    )


def _rows(held: list[bytetext.Words], ids: np.ndarray, marks: np.ndarray, v: Vocabulary, net: Network) -> Iterator[pa.RecordBatch]:
    row = np.concatenate([w.row + np.arange(w.n_texts) for w in held])
    names = ["ord", "mark", "spread", "h", "n", "spelling", "n_tokens", "known", "base", "score"]
    for sizes, total, base, known, owner, h, n, spelling in _score_batch(held, v, net):
        k, r = len(row), len(owner)
        lone = bytetext.signed(bytetext.mix(marks[row].view(np.uint64) ^ END))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[row]), pa.array(marks[row]), pa.array(lone), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.array(sizes.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(total)],
            names=names,
        )
        key = pa.array(bytetext.signed(h))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[row[owner]]), pa.array(marks[row[owner]]), key, key, pa.array(n.astype(np.int64)), pa.array(spelling.astype(np.int32)), pa.nulls(r, pa.int64()), pa.nulls(r, pa.int64()), pa.nulls(r, pa.float64()), pa.nulls(r, pa.float64())],
            names=names,
        )
