"""Source divergence audit with minimal acyclic transducers as vocabulary.

A first pass counts in how many documents of its language each term stands; the
terms kept are sorted, dealt to ranges, and each range becomes one minimal
acyclic transducer whose paths spell its terms and whose outputs add up to a
term's lexicographic ordinal.  A second pass streams the texts through the
transducers, all words of a slice side by side, and counts ordinals.  From there
on terms are ordinals: sources of a language are compared over blocks of them,
and of equal values the smaller ordinal comes first.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import Lookup, Words, mix, signed, slices
from .frames import stored

#: Documents of a language that a term must stand in to be kept.
MIN_DOCS = 30
#: Terms of one transducer at most, and terms of the transducers that one pass over the texts takes.
RANGE, PASS = 1 << 16, 1 << 20
#: Ordinals of one block, and sources of one bucket, when sources are compared.
BLOCK, BUCKET = 1024, 64
#: Ranks that part ``term`` keeps.
TOP = 50


class Transducer:
    """A minimal acyclic transducer over sorted, distinct byte strings: term to ordinal.

    Terms are added in order; states behind the part shared with the next term
    are final in their arcs, and equal ones become one.  An arc's output is the
    number of terms that come before all that follow it.
    """

    def __init__(self, terms: list[bytes]) -> None:
        known: dict[tuple, int] = {}
        accept, below, arcs = [], [], []

        def settle(state: list) -> int:
            key = (state[0], tuple(state[1]))
            if key not in known:
                known[key] = len(accept)
                accept.append(state[0])
                below.append(state[0] + sum(below[t] for _, t in state[1]))
                arcs.append(state[1])
            return known[key]

        # A state under way: whether a term ends there, its settled arcs, the byte of the open arc.
        path: list[list] = [[0, [], 0]]
        before = b""
        for term in [*terms, None]:
            shared = 0
            if term is not None:
                while shared < min(len(term), len(before)) and term[shared] == before[shared]:
                    shared += 1
            while len(path) > shared + 1:
                state = path.pop()
                path[-1][1].append((path[-1][2], settle(state)))
            if term is None:
                break
            for byte in term[shared:]:
                path[-1][2] = byte
                path.append([0, [], 0])
            path[-1][0] = 1
            before = term
        self.start = settle(path[0])
        self.terms = below[self.start]
        self.accept = np.array(accept, bool)
        keys, targets, outputs = [], [], []
        for state, found in enumerate(arcs):
            passed = accept[state]
            for byte, target in found:
                keys.append(state << 8 | byte)
                targets.append(target)
                outputs.append(passed)
                passed += below[target]
        self.target, self.output = np.array(targets, np.int32), np.array(outputs, np.int64)
        self.lookup = Lookup(mix(np.array(keys, np.uint64)))

    def ordinals(self, words: Words, chosen: np.ndarray) -> np.ndarray:
        """The ordinal of each chosen word, -1 for those that aren't terms; each step takes one byte of all."""
        out = np.full(len(chosen), -1, np.int64)
        live, at, end = np.arange(len(chosen)), words.start[chosen], words.end[chosen]
        state, ordinal = np.full(len(chosen), self.start, np.int64), np.zeros(len(chosen), np.int64)
        while len(live):
            done = at == end
            stop = done & self.accept[state]
            out[live[stop]] = ordinal[stop]
            go = ~done
            live, at, end, state, ordinal = live[go], at[go], end[go], state[go], ordinal[go]
            arc = self.lookup.find(mix((state << 8 | words.data[at]).astype(np.uint64)))
            go = arc >= 0
            live, at, end, arc = live[go], at[go] + 1, end[go], arc[go]
            state, ordinal = self.target[arc].astype(np.int64), ordinal[go] + self.output[arc]
        return out


def _groups(docs: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return docs.select(empty("text"), empty("lang"), empty("source"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term): the terms in at least ``min_docs`` documents of the language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            code = lang.indices.to_numpy().astype(np.uint64)
            for words in slices(batch.column("text"), lower=True, alpha=True):
                owner, h = words.owner(), words.hashes()
                # Once for each document, then once for each language.
                _, once = np.unique(mix(h ^ mix(owner.astype(np.uint64) + np.uint64(1))), return_index=True)
                mine = code[words.row + owner[once]]
                _, at, n = np.unique(mix(h[once] ^ mix(mine + np.uint64(1))), return_index=True, return_counts=True)
                text = pa.array([words.word(once[i]) for i in at], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(mine[at].astype(np.int64))), text, pa.array(n)], names=["lang", "term", "n"])

    found = docs.select("lang", "text").mapInArrow(count, "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term")


def build_vocabulary(kept: DataFrame, size: int = RANGE) -> DataFrame:
    """(lang, base, n, terms, transducer) per range of sorted terms; ``base`` is the ordinal of its first term in the language."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms = None, []

        def made() -> pa.RecordBatch:
            found = Transducer([t.encode() for t in terms])
            row = [[lang], [terms[0]], [len(terms)], [terms], [pickle.dumps(found, 5)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.binary()), strict=True)], names=["lang", "first", "n", "terms", "transducer"])

        for batch in batches:
            for one, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist(), strict=True):
                if terms and (one != lang or len(terms) >= size):
                    yield made()
                    terms = []
                lang = one
                terms.append(term)
        if terms:
            yield made()

    ranges = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(build, "lang string, first string, n long, terms array<string>, transducer binary")
    ranges = stored(ranges)
    order = Window.partitionBy("lang").orderBy("first")
    base = ranges.select("lang", "first", (F.sum("n").over(order) - F.col("n")).alias("base"))
    return ranges.join(base, ["lang", "first"]).select("lang", "base", "n", "terms", "transducer")


def recount(docs: DataFrame, vocabulary: DataFrame, most: int = PASS) -> DataFrame:
    """(lang, source, ordinal, count) of kept terms that occur, by streaming the texts through the transducers.

    One pass over the texts for every ``most`` terms, in which the transducers
    of that many are shipped to the tasks.
    """
    order = Window.orderBy("lang", "base")
    turns = vocabulary.select("lang", "base", F.floor((F.sum("n").over(order) - F.col("n")) / most).alias("turn"))
    turns = stored(turns)
    last = turns.agg(F.max("turn")).first()[0]
    out = None
    for turn in range(0 if last is None else last + 1):
        rows = vocabulary.join(turns.where(F.col("turn") == turn), ["lang", "base"]).select("lang", "base", "transducer").toLocalIterator()
        found = _streamed(docs, [(r.lang, r.base, bytes(r.transducer)) for r in rows])
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "lang string, source string, ordinal long, count long")
    # Each ordinal is counted in one pass only.
    return out.groupBy("lang", "source", "ordinal").agg(F.sum("count").alias("count"))


_loaded: dict[int, tuple[Any, dict]] = {}


def _transducers(shared) -> dict[str, list[tuple[int, Transducer]]]:
    """The transducers of each language, unpacked once in a worker."""
    blobs = shared.value  # Spark keeps it as long as the worker lives
    if id(blobs) not in _loaded:
        _loaded.clear()
        by: dict[str, list[tuple[int, Transducer]]] = {}
        for lang, base, blob in blobs:
            by.setdefault(lang, []).append((base, pickle.loads(blob)))
        _loaded[id(blobs)] = (blobs, by)
    return _loaded[id(blobs)][1]


def _streamed(docs: DataFrame, blobs: list[tuple[str, int, bytes]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _transducers(shared)
        for batch in batches:
            lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
            lang_of, source_of = lang.indices.to_numpy(), source.indices.to_numpy()
            n_sources = len(source.dictionary)
            for words in slices(batch.column("text"), lower=True, alpha=True):
                row = words.row + words.owner()
                mine = lang_of[row]
                for code, name in enumerate(lang.dictionary.to_pylist()):
                    left = np.flatnonzero(mine == code)
                    for base, transducer in by.get(name, []):
                        if not len(left):
                            break
                        ordinal = transducer.ordinals(words, left)
                        hit = ordinal >= 0
                        key, count = np.unique(ordinal[hit] * n_sources + source_of[row[left[hit]]], return_counts=True)
                        left = left[~hit]
                        if len(key):
                            names = [pa.array([name], pa.string()).take(pa.array(np.zeros(len(key), np.int64))), source.dictionary.take(pa.array(key % n_sources))]
                            yield pa.RecordBatch.from_arrays([*names, pa.array(key // n_sources + base), pa.array(count)], names=["lang", "source", "ordinal", "count"])

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, ordinal long, count long")


def _p(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 (count + 5) / (total + 5 terms)), in whole numbers."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(F.lit(1_000_000_000)) * wide(count + 5), wide(total + 5 * terms))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank); see ``pair_values`` and ``term_values``.

    Null text, lang and source read as ''.  Rows that repeat are documents of
    their own; groups whose texts hold no terms take part; a language without
    kept terms has pairs of value 0 and no terms.  Other columns are ignored;
    an empty table gives an empty result.
    """
    docs = _groups(docs)
    vocabulary = build_vocabulary(stored(kept_terms(docs, min_docs)))
    counts = stored(recount(docs, vocabulary))
    groups = stored(docs.select("lang", "source").distinct())
    terms = vocabulary.groupBy("lang").agg(F.sum("n").alias("terms"))
    totals = groups.join(counts.groupBy("lang", "source").agg(F.sum("count").alias("total")), ["lang", "source"], "left").join(terms, "lang", "left")
    totals = stored(totals.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")))
    shares = stored(counts.join(totals, ["lang", "source"]).withColumn("p", _p(F.col("count"), F.col("total"), F.col("terms"))).select("lang", "source", "ordinal", "count", "p", "total", "terms"))
    return pair_values(shares, totals).unionByName(term_values(shares, vocabulary, top))


def pair_values(shares: DataFrame, totals: DataFrame) -> DataFrame:
    """Part ``pair``: per group and other source of its language, the sum of abs(p - q) over all kept terms, all ranks.

    A source's shares of one block of ordinals make a row.  Rows meet in cells
    of one block and two buckets of sources, so a cell holds at most 2 *
    BUCKET rows, and adds one number per pair of sources.
    """
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    none = F.when(F.col("terms") > 0, _p(F.lit(0), F.col("total"), F.greatest("terms", F.lit(1)))).otherwise(F.lit(0))
    sources = stored(totals.select("lang", "source", "terms", none.alias("none"), place.alias("place")))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("terms") / BLOCK), F.lit(1)) - 1)).alias("block")
    held = shares.groupBy("lang", "source", F.floor(F.col("ordinal") / BLOCK).alias("block")).agg(F.collect_list(F.struct((F.col("ordinal") % BLOCK).cast("int").alias("at"), "p")).alias("held"))
    rows = sources.select("*", blocks).join(held, ["lang", "source", "block"], "left")
    buckets = sources.groupBy("lang").agg(F.floor(F.max("place") / BUCKET).alias("last"))
    mine = F.floor(F.col("place") / BUCKET)
    rows = rows.join(buckets, "lang").select(
        "lang", "block", "place", "none", F.least(F.lit(BLOCK), F.col("terms") - F.col("block") * BLOCK).cast("int").alias("size"), F.col("held.at").alias("at"), F.col("held.p").alias("p"),
        mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other"),
    )
    cells = rows.withColumns({"x": F.least("mine", "other"), "y": F.greatest("mine", "other")}).drop("other")

    def compare(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        lang, _, x, y = key
        grid = np.repeat(cell["none"].to_numpy(np.int64)[:, None], int(cell["size"].iloc[0]), axis=1)
        for i, (at, p) in enumerate(zip(cell["at"], cell["p"], strict=True)):
            if at is not None:
                grid[i, at] = p
        side, place = cell["mine"].to_numpy(), cell["place"].to_numpy()
        out = []
        for i in np.flatnonzero(side == x):
            far = np.flatnonzero((side == y) & (place > place[i]))
            out.append(pd.DataFrame({"lang": lang, "a": place[i], "b": place[far], "value": np.abs(grid[far] - grid[i]).sum(axis=1)}))
        return pd.concat(out) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "value": []})

    sums = cells.groupBy("lang", "block", "x", "y").applyInPandas(compare, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("pair")).select("lang", "value", "pair.*")
    names = sources.select("lang", "place", "source")
    out = both.join(names.withColumnRenamed("place", "a"), ["lang", "a"]).join(names.select("lang", F.col("place").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "b"))
    return out.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def term_values(shares: DataFrame, vocabulary: DataFrame, top: int = TOP) -> DataFrame:
    """Part ``term``: per group its ``top`` kept terms that occur there with p above the language's q, by p - q, ties by ordinal."""
    whole = shares.groupBy("lang", "ordinal").agg(F.sum("count").alias("count"), F.first("terms").alias("terms"))
    totals = whole.groupBy("lang").agg(F.sum("count").alias("total"))
    q = whole.join(totals, "lang").select("lang", "ordinal", _p(F.col("count"), F.col("total"), F.col("terms")).alias("q"))
    above = shares.select("lang", "source", "ordinal", "p").join(q, ["lang", "ordinal"]).where("p > q").withColumn("value", F.col("p") - F.col("q"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ordinal"))
    best = above.withColumn("rank", rank).where(F.col("rank") <= top)
    names = vocabulary.select("lang", "base", F.posexplode("terms").alias("at", "item")).select("lang", (F.col("base") + F.col("at")).alias("ordinal"), "item")
    return best.join(names, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


#: DuckDB SQL for the rows of the query.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
spread AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
grid AS (SELECT g.lang, g.source, k.term, CAST(coalesce(n, 0) AS HUGEINT) AS n FROM spread g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM grid JOIN sizes USING (lang)),
whole AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM grid GROUP BY lang, term) JOIN sizes USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM spread a JOIN spread b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS place FROM pairs
  UNION ALL SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, CAST(place AS INT) AS rank FROM ranked WHERE part = 'pair' OR place <= 50
"""
