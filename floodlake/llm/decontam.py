"""Benchmark decontamination with one Aho-Corasick automaton.

Questions and answers are normalised to words (A-Z folded, letters, digits and
non-ASCII characters) and cut into windows of ``WINDOW`` words.  All windows
form one automaton, and each text runs through it once.  Matches are word
positions of the normalised text; spans map them to characters of the original.

The automaton travels to every task, so its size is checked: items beyond
``MAX_WORDS`` words are dealt to several automata, each scanning the texts in
a pass of its own, and the passes' spans are united per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Consecutive words of an item that make a window.
WINDOW = 10
#: Words of items in one automaton, at most (about 2 GB of memory for every 5 million states; a word makes some six).
MAX_WORDS = 500_000
#: Words of the original text: runs of ASCII letters, digits and non-ASCII characters.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

#: Columns that the scan adds.
_FOUND = ("n_words", "n_hit", "items", "hits", "spans")


def normalise(text: str | None) -> str:
    """Words joined by single spaces."""
    return b" ".join((text or "").encode().translate(_FOLD).split()).decode()


def windows(text: str | None, size: int = WINDOW) -> set[str]:
    """The windows of one item: all runs of ``size`` words, or all its words if they are fewer."""
    words = normalise(text).split(" ") if normalise(text) else []
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class Scanner:
    """The automaton over (item_id, text) pairs."""

    def __init__(self, items: Iterable[tuple[str, str | None]], size: int = WINDOW) -> None:
        found: dict[str, set[str]] = {}
        for item, text in items:
            for window in windows(text, size):
                found.setdefault(window, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for window, ids in found.items():
            # A match ends at the space behind it; it covers so many words.
            self.automaton.add_word(f" {window} ", (window.count(" ") + 1, tuple(sorted(ids))))
        self.empty = not found
        if found:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, hit runs of words (first, last), and items found."""
        words = normalise(text)
        if not words:
            return 0, [], []
        total = words.count(" ") + 1
        if self.empty:
            return total, [], []
        padded = f" {words} "
        runs: list[list[int]] = []
        items: set[str] = set()
        at = passed = 0
        for end, (length, ids) in self.automaton.iter(padded):
            passed += padded.count(" ", at, end)
            at = end
            last = passed - 1
            first = last - length + 1
            while runs and runs[-1][1] >= first - 1:
                first = min(first, runs.pop()[0])
            runs.append([first, last])
            items.update(ids)
        return total, [(a, b) for a, b in runs], sorted(items)


def character_spans(text: str, runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as half-open spans of characters of the original text."""
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[first][0], at[last][1]) for first, last in runs]


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_words: int = MAX_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, items, hits (array of words first to last) and spans besides.

    ``keep`` names the columns of ``docs`` to return, all if it is None.
    ``spans`` are half-open ranges of characters of the original text.  Null
    and empty texts have no words and no hits; items without words never
    occur; a null item_id reads as "null".  Other columns stay as they are,
    and those of the five new names are replaced.  Rows that repeat are judged
    each for itself.  An empty table of either kind gives no hits.
    """
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD.pattern))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    shards = max(1, -(-int(items.agg(F.sum(words)).first()[0] or 0) // max_words))
    out = docs.drop(*_FOUND)
    for shard in range(shards):
        mine = items if shards == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard)
        out = _scan(out, [(r.item, r.text) for r in mine.toLocalIterator()], size, keep if shard == shards - 1 else None)
    return out


def _scan(docs: DataFrame, items: list[tuple[str, str | None]], size: int, keep: list[str] | None) -> DataFrame:
    """One pass; adds to what earlier passes found."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)
    columns = [c for c in docs.columns if c not in _FOUND and (keep is None or c in keep)]
    again = "hits" in docs.columns
    run = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
    kinds = (T.LongType(), T.LongType(), T.ArrayType(T.StringType()), run, run)
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in columns]).schema, *map(T.StructField, _FOUND, kinds)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared, size)
        pair = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            n, hit, found, hits, spans = [], [], [], [], []
            before = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True) if again else ((None, None) for _ in range(len(batch)))
            for value, (old, ids) in zip(batch.column("text"), before, strict=True):
                text = value.as_py()
                count, runs, names = scanner.scan(text)
                if old:
                    runs, names = _merged([*runs, *((x["first"], x["last"]) for x in old)]), sorted({*names, *ids})
                elif ids:
                    names = sorted({*names, *ids})
                n.append(count)
                hit.append(sum(b - a + 1 for a, b in runs))
                found.append(names)
                hits.append([{"first": a, "last": b} for a, b in runs])
                spans.append([{"first": a, "last": b} for a, b in character_spans(text, runs)] if runs else [])
            own = [batch.column(c) for c in columns]
            new = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(hits, pair), pa.array(spans, pair)]
            yield pa.RecordBatch.from_arrays([*own, *new], names=[*columns, *_FOUND])

    return docs.mapInArrow(scan, schema)


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and out[-1][1] >= first - 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


_scanners: dict[tuple[int, int], tuple[object, Scanner]] = {}


def _scanner(shared, size: int) -> Scanner:
    """One automaton for all tasks of a Python worker."""
    items = shared.value  # Spark keeps it as long as the worker lives
    key = (id(items), size)
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = (items, Scanner(items, size))
    return _scanners[key][1]


#: DuckDB SQL for the rows of the query.
ORACLE = r"""
WITH item_words AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
patterns AS (SELECT DISTINCT item, least(10, len(words)) AS n, array_to_string(words[i : i + 9], ' ') AS pat
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM item_words WHERE len(words) > 0)),
doc_words AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
places AS (SELECT row_id, words, unnest(range(1, len(words) + 1)) AS i FROM doc_words),
spots AS (SELECT row_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS pat FROM places, (SELECT DISTINCT n FROM patterns) sizes WHERE i + n - 1 <= len(words)),
hits AS (SELECT row_id, i, s.n, item FROM spots s JOIN patterns p ON s.pat = p.pat AND s.n = p.n),
words_hit AS (SELECT row_id, count(DISTINCT w) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS w FROM hits) GROUP BY row_id),
items_hit AS (SELECT row_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY row_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN words_hit USING (row_id) LEFT JOIN items_hit USING (row_id)
"""
