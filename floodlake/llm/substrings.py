"""Substring dedup by level-wise doubling of repeated windows.

Level 1 looks at windows of half the length (10 words).  It needs only anchors:
the smallest window hash of every 11 consecutive windows, which is part of
every 20-word window and is the same one wherever that window stands.  Anchors
that occur once end their windows.  Level 2 doubles: only 20-word windows
around repeated anchors are formed and counted.  Those that also start earlier
are removed.  Whole copies of a text are set aside first, as all of them goes.  ``longest_repeats`` goes on doubling, from the windows that level
2 found repeated, until no candidates survive.

Windows are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .frames import order_key, shared_folder, stored

#: Words of a window that is removed where it repeats.
WINDOW = 20
#: Words of an anchor.
ANCHOR = WINDOW // 2


def _last_minimum(values: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` values the index of the smallest, the last of equals."""
    n = len(values) - span + 1
    best = np.arange(n) + span - 1
    for back in range(span - 2, -1, -1):
        at = np.arange(n) + back
        best = np.where(values[at] < values[best], at, best)
    return best


def _anchor_of(w: bytetext.Words, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, how many each text has, each window's anchor position, and anchor hashes by position."""
    at, size = bytetext.window_starts(w.first, WINDOW)
    half = bytetext.shingle(words, ANCHOR)
    if not len(at):
        return at, size, at, half
    return at, size, _last_minimum(half, WINDOW - ANCHOR + 1)[at], half


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark, at, h): anchors of each text."""
    for batch in batches:
        for w in bytetext.slices(batch.column("text")):
            _, size, anchor, half = _anchor_of(w, w.hashes())
            owner = np.repeat(np.arange(w.n_texts), size)
            new = np.ones(len(anchor), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
            anchor, owner = anchor[new], owner[new]
            row = pa.array(w.row + owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("mark").take(row), pa.array((anchor - w.first[owner]).astype(np.int32)), pa.array(bytetext.signed(half[anchor]))],
                names=["doc_id", "mark", "at", "h"],
            )


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark, start, h, again): windows around repeated anchors, and whether the text itself has the window earlier."""
    for batch in batches:
        alive = batch.column("alive")
        values, offsets = alive.values.to_numpy(), alive.offsets.to_numpy()
        for w in bytetext.slices(batch.column("text")):
            words = w.hashes()
            at, size, anchor, _ = _anchor_of(w, words)
            if not len(at):
                continue
            live = np.zeros(len(w.start) + 1, dtype=bool)
            inside = slice(offsets[w.row], offsets[w.row + w.n_texts])
            base = np.repeat(w.first[:-1], np.diff(offsets[w.row : w.row + w.n_texts + 1]))
            live[values[inside] + base] = True
            keep = live[anchor]
            owner = np.repeat(np.arange(w.n_texts), size)[keep]
            start = at[keep]
            h = bytetext.shingle(words, WINDOW)[start]
            order = np.lexsort((start, h, owner))
            again = np.zeros(len(start), dtype=bool)
            a, b = order[1:], order[:-1]
            again[a] = (h[a] == h[b]) & (owner[a] == owner[b])
            row = pa.array(w.row + owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("mark").take(row), pa.array((start - w.first[owner]).astype(np.int32)), pa.array(bytetext.signed(h)), pa.array(again)],
                names=["doc_id", "mark", "start", "h", "again"],
            )


#: Copies (16 bytes each) up to which they are set aside by a broadcast join.
BROADCAST_ROWS = 500_000


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): where ids repeat, mark tells their texts apart; else it is 0 and costs nothing."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = docs.groupBy("doc_id").count().where("count > 1")
    mark = F.lit(0).cast("long") if again.isEmpty() else F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.withColumn("mark", mark)


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])


def _copies(keyed: DataFrame) -> DataFrame:
    """(doc_id, mark) of texts that are, whole, the text of a smaller id: every window of theirs starts earlier."""
    text = F.coalesce("text", F.lit(""))
    prints = keyed.select("doc_id", "mark", F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    firsts = prints.groupBy("a", "b").agg(F.min(order_key(F.col("doc_id"))).alias("origin"), F.count("*").alias("n")).where("n > 1")
    copies = stored(prints.join(firsts, ["a", "b"]).where(F.col("origin") < order_key(F.col("doc_id"))).select("doc_id", "mark").distinct())
    return F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies


def _windows(keyed: DataFrame, copies: DataFrame | None) -> DataFrame:
    """Levels 1 and 2: (doc_id, mark, start, h, again) of the windows around repeated anchors, without ``copies``."""
    firsts = keyed if copies is None else keyed.join(copies, _same(keyed, copies), "left_anti")
    anchors = firsts.mapInArrow(_anchors, "doc_id long, mark long, at int, h long")
    repeated = anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    alive = anchors.join(repeated, "h", "left_semi").groupBy("doc_id", "mark").agg(F.collect_list("at").alias("alive"))
    texts = keyed.join(alive, _same(keyed, alive)).select(keyed["doc_id"], keyed["mark"], "text", "alive")
    return texts.mapInArrow(_candidates, "doc_id long, mark long, start int, h long, again boolean")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, n_removed, kept) of texts with the starts of windows to remove; copies go whole."""
    for batch in batches:
        starts = batch.column("starts")
        values, offsets = starts.flatten().to_numpy(), np.concatenate([[0], np.cumsum(starts.value_lengths().fill_null(0).to_numpy())])
        copy = batch.column("copy").to_numpy(zero_copy_only=False)
        removed, kept, total = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
        for w in bytetext.slices(batch.column("text")):
            step = np.zeros(len(w.start) + 1, dtype=np.int64)
            base = np.repeat(w.first[:-1], np.diff(offsets[w.row : w.row + w.n_texts + 1]))
            begin = values[offsets[w.row] : offsets[w.row + w.n_texts]] + base
            np.add.at(step, begin, 1)
            np.add.at(step, begin + WINDOW, -1)
            n = w.counts()
            gone = (np.cumsum(step)[:-1] > 0) | np.repeat(copy[w.row : w.row + w.n_texts] & (n >= WINDOW), n)
            count = np.concatenate([[0], np.cumsum(gone)])
            removed.append(count[w.first[1:]] - count[w.first[:-1]])
            total.append(n)
            for i in range(w.n_texts):
                words = np.flatnonzero(~gone[w.first[i] : w.first[i + 1]]) + w.first[i]
                kept.append(b" ".join([w.data[a:b].tobytes() for a, b in zip(w.start[words].tolist(), w.end[words].tolist(), strict=True)]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.concatenate(total).astype(np.int64)), pa.array(np.concatenate(removed).astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed and kept, the words left, joined by one space.

    A word goes if a 20-word window over it also starts earlier: in a document
    with a smaller id, or further up in the same one; windows are judged on
    the input.  A null text has no words.  Rows that share an id are not
    earlier than one another, and null ids stand together after all others.
    Columns besides doc_id and text are ignored; an empty table gives an empty
    result.
    """
    keyed = _keyed(docs)
    copies = _copies(keyed)
    windows = _windows(keyed, copies)
    firsts = windows.groupBy("h").agg(F.min(order_key(F.col("doc_id"))).alias("origin"))
    later = windows.join(firsts, "h").where((F.col("origin") < order_key(F.col("doc_id"))) | F.col("again"))
    gone = later.groupBy("doc_id", "mark").agg(F.collect_list("start").alias("starts"))
    out = keyed.join(gone, _same(keyed, gone), "left").select(keyed["doc_id"], keyed["mark"], "text", "starts")
    flagged = copies.withColumnsRenamed({"doc_id": "i", "mark": "m"})
    out = out.join(flagged, out["doc_id"].eqNullSafe(flagged["i"]) & (out["mark"] == flagged["m"]), "left")
    return out.select("doc_id", "text", "starts", F.col("m").isNotNull().alias("copy")).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def longest_repeats(docs: DataFrame, max_levels: int = 40) -> DataFrame:
    """(doc_id, words): the longest doubled length (20, 40, 80, ...) at which a document's window repeats.

    A window of 2n words is a candidate only if its two halves of n words both
    repeat, and its hash is made of theirs, so texts aren't read again.  Ends
    when a level has no repeated window left.
    """
    shared_folder(docs.sparkSession)
    level = _windows(_keyed(docs), None).select(order_key(F.col("doc_id")).alias("ord"), "mark", "start", "h")
    length, found = WINDOW, None
    for _ in range(max_levels):
        repeated = level.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
        level = level.join(repeated, "h", "left_semi").checkpoint()
        here = level.select("ord").distinct().withColumn("words", F.lit(length).cast("long"))
        found = here if found is None else found.union(here)
        if level.isEmpty():
            break
        right = level.select("ord", "mark", (F.col("start") - length).alias("start"), F.col("h").alias("next"))
        level = level.join(right, ["ord", "mark", "start"]).select("ord", "mark", "start", F.xxhash64("h", "next").alias("h"))
        length *= 2
    return found.groupBy(F.col("ord").alias("doc_id")).agg(F.max("words").alias("words"))


#: DuckDB SQL for the rows of the query.
ORACLE = r"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(doc_id, 9223372036854775807) AS ord, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spans AS (SELECT *, min(i) OVER (PARTITION BY row_id, h) AS own FROM (SELECT row_id, ord, i, md5(array_to_string(w[i : i + 19], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM texts WHERE len(w) >= 20))),
origins AS (SELECT h, min(ord) AS origin FROM spans GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT row_id, unnest(range(i, i + 20)) AS i FROM spans JOIN origins USING (h) WHERE origin < ord OR own < i),
places AS (SELECT row_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM texts),
kept AS (SELECT row_id, count(g.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.i) FILTER (WHERE g.i IS NULL), '') AS rest FROM places p LEFT JOIN gone g USING (row_id, i) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (row_id)
"""
