"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A document is its lines that hold words.  A window is the shortest run of
lines that holds ``min_words`` words, reaching forward from any line or back
from any line.  The smallest line hash of each window (the last of equals) is
its fingerprint: it depends on the window alone, so two copies of a run of
``min_words`` words always share one.  Fingerprints that occur once settle
their windows at once.  Around the others the match is extended both ways, to
the windows that hold the fingerprint; windows whose whole line sequence starts
earlier (smaller doc_id, or the same document further up) are later copies.

Every line of a repeated run of ``min_words`` words lies in a window of that
run: in the one that reaches forward from it, or, near the run's end, in the
one that reaches back from the last line.  So just the lines of runs that occur
earlier are deleted, to the run's first and last line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .frames import WORD, order_key

#: Words that a repeated run of lines must hold to be deleted.
MIN_WORDS = 10


def _windows(docs: DataFrame, min_words: int) -> DataFrame:
    """(key, ord, first, last, print, sequence) per window."""
    lines = docs.select("ord", "mark", F.posexplode("lines").alias("pos", "line"))
    lines = lines.select("ord", "mark", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), F.regexp_count("line", F.lit(WORD)).alias("words")).where("words > 0")
    # Rows that repeat wholly are one document here; the windows below need no further shuffle.
    lines = lines.repartition("ord", "mark").distinct()
    run = Window.partitionBy("ord", "mark").orderBy("pos")
    lines = lines.withColumn("end", F.sum("words").over(run)).withColumn("at", F.col("end") - F.col("words"))
    ahead = Window.partitionBy("ord", "mark").orderBy("at").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("ord", "mark").orderBy("end").rangeBetween(-(min_words - 1), 0)

    def window(span: WindowSpec, words: str) -> Column:
        hashes = F.collect_list(F.struct("h", "h2")).over(span)
        return F.struct(F.min("pos").over(span).alias("first"), F.max("pos").over(span).alias("last"), F.min("h").over(span).alias("print"), F.xxhash64(hashes).alias("sequence"), F.hash(hashes).alias("sequence2"), (F.sum("words").over(span) - F.expr(words)).alias("held"))

    # A window that reaches back is a new one only if it holds enough without its last line.
    wide = lines.select("ord", "mark", F.array(window(ahead, "0"), window(back, "words")).alias("both"))
    return wide.select("ord", "mark", F.inline(F.filter("both", lambda w: w["held"] >= min_words))).drop("held")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(ord, mark, gone)``: for each document with later copies, the positions of its lines to delete."""
    windows = _windows(docs, min_words)
    prints = windows.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    near = windows.join(prints, "print", "left_semi")
    firsts = near.groupBy("sequence", "sequence2").agg(F.min(F.struct("ord", "first")).alias("origin"))
    later = near.join(firsts, ["sequence", "sequence2"]).where(F.col("origin") < F.struct("ord", "first"))
    cut = later.select("ord", "mark", F.explode(F.sequence("first", "last")).alias("pos"))
    return cut.groupBy("ord", "mark").agg(F.collect_set("pos").alias("gone"))


def _marked(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"ord": order_key(F.col("doc_id")), "mark": F.xxhash64(text), "lines": F.split(text, "\n", -1)})


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with text cleared of later repeated runs, and n_lines and n_removed besides.

    A null text counts as one empty line and stays null; blank lines hold no
    words, take no part and go only inside a deleted window.  Rows that share an id count
    as the same document, so of equal rows none is deleted for the other; null
    ids share the last place.  All other columns are kept as they are, but columns
    called n_lines or n_removed are replaced.  An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    marked = _marked(both)
    gone = repeated_lines(marked.select("ord", "mark", "lines"), min_words)
    out = marked.join(gone, ["ord", "mark"], "left")
    cut = F.coalesce("gone", F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), cut)
    kept = F.transform(stay, lambda i: F.get("lines", i))
    out = out.select("row", F.when(F.col("text").isNull() | F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.size(cut).cast("long").alias("n_removed"))
    columns: list[Column] = [F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    return out.select(*columns, "n_lines", "n_removed")


ORACLE = r"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(doc_id, 9223372036854775807) AS ord, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT row_id, ord, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM texts),
worded AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM lines),
placed AS (SELECT *, sum(words) OVER (PARTITION BY row_id ORDER BY pos) AS end_word FROM worded WHERE words > 0),
spans AS (SELECT row_id, ord, pos AS first_line, max(pos) OVER w AS last_line, sum(words) OVER w AS held, md5(array_to_string(list(line) OVER w, chr(10))) AS seq
  FROM (SELECT *, end_word - words AS at_word FROM placed) WINDOW w AS (PARTITION BY row_id ORDER BY at_word RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING)
  UNION ALL SELECT row_id, ord, min(pos) OVER w, pos, sum(words) OVER w, md5(array_to_string(list(line) OVER w, chr(10)))
  FROM placed WINDOW w AS (PARTITION BY row_id ORDER BY end_word RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)),
origins AS (SELECT seq, min({'o': ord, 'f': first_line}) AS origin FROM spans WHERE held >= 10 GROUP BY seq),
gone AS (SELECT DISTINCT row_id, unnest(range(first_line, last_line + 1)) AS pos FROM spans JOIN origins USING (seq)
  WHERE held >= 10 AND (origin.o < ord OR origin.o = ord AND origin.f < first_line)),
kept AS (SELECT row_id, count(g.pos) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS rest
  FROM lines l LEFT JOIN gone g USING (row_id, pos) GROUP BY row_id)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(rest) AS kept_sha256 FROM texts JOIN kept USING (row_id)
"""
