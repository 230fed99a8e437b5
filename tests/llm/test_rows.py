"""Copies are judged by their own text where ids repeat or are null."""

from __future__ import annotations

from floodlake.llm import ngram_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _text(name, changed=""):
    return " ".join(f"{name}{i}" if i != 40 or not changed else changed for i in range(80))


def _kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_near_copy_takes_only_its_own_row(spark):
    rows = [(1, _text("a")), (7, _text("a", "x")), (7, _text("b")), (None, _text("a", "y")), (None, _text("c")), (None, ""), (None, None)]
    assert _kept(spark, rows) == sorted([rows[0], rows[2], *rows[4:]], key=repr)


def test_one_row_stays_of_near_copies_with_null_or_equal_ids(spark):
    rows = [(None, _text("a")), (None, _text("a", "x")), (3, _text("b")), (3, _text("b", "y")), (3, _text("c")), (3, _text("c")), (4, ""), (4, "")]
    got = _kept(spark, rows)
    assert len([t for i, t in got if i is None]) == 1 and [t for i, t in got if i == 4] == ["", ""]
    three = [t for i, t in got if i == 3]
    assert sorted(t[0] for t in three) == ["b", "c"] and len(got) == 5
