"""Token files, alignment of tokenizers and the divergence audit against brute force, and on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from compare import connect, rows_of
from conftest import SMALL
from floodlake.llm import align, bytetext, divergence, queries, subwords, wavelet
from floodlake.llm.frames import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = [" ", "  ", "\n", "\n\n", "a", "B", "word", "'s", "'", "1", "23", "<|endoftext|>", "<s>", "<", ">", "é", " ", "　", "\t", "!?", "...", "日本", "▁", "x-y", "<0x41>", "\x85", "ﬁ", "é", "😀", "É", "×", " ", "|"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    long = " ".join(f"w{i * 7919 % 3001}" for i in range(20_000))
    return [None, "", " ", "\n", long, "x" * 5000, *("".join(r.choice(PARTS) for _ in range(r.randrange(40))) for _ in range(1500))]


def _library(plain):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = plain
    return t


def _encoded(encoder, texts, **kw):
    out = []
    for part in bytetext.parts(pa.array(texts, pa.string())):
        ids, size = encoder.encode(subwords.pieces(*part, **kw))
        out += [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]
    return out


@pytest.mark.parametrize("marks", [False, True])
@pytest.mark.parametrize("plain", [False, True])
def test_pieces_give_the_ids_of_whole_texts(texts, plain, marks):
    want = [x.ids for x in _library(plain).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert _encoded(subwords.byte_encoder(plain=plain), texts, marks=marks) == want


def test_pieces_give_the_ids_of_whole_texts_by_sentencepiece(texts):
    some = [t for t in texts if t]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert _encoded(subwords.piece_encoder(), [f" {t}" for t in some]) == library.encode(some)


def test_encoder_that_forgets(monkeypatch, texts):
    monkeypatch.setattr(subwords, "REMEMBERED", 300)
    encoder = subwords.byte_encoder()
    for _ in range(2):
        assert [x for t in texts[6:40] for x in _encoded(encoder, [t])] == [x.ids for x in _library(False).encode_batch(texts[6:40], add_special_tokens=False)]


@pytest.mark.parametrize(("n", "kinds"), [(0, 1), (1, 1), (7, 3), (70_000, 2), (150_000, 5_000), (150_000, 70_000)])
def test_wavelet_file(n, kinds):
    r = np.random.default_rng(n)
    ids = (r.zipf(1.2, n) % kinds).astype(np.int32)
    file = wavelet.WaveletFile(wavelet.encode_shard(ids, np.array([n]), np.array([5]), np.array([1])))
    assert (file.tokens() == ids).all() and file.lengths.tolist() == [n] and file.keys.tolist() == [5]
    for place in map(int, r.integers(0, n, 20) if n else []):
        first, last = sorted(map(int, r.integers(0, n + 1, 2)))
        assert file.access(place) == ids[place] and file.count(int(ids[place]), first, last) == (ids[first:last] == ids[place]).sum()
    for token in map(int, np.unique(ids)[-3:]):
        assert file.occurrences(token) == np.flatnonzero(ids == token).tolist()
        assert file.occurrences(token, n // 3, n // 2) == [i for i in range(n // 3, n // 2) if ids[i] == token]
    assert file.count(10**6) == 0 and file.occurrences(10**6) == []
    with pytest.raises(IndexError):
        file.access(n)


def _written(spark, rows, shard):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    return wavelet.read_tokens(spark, wavelet.write_tokens(docs, shard=shard))


@pytest.mark.parametrize("shard", [50, 10**6])
def test_token_files_by_hand(spark, texts, shard):
    rows = [(i * 7 % 1009 if i % 97 else None, t, "en", "s", 0) for i, t in enumerate(texts[:300])]
    rows += [rows[8], (3, "copy", None, None, None), (3, "copy", None, None, None), (None, None, None, None, None)]
    got = sorted(_written(spark, rows, shard).collect(), key=lambda r: r.start)
    library = _library(False)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == collections.Counter((r[0], (*library.encode(r[1] or "", add_special_tokens=False).ids, 0)) for r in rows)
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1] and all(r.n_tokens == len(r.ids) for r in got)
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is None, k))


def test_token_files_of_no_rows_and_clashing_names(spark):
    assert _written(spark, [], 50).count() == 0
    more = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, ord long, mark long, n_tokens long")
    assert [(r.doc_id, r.n_tokens, len(r.ids)) for r in wavelet.read_tokens(spark, wavelet.write_tokens(more)).collect()] == [(1, 3, 3)]


def test_token_files_query(spark):
    library, at = _library(False), 0
    got = {r.doc_id: r for r in queries.op11_token_files(spark, SMALL).collect()}
    for r in table(spark, SMALL, "documents").orderBy("doc_id").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


class _ByHand:
    """Groups and links by walking both token rows."""

    def __init__(self):
        self.a, self.b = _library(True), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.bytes_a, self.bytes_b = subwords.byte_tokens(), subwords.piece_tokens()

    def __call__(self, text):
        whole = f" {text}".encode()
        a, b = ([], []) if not text else (self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text))
        if b"".join(self.bytes_a[i] for i in a) != whole or b"".join(self.bytes_b[i] for i in b) != whole:
            return 0, 0, 0, "", collections.Counter()
        ends_a, ends_b = (list(itertools.accumulate(len(t[i]) for i in ids)) for t, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        groups, x, y = [], 0, 0
        for cut in sorted({*ends_a} & {*ends_b}):
            i, j = ends_a.index(cut, x) + 1, ends_b.index(cut, y) + 1
            groups.append(f"{','.join(map(str, a[x:i]))}|{','.join(map(str, b[y:j]))}")
            x, y = i, j
        owner_a = [i for i in a for _ in range(len(self.bytes_a[i]))]
        at_a, at_b = (np.repeat(np.arange(len(ids)), [len(t[i]) for i in ids]) for t, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        links = collections.Counter((a[i], b[j]) for i, j in {*zip(at_a.tolist(), at_b.tolist(), strict=True)})
        assert len(owner_a) == len(whole)
        return len(a), len(b), len(groups), ";".join(groups), links


def _linked_by_hand(texts):
    by_hand = _ByHand()
    found = [by_hand(t) for t in texts]
    count = collections.Counter(pair for *_, links in found for pair in links)
    most = collections.defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for n_a, n_b, n_groups, spelt, links in found:
        best = sum(n for pair, n in links.items() if count[pair] == most[pair[0]])
        out.append((n_a, n_b, n_groups, sum(links.values()), best, sum(n * count[pair] for pair, n in links.items()), hashlib.sha256(spelt.encode()).hexdigest() if spelt else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [100, align.PAIRS])
def test_alignment_by_hand(spark, texts, most):
    some = [*texts[:4], *texts[5:400], "same text", "same text"]
    docs = spark.createDataFrame([(i if i % 50 else None, t, i, 2) for i, t in enumerate(some)], "doc_id long, text string, pairs long, n_a int")
    aligned = align.stored(align.align_documents(docs, digests=True))
    got = align.score_links(aligned, align.count_pairs(aligned), most)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted(_linked_by_hand(some))


def test_alignment_query(spark):
    rows = sorted(table(spark, SMALL, "documents").collect(), key=lambda r: r.doc_id)
    got = sorted(queries.op13_align_tokens(spark, SMALL).collect(), key=lambda r: r.doc_id)
    assert [tuple(r[c] for c in COLUMNS) for r in got] == _linked_by_hand([r.text for r in rows])


def test_alignment_spelt_and_empty(spark):
    docs = spark.createDataFrame([(1, "unhappiness"), (2, None)], "doc_id long, text string")
    by_hand = _ByHand()
    assert [r.groups for r in align.align_documents(docs).orderBy("doc_id").collect()] == [by_hand("unhappiness")[3], ""]
    assert align.link_documents(docs.limit(0)).count() == 0 and align.link_documents(docs.where("doc_id = 2")).first()["n_a"] == 0


def test_shared_cuts_in_long_intervals():
    r = np.random.default_rng(0)
    for n, m in ((1, 1), (1, 5), (3000, 2000), (500, 500)):
        size = 10_000
        a, b = (np.append(np.sort(r.choice(np.arange(1, size), k - 1, replace=False)), size) for k in (n, m))
        at_a, at_b = align.shared_cuts(a, b, np.array([0, 0, n]), np.array([0, 0, m]))
        assert a[at_a].tolist() == b[at_b].tolist() == np.intersect1d(a, b).tolist()
    # No shared end but the last.
    a, b = np.append(np.arange(1, 4001, 2), 4002), np.arange(2, 4003, 2)
    assert align.shared_cuts(a, b, np.array([0, len(a)]), np.array([0, len(b)]))[0].tolist() == [len(a) - 1]


def test_transducer_is_minimal_and_ordered():
    r = random.Random(1)
    terms = sorted({"".join(r.choice("abcé") for _ in range(r.randrange(1, 7))).encode() for _ in range(2000)})
    found = divergence.Transducer(terms)
    asked = [*terms, *(t + b"a" for t in terms), b"zz", b"\xc3"]
    words = next(bytetext.slices(pa.array([b" ".join(asked[:-1]).decode()]), alpha=True))
    ordinals = found.ordinals(words, np.arange(len(words.start)))
    place = {t: i for i, t in enumerate(terms)}
    assert ordinals.tolist() == [place.get(words.word(i), -1) for i in range(len(words.start))]
    # As few states as there are different sets of endings.
    ends = collections.defaultdict(set)
    for t in terms:
        for i in range(len(t) + 1):
            ends[t[:i]].add(t[i:])
    assert len(found.accept) == len({frozenset(x) for x in ends.values()})
    none = divergence.Transducer([])
    assert none.ordinals(words, np.arange(3)).tolist() == [-1] * 3


AUDIT = [(i, t, lang, source) for i, (t, lang, source) in enumerate([
    *[("Alpha beta alpha gamma", "en", "x"), ("alpha BETA delta", "en", "y"), ("beta zeta éa1éa", "en", None), ("beta alpha", "en", "z")] * 3,
    ("", "en", "empty"), (None, "en", "w"), ("only once", "fr", "x"), ("other words", "fr", "y"), ("alpha " * 500, "en", "x"), ("lone", None, None), ("alpha", None, "x"),
])]


def _audit_by_hand(rows, min_docs, top):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")), lang or "", source or "") for _, t, lang, source, *_ in rows]
    df, counts = collections.Counter(), collections.defaultdict(collections.Counter)
    for words, lang, source in docs:
        df.update((lang, w) for w in {*words})
        counts[lang, source].update(words)
    kept = collections.defaultdict(list)
    for (lang, w), n in df.items():
        if n >= min_docs:
            kept[lang].append(w)
    whole = collections.defaultdict(collections.Counter)
    for (lang, _), c in counts.items():
        whole[lang].update(c)

    def shares(c, terms):
        total = sum(c[t] for t in terms) + 5 * len(terms)
        return {t: 1 + 10**9 * (c[t] + 5) // total for t in terms}

    out = []
    for (lang, source), c in counts.items():
        p, q = shares(c, kept[lang]), shares(whole[lang], kept[lang])
        pairs = [(-sum(abs(p[t] - o) for t, o in shares(d, kept[lang]).items()), other.encode()) for (l2, other), d in counts.items() if l2 == lang and other != source]
        terms = [(q[t] - p[t], t.encode()) for t in kept[lang] if c[t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "most"), [(3, 3), (1, divergence.PASS), (99, 1)])
def test_divergence_by_hand(spark, monkeypatch, min_docs, most):
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "BUCKET", 2)
    monkeypatch.setattr(divergence.recount, "__defaults__", (most,))
    monkeypatch.setattr(divergence.build_vocabulary, "__defaults__", (2,))
    docs = spark.createDataFrame([(*r, 1, 2) for r in AUDIT], "doc_id long, text string, lang string, source string, term int, ordinal int")
    got = divergence.audit_sources(docs, min_docs, 2)
    assert sorted(tuple(r) for r in got.collect()) == _audit_by_hand(AUDIT, min_docs, 2)


def test_divergence_query_and_empty(spark):
    assert divergence.audit_sources(spark.createDataFrame([], DOCS)).count() == 0
    got = queries.op12_divergence(spark, SMALL)
    found = connect(SMALL).execute(divergence.ORACLE)
    assert rows_of(got.columns, got.collect()) == rows_of([x[0] for x in found.description], found.fetchall())
