"""The operators against brute force, and on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import html
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import compare, connect
from conftest import SMALL
from floodlake.llm import bytetext, chat, curves, decontam, frames, gru, html_tree, lines, mixing, ngram_join, queries, substrings, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i * 7919 % 3001}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))


def _fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and very long texts, copies, near copies, repeated rows and passages."""
    base = " ".join(f"Word{i}" for i in range(80))
    near = base.replace("Word40 ", "other ")
    texts = [None, "", "  \n\t ", "one", "one two three", base, base, base.lower(), near, f"start {PASSAGE} end", f"other begin {PASSAGE} other end", LONG, "é\u00a0ß \u3000x y", "a\nb\nthis line has more than ten words in it so that counts\nc", "zz\nthis line has more than ten words in it so that counts\nyy", "x " * 60]
    out = [(i, t, "en", ["s1", "s0", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    return [*out, (None, base, None, None, None), (None, None, None, None, None), out[5]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLES[name]) == ""


def test_words_are_those_of_the_pattern(rows):
    import pyarrow as pa

    for lower in (False, True):
        texts = [r[1] for r in rows]
        got = [w.word(i).decode() for w in bytetext.slices(pa.array(texts), lower=lower) for i in range(len(w.start))]
        assert got == [x for t in texts for x in WORD.findall(_fold(t) if lower else t or "")]


def test_lookup_finds_just_its_keys():
    keys = bytetext.mix(np.arange(1000, dtype=np.uint64))
    found = bytetext.Lookup(keys).find(np.concatenate([keys[::-1], bytetext.mix(np.arange(5000, 6000, dtype=np.uint64))]))
    assert (found[:1000] == np.arange(999, -1, -1)).all() and (found[1000:] == -1).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in frames.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}
    assert frames.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def test_lm_counts_and_gain(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in gru.score_documents(docs).collect()}
    texts = {r.doc_id: [*WORD.findall(_fold(r.text)), "\0end"] for r in docs.collect()}
    c = collections.Counter(t for i, x in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for t in x)
    n, v = sum(c.values()), len(c)
    for i, x in texts.items():
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in x)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(x), sum(c[t] > 0 for t in x), n)
        assert abs(got[i].base_score - base) < 1e-6 * abs(base) + 1e-9
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_gradient():
    words = ["a", "b", "c", "d"]
    v = gru.Vocabulary(bytetext.mix(np.arange(4, dtype=np.uint64)), np.array([9.0, 5, 3, 2]), 30, 8, np.full(gru.SPELLINGS, 2.0), np.full(gru.SPELLINGS, 1.0), np.zeros(len(words), np.int64))
    net = gru.Network(v, np.random.default_rng(1).normal(0, 0.3, len(gru.Network(v).weights)))
    rng = np.random.default_rng(2)
    inputs = rng.integers(0, 4, (5, 3))
    index = rng.integers(0, 4, (5, 3))
    classes = v.classes(index.ravel(), np.zeros(15, np.int64)).reshape(5, 3)
    keep = np.ones((5, 3))
    keep[2, 1] = 0
    loss = lambda: net.learn_window(inputs, classes, index, np.zeros((3, gru.HIDDEN)), keep)[2]
    g = net.learn_window(inputs, classes, index, np.zeros((3, gru.HIDDEN)), keep)[0]
    for at in np.argsort(-np.abs(g))[:40:4]:
        was = net.weights[at]
        net.weights[at] = was + 1e-2
        up = loss()
        net.weights[at] = was - 1e-2
        down = loss()
        net.weights[at] = was
        assert abs((up - down) / 2e-2 - g[at]) < 2e-2 * max(1.0, abs(g[at])) and abs(g[at]) > 0


def test_lm_probabilities_sum_to_one():
    v = gru.Vocabulary(bytetext.mix(np.arange(3, dtype=np.uint64)), np.array([9.0, 5, 3]), 30, 8, np.full(gru.SPELLINGS, 2.0), np.full(gru.SPELLINGS, 1.0), np.zeros(3, np.int64))
    net = gru.Network(v)
    net.start_from_counts(v)
    s = np.random.default_rng(3).normal(size=(1, gru.HIDDEN)).astype(np.float32)
    assert abs(np.exp(net.log_classes(s)).sum() - 1) < 1e-5
    inside = sum(np.exp(net.log_inside(s, np.array([0]), np.array([i]))[0]) for i in range(gru.CLASS_SIZE))
    assert abs(inside - 1) < 1e-5


def test_lm_awkward_rows(spark, docs, rows):
    got = gru.score_documents(docs).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1}
    assert gru.score_documents(docs.limit(0)).count() == 0


# 2


@pytest.fixture(scope="module")
def tree_model():
    return html_tree.fit(html_tree.labelled_pages(120), rounds=150)


def test_html_marginals_by_enumeration():
    tree = html_tree.parse("<div><p>a b</p><p>c</p></div>")
    f = html_tree.forest([tree])
    rng = np.random.default_rng(0)
    theta, psi = rng.normal(size=f.features.shape[1]), rng.normal(size=(html_tree.KINDS, 2, 2))
    node, _ = html_tree.sum_product(f, theta, psi)
    n, total, want = len(f), 0.0, np.zeros(len(f))
    for code in range(2**n):
        x = [(code >> i) & 1 for i in range(n)]
        w = math.exp(sum(x[i] * (f.features[i] @ theta) for i in range(n)) + sum(psi[f.kind[i], x[f.parent[i]], x[i]] for i in range(n) if f.parent[i] >= 0))
        total += w
        want += w * np.array(x)
    assert np.allclose(node[:, 1], want / total)


def test_html_labelled_pages_held_out(tree_model):
    trees = [html_tree.parse(p) for p in html_tree.labelled_pages(80, seed=99)]
    hit = [(m >= 0.5) == html_tree.states(t) for t, m in zip(trees, tree_model.content(trees))]
    texts = [h[np.array([x is not None for x in t.text])] for t, h in zip(trees, hit)]
    assert np.concatenate(texts).mean() > 0.94


def test_html_article(spark, tree_model):
    page = '<html><body><nav><a href="/a">Home</a> <a href="/b">More</a></nav><article><h1>A  title &amp;\n more</h1><p>First <b>part<br>of it<p>Second part, a longer one that says something at length.</article><div class="comments"><p>Nice!</p></div><footer>&copy; site</footer></body></html>'
    pages = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 6), (None, "v", "", 7), (4, "w", "<<<>&#0;<p", 8), (5, "x", "<div>" * 300 + "deep", 9)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in html_tree.extract_pages(pages, tree_model).collect()}
    assert got[1].text == "A title & more\n\nFirst part of it\n\nSecond part, a longer one that says something at length."
    assert got[1].n_chars == len(got[1].text) and got[2].text == "" and got[None].text == "" and len(got) == 5
    assert html_tree.extract_pages(pages.limit(0), tree_model).count() == 0


@pytest.mark.parametrize("start", ["<html><head><title>t</title><body>", "<head><meta charset=u><title>t</title>", "<title>t</title><body>", "<html><head><title>t</title></head>", "", "<!doctype html><html><head><style>p{}</style><script>x()</script><body>"])
def test_html_tags_left_out(spark, tree_model, start):
    page = f"{start}<nav><a href='/a'>Home</a></nav><article><h1>A title</h1><p>First part of it, which goes on for a while.<p>Second part, a longer one that says something at length.</article><footer>&copy; site</footer>"
    got = html_tree.extract_pages(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), tree_model).first()
    assert got.text == "A title\n\nFirst part of it, which goes on for a while.\n\nSecond part, a longer one that says something at length."


@pytest.mark.parametrize(("inner", "text"), [
    ("<p hidden>secret<p>A line that is to be read here.<p>B line that is to be read, too.", "A line that is to be read here.\n\nB line that is to be read, too."),
    ("<p>A line <span hidden>x<p>B line that is to be read.<p>C line of some words.", "A line\n\nB line that is to be read.\n\nC line of some words."),
    ("<p>A line <span hidden>x</span>goes on to its end.<p>B line that is to be read.", "A line goes on to its end.\n\nB line that is to be read."),
    ("<ul><li hidden>no<li>First point of the list.<li>Second point of the list.</ul><p>B line that is to be read.", "First point of the list.\n\nSecond point of the list.\n\nB line that is to be read."),
    ("<div hidden><p>no<p>no<ul><li>no</div><p>B line that is to be read.", "B line that is to be read."),
    ("<div style='display: none'><div><p>no</div><p>no</div><p>B line that is to be read.", "B line that is to be read."),
    ("<p aria-hidden=true>no</p>B line that is to be read.<a hidden href=x>no</a><p>C line of some words.", "B line that is to be read.\n\nC line of some words."),
    ("<table><tr><td hidden>no<td>A cell that is to be read.<tr hidden><td>no<td>no<tr><td>Another cell to be read.</table>", "A cell that is to be read.\n\nAnother cell to be read."),
    ("<svg><path/><p>no</svg><p>B line that is to be read.<br hidden>And more of it.", "B line that is to be read. And more of it."),
])
def test_html_hidden_elements(spark, inner, text):
    """What hides ends with the element, also where its end tag is left out."""
    tree = html_tree.parse(f"<article><h1>A title</h1>{inner}</article><footer>Last words</footer>")
    assert [t for t in tree.text if t is not None] == ["A title", *text.split("\n\n"), "Last words"]


def test_html_repeated_and_very_long_pages(spark, tree_model):
    page = "<nav><a href='/a'>Home</a></nav><article><h1>A title</h1>" + "".join(f"<p>Line {i} of it, which goes on for a while.<span hidden>x" for i in range(20_000)) + "</article><footer>&copy; site</footer>"
    rows = [(1, "u", page), (2, "u", "<article><p>One line that goes on for a while.</article>"), (2, "u", "<article><p>One line that goes on for a while.</article>")]
    got = html_tree.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), tree_model).collect()
    assert {r.page_id: r.text for r in got}[1] == "\n\n".join(["A title", *(f"Line {i} of it, which goes on for a while." for i in range(20_000))])
    assert [r.text for r in got if r.page_id == 2] == ["One line that goes on for a while."] * 2


def _article_by_pattern(page):
    """The text of a page's article element, by patterns alone."""
    inner = re.search(r"<article[^>]*>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"<!--.*?-->|<(script|style|aside|form|figure|nav)\b.*?</\1>", "", inner, flags=re.S)
    parts = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|section|blockquote|pre|table|tr|td|th|header|footer|dl|dt|dd)\b[^>]*>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x))).split()) for x in parts]
    return "\n\n".join(t for t in texts if t)


def test_html_query_gives_the_articles(spark):
    pages = {r.page_id: r.html for r in frames.table(spark, SMALL, "pages").collect()}
    got = {r.page_id: r for r in queries.op2_extract_html(spark, SMALL).collect()}
    known = {i: _article_by_pattern(h) for i, h in pages.items() if h and len(re.findall("<article", h)) == 1}
    right = [got[i].text == t for i, t in known.items()]
    assert set(got) == set(pages) and all(r.n_chars == len(r.text) for r in got.values())
    assert len(right) >= 10 and np.mean(right) >= 0.95, [(i, got[i].text[:200], t[:200]) for i, t in known.items() if got[i].text != t][:2]


# 3


def _lines_by_hand(rows):
    """(removed positions per row) by comparing all runs of lines with 10 words or more; blank lines go inside a shortest such run."""
    runs = collections.defaultdict(list)
    for k, r in enumerate(rows):
        parts = [(i, x, len(WORD.findall(x))) for i, x in enumerate((r[1] or "").split("\n"))]
        parts = [p for p in parts if p[2]]
        order = frames.LAST if r[0] is None else r[0]
        for a in range(len(parts)):
            n = 0
            for b in range(a, min(len(parts), a + 60)):
                n += parts[b][2]
                if n >= lines.MIN_WORDS:
                    least = n - parts[a][2] < lines.MIN_WORDS or n - parts[b][2] < lines.MIN_WORDS
                    runs[tuple(p[1] for p in parts[a : b + 1])].append((order, parts[a][0], k, [p[0] for p in parts[a : b + 1]], least))
    gone = collections.defaultdict(set)
    for places in runs.values():
        first = min(p[:2] for p in places)
        for order, start, k, at, least in places:
            if (order, start) > first:
                gone[k].update(range(at[0], at[-1] + 1) if least else at)
    return gone


def test_line_runs_go_to_their_ends(spark):
    long = " ".join(f"w{i}" for i in range(12))
    run = f"head\n{long}\nshort tail\nend"
    rows = [(1, f"own line here\n{run}\nafter"), (2, f"before this\n{run}\nother"), (3, run), (4, f"{long} more\nshort tail\nend"), (5, f"x\n\n{long}\n\nshort tail\nnew {long}\nend")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got[2] == "before this\nother" and got[3] == "" and got[1] == rows[0][1] and got[4] == rows[3][1]
    assert got[5] == f"x\n\nnew {long}\nend"


def test_line_dedup_by_hand(docs, rows):
    got = sorted(((r.doc_id, r.n_removed, r.text) for r in lines.dedup_lines(docs.withColumn("gone", F.lit(1)).withColumn("lines", F.lit("x"))).collect()), key=repr)
    gone = _lines_by_hand(rows)
    want = sorted(((r[0], len(gone[k]), r[1] if not gone[k] else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone[k])) for k, r in enumerate(rows)), key=repr)
    assert got == want
    assert lines.dedup_lines(docs.limit(0)).count() == 0


# 4


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    x[4000:4100] = x[50]
    table = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(7000, None), (7050, [0.0] * 16), (7100, [float("nan")] * 16), (7150, [1.0, None] + [0.0] * 14), (None, [1.0] * 16), (7200, [1.0, 2.0])]
    frame = spark.createDataFrame([*table, *odd, table[100]], "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = collections.defaultdict(list)
    for r in curves.nearest(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = total = 0
    for q in range(0, 6000, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        want = sorted(range(6000), key=lambda i: (-s[i], i))[:5]
        assert len(got[q]) == 5 and q not in got[q]
        hit += len(set(want) & set(got[q]))
        total += 5
    assert hit / total >= 0.9 and set(got) == set(range(0, 6000, 50))
    assert got[50] == [4000, 4001, 4002, 4003, 4004]
    assert curves.nearest(frame.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_nearest_on_the_given_vectors(spark, scale, monkeypatch):
    """Small tables go through the same curves as large ones: a query sees a part of the ranges of every ordering."""
    made = []
    fit = curves.Index.__init__

    def watched(self, sample, ranges, orderings):
        made.append((ranges, orderings))
        fit(self, sample, ranges, orderings)

    monkeypatch.setattr(curves.Index, "__init__", watched)
    sf_dir = f"/root/testdata/{scale}"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = collections.defaultdict(set)
    for r in queries.op4_nearest(spark, sf_dir).collect():
        got[r.query_id].add(r.vec_id)
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = np.round(x @ x[q], 12)
        s[q] = -9
        want = {int(ids[i]) for i in np.lexsort((ids, -s))[:5]}
        hit += len(want & got[ids[q]])
        total += 5
    assert hit / total >= 0.9
    ranges, orderings = made[0]
    assert orderings == curves.ORDERINGS and ranges > 2 * curves.BESIDE + 1


def test_hilbert_curve_is_continuous():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = curves.hilbert(cells, 3)
    assert sorted(key) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# 5


@pytest.mark.parametrize("text", ["", "\\", "\\\\###", "### Assistant: </turn> ok", "\\### Assistant: </turn> ok", "####", "</turn>\n", "a\n### b\n</turn", "\uf8ff\ue000"])
def test_chat_round_trip(text):
    turns = [("user", text), ("assistant\n###", text), ("assistant", text)]
    found = chat.locate(chat.turn_template, turns)
    assert chat.read_back(found.output) == turns and not found.rewrites
    assert [chat.unescape(found.output[c:d]) for _, _, c, d in found.spans] == [text] * 3


def test_chat_template_that_rewrites_history():
    def last_only(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 else '...'}" for i, (r, t) in enumerate(turns))

    found = chat.locate(last_only, [("user", "hello"), ("assistant", "hi")])
    assert found.rewrites and not found.spans


def test_chat_awkward_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, None, None, None), (2, 0, "assistant", None)]
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest() and got[2].loss_chars == 0
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest() and got[None].n_turns == 1


def test_chat_roles_that_hold_the_probe():
    turns = [("\uf8ff\ue000\uf8ff", "\uf8ff\ue000\ue000\uf8ff"), ("assistant", "\uf8ff\ue000\uf8ff said \uf8ff\ue000\ue000\uf8ff")] * 2
    found = chat.locate(chat.turn_template, turns)
    assert not found.rewrites and [chat.unescape(found.output[c:d]) for _, _, c, d in found.spans] == [t for _, t in turns]


def test_chat_empty_table_many_turns_and_long_texts(spark):
    frame = spark.createDataFrame([(1, i, ["user", "assistant"][i % 2], f"turn {i}") for i in range(500)] + [(2, 0, "assistant", LONG)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(frame)).collect()}
    assert got[1].n_turns == 500 and got[1].loss_sha256 == hashlib.sha256("".join(f"turn {i}" for i in range(1, 500, 2)).encode()).hexdigest()
    assert got[2].loss_chars == len(LONG)
    assert chat.digests(chat.format_conversations(frame.limit(0))).count() == 0


# 6


def _sets(rows):
    out = []
    for r in rows:
        w = WORD.findall(_fold(r[1]))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def _components_by_hand(rows):
    sets = _sets(rows)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    return sorted(((r[0], len(s), least[g]) for r, s, g in zip(rows, sets, group)), key=repr)


def test_jaccard_components_by_hand(spark, docs, rows):
    cols = lambda d: sorted(((r.doc_id, r.n_shingles, r.component_id) for r in d.collect()), key=repr)
    assert cols(ngram_join.cluster_documents(docs.withColumn("node", F.lit(1)))) == _components_by_hand(rows)
    rng = np.random.default_rng(6)
    many = []
    for g in range(12):  # groups whose members are near the threshold, around it on both sides
        base = [f"g{g}w{i}" for i in range(60 + 5 * g)]
        for k in range(14):
            text = list(base)
            for at in rng.integers(0, len(text), rng.integers(0, 3)):
                text[at] = f"x{g}.{k}"
            many.append((1000 + g * 14 + k, " ".join(text), "en", "s", 0))
    assert cols(ngram_join.cluster_documents(spark.createDataFrame(many, DOCS))) == _components_by_hand(many)
    assert ngram_join.cluster_documents(docs.limit(0)).count() == 0


# 7


def test_toxicity_learns_and_ignores_other_columns(spark):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{k}" for k in rng.integers(0, 300, 40)]
        toxic = i % 5 == 3
        if toxic:
            for at in rng.integers(0, 40, 4):
                words[at] = ["scum", "idiot", "trash"][at % 3]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None, None, None, None), (5000, "", None, None, 0)], DOCS)
    model = toxicity.fit(*toxicity.training_rows(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    got = {r.doc_id: r for r in toxicity.score_texts(docs.withColumn("score", F.lit(1)), model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == labels[i][2] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].score == got[5000].score
    none = toxicity.fit(*toxicity.training_rows(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert {r.score for r in toxicity.score_texts(docs, none).collect()} == {0.5}


def _kneser_ney_by_hand(texts, d=toxicity.DISCOUNT):
    """A function of (left, word) for each value of CHANCE: the difference of the interpolated log-likelihoods, by dictionaries."""
    count = [collections.Counter(), collections.Counter()]
    for text, toxic in texts:
        w = WORD.findall(_fold(text))
        count[toxic].update(zip(["", *w[:-1]], w))
    pairs = set(count[0]) | set(count[1])
    unit = lambda w, j: (j, w.encode()[: toxicity.LEVELS[j]] if j else w.encode())
    levels = range(len(toxicity.LEVELS))
    k, kc = collections.Counter(), [collections.Counter(), collections.Counter()]
    for left, w in pairs:
        for j in levels:
            k[unit(w, j)] += 1
            for c in (0, 1):
                kc[c][unit(w, j)] += count[c][left, w] > 0
    whole, per = len(pairs), [sum(v for u, v in kc[c].items() if u[0] == 0) for c in (0, 1)]
    spare = [[sum(min(v, d) for u, v in kc[c].items() if u[0] == j) for j in levels] for c in (0, 1)]

    def z(n0, n1, h0, h1):
        e = (n0 + n1) * h1 / max(h0 + h1, 1)
        return abs(n1 - e) / math.sqrt(e + 1)

    def p(c, w, j):
        last = j == len(levels) - 1
        base = k[unit(w, j)] / whole if last else p(c, w, j + 1) * k[unit(w, j)] / k[unit(w, j + 1)]
        return max(kc[c][unit(w, j)] - d, 0) / per[c] + spare[c][j] / per[c] * base

    def ratio(w, j, chance):
        if j == len(levels):
            return 0.0
        low = ratio(w, j + 1, chance)
        if not k[unit(w, j)]:
            return low
        s = z(kc[0][unit(w, j)], kc[1][unit(w, j)], *per) ** 4
        s /= s + chance**4
        return s * math.log(p(1, w, j) / p(0, w, j)) + (1 - s) * low

    by_left = [collections.defaultdict(list) for _ in (0, 1)]
    for c in (0, 1):
        for (left, _), n in count[c].items():
            by_left[c][left].append(n)

    def pair(left, w, chance):
        low = ratio(w, 0, chance)
        if (left, w) not in pairs:
            return low
        h, n = [sum(by_left[c][left]) for c in (0, 1)], [count[c][left, w] for c in (0, 1)]
        q = [(max(n[c] - d, 0) + sum(min(x, d) for x in by_left[c][left]) * p(c, w, 0)) / h[c] if h[c] else p(c, w, 0) for c in (0, 1)]
        s = min(z(*n, *h), 2 * z(kc[0][unit(w, 0)], kc[1][unit(w, 0)], *per)) ** 4
        s /= s + (toxicity.OF_PAIRS * chance) ** 4
        return s * math.log(q[1] / q[0]) + (1 - s) * low

    return pair


def test_toxicity_models_by_dictionaries(spark):
    import pyarrow as pa

    rng = np.random.default_rng(17)
    texts = []
    for i in range(400):
        words = [["alpha", "beta", "gamma", "deltas", "deltoid", "Über", "epsilon"][k] + ["", "s", "ing"][k % 3] for k in rng.integers(0, 7, 12)]
        if i % 3 == 0:
            for at in rng.integers(0, 12, 3):
                words[at] = ["idiotic", "idiots", "you idiot", "scumbag"][at % 4]
        texts.append((" ".join(words), int(i % 3 == 0)))
    frame = spark.createDataFrame(texts, "text string, toxic int")
    counted = frame.mapInArrow(toxicity._pairs, "toxic int, left long, word long, n long")
    pairs = counted.groupBy("left", "word").agg(*[F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)])
    model = toxicity.smooth(pairs, frame.mapInArrow(toxicity._stems, "word long, stems array<long>").dropDuplicates(["word"]), 400_000, toxicity.DISCOUNT)
    want = _kneser_ney_by_hand(texts)
    said = ["you idiot alpha betas unheard idiotically idiots scumbag", "Über you", "deltoiding idiots idiots"]
    for i, chance in enumerate(toxicity.CHANCE):
        for text, w in zip(said, [next(bytetext.slices(pa.array([t]), lower=True)) for t in said]):
            words = WORD.findall(_fold(text))
            by_hand = [want(left, x, chance) for left, x in zip(["", *words[:-1]], words)]
            assert np.allclose(model.at(i).ratios(w), by_hand, atol=2 * toxicity.LEAST), text
    assert want("you", "idiot", 4.0) > 0.05 > abs(want("alpha", "unheard", 4.0))


def test_toxicity_awkward_rows(spark, docs, rows):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(16)] + [(3, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(*toxicity.training_rows(docs, labels))
    got = toxicity.score_texts(docs.withColumn("mean", F.lit("x")), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1 and len({r.score for r in got if r.doc_id == 5}) == 1
    empty = toxicity.fit(*toxicity.training_rows(docs.limit(0), labels))
    assert toxicity.score_texts(docs.limit(0), empty).count() == 0


# 8


def test_leaks_and_their_places(spark, docs, rows):
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "One TWO, three"), (None, "x x"), (5, "?!")], "item_id long, text string")
    got = {}
    for shard_words in (decontam.MAX_WORDS, 20):
        found = decontam.find_leaks(docs.withColumn("items", F.lit(1)), bench, max_words=shard_words).collect()
        got[shard_words] = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], [(s.first, s.last) for s in r.spans]) for r in found), key=repr)
    assert got[20] == got[decontam.MAX_WORDS]
    by = {r[0]: r for r in got[20]}
    assert by[9][2:4] == (60, ["1"]) and rows[9][1][slice(*by[9][4][0])] == PASSAGE
    assert by[4][2:4] == (3, ["3"]) and by[15][2:4] == (60, ["null"]) and by[0][1:4] == (0, 0, [])
    text = "Start One, two THREE end"
    spans = decontam.find_leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).first().spans
    assert [text[s.first : s.last] for s in spans] == ["One, two THREE"]


# 9


def _repeats_by_hand(rows):
    places = collections.defaultdict(list)
    words = [WORD.findall(r[1] or "") for r in rows]
    for k, w in enumerate(words):
        for i in range(len(w) - 19):
            places[tuple(w[i : i + 20])].append((k, i))
    gone = [set() for _ in rows]
    order = lambda k: frames.LAST if rows[k][0] is None else rows[k][0]
    for at in places.values():
        for k, i in at:
            if any(order(j) < order(k) or j == k and s < i for j, s in at):
                gone[k].update(range(i, i + 20))
    return sorted(((r[0], len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for r, w, g in zip(rows, words, gone)), key=repr)


def test_repeats_by_hand(docs, rows):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs.withColumn("starts", F.lit(1))).collect()), key=repr)
    assert got == _repeats_by_hand(rows)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_doubling_goes_on(docs):
    got = {r.doc_id: r.words for r in substrings.longest_repeats(docs.where("doc_id IN (5, 6, 9, 10, 11)")).collect()}
    assert got[5] == got[6] == 80 and got[9] == got[10] == 40


# 10


def test_mix_follows_targets(spark, docs, rows):
    got = mixing.mix_sources(docs.withColumn("target", F.lit("x")), slots=256).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        # The schedule leaves out a few slots' words at most.
        block = max(1, -(-round(sum({x.source: x.target for x in got}.values())) // 256))
        assert -3 * block <= sum(r.taken for r in mine) - mine[0].target <= 1
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(docs, slots=256).collect()))
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mix_sources(docs.where("doc_id < 3")).agg(F.sum("taken")).first()[0] == 0


def _spans(spark):
    sized = spark.createDataFrame([("a", 700), ("b", 200), (None, 100)], "source string, size long")
    return mixing.quota_spans(mixing.source_targets(sized).withColumn("quota", F.floor(F.col("target") + 0.5).cast("long")), 1000)


def test_schedule_is_even(spark):
    spans = _spans(spark)
    slots = mixing.schedule(spans, 1000).orderBy("slot").collect()
    want = {r.source: r.quota / r.total for r in spans.collect()}
    assert abs(sum(want.values()) - 1) < 1e-9 and [r.slot for r in slots] == list(range(1000))
    for s, share in want.items():
        mine = [r for r in slots if r.source == s]
        assert [r["rank"] for r in mine] == list(range(len(mine)))
        for first in range(0, 1000, 100):
            assert abs(sum(first <= r.slot < first + 100 for r in mine) - 100 * share) < 4


def test_schedule_decides_what_is_taken(spark, docs):
    """Without slots nothing is taken; a source's words follow the number of its slots."""
    none = mixing.mix_sources(docs, plan=spark.createDataFrame([], "slot long, source string, rank long"))
    assert none.agg(F.sum("taken")).first()[0] == 0 and none.where("first_slot IS NOT NULL").count() == 0
    plan = spark.createDataFrame([(0, "s0", 0), (1, "s0", 1), (2, "s1", 0)], "slot long, source string, rank long")
    got = mixing.mix_sources(docs, slots=256, plan=plan)
    quota = {r.source: round(r.target) for r in got.select("source", "target").distinct().collect()}
    block = -(-sum(quota.values()) // 256)
    assert {r.source: r.n for r in got.groupBy("source").agg(F.sum("taken").alias("n")).collect()} == {"s0": min(2 * block, quota["s0"]), "s1": min(block, quota["s1"]), None: 0}
    assert mixing.mix_sources(docs, slots=7).agg(F.sum("taken")).first()[0] != mixing.mix_sources(docs, slots=64).agg(F.sum("taken")).first()[0]


def test_mix_spreads_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, f"{i} b c", "s") for i in range(50)] + [(None, "same", "s")] * 3, "doc_id long, text string, source string")
    runs = [sorted((r["size"], r.taken, r.first_slot or -1) for r in mixing.mix_sources(docs.repartition(n)).collect()) for n in (1, 3)]
    assert runs[0] == runs[1] and len({x[2] for x in runs[0]}) > 40
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert compare(mixing.mix_sources(docs), con, mixing.ORACLE) == ""


# The pipeline


def test_pipeline_stages(spark):
    docs = frames.table(spark, SMALL, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = frames.stored(stage(spark, before, SMALL))
        assert after.columns == docs.columns and after.count() <= before.count(), name
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= ids
        rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in before.collect()]
        if name == "near_dedup":
            by = collections.defaultdict(set)
            for doc_id, n, component in _components_by_hand(rows):
                by[component if n else (doc_id,)].add(doc_id)
            assert kept == {min(g) for g in by.values()}
        if name == "line_dedup":
            gone = _lines_by_hand(rows)
            want = {r[0]: "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone[k]) for k, r in enumerate(rows)}
            assert {r.doc_id: r.text for r in after.collect()} == {i: t for i, t in want.items() if i in kept}
        if name == "decontamination":
            clean = connect(SMALL)
            clean.register("kept_before", before.select("doc_id", "text").toArrow())
            found = clean.execute(re.sub(r"\bdocuments\b", "kept_before", decontam.ORACLE)).to_arrow_table().to_pylist()
            assert kept == {r["doc_id"] for r in found if not r["contaminated"]} and len(found) == len(ids)
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SMALL)
    assert last.count() == before.count() > 50
    con = connect(SMALL)
    con.register("kept_before", before.select("doc_id", "source", "text").toArrow())
    assert compare(last, con, re.sub(r"\bdocuments\b", "kept_before", mixing.ORACLE)) == ""


def test_pipeline_stages_on_awkward_rows(spark, docs, rows):
    """Nulls, empty and long texts, repeated rows and other columns; and no rows at all."""
    more = docs.withColumn("size", F.lit("own")).withColumn("n_hit", F.lit(1.5))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, more, SMALL)
        assert stage(spark, more.limit(0), SMALL).count() == 0, name
        if name == "mixing":
            assert out.count() == len(rows)
            continue
        assert out.columns == more.columns, name
        kept = collections.Counter((r.doc_id, r.text) for r in out.collect())
        assert kept[0, None] == 1 and kept[1, ""] == 1 and kept[11, LONG] == 1, name
        if name == "near_dedup":
            assert sum(n for (i, _), n in kept.items() if i in (5, 6, 7, 8)) == 1 and kept[5, rows[5][1]] == 1
        else:
            assert all((r[0], r[1]) in kept for r in rows if not r[1] or len(r[1]) < 20), name


def test_other_columns_change_nothing(spark, docs, rows):
    """Columns named as the operators' own change no row and no value, and come through the stages as they were."""
    names = ["n_lines", "n_removed", "gone", "kept", "row", "ord", "mark", "lines", "length", "mean", "most", "score", "predicted", "n_words", "n_hit", "items", "hits", "spans", "size", "target", "taken", "key", "start", "node", "component_id", "n_shingles", "instead", "bucket", "rank"]
    own = {c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in names}
    more = docs.withColumns(own)
    for name, stage in corpus_pipeline.STAGES:
        plain, with_more = stage(spark, docs, SMALL), stage(spark, more, SMALL)
        if name == "mixing":
            assert sorted(map(repr, plain.collect())) == sorted(map(repr, with_more.collect()))
            continue
        assert with_more.columns == more.columns, name
        got = [r.asDict() for r in with_more.collect()]
        assert sorted(repr(tuple(r[c] for c in docs.columns)) for r in got) == sorted(map(repr, map(tuple, plain.collect()))), name
        assert all(r[c] == f"{c} {'' if r['doc_id'] is None else r['doc_id']}" for r in got for c in names), name
    for f in (lines.dedup_lines, substrings.remove_repeats, ngram_join.cluster_documents, mixing.mix_sources):
        want = f(docs)
        new = [c for c in want.columns if c not in docs.columns]
        assert sorted(map(repr, want.select("doc_id", *new).collect())) == sorted(map(repr, f(more).select("doc_id", *new).collect())), f.__name__
