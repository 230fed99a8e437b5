"""N-gram Jaccard join: rare-first prefix filtering, each pair verified once.

A document is its set of 5-word shingles, hashed to 64 bits.  Documents with
equal sets are one node.  Shingles are ordered rarest first; two sets with
Jaccard similarity 0.8 or more then share one of the first
``size - ceil(0.8 * size) + 1`` shingles of each.  How often a shingle occurs is
counted in a table of ``BUCKETS`` hash buckets over all documents: it orders
shingles well enough, is the same size for any input, and any order is exact.

The prefixes are shuffled once, by shingle, and shingles of one node drop out
where they lie; shingles of very full buckets are dealt over several tasks and
looked at by an aggregation.  The rest are joined in two steps so that no group of copies is spelled out as pairs:

1. every node is paired with a few pivots per shingle; pairs that pass the filters
   and verify are links, and linked nodes merge.  Again with other pivots, while
   that finds links and the next step has more than ``CHEAP`` pairs for each node;
2. where a shingle still holds several merged groups, nodes of different groups
   are paired.  Nodes of one group need no further link, so nothing is lost.

Filters before verification: length (sizes within 0.8), position (what can
follow the shared shingle in both), and suffix: the parities of the sets' parts
in 512 hash classes, of larger sets in about as many classes as they have
shingles; classes that differ bound from below how many shingles are in one of
the sets only, so none of the filters drops a link.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext
from .frames import components, order_key, stored

#: Words of a shingle, and the similarity in per cent.
WORDS, PERCENT = 5, 80
#: Buckets of the frequency table; 4 MB as 32-bit counts.
BUCKETS = 1 << 20
#: The table is summed in so many pieces, each by a task of its own.
PIECES = 32
#: A bucket is very full beyond ``FULL`` times the mean and ``FULL_LEAST`` more; its shingles' postings are dealt to so many tasks.
FULL, FULL_LEAST, SALTS = 8, 1000, 32
#: Nodes (16 bytes each) up to which their texts are picked by a broadcast join.
BROADCAST_ROWS = 500_000
#: Turns of pairing with pivots, and pairs per node up to which the rest are looked at one by one.
MAX_TURNS, CHEAP = 6, 50
#: 64-bit words of parities for the suffix filter; larger sets have more besides.
PARITIES = 8


def _sets(w: bytetext.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hashes grouped by text, and where each text begins."""
    words = w.hashes()
    n = w.counts()
    at, size = bytetext.window_starts(w.first, WORDS)
    all_ = bytetext.shingle(words, WORDS)[at] if len(at) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(w.n_texts), size)
    few = np.flatnonzero((n > 0) & (n < WORDS))
    if len(few):
        whole = [bytetext.shingle(words[w.first[i] : w.first[i + 1]], int(n[i]))[0] for i in few]
        all_, owner = np.concatenate([all_, np.array(whole, np.uint64)]), np.concatenate([owner, few])
    order = np.lexsort((all_, owner))
    all_, owner = all_[order], owner[order]
    new = np.ones(len(all_), dtype=bool)
    new[1:] = (all_[1:] != all_[:-1]) | (owner[1:] != owner[:-1])
    all_, owner = all_[new], owner[new]
    return all_, np.searchsorted(owner, np.arange(w.n_texts + 1))


def _sum_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _parities(sets: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Whether each of the hash classes holds an odd number of a text's shingles, as 64-bit words (n, PARITIES)."""
    bits = 64 * PARITIES
    part = (bytetext.mix(sets + np.uint64(7)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(owner * bits + part, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1).view(np.int64)


def _fine(sets: np.ndarray, first: np.ndarray) -> pa.Array:
    """The same over more classes for sets larger than ``_parities`` has classes: the next power of two; null for others."""
    n = np.diff(first)
    much = n > 64 * PARITIES
    bits = np.where(much, 1 << np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64), 0)
    begin = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(n)), n)
    own = much[owner]
    owner = owner[own]
    part = (bytetext.mix(sets[own] + np.uint64(7)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(begin[owner] + part, minlength=int(begin[-1])) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays((begin // 64).astype(np.int32), pa.array(np.packbits(odd).view(np.int64)), mask=pa.array(~much))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text (doc_id, mark, n_shingles, node, parts, fine), and at the end the task's frequency table in pieces."""
    counts = np.zeros(BUCKETS, dtype=np.uint32)
    for batch in batches:
        ids, marks = batch.column("doc_id"), batch.column("mark")
        for w in bytetext.slices(batch.column("text"), lower=True):
            sets, first = _sets(w)
            counts += np.bincount((sets & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
            n = np.diff(first)
            # A sum doesn't depend on the order of the set.
            node = bytetext.mix(_sum_by_text(bytetext.mix(sets), first) + n.astype(np.uint64))
            parts = _parities(sets, np.repeat(np.arange(w.n_texts), n), w.n_texts)
            yield _survey_batch(ids.slice(w.row, w.n_texts).cast(pa.int64()), marks.slice(w.row, w.n_texts), n, node, parts, _fine(sets, first))
    used = np.flatnonzero(counts.reshape(PIECES, -1).any(axis=1))
    if len(used):
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(used), pa.int64()), *(pa.nulls(len(used), pa.int64()) for _ in range(3)), *(pa.nulls(len(used), pa.list_(pa.int64())) for _ in range(2)),
             pa.array(used.astype(np.int32)), pa.array([zlib.compress(counts.reshape(PIECES, -1)[i].tobytes(), 1) for i in used], pa.binary())],
            names=_SURVEY_NAMES,
        )


_SURVEY = "doc_id long, mark long, n_shingles long, node long, parts array<long>, fine array<long>, piece int, counts binary"
_SURVEY_NAMES = ["doc_id", "mark", "n_shingles", "node", "parts", "fine", "piece", "counts"]


def _survey_batch(ids: pa.Array, marks: pa.Array, n: np.ndarray, node: np.ndarray, parts: np.ndarray, fine: pa.Array) -> pa.RecordBatch:
    k = len(n)
    lists = pa.ListArray.from_arrays(np.arange(0, (k + 1) * PARITIES, PARITIES, dtype=np.int32), pa.array(parts.ravel()))
    return pa.RecordBatch.from_arrays(
        [ids, marks, pa.array(n.astype(np.int64)), pa.array(bytetext.signed(node)), lists, fine, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
        names=_SURVEY_NAMES,
    )


def _add_pieces(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BUCKETS // PIECES, dtype=np.int64)
    for blob in group["counts"]:
        total += np.frombuffer(zlib.decompress(blob), dtype=np.uint32)
    small = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
    return pd.DataFrame({"piece": group["piece"].iloc[:1], "counts": [zlib.compress(small.tobytes(), 1)]})


def _frequencies(survey: DataFrame) -> np.ndarray:
    """The table over all documents: 4 MB, whatever their number."""
    pieces = survey.where("piece is not null").select("piece", "counts")
    # Two steps, so that no task adds up the tables of all tasks.
    part = pieces.withColumn("g", F.pmod(F.xxhash64("counts"), F.lit(16))).groupBy("piece", "g").applyInPandas(lambda k, g: _add_pieces(g), "piece int, counts binary")
    rows = part.groupBy("piece").applyInPandas(lambda k, g: _add_pieces(g), "piece int, counts binary").collect()
    table = np.zeros((PIECES, BUCKETS // PIECES), dtype=np.uint32)
    for r in rows:
        table[r.piece] = np.frombuffer(zlib.decompress(r.counts), dtype=np.uint32)
    return table.ravel()


def prefix_length(size: np.ndarray) -> np.ndarray:
    return size - (size * PERCENT + 99) // 100 + 1


def _postings(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(token, salt, node, size, pos) for the prefix of each document's set; pos counts from 0.

    ``salt`` is 0 but for shingles of very full buckets, whose postings it deals
    over several tasks.
    """
    used = table[table > 0]
    full = FULL * (float(used.mean()) if len(used) else 0.0) + FULL_LEAST
    shared = docs.sparkSession.sparkContext.broadcast((table, full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, full = shared.value
        for batch in batches:
            for w in bytetext.slices(batch.column("text"), lower=True):
                sets, first = _sets(w)
                n = np.diff(first)
                node = bytetext.mix(_sum_by_text(bytetext.mix(sets), first) + n.astype(np.uint64))
                owner = np.repeat(np.arange(w.n_texts), n)
                order = np.lexsort((sets, counts[(sets & np.uint64(BUCKETS - 1)).astype(np.int64)], owner))
                pos = np.arange(len(sets)) - np.repeat(first[:-1], n)
                keep = pos < np.repeat(prefix_length(n), n)
                _, once = np.unique(node, return_index=True)  # copies within the slice add nothing
                alone = np.zeros(w.n_texts, dtype=bool)
                alone[once] = True
                keep &= np.repeat(alone, n)
                token, whose = sets[order][keep], node[owner[keep]]
                much = counts[(token & np.uint64(BUCKETS - 1)).astype(np.int64)] > full
                salt = np.where(much, 1 + (bytetext.mix(whose) % np.uint64(SALTS)).astype(np.int8), 0).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bytetext.signed(token)), pa.array(salt), pa.array(bytetext.signed(whose)), pa.array(n[owner[keep]].astype(np.int32)), pa.array(pos[keep].astype(np.int32))],
                    names=["token", "salt", "node", "size", "pos"],
                )

    return docs.select("text").mapInArrow(run, "token long, salt byte, node long, size int, pos int")


def _shared(postings: DataFrame) -> DataFrame:
    """(token, node, size, pos): the postings whose shingle is in the prefix of several nodes.

    All postings are shuffled once, by token and salt; whether a token has
    several nodes is then seen where its postings lie.  Only the dealt tokens
    need a further look over their salts.
    """
    own = Window.partitionBy("token", "salt")
    dealt = postings.repartition("token", "salt").withColumns({"x": F.min("node").over(own), "y": F.max("node").over(own)})
    dealt = dealt.where("salt > 0 OR x <> y").groupBy("token", "salt", "node").agg(F.min("size").alias("size"), F.min("pos").alias("pos"))
    dealt = stored(dealt)
    much = dealt.where("salt > 0")
    several = much.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("token")
    names = ["token", "node", "size", "pos"]
    return dealt.where("salt = 0").select(*names).unionAll(much.join(several, "token", "left_semi").select(*names))


def _needed(a: Column, b: Column) -> Column:
    """Shingles that sets of these sizes must share: 100 * shared >= 80 * (a + b - shared), rounded up."""
    return F.floor((PERCENT * (a + b) + (100 + PERCENT - 1)) / (100 + PERCENT))


def _possible(size_a: Column, pos_a: Column, size_b: Column, pos_b: Column) -> Column:
    """Length and position filters for a pair that meets at these positions of its prefixes."""
    length = (100 * F.least(size_a, size_b) >= PERCENT * F.greatest(size_a, size_b))
    after = F.least(size_a - pos_a, size_b - pos_b) + F.least(pos_a, pos_b)
    return length & (after >= _needed(size_a, size_b))


def _differing(a: list[Column], b: list[Column]) -> Column:
    """Classes whose parity differs: so many shingles at least are in one set only."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a[1:], b[1:], strict=True)), F.bit_count(a[0].bitwiseXOR(b[0])))


def _words(array: str) -> list[Column]:
    return [F.get(array, i) for i in range(PARITIES)]


def _finely(a: Column, b: Column) -> Column:
    """The same for the finer parities: of the larger, halves meet until both are as long."""
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) / 2), F.slice(x, F.size(x) / 2 + 1, F.size(x) / 2), lambda u, v: u.bitwiseXOR(v))
    x, y = F.when(F.size(a) > F.size(b), half(a)).otherwise(a), F.when(F.size(b) > F.size(a), half(b)).otherwise(b)
    return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, u: n + u)


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar; each is compared once."""
    left, right = (nodes.select(F.col("node").alias(s), *[F.col(c).alias(f"{c[0]}{s}") for c in ("size", "parts", "fine", "rep")]) for s in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")
    apart = F.col("sa") + F.col("sb") - 2 * _needed(F.col("sa"), F.col("sb"))
    coarse = _differing(_words("pa"), _words("pb")) <= apart
    # Similar sets differ in size by a quarter at most, so finer parities differ in length by one doubling at most.
    finer = F.col("fa").isNull() | F.col("fb").isNull() | (100 * F.least("sa", "sb") >= PERCENT * F.greatest("sa", "sb")) & (_finely(F.col("fa"), F.col("fb")) <= apart)
    likely = stored(both.where(coarse).where(finer).select("a", "b", "sa", "sb", "ra", "rb"))
    wanted = likely.select(F.col("ra").alias("doc_id"), F.col("a").alias("node")).union(likely.select("rb", "b")).distinct()
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)  # beyond that, texts and nodes are shuffled together
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"])).select(wanted["node"], "text")
    sets = texts.mapInArrow(_shingle_sets, "node long, shingles array<long>")
    x = likely.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a")
    x = x.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b")
    return x.where(F.size(F.array_intersect("xa", "xb")) >= _needed(F.col("sa"), F.col("sb"))).select("a", "b")


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of texts; of rows that share an id, only the one whose set is the node."""
    for batch in batches:
        nodes = batch.column("node")
        for w in bytetext.slices(batch.column("text"), lower=True):
            sets, first = _sets(w)
            n = np.diff(first)
            node = bytetext.signed(bytetext.mix(_sum_by_text(bytetext.mix(sets), first) + n.astype(np.uint64)))
            own = np.flatnonzero(node == nodes.slice(w.row, w.n_texts).to_numpy(zero_copy_only=False))
            keep = np.isin(np.repeat(np.arange(w.n_texts), n), own)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n[own])]).astype(np.int32), pa.array(bytetext.signed(sets[keep])))
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), lists], names=["node", "shingles"])


def cluster_documents(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, node.

    Documents are linked if 100 * shared >= 80 * united shingles; component_id
    is the smallest doc_id that links reach, node names the set of shingles
    (equal for copies).  Texts without words have no shingles and stand alone,
    as do null texts; a null id is ignored in the minimum, which is null only
    if all ids of the component are.  Rows that share an id are judged each by
    its own text.  Columns besides doc_id and text are ignored; an empty table
    gives an empty result.
    """
    return _clusters(docs).select("doc_id", "n_shingles", "component_id", "node")


def _mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _clusters(docs: DataFrame) -> DataFrame:
    """The rows of ``cluster_documents`` with mark, the hash of the text, and cluster, one node of the component, besides."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = stored(docs.withColumn("mark", _mark()).mapInArrow(_survey, _SURVEY))
    rows = survey.where("node is not null").select("doc_id", "mark", "n_shingles", "node", "parts", "fine")
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").cast("int").alias("size"), F.first("parts").alias("parts"), F.first("fine").alias("fine"))
    links = _links(docs, nodes, _frequencies(survey))
    groups = components(links)
    named = nodes.join(groups, "node").groupBy("component").agg(F.min("rep").alias("least"))
    of_node = nodes.join(groups.join(named, "component").select("node", "least", "component"), "node", "left").select("node", F.coalesce("least", "rep").alias("least"), F.coalesce("component", "node").alias("cluster"))
    out = rows.join(of_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "node", "mark", "cluster")


def _links(docs: DataFrame, nodes: DataFrame, table: np.ndarray) -> DataFrame:
    """Links (a, b) between nodes that join the same components as all similar pairs do."""
    shared = stored(_shared(_postings(docs, table)))
    few = CHEAP * nodes.count()
    open_ = shared.withColumn("component", F.col("node"))
    tried, links = [], []
    for turn in range(MAX_TURNS):
        # 1. Pivots.  What copies were made from has no rare shingles of its own, so it has a shingle nearer its
        # front than they; the other pivots are drawn by hashes of the nodes, new ones each time.
        front = F.shiftleft(F.col("pos").cast("long"), 32) + F.xxhash64("node").bitwiseAND(0xFFFFFFFF)
        orders = [front, *[F.xxhash64("node", F.lit(2 * turn + i)) for i in range(2)]]
        least = open_.groupBy("token").agg(*[F.min(o).alias(f"o{i}") for i, o in enumerate(orders)])
        is_pivot = [F.col(f"o{i}") == o for i, o in enumerate(orders)]
        chosen = is_pivot[0] | is_pivot[1] | is_pivot[2]
        pivots = open_.join(least, "token").where(chosen).select("token", F.struct("node", "size", "pos", "component").alias("p"))
        pairs = open_.join(pivots, "token").where("component <> p.component").where(_possible(F.col("size"), F.col("pos"), F.col("p.size"), F.col("p.pos")))
        fresh = _fresh(pairs.select(F.col("p.node").alias("a"), F.col("node").alias("b")), tried)
        tried.append(fresh)
        links.append(stored(_verified(fresh, docs, nodes)))
        # 2. Shingles that still hold several groups, and how many pairs of nodes of different groups those have.
        # Others are settled for good, as groups only merge.
        groups = components(_union(links))
        grouped = open_.drop("component").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        kinds = grouped.groupBy("token", "component").agg(F.count("*").alias("k"))
        mixed = stored(kinds.groupBy("token").agg(F.count("*").alias("groups"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk")).where("groups > 1"))
        open_ = stored(grouped.join(mixed.select("token"), "token", "left_semi").select("token", "component", "node", "size", "pos"))
        across = mixed.agg(F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2)).first()[0]
        if (across or 0) <= few or links[-1].isEmpty():
            break
    wide = open_.join(nodes.select("node", *[x.alias(f"k{i}") for i, x in enumerate(_words("parts"))]), "node")
    names = ["component", "node", "size", "pos", *(f"k{i}" for i in range(PARITIES))]
    side = lambda s: wide.select("token", *[F.col(c).alias(f"{c}_{s}") for c in names])
    at = lambda c, s: F.col(f"{c}_{s}")
    parities = [[at(f"k{i}", s) for i in range(PARITIES)] for s in ("a", "b")]
    met = (at("node", "a") < at("node", "b")) & (at("component", "a") != at("component", "b")) & _possible(at("size", "a"), at("pos", "a"), at("size", "b"), at("pos", "b"))
    near = _differing(*parities) <= at("size", "a") + at("size", "b") - 2 * _needed(at("size", "a"), at("size", "b"))
    a, b = side("a"), side("b")
    pairs = a.join(b, (a["token"] == b["token"]) & met & near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return _union([*links, _verified(_fresh(pairs, tried), docs, nodes)])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _fresh(pairs: DataFrame, tried: list[DataFrame]) -> DataFrame:
    """Each pair once, smaller node first, without those tried before."""
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return stored(once.join(_union(tried), ["a", "b"], "left_anti") if tried else once)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.

    Every row is judged by its own text, also where ids repeat or are null:
    null ids come last, and of rows that share the smallest id one text is
    kept.  Equal rows are kept once.  Texts without words stand alone and all
    stay.
    """
    found = stored(_clusters(docs).where("n_shingles > 0").select(order_key(F.col("doc_id")).alias("ord"), "mark", "cluster"))
    rows = found.groupBy("cluster", "ord", "mark").agg(F.count("*").alias("n"))
    kept = found.groupBy("cluster").agg(F.min(F.struct("ord", "mark")).alias("kept"))
    judged = stored(rows.join(kept, "cluster").select("ord", "mark", (F.struct("ord", "mark") == F.col("kept")).alias("stays"), "n"))
    names, key = docs.columns, [order_key(F.col("doc_id")), _mark()]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key[0].alias("ord"), key[1].alias("mark"))
    out = out.join(judged.where("NOT stays").select("ord", "mark"), ["ord", "mark"], "left_anti")
    again = judged.where("stays AND n > 1").select("ord", "mark")
    if not again.isEmpty():
        once = out.join(again, ["ord", "mark"], "left_semi").dropDuplicates(["ord", "mark"])
        out = out.join(again, ["ord", "mark"], "left_anti").unionByName(once)
    return out.select("row.*")


#: DuckDB SQL for the rows of the query.
ORACLE = r"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT row_id, doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT row_id, doc_id, count(*) AS n FROM shingles GROUP BY ALL),
shared AS (SELECT a.row_id AS ra, b.row_id AS rb, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.row_id <> b.row_id GROUP BY ALL),
links AS (SELECT ra, rb FROM shared JOIN sizes x ON x.row_id = ra JOIN sizes y ON y.row_id = rb WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
reach AS (SELECT row_id AS origin, row_id AS at_row FROM sizes UNION SELECT origin, rb FROM reach JOIN links ON ra = at_row)
SELECT words.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least_id, words.doc_id) AS component_id
FROM words LEFT JOIN sizes USING (row_id) LEFT JOIN (SELECT origin, min(doc_id) AS least_id FROM reach JOIN sizes ON at_row = row_id GROUP BY origin) ON origin = words.row_id
"""
