"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a sequence of slots of equally many words.  Slot i asks the point
frac(i * golden ratio) of the cumulative targets for its source, so every
stretch of the schedule holds the sources in proportion.  A source's documents
are shuffled by a hash of their ids and laid end to end; cut into equal blocks,
its r-th block is joined to its r-th slot.  Blocks without a slot are not
taken, so the schedule decides how much each source gives: it misses the target
by the few slots that the sequence's discrepancy leaves out, and the last block
ends where the target does.  A document takes as many words as its stretches
(one each time its source is passed through) share with the blocks taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import WORD, stored

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Number of slots the whole schedule is cut into; blocks grow with the data.
SLOTS = 1 << 16
#: frac(i * this) is the golden-ratio sequence.
GOLDEN = 0.6180339887498949


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source: weight, size, target.

    Together the sources get 150 % of all words, by weight; none gets more than
    twice its size, and what it leaves is shared again by weight.  In order of
    size over weight, a source is full if its fair share of what the fuller
    ones left exceeds twice its size; the others split the rest.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    whole = Window.partitionBy()
    fair = ranked.withColumn("weight", weight.cast("long")).withColumns({
        "before": F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "all": F.sum("source_size").over(whole),
    })
    #: Twice the words that the fuller sources leave; kept whole to compare without rounding.
    left = 3 * F.col("all") - 4 * F.col("before")
    full = 4 * F.col("source_size") * F.col("open") < F.col("weight") * left
    # Of the sources that aren't full, the first in order has the largest open weight.
    first_open = F.max(F.when(~full, F.struct("open", (left / (2.0 * F.col("open"))).alias("level")))).over(whole)
    return fair.withColumns({"full": full, "level": first_open["level"]}).select(
        "source", "weight", "source_size",
        F.when(F.col("full"), 2.0 * F.col("source_size")).otherwise(F.col("weight") * F.col("level")).alias("target"),
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, slots: int = SLOTS, seed: str = "mix", plan: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, first_slot.

    ``first_slot`` is the first slot that takes words of the document, null if
    none does.  ``plan(slot, source, rank)`` is the schedule, made by
    ``schedule`` unless one is given.

    A null text has no words and takes none; a null source is a source of its
    own, after the others.  Rows that repeat are mixed each for itself.  An
    empty table gives an empty result.  Columns besides doc_id, source and text
    are ignored.  The shuffle is by md5 of seed and id, of rows without an id by
    their text in its place, so reruns agree.

    Texts are read once: ids, sources and sizes are kept in the shared folder.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    instead = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    sized = stored(docs.select("doc_id", "source", size.alias("size"), instead.alias("instead")))
    targets = source_targets(sized, weights).withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    spans = quota_spans(targets, slots)
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), "instead")).cast("binary"))
    shuffled = sized.select("doc_id", "source", "size", key.alias("key")).withColumn("bucket", F.substring("key", 1, 3))
    # Prefix sums in two steps, so that no source lies in one task.
    buckets = shuffled.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    lead = buckets.withColumn("base", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")).drop("bucket_size")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at = shuffled.withColumn("within", F.sum("size").over(inside) - F.col("size"))
    same = at["source"].eqNullSafe(lead["source"]) & (at["bucket"] == lead["bucket"])
    placed = at.join(lead, same).select(at["doc_id"], at["source"], "size", (F.col("within") + F.col("base")).alias("start"))
    info = _small(spans.select(F.col("source").alias("s"), "source_size", "target", "quota", "block"))
    placed = placed.join(info, placed["source"].eqNullSafe(info["s"])).drop("s")
    # Blocks that each document's stretches touch, in both passes through its source.
    passes = F.explode(F.filter(F.array(F.col("start"), F.col("start") + F.col("source_size")), lambda x: (x < F.col("quota")) & (F.col("size") > 0)))
    touched = placed.select("source", "start", "size", "block", "quota", passes.alias("from"))
    touched = touched.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("quota")))
    touched = touched.select("*", F.explode(F.sequence(F.floor(F.col("from") / F.col("block")), F.floor((F.col("to") - 1) / F.col("block")))).alias("rank"))
    pieces = touched.select("source", "start", "rank", (F.least("to", (F.col("rank") + 1) * F.col("block")) - F.greatest("from", F.col("rank") * F.col("block"))).alias("words"))
    # The schedule has ``slots`` rows at any size of the input.
    ranks = F.broadcast((schedule(spans, slots) if plan is None else plan).select("slot", F.col("source").alias("s"), F.col("rank").alias("r")))
    pieces = pieces.join(ranks, F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("r")))
    taken = pieces.groupBy("source", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    taken = taken.withColumnsRenamed({"source": "s", "start": "b"})
    some = placed["size"] > 0  # rows without words share a start, and take nothing
    out = placed.join(taken, some & placed["source"].eqNullSafe(taken["s"]) & (placed["start"] == taken["b"]), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def quota_spans(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``targets`` with low, high and total of the quotas laid end to end, and the words of a block."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    spans = targets.withColumns({"high": F.sum("quota").over(order), "total": F.sum("quota").over(Window.partitionBy())})
    return spans.withColumns({"low": F.col("high") - F.col("quota"), "block": F.greatest(F.ceil(F.col("total") / slots), F.lit(1)).cast("long")})


def _small(sources: DataFrame, most: int = 10_000) -> DataFrame:
    """Broadcast a table of sources if it is counted to be small; else Spark chooses the join."""
    return F.broadcast(sources) if sources.count() <= most else sources


def schedule(spans: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The slots as (slot, source, rank): golden-ratio points through the cumulative quotas.

    ``rank`` counts a source's slots from 0.
    """
    spark = spans.sparkSession
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) * GOLDEN % 1.0).alias("point"))
    # Points and spans meet in as many cells as there are slots, so each point is compared with the sources of its cell.
    cell = lambda c: F.floor(F.try_divide(F.col(c), F.col("total")) * slots)
    cells = spans.select("source", "low", "high", "total", F.explode(F.sequence(cell("low") - 1, cell("high") + 1)).alias("cell"))
    points = points.withColumn("cell", F.floor(F.col("point") * slots))
    at = F.floor(F.col("point") * F.col("total"))
    hit = points.join(cells, "cell").where((at >= F.col("low")) & (at < F.col("high")))
    return hit.select("slot", "source", (F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1).cast("long").alias("rank"))


#: DuckDB SQL for the same rows.  The blocks with a slot lie end to end from the start, so a document's pieces are the overlap of its stretches with them.
ORACLE = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM per),
fair AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER () AS whole FROM ranked),
judged AS (SELECT *, 4 * source_size * open < weight * (3 * whole - 4 * before) AS is_full, CAST(3 * whole - 4 * before AS DOUBLE) / (2.0 * CAST(open AS DOUBLE)) AS level FROM fair),
targets AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(2.0 AS DOUBLE) * source_size ELSE weight * first_value(level) OVER (ORDER BY is_full, open DESC) END AS target FROM judged),
quotas AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM targets),
spans AS (SELECT *, CAST(sum(quota) OVER (ORDER BY source NULLS LAST) AS BIGINT) AS high, CAST(sum(quota) OVER () AS BIGINT) AS total FROM quotas),
points AS (SELECT i, (CAST(i + 1 AS DOUBLE) * CAST('0.6180339887498949' AS DOUBLE)) % CAST(1 AS DOUBLE) AS point FROM range(65536) t(i)),
slots AS (SELECT i AS slot, source, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS place FROM points JOIN spans ON floor(point * total) >= high - quota AND floor(point * total) < high),
ends AS (SELECT s.*, greatest(CAST(ceil(total / 65536) AS BIGINT), 1) AS block, least(quota, greatest(CAST(ceil(total / 65536) AS BIGINT), 1) * (SELECT count(*) FROM slots x WHERE x.source IS NOT DISTINCT FROM s.source)) AS ends FROM spans s),
placed AS (SELECT s.*, t.source_size, t.target, t.ends, t.block, CAST(sum(size) OVER (PARTITION BY s.source ORDER BY md5('mix|' || name), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS at_word
  FROM sized s JOIN ends t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, p.source, size, source_size, target,
  CAST(least(size, greatest(0, ends - at_word)) + least(size, greatest(0, ends - source_size - at_word)) AS BIGINT) AS taken, slot AS first_slot
FROM placed p LEFT JOIN slots x ON x.source IS NOT DISTINCT FROM p.source AND x.place = p.at_word // p.block AND p.size > 0 AND p.at_word < p.ends
"""
