"""Small helpers that the operators share: shared storage, row keys, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Where a null doc_id stands in the order of documents: after all others.
LAST = (1 << 63) - 1
#: Links that one task of ``components`` takes, about.
LINKS_OF_A_TASK = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and all runs on one machine, a local one is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='floodlake-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, *partitions: str) -> DataFrame:
    """Write a table to the shared folder and read it again, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/floodlake-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def order_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, the smallest node naming each.

    Large-star and small-star rounds: every node hooks to the smallest
    neighbour of its neighbourhood, so chains shorten by half or better and a
    round never makes more rows than there are links.  Each round is cut off
    with ``checkpoint()``; only the number of changed links reaches the driver.
    """
    shared_folder(edges.sparkSession)
    links = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct().checkpoint()
    mark = links.agg(F.count("*"), F.sum(F.hash("hi", "lo").cast("long"))).first()
    for _ in range(max_rounds):
        # Few links need few tasks: each round has several small shuffles.
        tasks = 1 + mark[0] // LINKS_OF_A_TASK
        links = links.coalesce(tasks)
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(links.select("lo", "hi")).coalesce(tasks)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(tasks)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("hi").agg(F.min("lo").alias("m")).coalesce(tasks)
        small = large.join(low, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        links = small.select("e.hi", "e.lo").where("hi <> lo").coalesce(tasks).distinct().coalesce(tasks).checkpoint()
        now = links.agg(F.count("*"), F.sum(F.hash("hi", "lo").cast("long"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
