"""Two streams: newest scene per id as catalogue pages arrive, and newest state per job."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Parts of the table of scenes, by a hash of request and scene; a batch rewrites only the parts that it touches.
BUCKETS = 64


def _versions(spark: SparkSession, target: str, epoch: int) -> dict[int, int]:
    """The batch that last wrote each bucket, as of a batch; as many entries as there are buckets at most."""
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{target}/versions/v{epoch}").collect()}


def scene_intake(pages: DataFrame, target: str, checkpoint: str, buckets: int = BUCKETS):
    """Start a stream that keeps the newest item per request and scene under ``target``.

    Every batch writes the buckets it touches to a folder of its own, then the
    table of each bucket's last batch; a batch that is run again after a
    failure overwrites only itself.  Returns the query; ``latest_scenes`` reads
    the newest version.  A target keeps its number of buckets.
    """

    def upsert(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("request_id", "scene_id"), F.lit(buckets)).cast("int").alias("bucket")
        versions = _versions(spark, target, epoch - 1) if epoch > 0 else {}
        touched = [r.bucket for r in batch.select(bucket).distinct().collect()]
        paths = [f"{target}/v{versions[b]}/bucket={b}" for b in touched if b in versions]
        known = spark.read.schema(batch.schema).parquet(*paths).unionByName(batch) if paths else batch
        newest = _newest(known, ["request_id", "scene_id"], "ingest_seq")
        newest.select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v{epoch}")
        now = versions | dict.fromkeys(touched, epoch)
        spark.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{target}/versions/v{epoch}")

    return pages.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_scenes(spark: SparkSession, target: str, epoch: int, schema: str) -> DataFrame:
    """The table as of a batch, with the columns of ``schema``."""
    paths = [f"{target}/v{v}/bucket={b}" for b, v in _versions(spark, target, epoch).items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


#: How far behind the newest update one may arrive.
LATENESS = "1 hour"
_STATE = "job_id string, status string, stage string, started_at timestamp, seq long, first_at timestamp, last_at timestamp"


def latest_job_state(log: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Stream of what changed: per job of a batch its newest update, when it began and when it was last heard of.

    Updates of ``log(job_id, stage, started_at, seq, status)`` that lie before
    the watermark are dropped; ``run_to_end`` counts them.  A job's state is
    kept until the watermark passes its last update, and then evicted: the
    table that ``run_to_end`` writes keeps what was known of it.  A null job_id
    or started_at is no update.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get if state.exists else None
        for rows in batches:
            for r in rows.itertuples(index=False):
                one = (r.us, r.seq, r.status, r.stage)
                newest = one if known is None else max(known[:4], one, key=lambda x: x[:2])
                known = (*newest, min(known[4], r.us), max(known[5], r.us)) if known else (*one, r.us, r.us)
        state.update(known)
        state.setTimeoutTimestamp(max(known[5] // 1000, state.getCurrentWatermarkMs() + 1))
        us, seq, status, stage, first, last = known
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "stage": [stage], "us": [us], "seq": [seq], "first_us": [first], "last_us": [last]})

    marked = log.where("job_id IS NOT NULL AND started_at IS NOT NULL").withWatermark("started_at", lateness)
    rows = marked.select("job_id", "stage", "status", "seq", "started_at", F.unix_micros("started_at").alias("us"))
    changed = rows.groupBy("job_id").applyInPandasWithState(
        update, "job_id string, status string, stage string, us long, seq long, first_us long, last_us long", "us long, seq long, status string, stage string, first_us long, last_us long", "update", GroupStateTimeout.EventTimeTimeout
    )
    at = lambda c: F.timestamp_micros(c)
    return changed.select("job_id", "status", "stage", at("us").alias("started_at"), "seq", at("first_us").alias("first_at"), at("last_us").alias("last_at"))


class Run(NamedTuple):
    """What is known of each job, and how many updates the run dropped as late."""

    states: DataFrame
    late: int


def run_to_end(changed: DataFrame, target: str, checkpoint: str, buckets: int = BUCKETS) -> Run:
    """Run the stream of ``latest_job_state`` over all that is there.

    A batch rewrites just the buckets of jobs that it touches and then says
    which batch holds each bucket, so a batch that is run again after a failure
    changes nothing else.  A run that finds nothing new returns what earlier
    ones have written.
    """

    def upsert(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int").alias("bucket")
        versions = _versions(spark, target, epoch - 1) if epoch > 0 else {}
        batch = batch.persist()
        touched = [r.bucket for r in batch.select(bucket).distinct().collect()]
        paths = [f"{target}/v{versions[b]}/bucket={b}" for b in touched if b in versions]
        known = spark.read.schema(_STATE).parquet(*paths).unionByName(batch) if paths else batch
        newest = F.max_by(F.struct("status", "stage", "started_at", "seq"), F.struct("started_at", "seq"))
        merged = known.groupBy("job_id").agg(newest.alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
        merged.select("job_id", "n.*", "first_at", "last_at", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v{epoch}")
        now = versions | dict.fromkeys(touched, epoch)
        spark.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{target}/versions/v{epoch}")
        batch.unpersist()

    conf, kept = changed.sparkSession.conf, "spark.sql.streaming.numRecentProgressUpdates"
    before = conf.get(kept)
    conf.set(kept, "1000000")  # the reports of all batches, to add up what they dropped
    try:
        query = changed.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        late = sum(operator["numRowsDroppedByWatermark"] for report in query.recentProgress for operator in report["stateOperators"])
    finally:
        conf.set(kept, before)
    return Run(job_states(changed.sparkSession, target), late)


def job_states(spark: SparkSession, target: str) -> DataFrame:
    """What ``run_to_end`` has written last; empty if that is nothing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/versions")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    epochs = [int(x.getPath().getName()[1:]) for x in fs.listStatus(folder)] if fs.exists(folder) else []
    return latest_scenes(spark, target, max(epochs), _STATE) if epochs else spark.createDataFrame([], _STATE)
