"""The state of jobs stays out of the driver."""

from __future__ import annotations

import datetime as dt
import glob

from floodlake.streaming import intake


def test_job_state_is_written_to_the_shared_folder(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(str(i % 40), "s", at + dt.timedelta(seconds=i), i, str(i)) for i in range(200)]
    frame = spark.createDataFrame(rows, "job_id string, stage string, started_at timestamp, seq long, status string")
    frame.write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/log")
    before = {t.name for t in spark.catalog.listTables()}
    out = intake.run_to_end(intake.latest_job_state(stream), f"{tmp_path}/jobs", f"{tmp_path}/state")
    assert {r.job_id: r.status for r in out.states.collect()} == {str(i): str(160 + i) for i in range(40)}
    assert {t.name for t in spark.catalog.listTables()} == before and glob.glob(f"{tmp_path}/jobs/v*/bucket=*/*.parquet")


SCHEMA = "job_id string, stage string, started_at timestamp, seq long, status string"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def _run(spark, folder, rows):
    """Another page of updates, if there are any, and a run over what is new."""
    if rows:
        spark.createDataFrame([(job, "s", T0 + dt.timedelta(minutes=m), i, status) for job, m, i, status in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    out = intake.run_to_end(intake.latest_job_state(stream), f"{folder}/jobs", f"{folder}/state", buckets=16)
    return {r.job_id: (r.status, int((r.last_at - r.first_at).total_seconds() // 60)) for r in out.states.collect()}, out.late


def test_late_updates_are_dropped_and_counted(spark, tmp_path):
    assert _run(spark, tmp_path, [("a", 0, 1, "QUEUED"), ("a", 5, 2, "RUNNING"), ("b", 0, 3, "QUEUED"), (None, 1, 4, "x")]) == ({"a": ("RUNNING", 5), "b": ("QUEUED", 0)}, 0)
    # The newest update is now at 300 minutes, so the watermark is at 240 in the batch after.
    known, late = _run(spark, tmp_path, [("c", 300, 5, "QUEUED")])
    assert known["c"] == ("QUEUED", 0) and late == 0
    known, late = _run(spark, tmp_path, [("a", 20, 6, "FAILED"), ("a", 250, 7, "SUCCEEDED"), ("b", 30, 8, "FAILED"), ("d", 10, 9, "QUEUED")])
    assert known == {"a": ("SUCCEEDED", 250), "b": ("QUEUED", 0), "c": ("QUEUED", 0)} and late == 3


def test_run_without_new_updates_returns_what_is_known(spark, tmp_path):
    rows = [(str(i), i % 50, i, "QUEUED") for i in range(40)]
    first = _run(spark, tmp_path, rows)
    assert len(first[0]) == 40 and _run(spark, tmp_path, []) == first
    before = set(glob.glob(f"{tmp_path}/jobs/v*/bucket=*"))
    again = _run(spark, tmp_path, [("7", 49, 99, "RUNNING")])
    assert again == (first[0] | {"7": ("RUNNING", 42)}, 0) and len(set(glob.glob(f"{tmp_path}/jobs/v*/bucket=*")) - before) == 1


def test_state_of_old_jobs_is_evicted(spark, tmp_path):
    for page in range(4):
        rows = [(f"{page}-{i}", page * 600, page * 100 + i, "QUEUED") for i in range(50)]
        spark.createDataFrame([(job, "s", T0 + dt.timedelta(minutes=m), i, status) for job, m, i, status in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    held = []
    query = intake.latest_job_state(stream).writeStream.outputMode("update").foreachBatch(lambda batch, epoch: batch.count()).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) < 200 and held[-1] <= 100


def test_intake_rewrites_only_touched_buckets(spark, tmp_path):
    schema = "request_id int, scene_id string, ingest_seq long, platform string"
    pages = [[(1, f"s{i}", i, "first") for i in range(200)], [(1, "s7", 900, "again"), (1, "new", 901, "new"), (1, "s8", 1, "stale")]]
    for page in pages:
        spark.createDataFrame(page, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/pages")
        query = intake.scene_intake(stream, f"{tmp_path}/scenes", f"{tmp_path}/state", buckets=16)
        query.awaitTermination()
    got = {r.scene_id: r.platform for r in intake.latest_scenes(spark, f"{tmp_path}/scenes", 1, schema).collect()}
    assert got == {f"s{i}": "first" for i in range(200)} | {"s7": "again", "new": "new"}
    assert len(glob.glob(f"{tmp_path}/scenes/v0/bucket=*")) == 16 and len(glob.glob(f"{tmp_path}/scenes/v1/bucket=*")) <= 3
