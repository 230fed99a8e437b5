"""Artifacts, manifests, job records, evaluation and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pixels import CELL, resample

# Files that are no artifacts, and media types by ending.
EXCLUDED = ["job.json", "job.json.part", "request.json", "run_manifest.json"]
MEDIA = {"geojson": "application/geo+json", "json": "application/json", "html": "text/html", "tif": "image/tiff", "tiff": "image/tiff"}
STAGES = ["DISCOVERY", "PAIRING", "PREPROCESSING", "INFERENCE", "HAZARD", "OSM", "INFRASTRUCTURE", "CONNECTIVITY", "RESULTS"]


def media_type(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    out = F.lit("application/octet-stream")
    for name, kind in MEDIA.items():
        out = F.when(ending == name, kind).otherwise(out)
    return out


def artifact_inventory(files: DataFrame) -> DataFrame:
    """``files(path, content)`` with hash, size and media type; bookkeeping files are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.where(~name.isin(*EXCLUDED) & ~name.endswith(".part"))
    return kept.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"), media_type(F.col("path")).alias("media_type"))


def read_artifacts(spark, root: str) -> DataFrame:
    """Inventory of the files below a folder that Spark can read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return artifact_inventory(files.select("path", "content"))


def manifest_reconcile(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status): ok, missing, hash_mismatch, unlisted, or unsafe for a path that leaves the folder."""
    unsafe = (F.coalesce("path", F.lit("")) == "") | F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    both = manifest.select("path", F.col("sha256").alias("listed")).join(found.select("path", "sha256"), "path", "full")
    status = F.when(unsafe, "unsafe").when(F.col("listed").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(F.col("listed") != F.col("sha256"), "hash_mismatch").otherwise("ok")
    return both.select("path", status.alias("status"))


def layer_catalog(artifacts: DataFrame) -> DataFrame:
    """Artifacts that a map can show."""
    return artifacts.where(F.lower("path").rlike(r"\.(geojson|tif|tiff)$")).select("path", "media_type")


def run_manifest(artifacts: DataFrame, requests: DataFrame, pairs: DataFrame, stages: DataFrame) -> DataFrame:
    """Per request: hash of the canonical request, its scenes ``pairs(request_id, pre_id, post_id)``, stages and artifacts.

    ``stages(request_id, stage, status, seq)`` give each stage's last status, in
    order of stages; artifacts are in order of path.
    """
    canonical = F.sha2(F.to_json(F.struct("event_date", "request_id")), 256)
    by_path = artifacts.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("artifacts"))
    last = stages.groupBy("request_id", "stage").agg(F.max_by("status", "seq").alias("status"))
    by_stage = last.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("stage", "status"))).alias("stages"))
    chosen = pairs.select("request_id", F.struct("pre_id", "post_id").alias("selected_scenes"))
    out = requests.select("request_id", canonical.alias("request_sha256"))
    return out.join(chosen, "request_id", "left").join(by_stage, "request_id", "left").join(by_path, "request_id", "left")


def redact(text: Column) -> Column:
    """Values of secrets masked: after names like password or token, and after Bearer."""
    # The patterns of secrets.
    named = F.regexp_replace(text, r"(?i)(password|passwd|token|secret|authorization|api[_-]?key)(\s*[=:]\s*)([^\s,;&]+)", "$1$2[REDACTED]")
    return F.regexp_replace(named, r"(?i)\bBearer\s+[^\s,;&]+", "Bearer [REDACTED]")


def mask_evaluation(cells: DataFrame, pixel_km2: float) -> DataFrame:
    """Confusion of ``cells(predicted, reference)``, both known; scores are 0 where their base is."""
    p, r = F.col("predicted") > 0, F.col("reference") > 0
    n = lambda c, name: F.count_if(c).alias(name)
    counted = cells.where("predicted IS NOT NULL AND reference IS NOT NULL").agg(n(p & r, "tp"), n(p & ~r, "fp"), n(~p & r, "fn"), n(~p & ~r, "tn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.withColumns({
        "precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "f1": over(2 * tp, 2 * tp + fp + fn), "iou": over(tp, tp + fp + fn),
        "predicted_km2": (tp + fp) * pixel_km2, "reference_km2": (tp + fn) * pixel_km2,
    })


def compare_rasters(predicted: DataFrame, reference: DataFrame, size: float, reference_size: float, shift: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """``mask_evaluation`` of ``predicted(grid_id, y, x, value)`` against a reference raster of its own cells, both in metres.

    The reference takes the value at each predicted cell's centre (nearest), and
    counts as water where it is above 0; ``shift`` is how far the prediction's
    corner lies from the reference's, along y and x.  Cells unknown on either
    side are left out.
    """
    at = lambda c, d: ((F.col(c) + 0.5) * size + d) / reference_size - 0.5
    found = resample(reference.select(*CELL, "value"), predicted.select(*CELL, at("y", shift[0]).alias("sy"), at("x", shift[1]).alias("sx")), "value", categorical=True)
    cells = predicted.select(*CELL, F.col("value").alias("predicted")).join(found.select(*CELL, F.col("value").alias("reference")), CELL)
    return mask_evaluation(cells, size * size / 1e6)


def job_status_rollup(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"), F.count_if(F.col("status").isin("QUEUED", "RUNNING")).alias("pending"))


def mark_interrupted(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """Jobs left queued or running become FAILED at their running stage, else their latest, else the first."""
    at = stages.groupBy("job_id").agg(F.max_by(F.when(F.col("status") == "RUNNING", F.col("stage")), F.when(F.col("status") == "RUNNING", F.col("seq"))).alias("running"), F.max_by("stage", "seq").alias("latest"))
    out = jobs.join(at, "job_id", "left")
    open_ = F.col("status").isin("QUEUED", "RUNNING")
    stage = F.coalesce("running", "latest", F.lit(STAGES[0]))
    return out.select("job_id", F.when(open_, "FAILED").otherwise(F.col("status")).alias("status"), F.when(open_, stage).alias("error_stage"))


def stage_durations(stages: DataFrame) -> DataFrame:
    """Milliseconds until a job's next stage begins, and progress in per cent, at most 99."""
    w = Window.partitionBy("job_id").orderBy("started_at", "seq")
    done = F.row_number().over(w) - 1
    ms = F.timestamp_diff("MILLISECOND", F.col("started_at"), F.lead("started_at").over(w))
    progress = F.least(F.lit(99), F.floor((done * 100 + F.col("percent")) / len(STAGES)).cast("int"))
    return stages.select("job_id", "seq", ms.alias("duration_ms"), progress.alias("progress"))


def pending_requests(requests: DataFrame, results: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Requests without a result of the same fingerprint that is young enough; a life of 0 reuses none."""
    if ttl_seconds == 0:
        return requests
    fresh = results.where(F.timestamp_diff("SECOND", F.col("created_at"), now) <= ttl_seconds).select("fingerprint")
    return requests.join(fresh, "fingerprint", "left_anti")


# Labels of the report's measures, by the column that holds each.
LABELS = {
    "flooded_km2": "Flooded area (km2)",
    "regions": "Flood polygons",
    "affected_buildings": "Potentially affected buildings",
    "buildings": "Buildings assessed",
    "affected_bridges": "Potentially affected bridges",
    "bridges": "Bridges assessed",
    "open_km": "Roads: open (km)",
    "potentially_blocked_km": "Roads: potentially blocked (km)",
    "blocked_km": "Roads: blocked (km)",
    "unknown_coverage_km": "Roads: unknown coverage (km)",
    "connected": "Settlements connected",
    "detour": "Settlements with detours",
    "cut_off": "Settlements cut off",
    "no_baseline_access": "Settlements without baseline access",
}


def report_metrics(metrics: DataFrame) -> DataFrame:
    """Long form (request_id, label, value) of a row of measures per request, unknown ones left out."""
    names = [c for c in metrics.columns if c != "request_id"]
    wide = metrics.select("request_id", *[F.col(c).cast("double").alias(c) for c in names])
    return wide.unpivot("request_id", names, "label", "value").where("value IS NOT NULL")


def write_feature_layer(features: DataFrame, path: str, attribution: str, licence: str) -> None:
    """One GeoJSON feature a line; the output commit makes the write all or nothing."""
    props = F.struct(*[c for c in features.columns if c not in ("x", "y")], F.lit(attribution).alias("attribution"), F.lit(licence).alias("licence"))
    shape = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    features.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), props.alias("properties"))).alias("value")).write.mode("overwrite").text(path)


def read_feature_layer(spark, path: str, properties: str) -> DataFrame:
    """Features of lines that hold a feature or a collection of them."""
    kind = f"struct<type:string,geometry:struct<type:string,coordinates:array<double>>,properties:{properties}>"
    lines = spark.read.text(path).select(F.from_json("value", kind).alias("f"), F.from_json("value", f"features array<{kind}>")["features"].alias("many"))
    rows = lines.select(F.explode(F.coalesce("many", F.array("f"))).alias("f"))
    return rows.select(F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y"), "f.properties.*")


def read_job_records(spark, path: str, schema: str) -> DataFrame:
    """Job records; files that can't be read as JSON are skipped."""
    return spark.read.schema(f"{schema}, _bad string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad IS NULL").drop("_bad")
