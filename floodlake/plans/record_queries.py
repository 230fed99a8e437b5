"""Queries over features, records, text and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import features as ft
from ..operators import records as rc
from ..operators import wkb
from ..operators.regions import checkpointed
from ..streaming import intake
from . import exposure_queries, network_queries, pixel_queries, scene_queries
from .fixtures import asked, load, with_tables


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a local one only where that is unset on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="floodlake-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_TAGGED = """SELECT p_partkey AS osm_id, CASE p_partkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS osm_type,
    CASE p_partkey % 5 WHEN 0 THEN 'point' WHEN 1 THEN 'line' WHEN 4 THEN NULL ELSE 'polygon' END AS kind,
    CASE WHEN p_size % 4 = 0 THEN 'yes' WHEN p_size % 4 = 1 THEN 'no' END AS building, CASE WHEN p_size % 3 = 0 THEN 'primary' WHEN p_size % 3 = 1 THEN '' END AS highway,
    CASE WHEN p_partkey % 7 = 0 THEN 'town' WHEN p_partkey % 7 = 1 THEN 'locality' END AS place, CASE WHEN p_partkey % 11 < 3 THEN 'clinic' ELSE 'bank' END AS amenity FROM {part}"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_TAGGED, part=load(spark, sf_dir, "part"))
    tags = F.create_map(*[x for t in ("building", "highway", "place", "amenity") for x in (F.lit(t), F.col(t))])
    return ft.normalize_features(rows.select("osm_type", "osm_id", "kind", tags.alias("tags")))


def feature_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("feature_id", "category")


def feature_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("feature_id", "outcome", F.size("tags").alias("tags"))


def feature_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.feature_quality(_features(spark, sf_dir))


def feature_normalize_wkb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Little-endian points made in SQL from whole numbers; every seventh is cut short."""
    parts = load(spark, sf_dir, "part").select("p_partkey")
    # A double of 1.0 or 2.0 by parity, so that bytes need no arithmetic.
    one, two = "000000000000F03F", "0000000000000040"
    x = F.when(F.col("p_partkey") % 2 == 0, one).otherwise(two)
    blob = F.concat(F.lit("0101000000"), x, F.lit(one))
    geom = F.unhex(F.when(F.col("p_partkey") % 7 == 0, F.substring(blob, 1, 20)).otherwise(blob))
    read = wkb.decode(parts.select(F.col("p_partkey").alias("osm_id"), geom.alias("geom")))
    return read.select("osm_id", "kind", F.get(F.get(F.get("parts", 0)["rings"], 0), 0)["x"].alias("x"))


#: Big-endian doubles of the whole numbers that shapes are drawn with, as hexadecimal digits.
_NUMBERS = {0: "0000000000000000", 1: "3FF0000000000000", 2: "4000000000000000", 3: "4008000000000000", 4: "4010000000000000", 6: "4018000000000000"}


def feature_parts_wkb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Big-endian multipolygons of each part: a hollow square and a second square, as wide as the part's size says; some hold no second one, some break off."""
    at = lambda *xy: "".join(_NUMBERS[v] for v in xy)
    count = lambda n: f"{n:08X}"
    box = lambda a, b: count(5) + at(a, a, b, a, b, b, a, b, a, a)
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_size")
    hollow = F.when(F.col("p_size") % 3 == 0, box(1, 2)).otherwise(box(1, 3))
    first = F.concat(F.lit("0000000003" + count(2) + box(0, 4)), hollow)
    two = F.concat(F.lit("0000000006" + count(2)), first, F.lit("0000000003" + count(1) + box(4, 6)))
    one = F.concat(F.lit("0000000006" + count(1)), first)
    blob = F.when(F.col("p_partkey") % 7 == 0, F.substring(two, 1, 200)).when(F.col("p_partkey") % 2 == 0, two).otherwise(one)
    read = wkb.decode(parts.select(F.col("p_partkey").alias("osm_id"), F.unhex(blob).alias("geom")))
    area = lambda part: F.aggregate(F.slice(part["rings"], 2, F.size(part["rings"])), ft.ring_area(F.get(part["rings"], 0)), lambda s, r: s - ft.ring_area(r))
    rings = F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["rings"]))
    return read.select("osm_id", "kind", F.when(F.col("kind").isNotNull(), F.size("parts")).alias("parts"), rings.alias("rings"), F.aggregate("parts", F.lit(0.0), lambda s, p: s + area(p)).alias("area"))


_DRAWN = """SELECT 'way' AS osm_type, feature_id AS osm_id, grid_id AS request_id, 'polygon' AS kind, CASE WHEN CAST(feature_id AS BIGINT) % 6 = 0 THEN 'no' ELSE 'yes' END AS building, CAST(NULL AS STRING) AS highway, CAST(NULL AS STRING) AS place,
      xmin AS x1, ymin AS y1, xmax AS x2, ymax AS y2, CAST(feature_id AS BIGINT) % 13 = 0 AS knotted FROM {buildings}
    UNION ALL SELECT 'way', 'r' || feature_id, grid_id, 'line', NULL, highway, NULL, x1, y1, x2, y2, FALSE FROM {roads}
    UNION ALL SELECT 'node', feature_id, request_id, 'point', NULL, NULL, place, x, y, x, y, FALSE FROM {places}"""
#: Area asked about by each grid's request: x and y from 300 to 600, and 50 more each way.
_ASKED = (300.0, 600.0, 50.0)


def _extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings, roads and places as drawn shapes, repaired, cut to their requests' areas and normalised; every 13th building is a bow tie."""
    rows = spark.sql(_DRAWN, **{t: load(spark, sf_dir, t) for t in ("buildings", "roads", "places")})
    areas = rows.select("request_id").distinct()
    # Few files hold many shapes, so they are dealt out before the work on each.
    rows = rows.repartition("osm_type", "osm_id")
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    box = [at("x1", "y1"), at("x2", "y1"), at("x2", "y2"), at("x1", "y2")]
    points = F.when(F.col("kind") == "point", F.array(box[0])).when(F.col("kind") == "line", F.array(box[0], box[2])).when(F.col("knotted"), F.array(box[0], box[2], box[1], box[3])).otherwise(F.array(*box))
    tags = F.create_map(*[x for t in ("building", "highway", "place") for x in (F.lit(t), F.col(t))])
    drawn = ft.repair(rows.select("osm_type", "osm_id", "request_id", "kind", tags.alias("tags"), points.alias("points")))
    low, high, buffer = _ASKED
    areas = areas.select("request_id", *[F.lit(low).alias(c) for c in ("xmin", "ymin")], *[F.lit(high).alias(c) for c in ("xmax", "ymax")])
    return ft.normalize_features(ft.clip_parts(drawn, areas, buffer))


def feature_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda f: F.aggregate("parts", F.lit(0.0), lambda s, p: s + f(p))
    size = F.when(F.col("kind") == "polygon", total(ft.ring_area)).when(F.col("kind") == "line", total(ft.line_length)).otherwise(F.size("parts").cast("double"))
    return _extract(spark, sf_dir).select("feature_id", "request_id", "outcome", "category", "repaired", "clipped", F.round(size, 6).alias("size"))


def extract_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.feature_quality(_extract(spark, sf_dir))


def snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.snapshot_asof(load(spark, sf_dir, "versions"), _snapshot_events(spark, sf_dir)).select("request_id", "feature_id", "version", "value")


_EVENTS = "SELECT CAST(n_nationkey AS INT) AS request_id, DATE '2024-01-01' + CAST(n_nationkey AS INT) AS event_date FROM {nation}"


def _snapshot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_EVENTS, nation=load(spark, sf_dir, "nation"))


_AOIS = """SELECT CAST(c_custkey AS INT) AS request_id, CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 'Point' ELSE 'Polygon' END AS kind,
    CAST(c_custkey * 7 % 380 - 190 AS DOUBLE) AS x, CAST(c_custkey * 11 % 160 - 80 AS DOUBLE) AS y, CAST(c_custkey % 90 AS DOUBLE) / 100 AS w, DATE '2020-01-01' + CAST(c_custkey % 40 AS INT) AS event_date FROM {customer}"""


def aoi_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.sql(_AOIS, customer=load(spark, sf_dir, "customer"))
    knot = F.col("request_id") % 13 == 0
    xs = F.when(knot, F.array(F.col("x"), F.col("x") + F.col("w"), F.col("x"), F.col("x") + F.col("w"))).otherwise(F.array(F.col("x"), F.col("x") + F.col("w"), F.col("x") + F.col("w"), F.col("x")))
    ys = F.when(knot, F.array(F.col("y"), F.col("y") + F.col("w"), F.col("y") + F.col("w"), F.col("y"))).otherwise(F.array(F.col("y"), F.col("y"), F.col("y") + F.col("w"), F.col("y") + F.col("w")))
    out = ft.validate_aois(a.select("request_id", "kind", xs.alias("xs"), ys.alias("ys"), "event_date"), F.lit("2020-02-05").cast("date"))
    return out.select("request_id", "reject_code", F.when(F.col("reject_code").isNull(), F.round("area_km2", 4)).alias("area_km2"))


def aoi_validate_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas in two parts, the first one hollow; by the customer's number the hole, or the second part, lies where it mustn't."""
    a = spark.sql(_AOIS, customer=load(spark, sf_dir, "customer"))
    n, w = F.col("request_id"), F.col("w")
    at = lambda x, y: F.struct((F.col("x") + w * x).alias("x"), (F.col("y") + w * y).alias("y"))
    box = lambda x1, y1, x2, y2: F.array(at(x1, y1), at(x2, y1), at(x2, y2), at(x1, y2))
    hole = F.when(n % 7 == 0, box(0.75, 0.25, 1.25, 0.5)).when(n % 7 == 1, box(1.25, 0.25, 1.5, 0.5)).otherwise(box(0.25, 0.25, 0.75, 0.75))
    second = F.when(n % 5 == 0, box(0.375, 0.375, 0.625, 0.625)).when(n % 5 == 1, box(1.0, 1.0, 1.5, 1.5)).when(n % 5 == 2, box(0.0625, 0.0625, 0.125, 0.125)).otherwise(box(2.0, 0.0, 2.5, 0.5))
    polygons = F.array(F.array(box(0.0, 0.0, 1.0, 1.0), hole), F.array(second))
    kind = F.when(n % 11 == 0, F.lit("Polygon")).when(n % 19 != 0, F.lit("MultiPolygon"))
    out = ft.validate_areas(a.select("request_id", kind.alias("kind"), polygons.alias("polygons"), "event_date"), F.lit("2020-02-05").cast("date"))
    return out.select("request_id", "reject_code", F.when(F.col("reject_code").isNull(), F.round("area_km2", 4)).alias("area_km2"), F.when(F.col("reject_code").isNull(), F.round("xmax", 6)).alias("xmax"))


def geodesic_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.sql(_AOIS, customer=load(spark, sf_dir, "customer"))
    return a.select("request_id", F.round(geo.rectangle_km2(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w")), 4).alias("area_km2"))


def utm_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.sql(_AOIS, customer=load(spark, sf_dir, "customer"))
    return a.select("request_id", geo.utm_epsg(F.col("x"), F.col("y") * 1.2).alias("epsg"))


def project_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.sql(_AOIS, customer=load(spark, sf_dir, "customer")).where("x BETWEEN -180 AND 180")
    east, north = geo.metric(F.col("x"), F.col("y"), geo.utm_epsg(F.col("x"), F.col("y")))
    return a.select("request_id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


def clip_to_aoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each building is asked about by one request."""
    b = load(spark, sf_dir, "buildings").withColumn("request_id", (F.col("feature_id").cast("long") % 25).cast("int"))
    a = load(spark, sf_dir, "scene_boxes").select("request_id", *[F.round(F.col(c) * 200).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    return ft.clip_to_aoi(b, a, 50.0).select("request_id", "feature_id", "xmin", "ymin", "xmax", "ymax", "clipped")


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "artifacts")
    return rc.artifact_inventory(a.select(F.concat_ws("/", F.lit("job"), "page_id", "name").alias("path"), F.encode("html", "UTF-8").alias("content")))


def artifact_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _artifacts(spark, sf_dir)


def layer_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.layer_catalog(_artifacts(spark, sf_dir))


def manifest_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _artifacts(spark, sf_dir)
    n = F.split("path", "/")[1].cast("long")
    listed = found.where(n % 11 != 0).select(F.when(n % 13 == 0, F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("path"), F.when(n % 7 == 0, F.lit("00")).otherwise(F.col("sha256")).alias("sha256"))
    return rc.manifest_reconcile(listed, found)


def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _artifacts(spark, sf_dir).withColumn("request_id", (F.split("path", "/")[1].cast("long") % 25).cast("int"))
    log = load(spark, sf_dir, "stage_log").withColumn("request_id", (F.col("job_id").cast("long") % 25).cast("int"))
    out = rc.run_manifest(found, load(spark, sf_dir, "requests"), scene_queries.adaptive_pairing(spark, sf_dir), log)
    joined = F.array_join(F.transform("artifacts", lambda a: F.concat_ws("=", a["path"], a["sha256"])), ";")
    return out.select("request_id", "request_sha256", F.sha2(joined, 256).alias("artifacts_sha256"), "selected_scenes.*", F.array_join(F.transform("stages", lambda x: F.concat_ws("=", x["stage"], x["status"])), ";").alias("stages"))


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(rc.redact(F.col("text")).cast("binary")).alias("redacted_md5"))


def mask_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = load(spark, sf_dir, "labels").select(F.col("quality").alias("predicted"), F.col("toxic").alias("reference"))
    out = rc.mask_evaluation(cells, 0.0001)
    return out.select(*[F.round(c, 9).alias(c) if k == "double" else c for c, k in out.dtypes])


#: A reference raster of cells twice as wide, whose corner lies 5 m further up and 15 m to the left.
_SURVEYED = "SELECT grid_id, CAST(floor(y / 2) AS INT) AS y, CAST(floor(x / 2) AS INT) AS x, CASE WHEN (s + n) % 31 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(s % 3 AS DOUBLE) END AS value FROM cells WHERE y % 2 = 0 AND x % 2 = 0"


def raster_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = load(spark, sf_dir, "flood").select("grid_id", "y", "x", F.expr("CASE WHEN (y * 96 + x) % 37 <> 0 THEN mask END").alias("value"))
    reference = spark.sql(_SURVEYED.replace("FROM cells", "FROM {cells}"), cells=load(spark, sf_dir, "cells"))
    out = rc.compare_rasters(predicted, reference, 10, 20, (5.0, 15.0))
    return out.select(*[F.round(c, 9).alias(c) if k == "double" else c for c, k in out.dtypes])


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "stage_log")
    return log.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"))


def job_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.job_status_rollup(_jobs(spark, sf_dir))


def mark_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.mark_interrupted(_jobs(spark, sf_dir), load(spark, sf_dir, "stage_log"))


def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.stage_durations(load(spark, sf_dir, "stage_log"))


def pending_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "stage_log")
    asked = log.select("seq", F.sha2(F.concat_ws("|", "job_id", "stage"), 256).alias("fingerprint")).where("seq % 3 = 0")
    done = log.where("seq % 5 = 0 AND status = 'SUCCEEDED'").select(F.sha2(F.concat_ws("|", "job_id", "stage"), 256).alias("fingerprint"), F.col("started_at").alias("created_at"))
    now = F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")
    return rc.pending_requests(asked, done, now, 10 * 86400).select("seq")


def _asked_grids(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables of the grids that are reported on; their pixels are added up from the lines once and stored."""
    given = asked(spark, sf_dir, "pixels", "buildings", "roads")
    return given | {"pixels": checkpointed(given["pixels"])}


def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the request whose grid and road network have its number."""
    grids = _asked_grids(spark, sf_dir)
    flood = pixel_queries.flood_summary(spark, sf_dir, **grids).select(F.col("grid_id").alias("request_id"), "flooded_km2")
    regions = pixel_queries.flood_regions(spark, sf_dir, **grids).groupBy(F.col("grid_id").alias("request_id")).agg(F.count("*").alias("regions"))
    exposed = exposure_queries.by_grid(spark, sf_dir, **grids).withColumnRenamed("grid_id", "request_id")
    access = network_queries.connectivity_summary(spark, sf_dir, **asked(spark, sf_dir, "lattice")).drop("settlements")
    rows = load(spark, sf_dir, "requests").select("request_id")
    for part in (flood, regions, exposed, access):
        rows = rows.join(part, "request_id", "left")
    named = rows.select("request_id", *[F.col(c).alias(label) for c, label in rc.LABELS.items()])
    return rc.report_metrics(named).select("request_id", "label", F.round("value", 6).alias("value"))


def analysis_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested document per request, as its JSON: scenes found, the pair chosen, flood and buildings of its grid."""
    scenes = load(spark, sf_dir, "scenes").groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("scene_id", "platform"))).alias("scenes"))
    pairing = scene_queries.adaptive_pairing(spark, sf_dir).select("request_id", F.struct("status", "window_days", "pre_id", "post_id").alias("pairing"))
    grids = _asked_grids(spark, sf_dir)
    hazard = pixel_queries.flood_summary(spark, sf_dir, **grids).select(F.col("grid_id").alias("request_id"), F.struct("pixels", "valid_pixels", "flooded_pixels").alias("hazard"))
    exposed = exposure_queries.by_grid(spark, sf_dir, **grids).select(F.col("grid_id").alias("request_id"), F.struct("buildings", "affected_buildings", "bridges", "affected_bridges").alias("exposure"))
    doc = F.struct("request_id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "scenes", "pairing", "hazard", "exposure")
    rows = load(spark, sf_dir, "requests")
    for part in (scenes, pairing, hazard, exposed):
        rows = rows.join(part, "request_id", "left")
    rows = rows.withColumn("scenes", F.coalesce("scenes", F.array().cast("array<struct<scene_id:string,platform:string>>")))
    return rows.select("request_id", F.to_json(doc).alias("document"))


def feature_layer_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = load(spark, sf_dir, "places").select("feature_id", "name", "category", "x", "y")
    path = _shared(spark, "layer")
    rc.write_feature_layer(places, path, "map contributors", "ODbL")
    return rc.read_feature_layer(spark, path, "struct<feature_id:string,name:string,category:string,attribution:string,licence:string>").select("feature_id", "name", "category", "attribution", "licence", "x", "y")


def scene_intake_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scenes arrive in two pages, each with newer versions of some."""
    s = load(spark, sf_dir, "scenes").select("request_id", "scene_id", "ingest_seq", "platform")
    source, target = _shared(spark, "pages"), _shared(spark, "scenes")
    s.unionByName(s.where("ingest_seq % 3 = 0").withColumn("ingest_seq", F.col("ingest_seq") + 10_000_000).withColumn("platform", F.lit("again"))).repartition(2).write.parquet(source)
    pages = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = intake.scene_intake(pages, target, _shared(spark, "intake"))
    query.awaitTermination()
    return intake.latest_scenes(spark, target, query.lastProgress["batchId"], "request_id int, scene_id string, platform string").select("request_id", "scene_id", "platform")


def job_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "stage_log").select("job_id", "stage", "started_at", "seq", "status")
    source = _shared(spark, "log")
    log.withColumn("started_at", F.col("started_at").cast("timestamp")).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    out = intake.run_to_end(intake.latest_job_state(stream), _shared(spark, "jobs"), _shared(spark, "state"))
    return out.states.select("job_id", "status", "stage")


_CATEGORY = """CASE WHEN kind = 'polygon' AND building = 'yes' THEN 'building' WHEN kind = 'line' AND highway = 'primary' THEN 'road' WHEN kind IN ('point', 'polygon') AND place = 'town' THEN 'settlement' WHEN kind IN ('point', 'polygon') AND amenity = 'clinic' THEN 'healthcare' END"""
_FEATS = f"WITH t AS ({_TAGGED.format(part='part')}), f AS (SELECT *, osm_type || '/' || osm_id AS feature_id, {_CATEGORY} AS category FROM t), g AS (SELECT *, CASE WHEN kind IS NULL THEN 'dropped_empty' WHEN category IS NULL THEN 'ignored' ELSE 'retained' END AS outcome FROM f)"
_E2, _E, _B = 0.0066943799901413165, 0.0818191908426215, 6356752.314245179


def _q(lat: str) -> str:
    s = f"sin(radians({lat}))"
    return f"({_B}::DOUBLE * {_B}::DOUBLE / 2 * ({s} / (1 - {_E2}::DOUBLE * {s} * {s}) + ln((1 + {_E}::DOUBLE * {s}) / (1 - {_E}::DOUBLE * {s})) / (2 * {_E}::DOUBLE)))"


def _utm_sql() -> str:
    """DuckDB: the Krüger series as sums over its four terms."""
    n = "(1 / 298.257223563::DOUBLE / (2 - 1 / 298.257223563::DOUBLE))"
    terms = {1: f"({n} / 2 - 2 * {n}**2 / 3 + 5 * {n}**3 / 16 + 41 * {n}**4 / 180)", 2: f"(13 * {n}**2 / 48 - 3 * {n}**3 / 5 + 557 * {n}**4 / 1440)", 3: f"(61 * {n}**3 / 240 - 103 * {n}**4 / 140)", 4: f"(49561 * {n}**4 / 161280)"}
    east = " + ".join(f"{a} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, a in terms.items())
    north = " + ".join(f"{a} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, a in terms.items())
    return f""", z AS (SELECT request_id, x, y, radians(x - (greatest(1, least(60, CAST(floor((x + 180) / 6) AS INT) + 1)) * 6 - 183)) AS d, sin(radians(y)) AS s, 2 * sqrt({n}) / (1 + {n}) AS c FROM a WHERE x BETWEEN -180 AND 180),
        t AS (SELECT *, sinh(atanh(s) - c * atanh(c * s)) AS t FROM z), u AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM t),
        k AS (SELECT request_id, x, y, 6378137 / (1 + {n}) * (1 + {n}**2 / 4 + {n}**4 / 64) AS r, eta + {east} AS e, xi + {north} AS n FROM u)"""


_UTM = _utm_sql()
# Distance from the south pole on the plane that is true at 71 degrees.
_TURN = lambda lat: f"(tan(pi() / 4 - radians({lat}) / 2) * power((1 + {_E}::DOUBLE * sin(radians({lat}))) / (1 - {_E}::DOUBLE * sin(radians({lat}))), {_E}::DOUBLE / 2))"
_CAP = f"(6378137 * cos(radians(71)) / sqrt(1 - {_E2}::DOUBLE * power(sin(radians(71)), 2)) * {_TURN('-y')} / {_TURN('71')})"
_RECT = f"(radians(w) * ({_q('y + w')} - {_q('y')}) / 1e6)"
_A = f"WITH a AS ({_AOIS.format(customer='customer')})"
_FOUND = "WITH found AS (SELECT page_id, 'job/' || page_id || '/' || CASE page_id % 5 WHEN 0 THEN 'a.geojson' WHEN 1 THEN 'b.json' WHEN 2 THEN 'c.HTML' WHEN 3 THEN 'd.tif' ELSE 'e.bin' END AS path, sha256(html) AS sha256, octet_length(encode(html)) AS size_bytes, CASE page_id % 5 WHEN 0 THEN 'application/geo+json' WHEN 1 THEN 'application/json' WHEN 2 THEN 'text/html' WHEN 3 THEN 'image/tiff' ELSE 'application/octet-stream' END AS media_type FROM pages)"
_JOBS = with_tables("stage_log") + ", jobs AS (SELECT job_id, arg_max(status, seq) AS status, arg_max(stage, seq) AS latest, arg_max(CASE WHEN status = 'RUNNING' THEN stage END, CASE WHEN status = 'RUNNING' THEN seq END) AS running FROM stage_log GROUP BY job_id)"

_REQUESTS = with_tables("requests") + " SELECT * FROM requests"
_BY_GRID = ", ".join(f"{name} AS ({sql})" for name, sql in exposure_queries.BY_GRID.items())

# A bow tie is as high at x as x is far from its middle; cut where its sides meet the bounds, each strip's area follows from its middle.
_EXTRACT = with_tables("buildings", "roads", "places") + ", d AS (" + _DRAWN.format(buildings="buildings", roads="roads", places="places") + """),
    b AS (SELECT *, greatest(x1, 250) AS a1, least(x2, 650) AS a2, greatest(y1, 250) AS b1, least(y2, 650) AS b2, NOT (x1 >= 250 AND x2 <= 650 AND y1 >= 250 AND y2 <= 650) AS clipped FROM d),
    t AS (SELECT osm_id, (x1 + x2) / 2 AS xm, (y1 + y2) / 2 AS ym, (y2 - y1) / (x2 - x1) AS m, * EXCLUDE (osm_id) FROM b WHERE knotted AND a1 < a2 AND b1 < b2),
    stops AS (SELECT osm_id, xm, ym, m, b1, b2, unnest(list_sort(list_distinct(list_filter([a1, a2, xm, xm + (b1 - ym) / m, xm - (b1 - ym) / m, xm + (b2 - ym) / m, xm - (b2 - ym) / m], lambda v: v BETWEEN a1 AND a2)))) AS v FROM t),
    strips AS (SELECT *, lead(v) OVER (PARTITION BY osm_id ORDER BY v) AS w FROM stops),
    ties AS (SELECT osm_id, sum((w - v) * greatest(0, least(b2, ym + m * abs((v + w) / 2 - xm)) - greatest(b1, ym - m * abs((v + w) / 2 - xm)))) AS m2 FROM strips WHERE w IS NOT NULL GROUP BY osm_id),
    s AS (SELECT b.*, CASE WHEN kind = 'point' THEN CASE WHEN clipped THEN 0 ELSE 1 END WHEN kind = 'polygon' AND knotted THEN coalesce(m2, 0)
        WHEN kind = 'polygon' THEN greatest(0, a2 - a1) * greatest(0, b2 - b1) WHEN a1 <= a2 AND b1 <= b2 THEN (a2 - a1) + (b2 - b1) ELSE 0 END AS size FROM b LEFT JOIN ties USING (osm_id)),
    e AS (SELECT *, CASE WHEN kind = 'polygon' THEN CASE WHEN building <> 'no' THEN 'building' END WHEN kind = 'line' THEN 'road' WHEN place IN ('town', 'village', 'hamlet', 'suburb') THEN 'settlement' END AS category FROM s),
    o AS (SELECT *, CASE WHEN size <= 0 THEN 'dropped_empty' WHEN category IS NULL THEN 'ignored' ELSE 'retained' END AS outcome FROM e)"""

QUERIES = {f.__name__: f for f in (
    feature_category, feature_normalize, feature_quality, feature_normalize_wkb, feature_parts_wkb, feature_extract, extract_quality, snapshot_asof, aoi_validate, aoi_validate_parts, geodesic_area, utm_zone, project_utm, clip_to_aoi, artifact_inventory, layer_catalog, manifest_reconcile,
    run_manifest, redact_text, mask_evaluation, raster_evaluation, job_status_rollup, mark_interrupted, stage_durations, pending_requests, report_metrics, analysis_document, feature_layer_roundtrip, scene_intake_stream, job_state_stream,
)}
ORACLES = {
    "feature_category": _FEATS + " SELECT feature_id, category FROM f",
    "feature_normalize": _FEATS + " SELECT feature_id, outcome, CAST((building IS NOT NULL)::INT + (highway IS NOT NULL)::INT + (place IS NOT NULL)::INT + 1 AS INT) AS tags FROM g",
    "feature_quality": _FEATS + " SELECT count(*) AS rows, count(*) FILTER (outcome = 'retained') AS retained, count(*) FILTER (outcome = 'dropped_empty') AS dropped_empty, count(*) FILTER (outcome = 'ignored') AS ignored FROM g",
    "feature_normalize_wkb": "SELECT p_partkey AS osm_id, CASE WHEN p_partkey % 7 <> 0 THEN 'point' END AS kind, CASE WHEN p_partkey % 7 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 2.0 END::DOUBLE END AS x FROM part",
    "feature_parts_wkb": """WITH w AS (SELECT p_partkey AS osm_id, p_partkey % 7 <> 0 AS whole, p_partkey % 2 = 0 AS two, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 4 END AS hole FROM part)
        SELECT osm_id, CASE WHEN whole THEN 'polygon' END AS kind, CASE WHEN whole THEN CASE WHEN two THEN 2 ELSE 1 END END::INT AS parts, CASE WHEN whole THEN CASE WHEN two THEN 3 ELSE 2 END END::INT AS rings, CASE WHEN whole THEN 16 - hole + CASE WHEN two THEN 4 ELSE 0 END END::DOUBLE AS area FROM w""",
    "feature_extract": _EXTRACT + " SELECT osm_type || '/' || osm_id AS feature_id, request_id, outcome, category, knotted AS repaired, clipped, round(size, 6)::DOUBLE AS size FROM o",
    "extract_quality": _EXTRACT + " SELECT count(*) AS rows, count(*) FILTER (outcome = 'retained') AS retained, count(*) FILTER (outcome = 'dropped_empty') AS dropped_empty, count(*) FILTER (outcome = 'ignored') AS ignored, count(*) FILTER (knotted) AS repaired, count(*) FILTER (clipped) AS clipped FROM o",
    "snapshot_asof": with_tables("versions") + f", e AS ({_EVENTS.format(nation='nation')}), r AS (SELECT request_id, v.*, row_number() OVER (PARTITION BY request_id, feature_id ORDER BY version_ts DESC, version DESC) AS k FROM versions v JOIN e ON version_ts <= CAST(event_date AS TIMESTAMP) - INTERVAL '1' SECOND) SELECT request_id, feature_id, version, value FROM r WHERE k = 1 AND deleted = 0",
    "aoi_validate": _A + f""", j AS (SELECT *, CASE WHEN kind IS NULL THEN 'UNPARSABLE' WHEN kind = 'Point' THEN 'NOT_A_POLYGON' WHEN request_id % 13 = 0 AND w > 0 THEN 'INVALID_TOPOLOGY' WHEN x < -180 OR x + w > 180 THEN 'OUT_OF_BOUNDS'
        WHEN request_id % 13 = 0 OR {_RECT} NOT BETWEEN 0.1 AND 5000 THEN 'AREA_OUT_OF_LIMITS' WHEN event_date > DATE '2020-02-05' THEN 'EVENT_IN_FUTURE' END AS reject_code FROM a) SELECT request_id, reject_code, CASE WHEN reject_code IS NULL THEN round({_RECT}, 4) END AS area_km2 FROM j""",
    # Parts are flat where w is 0: no rings are left that could meet, and the area is too small.
    "aoi_validate_parts": _A + f""", p AS (SELECT *, request_id % 7 AS h, request_id % 5 AS s, w > 0 AS wide, CASE request_id % 5 WHEN 0 THEN 0.375 WHEN 1 THEN 1 WHEN 2 THEN 0.0625 ELSE 2 END::DOUBLE AS u, CASE request_id % 5 WHEN 0 THEN 0.375 WHEN 1 THEN 1 WHEN 2 THEN 0.0625 ELSE 0 END::DOUBLE AS v,
          CASE request_id % 5 WHEN 0 THEN 0.25 WHEN 2 THEN 0.0625 ELSE 0.5 END::DOUBLE AS d FROM a),
        b AS (SELECT *, greatest(x + w, x + w * (u + d), CASE WHEN h = 0 THEN x + w * 1.25::DOUBLE WHEN h = 1 THEN x + w * 1.5::DOUBLE ELSE x END) AS xmax, greatest(y + w, y + w * (v + d)) AS ymax,
          radians(w) * ({_q('y + w')} - {_q('y')}) / 1e6 - radians(w * 0.5::DOUBLE) * ({_q('y + w * 0.75::DOUBLE')} - {_q('y + w * 0.25::DOUBLE')}) / 1e6 + radians(w * d) * ({_q('y + w * (v + d)')} - {_q('y + w * v')}) / 1e6 AS km2 FROM p),
        j AS (SELECT *, CASE WHEN request_id % 19 = 0 AND request_id % 11 <> 0 THEN 'UNPARSABLE' WHEN request_id % 11 = 0 THEN 'NOT_A_POLYGON' WHEN wide AND (h < 2 OR s = 2) THEN 'INVALID_TOPOLOGY' WHEN x < -180 OR xmax > 180 OR y < -90 OR ymax > 90 THEN 'OUT_OF_BOUNDS'
          WHEN NOT wide OR km2 NOT BETWEEN 0.1 AND 5000 THEN 'AREA_OUT_OF_LIMITS' WHEN event_date > DATE '2020-02-05' THEN 'EVENT_IN_FUTURE' END AS reject_code FROM b)
        SELECT request_id, reject_code, CASE WHEN reject_code IS NULL THEN round(km2, 4) END AS area_km2, CASE WHEN reject_code IS NULL THEN round(xmax, 6) END AS xmax FROM j""",
    "geodesic_area": _A + f" SELECT request_id, CASE WHEN w > 0 THEN round({_RECT}, 4) ELSE 0 END AS area_km2 FROM a",
    "utm_zone": _A + " SELECT request_id, CAST(CASE WHEN y * 1.2::DOUBLE >= 84 THEN 3413 WHEN y * 1.2::DOUBLE <= -80 THEN 3031 ELSE CASE WHEN y >= 0 THEN 32600 ELSE 32700 END + greatest(1, least(60, CAST(floor((x + 180) / 6) AS INT) + 1)) END AS INT) AS epsg FROM a",
    "project_utm": _A + _UTM + " SELECT request_id, round(CASE WHEN y > -80 THEN 500000 + 0.9996 * r * e ELSE " + _CAP + " * sin(radians(x)) END, 3) AS east, round(CASE WHEN y > -80 THEN CASE WHEN y >= 0 THEN 0 ELSE 10000000 END + 0.9996 * r * n ELSE " + _CAP + " * cos(radians(x)) END, 3) AS north FROM k",
    "clip_to_aoi": with_tables("buildings", "scene_boxes") + """, w AS (SELECT request_id, round(xmin * 200) - 50 AS x0, round(ymin * 200) - 50 AS y0, round(xmax * 200) + 50 AS x1, round(ymax * 200) + 50 AS y1 FROM scene_boxes),
        c AS (SELECT request_id, feature_id, greatest(xmin, x0) AS xmin, greatest(ymin, y0) AS ymin, least(xmax, x1) AS xmax, least(ymax, y1) AS ymax, xmin < x0 OR ymin < y0 OR xmax > x1 OR ymax > y1 AS clipped
        FROM buildings JOIN w ON request_id = CAST(feature_id AS BIGINT) % 25) SELECT * FROM c WHERE xmin <= xmax AND ymin <= ymax""",
    "artifact_inventory": _FOUND + " SELECT path, sha256, CAST(size_bytes AS BIGINT) AS size_bytes, media_type FROM found",
    "layer_catalog": _FOUND + " SELECT path, media_type FROM found WHERE page_id % 5 IN (0, 3)",
    "manifest_reconcile": _FOUND + """, listed AS (SELECT CASE WHEN page_id % 13 = 0 THEN '../' || path ELSE path END AS path, CASE WHEN page_id % 7 = 0 THEN '00' ELSE sha256 END AS listed FROM found WHERE page_id % 11 <> 0)
        SELECT coalesce(l.path, f.path) AS path, CASE WHEN starts_with(l.path, '..') THEN 'unsafe' WHEN l.path IS NULL THEN 'unlisted' WHEN f.path IS NULL THEN 'missing' WHEN listed <> sha256 THEN 'hash_mismatch' ELSE 'ok' END AS status FROM listed l FULL JOIN found f ON l.path = f.path""",
    "run_manifest": _FOUND + f", requests AS ({_REQUESTS}), pairs AS ({scene_queries.ORACLES['adaptive_pairing']}), log AS (SELECT * FROM ({with_tables('stage_log')} SELECT * FROM stage_log))" + """,
        last AS (SELECT CAST(CAST(job_id AS BIGINT) % 25 AS INT) AS request_id, stage, arg_max(status, seq) AS status FROM log GROUP BY 1, 2), by_stage AS (SELECT request_id, string_agg(stage || '=' || status, ';' ORDER BY stage) AS stages FROM last GROUP BY request_id)
        SELECT request_id, sha256('{"event_date":"' || event_date || '","request_id":' || request_id || '}') AS request_sha256, sha256(string_agg(path || '=' || sha256, ';' ORDER BY path)) AS artifacts_sha256, any_value(pre_id) AS pre_id, any_value(post_id) AS post_id, any_value(stages) AS stages
        FROM requests LEFT JOIN found ON page_id % 25 = request_id LEFT JOIN pairs USING (request_id) LEFT JOIN by_stage USING (request_id) GROUP BY request_id, event_date""",
    "redact_text": r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)(password|passwd|token|secret|authorization|api[_-]?key)(\s*[=:]\s*)([^\s,;&]+)', '\1\2[REDACTED]', 'g'), '(?i)\bBearer\s+[^\s,;&]+', 'Bearer [REDACTED]', 'g')) AS redacted_md5 FROM documents",
    "mask_evaluation": """WITH c AS (SELECT count(*) FILTER (quality > 0 AND toxic > 0) AS tp, count(*) FILTER (quality > 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic > 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels)
        SELECT *, round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round(tp / (tp + fp + fn), 9) AS iou, round((tp + fp) * 0.0001::DOUBLE, 9) AS predicted_km2, round((tp + fn) * 0.0001::DOUBLE, 9) AS reference_km2 FROM c""",
    "raster_evaluation": with_tables("flood") + f""", surveyed AS ({_SURVEYED}), met AS (SELECT mask AS p, value AS r FROM flood f JOIN surveyed s ON s.grid_id = f.grid_id AND s.y = (f.y * 10 + 10) // 20 AND s.x = (f.x * 10 + 20) // 20 WHERE (f.y * 96 + f.x) % 37 <> 0 AND mask IS NOT NULL AND value IS NOT NULL),
        c AS (SELECT count(*) FILTER (p > 0 AND r > 0) AS tp, count(*) FILTER (p > 0 AND r = 0) AS fp, count(*) FILTER (p = 0 AND r > 0) AS fn, count(*) FILTER (p = 0 AND r = 0) AS tn FROM met)
        SELECT *, round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round(tp / (tp + fp + fn), 9) AS iou, round((tp + fp) * 0.0001::DOUBLE, 9) AS predicted_km2, round((tp + fn) * 0.0001::DOUBLE, 9) AS reference_km2 FROM c""",
    "job_status_rollup": _JOBS + " SELECT status, count(*) AS jobs, count(*) FILTER (status IN ('QUEUED', 'RUNNING')) AS pending FROM jobs GROUP BY status",
    "mark_interrupted": _JOBS + " SELECT job_id, CASE WHEN status IN ('QUEUED', 'RUNNING') THEN 'FAILED' ELSE status END AS status, CASE WHEN status IN ('QUEUED', 'RUNNING') THEN coalesce(running, latest) END AS error_stage FROM jobs",
    "stage_durations": with_tables("stage_log") + " SELECT job_id, seq, CAST(floor(date_diff('microsecond', started_at, lead(started_at) OVER w) / 1000) AS BIGINT) AS duration_ms, CAST(least(99, ((row_number() OVER w - 1) * 100 + percent) // 9) AS INT) AS progress FROM stage_log WINDOW w AS (PARTITION BY job_id ORDER BY started_at, seq)",
    "pending_requests": with_tables("stage_log") + " SELECT seq FROM stage_log a WHERE seq % 3 = 0 AND NOT EXISTS (SELECT 1 FROM stage_log b WHERE b.seq % 5 = 0 AND b.status = 'SUCCEEDED' AND b.job_id = a.job_id AND b.stage = a.stage AND epoch(TIMESTAMP '2024-01-12 00:00:00') - epoch(b.started_at) < 864001)",
    "report_metrics": f"""WITH flood AS ({pixel_queries.ORACLES['flood_summary']}), areas AS (SELECT grid_id, count(*) AS regions FROM ({pixel_queries.ORACLES['flood_regions']}) GROUP BY grid_id), {_BY_GRID}, access AS ({network_queries.ORACLES['connectivity_summary']}),
        wide AS MATERIALIZED (SELECT q.request_id, flood.*, areas.*, b.*, r.*, g.*, access.* FROM ({_REQUESTS}) q LEFT JOIN flood ON flood.grid_id = q.request_id LEFT JOIN areas ON areas.grid_id = q.request_id LEFT JOIN b ON b.grid_id = q.request_id
          LEFT JOIN r ON r.grid_id = q.request_id LEFT JOIN g ON g.grid_id = q.request_id LEFT JOIN access ON access.request_id = q.request_id) """
        + " UNION ALL ".join(f"SELECT request_id, '{label}' AS label, round(CAST({c} AS DOUBLE), 6) AS value FROM wide WHERE {c} IS NOT NULL" for c, label in rc.LABELS.items()),
    "analysis_document": f"""WITH found AS (SELECT request_id, string_agg('{{"scene_id":"' || scene_id || '","platform":"' || platform || '"}}', ',' ORDER BY scene_id) AS scenes FROM ({with_tables('scenes')} SELECT * FROM scenes) GROUP BY request_id),
        pairs AS ({scene_queries.ORACLES['adaptive_pairing']}), flood AS ({pixel_queries.ORACLES['flood_summary']}), {_BY_GRID}
        SELECT q.request_id, '{{"request_id":' || q.request_id || ',"event_date":"' || event_date || '","scenes":[' || coalesce(scenes, '') || ']' || ',"pairing":{{"status":"' || status || '"' || coalesce(',"window_days":' || window_days || ',"pre_id":"' || pre_id || '","post_id":"' || post_id || '"', '') || '}}'
          || coalesce(',"hazard":{{"pixels":' || pixels || ',"valid_pixels":' || valid_pixels || ',"flooded_pixels":' || flooded_pixels || '}}', '')
          || CASE WHEN b.grid_id IS NULL AND r.grid_id IS NULL AND g.grid_id IS NULL THEN '' ELSE ',"exposure":{{' || concat_ws(',', '"buildings":' || buildings, '"affected_buildings":' || affected_buildings, '"bridges":' || bridges, '"affected_bridges":' || affected_bridges) || '}}' END || '}}' AS document
        FROM ({_REQUESTS}) q LEFT JOIN found USING (request_id) LEFT JOIN pairs USING (request_id) LEFT JOIN flood ON flood.grid_id = q.request_id LEFT JOIN b ON b.grid_id = q.request_id LEFT JOIN r ON r.grid_id = q.request_id LEFT JOIN g ON g.grid_id = q.request_id""",
    "feature_layer_roundtrip": with_tables("places") + " SELECT feature_id, name, category, 'map contributors' AS attribution, 'ODbL' AS licence, x, y FROM places",
    "scene_intake_stream": with_tables("scenes") + " SELECT request_id, scene_id, CASE WHEN ingest_seq % 3 = 0 THEN 'again' ELSE platform END AS platform FROM scenes",
    "job_state_stream": with_tables("stage_log") + " SELECT job_id, arg_max(status, (started_at, seq)) AS status, arg_max(stage, (started_at, seq)) AS stage FROM stage_log GROUP BY job_id",
}
