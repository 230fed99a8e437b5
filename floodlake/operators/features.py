"""Map features, areas of interest and snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import ring_km2
from ..policy import DEFAULT, Policy
from . import validity

# Tag values that make a settlement or a place of healthcare.
SETTLEMENTS = ["city", "town", "village", "hamlet", "isolated_dwelling", "suburb", "neighbourhood"]
HEALTHCARE = ["hospital", "clinic", "doctors", "health_centre"]


def category(tags: str, kind: Column) -> Column:
    """Category by tags and geometry kind (point, line, polygon); the first that fits, else null."""
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    site = kind.isin("point", "polygon")
    return (
        F.when((kind == "polygon") & tag("building").isNotNull() & (tag("building") != "no"), "building")
        .when((kind == "line") & (F.coalesce(tag("highway"), F.lit("")) != ""), "road")
        .when(site & tag("place").isin(*SETTLEMENTS), "settlement")
        .when(site & (F.coalesce(tag("amenity").isin(*HEALTHCARE), F.lit(False)) | F.coalesce(tag("healthcare").isin(*HEALTHCARE), F.lit(False))), "healthcare")
    )


def snapshot_asof(versions: DataFrame, events: DataFrame) -> DataFrame:
    """State of each feature at 23:59:59 on the day before each event: its last version until then, unless that deletes it.

    An as-of merge.  The event dates, in order, bound spans of time; each
    version falls into one span, found by merging its day with the dates, and
    only a feature's last version of each span goes on.  One ordered window per
    feature says until which span a version holds; events take the versions
    that hold at their date.  Days are merged in one task: there are as many
    as the history has, whatever the number of versions and events.
    """
    second = F.expr("version_ts + INTERVAL '1' SECOND")
    # The first date on whose eve at 23:59:59 the version is known.
    day = F.when(second == F.to_date(second).cast(dict(versions.dtypes)["version_ts"]), F.to_date(second)).otherwise(F.date_add(F.to_date(second), 1))
    known = versions.where("version_ts IS NOT NULL").withColumn("day", day)
    dates = events.select(F.col("event_date").cast("date").alias("day")).where("day IS NOT NULL").distinct().withColumn("at", F.row_number().over(Window.orderBy("day")))
    days = known.select("day").distinct().withColumn("at", F.lit(None).cast("int")).unionByName(dates).groupBy("day").agg(F.max("at").alias("at"))
    spans = days.select("day", F.first("at", ignorenulls=True).over(Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)).alias("at")).where("at IS NOT NULL")
    # Versions are combined before they are shuffled.
    last = known.join(spans, "day").groupBy("feature_id", "at").agg(F.max(F.struct("version_ts", "version", "deleted", "value")).alias("v")).select("feature_id", "at", "v.version", "v.deleted", "v.value")
    until = last.withColumn("next", F.lead("at").over(Window.partitionBy("feature_id").orderBy("at"))).where("deleted = 0")
    # The last version holds at all later dates.
    held = until.select("feature_id", "version", "value", F.explode(F.sequence("at", F.coalesce(F.col("next") - 1, F.lit(dates.count())))).alias("at"))
    asked = events.select("request_id", F.col("event_date").cast("date").alias("day")).join(dates, "day").select("request_id", "at")
    return asked.join(held, "at").select("request_id", "feature_id", "version", "value")


def validate_aois(requests: DataFrame, today: Column | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """``requests(request_id, kind, xs, ys, event_date)`` with reject_code (null if fine), area and box; the first broken rule counts.

    ``xs`` and ``ys`` are the open ring in degrees, equally long.
    """
    ring = F.when(F.size("xs") == F.size("ys"), F.array(F.array(F.zip_with("xs", "ys", lambda x, y: F.struct(x.alias("x"), y.alias("y"))))))
    return validate_areas(requests.withColumn("polygons", ring), today, policy).drop("polygons")


def validate_areas(requests: DataFrame, today: Column | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """``requests(request_id, kind, polygons, event_date)`` with reject_code (null if fine), area and box; the first broken rule counts.

    ``polygons`` is an array of parts, each an array of rings of points in
    degrees: the outer ring, then the holes.  A Polygon has one part; a
    MultiPolygon one or more.  Rings have three points or more.  Shapes are
    looked through once, however many requests ask for them; equal 64-bit
    hashes stand for equal shapes.
    """
    points = F.flatten(F.flatten("polygons"))
    parts = F.size("polygons")
    whole = F.forall("polygons", lambda part: F.coalesce(F.size(part) > 0, F.lit(False)) & F.forall(part, lambda r: F.coalesce(F.size(r) >= 3, F.lit(False))))
    ring = F.coalesce((parts > 0) & whole & ((parts == 1) | (F.col("kind") == "MultiPolygon")), F.lit(False))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    ends = {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}
    outside = (F.col("xmin") < -180) | (F.col("xmax") > 180) | (F.col("ymin") < -90) | (F.col("ymax") > 90)
    ring_area_km2 = lambda r: ring_km2(F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"]))
    part_km2 = lambda part: F.aggregate(F.slice(part, 2, F.size(part)), ring_area_km2(F.get(part, 0)), lambda s, r: s - ring_area_km2(r))
    # Hashes of nested arrays take in the values only, so sizes go before them.
    sizes = [F.size("polygons"), F.transform("polygons", F.size), F.transform(F.flatten("polygons"), F.size)]
    shape, mark = "__shape", F.xxhash64(*sizes, "polygons")
    out = requests.withColumns(ends).withColumn("area_km2", F.when(ring & ~outside, F.aggregate("polygons", F.lit(0.0), lambda s, part: s + part_km2(part)))).withColumn(shape, mark)
    looked = requests.where(ring).select(mark.alias(shape), "polygons").dropDuplicates([shape])
    out = out.join(validity.faults(looked, shape).withColumnRenamed("fault", "__fault"), shape, "left")
    code = (
        F.when(F.col("kind").isNull(), "UNPARSABLE").when(~F.col("kind").isin("Polygon", "MultiPolygon") | ~ring, "NOT_A_POLYGON")
        .when(F.col("__fault").isNotNull(), "INVALID_TOPOLOGY").when(outside, "OUT_OF_BOUNDS")
        .when(~F.col("area_km2").between(policy.min_aoi_area_km2, policy.max_aoi_area_km2), "AREA_OUT_OF_LIMITS")
        .when(F.col("event_date") > (today if today is not None else F.current_date()), "EVENT_IN_FUTURE")
    )
    return out.withColumn("reject_code", code).select(*requests.columns, "area_km2", "reject_code", "xmin", "ymin", "xmax", "ymax")


def clip_to_aoi(features: DataFrame, aois: DataFrame, buffer: float) -> DataFrame:
    """Rectangular features within ``buffer`` of their request's rectangle, cut at the widened border."""
    a = aois.select("request_id", *[F.col(c).alias(f"_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    both = features.join(a, "request_id")
    cut = {c: (F.greatest(F.col(c), F.col(f"_{c}") - buffer) if c.endswith("min") else F.least(F.col(c), F.col(f"_{c}") + buffer)).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")}
    moved = F.lit(False)
    for c in cut:
        moved = moved | (F.col(c) < F.col(f"_{c}") - buffer if c.endswith("min") else F.col(c) > F.col(f"_{c}") + buffer)
    rest = [c for c in features.columns if c not in cut]
    return both.select(*rest, *cut.values(), moved.alias("clipped")).where("xmin <= xmax AND ymin <= ymax")


def loops(ring: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """An open-ended ring taken apart where it crosses or meets itself, into rings that don't; those without area are left out."""
    ring = [p for i, p in enumerate(ring) if p != ring[i - 1]]
    n = len(ring)
    if n < 3:
        return []
    a = np.array(ring)
    d = np.roll(a, -1, axis=0) - a
    cuts: list[list[tuple[float, tuple[float, float]]]] = [[] for _ in ring]
    for i in range(n - 2):
        later = slice(i + 2, n - 1 if i == 0 else n)
        gap, other = a[later] - a[i], d[later]
        with np.errstate(divide="ignore", invalid="ignore"):
            turn = d[i, 0] * other[:, 1] - d[i, 1] * other[:, 0]
            t = (gap[:, 0] * other[:, 1] - gap[:, 1] * other[:, 0]) / turn
            u = (gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) / turn
        for j in np.flatnonzero((t > 0) & (t < 1) & (u > 0) & (u < 1)):
            at = (float(a[i, 0] + t[j] * d[i, 0]), float(a[i, 1] + t[j] * d[i, 1]))
            cuts[i].append((float(t[j]), at))
            cuts[i + 2 + j].append((float(u[j]), at))
    walk = [q for p, cut in zip(ring, cuts, strict=True) for q in (p, *(at for _, at in sorted(cut)))]
    found, path, place = [], [], {}
    for p in [*walk, walk[0]]:
        if p in place:
            loop = path[place[p] :]
            x, y = np.array(loop).T
            if abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) > 0:
                found.append(loop)
            for q in loop[1:]:
                del place[q]
            path = path[: place[p] + 1]
        else:
            place[p] = len(path)
            path.append(p)
    return found


#: Rings of more points are looked through one by one.
MANY_POINTS = 64


def _sound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which open rings, one a row and of equally many points, ``loops`` gives back as they are; of some that it does, this isn't sure."""
    n = x.shape[1]
    if n < 3:
        return np.zeros(len(x), bool)
    dx, dy = np.roll(x, -1, axis=1) - x, np.roll(y, -1, axis=1) - y
    good = np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
    for k in range(1, n):
        good &= ((x[:, k:] != x[:, :-k]) | (y[:, k:] != y[:, :-k])).all(axis=1)
    one, two = x * np.roll(y, -1, axis=1), y * np.roll(x, -1, axis=1)
    good &= np.abs((one - two).sum(axis=1)) > 1e-9 * (np.abs(one) + np.abs(two)).sum(axis=1)
    for i in range(n - 2):
        later = slice(i + 2, n - 1 if i == 0 else n)
        ix, iy, jx, jy = dx[:, i : i + 1], dy[:, i : i + 1], dx[:, later], dy[:, later]
        gx, gy = x[:, later] - x[:, i : i + 1], y[:, later] - y[:, i : i + 1]
        turn = ix * jy - iy * jx
        t, u = (gx * jy - gy * jx) / turn, (gx * iy - gy * ix) / turn
        good &= ~((t > 0) & (t < 1) & (u > 0) & (u < 1)).any(axis=1)
    return good


def _repaired(kinds: pa.Array, points: pa.ListArray) -> tuple[pa.ListArray, np.ndarray]:
    """Parts of the shapes of a batch, and which took a repair; rings of equally many points are looked through side by side."""
    some = np.asarray(points.is_valid())
    offsets = np.asarray(points.offsets, dtype=np.int64)
    sizes = np.where(some, np.diff(offsets), 0)
    flat = points.values
    x, y = (np.asarray(flat.field(c).to_numpy(zero_copy_only=False), dtype=float) for c in "xy")
    given = np.asarray(kinds.is_valid()) & (np.asarray(pc.utf8_length(kinds).fill_null(0)) > 0) & (sizes > 0)
    ring = given & np.asarray(pc.equal(kinds, "polygon").fill_null(False))
    sound = np.zeros(len(sizes), bool)
    with np.errstate(all="ignore"):
        for n in np.unique(sizes[ring & (sizes <= MANY_POINTS)]):
            rows = np.flatnonzero(ring & (sizes == n))
            at = offsets[rows][:, None] + np.arange(n)
            sound[rows] = _sound(x[at], y[at])
    # Parts by where they begin among all points, those of the batch and then those of rings taken apart, and how many they are.
    whole = given & (~ring | sound)
    counts, begins, lengths = whole.astype(np.int64), [offsets[:-1][whole]], [sizes[whole]]
    owners, more, end = [np.flatnonzero(whole)], [], len(x)
    repaired = np.zeros(len(sizes), bool)
    for row in np.flatnonzero(ring & ~sound):
        span = slice(offsets[row], offsets[row] + sizes[row])
        got = loops(list(zip(x[span].tolist(), y[span].tolist(), strict=True)))
        counts[row], repaired[row] = len(got), len(got) != 1 or len(got[0]) != sizes[row]
        for loop in got:
            owners.append(np.array([row]))
            begins.append(np.array([end]))
            lengths.append(np.array([len(loop)]))
            more.extend(loop)
            end += len(loop)
    order = np.argsort(np.concatenate(owners), kind="stable")
    begin, length = np.concatenate(begins)[order], np.concatenate(lengths)[order]
    ends = np.concatenate([[0], np.cumsum(length)])
    at = np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])
    extra = np.array(more, dtype=float).reshape(-1, 2)
    xy = [pa.array(np.concatenate([a, extra[:, i]])[at]) for i, a in enumerate((x, y))]
    rings = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(xy, names=["x", "y"]))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), rings), repaired


def repair(decoded: DataFrame) -> DataFrame:
    """``decoded(kind, points)`` with parts, whose polygons' rings don't cross themselves, and whether that took a repair.

    A polygon without area has no parts and, as a null geometry, empty ones.
    """
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, repaired = _repaired(batch.column("kind"), batch.column("points"))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(repaired, pa.bool_())], names=[*batch.schema.names, "parts", "repaired"])

    ring = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
    return decoded.mapInArrow(run, T.StructType([*decoded.schema, T.StructField("parts", T.ArrayType(ring)), T.StructField("repaired", T.BooleanType())]))


def _ring_within(ring: Column, planes: Column) -> Column:
    """A ring cut by half-planes (axis, sign, bound), one after the other; empty if nothing is left."""

    def cut(path: Column, plane: Column) -> Column:
        depth = lambda p: plane["sign"] * (F.when(plane["axis"] == 0, p["x"]).otherwise(p["y"]) - plane["bound"])

        def step(p: Column, i: Column) -> Column:
            q = F.get(path, F.when(i == 0, F.size(path) - 1).otherwise(i - 1))
            t = F.try_divide(depth(q), depth(q) - depth(p))
            at = F.struct((q["x"] + (p["x"] - q["x"]) * t).alias("x"), (q["y"] + (p["y"] - q["y"]) * t).alias("y"))
            here, there = depth(p) >= 0, depth(q) >= 0
            return F.when(here & there, F.array(p)).when(here, F.array(at, p)).when(there, F.array(at)).otherwise(F.slice(F.array(p), 1, 0))

        return F.flatten(F.transform(path, step))

    return F.aggregate(planes, ring, cut)


def _line_within(line: Column, box: dict[str, Column]) -> Column:
    """The stretches of a line's edges inside a box, in their order and direction."""

    def edge(i: Column) -> Column:
        a, b = F.get(line, i), F.get(line, i + 1)
        t0, t1 = [F.lit(0.0)], [F.lit(1.0)]
        for c in "xy":
            d, near, far = b[c] - a[c], box[f"{c}min"] - a[c], box[f"{c}max"] - a[c]
            off = (d == 0) & ((near > 0) | (far < 0))
            t0.append(F.when(off, F.lit(2.0)).when(d == 0, F.lit(0.0)).otherwise(F.least(near / d, far / d)))
            t1.append(F.when(off, F.lit(-1.0)).when(d == 0, F.lit(1.0)).otherwise(F.greatest(near / d, far / d)))
        at = lambda t: F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))
        return F.when(F.greatest(*t0) < F.least(*t1), F.array(at(F.greatest(*t0)), at(F.least(*t1))))

    return F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(line) - 2, F.lit(0))), edge), lambda e: e.isNotNull())


def clip_parts(repaired: DataFrame, aois: DataFrame, buffer: float) -> DataFrame:
    """Points, lines and polygons in ``parts``, cut at their request's rectangle widened by ``buffer``, and whether any lay beyond.

    What lies wholly beyond has no parts left.  A line's parts are its edges'
    stretches inside; a hollow polygon may keep edges along the border.  Rows
    of a request without a rectangle have none left either.
    """
    box = {c: F.col(f"_{c}") + (-buffer if c.endswith("min") else buffer) for c in ("xmin", "ymin", "xmax", "ymax")}
    both = repaired.join(aois.select("request_id", *[F.col(c).cast("double").alias(f"_{c}") for c in box]), "request_id", "left")
    within = lambda p: (p["x"] >= box["xmin"]) & (p["x"] <= box["xmax"]) & (p["y"] >= box["ymin"]) & (p["y"] <= box["ymax"])
    known = F.col("_xmin").isNotNull()
    covered = known & F.forall(F.flatten("parts"), within)
    planes = F.array(*[F.struct(F.lit(axis).alias("axis"), F.lit(sign).alias("sign"), box[c].alias("bound")) for axis, sign, c in ((0, 1.0, "xmin"), (0, -1.0, "xmax"), (1, 1.0, "ymin"), (1, -1.0, "ymax"))])
    cut = (
        F.when(F.col("kind") == "polygon", F.filter(F.transform("parts", lambda r: _ring_within(r, planes)), lambda r: ring_area(r) > 0))
        .when(F.col("kind") == "line", F.flatten(F.transform("parts", lambda r: _line_within(r, box))))
        .otherwise(F.filter("parts", lambda r: F.forall(r, within)))
    )
    none = F.slice(F.col("parts"), 1, 0)
    # What lies beyond one side needs no cutting.
    apart = lambda c, side: F.forall(F.flatten("parts"), lambda p: p[c] < box[f"{c}min"] if side == "min" else p[c] > box[f"{c}max"])
    beyond = apart("x", "min") | apart("x", "max") | apart("y", "min") | apart("y", "max")
    out = both.withColumns({"clipped": ~covered, "parts": F.when(covered, F.col("parts")).when(~known | beyond, none).otherwise(cut)})
    return out.select(*repaired.columns, "clipped")


def ring_area(ring: Column) -> Column:
    """Area of a ring in the plane, measured from its first corner, so that a place far from 0 takes no digits."""
    n = F.size(ring)
    after = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    x, y = F.get(ring, 0)["x"], F.get(ring, 0)["y"]
    return F.abs(F.aggregate(F.zip_with(ring, after, lambda a, b: (a["x"] - x) * (b["y"] - y) - (a["y"] - y) * (b["x"] - x)), F.lit(0.0), lambda s, v: s + v)) / 2


def line_length(line: Column) -> Column:
    """Length of a line in the plane."""
    steps = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)


def normalize_features(decoded: DataFrame) -> DataFrame:
    """Rows ``(osm_type, osm_id, tags, kind, ...)`` with id, tags without nulls, category and outcome.

    Outcomes: dropped_empty without geometry (or without ``parts``, where rows
    have them), ignored without category, else retained.
    """
    empty = F.col("kind").isNull() | ((F.size("parts") == 0) if "parts" in decoded.columns else F.lit(False))
    tags = F.map_filter("tags", lambda k, v: v.isNotNull())
    out = decoded.withColumn("tags", tags).withColumn("category", category("tags", F.col("kind")))
    outcome = F.when(empty, "dropped_empty").when(F.col("category").isNull(), "ignored").otherwise("retained")
    return out.withColumns({"feature_id": F.concat_ws("/", "osm_type", "osm_id"), "outcome": outcome})


def feature_quality(normalized: DataFrame) -> DataFrame:
    """Rows by outcome; repaired and clipped ones, where known, are counted besides."""
    n = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    beside = [F.count_if(c).alias(c) for c in ("repaired", "clipped") if c in normalized.columns]
    return normalized.agg(F.count("*").alias("rows"), n("retained"), n("dropped_empty"), n("ignored"), *beside)
