"""Scene catalogue and pre/post pairing, for many requests at once.

Every table leads with ``request_id``; joins, groups and windows are by it, so
requests are independent and the work spreads by request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import clamp, ratio, rectangle_km2
from ..policy import DEFAULT, Policy

#: Fields that both scenes of a pair must have and share, in the order of the reasons.
MATCHED = ["instrument_mode", "polarizations", "orbit_direction", "relative_orbit", "product_type"]


def _first(properties: str, *keys: str) -> Column:
    return F.coalesce(*[F.try_element_at(properties, F.lit(k)) for k in keys])


def normalize_scene_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scenes of catalogue items ``(request_id, item json)``, and the items without a usable time."""
    schema = "id string, properties map<string,string>, assets map<string,struct<href:string,roles:array<string>>>"
    x = items.withColumn("j", F.from_json("item", schema)).select("*", F.col("j.properties").alias("p"), F.map_values("j.assets").alias("a"))
    pols = _first("p", "sar:polarizations", "polarization")
    with_href = F.filter("a", lambda v: v["href"].isNotNull())
    data = F.filter(with_href, lambda v: F.array_contains(v["roles"], "data"))
    out = x.select(
        "request_id", "item", F.col("j.id").alias("scene_id"),
        F.lower(F.coalesce(F.try_element_at("p", F.lit("platform")), F.lit("unknown"))).alias("platform"),
        F.to_timestamp(F.try_element_at("p", F.lit("datetime"))).alias("acquired_at"),
        F.upper(_first("p", "sar:product_type", "product:type", "productType")).alias("product_type"),
        F.upper(_first("p", "sar:instrument_mode", "instrumentMode")).alias("instrument_mode"),
        F.array_sort(F.array_distinct(F.transform(
            F.when(pols.isNull(), F.array().cast("array<string>")).when(pols.startswith("["), F.from_json(pols, "array<string>")).otherwise(F.array(pols)), F.upper,
        ))).alias("polarizations"),
        F.upper(_first("p", "sat:orbit_state", "sar:orbit_direction", "orbitDirection")).alias("orbit_direction"),
        _first("p", "sat:relative_orbit", "sat:relative_orbit_number", "relativeOrbitNumber").try_cast("int").alias("relative_orbit"),
        F.try_element_at("p", F.lit("eo:cloud_cover")).try_cast("double").alias("cloud_cover"),
        F.coalesce(F.get(data, 0)["href"], F.get(with_href, 0)["href"]).alias("asset_href"),
    )
    return out.where("acquired_at IS NOT NULL").drop("item"), out.where("acquired_at IS NULL").select("request_id", "item")


def in_event_window(scenes: DataFrame, requests: DataFrame, days: int) -> DataFrame:
    """Scenes from the start of event - days to the end of event + days."""
    at, event = F.col("acquired_at"), F.col("event_date")
    return scenes.join(requests.select("request_id", "event_date"), "request_id").where((at >= F.date_sub(event, days)) & (at < F.date_add(event, days + 1)))


def filter_scenes(scenes: DataFrame, equals: dict[str, object] | None = None, at_most: dict[str, float] | None = None, max_cloud_cover: float | None = None) -> DataFrame:
    """Property comparisons; scenes of unknown cloud cover fail a cloud limit."""
    if max_cloud_cover is not None and not 0 <= max_cloud_cover <= 100:
        raise ValueError("cloud cover is a percentage")
    out = scenes
    for name, value in (equals or {}).items():
        out = out.where(F.col(name) == F.lit(value))
    for name, value in ((at_most or {}) | ({} if max_cloud_cover is None else {"cloud_cover": max_cloud_cover})).items():
        out = out.where(F.col(name) <= value)
    return out


def dedupe_scenes(scenes: DataFrame) -> DataFrame:
    """One row per request and scene: the one taken in last."""
    order = Window.partitionBy("request_id", "scene_id").orderBy(F.desc("ingest_seq"))
    return scenes.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def scene_coverage(scenes: DataFrame, aois: DataFrame) -> DataFrame:
    """Share of the area of interest that a rectangular footprint covers."""
    both = scenes.join(aois.selectExpr("request_id", "xmin AS ax0", "ymin AS ay0", "xmax AS ax1", "ymax AS ay1"), "request_id")
    common = rectangle_km2(F.greatest("xmin", "ax0"), F.greatest("ymin", "ay0"), F.least("xmax", "ax1"), F.least("ymax", "ay1"))
    whole = rectangle_km2(F.col("ax0"), F.col("ay0"), F.col("ax1"), F.col("ay1"))
    return both.withColumn("aoi_coverage_fraction", F.least(F.lit(1.0), ratio(common, whole))).drop("ax0", "ay0", "ax1", "ay1")


def _reasons(policy: Policy) -> Column:
    """Why a pair is rejected, in order; empty if it is valid."""
    found = []
    for name in MATCHED:
        a, b = F.col(f"pre.{name}"), F.col(f"post.{name}")
        if name != "polarizations":
            found.append(F.when(a.isNull() | b.isNull(), F.lit(f"missing_{name}")).when(a != b, F.lit(f"mismatched_{name}")))
        else:
            found.append(F.when(~a.eqNullSafe(b), F.lit(f"mismatched_{name}")))
    for side in ("pre", "post"):
        found.append(F.when(F.col(f"{side}.aoi_coverage_fraction") < policy.minimum_aoi_coverage, F.lit(f"insufficient_aoi_coverage_{side}")))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _sides(scenes: DataFrame, requests: DataFrame, days: int | None) -> DataFrame:
    """Scenes before and after the event day, with their day and how many days lie between; none of the day itself."""
    s = scenes.join(requests.select("request_id", "event_date"), "request_id").withColumn("day", F.to_date("acquired_at"))
    s = s.withColumn("gap", F.abs(F.datediff("day", "event_date"))).where("gap > 0")
    return s if days is None else s.where(F.col("gap") <= days)


def _paired(sides: DataFrame, policy: Policy, on: list[str]) -> DataFrame:
    """Scenes before with scenes after, of one request and equal in the columns ``on`` (null equals null)."""
    fields = F.struct(*[c for c in sides.columns if c not in ("request_id", "event_date", "gap")])
    kept = ["request_id", "event_date", *on]
    pre = sides.where("day < event_date").select(*kept, fields.alias("pre"))
    post = sides.where("day > event_date").select("request_id", *[F.col(c).alias(f"_{c}") for c in on], fields.alias("post"))
    both = pre["request_id"] == post["request_id"]
    for c in on:
        both = both & pre[c].eqNullSafe(post[f"_{c}"])
    gaps = [F.datediff("event_date", "pre.day").alias("pre_days"), F.datediff("post.day", "event_date").alias("post_days")]
    return pre.join(post, both).select(pre["request_id"], "event_date", "pre", "post", _reasons(policy).alias("reasons"), *gaps)


def _kinds(scenes: DataFrame, requests: DataFrame, policy: Policy, days: int | None) -> tuple[DataFrame, DataFrame]:
    """Both sides' scenes with their kind, and what each pair of kinds of a request has against it.

    Scenes that agree in all that reasons depend on are of one kind, so a
    pair's reasons follow from its kinds.
    """
    low = F.coalesce(F.col("aoi_coverage_fraction") < policy.minimum_aoi_coverage, F.lit(False)).alias("low")
    sides = _sides(scenes, requests, days).withColumn("kind", F.to_json(F.struct(*MATCHED, low))).withColumn("before", F.col("day") < F.col("event_date"))
    stand_in = F.when(low, F.lit(policy.minimum_aoi_coverage - 1))
    kinds = sides.groupBy("request_id", "before", "kind").agg(F.count("*").alias("n"), F.first(F.struct(*MATCHED, stand_in.alias("aoi_coverage_fraction"))).alias("like"))
    side = lambda name, before: kinds.where("before" if before else "NOT before").select("request_id", F.col("kind").alias(f"{name}_kind"), F.col("n").alias(f"{name}_n"), F.col("like").alias(name))
    met = side("pre", True).join(side("post", False), "request_id").withColumn("reasons", _reasons(policy))
    return sides, met.select("request_id", "pre_kind", "post_kind", "reasons", F.size("reasons").alias("against"), (F.col("pre_n") * F.col("post_n")).alias("pairs"))


def _of_kinds(sides: DataFrame, met: DataFrame) -> DataFrame:
    """The pairs of scenes of pairs of kinds ``met``."""
    fields = F.struct(*[c for c in sides.columns if c not in ("request_id", "event_date", "gap", "kind", "before")])
    pre = sides.where("before").select("request_id", "event_date", F.col("kind").alias("pre_kind"), fields.alias("pre"))
    post = sides.where("NOT before").select("request_id", F.col("kind").alias("post_kind"), fields.alias("post"))
    gaps = [F.datediff("event_date", "pre.day").alias("pre_days"), F.datediff("post.day", "event_date").alias("post_days")]
    met = met.select("request_id", "pre_kind", "post_kind", "reasons")
    return met.join(pre, ["request_id", "pre_kind"]).join(post, ["request_id", "post_kind"]).select("request_id", "event_date", "pre", "post", "reasons", *gaps)


def scene_pairs(scenes: DataFrame, requests: DataFrame, policy: Policy = DEFAULT, days: int | None = None) -> DataFrame:
    """All pairs of a scene before and a scene after the event day, with reasons and day gaps.

    Pairs are dealt out by request and kind, and reasons are found once a pair of kinds.
    """
    return _of_kinds(*_kinds(scenes, requests, policy, days))


def _usable(sides: DataFrame, policy: Policy) -> DataFrame:
    """Scenes that can be in a valid pair: covering enough, with nothing missing that must match."""
    usable = F.coalesce(F.col("aoi_coverage_fraction") >= policy.minimum_aoi_coverage, F.lit(True))
    for name in MATCHED:
        if name != "polarizations":
            usable = usable & F.col(name).isNotNull()
    return sides.where(usable)


def _closeness(window: Column, policy: Policy) -> Column:
    """What a scene's own gap adds to the score of its pairs, weighed."""
    midnight, at = F.col("event_date").cast("timestamp_ntz"), F.col("acquired_at")
    close = lambda gap: F.greatest(F.lit(0.0), 1 - gap / window)
    before, after = close(_gap_days(midnight, at)) * policy.weight_pre_closeness, close(_gap_days(at, midnight)) * policy.weight_post_closeness
    return F.when(F.col("day") < F.col("event_date"), before).otherwise(after)


def _leading(sides: DataFrame, window: Column, policy: Policy) -> DataFrame:
    """The usable ``sides`` of which one can be in a best pair.

    Among scenes alike in all that must match, in platform and footprint, one
    can win only if none covers as much and is nearer in time, or as near with
    a smaller id; unknown coverage counts as the other side's.  Pairs of which
    a criterion is unknown go by their ids alone, so the first id of each kind,
    with and without coverage, stays, too.  Scores never fall with coverage and
    closeness, as long as no weight is negative.
    """
    if min(policy.weight_pre_closeness, policy.weight_post_closeness, policy.weight_coverage) < 0:
        return sides
    alike = ["request_id", F.col("day") < F.col("event_date"), *MATCHED, "platform", "xmin", "ymin", "xmax", "ymax"]
    kind, known = Window.partitionBy(*alike), Window.partitionBy(*alike, F.col("aoi_coverage_fraction").isNull())
    ranked = sides.withColumn("_far", F.struct((-_closeness(window, policy)).alias("far"), "scene_id"))
    better = F.min("_far").over(kind.orderBy(F.desc_nulls_first("aoi_coverage_fraction"), "_far").rowsBetween(Window.unboundedPreceding, -1))
    ranked = ranked.withColumns({"_better": better, "_first": F.row_number().over(known.orderBy("scene_id"))})
    return ranked.where("_better IS NULL OR _far < _better OR _first = 1").drop("_far", "_better", "_first")


def leading_pairs(scenes: DataFrame, requests: DataFrame, window: int, policy: Policy = DEFAULT) -> DataFrame:
    """Those of ``valid_pairs`` within so many days, among them each request's best by ``score_pairs`` of that window."""
    return _paired(_leading(_usable(_sides(scenes, requests, window), policy), F.lit(window), policy), policy, MATCHED)


def valid_pairs(scenes: DataFrame, requests: DataFrame, policy: Policy = DEFAULT, days: int | None = None) -> DataFrame:
    """The pairs of ``scene_pairs`` without a reason against them; only scenes that match are joined."""
    return _paired(_usable(_sides(scenes, requests, days), policy), policy, MATCHED)


def near_pairs(scenes: DataFrame, requests: DataFrame, policy: Policy = DEFAULT, days: int | None = None, most: int = 20) -> DataFrame:
    """Pairs of ``scene_pairs``, among them of each request the first ``most`` and one more by number of reasons, days and ids.

    A threshold join: counting kinds tells how many reasons the last pair
    wanted has.  Of a pair of kinds only those scenes can be wanted that are
    among the first so many of their kind and side: any other has as many
    nearer ones to take its place.  So a request's scenes are never all paired.
    """
    sides, met = _kinds(scenes, requests, policy, days)
    fewer = Window.partitionBy("request_id").orderBy("against").rowsBetween(Window.unboundedPreceding, -1)
    wanted = met.groupBy("request_id", "against").agg(F.sum("pairs").alias("pairs")).withColumn("fewer", F.coalesce(F.sum("pairs").over(fewer), F.lit(0))).where(F.col("fewer") <= most)
    met = met.join(wanted.select("request_id", "against"), ["request_id", "against"])
    first = Window.partitionBy("request_id", "before", "kind").orderBy("gap", "scene_id")
    return _of_kinds(sides.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most + 1).drop("_n"), met)


def first_window_pairs(scenes: DataFrame, requests: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Valid pairs of the first window of the ladder that has one, the best among them, with ``window_days``.

    A pair fits a window if both gaps do, so the smallest window of a group of
    scenes that match follows from its least gap on either side.  An
    aggregation finds each request's window, and only scenes inside it that
    match are joined.
    """
    sides = _usable(_sides(scenes, requests, policy.max_window_days), policy)
    least = [F.min(F.when(side, F.col("gap"))) for side in (F.col("day") < F.col("event_date"), F.col("day") > F.col("event_date"))]
    # A group without scenes on one side has no pair; greatest would pass over its null.
    gap = F.when(least[0].isNotNull() & least[1].isNotNull(), F.greatest(*least))
    windows = sides.groupBy("request_id", *MATCHED).agg(gap.alias("gap")).groupBy("request_id").agg(F.min("gap").alias("least"))
    fits = F.lit(None).cast("int")
    for days in reversed(policy.windows):
        fits = F.when(F.col("least") <= days, F.lit(days)).otherwise(fits)
    windows = windows.select("request_id", fits.alias("window_days")).where("window_days IS NOT NULL")
    near = sides.join(windows, "request_id").where("gap <= window_days")
    return _paired(_leading(near, F.col("window_days"), policy).drop("window_days"), policy, MATCHED).join(windows, "request_id")


def _gap_days(later: Column, earlier: Column) -> Column:
    return F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", earlier, later) / 86400)


def score_pairs(pairs: DataFrame, window: Column, policy: Policy = DEFAULT) -> DataFrame:
    """``pairs`` with the criteria and the score that a search window of so many days gives."""
    midnight = F.col("event_date").cast("timestamp_ntz")
    close = lambda gap: F.greatest(F.lit(0.0), 1 - gap / window)
    box = lambda s: [F.col(f"{s}.{c}") for c in ("xmin", "ymin", "xmax", "ymax")]
    a, b = box("pre"), box("post")
    common = rectangle_km2(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = rectangle_km2(*a) + rectangle_km2(*b) - common
    out = pairs.withColumns({
        "footprint_overlap": clamp(ratio(common, union), 0.0, 1.0),
        "pre_closeness": close(_gap_days(midnight, F.col("pre.acquired_at"))),
        "post_closeness": close(_gap_days(F.col("post.acquired_at"), midnight)),
        "same_platform": (F.col("pre.platform") == F.col("post.platform")).cast("double"),
        "coverage": F.least("pre.aoi_coverage_fraction", "post.aoi_coverage_fraction"),
    })
    p = policy
    total = F.col("footprint_overlap") * p.weight_overlap + F.col("pre_closeness") * p.weight_pre_closeness + F.col("post_closeness") * p.weight_post_closeness + F.col("same_platform") * p.weight_same_platform + F.col("coverage") * p.weight_coverage
    return out.withColumn("score", clamp(total, 0.0, 1.0))


def best_pair(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The valid pair with the best score; ties by scene ids."""
    order = Window.partitionBy(*(by or ["request_id"])).orderBy(F.desc("score"), "pre.scene_id", "post.scene_id")
    return scored.where(F.size("reasons") == 0).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def pair_alternatives(pairs: DataFrame, best: DataFrame, most: int = 20) -> DataFrame:
    """Up to ``most`` other pairs per request: fewest reasons, then nearest in days, then ids.

    ``pairs`` may be all of them or just ``near_pairs``.
    """
    won = best.select("request_id", F.col("pre.scene_id").alias("_a"), F.col("post.scene_id").alias("_b"))
    rest = pairs.join(won, (pairs["request_id"] == won["request_id"]) & (pairs["pre.scene_id"] == won["_a"]) & (pairs["post.scene_id"] == won["_b"]), "left_anti")
    order = Window.partitionBy("request_id").orderBy(F.size("reasons"), F.col("pre_days") + F.col("post_days"), "pre.scene_id", "post.scene_id")
    out = rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return out.withColumn("reasons", F.when(F.size("reasons") == 0, F.array(F.lit("lower_score_than_selected"))).otherwise(F.col("reasons")))


def adaptive_pairing(scenes: DataFrame, requests: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Per request the best pair of the first window of the ladder that has a valid one, or why there is none."""
    best = best_pair(score_pairs(first_window_pairs(scenes, requests, policy), F.col("window_days"), policy))
    failed = pair_failures(scenes, requests, policy.max_window_days)
    out = failed.join(best.select("request_id", "window_days", "pre", "post", "score"), "request_id", "left")
    status = F.when(F.col("score").isNotNull(), F.lit("PAIRED")).otherwise(F.col("failure"))
    return out.select("request_id", status.alias("status"), "window_days", F.col("pre.scene_id").alias("pre_id"), F.col("post.scene_id").alias("post_id"), "score")


def pair_failures(scenes: DataFrame, requests: DataFrame, days: int) -> DataFrame:
    """What a request without a valid pair fails by; counts of scenes and pairs besides.

    Coverage alone is to blame if all scenes of both sides match: then they all
    have the same known fields.  So neither the count nor the reason needs the
    pairs themselves.
    """
    counted = in_event_window(scenes, requests, days).groupBy("request_id").agg(F.count("*").alias("scenes"))
    known = F.lit(True)
    for name in MATCHED:
        if name != "polarizations":
            known = known & F.col(name).isNotNull()
    kinds = _sides(scenes, requests, days).groupBy("request_id", *MATCHED).agg(F.count_if(F.col("day") < F.col("event_date")).alias("before"), F.count_if(F.col("day") > F.col("event_date")).alias("after"))
    judged = kinds.groupBy("request_id").agg((F.sum("before") * F.sum("after")).alias("pairs"), ((F.count("*") == 1) & F.bool_and(known)).alias("alike"))
    out = requests.select("request_id").join(counted, "request_id", "left").join(judged, "request_id", "left")
    short = F.coalesce(F.col("alike") & (F.col("pairs") > 0), F.lit(False))
    failure = F.when(F.col("scenes").isNull(), F.lit("NO_S1_SCENES")).when(short, F.lit("S1_INSUFFICIENT_AOI_COVERAGE")).otherwise(F.lit("S1_NO_VALID_PAIR"))
    return out.select("request_id", failure.alias("failure"), F.coalesce("scenes", F.lit(0)).alias("scenes"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


def pair_warnings(best: DataFrame, window: Column, policy: Policy = DEFAULT) -> DataFrame:
    """Ordered warnings of chosen pairs: other platforms, and a long gap over both sides together."""
    gap = (1 - F.col("pre_closeness")) * window + (1 - F.col("post_closeness")) * window
    found = F.array(F.when(F.col("same_platform") == 0, F.lit("platforms_differ")), F.when(gap > policy.long_gap_warning_days, F.lit("long_gap")))
    return best.select("request_id", F.filter(found, lambda w: w.isNotNull()).alias("warnings"))
