"""The older rules for the same questions: modes by fix, gaps of trains and flights, sequential stays, drawing by fix, labels.

Speeds of points are metres a second; the rules speak of km/h. Hours and days are those of the session's time zone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators.behavior import PLACES
from wayfold.operators.spatial import _areas, _buckets
from wayfold.plans.windows import fan_out, islands, ordered

#: Colours and line widths of modes, share of importance by level of a place.
COLOURS = {"STAY": "#808080", "WALK": "#00FF00", "CAR": "#FFA500", "TRAIN": "#FF0000", "FLIGHT": "#0000FF"}
WIDTHS = {"STAY": 1, "WALK": 1, "CAR": 2, "TRAIN": 3, "FLIGHT": 4, "UNKNOWN": 1}
IMPORTANCE = {"PROVINCE": 10, "CITY": 7, "COUNTY": 5, "TOWN": 3}
MEALS = {"BREAKFAST": (7, 9), "LUNCH": (11, 13), "DINNER": (17, 19)}


def _chosen(rules: list[tuple[Column, dict[str, Column]]], otherwise: dict[str, Column]) -> Column:
    """A struct: that of the first rule that holds."""
    out = F.struct(*(v.alias(k) for k, v in otherwise.items()))
    for rule, values in reversed(rules):
        out = F.when(rule, F.struct(*(v.alias(k) for k, v in values.items()))).otherwise(out)
    return out


def _looked_up(table: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def rule_modes(points: DataFrame) -> DataFrame:
    """Points with kmh (the greater of the recorded speed and that from the fix before), hop (metres from there, null for
    a track's first fix), mode, mode_confidence and mode_reasons by the first rule that holds."""
    df = points.withColumn("_b", F.lag(F.struct("data_time", "lat", "lon", "province")).over(ordered()))
    hop, wait = geo.haversine("_b.lat", "_b.lon", "lat", "lon"), F.col("data_time") - F.col("_b.data_time")
    implied = F.coalesce(F.try_divide(hop, wait) * 3.6, F.lit(0.0))
    df = df.withColumn("hop", hop).withColumn("kmh", F.greatest(F.coalesce("speed", F.lit(0.0)) * 3.6, implied))
    v, crosses = F.col("kmh"), F.coalesce((F.length("province") > 0) & (F.length("_b.province") > 0) & (F.col("province") != F.col("_b.province")), F.lit(False))

    def mode(name: str, sure: float, *reasons: str) -> dict[str, Column]:
        return {"mode": F.lit(name), "sure": F.lit(sure), "reasons": F.array(*map(F.lit, reasons))}

    rules = [
        ((F.coalesce("altitude", F.lit(0.0)) > 1000) & v.between(200, 1000), mode("FLIGHT", 0.95, "HIGH_ALTITUDE", "FLIGHT_SPEED_RANGE")),
        (v.between(80, 350) & crosses, mode("TRAIN", 0.85, "TRAIN_SPEED_RANGE", "CROSSES_PROVINCE")),
        (v.between(80, 350), mode("CAR", 0.7, "HIGH_SPEED")),
        (v.between(20, 120), mode("CAR", 0.75, "CAR_SPEED_RANGE")),
        ((v >= 1) & (v < 10), mode("WALK", 0.8, "WALKING_SPEED")),
        (v < 1, mode("STAY", 0.9, "STATIONARY")),
    ]
    df = df.withColumn("_m", _chosen(rules, mode("UNKNOWN", 0.5, "NO_MATCHING_RULE")))
    return df.withColumns({"mode": F.col("_m.mode"), "mode_confidence": F.col("_m.sure"), "mode_reasons": F.col("_m.reasons")}).drop("_b", "_m")


def rule_segments(moded: DataFrame) -> DataFrame:
    """Runs of one mode of rule_modes' points, with the confidence and reasons of their first fix. segment_id is its id."""
    order = F.struct("data_time", "id")
    before = F.lag("mode").over(ordered())
    runs = islands(moded, F.col("mode") != before, name="run").withColumn("_begins", F.row_number().over(ordered(["track_id", "run"])) == 1)
    out = runs.groupBy("track_id", "run", "mode").agg(
        F.min("data_time").alias("start_time"), F.max("data_time").alias("end_time"), F.count("*").alias("point_count"), F.coalesce(F.sum(F.when(~F.col("_begins"), F.col("hop"))), F.lit(0.0)).alias("distance_m"),
        (F.max(F.coalesce("speed", F.lit(0.0))) * 3.6).alias("max_speed_kmh"), F.min_by(F.struct("id", "mode_confidence", "mode_reasons"), order).alias("_f"), F.max_by("id", order).alias("end_id"),
    )
    took = F.col("end_time") - F.col("start_time")
    return out.select(
        F.col("_f.id").alias("segment_id"), "end_id", "track_id", "mode", "start_time", "end_time", took.alias("duration_s"), "point_count", "distance_m",
        F.coalesce(F.try_divide(F.col("distance_m"), took) * 3.6, F.lit(0.0)).alias("avg_speed_kmh"), "max_speed_kmh", F.col("_f.mode_confidence").alias("confidence"), F.col("_f.mode_reasons").alias("reasons"),
    )


def fill_rides(points: DataFrame, gap: int = 3600, min_kmh: float = 80.0, step: int = 600, flight_m: float = 1000.0, cruise_m: float = 10_000.0) -> DataFrame:
    """Synthetic points in long gaps that were crossed fast, if the fixes around look like a train's or a flight's.

    Around: the two fixes before the gap's first and the two after its last. A flight has a mean altitude above flight_m
    and 200 to 1000 km/h, a train 80 to 350 km/h and several provinces. A flight climbs and descends for a fifth of the
    way each. Returns track_id, after_id, before_id, k (from 1), ratio, data_time, lat, lon, altitude, source.
    """
    w = ordered()
    df = points.withColumn("_b", F.lag(F.struct("id", "data_time", "lat", "lon")).over(w))
    df = df.withColumn("_dt", F.col("data_time") - F.col("_b.data_time"))
    implied = F.coalesce(F.try_divide(geo.haversine("_b.lat", "_b.lon", "lat", "lon"), F.col("_dt")) * 3.6, F.lit(0.0))
    df = df.withColumn("_v", F.when(F.col("_b").isNotNull(), implied)).withColumn("_a", F.when(F.col("_b").isNotNull(), F.coalesce("altitude", F.lit(0.0))))
    near, wide = w.rowsBetween(-2, 2), w.rowsBetween(-3, 2)
    named = F.when(F.length("province") > 0, F.col("province"))
    df = df.withColumns({"_mv": F.avg("_v").over(near), "_ma": F.avg("_a").over(near), "_p": F.min(named).over(wide), "_q": F.max(named).over(wide)})
    kind = F.when((F.col("_ma") > flight_m) & F.col("_mv").between(200, 1000), "FLIGHT").when(F.col("_mv").between(80, 350) & (F.col("_p") != F.col("_q")), "TRAIN")
    gaps = df.withColumn("_kind", kind).where((F.col("_dt") > gap) & (F.col("_v") > min_kmh) & F.col("_kind").isNotNull())
    gaps = gaps.withColumn("_n", F.greatest(F.lit(1), F.floor(F.col("_dt") / step)).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    share = F.col("k") / (F.col("_n") + 1)
    height = F.when(F.col("_kind") != "FLIGHT", 0.0).when(share < 0.2, cruise_m * share / 0.2).when(share > 0.8, cruise_m * (1 - share) / 0.2).otherwise(cruise_m)

    def between(name: str) -> Column:
        return (F.col(f"_b.{name}") + share * (F.col(name) - F.col(f"_b.{name}"))).alias(name)

    time = F.floor(F.col("_b.data_time") + share * F.col("_dt")).alias("data_time")
    return gaps.select("track_id", F.col("_b.id").alias("after_id"), F.col("id").alias("before_id"), "k", share.alias("ratio"), time, between("lat"), between("lon"), height.alias("altitude"), F.concat("_kind", F.lit("_INTERPOLATION")).alias("source"))


def _metres(a: float, b: float, c: float, d: float) -> float:
    p, q, r, s = map(math.radians, (a, b, c, d))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(max(1 - h, 0.0)))


def sequential_stays(points: DataFrame, radius_m: float = 100.0, min_s: int = 7200) -> DataFrame:
    """Stays found by walking along each track: a fix joins while it lies within radius_m of the mean of those so far.

    The mean moves with every fix, so no window can say this. Tracks are dealt by hash and sorted by Spark, and a task
    keeps only sums of the open stay, so a track may be of any length. radius_m of a stay is the greatest distance of a
    fix from the mean when it joined. Fixes without a place are left out.
    """
    names = ["track_id", "id", "data_time", "lat", "lon", *PLACES]
    rows = points.where("lat is not null and lon is not null and data_time is not null").select(*names)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    shape = f"stay_id {types['id']}, track_id {types['track_id']}, start_time long, end_time long, center_lat double, center_lon double, radius_m double, point_count long, " + ", ".join(f"{p} string" for p in PLACES)
    outputs = [part.split()[0] for part in shape.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, end, n, y, x, reach = None, 0, 0, 0.0, 0.0, 0.0
        kinds = None

        def closed() -> list[tuple]:
            if first is None or n < 2 or end - first[2] < min_s:
                return []
            return [(first[1], first[0], first[2], end, y / n, x / n, reach, n, *first[5:])]

        def table(found: list[tuple]) -> pa.RecordBatch:
            values = list(zip(*found, strict=True)) if found else [()] * len(outputs)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=outputs)

        for batch in batches:
            kinds = [batch.schema.field("id").type, batch.schema.field("track_id").type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), *[pa.string()] * len(PLACES)]
            found = []
            for row in zip(*(batch[c].to_pylist() for c in names), strict=True):
                far = 0.0
                if first is not None and row[0] == first[0]:
                    far = _metres(row[3], row[4], y / n, x / n)
                if first is None or row[0] != first[0] or far > radius_m:
                    found += closed()
                    first, n, y, x, reach, far = row, 0, 0.0, 0.0, 0.0, 0.0
                end, n, y, x, reach = row[2], n + 1, y + row[3], x + row[4], max(reach, far)
            yield table(found)
        if kinds is not None:
            yield table(closed())

    walked = rows.repartition("track_id").sortWithinPartitions("track_id", "data_time", "id").mapInArrow(walk, shape)
    return walked.withColumn("duration_s", F.col("end_time") - F.col("start_time")).withColumn("stay_type", F.lit("SPATIAL")).withColumn("stay_kind", stay_kind()).withColumn("confidence", F.least(F.lit(1.0), F.col("point_count") / 10))


def stay_kind(start: str = "start_time", duration: str = "duration_s") -> Column:
    hour = F.hour(F.timestamp_seconds(start))
    night, long = (hour >= 22) | (hour < 6), (hour >= 9) & (hour < 18) & (F.col(duration) > 14_400)
    return F.when(night, "HOME").when(long, "WORK").when(F.col(duration) < 3600, "TRANSIT").otherwise("VISIT")


def point_styles(moded: DataFrame, outlier: Column | None = None, synthetic: Column | None = None) -> DataFrame:
    """Points of rule_modes with render_color, render_width, render_opacity and lod_level (1 for the coarsest map)."""
    v = F.coalesce("speed", F.lit(0.0)) * 3.6
    by_speed = F.when(v < 1, COLOURS["STAY"]).when(v < 10, COLOURS["WALK"]).when(v < 80, COLOURS["CAR"]).when(v < 200, COLOURS["TRAIN"]).otherwise(COLOURS["FLIGHT"])
    bad, made = (F.coalesce(c, F.lit(False)) if c is not None else F.lit(False) for c in (outlier, synthetic))
    blur = F.when(F.col("accuracy") > 100, 0.5).when(F.col("accuracy") > 50, 0.7).otherwise(1.0)
    sure = F.coalesce("mode_confidence", F.lit(0.5))
    opacity = F.when(bad, 0.3).otherwise(1.0) * blur * F.when((sure > 0) & (sure < 0.5), 0.6).otherwise(1.0)
    lod = F.when(made, 5).when(v > 80, 1).when(v > 10, 2).when(v > 1, 3).otherwise(4)
    return moded.withColumns({
        "render_color": F.coalesce(_looked_up(COLOURS, F.col("mode")), by_speed), "render_width": F.coalesce(_looked_up(WIDTHS, F.col("mode")), F.lit(1)),
        "render_opacity": F.greatest(F.lit(0.1), F.least(F.lit(1.0), opacity)), "lod_level": lod,
    })


def _nearest(name: str, parts: int) -> Column:
    """The whole number of parts of one that is nearest, halves away from zero, by the double that a multiplication gives.
    (round goes by the shortest decimal of a double, which may be a half where the product is not, or the other way round.)"""
    v = F.abs(F.col(name) * parts)
    down = F.floor(v)
    return F.signum(name).cast("long") * (down + F.when(v - down >= 0.5, 1).otherwise(0))


def labelled_stays(stays: DataFrame, as_of: int, min_confidence: float = 0.5) -> DataFrame:
    """Stays above min_confidence with frequency (stays at one place to four digits), purpose, label and importance (0 to 100).

    as_of: the unix time from which recency counts.
    """
    sure = stays.where(F.col("confidence") > min_confidence)
    area = F.coalesce(*(F.when(F.length(p) > 0, F.col(p)) for p in ("county", "city", "province")))
    sure = sure.withColumns({"_area": area, "_y": _nearest("center_lat", 10_000), "_x": _nearest("center_lon", 10_000)})
    counts = sure.groupBy("_area", "_y", "_x").agg(F.count("*").alias("frequency"))
    same = F.col("s._area").eqNullSafe(F.col("c._area")) & F.col("s._y").eqNullSafe(F.col("c._y")) & F.col("s._x").eqNullSafe(F.col("c._x"))
    df = sure.alias("s").join(counts.alias("c"), same).select("s.*", "c.frequency")
    start = F.timestamp_seconds("start_time")
    hour, weekday, took = F.hour(start), ~F.dayofweek(start).isin(1, 7), F.col("duration_s")
    day_part = F.when((hour >= 22) | (hour < 6), "NIGHT").when(hour < 12, "MORNING").when(hour < 18, "AFTERNOON").otherwise("EVENING")
    meal = F.lit(None).cast("string")
    for name, (begins, ends) in MEALS.items():
        meal = F.when((hour >= begins) & (hour < ends), name).otherwise(meal)
    df = df.withColumns({"time_of_day": day_part, "is_weekday": weekday, "meal_time": meal})
    evening, meal, often = F.col("time_of_day"), F.col("meal_time"), F.col("frequency")
    place = F.coalesce("_area", F.lit("Unknown"))

    def purpose(name: str | Column, confidence: float, label: str | Column) -> dict[str, Column]:
        text = F.concat(F.lit(label) if isinstance(label, str) else label, place)
        return {"purpose": F.lit(name) if isinstance(name, str) else name, "sure": F.lit(confidence), "label": text}

    rules = [
        ((evening == "NIGHT") & (took > 14_400) & (often > 10), purpose("HOME", 0.9, "Home in ")),
        (F.col("is_weekday") & evening.isin("MORNING", "AFTERNOON") & (took > 7200) & (often > 5), purpose("WORK", 0.8, "Work in ")),
        (meal.isNotNull() & (took < 7200), purpose(F.concat(F.lit("MEAL_"), meal), 0.7, F.concat(F.initcap(meal), F.lit(" in ")))),
        (took < 3600, purpose("TRANSIT", 0.6, "Transit in ")),
        ((~F.col("is_weekday") | (evening == "EVENING")) & (took > 3600) & (took < 14_400), purpose("VISIT", 0.5, "Visit to ")),
    ]
    df = df.withColumn("_p", _chosen(rules, purpose("UNKNOWN", 0.3, "Stay in ")))
    level = F.coalesce(_looked_up(IMPORTANCE, F.upper("admin_level")), F.lit(5)) if "admin_level" in stays.columns else F.lit(IMPORTANCE["COUNTY"])
    recent = F.greatest(F.lit(0.0), 1 - (F.lit(as_of) - F.col("end_time")) / 86_400 / 365)
    score = F.least(often / 20, F.lit(1.0)) * 40 + F.least(took / 86_400, F.lit(1.0)) * 30 + recent * 20 + level
    kept = {"purpose": F.col("_p.purpose"), "purpose_confidence": F.col("_p.sure"), "label": F.col("_p.label"), "importance": F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))).cast("int")}
    return df.withColumns(kept).drop("_p", "_area", "_y", "_x")


def stays_by_spanned_days(stays: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Stays by place or activity_type (UNKNOWN without such a column) and year, month, day and all time of their start.

    visit_days counts every day that a stay touches. Groups are counted by day first.
    """
    sure = stays.where(F.col("confidence") > min_confidence)
    kind = F.coalesce("activity_type", F.lit("UNKNOWN")) if "activity_type" in stays.columns else F.lit("UNKNOWN")
    first, last = F.to_date(F.timestamp_seconds("start_time")), F.to_date(F.timestamp_seconds("end_time"))
    days = sure.withColumn("activity_type", kind).withColumn("_day", F.explode(F.sequence(first, last)))
    days = days.withColumn("_first", F.col("_day") == first)
    wide = fan_out(days, _areas(*PLACES, "activity_type"), _buckets("start_time", "all", "year", "month", "day"))
    group = ["area_type", "area_key", "bucket_type", "bucket_key"]
    by_day = wide.groupBy(*group, "_day").agg(
        F.count_if("_first").alias("n"), F.sum(F.when(F.col("_first"), F.col("duration_s")).otherwise(0)).alias("s"), F.max("duration_s").alias("m"), F.min("start_time").alias("a"), F.max("end_time").alias("b")
    )
    return by_day.groupBy(*group).agg(
        F.sum("n").alias("stay_count"), F.sum("s").alias("total_duration_s"), F.max("m").alias("max_duration_s"), F.count("*").alias("visit_days"), F.min("a").alias("first_visit"), F.max("b").alias("last_visit")
    )
