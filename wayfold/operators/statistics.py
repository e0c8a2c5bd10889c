"""Rollups by area and time: footprint, stays, regions, crossings, extremes, trends, movement intensity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators.spatial import _areas, _buckets, _day
from wayfold.plans.windows import fan_out, ordered, previous, range_join

LEVELS = ("province", "city", "county", "town")
GROUP = ["area_type", "area_key", "bucket_type", "bucket_key"]


def footprint(points: DataFrame, zoom: int = 15) -> DataFrame:
    """Points, distance, distinct days and times by province, city, county, town and grid cell, for each year, month, day and all time.

    Points are first counted by their own areas and day; only that far smaller table is copied to its twenty groups.
    """
    own = points.withColumn("grid", geo.tile_id("lat", "lon", zoom)).groupBy(*LEVELS, "grid", _day().alias("day"))
    base = own.agg(F.count("*").alias("n"), F.sum("distance").alias("d"), F.min("data_time").alias("s"), F.max("data_time").alias("e"))
    wide = fan_out(base, _areas(*LEVELS, "grid"), _buckets("s", "year", "month", "day", "all"))
    return wide.groupBy(*GROUP).agg(
        F.sum("n").alias("point_count"), F.count_distinct("day").alias("visit_days"), F.min("s").alias("first_visit"), F.max("e").alias("last_visit"), F.sum("d").alias("total_distance"), (F.max("e") - F.min("s")).alias("duration_s")
    )


def footprint_by_ids(points: DataFrame, segments: DataFrame, width: int = 4096) -> DataFrame:
    """By city: fixes and the durations of the segments whose range of ids (first to last fix) holds the fix's id."""
    spans = segments.select("track_id", "segment_id", "end_id", "duration_s").where("end_id >= segment_id")
    met = range_join(points.select("track_id", "id", "city"), spans, "id", "segment_id", "end_id", ["track_id"], width)
    return met.groupBy("city").agg(F.sum("duration_s").alias("duration_s"), F.count("*").alias("n"))


def stay_statistics(stays: DataFrame) -> DataFrame:
    wide = fan_out(stays.withColumn("activity_type", F.col("stay_type")).withColumn("day", _day("start_time")), _areas(*LEVELS, "activity_type"), _buckets("start_time", "year", "month", "day", "all"))
    return wide.groupBy(*GROUP).agg(
        F.count("*").alias("stay_count"), F.sum("duration_s").alias("total_duration"), F.avg("duration_s").alias("avg_duration"), F.max("duration_s").alias("max_duration"), F.count_distinct("day").alias("visit_days")
    )


def admin_view(points: DataFrame) -> DataFrame:
    """Regions with their parents. A region's key holds its parent, so that namesakes stay apart."""
    own = points.groupBy(*LEVELS, _day().alias("day")).agg(F.count("*").alias("n"), F.sum("distance").alias("d"), F.min("data_time").alias("s"), F.max("data_time").alias("e"))
    parents = ("", *LEVELS[:-1])
    listed = F.array(*(F.struct(F.lit(c.upper()).alias("level"), F.col(c).alias("name"), (F.col(p) if p else F.lit("")).alias("parent")) for c, p in zip(LEVELS, parents, strict=True)))
    wide = own.select("day", "n", "d", "s", "e", F.explode(listed).alias("a")).select("*", "a.*").where("name is not null and name != ''")
    return wide.groupBy("level", "name", F.coalesce("parent", F.lit("")).alias("parent")).agg(
        F.sum("n").alias("visit_count"), F.sum("d").alias("total_distance"), F.count_distinct("day").alias("unique_days"), F.min("s").alias("first_visit"), F.max("e").alias("last_visit"), (F.sum("n") * 10).alias("duration_s")
    )


def admin_crossings(points: DataFrame, chunk_s: int | None = None) -> DataFrame:
    """Steps from one region into another, named by the highest level that changes."""
    known = points.where("province is not null")
    names = [F.coalesce(c, F.lit("")).alias(c) for c in LEVELS]
    df = previous(known.select("track_id", "id", "data_time", "lat", "lon", *names), ["lat", "lon", *LEVELS], "_b", chunk_s)
    kind, above = F.when(F.lit(False), ""), F.col("_b").isNotNull()
    for level in LEVELS:
        kind = kind.when(above & (F.col(level) != F.col(f"_b.{level}")) & (F.col(level) != ""), level.upper())
        above = above & (F.col(level) == F.col(f"_b.{level}"))
    df = df.withColumn("crossing_type", kind).where("crossing_type is not null")
    sides = [F.col(f"_b.{c}").alias(f"from_{c}") for c in LEVELS] + [F.col(c).alias(f"to_{c}") for c in LEVELS]
    return df.select("track_id", F.col("id").alias("crossing_id"), F.col("data_time").alias("crossing_time"), "crossing_type", *sides, geo.haversine("_b.lat", "_b.lon", "lat", "lon").alias("distance_m"))


def extreme_events(points: DataFrame, trip: DataFrame) -> DataFrame:
    """Per trip, the first fix at or beyond the 99th (or 1st) percentile of altitude, longitude and latitude."""
    spans = trip.select("track_id", "trip_id", "start_time", "end_time")
    inside = range_join(points.select("track_id", "id", "data_time", "lat", "lon", "altitude"), spans, "data_time", "start_time", "end_time", ["track_id"], 86_400)
    alt = F.when(F.col("altitude") != 0, F.col("altitude"))
    limits = inside.groupBy("trip_id").agg(F.percentile(alt, 0.99).alias("hi_a"), F.percentile("lon", F.array(F.lit(0.99), F.lit(0.01))).alias("x"), F.percentile("lat", F.array(F.lit(0.99), F.lit(0.01))).alias("y"))
    both = inside.join(limits, "trip_id")
    rules = [
        ("MAX_ALTITUDE", "ALTITUDE", alt, alt >= F.col("hi_a")),
        ("EASTMOST", "SPATIAL", F.col("lon"), F.col("lon") >= F.col("x")[0]),
        ("WESTMOST", "SPATIAL", F.col("lon"), F.col("lon") <= F.col("x")[1]),
        ("NORTHMOST", "SPATIAL", F.col("lat"), F.col("lat") >= F.col("y")[0]),
        ("SOUTHMOST", "SPATIAL", F.col("lat"), F.col("lat") <= F.col("y")[1]),
    ]
    listed = F.array_compact(F.array(*(F.when(rule, F.struct(F.lit(n).alias("event_type"), F.lit(c).alias("event_category"), v.alias("value"))) for n, c, v, rule in rules)))
    events = both.select("trip_id", "id", "data_time", "lat", "lon", F.explode(listed).alias("v")).select("*", "v.*")
    first = F.min_by(F.struct("id", "data_time", "lat", "lon", "value"), F.struct("data_time", "id")).alias("f")
    found = events.groupBy("trip_id", "event_type", "event_category").agg(first).select("trip_id", "event_type", "event_category", "f.*")
    return found.withColumn("rank", F.lit(None).cast("int"))  # for callers that rank events; read queries put ranked ones first


def admin_trends(points: DataFrame, level: str = "city") -> DataFrame:
    """Monthly counts of a region: trend, seasonality, months that stand out and the next month's expectation."""
    month = F.date_format(F.timestamp_seconds("data_time"), "yyyy-MM")
    monthly = points.where(F.length(level) > 0).groupBy(F.col(level).alias("region"), month.alias("month")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("region").orderBy("month")
    placed = monthly.withColumn("x", F.row_number().over(w) - 1).withColumn("back", F.row_number().over(w.orderBy(F.desc("month"))))
    out = placed.groupBy("region").agg(
        F.count("*").alias("months"), F.sum("n").alias("total"), F.max("n").alias("top"), F.coalesce(F.try_divide(F.covar_pop("x", "n"), F.var_pop("x")), F.lit(0.0)).alias("slope"), F.avg("n").alias("mean"), F.var_pop("n").alias("var"),
        F.avg(F.when(F.col("back") <= 3, F.col("n"))).alias("recent"), F.array_sort(F.collect_list(F.struct("month", "n"))).alias("all"),
    )
    enough = F.col("months") >= 3
    kind = F.when(~enough | (F.abs("slope") < 0.1), "STABLE").when(F.col("slope") > 0, "GROWTH").otherwise("DECLINE")
    score = F.when(enough, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("slope") / F.col("top")))).otherwise(0.0)
    odd = F.filter("all", lambda m: F.coalesce(F.abs(F.try_divide(m["n"] - F.col("mean"), F.sqrt("var"))) > 2.5, F.lit(False)))
    out = out.withColumn("trend_type", kind).withColumn("trend_score", score)
    expect = F.when(F.col("months") >= 2, F.greatest(F.floor(F.col("recent") * (1 + F.col("trend_score"))), F.lit(0))).otherwise(0)
    return out.select(
        "region", "months", "total", "trend_type", "trend_score", ((F.col("months") >= 12) & (F.try_divide("var", "mean") > 0.5)).alias("seasonality_detected"),
        F.when(enough, odd).otherwise(F.array().cast("array<struct<month:string,n:bigint>>")).alias("anomalies"), expect.cast("long").alias("prediction"),
    )


def movement_by_area(segments: DataFrame, burst_kmh: float = 50.0, active_kmh: float = 5.0) -> DataFrame:
    """movement_intensity's figures by area of the segments' start and by time bucket."""
    moving = segments.where("duration_s > 0 and distance_m > 0")
    fast = F.col("avg_speed_kmh") > burst_kmh
    moving = moving.withColumn("_rise", fast & ~F.coalesce(F.lag(fast).over(ordered(order=["start_time", "segment_id"])), F.lit(False)))
    wide = fan_out(moving, {"ALL": F.lit("ALL"), **_areas("province", "city")}, _buckets("start_time", "all", "year", "month"))
    out = wide.groupBy(*GROUP).agg(
        F.count("*").alias("trip_count"), F.sum("distance_m").alias("total_distance"), F.sum("duration_s").alias("total_duration"), F.sum(F.when(F.col("avg_speed_kmh") > active_kmh, F.col("duration_s")).otherwise(0)).alias("active_time"),
        F.count_if("_rise").alias("burst_count"), F.sum(F.when(fast, F.col("duration_s")).otherwise(0)).alias("burst_duration"), F.count_distinct(F.floor(F.col("start_time") / 86400)).alias("distinct_days"),
    )
    out = out.withColumn("movement_intensity", F.col("total_distance") / 1000 / (F.col("total_duration") / 3600)).withColumn("activity_ratio", F.col("active_time") / F.col("total_duration"))
    index = F.col("movement_intensity") * F.col("activity_ratio") * F.log1p(F.col("distinct_days").cast("double"))
    return out.withColumn("burst_intensity", F.when(F.col("burst_duration") > 0, burst_kmh * 1.5).otherwise(0.0)).withColumn("time_compression_index", index)


def movement_intensity(segments: DataFrame, active_kmh: float = 5.0, burst_kmh: float = 50.0) -> DataFrame:
    """One row over all segments with a time and a distance: how dense movement is, and bursts of fast segments."""
    moving = segments.where("duration_s > 0 and distance_m > 0")
    w = ordered(order=["start_time", "segment_id"])
    fast = F.col("avg_speed_kmh") > burst_kmh
    moving = moving.withColumn("_rise", fast & ~F.coalesce(F.lag(fast).over(w), F.lit(False)))
    days = F.count_distinct(F.floor(F.col("start_time") / 86400))
    out = moving.agg(
        F.count("*").alias("trip_count"), F.coalesce(F.sum("distance_m"), F.lit(0.0)).alias("d"), F.coalesce(F.sum("duration_s"), F.lit(0)).alias("s"), F.coalesce(F.sum(F.when(F.col("avg_speed_kmh") > active_kmh, F.col("duration_s"))), F.lit(0)).alias("active"),
        F.coalesce(F.max("max_speed_kmh"), F.lit(0.0)).alias("max_speed_kmh"), F.count_if(F.col("_rise")).alias("burst_count"), F.coalesce(F.sum(F.when(fast, F.col("duration_s"))), F.lit(0)).alias("burst_duration"), days.alias("distinct_days"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    km, hours = F.col("d") / 1000, F.col("s") / 3600
    out = out.withColumn("movement_intensity", ratio(km, hours)).withColumn("activity_ratio", ratio(F.col("active").cast("double"), F.col("s").cast("double")))
    return out.select(
        "movement_intensity", F.when(F.col("burst_duration") > 0, burst_kmh * 1.5).otherwise(0.0).alias("burst_intensity"), "burst_count", "burst_duration", F.col("active").alias("active_time"), (F.col("s") - F.col("active")).alias("inactive_time"),
        "activity_ratio", ratio(km, F.col("active") / 3600).alias("avg_speed_kmh"), "max_speed_kmh", ratio(km, F.col("distinct_days").cast("double")).alias("distance_per_day"),
        (F.col("movement_intensity") * F.col("activity_ratio") * F.log1p(F.col("distinct_days").cast("double"))).alias("time_compression_index"), F.col("d").alias("total_distance"), F.col("s").alias("total_duration"), "trip_count", "distinct_days",
    )
