"""What a track does: transport segments, stays, trips, streaks, fast stretches.

Runs are found with one window each (gaps and islands); nothing loops over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.plans.storage import stored
from wayfold.plans.windows import ORDER, asof, islands, ordered, previous, range_join, running

PLACES = ["province", "city", "county", "town"]
#: Metres a second below which a fix belongs to a mode.
MODE_LIMITS = (("WALK", 2.0), ("BIKE", 8.0), ("CAR", 40.0), ("TRAIN", 60.0))


def transport_mode(speed: str = "speed") -> Column:
    out = F.when(F.col(speed) < MODE_LIMITS[0][1], MODE_LIMITS[0][0])
    for mode, limit in MODE_LIMITS[1:]:
        out = out.when(F.col(speed) < limit, mode)
    return out.otherwise("PLANE")


def with_runs(points: DataFrame, chunk_s: int | None = None) -> DataFrame:
    """Points with mode, run (number of the maximal run of one mode in its track) and hop (metres from the fix before in the run)."""
    df = points.withColumn("speed", F.coalesce("speed", F.lit(0.0))).withColumn("mode", transport_mode())
    df = previous(df, ["mode", "lat", "lon"], "_b", chunk_s)
    df = islands(df, F.col("mode") != F.col("_b.mode"), name="run", chunk_s=chunk_s)
    same = F.col("mode") == F.col("_b.mode")
    return df.withColumn("hop", F.when(same, geo.haversine("_b.lat", "_b.lon", "lat", "lon")).otherwise(0.0)).drop("_b")


def transport_segments(points: DataFrame, min_s: int = 10, chunk_s: int | None = None) -> DataFrame:
    """Maximal runs of one mode of at least min_s seconds. segment_id is the id of the first fix; places are its places."""
    order = F.struct("data_time", "id")
    first, last = F.min_by(F.struct("id", "lat", "lon", *PLACES), order), F.max_by(F.struct("id", "lat", "lon"), order)
    runs = with_runs(points, chunk_s).groupBy("track_id", "run", "mode").agg(
        F.min("data_time").alias("start_time"),
        F.max("data_time").alias("end_time"),
        F.count("*").alias("point_count"),
        F.sum("hop").alias("distance_m"),
        (F.avg("speed") * 3.6).alias("avg_speed_kmh"),
        (F.max("speed") * 3.6).alias("max_speed_kmh"),
        first.alias("_f"),
        last.alias("_l"),
    )
    runs = runs.withColumn("duration_s", F.col("end_time") - F.col("start_time")).where(F.col("duration_s") >= min_s)
    return runs.select(
        F.col("_f.id").alias("segment_id"), "track_id", "run", "mode", "start_time", "end_time", "duration_s", "point_count", "distance_m", "avg_speed_kmh", "max_speed_kmh",
        F.lit(0.8).alias("confidence"), F.col("_l.id").alias("end_id"), F.col("_f.lat").alias("start_lat"), F.col("_f.lon").alias("start_lon"),
        F.col("_l.lat").alias("end_lat"), F.col("_l.lon").alias("end_lon"), *(F.col(f"_f.{p}").alias(p) for p in PLACES),
    )


def _stay(df: DataFrame, group: list[str], kind: Column, min_s: int) -> DataFrame:
    """One row per group of points: the stay's time, middle, radius and places of its first fix."""
    order = F.struct("data_time", "id")
    if "center_lat" not in df.columns:
        df = df.join(df.groupBy(*group).agg(F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon")), group)
    spread = df.groupBy(*group).agg(
        F.min("data_time").alias("start_time"), F.max("data_time").alias("end_time"), F.count("*").alias("point_count"), F.first("center_lat").alias("center_lat"), F.first("center_lon").alias("center_lon"),
        F.max(geo.haversine("lat", "lon", "center_lat", "center_lon")).alias("radius_m"), F.min_by(F.struct("id", *PLACES), order).alias("_f"),
    )
    stays = spread.withColumn("duration_s", F.col("end_time") - F.col("start_time")).where((F.col("duration_s") >= min_s) & (F.col("point_count") >= 2))
    return stays.select(
        F.col("_f.id").alias("stay_id"), "track_id", kind.alias("stay_type"), "start_time", "end_time", "duration_s", "center_lat", "center_lon", "radius_m", "point_count",
        F.least(F.lit(1.0), F.col("point_count") / 10).alias("confidence"), *(F.col(f"_f.{p}").alias(p) for p in PLACES), geo.geohash(F.round("center_lat", 7), F.round("center_lon", 7), 6).alias("geohash6"),
    )


def admin_stays(points: DataFrame, level: str = "town", min_s: int = 7200, chunk_s: int | None = None) -> DataFrame:
    """Maximal runs of fixes in one region of the given level, at least min_s long and of two fixes or more."""
    named = previous(points.where(F.length(level) > 0), [level], "_b", chunk_s)
    runs = islands(named, F.col(level) != F.col(f"_b.{level}"), name="run", chunk_s=chunk_s).drop("_b")
    return _stay(runs, ["track_id", "run"], F.lit(f"ADMIN_{level.upper()}"), min_s)


def density_stays(points: DataFrame, eps_m: float = 200.0, min_samples: int = 3, max_gap: int = 3600, min_s: int = 1800) -> DataFrame:
    """Stays from density clusters of each track, cut at every time gap above max_gap."""
    from wayfold.operators.density import density_clusters

    placed = density_clusters(points.select("id", "track_id", "data_time", "lat", "lon", *PLACES), eps_m, min_samples).where("cluster is not null")
    order = Window.partitionBy("track_id", "cluster").orderBy(*ORDER)
    cut = placed.withColumn("_new", F.when(F.col("data_time") - F.lag("data_time").over(order) <= max_gap, 0).otherwise(1))
    cut = cut.withColumn("part", F.sum("_new").over(order)).drop("_new")
    # the middles by a window in the same partitioning: all that comes before is done once, and no fix is dealt again
    whole = Window.partitionBy("track_id", "cluster", "part")
    cut = cut.withColumns({"center_lat": F.avg("lat").over(whole), "center_lon": F.avg("lon").over(whole)})
    return _stay(cut, ["track_id", "cluster", "part"], F.lit("SPATIAL"), min_s)


def trips(segments: DataFrame, stays: DataFrame | None = None, gap: int = 7200, near_s: int = 3600, min_stay_s: int = 1800) -> DataFrame:
    """Segments joined across pauses of up to gap seconds. trip_id is the first segment's id.

    With stays: origin and destination, the last stay (by its start) that ended less than near_s before the trip, and
    the last that began less than near_s after it.
    """
    order = ["start_time", "segment_id"]
    w = ordered(order=order)
    runs = islands(segments, F.col("start_time") - F.lag("end_time").over(w) > gap, order=order, name="trip")
    first = F.struct("start_time", "segment_id")
    by_mode = runs.groupBy("track_id", "trip", "mode").agg(
        F.min("start_time").alias("s"), F.max("end_time").alias("e"), F.sum("distance_m").alias("d"), F.count("*").alias("n"), F.collect_list(first).alias("ids"),
        F.min_by(F.struct("segment_id", "start_lat", "start_lon", "city"), first).alias("f"), F.max_by(F.struct("end_lat", "end_lon", "city"), first).alias("l"), F.min(first).alias("o"), F.max(first).alias("p"),
    )
    whole = by_mode.groupBy("track_id", "trip").agg(
        F.min_by("f", "o").alias("_f"), F.max_by("l", "p").alias("_l"), F.min("s").alias("start_time"), F.max("e").alias("end_time"), F.sum("d").alias("distance_m"), F.sum("n").alias("segment_count"),
        F.array_sort(F.collect_list("mode")).alias("modes"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("_ids"), F.max(F.struct("d", "mode")).alias("_m"),
    )
    day = F.to_date(F.timestamp_seconds("start_time"))
    out = whole.select(
        F.col("_f.segment_id").alias("trip_id"), "track_id", day.alias("date"), "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration_s"), "distance_m", "segment_count", "modes",
        F.transform("_ids", lambda x: x["segment_id"]).alias("segment_ids"), F.col("_m.mode").alias("primary_mode"), F.col("_f.city").alias("origin_city"), F.col("_l.city").alias("dest_city"),
        F.col("_f.start_lat").alias("origin_lat"), F.col("_f.start_lon").alias("origin_lon"), F.col("_l.end_lat").alias("dest_lat"), F.col("_l.end_lon").alias("dest_lon"),
    )
    numbered = out.withColumn("trip_number", F.row_number().over(Window.partitionBy("track_id", "date").orderBy("start_time", "trip_id")))
    if stays is None:
        return numbered
    long = stays.where(F.col("duration_s") >= min_stay_s).select("track_id", "stay_id", "start_time", "end_time")
    ended = long.select("track_id", F.col("stay_id"), F.col("start_time").alias("_s"), F.col("end_time").alias("_t"), (F.col("end_time") + near_s - 1).alias("_u"))
    begun = long.select("track_id", F.col("stay_id"), F.col("start_time").alias("_s"), (F.col("start_time") - near_s + 1).alias("_t"), F.col("start_time").alias("_u"))
    for side, time, name in ((ended, "start_time", "origin_stay_id"), (begun, "end_time", "dest_stay_id")):
        met = range_join(numbered.select("track_id", "trip_id", F.col(time).alias("_at")), side, "_at", "_t", "_u", ["track_id"], near_s)
        numbered = numbered.join(met.groupBy("trip_id").agg(F.max_by("stay_id", F.struct("_s", "stay_id")).alias(name)), "trip_id", "left")
    return numbered


def stay_trips(stays: DataFrame, segments: DataFrame, round_s: int = 1800) -> DataFrame:
    """The older rule: one trip between two consecutive stays of a track, made of the segments that lie wholly between them.

    trip_type: ROUND_TRIP if both stays are in one cell, COMMUTE if the way is short and between 6 and 10 or 16 and 20 h,
    otherwise ONE_WAY. A segment lies in at most one gap, that of the last stay that ended before it began.
    """
    w = Window.partitionBy("track_id").orderBy("start_time", "stay_id")
    after = F.lead(F.struct("stay_id", "start_time", "geohash6")).over(w)
    gaps = stays.withColumn("_next", after).where("_next is not null").select(
        "track_id", F.col("stay_id").alias("origin_stay_id"), F.col("_next.stay_id").alias("dest_stay_id"), F.col("end_time").alias("_from"), F.col("_next.start_time").alias("_to"), (F.col("geohash6") == F.col("_next.geohash6")).alias("_same")
    )
    own = segments.select("track_id", "segment_id", F.col("start_time").alias("_s"), F.col("end_time").alias("_e"), "duration_s", "distance_m")
    placed = asof(own, gaps, "_s", "_from", ["track_id"], ["origin_stay_id", "dest_stay_id", "_from", "_to", "_same"], "gap").where(F.col("_e") <= F.col("gap._to"))
    out = placed.groupBy("gap.origin_stay_id", "gap.dest_stay_id", "gap._same").agg(F.count("*").alias("segments"), F.sum("duration_s").alias("moving_s"), F.sum("distance_m").alias("distance_m"), F.min("_s").alias("start_time"), F.max("_e").alias("end_time"))
    hour = F.hour(F.timestamp_seconds("start_time"))
    short = (F.col("end_time") - F.col("start_time") <= 4 * round_s) & (hour.between(6, 10) | hour.between(16, 20))
    return out.withColumn("trip_type", F.when(F.col("_same"), "ROUND_TRIP").when(short, "COMMUTE").otherwise("ONE_WAY")).drop("_same")


def streaks(points: DataFrame, min_m: float = 1000.0, min_days: int = 2) -> DataFrame:
    """Runs of consecutive days on each of which a track covered min_m metres."""
    day = F.to_date(F.timestamp_seconds("data_time"))
    daily = points.groupBy("track_id", day.alias("day")).agg(F.sum("distance").alias("m"), F.count("*").alias("n"), (F.max("data_time") - F.min("data_time")).alias("s")).where(F.col("m") >= min_m)
    numbered = daily.withColumn("_k", F.row_number().over(Window.partitionBy("track_id").orderBy("day")))
    runs = numbered.groupBy("track_id", F.date_sub("day", F.col("_k")).alias("_anchor")).agg(
        F.min("day").alias("start_date"), F.max("day").alias("end_date"), F.count("*").alias("days"), F.sum("m").alias("distance_m"), F.sum("s").alias("duration_s"), F.sum("n").alias("point_count")
    )
    return runs.where(F.col("days") >= min_days).drop("_anchor")


def segment_streaks(segments: DataFrame, fast_kmh: float = 100.0, fast_s: int = 1800, walk_m: float = 2000.0) -> DataFrame:
    """Single segments that stand out: long fast rides and long walks."""
    kind = F.when((F.col("avg_speed_kmh") >= fast_kmh) & (F.col("duration_s") >= fast_s), "HIGH_SPEED_STREAK")
    kind = kind.when((F.col("mode") == "WALK") & (F.col("distance_m") >= walk_m), "WALKING_STREAK")
    return segments.withColumn("streak_type", kind).where("streak_type is not null")


def fastest_segments(segments: DataFrame, limits: dict[str, float], most: int = 10) -> DataFrame:
    """The fastest segments of each mode among those at or above the mode's limit (km/h), with place; modes without a limit
    are left out. The window keeps `most` rows a mode and task before it shuffles."""
    least = F.coalesce(*(F.when(F.col("mode") == m, F.lit(v)) for m, v in limits.items()))
    w = Window.partitionBy("mode").orderBy(F.desc("max_speed_kmh"), "segment_id")
    return segments.where(F.col("max_speed_kmh") >= least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def speed_events(points: DataFrame, min_speed: float = 33.33, min_s: int = 60, gap: int = 10, mode: str = "CAR", min_run_s: int = 10, chunk_s: int | None = None) -> DataFrame:
    """Fast stretches inside segments of one mode. Low fixes end a stretch once one lies more than gap seconds after its
    last fast fix. The run number stays on the points, so segments need no range join."""
    run = ["track_id", "run"]
    df = with_runs(points, chunk_s).where(F.col("mode") == mode)
    if chunk_s is None:
        whole = Window.partitionBy(*run)
        df = df.withColumn("_s", F.max("data_time").over(whole) - F.min("data_time").over(whole))
    else:  # a run may be long: its span by aggregation
        df = stored(df, "runs")
        spans = df.groupBy(*run).agg((F.max("data_time") - F.min("data_time")).alias("_s"))
        df = df.alias("x").join(spans.alias("y"), F.col("x.track_id").eqNullSafe(F.col("y.track_id")) & (F.col("x.run") == F.col("y.run"))).select("x.*", "y._s")
    fast = F.col("speed") >= min_speed
    time = F.col("data_time")
    df = running(df.where(F.col("_s") >= min_run_s), chunk_s, run, firsts={"_segment": F.col("id")}, lasts={"_low": F.when(~fast, time)}, befores={"_high": F.when(fast, time)}).where(fast)
    fresh = F.col("_high").isNull() | ((F.col("_low") > F.col("_high")) & (F.col("_low") - F.col("_high") > gap))
    df = islands(df, F.coalesce(fresh, F.lit(False)), run, name="event", chunk_s=chunk_s)
    events = df.groupBy("track_id", "run", "event").agg(
        F.min("_segment").alias("segment_id"), F.min("data_time").alias("start_time"), F.max("data_time").alias("end_time"), F.count("*").alias("point_count"), F.avg("speed").alias("avg_speed"),
        F.max("speed").alias("max_speed"), F.min_by(F.struct("data_time", "lat", "lon"), F.struct(-F.col("speed"), F.col("data_time"), F.col("id"))).alias("_p"),
    )
    events = events.withColumn("duration_s", F.col("end_time") - F.col("start_time")).where(F.col("duration_s") >= min_s)
    s, n, top = F.col("duration_s"), F.col("point_count"), F.col("max_speed")
    confidence = F.when(s < 120, 0.8).otherwise(1.0) * F.when(n < 5, 0.7).otherwise(1.0) * F.when(top < 40, 0.9).otherwise(1.0)
    reasons = F.array(
        F.when(top >= 50, "VERY_HIGH_SPEED").when(top >= 40, "HIGH_SPEED").otherwise("MODERATE_SPEED"),
        F.when(s >= 300, "LONG_DURATION").when(s >= 120, "MEDIUM_DURATION").otherwise("SHORT_DURATION"),
        F.when(n >= 10, "MANY_POINTS").when(n >= 5, "MODERATE_POINTS").otherwise("FEW_POINTS"),
    )
    return events.select(
        "track_id", "segment_id", "start_time", "end_time", "duration_s", "point_count", "avg_speed", "max_speed",
        F.col("_p.data_time").alias("peak_time"), F.col("_p.lat").alias("peak_lat"), F.col("_p.lon").alias("peak_lon"), confidence.alias("confidence"), reasons.alias("reasons"),
    )


def trip_purpose(trip: DataFrame) -> DataFrame:
    """Adds purpose and purpose_confidence by ordered rules on hour, weekday, distance, duration and cities."""
    start = F.timestamp_seconds("start_time")
    hour, weekend = F.hour(start), F.dayofweek(start).isin(1, 7)
    km, h = F.col("distance_m") / 1000, F.col("duration_s") / 3600
    same = F.col("origin_city").eqNullSafe(F.col("dest_city"))
    rules = [
        ("COMMUTE", 0.8, ~weekend & same & (km < 20) & (hour.between(7, 9) | hour.between(17, 19))),
        ("WORK", 0.7, ~weekend & hour.between(9, 17) & (h > 2)),
        ("LEISURE", 0.7, (weekend | (hour >= 19) | (hour <= 7)) & (km < 50)),
        ("SHOPPING", 0.6, same & (km < 10) & (h < 2) & hour.between(10, 20)),
        ("TRAVEL", 0.8, (km > 100) | ~same),
    ]
    name, sure = F.lit("OTHER"), F.lit(0.4)
    for purpose, confidence, rule in reversed(rules):
        name, sure = F.when(rule, purpose).otherwise(name), F.when(rule, confidence).otherwise(sure)
    return trip.withColumn("purpose", name).withColumn("purpose_confidence", sure)
