"""Where a track goes: grid cells, density levels, directions, speeds by area, revisits, use of areas, altitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo, stats
from wayfold.plans.ranking import Place, at_places, percentiles
from wayfold.plans.storage import stored
from wayfold.plans.windows import fan_out, islands, previous, running

LEVELS = (8, 10, 12, 15)


def _day(seconds: str = "data_time") -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def _areas(*names: str) -> dict[str, Column]:
    return {n.upper(): F.col(n) for n in names}


def _buckets(seconds: str, *kinds: str) -> dict[str, Column]:
    t = F.timestamp_seconds(seconds)
    shown = {"year": F.date_format(t, "yyyy"), "month": F.date_format(t, "yyyy-MM"), "day": F.date_format(t, "yyyy-MM-dd"), "all": F.lit("")}
    return {k: shown[k] for k in kinds}


def grid_cells(points: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Web-Mercator tiles at several zoom levels: counts, distinct days, times, bounds.

    Points are counted by day and finest tile first; coarser tiles are that table's rows again, not the points'.
    """
    return cells_of_days(tile_days(points, max(levels)), levels)


def tile(zoom: int) -> tuple[Column, Column]:
    return geo.tile_x("lon", zoom), geo.tile_y("lat", zoom)


def tile_days(points: DataFrame, zoom: int) -> DataFrame:
    """Fixes, first and last time by tile (x, y) and day."""
    x, y = tile(zoom)
    return points.groupBy(x.alias("x"), y.alias("y"), _day().alias("day")).agg(F.count("*").alias("n"), F.min("data_time").alias("s"), F.max("data_time").alias("e"))


def cells_of_days(counted: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """grid_cells from the tile_days of the finest level."""
    finest = max(levels)
    wide = counted.withColumn("level", F.explode(F.array(*map(F.lit, sorted(levels)))))
    wide = wide.withColumn("x", F.expr(f"shiftright(x, {finest} - level)")).withColumn("y", F.expr(f"shiftright(y, {finest} - level)"))
    cells = wide.groupBy("level", "x", "y").agg(F.sum("n").alias("point_count"), F.count_distinct("day").alias("days"), F.min("s").alias("first_visit"), F.max("e").alias("last_visit"))
    size = F.pow(F.lit(2.0), F.col("level"))
    west, east = geo.tile_lon("x", size), geo.tile_lon(F.col("x") + 1, size)
    north, south = geo.tile_lat("y", size), geo.tile_lat(F.col("y") + 1, size)
    return cells.select(
        F.concat(F.lit("L"), "level", F.lit("_"), "x", F.lit("_"), "y").alias("grid_id"), "level", "x", "y", "point_count", F.col("point_count").alias("visit_count"), "days", "first_visit", "last_visit",
        (F.col("last_visit") - F.col("first_visit")).alias("duration_s"), south.alias("min_lat"), north.alias("max_lat"), west.alias("min_lon"), east.alias("max_lon"), ((south + north) / 2).alias("center_lat"), ((west + east) / 2).alias("center_lon"),
    )


def geohash_cells(points: DataFrame, precisions: tuple[int, ...] = (4, 5, 6, 7, 8)) -> DataFrame:
    """Geohash cells at levels 1..n; visits are distinct days. A coarser cell is a prefix of the finest."""
    finest = max(precisions)
    base = points.groupBy(geo.geohash("lat", "lon", finest).alias("h"), _day().alias("day")).agg(F.count("*").alias("n"))
    listed = F.array(*(F.struct(F.lit(k).alias("level"), F.substring("h", 1, p).alias("geohash")) for k, p in enumerate(sorted(precisions), 1)))
    wide = base.select("day", "n", F.explode(listed).alias("c")).select("day", "n", "c.*")
    return wide.groupBy("level", "geohash").agg(F.sum("n").alias("point_count"), F.count_distinct("day").alias("visit_count"))


def geohash_modes(points: DataFrame, precision: int = 6) -> DataFrame:
    """Geohash cells with their fixes and the set of modes (a column of the points) seen in them."""
    own = points.groupBy(geo.geohash("lat", "lon", precision).alias("geohash"), "mode").agg(F.count("*").alias("n"))
    return own.groupBy("geohash").agg(F.sum("n").alias("point_count"), F.array_sort(F.collect_set("mode")).alias("modes"))


def _descending(tenths: int) -> Place:
    return lambda n: n - 1 - F.least(n - 1, F.floor(n * tenths / 10))


def density_levels(cells: DataFrame, level: int | None = None) -> DataFrame:
    """Cells with a score from duration, days and count, and a level by the score's order statistics.

    Thresholds are the scores at the places n/10, 3n/10, 7n/10 and 9n/10 of the descending order, found over ranges of
    scores, so cells are never sorted in one task.
    """
    own = cells if level is None else cells.where(F.col("level") == level)
    score = 0.5 * F.log1p(F.col("duration_s") / 3600) + 0.3 * F.log1p(F.col("days").cast("double")) + 0.2 * F.log1p(F.col("visit_count").cast("double"))
    scored = stored(own.withColumn("score", score), "scored")
    # place k of the descending order is place n - 1 - k of the ascending one
    cut = at_places(scored, F.col("score"), [_descending(k) for k in (1, 3, 7, 9)])
    placed = scored.crossJoin(F.broadcast(cut))  # one row
    s, p = F.col("score") + 1e-12, F.col("p")
    name = F.when(s >= p[0], "core").when(s >= p[1], "secondary").when(s >= p[2], "active").when(s >= p[3], "peripheral").otherwise("rare")
    return placed.withColumn("density_level", name).drop("p")


def speed_space(segments: DataFrame, bin_kmh: int = 10, fast: float = 0.9, slow: float = 0.25) -> DataFrame:
    """Distance-weighted speed and its spread and entropy by area and time bucket; fast and slow areas against all segments."""
    moving = stored(segments.where(F.col("distance_m") > 0).select("start_time", "distance_m", "avg_speed_kmh", "province", "city", "county"), "moving")
    wide = fan_out(moving, _areas("province", "city", "county"), _buckets("start_time", "all", "year", "month"))
    keys = ["area_type", "area_key", "bucket_type", "bucket_key"]
    v, d = F.col("avg_speed_kmh"), F.col("distance_m")
    # bins first: the entropy needs them, and all other sums follow from theirs
    binned = wide.groupBy(*keys, F.floor(v / bin_kmh).alias("bin")).agg(F.sum(d).alias("d"), F.sum(v * d).alias("vd"), F.sum(v * v * d).alias("vvd"), F.count("*").alias("n"))
    out = binned.groupBy(*keys).agg(F.sum("d").alias("total_distance"), F.sum("n").alias("segment_count"), (F.sum("vd") / F.sum("d")).alias("avg_speed"), F.sum("vvd").alias("_vvd"), stats.entropy("d").alias("speed_entropy"))
    out = out.withColumn("speed_variance", F.greatest(F.col("_vvd") / F.col("total_distance") - F.col("avg_speed") * F.col("avg_speed"), F.lit(0.0))).drop("_vvd")
    limits = percentiles(moving, F.col("avg_speed_kmh"), [fast, slow])
    both = out.crossJoin(F.broadcast(limits))  # one row
    return both.withColumn("is_high_speed", F.col("avg_speed") > F.col("p")[0]).withColumn("is_slow_life", F.col("avg_speed") < F.col("p")[1]).drop("p")


def directional_bias(segments: DataFrame, bins: int = 8, min_m: float = 10.0) -> DataFrame:
    """Distance by direction, by area, time bucket and mode (and ALL modes), with dominance, concentration, two-way share and entropy."""
    size = 360.0 / bins
    far = segments.where(F.col("distance_m") > min_m)
    turned = geo.bearing("start_lat", "start_lon", "end_lat", "end_lon")
    far = far.withColumn("_bin", (F.floor((turned + size / 2) / size) % bins).cast("int"))
    wide = fan_out(far, _areas("province", "city", "county"), _buckets("start_time", "all", "year", "month"))
    wide = wide.withColumn("_mode", F.explode(F.array("mode", F.lit("ALL"))))
    keys = ["area_type", "area_key", "bucket_type", "bucket_key", "_mode"]
    d = [F.sum(F.when(F.col("_bin") == k, F.col("distance_m")).otherwise(0.0)).alias(f"d{k}") for k in range(bins)]
    n = [F.count_if(F.col("_bin") == k).alias(f"n{k}") for k in range(bins)]
    sums = wide.groupBy(*keys).agg(*d, *n, F.sum("distance_m").alias("total_distance"), F.count("*").alias("segment_count"))
    all_d = [F.col(f"d{k}") for k in range(bins)]
    top = F.greatest(*all_d)
    dominant = F.lit(0)
    for k in reversed(range(bins)):
        dominant = F.when(all_d[k] == top, k).otherwise(dominant)
    total = F.col("total_distance")
    middle = [F.radians(F.lit(k * size + size / 2)) for k in range(bins)]
    x = sum((d / total * F.cos(m) for d, m in zip(all_d, middle, strict=True)), F.lit(0.0))
    y = sum((d / total * F.sin(m) for d, m in zip(all_d, middle, strict=True)), F.lit(0.0))
    half = bins // 2
    both = sum((F.least(all_d[k], all_d[k + half]) / total for k in range(half)), F.lit(0.0))
    shares = [F.when(d > 0, d / total) for d in all_d]
    entropy = sum((F.coalesce(-s * F.log2(s), F.lit(0.0)) for s in shares), F.lit(0.0)) / F.log2(F.lit(float(bins)))
    histogram = F.array(*(F.struct(F.lit(k).alias("bin"), F.col(f"d{k}").alias("distance"), F.col(f"n{k}").alias("count")) for k in range(bins)))
    return sums.select(
        *keys[:4], F.col("_mode").alias("mode"), histogram.alias("histogram"), (dominant * size + size / 2).alias("dominant_direction"), F.sqrt(x * x + y * y).alias("concentration"),
        both.alias("bidirectional_score"), entropy.alias("directional_entropy"), "total_distance", "segment_count",
    )


def revisit_patterns(stays: DataFrame, min_visits: int = 2) -> DataFrame:
    """Cells that were visited several times, the regularity of the intervals in days, and their strength."""
    order = Window.partitionBy("geohash6").orderBy("start_time", "stay_id")
    gaps = stays.withColumn("_days", (F.col("start_time") - F.lag("start_time").over(order)) / 86400.0)
    out = gaps.groupBy("geohash6").agg(
        F.avg("center_lat").alias("center_lat"), F.avg("center_lon").alias("center_lon"), F.count("*").alias("visit_count"), F.min("start_time").alias("first_visit"), F.max("end_time").alias("last_visit"),
        F.sum("duration_s").alias("total_duration"), F.avg("_days").alias("avg_interval_days"), F.coalesce(F.stddev_samp("_days"), F.lit(0.0)).alias("std_interval_days"), F.min("_days").alias("min_interval_days"), F.max("_days").alias("max_interval_days"),
    ).where(F.col("visit_count") >= min_visits)
    regular = F.when(F.col("avg_interval_days") > 0, 1 / (1 + F.try_divide("std_interval_days", "avg_interval_days"))).otherwise(0.0)
    n = F.col("visit_count")
    return out.withColumn("regularity", regular).select(
        "*", ((F.col("regularity") > 0.8) & (n >= 3)).alias("is_periodic"), ((n >= 5) & (F.col("regularity") > 0.7)).alias("is_habitual"),
        (F.log1p(n.cast("double")) * F.log1p(F.col("total_duration").cast("double"))).alias("strength"),
    )


def utilization(points: DataFrame, segments: DataFrame, stays: DataFrame) -> DataFrame:
    """By area of the points: segments that start there against the time stayed."""
    levels = ("province", "city", "county", "town")

    def long(df: DataFrame, *more: str) -> DataFrame:
        return fan_out(df.select(*levels, *more), _areas(*levels), {"all": F.lit("")})

    keys = ["area_type", "area_key"]
    known = long(points.select(*levels).distinct()).select(*keys).distinct()
    transit = long(segments).groupBy(*keys).agg(F.count("*").alias("transit"))
    stayed = long(stays.withColumn("day", _day("start_time")), "duration_s", "start_time", "end_time", "day", "geohash6").groupBy(*keys).agg(
        F.sum("duration_s").alias("s"), F.count_distinct("day").alias("days"), F.count_distinct("geohash6").alias("grids"), F.min("start_time").alias("first_visit"), F.max("end_time").alias("last_visit")
    )
    both = known.join(transit, keys, "left").join(stayed, keys, "left")
    t, s, days = (F.coalesce(c, F.lit(0)) for c in ("transit", "s", "days"))
    return both.select(
        *keys, t.alias("transit_intensity"), s.alias("stay_duration_s"), days.alias("distinct_visit_days"), F.coalesce("grids", F.lit(0)).alias("distinct_grids"), F.coalesce("first_visit", F.lit(0)).alias("first_visit"),
        F.coalesce("last_visit", F.lit(0)).alias("last_visit"), (s / (t + 1.0)).alias("utilization_efficiency"), (t / (t + s / 3600.0 + 1.0)).alias("transit_dominance"),
        (F.log1p(s.cast("double")) * F.log1p(days.cast("double"))).alias("area_depth"), F.lit(0.0).alias("coverage_efficiency"),
    )


def altitude_events(points: DataFrame, plateau_m: float = 10.0, min_m: float = 50.0, min_s: int = 300, chunk_s: int | None = None) -> DataFrame:
    """Climbs and descents: maximal runs of steps of one sign, from the fix before the run to its last.

    The run's first step adds no distance where it follows level ground. Altitudes outside (-500, 9000) are left out.
    """
    df = points.where((F.col("altitude") > -500) & (F.col("altitude") < 9000))
    df = previous(df, ["data_time", "altitude", "lat", "lon"], "_b", chunk_s)
    step = F.col("altitude") - F.col("_b.altitude")
    df = df.withColumn("kind", F.when(step > plateau_m, "CLIMB").when(step < -plateau_m, "DESCENT").otherwise("FLAT"))
    df = running(df, chunk_s, befores={"_k": F.col("kind")})
    runs = islands(df, F.col("kind") != F.col("_k"), name="run", chunk_s=chunk_s).where("kind <> 'FLAT'")
    order = F.struct("data_time", "id")
    out = runs.groupBy("track_id", "run", "kind").agg(
        F.min_by(F.struct("_b", "distance", "_k"), order).alias("f"), F.max_by(F.struct("data_time", "altitude", "lat", "lon"), order).alias("l"), F.sum("distance").alias("d"), F.count("*").alias("steps")
    )
    level = F.coalesce(F.col("f._k") == "FLAT", F.lit(True))
    distance = F.col("d") - F.when(level, F.coalesce("f.distance", F.lit(0.0))).otherwise(0.0)
    change = F.col("l.altitude") - F.col("f._b.altitude")
    out = out.select(
        "track_id", F.col("kind").alias("event_type"), F.col("f._b.data_time").alias("start_time"), F.col("l.data_time").alias("end_time"), (F.col("l.data_time") - F.col("f._b.data_time")).alias("duration_s"),
        F.col("f._b.lat").alias("start_lat"), F.col("f._b.lon").alias("start_lon"), F.col("f._b.altitude").alias("start_altitude"), F.col("l.altitude").alias("end_altitude"), change.alias("altitude_change"), distance.alias("distance_m"), "steps",
    )
    out = out.where((F.abs("altitude_change") >= min_m) & (F.col("duration_s") >= min_s))
    return out.withColumn("avg_grade", F.when(F.col("distance_m") > 0, F.try_divide("altitude_change", "distance_m") * 100).otherwise(0.0))


def altitude_stats(points: DataFrame) -> DataFrame:
    """Altitude spread, ascent and descent over all points and by province and city, from each area's own fixes in order."""
    high = stored(points.where(F.col("altitude") > 0).select("track_id", "id", "data_time", "altitude", "distance", "province", "city"), "high")
    wide = fan_out(high, {"ALL": F.lit("ALL"), **_areas("province", "city")}, {"all": F.lit("")})
    w = Window.partitionBy("track_id", "area_type", "area_key").orderBy("data_time", "id")
    wide = wide.withColumn("_d", F.col("altitude") - F.lag("altitude").over(w))
    out = wide.groupBy("area_type", "area_key").agg(
        F.count("*").alias("point_count"), F.min("altitude").alias("min_altitude"), F.max("altitude").alias("max_altitude"), F.avg("altitude").alias("avg_altitude"),
        F.coalesce(F.sum(F.greatest("_d", F.lit(0.0))), F.lit(0.0)).alias("total_ascent"), F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0.0))), F.lit(0.0)).alias("total_descent"), F.sum("distance").alias("distance_m"),
    )
    spread = percentiles(wide, F.col("altitude"), [0.25, 0.5, 0.75, 0.9], ["area_type", "area_key"])
    out = out.join(spread, ["area_type", "area_key"])
    named = [F.col("p")[k].alias(n) for k, n in enumerate(("p25", "p50", "p75", "p90"))]
    intensity = F.when(F.col("distance_m") > 0, F.try_divide(F.col("total_ascent") + F.col("total_descent"), F.col("distance_m"))).otherwise(0.0)
    return out.select("area_type", "area_key", "point_count", "min_altitude", "max_altitude", "avg_altitude", (F.col("max_altitude") - F.col("min_altitude")).alias("altitude_span"), *named, "total_ascent", "total_descent", intensity.alias("vertical_intensity"))


def spatial_complexity(points: DataFrame, cells: DataFrame, min_turn: float = 15.0, chunk_s: int | None = None) -> DataFrame:
    """One row: turns, path efficiency, entropy of visits, and a score. Tracks add up; a straight line is a track's first to last fix."""
    known = points.where("heading is not null and distance is not null")
    known = running(known, chunk_s, befores={"_b": F.col("heading")})
    turned = F.abs(F.col("heading") - F.col("_b"))
    known = known.withColumn("_t", F.when(turned > 180, 360 - turned).otherwise(turned))
    order = F.struct("data_time", "id")
    track = known.groupBy("track_id").agg(F.count_if(F.col("_t") > min_turn).alias("c"), F.sum(F.when(F.col("_t") > min_turn, F.col("_t"))).alias("t"), F.sum("distance").alias("d"), F.min_by(F.struct("lat", "lon"), order).alias("a"), F.max_by(F.struct("lat", "lon"), order).alias("b"))
    whole = track.agg(F.sum("c").alias("direction_changes"), (F.try_divide(F.sum("t"), F.sum("c"))).alias("t"), F.sum("d").alias("d"), F.sum(geo.haversine("a.lat", "a.lon", "b.lat", "b.lon")).alias("line"))
    both = whole.crossJoin(F.broadcast(cells.agg(stats.entropy("visit_count").alias("spatial_entropy"))))  # one row each
    out = both.select(F.coalesce("direction_changes", F.lit(0)).alias("direction_changes"), F.coalesce("t", F.lit(0.0)).alias("avg_turn_angle"), F.coalesce(F.try_divide("line", "d"), F.lit(0.0)).alias("path_efficiency"), "spatial_entropy")
    out = out.withColumn("tortuosity", F.when(F.col("path_efficiency") > 0, F.try_divide(F.lit(1.0), F.col("path_efficiency"))).otherwise(0.0))
    one = F.lit(1.0)
    score = 0.4 * F.least(F.col("direction_changes") / 1000, one) + 0.3 * F.least(F.col("tortuosity") / 5, one) + 0.3 * F.least(F.col("spatial_entropy") / 10, one)
    return out.withColumn("trajectory_complexity", score)


def road_overlap(segments: DataFrame) -> DataFrame:
    """How much of a segment was on roads, judged by mode and speed (the limits are compared with the stored km/h)."""
    mode, v = F.col("mode"), F.col("avg_speed_kmh")
    quick = v > 3.0
    ratio = F.when(mode == "CAR", 1.0).when(mode == "BIKE", 0.9).when(mode == "WALK", F.when(quick, 0.8).otherwise(0.5)).otherwise(0.7)
    kind = F.when(mode == "CAR", F.when(F.col("max_speed_kmh") >= 27.8, "HIGHWAY").when(v >= 13.9, "ARTERIAL").otherwise("LOCAL")).when(mode.isin("BIKE", "WALK"), "LOCAL").otherwise("UNKNOWN")
    sure = F.when(mode == "CAR", 0.95).when(mode == "BIKE", 0.7).when(mode == "WALK", F.when(quick, 0.6).otherwise(0.5)).otherwise(0.3)
    out = segments.withColumn("overlap_ratio", ratio).withColumn("road_type", kind).withColumn("road_confidence", sure)
    return out.withColumn("on_road_m", F.col("distance_m") * F.col("overlap_ratio")).withColumn("off_road_m", F.col("distance_m") - F.col("on_road_m"))
