"""What viewers draw and read: rendering hints, time-axis markers, notes on stays, a persona."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo, stats
from wayfold.operators.behavior import with_runs
from wayfold.plans.ranking import percentiles, with_ranks
from wayfold.plans.storage import stored
from wayfold.plans.windows import asof, valid_at

#: Icons and colours of transport modes, and of what else is marked.
MODE_ICONS = {"WALK": "walk", "BIKE": "bike", "CAR": "car", "TRAIN": "train", "PLANE": "plane"}
MODE_COLOURS = {"WALK": "#4CAF50", "BIKE": "#2196F3", "CAR": "#FF9800", "TRAIN": "#9C27B0", "PLANE": "#F44336"}
OTHER_ICON, OTHER_COLOUR, STAY_COLOUR, SPEED_COLOUR, ALTITUDE_COLOUR = "circle", "#757575", "#FF6B6B", "#FFA500", "#4CAF50"
DEFAULT_SPEEDS = (0.0, 2.0, 5.0, 10.0, 20.0, 30.0)


def rendering_metadata(points: DataFrame, segments: DataFrame, zoom: int = 15) -> DataFrame:
    """Per segment and level of detail (1 to 3): its start (id, data_time, lat, lon) and mode, speed bucket, how travelled its
    commonest cell is, line weight and alpha."""
    grid = geo.tile_id("lat", "lon", zoom)
    p = stored(with_runs(points).select("track_id", "run", "speed", grid.alias("grid")), "runs")
    limits = percentiles(p.where("speed > 0"), F.col("speed"), [k / 5 for k in range(6)])
    limits = limits.select(F.coalesce("p", F.array(*map(F.lit, DEFAULT_SPEEDS))).alias("p"))
    # the share of cells with fewer points
    ranks = with_ranks(p.groupBy("grid").agg(F.count("*").alias("n")), "n", []).select("grid", (F.col("_below") / F.col("_total")).alias("overlap_rank"))
    by_cell = p.where("speed > 0").groupBy("track_id", "run", "grid").agg(F.count("*").alias("c"), F.sum("speed").alias("s"))
    # doubles added in another order give other last digits, which decide where a mean equals a limit: the least cell comes first
    upto = Window.partitionBy("track_id", "run").orderBy("s", "grid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = by_cell.withColumn("_upto", F.sum("s").over(upto))
    runs = summed.groupBy("track_id", "run").agg((F.max_by("_upto", F.struct("s", "grid")) / F.sum("c")).alias("v"), F.min_by("grid", F.struct(-F.col("c"), F.col("grid"))).alias("grid"))
    begin = [F.col("segment_id").alias("id"), F.col("start_time").alias("data_time"), F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon"), "mode"]
    own = segments.select("segment_id", "track_id", "run", *begin).join(runs, ["track_id", "run"]).join(ranks, "grid", "left").crossJoin(F.broadcast(limits))
    bucket = F.lit(0)
    for k in range(6):
        bucket = F.when(F.col("v") >= F.col("p")[k], k).otherwise(bucket)
    rank = F.coalesce("overlap_rank", F.lit(0.0))
    out = own.select("segment_id", "id", "data_time", "lat", "lon", "mode", bucket.alias("speed_bucket"), rank.alias("overlap_rank"), (1.0 + rank * 2.0).alias("line_weight"), (0.3 + rank * 0.7).alias("alpha_hint"))
    return out.withColumn("lod_level", F.explode(F.array(*map(F.lit, (1, 2, 3)))))


def heatmap(cells: DataFrame, metric: str = "point_count") -> DataFrame:
    """Cells with their metric scaled to 0..1; 1 where all are equal."""
    return stats.normalised(cells.withColumn("_v", F.col(metric).cast("double")), "_v", [], "intensity").drop("_v")


def _marker(df: DataFrame, kind: str, entity: str, time: str, place: tuple[str, str], label: Column, icon: Column, colour: Column, source: str) -> DataFrame:
    lat, lon = (F.col(c) for c in place)
    return df.select(
        F.col(time).alias("marker_time"), F.lit(kind).alias("marker_type"), F.col(source).alias("entity_id"), F.lit(entity).alias("entity_type"), lat.alias("lat"), lon.alias("lon"), label.alias("label"), icon.alias("icon"), colour.alias("color")
    )


def _by_mode(values: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("mode")), F.lit(other))


def time_axis_markers(segments: DataFrame, stays: DataFrame, speed: DataFrame, altitude: DataFrame, min_stay_s: int = 7200, min_change_m: float = 100.0, most: tuple[int, int, int, int] | None = (1000, 500, 200, 200)) -> DataFrame:
    """Markers on a time axis: segment starts and ends, long stays, speed and altitude events, the earliest of each kind.

    `most` are a viewer's limits per kind (segments, stays, speed, altitude); None shows all.
    """
    stays, altitude = stays.where(F.col("duration_s") >= min_stay_s), altitude.where(F.abs("altitude_change") >= min_change_m)
    if most is not None:
        segments = segments.orderBy("start_time", "segment_id").limit(most[0])
        stays = stays.orderBy("start_time", "stay_id").limit(most[1])
        speed = speed.orderBy("peak_time", "segment_id").limit(most[2])
        altitude = altitude.orderBy("start_time", "track_id").limit(most[3])
    icon, colour = _by_mode(MODE_ICONS, OTHER_ICON), _by_mode(MODE_COLOURS, OTHER_COLOUR)
    hours = F.floor(F.col("duration_s") / 3600).cast("string")
    fast, change = F.round(F.col("max_speed") * 3.6).cast("long"), F.round("altitude_change").cast("long")
    start, end = ("start_lat", "start_lon"), ("end_lat", "end_lon")
    parts = [
        _marker(segments, "SEGMENT_START", "SEGMENT", "start_time", start, F.concat("mode", F.lit(" Start")), icon, colour, "segment_id"),
        _marker(segments, "SEGMENT_END", "SEGMENT", "end_time", end, F.concat("mode", F.lit(" End")), icon, colour, "segment_id"),
        _marker(stays, "STAY", "STAY", "start_time", ("center_lat", "center_lon"), F.concat(F.lit("Stay ("), hours, F.lit("h)")), F.lit("pin"), F.lit(STAY_COLOUR), "stay_id"),
        _marker(speed, "EVENT", "SPEED_EVENT", "peak_time", ("peak_lat", "peak_lon"), F.concat(F.lit("Speed "), fast, F.lit(" km/h")), F.lit("flash"), F.lit(SPEED_COLOUR), "segment_id"),
        _marker(altitude, "EVENT", "ALTITUDE_EVENT", "start_time", start, F.concat("event_type", F.lit(" "), change, F.lit("m")), F.when(F.col("event_type") == "DESCENT", "arrow-down").otherwise("mountain"), F.lit(ALTITUDE_COLOUR), "track_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stay_annotation(stays: DataFrame, segments: DataFrame, anchors: DataFrame | None = None, labels: DataFrame | None = None, zoom: int = 15) -> DataFrame:
    """Stays with time features, the segments before and after, and label suggestions.

    anchors: (type, grid_id), and active_from_ts and active_to_ts if they are valid for a time: that of the stay's start
    counts (windows.valid_at). labels: (grid_id, label, updated_at), and confirmed if some are not: a cell's latest confirmed
    one not after the stay's start counts. A known anchor is the only suggestion; otherwise rules suggest.
    """
    start, end = F.timestamp_seconds("start_time"), F.timestamp_seconds("end_time")
    df = stays.withColumn("grid_id", geo.tile_id("center_lat", "center_lon", zoom)).withColumn("hour", F.hour(start)).withColumn("weekday", F.dayofweek(start) - 1)
    df = df.withColumn("is_weekend", F.col("weekday").isin(0, 6)).withColumn("is_night", (F.col("hour") >= 22) | (F.col("hour") < 6))
    df = df.withColumn("is_overnight", F.dayofmonth(start) != F.dayofmonth(end)).withColumn("hours", F.col("duration_s") / 3600)
    seg = segments.select("track_id", "segment_id", "mode", "start_time", "end_time").withColumnRenamed("start_time", "_s").withColumnRenamed("end_time", "_e")
    df = asof(df, seg, "start_time", "_e", ["track_id"], ["mode", "segment_id"], "arrival")
    df = asof(df, seg, "end_time", "_s", ["track_id"], ["mode", "segment_id"], "departure", forward=True)
    known, last = F.lit(None).cast("string"), F.lit(None).cast("string")
    if anchors is not None:
        for c in ("active_from_ts", "active_to_ts"):
            anchors = anchors if c in anchors.columns else anchors.withColumn(c, F.lit(None).cast("long"))
        df = valid_at(df, anchors, "start_time", "grid_id", "type", "active_from_ts", "active_to_ts", "_anchor")
        known = F.col("_anchor")
    if labels is not None:
        sure = labels.where(F.col("confirmed").cast("boolean")) if "confirmed" in labels.columns else labels
        df = asof(df, sure.where("grid_id is not null"), "start_time", "updated_at", ["grid_id"], ["label"], "_said").withColumn("_label", F.col("_said.label")).drop("_said")
        last = F.col("_label")

    def suggestion(rule: Column, label: str | Column, sure: float, *reasons: str) -> Column:
        name = F.lit(label) if isinstance(label, str) else label
        return F.when(rule, F.struct(name.alias("label"), F.lit(sure).alias("confidence"), F.array(*map(F.lit, reasons)).alias("reasons")))

    h, hours = F.col("hour"), F.col("hours")
    rules = [
        suggestion(F.length(last) > 0, last, 0.85, "HISTORICAL_LABEL"),
        suggestion(F.col("is_overnight") & F.col("is_night") & (hours >= 6), "HOME", 0.8, "OVERNIGHT", "NIGHT_HOURS", "LONG_DURATION"),
        suggestion(~F.col("is_weekend") & h.between(8, 18) & (hours >= 4), "WORK", 0.7, "WEEKDAY", "DAYTIME", "LONG_DURATION"),
        suggestion((h.between(11, 14) | h.between(17, 20)) & hours.between(0.5, 2), "EAT", 0.6, "MEAL_HOURS", "SHORT_DURATION"),
        suggestion(F.col("is_night") & hours.between(4, 10), "SLEEP", 0.65, "NIGHT_HOURS", "MEDIUM_DURATION"),
        suggestion((hours < 1) & F.col("arrival").isNotNull() & F.col("departure").isNotNull(), "TRANSIT", 0.5, "SHORT_DURATION", "BETWEEN_MOVEMENTS"),
    ]
    anchor = F.array(suggestion(F.lit(True), known, 0.95, "KNOWN_ANCHOR"))
    return df.withColumn("suggestions", F.when(known.isNotNull(), anchor).otherwise(F.array_compact(F.array(*rules)))).drop("_anchor", "_label")


def spatial_persona(footprint: DataFrame, segments: DataFrame, cells: DataFrame) -> DataFrame:
    """One row of scores from 0 to 100: mobility, exploration, routine, diversity, the commonest mode and codes of insights."""
    whole = footprint.where("bucket_type = 'all'")
    seen = whole.agg(F.count_if(F.col("area_type") == "PROVINCE").alias("provinces"), F.count_if(F.col("area_type") == "CITY").alias("cities"), F.sum(F.when(F.col("area_type") == "PROVINCE", F.col("total_distance"))).alias("d"))
    modes = segments.groupBy("mode").agg(F.count("*").alias("n"), F.sum(F.col("avg_speed_kmh")).alias("v"))
    moved = modes.agg((F.sum("v") / F.sum("n")).alias("kmh"), stats.entropy("n").alias("h"), F.max_by("mode", F.struct("n", "mode")).alias("primary_mode"))
    used = cells.agg(F.count("*").alias("grids"), F.sum("visit_count").alias("visits"))
    one = seen.crossJoin(F.broadcast(moved)).crossJoin(F.broadcast(used))  # one row each

    def part(x: Column, full: float) -> Column:
        return F.least(F.lit(100.0), F.coalesce(x, F.lit(0.0)) / full * 100)

    out = one.select(
        F.round(0.7 * part(F.col("d") / 1000, 10_000) + 0.3 * part(F.col("kmh"), 50), 2).alias("mobility_score"),
        F.round(0.3 * part(F.col("provinces").cast("double"), 30) + 0.3 * part(F.col("cities").cast("double"), 300) + 0.4 * part(F.col("grids").cast("double"), 1000), 2).alias("exploration_score"),
        F.round(F.coalesce(F.try_divide((F.col("visits") - F.col("grids")) * 100.0, F.col("visits")), F.lit(0.0)), 2).alias("routine_score"),
        F.round(F.coalesce(F.col("h"), F.lit(0.0)) / F.log2(F.lit(5.0)) * 100, 2).alias("diversity_score"),
        "primary_mode",
    )
    m, e, r, d = (F.col(f"{x}_score") for x in ("mobility", "exploration", "routine", "diversity"))
    said = F.array(
        F.when(m > 80, "VERY_MOBILE").when(m < 30, "MOSTLY_AT_REST"), F.when(e > 80, "EXPLORER").when(e < 30, "KNOWN_PLACES"), F.when(r > 70, "REGULAR").when(r < 30, "CHANGEABLE"), F.when(d > 70, "MANY_WAYS"),
        F.concat(F.lit("BY_"), "primary_mode"),
    )
    return out.withColumn("insights", F.array_compact(said))
