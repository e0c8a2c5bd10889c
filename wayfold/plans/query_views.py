"""Read queries: every view of plans/serving.py asked once, each with its statement in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import behavior, presentation, spatial, statistics, temporal
from wayfold.plans import queries as q
from wayfold.plans.oracles import fan, sql, ts
from wayfold.plans.queries import i, query, r
from wayfold.plans.serving import VIEWS, serve
from wayfold.sources.trace import trace_points

Table = Callable[[SparkSession, str], DataFrame]
#: A column by name, or (name, digits) to round it, or (name, None) for a flag or small number as an int.
Shown = str | tuple[str, int | None]


def _picked(rows: DataFrame, columns: list[Shown]) -> DataFrame:
    return rows.select(*(c if isinstance(c, str) else i(c[0]) if c[1] is None else r(*c) for c in columns))


def view(name: str, of: str, table: Table, columns: list[Shown], oracle: str, order: str = "", limit: int = 0, **asked: object) -> None:
    """Register the view `of` a table under a name."""

    def ask(spark: SparkSession, folder: str) -> DataFrame:
        return _picked(serve(table(spark, folder), VIEWS[of], order, limit, **asked), columns)

    ask.__name__ = name
    query(oracle)(ask)


def last_of(name: str, of: str, table: Table, key: str, columns: list[Shown], oracle: str) -> None:
    """Register the view `of` a table asked for its greatest id."""

    def ask(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder)
        last = rows.agg(F.max(key)).first()[0]
        return _picked(serve(rows, VIEWS[of], id=last), columns)

    ask.__name__ = name
    query(oracle)(ask)


def _half_geocoded(spark: SparkSession, folder: str) -> DataFrame:
    return trace_points(spark, folder).withColumn("province", F.when(F.col("id") % 97 != 0, F.col("province")))


view("ungeocoded_points", "ungeocoded", _half_geocoded, ["id", "data_time"], sql("points", "SELECT id, data_time FROM points WHERE id % 97 = 0 ORDER BY data_time, id LIMIT 1000"))
last_of("track_point", "track_points", trace_points, "id", ["id", "data_time", ("speed", 4)], sql("points", "SELECT id, data_time, round(speed, 4) AS speed FROM points WHERE id = (SELECT max(id) FROM points)"))
view("segments_page", "segments", q.segments, ["segment_id", "mode", "start_time", "duration_s"], sql("seg", "SELECT segment_id, mode, start_time, duration_s FROM seg WHERE mode = 'CAR' AND duration_s >= 600 ORDER BY start_time DESC, segment_id DESC LIMIT 50"), limit=50, mode="CAR", min_duration=600)
last_of("segment_by_id", "segments", q.segments, "segment_id", ["segment_id", "mode", "start_time"], sql("seg", "SELECT segment_id, mode, start_time FROM seg WHERE segment_id = (SELECT max(segment_id) FROM seg)"))
view("stays_page", "stays", q.stays, ["stay_id", "stay_type", "start_time", "duration_s"], sql("stay", "SELECT stay_id, stay_type, start_time, duration_s FROM stay WHERE province = 'ASIA' AND duration_s >= 10000 ORDER BY start_time DESC, stay_id DESC LIMIT 50", "user_id"), limit=50, province="ASIA", min_duration=10_000)
last_of("stay_by_id", "stays", q.stays, "stay_id", ["stay_id", "town", "start_time"], sql("stay", "SELECT stay_id, town, start_time FROM stay WHERE stay_id = (SELECT max(stay_id) FROM stay)", "user_id"))
view("trips_page", "trips", q.trips, ["trip_id", "start_time", "origin_city"], sql("trip", "SELECT trip_id, start_time, origin_city FROM trip WHERE start_time >= 1705000000 AND end_time <= 1706000000 ORDER BY start_time DESC, trip_id DESC LIMIT 50"), limit=50, start=1_705_000_000, end=1_706_000_000)
last_of("trip_by_id", "trips", q.trips, "trip_id", ["trip_id", "start_time", "dest_city"], sql("trip", "SELECT trip_id, start_time, dest_city FROM trip WHERE trip_id = (SELECT max(trip_id) FROM trip)"))
view("stay_rankings", "stay_statistics", lambda s, f: statistics.stay_statistics(q.stays(s, f)), ["area_key", "stay_count", "total_duration"],
    sql("stay", "SELECT area_key, count(*) AS stay_count, CAST(sum(duration_s) AS BIGINT) AS total_duration FROM wide WHERE area_type = 'CITY' AND bucket_type = 'all' GROUP BY area_key ORDER BY sum(duration_s) DESC, area_key LIMIT 10", "user_id", q._STAYS), "duration", 10, stat_type="CITY")
view("extremes_page", "extreme_events", lambda s, f: statistics.extreme_events(q.points(s, f), q.trips(s, f)), ["trip_id", ("value", 5)],
    q.ORACLES["extreme_events"].replace("SELECT trip_id, event_type, id, round(v, 5) AS value FROM (", "SELECT trip_id, round(v, 5) AS value FROM (").replace(") WHERE k = 1", ") WHERE k = 1 AND event_type = 'EASTMOST' ORDER BY v DESC, trip_id LIMIT 50"), type="EASTMOST")
view("regions_page", "admin_view", lambda s, f: statistics.admin_view(q.points(s, f)), ["name", "parent", "unique_days", "visit_count"],
    sql("clean", f"SELECT name, parent, count(DISTINCT CAST({ts('data_time')} AS DATE)) AS unique_days, count(*) AS visit_count FROM v WHERE level = 'CITY' GROUP BY name, parent ORDER BY 3 DESC, name, parent LIMIT 50", more={"v": q._VIEW}), "days", level="CITY")
view("speed_space_page", "speed_space", lambda s, f: spatial.speed_space(q.segments(s, f)), ["area_key", ("avg_speed", 4)], sql("seg", "SELECT area_key, round(v, 4) AS avg_speed FROM spd WHERE area_type = 'PROVINCE' AND bucket_type = 'all'", more=q._SPEED), area_type="PROVINCE")


def _bias(spark: SparkSession, folder: str) -> DataFrame:
    return spatial.directional_bias(q.segments(spark, folder))


for _name, _order, _shown, _value in (("directional_bias_page", "", "total_distance", "round(total, 2)"), ("directional_top_areas", "concentration", "concentration", "round(sqrt(x * x + y * y) / total, 5)"), ("two_way_areas", "bidirectional", "bidirectional_score", "round(two / total, 5)")):
    view(_name, "directional_bias", _bias, ["area_type", "area_key", (_shown, 2 if _shown == "total_distance" else 5)], sql("seg", f"SELECT area_type, area_key, {_value} AS {_shown} FROM tot WHERE bucket_type = 'all' AND m = 'ALL' AND area_type = 'CITY'", more=q._D), _order, area_type="CITY")


def _revisits(spark: SparkSession, folder: str) -> DataFrame:
    return spatial.revisit_patterns(q.stays(spark, folder))


view("revisit_page", "revisit_patterns", _revisits, ["geohash6", "visit_count"], sql("stay", "SELECT geohash6, visit_count FROM rr WHERE visit_count >= 4 ORDER BY strength DESC, geohash6 LIMIT 100", "user_id", q._REVISIT), min_visits=4)
view("habitual_places", "habitual_places", _revisits, ["geohash6", "visit_count"], sql("stay", "SELECT geohash6, visit_count FROM rr WHERE reg > 0.7 AND visit_count >= 5 ORDER BY strength DESC, geohash6 LIMIT 100", "user_id", q._REVISIT))
view("periodic_places", "periodic_places", _revisits, ["geohash6", "visit_count"], sql("stay", "SELECT geohash6, visit_count FROM rr WHERE reg > 0.8 AND visit_count >= 3 ORDER BY strength DESC, geohash6 LIMIT 100", "user_id", q._REVISIT))
view("utilization_page", "utilization", q._utilization, ["area_key", ("utilization_efficiency", 4)], sql("seg stay", "SELECT area_key, round(eff, 4) AS utilization_efficiency FROM ut WHERE area_type = 'CITY'", "user_id", q._USE), area_type="CITY")
view("transit_corridors", "corridors", q._utilization, ["area_type", "area_key", ("transit_dominance", 6)], sql("seg stay", "SELECT area_type, area_key, round(dom, 6) AS transit_dominance FROM ut WHERE dom > 0.7 AND eff < 1 ORDER BY dom DESC, area_type, area_key LIMIT 100", "user_id", q._USE))
view("deep_engagement", "deep_engagement", q._utilization, ["area_type", "area_key", ("area_depth", 4)], sql("seg stay", "SELECT area_type, area_key, round(depth, 4) AS area_depth FROM ut WHERE depth > 20 AND area_type = 'CITY'", "user_id", q._USE), area_type="CITY")


def _rated(spark: SparkSession, folder: str) -> DataFrame:
    return spatial.density_levels(q.cells(spark, folder), 8)


for _name, _level in (("active_areas", "active"), ("core_areas", "core"), ("rare_areas", "rare")):
    _statement = q.ORACLES["density_levels"].replace("level = 12", "level = 8").replace("SELECT grid_id, round(s, 6) AS score", "SELECT grid_id, score FROM (SELECT grid_id, round(s, 6) AS score", 1)
    view(_name, "density", _rated, ["grid_id", ("score", 6)], _statement + f") WHERE density_level = '{_level}'", limit=1000, density_level=_level)


def _altitudes(spark: SparkSession, folder: str) -> DataFrame:
    return spatial.altitude_stats(q.points(spark, folder))


_HEIGHT = q.ORACLES["altitude_stats"].replace("round(max(altitude) - min(altitude), 4) AS altitude_span", "round(max(altitude) - min(altitude), 4) AS altitude_span, round((coalesce(sum(greatest(dd, 0)), 0) + coalesce(sum(greatest(-dd, 0)), 0)) / sum(distance), 6) AS vertical_intensity")
for _name, _of, _order, _shown, _digits, _type in (("altitude_page", "altitude", "span", "altitude_span", 4, "PROVINCE"), ("highest_spans", "highest_spans", "", "altitude_span", 4, "CITY"), ("highest_intensity", "highest_intensity", "", "vertical_intensity", 6, "CITY")):
    _at = _HEIGHT.index("SELECT area_type, area_key, count(*) AS point_count")
    view(_name, _of, _altitudes, ["area_key", (_shown, _digits)], f"{_HEIGHT[:_at]}SELECT area_key, {_shown} FROM ({_HEIGHT[_at:]}) WHERE area_type = '{_type}' AND {_shown} > 0", _order, area_type=_type)


def _slices(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.time_slices(q.points(spark, folder))


for _name, _of, _kind in (("daily_slices", "time_slices", "DAILY"), ("weekly_pattern", "weekly_pattern", "WEEKLY_HOURLY"), ("hourly_pattern", "hourly_pattern", "HOURLY")):
    _at = q.ORACLES["time_slices"].index("SELECT slice_type, slice_key, count(*)")
    view(_name, _of, _slices, ["slice_key", "point_count"], f"{q.ORACLES['time_slices'][:_at]}SELECT slice_key, point_count FROM ({q.ORACLES['time_slices'][_at:]}) WHERE slice_type = '{_kind}'", **({"slice_type": _kind} if _of == "time_slices" else {}))
view("grid_cells_page", "grid_cells", q.cells, ["grid_id", "point_count"], sql("cell", "SELECT grid_id, point_count FROM cell WHERE level = 12 AND point_count >= 3 ORDER BY point_count DESC, grid_id LIMIT 10000"), level=12, min_density=3)


def _drawn(spark: SparkSession, folder: str) -> DataFrame:
    p = q.points(spark, folder)
    return presentation.rendering_metadata(p, behavior.transport_segments(p))


view("rendering_page", "rendering", _drawn, ["id", "data_time", ("lod_level", None)], sql("seg", "SELECT segment_id AS id, start_time AS data_time, CAST(lod AS INT) AS lod_level FROM seg, range(1, 3) t(lod) WHERE mode = 'CAR' AND start_lat >= 22.5 AND start_lon <= 115 AND EXISTS (SELECT 1 FROM runs c WHERE c.track_id = seg.track_id AND c.run = seg.run AND speed > 0) ORDER BY start_time, segment_id LIMIT 10000"), mode="CAR", lod=2, min_lat=22.5, max_lon=115.0)


def _moved(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.movement_by_area(q.segments(spark, folder))


_MOVED = {
    "f": "SELECT *, 'ALL' AS every FROM (SELECT *, f AND NOT coalesce(lag(f) OVER (PARTITION BY track_id ORDER BY start_time, segment_id), FALSE) AS rise FROM (SELECT *, avg_speed_kmh > 50 AS f FROM seg WHERE duration_s > 0 AND distance_m > 0))",
    "wide": fan("f", "province city", "all year month", "start_time") + " UNION ALL " + fan("f", "every", "all year month", "start_time").replace("'EVERY'", "'ALL'"),
    "mv": "SELECT area_type, area_key, bucket_type, bucket_key, sum(distance_m) / 1000 / (sum(duration_s) / 3600) AS mi, sum(CASE WHEN avg_speed_kmh > 5 THEN duration_s ELSE 0 END) / sum(duration_s) AS ar, count(DISTINCT start_time // 86400) AS days, CAST(sum(CASE WHEN rise THEN 1 ELSE 0 END) AS BIGINT) AS bc, CAST(sum(CASE WHEN f THEN duration_s ELSE 0 END) AS BIGINT) AS bd FROM wide GROUP BY ALL",
}
view("compression_page", "compression", _moved, ["area_key", "bucket_key", ("time_compression_index", 3)], sql("seg", "SELECT area_key, bucket_key, round(mi * ar * ln(1 + days), 3) AS time_compression_index FROM mv WHERE area_type = 'CITY' AND bucket_type = 'month'", more=_MOVED), area_type="CITY", bucket_type="month")
view("most_intense_areas", "most_intense", _moved, ["area_key", ("movement_intensity", 4)], sql("seg", "SELECT area_key, round(mi, 4) AS movement_intensity FROM mv WHERE area_type = 'PROVINCE' AND bucket_type = 'year' AND mi > 0", more=_MOVED), area_type="PROVINCE", bucket_type="year")
view("burst_areas", "bursts", _moved, ["area_key", "burst_count", "burst_duration"], sql("seg", "SELECT area_key, bc AS burst_count, bd AS burst_duration FROM mv WHERE area_type = 'CITY' AND bucket_type = 'all' AND bc > 0", more=_MOVED), area_type="CITY", bucket_type="all")


# ---- checks of data


@query(sql("flagged", "SELECT CASE WHEN speed < 2 THEN 'WALK' WHEN speed < 8 THEN 'BIKE' WHEN speed < 40 THEN 'CAR' WHEN speed < 60 THEN 'TRAIN' ELSE 'PLANE' END AS mode, count(*) AS n, round(avg(speed), 2) AS avg_speed, round(avg(accuracy), 2) AS avg_accuracy, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM flagged WHERE r2 OR r1 OR r3 GROUP BY 1"))
def flagged_by_mode(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged fixes by mode, with their share of all flagged ones."""
    from wayfold.operators.foundation import flag_outliers

    bad = flag_outliers(trace_points(spark, folder)).where(F.exists("reasons", lambda x: x.isin("EXCESSIVE_SPEED", "LOW_ACCURACY", "JUMP")))
    by = bad.groupBy(behavior.transport_mode().alias("mode")).agg(F.count("*").alias("n"), r("avg_speed", 2, F.avg("speed")), r("avg_accuracy", 2, F.avg("accuracy")))
    total = by.agg(F.sum("n").alias("_all"))
    return by.crossJoin(F.broadcast(total)).select("mode", "n", "avg_speed", "avg_accuracy", F.round(100.0 * F.col("n") / F.col("_all"), 4).alias("percent"))  # one row


@query(sql("flagged seg", "SELECT count(DISTINCT p.id) AS flagged, count(DISTINCT CASE WHEN s.mode = 'PLANE' THEN p.id END) AS in_flight FROM flagged p LEFT JOIN seg s ON s.track_id = p.track_id AND p.data_time BETWEEN s.start_time AND s.end_time WHERE p.speed > 60"))
def fast_points_in_flights(spark: SparkSession, folder: str) -> DataFrame:
    """Fast fixes, and those of them within segments of the fastest mode: a left join by time ranges, and a conditional distinct count."""
    from wayfold.plans.windows import range_join

    fast = trace_points(spark, folder).where("speed > 60").select("track_id", "id", "data_time")
    s = q.segments(spark, folder).select("track_id", "mode", "start_time", "end_time")
    both = range_join(fast, s, "data_time", "start_time", "end_time", ["track_id"], 3600, "left")
    return both.agg(F.count_distinct("id").alias("flagged"), F.count_distinct(F.when(F.col("mode") == "PLANE", F.col("id"))).alias("in_flight"))


@query(sql("points", "SELECT t AS threshold, CAST(sum(CASE WHEN speed > t THEN 1 ELSE 0 END) AS BIGINT) AS n, round(100.0 * sum(CASE WHEN speed > t THEN 1 ELSE 0 END) / count(*), 4) AS percent FROM points, (SELECT unnest([30, 50, 80, 120, 150, 200]) AS t) GROUP BY t"))
def speed_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """How many fixes each threshold would mark, in one pass."""
    limits = (30, 50, 80, 120, 150, 200)
    one = trace_points(spark, folder).agg(F.count("*").alias("_all"), *(F.count_if(F.col("speed") > t).alias(f"_{t}") for t in limits))
    listed = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"_{t}").alias("n")) for t in limits))
    return one.select("_all", F.explode(listed).alias("x")).select("x.*", F.round(100.0 * F.col("x.n") / F.col("_all"), 4).alias("percent"))


@query(sql("points", "SELECT count(*) AS points, CAST(sum(CASE WHEN id % 97 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS geocoded, CAST(sum(CASE WHEN id % 97 = 0 AND city IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS city_without_province, count(DISTINCT CASE WHEN id % 97 <> 0 THEN province END) AS provinces, count(DISTINCT town) AS towns FROM points"))
def geocoding_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes with places, regions, and gaps in the hierarchy."""
    p = _half_geocoded(spark, folder)
    return p.agg(F.count("*").alias("points"), F.count("province").alias("geocoded"), F.count_if(F.col("province").isNull() & F.col("city").isNotNull()).alias("city_without_province"), F.count_distinct("province").alias("provinces"), F.count_distinct("town").alias("towns"))


@query(sql("seg", "SELECT segment_id, mode, duration_s, CAST(row_number() OVER (ORDER BY duration_s DESC, segment_id) AS INT) AS place FROM (SELECT * FROM seg ORDER BY duration_s DESC, segment_id LIMIT 10)"))
def longest_segments(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    top = q.segments(spark, folder).orderBy(F.desc("duration_s"), "segment_id").limit(10)
    return top.select("segment_id", "mode", "duration_s", F.row_number().over(Window.orderBy(F.desc("duration_s"), "segment_id")).alias("place"))  # ten rows


@query(sql("stay seg", """SELECT s.stay_id, count(g.segment_id) AS segments, CAST(coalesce(sum(g.duration_s), 0) AS BIGINT) AS moving_s FROM
  (SELECT *, lead(start_time) OVER (PARTITION BY track_id ORDER BY start_time, stay_id) AS until FROM stay) s JOIN seg g ON g.track_id = s.track_id AND g.start_time >= s.end_time AND g.end_time <= s.until WHERE until IS NOT NULL GROUP BY s.stay_id""", "user_id"))
def trips_between_stays(spark: SparkSession, folder: str) -> DataFrame:
    found = behavior.stay_trips(q.stays(spark, folder), q.user_segments(spark, folder))
    return found.select(F.col("origin_stay_id").alias("stay_id"), "segments", "moving_s")


@query(sql("clean seg", "SELECT city, CAST(sum(s.duration_s) AS BIGINT) AS duration_s, count(*) AS n FROM clean p JOIN seg s ON s.track_id = p.track_id AND p.id BETWEEN s.segment_id AND s.end_id GROUP BY city".replace("SELECT city", "SELECT p.city AS city").replace("GROUP BY city", "GROUP BY p.city")))
def footprint_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The older rule: a fix counts the durations of all segments whose range of ids holds its own."""
    return statistics.footprint_by_ids(q.points(spark, folder), q.segments(spark, folder))
