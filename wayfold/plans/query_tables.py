"""Queries over loads, dictionaries and rules: dense ids, anchors and labels that are valid for a time, stricter outliers, the persona."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geo, stats
from wayfold.operators import behavior, foundation, presentation, spatial, statistics, temporal
from wayfold.plans import queries as q
from wayfold.plans.oracles import entropy, geohash, hav, sql, tile_id, ts
from wayfold.plans.queries import i, j, query, r
from wayfold.plans.storage import stored
from wayfold.sources.counters import counter_totals, group_sums, numbered
from wayfold.sources.trace import table, trace_points


@query(sql("points", "SELECT row_number() OVER (ORDER BY data_time, id) AS id, id AS event_id, data_time, round(speed, 4) AS speed FROM points"))
def numbered_fixes(spark: SparkSession, folder: str) -> DataFrame:
    """All fixes with dense numbers in the order of time, as a load gives them."""
    fixes = trace_points(spark, folder).select(F.col("id").alias("event_id"), "data_time", "speed")
    return numbered(fixes, ["data_time", "event_id"]).select("id", "event_id", "data_time", r("speed", 4))


_DRIFT = hav("lats[i]", "lons[i]", "mlat", "mlon")
_PATTERN = {
    "seen": f"""SELECT *, lag(data_time) OVER w AS bt, lag(data_time, 2) OVER w AS t2, {hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} AS leg, {hav("lag(lat, 2) OVER w", "lag(lon, 2) OVER w", "lat", "lon")} AS back,
    {hav("lag(lat, 2) OVER w", "lag(lon, 2) OVER w", "lag(lat) OVER w", "lag(lon) OVER w")} AS leg2, list(lat) OVER last AS lats, list(lon) OVER last AS lons, avg(lat) OVER last AS mlat, avg(lon) OVER last AS mlon
  FROM points WINDOW w AS (PARTITION BY track_id ORDER BY data_time, id), last AS (PARTITION BY track_id ORDER BY data_time, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "far": f"SELECT id, max({_DRIFT}) AS m, count(DISTINCT (lats[i], lons[i])) AS places, count(*) AS n FROM (SELECT id, lats, lons, mlat, mlon, unnest(range(1, len(lats) + 1)) AS i FROM seen) GROUP BY id",
    "ruled": """SELECT id, coalesce(data_time - bt > 0 AND data_time - bt <= 3600 AND leg / nullif(data_time - bt, 0) * 3.6 > 300, FALSE) AS jump, coalesce(back <= 50 AND data_time - t2 <= 300 AND leg >= 10 AND leg2 >= 10, FALSE) AS backtrack,
    coalesce(n >= 5 AND m < 20 AND places > 1, FALSE) AS drift, coalesce(accuracy, 0) > 100 AS low FROM seen JOIN far USING (id)""",
}


@query(sql("points", """SELECT id, CAST(jump OR backtrack OR drift AS INT) AS outlier, concat_ws(',', CASE WHEN jump THEN 'JUMP' END, CASE WHEN backtrack THEN 'BACKTRACK' END, CASE WHEN drift THEN 'STATIC_DRIFT' END, CASE WHEN low THEN 'LOW_ACCURACY' END) AS reasons,
  CASE WHEN jump OR backtrack OR drift THEN 'FAIL' WHEN low THEN 'WARNING' ELSE 'PASS' END AS qa_status FROM ruled""", more=_PATTERN))
def outliers_by_pattern(spark: SparkSession, folder: str) -> DataFrame:
    """All fixes under the stricter rules."""
    return foundation.flag_outliers_by_pattern(trace_points(spark, folder)).select("id", i("outlier"), j("reasons"), "qa_status")


def _anchors(stay: DataFrame) -> DataFrame:
    """Anchors at the cells of every third stay, each valid for some days around it, some for ever."""
    own = stay.where(F.col("stay_id") % 3 == 0)
    kind = F.when(F.col("stay_id") % 2 == 0, "HOME").otherwise("WORK")
    until = F.when(F.col("stay_id") % 4 != 0, F.col("start_time") + 864_000)
    return own.select(kind.alias("type"), "grid_id", (F.col("start_time") - 432_000).alias("active_from_ts"), until.alias("active_to_ts"))


def _labels(stay: DataFrame) -> DataFrame:
    """Labels given after every second stay, not all confirmed."""
    own = stay.where(F.col("stay_id") % 2 == 1)
    return own.select("grid_id", F.concat(F.lit("L-"), "town").alias("label"), F.col("end_time").alias("updated_at"), F.when(F.col("stay_id") % 5 != 0, 1).otherwise(0).alias("confirmed"))


_NOTED = {
    "s": f"SELECT *, {tile_id('center_lat', 'center_lon', 15)} AS grid_id, hour({ts('start_time')}) AS h, dayofweek({ts('start_time')}) AS wd, day({ts('start_time')}) <> day({ts('end_time')}) AS night_over, duration_s / 3600 AS hours FROM stay",
    "anchor": "SELECT CASE WHEN stay_id % 2 = 0 THEN 'HOME' ELSE 'WORK' END AS type, grid_id, start_time - 432000 AS f, CASE WHEN stay_id % 4 <> 0 THEN start_time + 864000 END AS t FROM s WHERE stay_id % 3 = 0",
    "said": "SELECT grid_id, 'L-' || town AS label, end_time AS u FROM s WHERE stay_id % 2 = 1 AND stay_id % 5 <> 0",
    "k": """SELECT s.*, (SELECT type FROM anchor a WHERE a.grid_id = s.grid_id AND f <= s.start_time AND (t IS NULL OR s.start_time < t) ORDER BY f DESC, type LIMIT 1) AS known,
    (SELECT label FROM said l WHERE l.grid_id = s.grid_id AND u <= s.start_time ORDER BY u DESC, label DESC LIMIT 1) AS last,
    EXISTS (SELECT 1 FROM seg g WHERE g.track_id = s.track_id AND g.end_time <= s.start_time) AND EXISTS (SELECT 1 FROM seg g WHERE g.track_id = s.track_id AND g.start_time >= s.end_time) AS between_ FROM s""",
}


@query(sql("seg stay", """SELECT stay_id, coalesce(known, concat_ws(',', CASE WHEN length(last) > 0 THEN last END, CASE WHEN night_over AND (h >= 22 OR h < 6) AND hours >= 6 THEN 'HOME' END, CASE WHEN wd BETWEEN 1 AND 5 AND h BETWEEN 8 AND 18 AND hours >= 4 THEN 'WORK' END,
  CASE WHEN (h BETWEEN 11 AND 14 OR h BETWEEN 17 AND 20) AND hours BETWEEN 0.5 AND 2 THEN 'EAT' END, CASE WHEN (h >= 22 OR h < 6) AND hours BETWEEN 4 AND 10 THEN 'SLEEP' END, CASE WHEN hours < 1 AND between_ THEN 'TRANSIT' END)) AS labels FROM k""", "user_id", _NOTED))
def stay_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """Suggestions with anchors that overlap in time and labels of which some are confirmed."""
    p = stored(q.user_points(spark, folder), "points")
    stay = behavior.admin_stays(p)
    placed = stay.withColumn("grid_id", geo.tile_id("center_lat", "center_lon", 15))
    noted = presentation.stay_annotation(stay, behavior.transport_segments(p), _anchors(placed), _labels(placed))
    return noted.select("stay_id", F.array_join(F.transform("suggestions", lambda s: s["label"]), ",").alias("labels"))


_SCORES = {
    "a": "SELECT count(DISTINCT province) FILTER (province <> '') AS provinces, count(DISTINCT city) FILTER (city <> '') AS cities, sum(distance) FILTER (province <> '') AS d FROM clean",
    "m": "SELECT mode, count(*) AS n, sum(avg_speed_kmh) AS v FROM seg GROUP BY mode",
    "w": f"SELECT sum(v) / sum(n) AS kmh, {entropy('n')} AS h, arg_max(mode, (n, mode)) AS primary_mode FROM m",
    "u": "SELECT count(*) AS grids, sum(visit_count) AS visits FROM cell",
    "v": """SELECT round(0.7E0 * least(100, coalesce(d / 1000, 0) / 10000 * 100) + 0.3E0 * least(100, coalesce(kmh, 0) / 50 * 100), 2) AS mobility_score,
    round(0.3E0 * least(100, provinces / 30 * 100) + 0.3E0 * least(100, cities / 300 * 100) + 0.4E0 * least(100, grids / 1000 * 100), 2) AS exploration_score,
    round(coalesce((visits - grids) * 100.0E0 / visits, 0), 2) AS routine_score, round(coalesce(h, 0) / log2(5) * 100, 2) AS diversity_score, primary_mode FROM a, w, u""",
}


@query(sql("clean seg cell", """SELECT *, concat_ws(',', CASE WHEN mobility_score > 80 THEN 'VERY_MOBILE' WHEN mobility_score < 30 THEN 'MOSTLY_AT_REST' END, CASE WHEN exploration_score > 80 THEN 'EXPLORER' WHEN exploration_score < 30 THEN 'KNOWN_PLACES' END,
  CASE WHEN routine_score > 70 THEN 'REGULAR' WHEN routine_score < 30 THEN 'CHANGEABLE' END, CASE WHEN diversity_score > 70 THEN 'MANY_WAYS' END, 'BY_' || primary_mode) AS insights FROM v""", more=_SCORES))
def spatial_persona(spark: SparkSession, folder: str) -> DataFrame:
    p = stored(q.points(spark, folder), "points")
    return presentation.spatial_persona(statistics.footprint(p), behavior.transport_segments(p), spatial.grid_cells(p)).withColumn("insights", j("insights"))


@query(sql("seg", """SELECT segment_id, mode, CASE WHEN avg_speed_kmh >= 60 AND duration_s >= 300 THEN 'HIGH_SPEED_STREAK' ELSE 'WALKING_STREAK' END AS streak_type FROM seg
  WHERE (avg_speed_kmh >= 60 AND duration_s >= 300) OR (mode = 'WALK' AND distance_m >= 2000)"""))
def segment_streaks(spark: SparkSession, folder: str) -> DataFrame:
    """Long fast rides and long walks."""
    return behavior.segment_streaks(q.segments(spark, folder), fast_kmh=60.0, fast_s=300).select("segment_id", "mode", "streak_type")


_COUNTED = "c AS (SELECT CAST(ts AS DATE) AS date, event_type AS name, value FROM events)"


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counters from the events: their kinds are the names."""
    return table(spark, folder, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("name"), "value")


@query(f"""WITH {_COUNTED}, g AS (SELECT date, unnest(['seen', 'done']) AS "group", unnest([sum(CASE WHEN name IN ('view', 'click') THEN value ELSE 0 END), sum(CASE WHEN name IN ('purchase', 'signup') THEN value ELSE 0 END)]) AS total FROM c GROUP BY date)
  SELECT CAST(date AS VARCHAR) AS date, "group", round(total, 2) AS total FROM g""")
def counter_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of groups of counters by day, as charts draw them."""
    sums = group_sums(_counted(spark, folder), {"seen": ("view", "click"), "done": ("purchase", "signup")})
    return sums.select(F.col("date").cast("string").alias("date"), "group", r("total", 2))


@query(f"WITH {_COUNTED} SELECT name, count(DISTINCT date) AS days, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, round(sum(value), 2) AS total FROM c GROUP BY name")
def counters_by_name(spark: SparkSession, folder: str) -> DataFrame:
    found = counter_totals(_counted(spark, folder))
    return found.select("name", "days", F.col("first_date").cast("string").alias("first_date"), F.col("last_date").cast("string").alias("last_date"), r("total", 2))


_DAYS = ("day", "%Y-%m-%d"), ("month", "%Y-%m"), ("year", "%Y")


@query(sql("seg", " UNION ALL ".join(f"SELECT '{g}' AS granularity, strftime({ts('start_time')}, '{f}') AS slice_key, count(*) AS segment_count, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes, min(start_time) AS first_time, max(end_time) AS last_time, round(sum(distance_m), 2) AS distance_m FROM seg GROUP BY 2" for g, f in _DAYS)))
def mode_slices_of_all_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Segments by day, month and year."""
    own = stored(q.segments(spark, folder), "segments")
    parts = [temporal.mode_slices(own, g).withColumn("granularity", F.lit(g)) for g, _ in _DAYS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("granularity", "slice_key", "segment_count", j("modes"), "first_time", "last_time", r("distance_m", 2))


_LIMITS = {"WALK": 5.0, "BIKE": 20.0, "CAR": 60.0, "TRAIN": 150.0, "PLANE": 220.0}


@query(sql("seg", "SELECT mode, segment_id, CAST(k AS INT) AS place, round(max_speed_kmh, 4) AS max_speed_kmh FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY max_speed_kmh DESC, segment_id) AS k FROM seg WHERE max_speed_kmh >= CASE mode " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in _LIMITS.items()) + " END) WHERE k <= 10"))
def fastest_by_mode(spark: SparkSession, folder: str) -> DataFrame:
    """The ten fastest segments of each mode among those above the mode's own limit."""
    return behavior.fastest_segments(q.segments(spark, folder), _LIMITS).select("mode", "segment_id", i("place"), r("max_speed_kmh", 4))


@query(sql("runs", f"SELECT {geohash('lat', 'lon', 5)} AS geohash, count(*) AS point_count, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes FROM runs GROUP BY 1"))
def modes_by_geohash(spark: SparkSession, folder: str) -> DataFrame:
    """The modes by which each geohash cell was crossed."""
    own = q.points(spark, folder).withColumn("mode", behavior.transport_mode())
    return spatial.geohash_modes(own, 5).select("geohash", "point_count", j("modes"))


@query(sql("clean", f"SELECT id, round(fmod(fmod(radians(heading) - 1 + pi(), 2 * pi()) + 2 * pi(), 2 * pi()) - pi(), 9) AS turn FROM clean"))
def turns_in_radians(spark: SparkSession, folder: str) -> DataFrame:
    """The turn from a bearing of one radian to each fix's heading."""
    return q.points(spark, folder).select("id", r("turn", 9, geo.angular_difference_radians(F.lit(1.0), F.radians("heading"))))


@query("SELECT event_type, round(-sum(p * ln(p)), 6) AS nats FROM (SELECT event_type, n / sum(n) OVER (PARTITION BY event_type) AS p FROM (SELECT event_type, user_id % 10 AS k, count(*) AS n FROM events GROUP BY ALL)) GROUP BY event_type")
def entropy_in_nats(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "events").groupBy("event_type", (F.col("user_id") % 10).alias("k")).agg(F.count("*").alias("n"))
    return counts.groupBy("event_type").agg(r("nats", 6, stats.entropy("n", math.e)))


@query(sql("stay seg", f"""SELECT origin_stay_id, dest_stay_id, segments, CASE WHEN a6 = b6 THEN 'ROUND_TRIP' WHEN e - s <= 7200 AND (hour({ts('s')}) BETWEEN 6 AND 10 OR hour({ts('s')}) BETWEEN 16 AND 20) THEN 'COMMUTE' ELSE 'ONE_WAY' END AS trip_type FROM (
  SELECT s.stay_id AS origin_stay_id, nid AS dest_stay_id, s.geohash6 AS a6, n6 AS b6, count(*) AS segments, min(g.start_time) AS s, max(g.end_time) AS e
  FROM (SELECT *, lead(start_time) OVER w AS until, lead(stay_id) OVER w AS nid, lead(geohash6) OVER w AS n6 FROM stay WINDOW w AS (PARTITION BY track_id ORDER BY start_time, stay_id)) s
  JOIN seg g ON g.track_id = s.track_id AND g.start_time >= s.end_time AND g.end_time <= s.until WHERE until IS NOT NULL GROUP BY ALL)""", "user_id"))
def trip_types(spark: SparkSession, folder: str) -> DataFrame:
    """Trips between stays by their type."""
    p = stored(q.user_points(spark, folder), "points")
    return behavior.stay_trips(behavior.admin_stays(p), behavior.transport_segments(p)).select("origin_stay_id", "dest_stay_id", "segments", "trip_type")
