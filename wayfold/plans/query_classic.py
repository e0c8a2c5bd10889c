"""Queries of the older rules (operators/classic.py), of geocoding by cell and of stretched windows, each with its statement in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import behavior, classic, foundation
from wayfold.plans import queries as q
from wayfold.plans.oracles import fan, hav, sql, ts
from wayfold.plans.queries import i, j, query, r
from wayfold.sources.trace import trace_points

_W = "WINDOW w AS (PARTITION BY track_id ORDER BY data_time, id)"
_MODED = {
    "legs": f"SELECT * EXCLUDE (dt, hop), {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS leg, data_time - lag(data_time) OVER w AS wait, lag(province) OVER w AS pp, row_number() OVER w AS rn FROM clean {_W}",
    "fast": "SELECT *, coalesce(leg / nullif(wait, 0) * 3.6E0, 0) AS v, greatest(coalesce(speed, 0) * 3.6E0, coalesce(leg / nullif(wait, 0) * 3.6E0, 0)) AS kmh FROM legs",
    "ruled": """SELECT *, CASE WHEN altitude > 1000 AND kmh BETWEEN 200 AND 1000 THEN 1 WHEN kmh BETWEEN 80 AND 350 AND province <> pp THEN 2 WHEN kmh BETWEEN 80 AND 350 THEN 3 WHEN kmh BETWEEN 20 AND 120 THEN 4
    WHEN kmh >= 1 AND kmh < 10 THEN 5 WHEN kmh < 1 THEN 6 ELSE 7 END AS rule FROM fast""",
    "moded": """SELECT *, ['FLIGHT', 'TRAIN', 'CAR', 'CAR', 'WALK', 'STAY', 'UNKNOWN'][rule] AS mode, [0.95E0, 0.85E0, 0.7E0, 0.75E0, 0.8E0, 0.9E0, 0.5E0][rule] AS sure,
    ['HIGH_ALTITUDE,FLIGHT_SPEED_RANGE', 'TRAIN_SPEED_RANGE,CROSSES_PROVINCE', 'HIGH_SPEED', 'CAR_SPEED_RANGE', 'WALKING_SPEED', 'STATIONARY', 'NO_MATCHING_RULE'][rule] AS reasons FROM ruled""",
}


def _moded(spark: SparkSession, folder: str) -> DataFrame:
    return classic.rule_modes(q.points(spark, folder))


@query(sql("clean", "SELECT id, mode, sure AS mode_confidence, reasons AS mode_reasons, round(kmh, 3) AS kmh FROM moded", more=_MODED))
def modes_by_rule(spark: SparkSession, folder: str) -> DataFrame:
    return _moded(spark, folder).select("id", "mode", "mode_confidence", j("mode_reasons"), r("kmh", 3))


@query(sql("clean", f"""SELECT first(id ORDER BY data_time, id) AS segment_id, last(id ORDER BY data_time, id) AS end_id, track_id, mode, min(data_time) AS start_time, max(data_time) AS end_time, max(data_time) - min(data_time) AS duration_s, count(*) AS point_count,
  round(sum(CASE WHEN b = 0 THEN leg ELSE 0 END), 3) AS distance_m, round(coalesce(sum(CASE WHEN b = 0 THEN leg ELSE 0 END) / nullif(max(data_time) - min(data_time), 0) * 3.6E0, 0), 4) AS avg_speed_kmh, round(max(coalesce(speed, 0)) * 3.6E0, 4) AS max_speed_kmh,
  first(sure ORDER BY data_time, id) AS confidence, first(reasons ORDER BY data_time, id) AS reasons
  FROM (SELECT *, sum(b) OVER w AS run FROM (SELECT *, CASE WHEN lag(mode) OVER w = mode THEN 0 ELSE 1 END AS b FROM moded {_W}) {_W}) GROUP BY track_id, run, mode""", more=_MODED))
def segments_by_rule(spark: SparkSession, folder: str) -> DataFrame:
    out = classic.rule_segments(_moded(spark, folder))
    return out.select("segment_id", "end_id", "track_id", "mode", "start_time", "end_time", "duration_s", "point_count", r("distance_m", 3), r("avg_speed_kmh", 4), r("max_speed_kmh", 4), "confidence", j("reasons"))


@query(sql("clean", """SELECT id, CASE mode WHEN 'STAY' THEN '#808080' WHEN 'WALK' THEN '#00FF00' WHEN 'CAR' THEN '#FFA500' WHEN 'TRAIN' THEN '#FF0000' WHEN 'FLIGHT' THEN '#0000FF' ELSE
  CASE WHEN s < 1 THEN '#808080' WHEN s < 10 THEN '#00FF00' WHEN s < 80 THEN '#FFA500' WHEN s < 200 THEN '#FF0000' ELSE '#0000FF' END END AS render_color,
  CASE mode WHEN 'CAR' THEN 2 WHEN 'TRAIN' THEN 3 WHEN 'FLIGHT' THEN 4 ELSE 1 END AS render_width, round(greatest(0.1E0, CASE WHEN accuracy > 100 THEN 0.5E0 WHEN accuracy > 50 THEN 0.7E0 ELSE 1 END), 6) AS render_opacity,
  CASE WHEN s > 80 THEN 1 WHEN s > 10 THEN 2 WHEN s > 1 THEN 3 ELSE 4 END AS lod_level FROM (SELECT *, coalesce(speed, 0) * 3.6E0 AS s FROM moded)""", more=_MODED))
def point_styles(spark: SparkSession, folder: str) -> DataFrame:
    return classic.point_styles(_moded(spark, folder)).select("id", "render_color", i("render_width"), r("render_opacity"), i("lod_level"))


@query(sql("clean", """SELECT track_id, after_id, id AS before_id, CAST(k AS INT) AS k, CAST(floor(t0 + k / (n + 1) * wait) AS BIGINT) AS data_time, round(y0 + k / (n + 1) * (lat - y0), 8) AS lat, round(x0 + k / (n + 1) * (lon - x0), 8) AS lon,
  round(CASE WHEN kind = 'TRAIN' THEN 0 WHEN k / (n + 1) < 0.2 THEN 10000 * (k / (n + 1)) / 0.2E0 WHEN k / (n + 1) > 0.8 THEN 10000 * (1 - k / (n + 1)) / 0.2E0 ELSE 10000 END, 4) AS altitude, kind || '_INTERPOLATION' AS source FROM (
  SELECT *, greatest(1, wait // 600) AS n, unnest(range(1, greatest(1, wait // 600) + 1)) AS k FROM (
    SELECT *, CASE WHEN ma > 400 AND mv BETWEEN 200 AND 1000 THEN 'FLIGHT' WHEN mv BETWEEN 80 AND 350 AND p <> q THEN 'TRAIN' END AS kind FROM (
      SELECT *, lag(id) OVER w AS after_id, lag(data_time) OVER w AS t0, lag(lat) OVER w AS y0, lag(lon) OVER w AS x0, avg(CASE WHEN rn > 1 THEN v END) OVER n AS mv, avg(CASE WHEN rn > 1 THEN coalesce(altitude, 0) END) OVER n AS ma, min(nullif(province, '')) OVER m AS p, max(nullif(province, '')) OVER m AS q
      FROM fast WINDOW w AS (PARTITION BY track_id ORDER BY data_time, id), n AS (PARTITION BY track_id ORDER BY data_time, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), m AS (PARTITION BY track_id ORDER BY data_time, id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)))
  WHERE wait > 600 AND v > 80 AND kind IS NOT NULL)""", more=_MODED))
def rides_filled(spark: SparkSession, folder: str) -> DataFrame:
    """At gaps of ten minutes and flights from 400 m, since these traces are dense and low."""
    out = classic.fill_rides(q.points(spark, folder), gap=600, flight_m=400.0)
    return out.select("track_id", "after_id", "before_id", "k", "data_time", r("lat", 8), r("lon", 8), r("altitude", 4), "source")


_WALK = {
    "num": "SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY data_time, id) AS rn FROM clean",
    "walk": f"""SELECT track_id, rn, id AS sid, data_time AS s, data_time AS e, 1 AS n, lat AS y, lon AS x, 0.0E0 AS reach FROM num WHERE rn = 1 UNION ALL
    SELECT track_id, nrn, CASE WHEN near THEN sid ELSE nid END, CASE WHEN near THEN s ELSE t END, t, CASE WHEN near THEN n + 1 ELSE 1 END, CASE WHEN near THEN y + lat ELSE lat END, CASE WHEN near THEN x + lon ELSE lon END, CASE WHEN near THEN greatest(reach, d) ELSE 0 END
    FROM (SELECT *, d <= 700 AS near FROM (SELECT walk.*, num.rn AS nrn, num.id AS nid, data_time AS t, lat, lon, {hav("lat", "lon", "y / n", "x / n")} AS d FROM walk JOIN num ON num.track_id = walk.track_id AND num.rn = walk.rn + 1))""",
}


@query(sql("clean", f"""SELECT sid AS stay_id, track_id, s AS start_time, m.e AS end_time, m.e - s AS duration_s, m.n AS point_count, round(m.y / m.n, 7) AS center_lat, round(m.x / m.n, 7) AS center_lon, round(m.reach, 3) AS radius_m,
  CASE WHEN h >= 22 OR h < 6 THEN 'HOME' WHEN h >= 9 AND h < 18 AND m.e - s > 14400 THEN 'WORK' WHEN m.e - s < 3600 THEN 'TRANSIT' ELSE 'VISIT' END AS stay_kind
  FROM (SELECT track_id, sid, s, hour({ts("s")}) AS h, max(struct_pack(n := CAST(n AS BIGINT), e := e, y := y, x := x, reach := reach)) AS m FROM walk GROUP BY track_id, sid, s) WHERE m.n >= 2 AND m.e - s >= 7200""", "user_id", _WALK))
def stays_sequential(spark: SparkSession, folder: str) -> DataFrame:
    """Within 700 m, since the fixes of a user lie a kilometre apart."""
    out = classic.sequential_stays(q.user_points(spark, folder), radius_m=700.0)
    return out.select("stay_id", "track_id", "start_time", "end_time", "duration_s", "point_count", r("center_lat", 7), r("center_lon", 7), r("radius_m", 3), "stay_kind")


_AS_OF = 1_735_689_600


def _all_stays(spark: SparkSession, folder: str) -> DataFrame:
    return q.stays(spark, folder)


@query(sql("stay", f"""SELECT stay_id, frequency, purpose, round(sure, 2) AS purpose_confidence, CASE split_part(purpose, '_', 1) WHEN 'HOME' THEN 'Home in ' WHEN 'WORK' THEN 'Work in ' WHEN 'MEAL' THEN upper(meal[1]) || lower(meal[2:]) || ' in ' WHEN 'TRANSIT' THEN 'Transit in ' WHEN 'VISIT' THEN 'Visit to ' ELSE 'Stay in ' END || area AS label,
  CAST(floor(least(100.0E0, least(frequency / 20.0E0, 1) * 40 + least(duration_s / 86400.0E0, 1) * 30 + greatest(0, 1 - ({_AS_OF} - end_time) / 86400.0E0 / 365) * 20 + 5)) AS INT) AS importance FROM (
  SELECT *, CASE WHEN h >= 22 OR h < 6 THEN duration_s > 14400 AND frequency > 10 ELSE FALSE END AS home,
    CASE WHEN (h >= 22 OR h < 6) AND duration_s > 14400 AND frequency > 10 THEN 'HOME' WHEN wd AND h >= 6 AND h < 18 AND duration_s > 7200 AND frequency > 5 THEN 'WORK' WHEN meal IS NOT NULL AND duration_s < 7200 THEN 'MEAL_' || meal
    WHEN duration_s < 3600 THEN 'TRANSIT' WHEN (NOT wd OR h BETWEEN 18 AND 21) AND duration_s > 3600 AND duration_s < 14400 THEN 'VISIT' ELSE 'UNKNOWN' END AS purpose,
    CASE split_part(purpose, '_', 1) WHEN 'HOME' THEN 0.9E0 WHEN 'WORK' THEN 0.8E0 WHEN 'MEAL' THEN 0.7E0 WHEN 'TRANSIT' THEN 0.6E0 WHEN 'VISIT' THEN 0.5E0 ELSE 0.3E0 END AS sure FROM (
    SELECT *, hour({ts("start_time")}) AS h, dayofweek({ts("start_time")}) NOT IN (0, 6) AS wd, CASE WHEN hour({ts("start_time")}) IN (7, 8) THEN 'BREAKFAST' WHEN hour({ts("start_time")}) IN (11, 12) THEN 'LUNCH' WHEN hour({ts("start_time")}) IN (17, 18) THEN 'DINNER' END AS meal,
      coalesce(nullif(county, ''), nullif(city, ''), province) AS area, count(*) OVER (PARTITION BY coalesce(nullif(county, ''), nullif(city, ''), province), round(center_lat, 4), round(center_lon, 4)) AS frequency FROM stay WHERE confidence > 0.1))""", "user_id"))
def labelled_stays(spark: SparkSession, folder: str) -> DataFrame:
    """Of stays surer than a tenth: these have few fixes each."""
    out = classic.labelled_stays(_all_stays(spark, folder), _AS_OF, 0.1)
    return out.select("stay_id", "frequency", "purpose", r("purpose_confidence", 2), "label", i("importance"))


@query(sql("stay", """SELECT area_type, area_key, bucket_type, bucket_key, count(*) AS stay_count, CAST(sum(duration_s) AS BIGINT) AS total_duration_s, max(duration_s) AS max_duration_s, min(start_time) AS first_visit, max(end_time) AS last_visit,
  (SELECT count(DISTINCT d) FROM dayed WHERE dayed.area_type = f.area_type AND dayed.area_key = f.area_key AND dayed.bucket_type = f.bucket_type AND dayed.bucket_key = f.bucket_key) AS visit_days FROM wide f GROUP BY ALL""", "user_id", {
    "wide": fan("(SELECT *, 'UNKNOWN' AS activity_type FROM stay WHERE confidence > 0.1)", "province city county town activity_type", "all year month day", "start_time"),
    "dayed": f"SELECT area_type, area_key, bucket_type, bucket_key, unnest(generate_series(CAST({ts('start_time')} AS DATE), CAST({ts('end_time')} AS DATE), INTERVAL 1 DAY)) AS d FROM wide",
}))
def stays_by_spanned_days(spark: SparkSession, folder: str) -> DataFrame:
    return classic.stays_by_spanned_days(_all_stays(spark, folder), 0.1)


@query(q.ORACLES["transport_segments"])
def transport_segments_by_stretch(spark: SparkSession, folder: str) -> DataFrame:
    """transport_segments with windows over stretches of two days; the same rows."""
    days = 172_800
    found = behavior.transport_segments(foundation.clean(trace_points(spark, folder), days), chunk_s=days)
    return found.select("segment_id", "track_id", "mode", "start_time", "end_time", "duration_s", "point_count", r("distance_m", 3), r("avg_speed_kmh", 4), r("max_speed_kmh", 4), "end_id", "city")


@query(sql("points", "SELECT id, CASE " + " ".join(f"WHEN {q._in_ring(a[4])} THEN '{a[0]}'" for a in q.AREAS) + " END AS province FROM (SELECT id, (floor((lat + 90) / 180 * 131072) + 0.5E0) / 131072 * 180 - 90 AS lat, (floor((lon + 180) / 360 * 262144) + 0.5E0) / 262144 * 360 - 180 AS lon FROM points)"))
def geocode_by_cell(spark: SparkSession, folder: str) -> DataFrame:
    bare = trace_points(spark, folder).withColumns({p: F.lit(None).cast("string") for p in behavior.PLACES})
    return foundation.reverse_geocode_by_cell(bare, q._areas(spark)).select("id", "province")
