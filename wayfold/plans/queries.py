"""The registered queries of the analytics operators over the driver's tables, each with its statement in SQL where SQL can say it.

Two readings of the events table serve as traces: four long tracks (user modulo 4) for movement, and a track per user for
what needs stays. Floating-point results are rounded, flags are integers and arrays are joined, so that both engines agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geo, stats
from wayfold.operators import behavior, foundation, presentation, spatial, statistics, temporal
from wayfold.operators.density import cluster_figures, density_clusters
from wayfold.plans import serving
from wayfold.plans.oracles import bearing, clusters, entropy, fan, geohash, hav, sql, tile_id, ts
from wayfold.plans.storage import stored
from wayfold.plans.windows import range_join
from wayfold.sources.trace import table, trace_points

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def r(name: str, digits: int = 6, of: Column | None = None) -> Column:
    return F.round(F.col(name) if of is None else of, digits).alias(name)


def i(name: str) -> Column:
    return F.col(name).cast("int").alias(name)


def j(name: str) -> Column:
    return F.array_join(name, ",").alias(name)


def points(spark: SparkSession, folder: str) -> DataFrame:
    return foundation.clean(trace_points(spark, folder))


def user_points(spark: SparkSession, folder: str) -> DataFrame:
    return foundation.clean(trace_points(spark, folder, F.col("user_id")))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    return behavior.transport_segments(points(spark, folder))


def user_segments(spark: SparkSession, folder: str) -> DataFrame:
    return behavior.transport_segments(user_points(spark, folder))


def stays(spark: SparkSession, folder: str) -> DataFrame:
    return behavior.admin_stays(user_points(spark, folder))


def trips(spark: SparkSession, folder: str) -> DataFrame:
    return behavior.trips(segments(spark, folder), gap=1800)


def cells(spark: SparkSession, folder: str) -> DataFrame:
    return spatial.grid_cells(points(spark, folder))


# ---- cleaning


@query(sql("flagged", """SELECT id, CAST(r1 OR r2 OR r3 AS INT) AS outlier, concat_ws(',', CASE WHEN r1 THEN 'EXCESSIVE_SPEED' END, CASE WHEN r2 THEN 'LOW_ACCURACY' END, CASE WHEN r3 THEN 'JUMP' END) AS reasons,
  CASE WHEN r1 OR r2 OR r3 THEN 'FAIL' WHEN accuracy >= 50 AND accuracy <= 100 THEN 'WARNING' ELSE 'PASS' END AS qa_status FROM flagged"""))
def outlier_detection(spark: SparkSession, folder: str) -> DataFrame:
    return foundation.flag_outliers(trace_points(spark, folder)).select("id", i("outlier"), j("reasons"), "qa_status")


@query(sql("flagged", """SELECT CAST(floor(speed / 50) * 50 AS BIGINT) AS band, count(*) AS n, CAST(sum(CASE WHEN r1 OR r2 OR r3 THEN 1 ELSE 0 END) AS BIGINT) AS outliers,
  round(sum(CASE WHEN r1 OR r2 OR r3 THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM flagged GROUP BY 1"""))
def outlier_rate_by_band(spark: SparkSession, folder: str) -> DataFrame:
    marked = foundation.flag_outliers(trace_points(spark, folder)).groupBy((F.floor(F.col("speed") / 50) * 50).alias("band"))
    return marked.agg(F.count("*").alias("n"), F.count_if("outlier").alias("outliers"), F.round(F.count_if("outlier") / F.count("*"), 6).alias("rate"))


@query(sql("clean", """SELECT track_id, id AS after_id, CAST(k AS INT) AS k, CAST(data_time + floor(dt * (k / (c + 1))) AS BIGINT) AS data_time, round(lat + (nlat - lat) * (k / (c + 1)), 8) AS lat, round(lon + (nlon - lon) * (k / (c + 1)), 8) AS lon,
  round(altitude + (nalt - altitude) * (k / (c + 1)), 8) AS altitude, round(speed + (nspeed - speed) * (k / (c + 1)), 8) AS speed FROM (
  SELECT *, unnest(range(1, c + 1)) AS k FROM (SELECT *, least(dt // 60, 30) AS c FROM (SELECT * EXCLUDE (dt, hop), lead(data_time) OVER w - data_time AS dt, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon, lead(altitude) OVER w AS nalt, lead(speed) OVER w AS nspeed
  FROM clean WINDOW w AS (PARTITION BY track_id ORDER BY data_time, id)) WHERE dt > 300 AND dt <= 1800))"""))
def trajectory_completion(spark: SparkSession, folder: str) -> DataFrame:
    return foundation.fill_gaps(points(spark, folder)).select("track_id", "after_id", "k", "data_time", r("lat", 8), r("lon", 8), r("altitude", 8), r("speed", 8))


#: Five wedge-shaped and square areas over the traces' box, for geocoding.
AREAS = [
    ("P1", "A", "a", "t", [(22.0, 113.0), (22.0, 114.5), (23.0, 114.5), (23.0, 113.0)]),
    ("P1", "B", "b", "t", [(23.0, 113.0), (23.0, 114.5), (24.1, 113.0)]),
    ("P2", "C", "c", "t", [(22.0, 114.5), (22.0, 116.1), (23.2, 115.3)]),
    ("P2", "D", "d", "t", [(23.0, 114.5), (24.1, 114.6), (24.1, 116.1), (23.5, 115.2)]),
]


def _areas(spark: SparkSession) -> DataFrame:
    rows = [(*names, [{"lat": a, "lon": b} for a, b in ring]) for *names, ring in AREAS]
    return spark.createDataFrame(rows, "province string, city string, county string, town string, ring array<struct<lat:double,lon:double>>")


def _in_ring(ring: list[tuple[float, float]]) -> str:
    edges = []
    for k, (lat, lon) in enumerate(ring):
        blat, blon = ring[k - 1]
        edges.append(f"CASE WHEN ({lat}E0 > lat) <> ({blat}E0 > lat) AND lon < ({blon - lon!r}E0 * (lat - {lat}E0)) / {blat - lat!r}E0 + {lon}E0 THEN 1 ELSE 0 END" if blat != lat else "0")
    return f"({' + '.join(edges)}) % 2 = 1"


@query(sql("points", "SELECT id, CASE " + " ".join(f"WHEN {_in_ring(a[4])} THEN '{a[0]}'" for a in AREAS) + " END AS province, CASE " + " ".join(f"WHEN {_in_ring(a[4])} THEN '{a[1]}'" for a in AREAS) + " END AS city FROM points"))
def geocode_pip(spark: SparkSession, folder: str) -> DataFrame:
    bare = trace_points(spark, folder).withColumns({p: F.lit(None).cast("string") for p in behavior.PLACES})
    return foundation.reverse_geocode(bare, _areas(spark)).select("id", "province", "city")


# ---- behaviour


@query(sql("seg", "SELECT segment_id, track_id, mode, start_time, end_time, duration_s, point_count, round(distance_m, 3) AS distance_m, round(avg_speed_kmh, 4) AS avg_speed_kmh, round(max_speed_kmh, 4) AS max_speed_kmh, end_id, city FROM seg"))
def transport_segments(spark: SparkSession, folder: str) -> DataFrame:
    return segments(spark, folder).select("segment_id", "track_id", "mode", "start_time", "end_time", "duration_s", "point_count", r("distance_m", 3), r("avg_speed_kmh", 4), r("max_speed_kmh", 4), "end_id", "city")


@query(sql("seg", "SELECT mode, count(*) AS n, round(sum(distance_m), 2) AS distance_m, round(avg(avg_speed_kmh), 4) AS avg_speed_kmh, CAST(sum(duration_s) AS BIGINT) AS duration_s FROM seg GROUP BY mode"))
def mode_summary(spark: SparkSession, folder: str) -> DataFrame:
    return segments(spark, folder).groupBy("mode").agg(F.count("*").alias("n"), r("distance_m", 2, F.sum("distance_m")), r("avg_speed_kmh", 4, F.avg("avg_speed_kmh")), F.sum("duration_s").alias("duration_s"))


@query(sql("clean", f"""SELECT track_id, CAST(min(day) AS VARCHAR) AS start_date, CAST(max(day) AS VARCHAR) AS end_date, count(*) AS days, round(sum(m), 3) AS distance_m, CAST(sum(s) AS BIGINT) AS duration_s, CAST(sum(n) AS BIGINT) AS point_count FROM (
  SELECT *, day - CAST(row_number() OVER (PARTITION BY track_id ORDER BY day) AS INT) AS anchor FROM (
    SELECT track_id, CAST({ts("data_time")} AS DATE) AS day, sum(distance) AS m, count(*) AS n, max(data_time) - min(data_time) AS s FROM clean GROUP BY 1, 2 HAVING sum(distance) >= 1000))
  GROUP BY track_id, anchor HAVING count(*) >= 2""", "user_id"))
def daily_streaks(spark: SparkSession, folder: str) -> DataFrame:
    return behavior.streaks(user_points(spark, folder)).select("track_id", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), "days", r("distance_m", 3), "duration_s", "point_count")


@query(sql("trip", "SELECT trip_id, track_id, CAST(date AS VARCHAR) AS date, trip_number, start_time, end_time, duration_s, round(distance_m, 2) AS distance_m, segment_count, modes, segment_ids, origin_city, dest_city FROM trip"))
def trips_by_gap(spark: SparkSession, folder: str) -> DataFrame:
    t = trips(spark, folder).withColumn("trip_number", F.col("trip_number").cast("long"))
    return t.select("trip_id", "track_id", F.col("date").cast("string").alias("date"), "trip_number", "start_time", "end_time", "duration_s", r("distance_m", 2), "segment_count", j("modes"), j("segment_ids"), "origin_city", "dest_city")


@query(sql("trip stay", """SELECT t.trip_id, (SELECT s.stay_id FROM stay s WHERE s.track_id = t.track_id AND t.start_time - s.end_time >= 0 AND t.start_time - s.end_time < 86400 ORDER BY s.start_time DESC, s.stay_id DESC LIMIT 1) AS origin_stay_id,
  (SELECT s.stay_id FROM stay s WHERE s.track_id = t.track_id AND s.start_time - t.end_time >= 0 AND s.start_time - t.end_time < 86400 ORDER BY s.start_time DESC, s.stay_id DESC LIMIT 1) AS dest_stay_id FROM trip t""", "user_id"))
def trip_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Trips per user with the stays before and after, within a day."""
    return behavior.trips(user_segments(spark, folder), stays(spark, folder), gap=1800, near_s=86_400).select("trip_id", "origin_stay_id", "dest_stay_id")


@query(sql("trip", f"""SELECT trip_id, CASE WHEN NOT we AND same AND km < 20 AND (h BETWEEN 7 AND 9 OR h BETWEEN 17 AND 19) THEN 'COMMUTE' WHEN NOT we AND h BETWEEN 9 AND 17 AND d > 2 THEN 'WORK'
  WHEN (we OR h >= 19 OR h <= 7) AND km < 50 THEN 'LEISURE' WHEN same AND km < 10 AND d < 2 AND h BETWEEN 10 AND 20 THEN 'SHOPPING' WHEN km > 100 OR NOT same THEN 'TRAVEL' ELSE 'OTHER' END AS purpose
  FROM (SELECT trip_id, hour({ts("start_time")}) AS h, dayofweek({ts("start_time")}) IN (0, 6) AS we, distance_m / 1000 AS km, duration_s / 3600 AS d, origin_city IS NOT DISTINCT FROM dest_city AS same FROM trip)"""))
def trip_purpose(spark: SparkSession, folder: str) -> DataFrame:
    return behavior.trip_purpose(trips(spark, folder)).select("trip_id", "purpose")


@query(sql("runs", """SELECT segment_id, start_time, end_time, n AS point_count, round(v, 4) AS avg_speed, round(top, 4) AS max_speed, peak_time, round((CASE WHEN end_time - start_time < 120 THEN 0.8E0 ELSE 1 END) * (CASE WHEN n < 5 THEN 0.7E0 ELSE 1 END) * (CASE WHEN top < 40 THEN 0.9E0 ELSE 1 END), 6) AS confidence FROM (
  SELECT min(sid) AS segment_id, min(data_time) AS start_time, max(data_time) AS end_time, count(*) AS n, avg(speed) AS v, max(speed) AS top, first(data_time ORDER BY speed DESC, data_time, id) AS peak_time FROM (
    SELECT *, sum(CASE WHEN pt IS NULL OR (low > pt AND low - pt > 60) THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, run ORDER BY data_time, id) AS ev FROM (
      SELECT *, lag(data_time) OVER (PARTITION BY track_id, run ORDER BY data_time, id) AS pt FROM (
        SELECT *, last_value(CASE WHEN speed < 12 THEN data_time END IGNORE NULLS) OVER w AS low, first_value(id) OVER w AS sid, max(data_time) OVER (PARTITION BY track_id, run) - min(data_time) OVER (PARTITION BY track_id, run) AS s
        FROM runs WHERE mode = 'CAR' WINDOW w AS (PARTITION BY track_id, run ORDER BY data_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      WHERE s >= 10 AND speed >= 12))
  GROUP BY track_id, run, ev) WHERE end_time - start_time >= 60"""))
def speed_events(spark: SparkSession, folder: str) -> DataFrame:
    """At 12 m/s and gaps of a minute, since these traces are sparse."""
    found = behavior.speed_events(points(spark, folder), min_speed=12.0, gap=60)
    return found.select("segment_id", "start_time", "end_time", "point_count", r("avg_speed", 4), r("max_speed", 4), "peak_time", r("confidence"))


QUERIES["stays_dbscan"] = lambda spark, folder: behavior.density_stays(user_points(spark, folder), max_gap=172_800).select("stay_id", "track_id", "start_time", "end_time", "point_count", r("radius_m", 3))
QUERIES["density_clusters"] = lambda spark, folder: density_clusters(user_points(spark, folder), 500.0, 10).groupBy("track_id", "cluster").agg(F.count("*").alias("points"))
ORACLES["density_clusters"] = sql("clean", "SELECT track_id, cluster, count(*) AS points FROM named GROUP BY track_id, cluster", "user_id", clusters(500, 10))
ORACLES["stays_dbscan"] = sql("clean", f"""SELECT first(c.id ORDER BY c.data_time, c.id) AS stay_id, c.track_id, min(c.data_time) AS start_time, max(c.data_time) AS end_time, count(*) AS point_count,
  round(max({hav("c.lat", "c.lon", "y", "x")}), 3) AS radius_m FROM cut c JOIN (SELECT track_id, cluster, part, avg(lat) AS y, avg(lon) AS x FROM cut GROUP BY track_id, cluster, part) m USING (track_id, cluster, part)
  GROUP BY c.track_id, c.cluster, c.part HAVING max(c.data_time) - min(c.data_time) >= 1800 AND count(*) >= 2""", "user_id", {**clusters(200, 3), "cut": """SELECT *, sum(CASE WHEN g <= 172800 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id, cluster ORDER BY data_time, id) AS part FROM
  (SELECT *, data_time - lag(data_time) OVER (PARTITION BY track_id, cluster ORDER BY data_time, id) AS g FROM named WHERE cluster IS NOT NULL)"""})
QUERIES["simplified_lines"] = lambda spark, folder: temporal.simplified_lines(points(spark, folder)).select("track_id", "chunk", "epsilon", "original_points", "kept_points", r("ratio"))


_CROSS = "((q.lat - p.lat) * (o.lon - p.lon) - (q.lon - p.lon) * (o.lat - p.lat))"
_ALONG = "((q.lat - p.lat) * (o.lat - p.lat) + (q.lon - p.lon) * (o.lon - p.lon))"
_LENGTH = "(pow(q.lat - p.lat, 2) + pow(q.lon - p.lon, 2))"


@query(sql("clean", f"""SELECT c.track_id, c.cluster, round(max(y), 9) AS center_lat, round(max(x), 9) AS center_lon, count(*) AS point_count, count(DISTINCT data_time // 86400) AS visit_count, count(*) * 60 AS duration_s, round(count(*) / 0.25E0, 6) AS density_score,
  CASE WHEN count(*) > 1000 AND count(*) / 60.0E0 / count(DISTINCT data_time // 86400) > 6 THEN 'HOME' WHEN count(*) > 500 AND count(*) / 60.0E0 / count(DISTINCT data_time // 86400) > 4 THEN 'WORK' WHEN count(*) > 200 THEN 'FREQUENT' ELSE 'OCCASIONAL' END AS cluster_type,
  round(max({hav("y", "x", "lat", "lon")}), 3) AS radius_m, round(coalesce(max(area), 0) * 111 * 111, 8) AS convex_hull_area_km2, first(province ORDER BY data_time, id) AS province, first(city ORDER BY data_time, id) AS city, first(county ORDER BY data_time, id) AS county, round(least(1.0E0, count(*) / 50), 6) AS confidence
  FROM named c JOIN (SELECT cluster, avg(lat) AS y, avg(lon) AS x FROM named GROUP BY cluster) m ON m.cluster = c.cluster LEFT JOIN hull ON hull.cluster = c.cluster GROUP BY c.track_id, c.cluster""", "user_id", {**clusters(500, 10),
  "place": "SELECT DISTINCT cluster, lat - 22 AS lat, lon - 113 AS lon FROM named WHERE cluster IS NOT NULL",
  "edge": f"""SELECT p.cluster, p.lat * q.lon - q.lat * p.lon AS twice FROM place p JOIN place q ON p.cluster = q.cluster AND (p.lat, p.lon) <> (q.lat, q.lon) JOIN place o ON o.cluster = p.cluster
  GROUP BY p.cluster, p.lat, p.lon, q.lat, q.lon HAVING bool_and({_CROSS} > 1E-10 OR (abs({_CROSS}) <= 1E-10 AND {_ALONG} >= -1E-10 AND {_ALONG} <= {_LENGTH} + 1E-10))""",
  "hull": "SELECT cluster, sum(twice) / 2 AS area FROM edge GROUP BY cluster"}))
def density_cluster_figures(spark: SparkSession, folder: str) -> DataFrame:
    found = cluster_figures(density_clusters(user_points(spark, folder), 500.0, 10), 500.0)
    kept = ["track_id", "cluster", "point_count", "visit_count", "duration_s", "cluster_type", "province", "city", "county"]
    return found.select(*kept, r("center_lat", 9), r("center_lon", 9), r("density_score"), r("radius_m", 3), r("convex_hull_area_km2", 8), r("confidence"))


@query(ORACLES["density_cluster_figures"] + " ORDER BY 11 DESC, 1, 2 LIMIT 100")
def widest_density_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """The view's first page: clusters by the area that they cover."""
    return serving.serve(density_cluster_figures(spark, folder), serving.VIEWS["density_clusters"])


# ---- space


@query(sql("cell", "SELECT grid_id, level, x, y, point_count, days, first_visit, last_visit, duration_s FROM cell"))
def grid_cells(spark: SparkSession, folder: str) -> DataFrame:
    return cells(spark, folder).select("grid_id", i("level"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "point_count", "days", "first_visit", "last_visit", "duration_s")


@query(sql("clean", f"SELECT CAST(p - 3 AS INT) AS level, substr(h, 1, CAST(p AS BIGINT)) AS geohash, count(*) AS point_count, count(DISTINCT day) AS visit_count FROM (SELECT {geohash('lat', 'lon', 8)} AS h, CAST({ts('data_time')} AS DATE) AS day FROM clean), range(4, 9) t(p) GROUP BY 1, 2"))
def geohash_cells(spark: SparkSession, folder: str) -> DataFrame:
    return spatial.geohash_cells(points(spark, folder))


@query(sql("cell", "SELECT grid_id, round(CASE WHEN max(point_count) OVER () > min(point_count) OVER () THEN (point_count - min(point_count) OVER ()) / (max(point_count) OVER () - min(point_count) OVER ()) ELSE 1 END, 6) AS intensity FROM cell WHERE level = 10"))
def heatmap_normalised(spark: SparkSession, folder: str) -> DataFrame:
    return presentation.heatmap(cells(spark, folder).where("level = 10")).select("grid_id", r("intensity"))


@query(sql("cell", """SELECT grid_id, round(s, 6) AS score, CASE WHEN s + 1e-12 >= p1 THEN 'core' WHEN s + 1e-12 >= p3 THEN 'secondary' WHEN s + 1e-12 >= p7 THEN 'active' WHEN s + 1e-12 >= p9 THEN 'peripheral' ELSE 'rare' END AS density_level FROM scored,
  (SELECT max(s) FILTER (k = n // 10) AS p1, max(s) FILTER (k = n * 3 // 10) AS p3, max(s) FILTER (k = n * 7 // 10) AS p7, max(s) FILTER (k = n * 9 // 10) AS p9 FROM (SELECT s, row_number() OVER (ORDER BY s DESC) - 1 AS k, count(*) OVER () AS n FROM scored))""",
  more={"scored": "SELECT grid_id, 0.5 * ln(1 + duration_s / 3600) + 0.3 * ln(1 + days) + 0.2 * ln(1 + visit_count) AS s FROM cell WHERE level = 12"}))
def density_levels(spark: SparkSession, folder: str) -> DataFrame:
    return spatial.density_levels(cells(spark, folder), 12).select("grid_id", r("score"), "density_level")


@query(ORACLES["density_levels"].replace(" FROM cell WHERE level = 12", " FROM cell"))
def density_levels_all(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of all levels, rated together; density_levels rates level 12 alone."""
    return spatial.density_levels(cells(spark, folder)).select("grid_id", r("score"), "density_level")


_SPEED = {
    "wide": fan("(SELECT * FROM seg WHERE distance_m > 0)", "province city county", "all year month", "start_time"),
    "bins": "SELECT area_type, area_key, bucket_type, bucket_key, floor(avg_speed_kmh / 10) AS b, sum(distance_m) AS d, sum(avg_speed_kmh * distance_m) AS vd, count(*) AS n FROM wide GROUP BY ALL",
    "spd": f"SELECT area_type, area_key, bucket_type, bucket_key, round(sum(d), 2) AS total_distance, CAST(sum(n) AS BIGINT) AS segment_count, sum(vd) / sum(d) AS v, {entropy('d')} AS h FROM bins GROUP BY ALL",
    "lim": "SELECT quantile_cont(avg_speed_kmh, 0.9) AS hi, quantile_cont(avg_speed_kmh, 0.25) AS lo FROM seg WHERE distance_m > 0",
}
#: Areas of these traces are all alike; limits nearer to the middle let some stand out.
_ZONES = {**_SPEED, "lim": "SELECT quantile_cont(avg_speed_kmh, 0.5) AS hi, quantile_cont(avg_speed_kmh, 0.6) AS lo FROM seg WHERE distance_m > 0"}


@query(sql("seg", "SELECT area_type, area_key, bucket_type, bucket_key, total_distance, segment_count, round(v, 4) AS avg_speed, round(h, 5) AS speed_entropy, CAST(v > hi AS INT) AS is_high_speed, CAST(v < lo AS INT) AS is_slow_life FROM spd, lim", more=_SPEED))
def speed_space(spark: SparkSession, folder: str) -> DataFrame:
    return spatial.speed_space(segments(spark, folder)).select("area_type", "area_key", "bucket_type", "bucket_key", r("total_distance", 2), "segment_count", r("avg_speed", 4), r("speed_entropy", 5), i("is_high_speed"), i("is_slow_life"))


@query(sql("seg", "SELECT area_key, round(v, 4) AS avg_speed FROM spd, lim WHERE v > hi AND bucket_type = 'all' AND area_type = 'CITY' ORDER BY v DESC, area_key LIMIT 10", more=_ZONES))
def high_speed_zones(spark: SparkSession, folder: str) -> DataFrame:
    return serving.serve(spatial.speed_space(segments(spark, folder), fast=0.5, slow=0.6), serving.VIEWS["high_speed_zones"], area_type="CITY").select("area_key", r("avg_speed", 4))


@query(sql("seg", "SELECT area_key, round(v, 4) AS avg_speed FROM spd, lim WHERE v < lo AND bucket_type = 'month' ORDER BY v, area_type, area_key, bucket_key LIMIT 10", more=_ZONES))
def slow_life_zones(spark: SparkSession, folder: str) -> DataFrame:
    return serving.serve(spatial.speed_space(segments(spark, folder), fast=0.5, slow=0.6), serving.VIEWS["slow_life_zones"], bucket_type="month").select("area_key", r("avg_speed", 4))


_D = {
    "far": f"SELECT *, CAST(floor(({bearing('start_lat', 'start_lon', 'end_lat', 'end_lon')} + 22.5E0) / 45) AS INT) % 8 AS b FROM seg WHERE distance_m > 10",
    "wide": fan("far", "province city county", "all year month", "start_time"),
    "modes": "SELECT *, mode AS m FROM wide UNION ALL SELECT *, 'ALL' FROM wide",
    "per": "SELECT area_type, area_key, bucket_type, bucket_key, m, b, sum(distance_m) AS d, count(*) AS n FROM modes GROUP BY ALL",
    "tot": "SELECT area_type, area_key, bucket_type, bucket_key, m, sum(d) AS total, CAST(sum(n) AS BIGINT) AS segment_count, first(b ORDER BY d DESC, b) AS top, sum(d * cos(radians(b * 45 + 22.5))) AS x, sum(d * sin(radians(b * 45 + 22.5))) AS y, "
    f"{entropy('d')} / 3 AS h, " + " + ".join(f"least(sum(CASE WHEN b = {k} THEN d ELSE 0 END), sum(CASE WHEN b = {k + 4} THEN d ELSE 0 END))" for k in range(4)) + " AS two FROM per GROUP BY ALL",
}


@query(sql("seg", "SELECT area_type, area_key, bucket_type, bucket_key, m AS mode, round(total, 2) AS total_distance, segment_count, top * 45 + 22.5E0 AS dominant_direction, round(sqrt(x * x + y * y) / total, 5) AS concentration, round(two / total, 5) AS bidirectional_score, round(h, 5) AS directional_entropy FROM tot", more=_D))
def directional_bias(spark: SparkSession, folder: str) -> DataFrame:
    out = spatial.directional_bias(segments(spark, folder))
    return out.select("area_type", "area_key", "bucket_type", "bucket_key", "mode", r("total_distance", 2), "segment_count", "dominant_direction", r("concentration", 5), r("bidirectional_score", 5), r("directional_entropy", 5))


_REVISIT = {"g": "SELECT *, (start_time - lag(start_time) OVER (PARTITION BY geohash6 ORDER BY start_time, stay_id)) / 86400.0E0 AS dd FROM stay",
    "rv": "SELECT geohash6, count(*) AS visit_count, min(start_time) AS first_visit, max(end_time) AS last_visit, CAST(sum(duration_s) AS BIGINT) AS total_duration, avg(dd) AS m, coalesce(stddev_samp(dd), 0) AS s FROM g GROUP BY geohash6 HAVING count(*) >= 2",
    "rr": "SELECT *, CASE WHEN m > 0 THEN 1 / (1 + s / m) ELSE 0 END AS reg, ln(1 + visit_count) * ln(1 + total_duration) AS strength FROM rv"}


@query(sql("stay", "SELECT geohash6, visit_count, first_visit, last_visit, total_duration, round(m, 5) AS avg_interval_days, round(s, 5) AS std_interval_days, round(reg, 5) AS regularity, CAST(reg > 0.8 AND visit_count >= 3 AS INT) AS is_periodic, CAST(reg > 0.7 AND visit_count >= 5 AS INT) AS is_habitual, round(strength, 5) AS strength FROM rr", "user_id", _REVISIT))
def revisit_patterns(spark: SparkSession, folder: str) -> DataFrame:
    out = spatial.revisit_patterns(stays(spark, folder))
    return out.select("geohash6", "visit_count", "first_visit", "last_visit", "total_duration", r("avg_interval_days", 5), r("std_interval_days", 5), r("regularity", 5), i("is_periodic"), i("is_habitual"), r("strength", 5))


@query(sql("stay", "SELECT geohash6, visit_count, round(strength, 5) AS strength FROM rr ORDER BY rr.strength DESC, geohash6 LIMIT 100", "user_id", _REVISIT))
def top_places(spark: SparkSession, folder: str) -> DataFrame:
    return serving.serve(spatial.revisit_patterns(stays(spark, folder)), serving.VIEWS["revisit_patterns"]).select("geohash6", "visit_count", r("strength", 5))


_USE = {
    "known": " UNION ".join(f"SELECT '{a.upper()}' AS area_type, {a} AS area_key FROM clean WHERE {a} <> ''" for a in ("province", "city", "county", "town")),
    "tr": "SELECT area_type, area_key, count(*) AS t FROM (" + " UNION ALL ".join(f"SELECT '{a.upper()}' AS area_type, {a} AS area_key FROM seg" for a in ("province", "city", "county", "town")) + ") GROUP BY ALL",
    "st": "SELECT area_type, area_key, sum(duration_s) AS s, count(DISTINCT day) AS days, count(DISTINCT geohash6) AS grids FROM (" + " UNION ALL ".join(f"SELECT '{a.upper()}' AS area_type, {a} AS area_key, duration_s, geohash6, CAST({ts('start_time')} AS DATE) AS day FROM stay" for a in ("province", "city", "county", "town")) + ") GROUP BY ALL",
    "us": "SELECT area_type, area_key, coalesce(t, 0) AS t, CAST(coalesce(s, 0) AS BIGINT) AS s, coalesce(days, 0) AS days, coalesce(grids, 0) AS grids FROM known LEFT JOIN tr USING (area_type, area_key) LEFT JOIN st USING (area_type, area_key)",
    "ut": "SELECT *, s / (t + 1.0E0) AS eff, t / (t + s / 3600.0E0 + 1.0E0) AS dom, ln(1 + s) * ln(1 + days) AS depth FROM us",
}


def _utilization(spark: SparkSession, folder: str) -> DataFrame:
    p = stored(user_points(spark, folder), "points")
    return spatial.utilization(p, behavior.transport_segments(p), behavior.admin_stays(p))


@query(sql("seg stay", "SELECT area_type, area_key, t AS transit_intensity, s AS stay_duration_s, days AS distinct_visit_days, grids AS distinct_grids, round(eff, 4) AS utilization_efficiency, round(dom, 6) AS transit_dominance, round(depth, 4) AS area_depth FROM ut", "user_id", _USE))
def utilization(spark: SparkSession, folder: str) -> DataFrame:
    return _utilization(spark, folder).select("area_type", "area_key", "transit_intensity", "stay_duration_s", "distinct_visit_days", "distinct_grids", r("utilization_efficiency", 4), r("transit_dominance"), r("area_depth", 4))


@query(sql("seg stay", "SELECT area_type, area_key, round(eff, 4) AS utilization_efficiency FROM ut WHERE eff > 10 AND dom < 0.3 ORDER BY eff DESC, area_type, area_key LIMIT 100", "user_id", _USE))
def destination_areas(spark: SparkSession, folder: str) -> DataFrame:
    return serving.serve(_utilization(spark, folder), serving.VIEWS["destinations"]).select("area_type", "area_key", r("utilization_efficiency", 4))


@query(sql("clean", """SELECT track_id, k AS event_type, start_time, end_time, round(a1 - a0, 4) AS altitude_change, round(d, 3) AS distance_m FROM (
  SELECT track_id, k, first(pt ORDER BY data_time, id) AS start_time, max(data_time) AS end_time, first(pa ORDER BY data_time, id) AS a0, last(altitude ORDER BY data_time, id) AS a1,
    sum(distance) - CASE WHEN coalesce(first(pk ORDER BY data_time, id), 'FLAT') = 'FLAT' THEN first(distance ORDER BY data_time, id) ELSE 0 END AS d FROM (
    SELECT *, sum(CASE WHEN pk = k THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY data_time, id) AS run FROM (
      SELECT *, lag(k) OVER (PARTITION BY track_id ORDER BY data_time, id) AS pk FROM (
        SELECT *, CASE WHEN altitude - pa > 10 THEN 'CLIMB' WHEN altitude - pa < -10 THEN 'DESCENT' ELSE 'FLAT' END AS k FROM (
          SELECT *, lag(altitude) OVER w AS pa, lag(data_time) OVER w AS pt FROM clean WHERE altitude > -500 AND altitude < 9000 WINDOW w AS (PARTITION BY track_id ORDER BY data_time, id)))))
  WHERE k <> 'FLAT' GROUP BY track_id, run, k) WHERE abs(a1 - a0) >= 50 AND end_time - start_time >= 300"""))
def altitude_events(spark: SparkSession, folder: str) -> DataFrame:
    return spatial.altitude_events(points(spark, folder)).select("track_id", "event_type", "start_time", "end_time", r("altitude_change", 4), r("distance_m", 3))


@query(sql("clean", """SELECT area_type, area_key, count(*) AS point_count, round(min(altitude), 4) AS min_altitude, round(max(altitude) - min(altitude), 4) AS altitude_span, round(quantile_cont(altitude, 0.5), 4) AS p50, round(quantile_cont(altitude, 0.9), 4) AS p90,
  round(coalesce(sum(greatest(dd, 0)), 0), 2) AS total_ascent, round(coalesce(sum(greatest(-dd, 0)), 0), 2) AS total_descent FROM (
  SELECT *, altitude - lag(altitude) OVER (PARTITION BY track_id, area_type, area_key ORDER BY data_time, id) AS dd FROM w) GROUP BY ALL""",
  more={"w": "SELECT *, 'ALL' AS area_type, 'ALL' AS area_key FROM clean WHERE altitude > 0 UNION ALL SELECT *, 'PROVINCE', province FROM clean WHERE altitude > 0 UNION ALL SELECT *, 'CITY', city FROM clean WHERE altitude > 0"}))
def altitude_stats(spark: SparkSession, folder: str) -> DataFrame:
    return spatial.altitude_stats(points(spark, folder)).select("area_type", "area_key", "point_count", r("min_altitude", 4), r("altitude_span", 4), r("p50", 4), r("p90", 4), r("total_ascent", 2), r("total_descent", 2))


@query(sql("clean cell", f"""SELECT c AS direction_changes, round(t / c, 5) AS avg_turn_angle, round(line / d, 8) AS path_efficiency, round(e, 5) AS spatial_entropy FROM
  (SELECT CAST(sum(c) AS BIGINT) AS c, sum(t) AS t, sum(d) AS d, sum({hav("a1", "o1", "a2", "o2")}) AS line FROM (
    SELECT track_id, sum(CASE WHEN turn > 15 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN turn > 15 THEN turn ELSE 0 END) AS t, sum(distance) AS d, first(lat ORDER BY data_time, id) AS a1, first(lon ORDER BY data_time, id) AS o1, last(lat ORDER BY data_time, id) AS a2, last(lon ORDER BY data_time, id) AS o2 FROM (
      SELECT *, CASE WHEN h > 180 THEN 360 - h ELSE h END AS turn FROM (SELECT *, abs(heading - lag(heading) OVER (PARTITION BY track_id ORDER BY data_time, id)) AS h FROM clean)) GROUP BY track_id)),
  (SELECT {entropy("visit_count")} AS e FROM cell)"""))
def spatial_complexity(spark: SparkSession, folder: str) -> DataFrame:
    return spatial.spatial_complexity(points(spark, folder), cells(spark, folder)).select("direction_changes", r("avg_turn_angle", 5), r("path_efficiency", 8), r("spatial_entropy", 5))


@query(sql("seg", """SELECT coalesce(road_type, 'ALL') AS road_type, count(*) AS segments, round(sum(distance_m * q), 2) AS on_road_m, round(avg(q), 5) AS avg_overlap_ratio FROM (
  SELECT distance_m, CASE mode WHEN 'CAR' THEN 1.0E0 WHEN 'BIKE' THEN 0.9E0 WHEN 'WALK' THEN CASE WHEN avg_speed_kmh > 3 THEN 0.8E0 ELSE 0.5E0 END ELSE 0.7E0 END AS q,
    CASE WHEN mode = 'CAR' THEN CASE WHEN max_speed_kmh >= 27.8 THEN 'HIGHWAY' WHEN avg_speed_kmh >= 13.9 THEN 'ARTERIAL' ELSE 'LOCAL' END WHEN mode IN ('BIKE', 'WALK') THEN 'LOCAL' ELSE 'UNKNOWN' END AS road_type FROM seg)
  GROUP BY GROUPING SETS ((road_type), ())"""))
def road_overlap_summary(spark: SparkSession, folder: str) -> DataFrame:
    return serving.road_overlap_summary(spatial.road_overlap(segments(spark, folder))).select("road_type", "segments", r("on_road_m", 2), r("avg_overlap_ratio", 5))


# ---- rollups


_FOOT = {"g": f"SELECT *, {tile_id('lat', 'lon', 15)} AS grid FROM clean", "wide": fan("g", "province city county town grid", "year month day all"),
    "fp": f"SELECT area_type, area_key, bucket_type, bucket_key, count(*) AS point_count, count(DISTINCT CAST({ts('data_time')} AS DATE)) AS visit_days, min(data_time) AS first_visit, max(data_time) AS last_visit, sum(distance) AS td, max(data_time) - min(data_time) AS duration_s FROM wide GROUP BY ALL"}


@query(sql("clean", "SELECT area_type, area_key, bucket_type, bucket_key, point_count, visit_days, first_visit, last_visit, round(td, 3) AS total_distance, duration_s FROM fp", more=_FOOT))
def footprint_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.footprint(points(spark, folder)).select(*statistics.GROUP, "point_count", "visit_days", "first_visit", "last_visit", r("total_distance", 3), "duration_s")


@query(sql("clean", "SELECT area_key, point_count, rank() OVER (ORDER BY point_count DESC) AS place FROM (SELECT * FROM fp WHERE area_type = 'CITY' AND bucket_type = 'all') ORDER BY point_count DESC, area_key LIMIT 10", more=_FOOT))
def footprint_rankings(spark: SparkSession, folder: str) -> DataFrame:
    top = serving.serve(statistics.footprint(points(spark, folder)), serving.VIEWS["footprint"], "points", 10, stat_type="CITY")
    return top.select("area_key", "point_count", F.rank().over(Window.orderBy(F.desc("point_count"))).cast("long").alias("place"))  # ten rows


@query(sql("clean", """SELECT count(*) AS points, string_agg(DISTINCT province, ',' ORDER BY province) AS province_list, string_agg(DISTINCT city, ',' ORDER BY city) AS city_list, count(DISTINCT town) AS towns, count(DISTINCT county) AS counties FROM clean"""))
def footprint_summary(spark: SparkSession, folder: str) -> DataFrame:
    return serving.footprint_summary(points(spark, folder)).select("points", j("province_list"), j("city_list"), "towns", F.col("counties").cast("long").alias("counties"))


_STAYS = {"a": "SELECT *, stay_type AS activity_type FROM stay", "wide": fan("a", "province city county town activity_type", "year month day all", "start_time")}


@query(sql("stay", f"SELECT area_type, area_key, bucket_type, bucket_key, count(*) AS stay_count, CAST(sum(duration_s) AS BIGINT) AS total_duration, round(avg(duration_s), 4) AS avg_duration, max(duration_s) AS max_duration, count(DISTINCT CAST({ts('start_time')} AS DATE)) AS visit_days FROM wide GROUP BY ALL", "user_id", _STAYS))
def stay_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.stay_statistics(stays(spark, folder)).select(*statistics.GROUP, "stay_count", "total_duration", r("avg_duration", 4), "max_duration", "visit_days")


@query(sql("stay", "SELECT stay_id, track_id, town, start_time, end_time, duration_s, point_count, round(radius_m, 3) AS radius_m, geohash6 FROM stay", "user_id"))
def town_stays(spark: SparkSession, folder: str) -> DataFrame:
    return stays(spark, folder).select("stay_id", "track_id", "town", "start_time", "end_time", "duration_s", "point_count", r("radius_m", 3), "geohash6")


_VIEW = " UNION ALL ".join(f"SELECT '{c.upper()}' AS level, {c} AS name, {p} AS parent, data_time, distance FROM clean WHERE {c} <> ''" for c, p in (("province", "''"), ("city", "province"), ("county", "city"), ("town", "county")))


@query(sql("clean", f"SELECT level, name, parent, count(*) AS visit_count, round(sum(distance), 3) AS total_distance, count(DISTINCT CAST({ts('data_time')} AS DATE)) AS unique_days, min(data_time) AS first_visit, max(data_time) AS last_visit, count(*) * 10 AS duration_s FROM v GROUP BY ALL", more={"v": _VIEW}))
def admin_view(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.admin_view(points(spark, folder)).select("level", "name", "parent", "visit_count", r("total_distance", 3), "unique_days", "first_visit", "last_visit", "duration_s")


_CROSS = {"c": f"""SELECT *, CASE WHEN p0 IS NULL THEN NULL WHEN province <> p0 AND province <> '' THEN 'PROVINCE' WHEN province = p0 AND city <> p1 AND city <> '' THEN 'CITY' WHEN province = p0 AND city = p1 AND county <> p2 AND county <> '' THEN 'COUNTY'
  WHEN province = p0 AND city = p1 AND county = p2 AND town <> p3 AND town <> '' THEN 'TOWN' END AS k FROM (SELECT *, lag(province) OVER w AS p0, lag(city) OVER w AS p1, lag(county) OVER w AS p2, lag(town) OVER w AS p3, {hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} AS m FROM clean WINDOW w AS (PARTITION BY track_id ORDER BY data_time, id))"""}


@query(sql("clean", "SELECT id AS crossing_id, data_time AS crossing_time, k AS crossing_type, p0 AS from_province, city AS to_city, round(m, 3) AS distance_m FROM c WHERE k IS NOT NULL", more=_CROSS))
def admin_crossings(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.admin_crossings(points(spark, folder)).select("crossing_id", "crossing_time", "crossing_type", "from_province", "to_city", r("distance_m", 3))


@query(sql("clean", "SELECT id AS crossing_id, k AS crossing_type FROM c WHERE k IS NOT NULL AND 'ASIA' IN (p0, p1, p2, p3) ORDER BY data_time DESC, id DESC LIMIT 50", more=_CROSS))
def crossings_by_region(spark: SparkSession, folder: str) -> DataFrame:
    return serving.serve(statistics.admin_crossings(points(spark, folder)), serving.VIEWS["admin_crossings"], limit=50, from_region="ASIA").select("crossing_id", "crossing_type")


@query(sql("clean trip", """SELECT trip_id, event_type, id, round(v, 5) AS value FROM (SELECT trip_id, event_type, v, id, row_number() OVER (PARTITION BY trip_id, event_type ORDER BY data_time, id) AS k FROM ev) WHERE k = 1""",
  more={"ins": "SELECT t.trip_id, c.* FROM clean c JOIN trip t ON c.track_id = t.track_id AND c.data_time BETWEEN t.start_time AND t.end_time",
    "lm": "SELECT trip_id, quantile_cont(CASE WHEN altitude <> 0 THEN altitude END, 0.99) AS a, quantile_cont(lon, 0.99) AS x9, quantile_cont(lon, 0.01) AS x1, quantile_cont(lat, 0.99) AS y9, quantile_cont(lat, 0.01) AS y1 FROM ins GROUP BY trip_id",
    "ev": "SELECT i.trip_id, id, data_time, altitude AS v, 'MAX_ALTITUDE' AS event_type FROM ins i JOIN lm USING (trip_id) WHERE altitude <> 0 AND altitude >= a UNION ALL SELECT i.trip_id, id, data_time, lon, 'EASTMOST' FROM ins i JOIN lm USING (trip_id) WHERE lon >= x9 UNION ALL SELECT i.trip_id, id, data_time, lon, 'WESTMOST' FROM ins i JOIN lm USING (trip_id) WHERE lon <= x1 UNION ALL SELECT i.trip_id, id, data_time, lat, 'NORTHMOST' FROM ins i JOIN lm USING (trip_id) WHERE lat >= y9 UNION ALL SELECT i.trip_id, id, data_time, lat, 'SOUTHMOST' FROM ins i JOIN lm USING (trip_id) WHERE lat <= y1"}))
def extreme_events(spark: SparkSession, folder: str) -> DataFrame:
    p = stored(points(spark, folder), "points")
    return statistics.extreme_events(p, behavior.trips(behavior.transport_segments(p), gap=1800)).select("trip_id", "event_type", "id", r("value", 5))


@query(sql("clean", f"""SELECT region, months, CAST(total AS BIGINT) AS total, CASE WHEN months < 3 OR abs(slope) < 0.1 THEN 'STABLE' WHEN slope > 0 THEN 'GROWTH' ELSE 'DECLINE' END AS trend_type FROM (
  SELECT region, count(*) AS months, sum(n) AS total, coalesce(regr_slope(n, x), 0) AS slope FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY m) - 1 AS x FROM (SELECT city AS region, strftime({ts("data_time")}, '%Y-%m') AS m, count(*) AS n FROM clean GROUP BY 1, 2)) GROUP BY region)"""))
def admin_trends(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.admin_trends(points(spark, folder)).select("region", "months", "total", "trend_type")


@query(sql("seg", """SELECT round(d / 1000 / (s / 3600), 4) AS movement_intensity, CAST(bc AS BIGINT) AS burst_count, CAST(bd AS BIGINT) AS burst_duration, CAST(act AS BIGINT) AS active_time, round(act / s, 6) AS activity_ratio, n AS trip_count, days AS distinct_days, round(d / 1000 / (s / 3600) * (act / s) * ln(1 + days), 3) AS time_compression_index FROM (
  SELECT count(*) AS n, sum(distance_m) AS d, sum(duration_s) AS s, sum(CASE WHEN avg_speed_kmh > 5 THEN duration_s ELSE 0 END) AS act, sum(CASE WHEN f AND NOT coalesce(pf, FALSE) THEN 1 ELSE 0 END) AS bc, sum(CASE WHEN f THEN duration_s ELSE 0 END) AS bd, count(DISTINCT start_time // 86400) AS days FROM (
    SELECT *, lag(f) OVER (PARTITION BY track_id ORDER BY start_time, segment_id) AS pf FROM (SELECT *, avg_speed_kmh > 50 AS f FROM seg WHERE duration_s > 0 AND distance_m > 0)))"""))
def movement_intensity(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.movement_intensity(segments(spark, folder)).select(r("movement_intensity", 4), "burst_count", "burst_duration", "active_time", r("activity_ratio"), "trip_count", "distinct_days", r("time_compression_index", 3))


# ---- time and presentation


@query(sql("clean", "SELECT slice_type, slice_key, count(*) AS point_count, round(sum(distance), 3) AS total_distance, count(DISTINCT grid) AS unique_grids, count(*) * 10 AS duration_s FROM w GROUP BY ALL", more={
    "g": f"SELECT *, {tile_id('lat', 'lon', 15)} AS grid, {ts('data_time')} AS t FROM clean",
    "w": "SELECT 'HOURLY' AS slice_type, strftime(t, '%H') AS slice_key, distance, grid FROM g UNION ALL SELECT 'DAILY', strftime(t, '%Y-%m-%d'), distance, grid FROM g UNION ALL SELECT 'WEEKLY_HOURLY', strftime(t, '%w-%H'), distance, grid FROM g"}))
def time_slices(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.time_slices(points(spark, folder)).select("slice_type", "slice_key", "point_count", r("total_distance", 3), "unique_grids", "duration_s")


@query(sql("clean", f"SELECT CAST(hour({ts('data_time')}) AS INT) AS hour, count(*) AS points FROM clean GROUP BY 1"))
def time_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return serving.time_distribution(points(spark, folder))


@query(sql("clean", "SELECT CASE WHEN speed < 10 THEN '0-10' WHEN speed < 30 THEN '10-30' WHEN speed < 60 THEN '30-60' WHEN speed < 120 THEN '60-120' ELSE '120+' END AS speed_range, count(*) AS points FROM clean WHERE speed > 0 GROUP BY 1"))
def speed_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return serving.speed_distribution(points(spark, folder)).select("speed_range", "points")


@query(sql("seg", f"SELECT strftime({ts('start_time')}, '%Y-%m-%d') AS slice_key, count(*) AS segment_count, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes, min(start_time) AS first_time, max(end_time) AS last_time FROM seg GROUP BY 1"))
def time_slice_granularity(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.mode_slices(segments(spark, folder)).select("slice_key", "segment_count", j("modes"), "first_time", "last_time")


@query(sql("seg", """SELECT s.segment_id, CAST(lod AS INT) AS lod_level, CASE WHEN v >= q5 THEN 5 WHEN v >= q4 THEN 4 WHEN v >= q3 THEN 3 WHEN v >= q2 THEN 2 WHEN v >= q1 THEN 1 ELSE 0 END AS speed_bucket, round(rk, 6) AS overlap_rank, round(1 + 2 * rk, 6) AS line_weight FROM seg s JOIN per USING (track_id, run) JOIN cellrank USING (grid), lim, range(1, 4) t(lod)""",
  more={"p": f"SELECT *, {tile_id('lat', 'lon', 15)} AS grid FROM runs", "lim": "SELECT " + ", ".join(f"quantile_cont(speed, {k / 5}) AS q{k}" for k in range(1, 6)) + " FROM runs WHERE speed > 0",
    "cellrank": "SELECT grid, (rank() OVER (ORDER BY n) - 1) / count(*) OVER () AS rk FROM (SELECT grid, count(*) AS n FROM p GROUP BY grid)",
    "per": "SELECT track_id, run, sum(s) / sum(c) AS v, first(grid ORDER BY c DESC, grid) AS grid FROM (SELECT track_id, run, grid, count(*) AS c, sum(speed) AS s FROM p WHERE speed > 0 GROUP BY ALL) GROUP BY ALL"}))
def render_metadata(spark: SparkSession, folder: str) -> DataFrame:
    p = stored(points(spark, folder), "points")
    return presentation.rendering_metadata(p, behavior.transport_segments(p)).select("segment_id", "lod_level", "speed_bucket", r("overlap_rank"), r("line_weight"))


_EVENTS = {
    "fast": """SELECT * FROM (SELECT min(sid) AS segment_id, first(lat ORDER BY speed DESC, data_time, id) AS lat, first(lon ORDER BY speed DESC, data_time, id) AS lon, max(speed) AS top, min(data_time) AS t0, max(data_time) AS t1, first(data_time ORDER BY speed DESC, data_time, id) AS peak_time FROM (
    SELECT *, sum(CASE WHEN pt IS NULL OR (low > pt AND low - pt > 10) THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, run ORDER BY data_time, id) AS ev FROM (
      SELECT *, lag(data_time) OVER (PARTITION BY track_id, run ORDER BY data_time, id) AS pt FROM (
        SELECT *, last_value(CASE WHEN speed < 33.33 THEN data_time END IGNORE NULLS) OVER w AS low, first_value(id) OVER w AS sid, max(data_time) OVER (PARTITION BY track_id, run) - min(data_time) OVER (PARTITION BY track_id, run) AS s
        FROM runs WHERE mode = 'CAR' WINDOW w AS (PARTITION BY track_id, run ORDER BY data_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      WHERE s >= 10 AND speed >= 33.33))
  GROUP BY track_id, run, ev) WHERE t1 - t0 >= 60""",
    "steep": """SELECT track_id, k, t0, a1 - a0 AS change, lat, lon FROM (
  SELECT track_id, k, first(pt ORDER BY data_time, id) AS t0, first(plat ORDER BY data_time, id) AS lat, first(plon ORDER BY data_time, id) AS lon, max(data_time) AS t1, first(pa ORDER BY data_time, id) AS a0, last(altitude ORDER BY data_time, id) AS a1 FROM (
    SELECT *, sum(CASE WHEN pk = k THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY data_time, id) AS run FROM (
      SELECT *, lag(k) OVER (PARTITION BY track_id ORDER BY data_time, id) AS pk FROM (
        SELECT *, CASE WHEN altitude - pa > 10 THEN 'CLIMB' WHEN altitude - pa < -10 THEN 'DESCENT' ELSE 'FLAT' END AS k FROM (
          SELECT *, lag(altitude) OVER w AS pa, lag(data_time) OVER w AS pt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM clean WHERE altitude > -500 AND altitude < 9000 WINDOW w AS (PARTITION BY track_id ORDER BY data_time, id)))))
  WHERE k <> 'FLAT' GROUP BY track_id, run, k) WHERE abs(a1 - a0) >= 100 AND t1 - t0 >= 300""",
}


def _markers(limited: bool) -> str:
    """Markers of all kinds, the earliest of each as a viewer limits them, or all."""

    def cut(table: str, order: str, most: int) -> str:
        return f"(SELECT * FROM {table}" + (f" ORDER BY {order} LIMIT {most})" if limited else ")")

    def pick(values: dict[str, str], other: str) -> str:
        return "CASE mode " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE '{other}' END"

    look = f"{pick(presentation.MODE_ICONS, presentation.OTHER_ICON)} AS icon, {pick(presentation.MODE_COLOURS, presentation.OTHER_COLOUR)} AS color"
    seg, stay = cut("seg", "start_time, segment_id", 1000), cut("stay", "start_time, stay_id", 500)
    return f"""SELECT marker_time, marker_type, entity_id, entity_type, round(lat, 6) AS lat, round(lon, 6) AS lon, label, icon, color FROM (
  SELECT start_time AS marker_time, 'SEGMENT_START' AS marker_type, segment_id AS entity_id, 'SEGMENT' AS entity_type, start_lat AS lat, start_lon AS lon, mode || ' Start' AS label, {look} FROM {seg} UNION ALL
  SELECT end_time, 'SEGMENT_END', segment_id, 'SEGMENT', end_lat, end_lon, mode || ' End', {look} FROM {seg} UNION ALL
  SELECT start_time, 'STAY', stay_id, 'STAY', center_lat, center_lon, 'Stay (' || duration_s // 3600 || 'h)', 'pin', '{presentation.STAY_COLOUR}' FROM {stay} UNION ALL
  SELECT peak_time, 'EVENT', segment_id, 'SPEED_EVENT', lat, lon, 'Speed ' || CAST(round(top * 3.6) AS BIGINT) || ' km/h', 'flash', '{presentation.SPEED_COLOUR}' FROM {cut("fast", "peak_time, segment_id", 200)} UNION ALL
  SELECT t0, 'EVENT', track_id, 'ALTITUDE_EVENT', lat, lon, k || ' ' || CAST(round(change) AS BIGINT) || 'm', CASE k WHEN 'DESCENT' THEN 'arrow-down' ELSE 'mountain' END, '{presentation.ALTITUDE_COLOUR}' FROM {cut("steep", "t0, track_id", 200)})"""


def _marked(spark: SparkSession, folder: str, **most: object) -> DataFrame:
    p = stored(user_points(spark, folder), "points")
    found = presentation.time_axis_markers(behavior.transport_segments(p), behavior.admin_stays(p), behavior.speed_events(p), spatial.altitude_events(p), **most)
    return found.withColumn("lat", r("lat", 6)).withColumn("lon", r("lon", 6))


@query(sql("seg stay", _markers(True), "user_id", _EVENTS))
def time_axis_markers(spark: SparkSession, folder: str) -> DataFrame:
    """The viewer's limits are part of this operator."""
    return _marked(spark, folder)


@query(sql("seg stay", _markers(False), "user_id", _EVENTS))
def time_axis_markers_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every marker, without limits."""
    return _marked(spark, folder, most=None)


@query(sql("seg stay", f"""SELECT s.stay_id, CAST(hour({ts("s.start_time")}) AS INT) AS hour, CAST(dayofweek({ts("s.start_time")}) AS INT) AS weekday, CAST(day({ts("s.start_time")}) <> day({ts("s.end_time")}) AS INT) AS is_overnight, round(s.duration_s / 3600, 5) AS hours,
  (SELECT mode FROM seg g WHERE g.track_id = s.track_id AND g.end_time <= s.start_time ORDER BY g.end_time DESC, g.mode DESC LIMIT 1) AS arrival, (SELECT mode FROM seg g WHERE g.track_id = s.track_id AND g.start_time >= s.end_time ORDER BY g.start_time, g.mode LIMIT 1) AS departure FROM stay s""", "user_id"))
def stay_annotation(spark: SparkSession, folder: str) -> DataFrame:
    p = stored(user_points(spark, folder), "points")
    noted = presentation.stay_annotation(behavior.admin_stays(p), behavior.transport_segments(p))
    return noted.select("stay_id", "hour", "weekday", i("is_overnight"), r("hours", 5), F.col("arrival.mode").alias("arrival"), F.col("departure.mode").alias("departure"))


@query(sql("points", "SELECT id, data_time, round(speed, 4) AS speed FROM points WHERE province = 'ASIA' AND speed >= 20 ORDER BY data_time DESC, id DESC LIMIT 100 OFFSET 100"))
def track_points_page(spark: SparkSession, folder: str) -> DataFrame:
    return serving.serve(trace_points(spark, folder), serving.VIEWS["track_points"], page=2, province="ASIA", min_speed=20).select("id", "data_time", r("speed", 4))


@query(sql("seg", "SELECT mode, segment_id, round(max_speed_kmh, 4) AS max_speed_kmh FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY max_speed_kmh DESC, segment_id) AS k FROM seg) WHERE k <= 10"))
def topn_per_mode(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("mode").orderBy(F.desc("max_speed_kmh"), "segment_id")
    return segments(spark, folder).withColumn("_k", F.row_number().over(w)).where("_k <= 10").select("mode", "segment_id", r("max_speed_kmh", 4))


@query(sql("seg", "SELECT s.segment_id, count(*) AS points, round(avg(c.speed), 4) AS speed FROM seg s JOIN clean c ON c.track_id = s.track_id AND c.data_time BETWEEN s.start_time AND s.end_time GROUP BY s.segment_id"))
def range_join_points_segments(spark: SparkSession, folder: str) -> DataFrame:
    p = points(spark, folder)
    s = behavior.transport_segments(p).select("segment_id", "track_id", "start_time", "end_time")
    both = range_join(p.select("track_id", "data_time", "speed"), s, "data_time", "start_time", "end_time", ["track_id"], 3600)
    return both.groupBy("segment_id").agg(F.count("*").alias("points"), r("speed", 4, F.avg("speed")))


# ---- functions


@query("""SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(skewness(value), 5) AS skew, round(kurtosis(value), 5) AS kurt, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3,
  round(max(value) - min(value), 6) AS span, round(stddev_samp(value) / avg(value), 6) AS cv, round(100 * avg(CASE WHEN value <= 50 THEN 1 ELSE 0 END), 6) AS rank50 FROM events GROUP BY event_type""")
def descriptive_stats(spark: SparkSession, folder: str) -> DataFrame:
    v = "value"
    return table(spark, folder, "events").groupBy("event_type").agg(
        r("mean", 6, stats.mean(v)), r("sd", 6, stats.stddev(v)), r("skew", 5, stats.skewness(v)), r("kurt", 5, stats.kurtosis(v)), r("q1", 6, stats.quantile(v, 0.25)), r("q2", 6, stats.median(v)), r("q3", 6, stats.quantile(v, 0.75)),
        r("span", 6, stats.value_range(v)), r("cv", 6, stats.coefficient_of_variation(v)), r("rank50", 6, stats.percentile_rank(v, 50.0)),
    )


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(covar_samp(l_quantity, l_extendedprice), 2) AS cov, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(sqrt(avg(pow(l_tax - l_discount, 2))), 6) AS rmse, round(avg(abs(l_tax - l_discount)), 6) AS mae FROM lineitem GROUP BY l_returnflag")
def correlation_matrix(spark: SparkSession, folder: str) -> DataFrame:
    x, y = "l_quantity", "l_extendedprice"
    line = stats.regression(x, y)
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        r("pearson", 6, stats.correlation(x, y)), r("cov", 2, stats.covariance(x, y)), r("slope", 4, line["slope"]), r("intercept", 2, line["intercept"]), r("r2", 6, stats.r_squared(x, y)), r("rmse", 6, stats.rmse("l_tax", "l_discount")), r("mae", 6, stats.mae("l_tax", "l_discount"))
    )


@query("""WITH a AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS rx, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2 AS ry FROM events)
  SELECT event_type, round(corr(rx, ry), 6) AS spearman FROM a GROUP BY event_type""")
def spearman(spark: SparkSession, folder: str) -> DataFrame:
    return stats.spearman(table(spark, folder, "events"), "value", "user_id", ["event_type"]).select("event_type", r("spearman"))


@query(f"WITH a AS (SELECT user_id % 10 AS g, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT g, round({entropy('n')}, 6) AS h, round(({entropy('n')}) / log2(count(*)), 6) AS h_norm, round(1 - sum(n * n) / pow(sum(n), 2), 6) AS gini FROM a GROUP BY g")
def entropy_metrics(spark: SparkSession, folder: str) -> DataFrame:
    counted = table(spark, folder, "events").groupBy((F.col("user_id") % 10).alias("g"), "event_type").agg(F.count("*").alias("n"))
    return counted.groupBy("g").agg(r("h", 6, stats.entropy("n")), r("h_norm", 6, stats.normalised_entropy("n")), r("gini", 6, stats.gini_impurity("n")))


@query("""WITH a AS (SELECT l_shipmode2 AS k, sum(q) AS p, sum(e) AS q FROM (SELECT l_linenumber AS l_shipmode2, l_quantity AS q, l_extendedprice AS e FROM lineitem) GROUP BY 1),
  s AS (SELECT k, p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM a)
  SELECT round(sum(-p * log2(q)), 6) AS cross_entropy, round(sum(p * log2(p / q)), 8) AS kl_divergence, round(sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2, 8) AS js_divergence FROM s""")
def divergences(spark: SparkSession, folder: str) -> DataFrame:
    sums = table(spark, folder, "lineitem").groupBy("l_linenumber").agg(F.sum("l_quantity").alias("p"), F.sum("l_extendedprice").alias("q"))
    return stats.divergences(sums, "p", "q", []).select(r("cross_entropy"), r("kl_divergence", 8), r("js_divergence", 8))


@query(sql("clean", "SELECT city, round(sqrt(pow(sum(sin(radians(heading))), 2) + pow(sum(cos(radians(heading))), 2)) / count(*), 6) AS resultant, round(1 - sqrt(pow(sum(sin(radians(heading))), 2) + pow(sum(cos(radians(heading))), 2)) / count(*), 6) AS variance FROM clean GROUP BY city"))
def circular_stats(spark: SparkSession, folder: str) -> DataFrame:
    return points(spark, folder).groupBy("city").agg(r("resultant", 6, stats.resultant("heading")), r("variance", 6, stats.circular_variance("heading")))


@query("""WITH b AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1), o AS (SELECT event_id, event_type, value, abs(value - m) AS off, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS iq FROM events JOIN b USING (event_type)),
  d AS (SELECT event_type, quantile_cont(off, 0.5) AS mad FROM o GROUP BY 1) SELECT event_type, CAST(sum(CAST(iq AS INT)) AS BIGINT) AS iqr_outliers, CAST(sum(CAST(0.6745 * off / mad > 3.5 AS INT)) AS BIGINT) AS mad_outliers FROM o JOIN d USING (event_type) GROUP BY event_type""")
def outlier_iqr_mad(spark: SparkSession, folder: str) -> DataFrame:
    e = stats.with_outlier_flag(table(spark, folder, "events"), "value", ["event_type"], "iq")
    return stats.with_mad_flag(e, "value", 3.5, ["event_type"], "md").groupBy("event_type").agg(F.count_if("iq").alias("iqr_outliers"), F.count_if("md").alias("mad_outliers"))


@query("WITH b AS (SELECT event_type, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events GROUP BY 1) SELECT event_type, round(sum(greatest(least(value, hi), lo)), 4) AS total, CAST(sum(CAST(value BETWEEN lo AND hi AS INT)) AS BIGINT) AS kept FROM events JOIN b USING (event_type) GROUP BY event_type")
def winsorize(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    clipped = stats.winsorized(e, "value", 0.05, 0.95, ["event_type"]).groupBy("event_type").agg(r("total", 4, F.sum("winsorized")))
    return clipped.join(stats.trimmed(e, "value", 0.05, 0.95, ["event_type"]).groupBy("event_type").agg(F.count("*").alias("kept")), "event_type")


@query("""WITH a AS (SELECT user_id, value, lead(value, 0) OVER w AS l0, lead(value, 1) OVER w AS l1, lead(value, 2) OVER w AS l2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT user_id, value, 0 AS lag, l0 AS y FROM a UNION ALL SELECT user_id, value, 1, l1 FROM a UNION ALL SELECT user_id, value, 2, l2 FROM a)
  SELECT user_id, CAST(lag AS INT) AS lag, round(coalesce(corr(value, y), 0), 6) AS r FROM b WHERE y IS NOT NULL GROUP BY 1, 2""")
def autocorrelation(spark: SparkSession, folder: str) -> DataFrame:
    return stats.lagged_correlation(table(spark, folder, "events"), "value", "value", ["ts", "event_id"], ["user_id"], 2).select("user_id", "lag", r("r"))


@query(sql("points", f"SELECT id, {geohash('lat', 'lon', 7)} AS h, round({hav('lat', 'lon', '22.5E0', '114.0E0')}, 3) AS m, round({bearing('lat', 'lon', '22.5E0', '114.0E0')}, 6) AS b FROM points"))
def geodesy(spark: SparkSession, folder: str) -> DataFrame:
    return trace_points(spark, folder).select("id", geo.geohash("lat", "lon", 7).alias("h"), F.round(geo.haversine("lat", "lon", 22.5, 114.0), 3).alias("m"), F.round(geo.bearing("lat", "lon", 22.5, 114.0), 6).alias("b"))
