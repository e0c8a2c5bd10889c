"""Queries that show the functions of wayfold/functions, each with its statement in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geo, stats
from wayfold.operators import foundation
from wayfold.plans import queries as q
from wayfold.plans.oracles import entropy, geohash, hav, sql
from wayfold.plans.queries import query, r
from wayfold.plans.storage import stored
from wayfold.sources.trace import table, trace_points

_NEAR = "least(greatest(lat, -90), 90)"


@query(sql("points", """SELECT id, round(degrees(asin(sin(radians(lat)) * cos(distance / 6371000) + cos(radians(lat)) * sin(distance / 6371000) * cos(radians(heading)))), 7) AS dlat,
  round(degrees(atan2(sin(radians(114.0E0) - radians(lon)) * cos(radians(22.5E0)), 1)), 6) AS side,
  round(degrees(atan2(sin(radians(lat)) + sin(radians(22.5E0)), sqrt(pow(cos(radians(lat)) + cos(radians(22.5E0)) * cos(radians(114.0E0) - radians(lon)), 2) + pow(cos(radians(22.5E0)) * sin(radians(114.0E0) - radians(lon)), 2)))), 7) AS mlat,
  round(CASE WHEN fmod(heading * 2 + 40 + 180, 360) - 180 = -180 THEN 180 ELSE fmod(heading * 2 + 40 + 180, 360) - 180 END, 6) AS turn,
  round(111320.0E0 * abs(1.5E0 * lon - 2.0E0 * lat - 1.5E0 * 113.0E0 + 2.0E0 * 22.0E0) / 2.5E0, 2) AS away,
  round(111320.0E0 * 111320.0E0 * 0.005E0, -2) AS triangle FROM points"""))
def geodesy_more(spark: SparkSession, folder: str) -> DataFrame:
    """Destination, midpoint, turn, distance from a line through (22, 113) and (23.5, 115), area of a triangle."""
    p = trace_points(spark, folder)
    corner = [F.struct((F.col("lat") + a).alias("lat"), (F.col("lon") + b).alias("lon")) for a, b in ((0.0, 0.0), (0.1, 0.0), (0.0, 0.1))]
    side = F.degrees(F.atan2(F.sin(F.radians(F.lit(114.0)) - F.radians("lon")) * F.cos(F.radians(F.lit(22.5))), F.lit(1.0)))
    return p.select(
        "id", r("dlat", 7, geo.destination("lat", "lon", "heading", "distance")["lat"]), r("side", 6, side), r("mlat", 7, geo.midpoint("lat", "lon", 22.5, 114.0)["lat"]), r("turn", 6, geo.angular_difference("heading", F.col("heading") * 3 + 40)),
        r("away", 2, geo.perpendicular_distance("lat", "lon", 22.0, 113.0, 23.5, 115.0)), F.round(geo.polygon_area(F.array(*corner)), -2).alias("triangle"),
    )


_X, _Y = "(ceil((lon + 180.0E0) / 360.0E0 * 262144) - 1)", "(ceil((lat + 90.0E0) / 180.0E0 * 131072) - 1)"


@query(sql("points", f"""SELECT id, round(({_Y} + 0.5E0) / 131072 * 180 - 90, 7) AS lat, round(({_X} + 0.5E0) / 262144 * 360 - 180, 7) AS lon, round({_Y} / 131072 * 180 - 90, 7) AS south, round({_X} / 262144 * 360 - 180, 7) AS west,
  153.0E0 AS cell_m, CASE WHEN speed <= 0.037 THEN 12 WHEN speed <= 0.149 THEN 11 WHEN speed <= 1.19 THEN 10 WHEN speed <= 4.77 THEN 9 WHEN speed <= 38.2 THEN 8 WHEN speed <= 153 THEN 7 WHEN speed <= 1220 THEN 6 ELSE 5 END AS fits,
  round({hav('lat', 'lon', 'lat', 'lon + 0.5E0')} * {hav('lat', 'lon', 'lat + 0.5E0', 'lon')}, -3) AS box FROM points"""))
def geohash_functions(spark: SparkSession, folder: str) -> DataFrame:
    p = trace_points(spark, folder).withColumn("h", geo.geohash("lat", "lon", 7))
    middle, edges = geo.geohash_decode("h"), geo.geohash_bounds("h")
    box = geo.bounding_box_area("lat", "lon", F.col("lat") + 0.5, F.col("lon") + 0.5)
    return p.select("id", r("lat", 7, middle["lat"]), r("lon", 7, middle["lon"]), r("south", 7, edges["min_lat"]), r("west", 7, edges["min_lon"]), geo.geohash_cell_size(F.lit(7)).alias("cell_m"), geo.geohash_precision_for("speed").alias("fits"), F.round(box, -3).alias("box"))


_AROUND = [f"SELECT id, {geohash(f'y + {a} * 180.0E0 / 128', f'x + {b} * 360.0E0 / 256', 3)} AS h FROM c" for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


@query(sql("points", "SELECT id, string_agg(h, ',' ORDER BY h) AS around FROM (" + " UNION ".join(_AROUND) + ") GROUP BY id", more={"c": "SELECT id, (ceil((lat + 90.0E0) / 180.0E0 * 128) - 0.5E0) / 128 * 180 - 90 AS y, (ceil((lon + 180.0E0) / 360.0E0 * 256) - 0.5E0) / 256 * 360 - 180 AS x FROM points"}))
def geohash_around(spark: SparkSession, folder: str) -> DataFrame:
    """The cells around those of all events."""
    p = trace_points(spark, folder).select("id", geo.geohash("lat", "lon", 3).alias("h"))
    cells = p.select("h").distinct().select("h", F.array_join(F.array_sort(geo.geohash_neighbours("h", 3)), ",").alias("around"))
    return p.join(cells, "h").select("id", "around")


@query("""WITH e AS (SELECT event_type, value AS x, user_id % 7 + 1 AS w, user_id % 10 AS k FROM events), m AS (SELECT event_type, first(k ORDER BY n DESC, k) AS mode FROM (SELECT event_type, k, count(*) AS n FROM e GROUP BY ALL) GROUP BY event_type)
  SELECT event_type, round(sum(x * w) / sum(w), 6) AS w_mean, round(var_samp(x), 4) AS var, round(sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2), 4) AS w_var, round(sqrt(sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2)), 5) AS w_sd, mode,
    round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(quantile_cont(x, 0.3), 6) AS d3, round(quantile_cont(x, 0.9), 6) AS d9, round(min(x), 6) AS low, round(max(x), 6) AS high FROM e JOIN m USING (event_type) GROUP BY event_type, mode""")
def weighted_stats(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_type", F.col("value").alias("x"), (F.col("user_id") % 7 + 1).alias("w"), (F.col("user_id") % 10).alias("k"))
    tenths, five = stats.deciles("x"), stats.five_numbers("x")
    return e.groupBy("event_type").agg(
        r("w_mean", 6, stats.weighted_mean("x", "w")), r("var", 4, stats.variance("x")), r("w_var", 4, stats.weighted_variance("x", "w")), r("w_sd", 5, stats.weighted_stddev("x", "w")), stats.mode("k").alias("mode"), r("iqr", 6, stats.iqr("x")),
        r("d3", 6, tenths[2]), r("d9", 6, tenths[8]), r("low", 6, five[0]), r("high", 6, five[4]),
    )


@query("""WITH s AS (SELECT event_type, value, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) AS u FROM events WINDOW w AS (PARTITION BY event_type)),
  b AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
  SELECT event_type, round(sum(z * z), 4) AS squares, CAST(sum(CASE WHEN abs(z) > 2 THEN 1 ELSE 0 END) AS BIGINT) AS far, round(avg(u), 6) AS scaled, CAST(sum(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM s JOIN b USING (event_type) GROUP BY event_type""")
def standard_scores(spark: SparkSession, folder: str) -> DataFrame:
    e, by = table(spark, folder, "events"), ["event_type"]
    scores = stats.with_zscore(e, "value", by).groupBy(*by).agg(r("squares", 4, F.sum(F.col("z") * F.col("z"))))
    far = stats.with_zscore_flag(e, "value", 2.0, by, "far").groupBy(*by).agg(F.count_if("far").alias("far"))
    scaled = stats.normalised(e, "value", by).groupBy(*by).agg(r("scaled", 6, F.avg("scaled")))
    kept = stats.without_outliers(e, "value", by).groupBy(*by).agg(F.count("*").alias("kept"))
    return scores.join(far, by).join(scaled, by).join(kept, by)


@query("""WITH l AS (SELECT l_returnflag AS f, corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem GROUP BY 1)
  SELECT f AS l_returnflag, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) AS partial, round(i + 10 * s, 2) AS at_ten FROM l""")
def partial_correlations(spark: SparkSession, folder: str) -> DataFrame:
    line = stats.regression("l_quantity", "l_extendedprice")
    found = table(spark, folder, "lineitem").groupBy("l_returnflag").agg(r("partial", 6, stats.partial_correlation("l_quantity", "l_extendedprice", "l_discount")), line.alias("line"))
    return found.select("l_returnflag", "partial", r("at_ten", 2, stats.predict(10.0, "line.slope", "line.intercept")))


_BINS = {
    "e": "SELECT event_type, value AS x, CAST(user_id AS DOUBLE) AS y FROM events", "m": "SELECT event_type, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM e GROUP BY 1",
    "b": "SELECT event_type, least(floor((x - x0) * 8 / (x1 - x0)), 7) AS bx, least(floor((y - y0) * 8 / (y1 - y0)), 7) AS b2 FROM e JOIN m USING (event_type)",
    "hx": f"SELECT event_type, {entropy('n')} AS hx FROM (SELECT event_type, bx, count(*) AS n FROM b GROUP BY ALL) GROUP BY 1", "hy": f"SELECT event_type, {entropy('n')} AS hy FROM (SELECT event_type, b2, count(*) AS n FROM b GROUP BY ALL) GROUP BY 1",
    "hxy": f"SELECT event_type, {entropy('n')} AS hxy FROM (SELECT event_type, bx, b2, count(*) AS n FROM b GROUP BY ALL) GROUP BY 1",
}


@query("WITH " + ", ".join(f"{n} AS ({s})" for n, s in _BINS.items()) + " SELECT event_type, round(hx, 6) AS h_x, round(hxy, 6) AS h_xy, round(hx + hy - hxy, 6) AS mutual, round(hxy - hx, 6) AS conditional, round(hx * ln(2), 6) AS nats FROM hx JOIN hy USING (event_type) JOIN hxy USING (event_type)")
def information_of_columns(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_type", F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    found = stats.information(e, "x", "y", 8, ["event_type"])
    alone = stats.entropy_of_values(e, "x", 8, ["event_type"])
    return found.join(alone, "event_type").select("event_type", r("h_x", 6, F.col("entropy")), r("h_xy"), r("mutual", 6, F.col("mutual_information")), r("conditional", 6, F.col("conditional_entropy")), r("nats", 6, F.col("h_x") * F.log(F.lit(2.0))))


_C = "SELECT city, count(*) AS n, sum(sin(radians(heading))) AS s, sum(cos(radians(heading))) AS c, sqrt(pow(sum(sin(radians(heading))), 2) + pow(sum(cos(radians(heading))), 2)) / count(*) AS r FROM clean GROUP BY city"


@query(sql("clean", """SELECT city, round(fmod(degrees(atan2(s, c)) + 360, 360), 4) AS mean, round(fmod(atan2(s, c) + 2 * pi(), 2 * pi()), 6) AS mean_rad, round(sqrt(-2 * ln(r)), 6) AS sd,
  round(CASE WHEN r < 0.53 THEN 2 * r + pow(r, 3) + 5 * pow(r, 5) / 6 WHEN r < 0.85 THEN -0.4 + 1.39 * r + 0.43 / (1 - r) ELSE 1 / (pow(r, 3) - 4 * pow(r, 2) + 3 * r) END, 5) AS kappa, CAST(exp(-n * r * r) > 0.05 AS INT) AS uniform FROM g""", more={"g": _C}))
def circular_functions(spark: SparkSession, folder: str) -> DataFrame:
    h = "heading"
    return q.points(spark, folder).groupBy("city").agg(
        r("mean", 4, stats.circular_mean(h)), r("mean_rad", 6, stats.circular_mean_radians(F.radians(h))), r("sd", 6, stats.circular_stddev(h)), r("kappa", 5, stats.circular_concentration(h)), stats.is_circular_uniform(h).cast("int").alias("uniform")
    )


@query(sql("clean", f"""SELECT track_id, round(path, 2) AS path_m, round(path / line, 5) AS tortuosity, round(gyration, 3) AS gyration, round(weighted, 3) AS weighted, round(wlat, 7) AS wlat, round(south, 6) AS south, round(box, -4) AS hull FROM
  (SELECT track_id, sum(stride) AS path, {hav("first(lat ORDER BY data_time, id)", "first(lon ORDER BY data_time, id)", "last(lat ORDER BY data_time, id)", "last(lon ORDER BY data_time, id)")} AS line FROM (SELECT *, {hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} AS stride FROM clean WINDOW w AS (PARTITION BY track_id ORDER BY data_time, id)) GROUP BY track_id)
  JOIN (SELECT track_id, sqrt(avg(pow({hav("lat", "lon", "cy", "cx")}, 2))) AS gyration, sqrt(sum(accuracy * pow({hav("lat", "lon", "wy", "wx")}, 2)) / sum(accuracy)) AS weighted, max(wy) AS wlat FROM clean JOIN c USING (track_id) GROUP BY track_id) USING (track_id)
  JOIN (SELECT track_id, min(lat) AS south, {hav("min(lat)", "min(lon)", "min(lat)", "max(lon)")} * {hav("min(lat)", "min(lon)", "max(lat)", "min(lon)")} AS box FROM clean GROUP BY track_id) USING (track_id)""",
  more={"c": "SELECT track_id, avg(lat) AS cy, avg(lon) AS cx, sum(lat * accuracy) / sum(accuracy) AS wy, sum(lon * accuracy) / sum(accuracy) AS wx FROM clean GROUP BY track_id"}))
def track_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """In stretches of six hours, since there are few tracks."""
    hours, by = 21_600, ["track_id"]
    fixes = trace_points(spark, folder).select("id", "track_id", "data_time", "lat", "lon", "speed", "accuracy")
    p = stored(foundation.clean(fixes, hours).drop("speed"), "points")
    out = geo.paths(p, by, ["data_time", "id"], chunk_s=hours).join(geo.radius_of_gyration(p, by).withColumnRenamed("radius_m", "g"), by).join(geo.radius_of_gyration(p, by, "accuracy").withColumnRenamed("radius_m", "w"), by)
    box = p.groupBy(*by).agg(geo.centroid("lat", "lon", "accuracy").alias("c"), geo.bounding_box("lat", "lon").alias("b"), geo.hull_area("lat", "lon").alias("hull"))
    return out.join(box, by).select("track_id", r("path_m", 2), r("tortuosity", 5), r("gyration", 3, F.col("g")), r("weighted", 3, F.col("w")), r("wlat", 7, F.col("c.lat")), r("south", 6, F.col("b.min_lat")), F.round("hull", -4).alias("hull"))
