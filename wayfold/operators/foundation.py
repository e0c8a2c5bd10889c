"""Cleaning of raw fixes: outliers, gaps, missing places.

Points have id, track_id, data_time (unix seconds), lat, lon, speed (m/s), accuracy, altitude, heading, distance and
places. All windows run over one track in the order (data_time, id), so one hash partitioning serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators.area_index import with_area
from wayfold.plans.windows import ORDER, previous, running


def _reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in the rules' order."""
    return F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))


def flag_outliers(points: DataFrame, max_speed: float = 277.78, max_accuracy: float = 100.0, warn_accuracy: float = 50.0, jump_m: float = 1000.0, jump_s: int = 10, chunk_s: int | None = None) -> DataFrame:
    """Adds outlier, reasons and qa_status. A jump is seen from the raw fix before, itself an outlier or not; nulls count as 0.

    chunk_s, here and in other operators: cut long tracks into stretches of so many seconds, see windows.previous."""
    df = previous(points, ["data_time", "lat", "lon"], "_b", chunk_s)
    wait = F.col("data_time") - F.col("_b.data_time")
    speed, accuracy = F.coalesce("speed", F.lit(0.0)), F.coalesce("accuracy", F.lit(0.0))
    jump = (wait > 0) & (wait <= jump_s) & (geo.haversine("_b.lat", "_b.lon", "lat", "lon") >= jump_m)
    rules = {"EXCESSIVE_SPEED": speed > max_speed, "LOW_ACCURACY": accuracy > max_accuracy, "JUMP": jump}
    return _judged(df.withColumn("reasons", _reasons(rules)), F.size("reasons") > 0, accuracy.between(warn_accuracy, max_accuracy)).drop("_b")


def flag_outliers_by_pattern(points: DataFrame, max_kmh: float = 300.0, max_accuracy: float = 100.0, back_m: float = 50.0, back_s: int = 300, leg_m: float = 10.0, drift_m: float = 20.0, drift_points: int = 5, chunk_s: int | None = None) -> DataFrame:
    """The stricter rules: implied speed, there-and-back within three fixes, and drift of a resting receiver over five.

    The last fix of a pattern is marked. Low accuracy alone is a warning, not an outlier.
    """
    fix = F.struct("data_time", "lat", "lon")
    df = running(points, chunk_s, lags={"_seen": (fix, max(2, drift_points - 1))})
    df = df.withColumn("_b", F.try_element_at("_seen", F.lit(-1))).withColumn("_a", F.try_element_at("_seen", F.lit(-2)))
    near = F.concat(F.transform("_seen", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))), F.array(F.struct("lat", "lon")))
    df = df.withColumn("_near", F.slice(near, F.greatest(F.size(near) - drift_points, F.lit(0)) + 1, drift_points))
    wait = F.col("data_time") - F.col("_b.data_time")
    leg = geo.haversine("_b.lat", "_b.lon", "lat", "lon")
    jump = (wait > 0) & (wait <= 3600) & (F.try_divide(leg, wait) * 3.6 > max_kmh)
    back = (geo.haversine("_a.lat", "_a.lon", "lat", "lon") <= back_m) & (F.col("data_time") - F.col("_a.data_time") <= back_s)
    back = back & (leg >= leg_m) & (geo.haversine("_a.lat", "_a.lon", "_b.lat", "_b.lon") >= leg_m)
    for c in ("lat", "lon"):
        known = F.filter(F.col(f"_near.{c}"), lambda v: v.isNotNull())
        df = df.withColumn(f"_{c}", F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, v: s + v), F.size(known)))
    close = F.forall("_near", lambda p: geo.haversine(p["lat"], p["lon"], F.col("_lat"), F.col("_lon")) < drift_m)
    drift = (F.size("_near") >= drift_points) & close & (F.size(F.array_distinct("_near")) > 1)
    rules = {"JUMP": jump, "BACKTRACK": back, "STATIC_DRIFT": drift, "LOW_ACCURACY": F.coalesce("accuracy", F.lit(0.0)) > max_accuracy}
    df = df.withColumn("reasons", _reasons(rules)).drop("_a", "_b", "_seen", "_near", "_lat", "_lon")
    hard = F.size(F.array_except("reasons", F.array(F.lit("LOW_ACCURACY")))) > 0
    return _judged(df, hard, F.size("reasons") > 0)


def _judged(df: DataFrame, fail: Column, warn: Column) -> DataFrame:
    return df.withColumn("outlier", fail).withColumn("qa_status", F.when(fail, "FAIL").when(warn, "WARNING").otherwise("PASS"))


def clean(points: DataFrame, chunk_s: int | None = None) -> DataFrame:
    """The points that are no outliers, without the marks."""
    return flag_outliers(points, chunk_s=chunk_s).where(~F.col("outlier")).drop("outlier", "reasons", "qa_status")


def fill_gaps(points: DataFrame, gap: int = 300, max_gap: int = 1800, step: int = 60, most: int = 30, chunk_s: int | None = None) -> DataFrame:
    """Synthetic points between consecutive fixes more than gap and up to max_gap seconds apart, on a straight line.

    Returns track_id, after_id (the fix before), k (from 1), data_time, lat, lon, altitude, speed and qa_status. The
    input is left alone, so a second run gives the same rows.
    """
    after = F.struct("data_time", "lat", "lon", "altitude", "speed")
    df = running(points, chunk_s, order=[F.desc(c) for c in ORDER], descending=True, befores={"_n": after})
    df = df.withColumn("_dt", F.col("_n.data_time") - F.col("data_time")).where((F.col("_dt") > gap) & (F.col("_dt") <= max_gap))
    df = df.withColumn("_count", F.least(F.floor(F.col("_dt") / step), F.lit(most)).cast("int")).where("_count > 0")
    df = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    share = F.col("k") / (F.col("_count") + 1)

    def between(name: str, missing: float | None = None) -> Column:
        a, b = F.col(name), F.col(f"_n.{name}")
        if missing is not None:
            a, b = F.coalesce(a, F.lit(missing)), F.coalesce(b, F.lit(missing))
        return (a + (b - a) * share).alias(name)

    time = (F.col("data_time") + F.floor(F.col("_dt") * share)).alias("data_time")
    return df.select("track_id", F.col("id").alias("after_id"), "k", time, between("lat"), between("lon"), between("altitude", 0.0), between("speed", 0.0), F.lit("interpolated").alias("qa_status"))


def reverse_geocode(points: DataFrame, areas: DataFrame, most_edges: int = 32) -> DataFrame:
    """Fill places of points without a province from polygons: areas has province, city, county, town and rings
    (array<array<struct<lat, lon>>>; a point is inside by the even-odd rule over all of them), or one ring. A point in
    several polygons takes the least by name; in none, it keeps null places.

    Polygons are cut to the cells of an index, finer where many edges lie (operators/area_index.py), and met by
    equi-joins: no point is held against a whole polygon, and polygons need not fit in memory.
    """
    names = ["province", "city", "county", "town"]
    out = with_area(points, areas, names, F.coalesce(F.length("province"), F.lit(0)) == 0, most_edges)
    rest = [c for c in points.columns if c not in names]
    return out.select(*rest, *(F.coalesce(F.when(F.length(n) > 0, F.col(n)), F.col(f"_area.{n}")).alias(n) for n in names))


def reverse_geocode_by_cell(points: DataFrame, areas: DataFrame, precision: int = 7) -> DataFrame:
    """reverse_geocode, asked once for each geohash cell, at its middle: all points of a cell get the same places."""
    names = ["province", "city", "county", "town"]
    held = points.withColumn("_cell", F.when(F.coalesce(F.length("province"), F.lit(0)) == 0, geo.geohash("lat", "lon", precision)))
    cells = held.where("_cell is not null").select("_cell").distinct().withColumn("_m", geo.geohash_decode("_cell"))
    bare = cells.select("_cell", F.col("_m.lat").alias("lat"), F.col("_m.lon").alias("lon"), *(F.lit(None).cast("string").alias(n) for n in names))
    found = reverse_geocode(bare, areas).select("_cell", F.struct(*names).alias("_area"))
    rest = [c for c in points.columns if c not in names]
    return held.join(found, "_cell", "left").select(*rest, *(F.coalesce(F.when(F.length(n) > 0, F.col(n)), F.col(f"_area.{n}")).alias(n) for n in names))
