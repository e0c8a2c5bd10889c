"""The tables of a batch, reached in three increments over the events; their SQL is that of one batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import increments
from wayfold.plans import queries as q
from wayfold.plans.oracles import sql
from wayfold.plans.queries import i, query, r
from wayfold.plans.storage import fresh_folder
from wayfold.sources.trace import trace_points


def grown(points: DataFrame, steps: int = 3) -> Iterator[DataFrame]:
    """The points of the first third of the time, of two thirds, and all."""
    low, high = points.agg(F.min("data_time"), F.max("data_time")).first()
    for k in range(1, steps):
        yield points.where(F.col("data_time") <= low + (high - low) * k // steps) if low is not None else points
    yield points


def _in_steps(spark: SparkSession, points: DataFrame, advance: Callable[[SparkSession, str, DataFrame], DataFrame]) -> DataFrame:
    folder = fresh_folder(spark, "grown")
    for part in grown(points):
        out = advance(spark, folder, part)
    return out


@query(q.ORACLES["transport_segments"])
def segments_in_increments(spark: SparkSession, folder: str) -> DataFrame:
    out = _in_steps(spark, trace_points(spark, folder), increments.advance_segments)
    return out.select("segment_id", "track_id", "mode", "start_time", "end_time", "duration_s", "point_count", r("distance_m", 3), r("avg_speed_kmh", 4), r("max_speed_kmh", 4), "end_id", "city")


@query(sql("stay", "SELECT stay_id, track_id, stay_type, start_time, end_time, duration_s, round(center_lat, 6) AS center_lat, round(center_lon, 6) AS center_lon, round(radius_m, 3) AS radius_m, point_count, town, geohash6 FROM stay", "user_id"))
def stays_in_increments(spark: SparkSession, folder: str) -> DataFrame:
    out = _in_steps(spark, trace_points(spark, folder, F.col("user_id")), increments.advance_stays)
    return out.select("stay_id", "track_id", "stay_type", "start_time", "end_time", "duration_s", r("center_lat", 6), r("center_lon", 6), r("radius_m", 3), "point_count", "town", "geohash6")


@query(q.ORACLES["grid_cells"])
def cells_in_increments(spark: SparkSession, folder: str) -> DataFrame:
    out = _in_steps(spark, trace_points(spark, folder), increments.advance_cells)
    return out.select("grid_id", i("level"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "point_count", "days", "first_visit", "last_visit", "duration_s")


@query(sql("cell", """SELECT area_type, area_key, count(*) AS point_count, round(sum(distance), 4) AS total_distance, min(data_time) AS first_visit, max(data_time) AS last_visit, count(DISTINCT data_time // 86400) AS visit_days, count(DISTINCT (x, y)) AS distinct_cells
  FROM (SELECT c.*, x, y FROM (SELECT id, data_time, distance, unnest(['PROVINCE', 'CITY', 'COUNTY', 'TOWN']) AS area_type, unnest([province, city, county, town]) AS area_key FROM clean) c JOIN cell0 k ON k.id = c.id AND k.level = 15)
  WHERE area_key <> '' GROUP BY area_type, area_key"""))
def areas_in_increments(spark: SparkSession, folder: str) -> DataFrame:
    out = _in_steps(spark, trace_points(spark, folder), increments.advance_areas)
    return out.select("area_type", "area_key", "point_count", r("total_distance", 4), "first_visit", "last_visit", "visit_days", "distinct_cells")
