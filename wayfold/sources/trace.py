"""Track points from the driver's star schema: events carry time and value; places follow from user and event numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trace_points(spark: SparkSession, folder: str, track: Column | None = None) -> DataFrame:
    """Points with a fixed schema. `track` names the track of an event (default: user modulo 4)."""
    places = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select("n_nationkey", "n_name", "r_name")
    e = table(spark, folder, "events").withColumn("_nation", (F.col("user_id") % 25).cast("int"))
    joined = e.join(F.broadcast(places), F.col("_nation") == F.col("n_nationkey"))  # a nation table has 25 rows
    event, user = F.col("event_id"), F.col("user_id")
    county = F.concat("n_name", F.lit("-C"), (F.floor(user / 25).cast("long") % 3).cast("string"))
    return joined.select(
        event.alias("id"),
        (user % 4 if track is None else track).alias("track_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("data_time"),
        (22.0 + (user * 37 % 200) / 100.0 + (event * 13 % 50) / 5000.0).alias("lat"),
        (113.0 + (user * 53 % 300) / 100.0 + (event * 29 % 50) / 5000.0).alias("lon"),
        F.col("value").alias("speed"),
        (F.get_json_object("props", "$.k").cast("double") + 5).alias("accuracy"),
        ((event * 7 % 900) + F.col("value")).alias("altitude"),
        (event * 47 % 360).cast("double").alias("heading"),
        (F.col("value") * 10).alias("distance"),
        F.col("r_name").alias("province"),
        F.col("n_name").alias("city"),
        county.alias("county"),
        F.concat(county, F.lit("-T"), (event % 2).cast("string")).alias("town"),
    )


def points_sql(track: str = "user_id % 4") -> str:
    """The same points for DuckDB, as a common table expression named points."""
    return f"""points AS (
  SELECT event_id AS id, {track} AS track_id, CAST(floor(epoch(ts)) AS BIGINT) AS data_time,
    22.0E0 + (user_id * 37 % 200) / 100.0E0 + (event_id * 13 % 50) / 5000.0E0 AS lat,
    113.0E0 + (user_id * 53 % 300) / 100.0E0 + (event_id * 29 % 50) / 5000.0E0 AS lon,
    value AS speed, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 5 AS accuracy,
    (event_id * 7 % 900) + value AS altitude, CAST(event_id * 47 % 360 AS DOUBLE) AS heading, value * 10 AS distance,
    r_name AS province, n_name AS city, n_name || '-C' || CAST((user_id // 25) % 3 AS VARCHAR) AS county,
    n_name || '-C' || CAST((user_id // 25) % 3 AS VARCHAR) || '-T' || CAST(event_id % 2 AS VARCHAR) AS town
  FROM events JOIN nation ON n_nationkey = user_id % 25 JOIN region ON n_regionkey = r_regionkey)"""
