"""The same rollups over streams of points: windows with watermarks, sessions, and mergeable totals.

A stream of points has data_time in unix seconds. State is bounded by the watermark, not by the stream's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(points: DataFrame, late: str) -> DataFrame:
    return points.withColumn("at", F.timestamp_seconds("data_time")).withWatermark("at", late)


def hourly_slices(points: DataFrame, late: str = "1 day") -> DataFrame:
    """Points and distance of each track and hour; an hour is final once the watermark has passed it."""
    w = F.window("at", "1 hour")
    out = _timed(points, late).groupBy("track_id", w).agg(F.count("*").alias("point_count"), F.sum("distance").alias("total_distance"))
    return out.select("track_id", F.unix_seconds("window.start").alias("hour_start"), "point_count", "total_distance")


def sessions(points: DataFrame, gap_s: int = 7200, late: str = "1 day") -> DataFrame:
    """Stretches of a track without a pause of gap_s seconds: start, end (its last fix), points."""
    w = F.session_window("at", f"{gap_s} seconds")
    out = _timed(points, late).groupBy("track_id", w).agg(F.count("*").alias("point_count"))
    return out.select("track_id", F.unix_seconds("session_window.start").alias("start_time"), (F.unix_seconds("session_window.end") - gap_s).alias("end_time"), "point_count")


def daily_totals(points: DataFrame) -> DataFrame:
    """Totals by region and day, which add up over batches; distinct days of any period follow from the keys."""
    day = F.to_date(F.timestamp_seconds("data_time")).alias("day")
    return points.groupBy("province", "city", day).agg(F.count("*").alias("n"), F.sum("distance").alias("distance"), F.min("data_time").alias("first"), F.max("data_time").alias("last"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two tables of daily totals as one."""
    both = old.unionByName(new)
    return both.groupBy("province", "city", "day").agg(F.sum("n").alias("n"), F.sum("distance").alias("distance"), F.min("first").alias("first"), F.max("last").alias("last"))


def caught_up(totals: DataFrame | None, points: DataFrame) -> DataFrame:
    """daily_totals with `mark`, the greatest id counted so far, brought up to the points above that mark.

    totals: what an earlier call gave and the caller has stored, or None at first. The mark is kept in the totals, so a
    run that failed before they were stored is simply made again, and nothing counts twice. Ids must grow with arrival.
    The filter on id reaches the scan.
    """
    mark = None if totals is None else totals.agg(F.max("mark")).head()[0]
    fresh = points if mark is None else points.where(F.col("id") > mark)
    day = F.to_date(F.timestamp_seconds("data_time")).alias("day")
    new = fresh.groupBy("province", "city", day).agg(F.count("*").alias("n"), F.sum("distance").alias("distance"), F.min("data_time").alias("first"), F.max("data_time").alias("last"), F.max("id").alias("mark"))
    if totals is None:
        return new
    both = totals.unionByName(new).groupBy("province", "city", "day")
    return both.agg(F.sum("n").alias("n"), F.sum("distance").alias("distance"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("mark").alias("mark"))


def jumps(points: DataFrame, jump_m: float = 1000.0, jump_s: int = 10, late: str = "1 day", idle_s: int = 86_400) -> DataFrame:
    """Fixes of a stream that lie jump_m or more from the fix before in their track, at most jump_s seconds earlier.

    State is one fix a track, dropped once the watermark has passed it by idle_s seconds. A trigger's fixes of a track
    are sorted; one that is older than the last fix of an earlier trigger is judged by nothing and leaves the state alone.
    Returns track_id, id, data_time, wait_s, moved_m.
    """
    kind = points.schema["track_id"].dataType.simpleString()
    rows = _timed(points.where("data_time is not null and lat is not null and lon is not null"), late).select("track_id", "id", "data_time", "lat", "lon", "at")

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = pd.concat(list(batches)).sort_values(["data_time", "id"])
        if state.exists:
            time, number, lat, lon = state.get
            own = own[(own["data_time"] > time) | ((own["data_time"] == time) & (own["id"] > number))]
            own = pd.concat([pd.DataFrame({"id": [number], "data_time": [time], "lat": [lat], "lon": [lon]}), own[["id", "data_time", "lat", "lon"]]])
        if len(own) == 0:
            return
        y, x = np.radians(own["lat"].to_numpy(dtype=float)), np.radians(own["lon"].to_numpy(dtype=float))
        h = np.sin(np.diff(y) / 2) ** 2 + np.cos(y[:-1]) * np.cos(y[1:]) * np.sin(np.diff(x) / 2) ** 2
        moved, wait = 2 * 6_371_000 * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0))), np.diff(own["data_time"].to_numpy(dtype=np.int64))
        last = own.iloc[-1]
        state.update((int(last["data_time"]), int(last["id"]), float(last["lat"]), float(last["lon"])))
        state.setTimeoutTimestamp(max(int(last["data_time"]) + idle_s, state.getCurrentWatermarkMs() // 1000 + 1) * 1000)
        found = (wait > 0) & (wait <= jump_s) & (moved >= jump_m)
        after = own.iloc[1:][found]
        yield pd.DataFrame({"track_id": [key[0]] * len(after), "id": after["id"].astype("int64"), "data_time": after["data_time"].astype("int64"), "wait_s": wait[found], "moved_m": moved[found]})

    out = f"track_id {kind}, id long, data_time long, wait_s long, moved_m double"
    return rows.groupBy("track_id").applyInPandasWithState(judge, out, "data_time long, id long, lat double, lon double", "append", GroupStateTimeout.EventTimeTimeout)
