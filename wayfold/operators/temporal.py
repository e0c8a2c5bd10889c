"""Time slices of points, and polylines simplified for several scales."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo

EPSILONS = (1e-4, 5e-4, 1e-3, 5e-3)


def time_slices(points: DataFrame, zoom: int = 15) -> DataFrame:
    """By hour of the day, by day, and by weekday (0 is Sunday) and hour: count, distance, distinct grid cells.

    One pass: points are counted by day, hour and cell, and that table is copied to its three slices.
    """
    t = F.timestamp_seconds("data_time")
    base = points.groupBy(F.date_format(t, "yyyy-MM-dd").alias("day"), F.date_format(t, "HH").alias("hour"), (F.dayofweek(t) - 1).cast("string").alias("weekday"), geo.tile_id("lat", "lon", zoom).alias("grid")).agg(
        F.count("*").alias("n"), F.sum("distance").alias("d")
    )
    kinds = {"HOURLY": F.col("hour"), "DAILY": F.col("day"), "WEEKLY_HOURLY": F.concat("weekday", F.lit("-"), "hour")}
    listed = F.array(*(F.struct(F.lit(k).alias("slice_type"), v.alias("slice_key")) for k, v in kinds.items()))
    wide = base.select("n", "d", "grid", F.explode(listed).alias("x")).select("*", "x.*")
    return wide.groupBy("slice_type", "slice_key").agg(F.sum("n").alias("point_count"), F.sum("d").alias("total_distance"), F.count_distinct("grid").alias("unique_grids"), (F.sum("n") * 10).alias("duration_s"))


def mode_slices(segments: DataFrame, granularity: str = "day") -> DataFrame:
    """Segments by day, month or year: count, modes, first and last time, distance."""
    shown = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[granularity]
    key = F.date_format(F.timestamp_seconds("start_time"), shown).alias("slice_key")
    return segments.groupBy(key).agg(F.count("*").alias("segment_count"), F.array_sort(F.collect_set("mode")).alias("modes"), F.min("start_time").alias("first_time"), F.max("end_time").alias("last_time"), F.sum("distance_m").alias("distance_m"))


def douglas_peucker(lat: np.ndarray, lon: np.ndarray, epsilon: float) -> np.ndarray:
    """Which corners of a line stay: those farther than epsilon from the chord between their neighbours that stay."""
    keep = np.zeros(len(lat), dtype=bool)
    if len(lat):
        keep[[0, -1]] = True
    open_spans = [(0, len(lat) - 1)]
    while open_spans:
        a, b = open_spans.pop()
        if b - a < 2:
            continue
        dx, dy = lon[b] - lon[a], lat[b] - lat[a]
        x, y = lon[a + 1 : b] - lon[a], lat[a + 1 : b] - lat[a]
        chord = np.hypot(dx, dy)
        away = np.abs(dx * y - dy * x) / chord if chord > 0 else np.hypot(x, y)
        far = int(away.argmax())
        if away[far] > epsilon:
            keep[a + 1 + far] = True
            open_spans += [(a, a + 1 + far), (a + 1 + far, b)]
    return keep


def simplified_lines(points: DataFrame, epsilons: tuple[float, ...] = EPSILONS, chunk_s: int = 86_400) -> DataFrame:
    """Polylines of a track's points, by chunk of chunk_s seconds: track_id, chunk, epsilon, original_points, kept_points, ratio, line.

    Chunks keep a group bounded however long a track is; each chunk's line ends at its own first and last fix. chunk_s=0
    makes one line of a whole track.
    """
    chunk = F.floor(F.col("data_time") / chunk_s) if chunk_s else F.lit(0).cast("long")
    rows = points.select("track_id", chunk.alias("chunk"), "data_time", "id", "lat", "lon")
    kind = rows.schema["track_id"].dataType.simpleString()

    def simplify(table: pa.Table) -> Iterator[pa.Table] | pa.Table:
        table = table.sort_by([("data_time", "ascending"), ("id", "ascending")])
        lat, lon = table["lat"].to_numpy(), table["lon"].to_numpy()
        kept = [douglas_peucker(lat, lon, e) for e in epsilons]
        lines = [[{"lat": float(a), "lon": float(b)} for a, b in zip(lat[k], lon[k], strict=True)] for k in kept]
        n = len(epsilons)
        return pa.table(
            {
                "track_id": pa.array([table["track_id"][0].as_py()] * n, table.schema.field("track_id").type),
                "chunk": pa.array([table["chunk"][0].as_py()] * n, pa.int64()),
                "epsilon": pa.array(list(epsilons), pa.float64()),
                "original_points": pa.array([len(lat)] * n, pa.int64()),
                "kept_points": pa.array([int(k.sum()) for k in kept], pa.int64()),
                "ratio": pa.array([float(k.sum()) / len(lat) for k in kept], pa.float64()),
                "line": pa.array(lines, pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))),
            }
        )

    return rows.groupBy("track_id", "chunk").applyInArrow(simplify, f"track_id {kind}, chunk long, epsilon double, original_points long, kept_points long, ratio double, line array<struct<lat:double,lon:double>>")
