"""Incremental runs: segments, stays, cells and area totals brought up to new fixes without reading the old ones.

A table (sources/tables.py) keeps beside its rows the last raw fix of each track, which judges the next one, and the
fixes of each track's open run, which new ones may prolong. A run reads the fixes above the mark, (data_time, id) of the
last fix seen, joins the open runs, applies the batch operator to them alone and replaces rows by key; state, rows and
mark are published at once. So several increments give the rows of one batch, and a run without new fixes changes
nothing. Its cost grows with the new fixes and the open runs' fixes, not with the table's past.

Fixes must come in the order of time over all tracks, as a device's log does: one at or before the mark is left out, and
a full run is needed to take it in. Null times or ids are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import behavior, foundation, spatial
from wayfold.plans.storage import stored
from wayfold.plans.windows import ORDER, islands, previous
from wayfold.sources import tables

Rows = Callable[[DataFrame], DataFrame]


def _above(points: DataFrame, mark: list[int] | None) -> DataFrame:
    known = points.where("data_time is not null and id is not null")
    if mark is None:
        return known
    time, number = mark
    return known.where((F.col("data_time") >= time) & ((F.col("data_time") > time) | (F.col("id") > number)))


def _cleaned(fresh: DataFrame, last: DataFrame | None) -> DataFrame:
    """Fixes that are no outliers, the first of a track judged by the track's last raw fix."""
    if last is None:
        return foundation.clean(fresh)
    both = fresh.withColumn("_old", F.lit(False)).unionByName(last.select(*fresh.columns).withColumn("_old", F.lit(True)))
    return foundation.clean(both).where(~F.col("_old")).drop("_old")


def _last(fresh: DataFrame, last: DataFrame | None) -> DataFrame:
    """The last raw fix of each track."""
    both = fresh if last is None else fresh.unionByName(last.select(*fresh.columns))
    return both.groupBy("track_id").agg(F.max_by(F.struct(*(c for c in fresh.columns if c != "track_id")), F.struct(*ORDER)).alias("f")).select("track_id", "f.*").select(*fresh.columns)


def _mark(fresh: DataFrame) -> list[int] | None:
    row = fresh.agg(F.max(F.struct(*ORDER)).alias("m")).first()["m"]
    return None if row is None else [int(row["data_time"]), int(row["id"])]


def _advance_runs(spark: SparkSession, folder: str, points: DataFrame, numbered: Rows, rows: Rows, key: str, buckets: int) -> DataFrame:
    """numbered: fixes with `run`, their run's number in the track; rows: the batch operator on fixes."""
    now = tables.manifest(folder)
    fresh = stored(_above(points, now and now.mark), "fresh")
    mark = _mark(fresh)
    if mark is not None or now is None:
        last = tables.read_beside(spark, folder, "last")
        usable = _cleaned(fresh, last).withColumn("_before", F.lit(None).cast("long"))
        carried = tables.read_beside(spark, folder, "open")
        usable = stored(usable if carried is None else usable.unionByName(carried.select(*usable.columns)), "usable")
        runs = stored(numbered(usable), "runs")
        # numbers go on from the runs closed before; the open run of a track is its last
        track = runs.groupBy("track_id").agg(F.max("run").alias("_open"), F.coalesce(F.max("_before"), F.lit(0)).alias("_closed"))
        met = runs.alias("r").join(track.alias("t"), F.col("r.track_id").eqNullSafe(F.col("t.track_id"))).where("run = _open")
        still = met.select(*(F.col(f"r.{c}") for c in usable.columns if c != "_before"), (F.col("_closed") + F.col("_open") - 1).alias("_before"))
        changed = rows(usable.drop("_before"))
        if "run" in changed.columns:
            shift = track.select(F.col("track_id").alias("_track"), "_closed")
            changed = changed.join(shift, F.col("track_id").eqNullSafe(F.col("_track")), "left").withColumn("run", F.col("run") + F.col("_closed")).drop("_track", "_closed")
        tables.update(spark, folder, changed, [key], tables.replacing([key]), mark, {"open": still, "last": _last(fresh, last)}, buckets)
    return tables.read(spark, folder)


def advance_segments(spark: SparkSession, folder: str, points: DataFrame, min_s: int = 10, buckets: int = 32) -> DataFrame:
    """The table at folder, brought up to points: the rows of behavior.transport_segments on clean points."""
    return _advance_runs(spark, folder, points, behavior.with_runs, lambda p: behavior.transport_segments(p, min_s), "segment_id", buckets)


def advance_stays(spark: SparkSession, folder: str, points: DataFrame, level: str = "town", min_s: int = 7200, buckets: int = 32) -> DataFrame:
    """The table at folder, brought up to points: the rows of behavior.admin_stays on clean points."""

    def numbered(p: DataFrame) -> DataFrame:
        named = previous(p.where(F.length(level) > 0), [level], "_b")
        return islands(named, F.col(level) != F.col(f"_b.{level}"), name="run").drop("_b")

    return _advance_runs(spark, folder, points, numbered, lambda p: behavior.admin_stays(p, level, min_s), "stay_id", buckets)


def _advance_totals(spark: SparkSession, folder: str, points: DataFrame, make: Rows, keys: list[str], combine: tables.Combine, buckets: int) -> DataFrame:
    now = tables.manifest(folder)
    fresh = stored(_above(points, now and now.mark), "fresh")
    mark = _mark(fresh)
    if mark is not None or now is None:
        last = tables.read_beside(spark, folder, "last")
        tables.update(spark, folder, make(_cleaned(fresh, last)), keys, combine, mark, {"last": _last(fresh, last)}, buckets)
    return tables.read(spark, folder)


def advance_cells(spark: SparkSession, folder: str, points: DataFrame, levels: tuple[int, ...] = spatial.LEVELS, buckets: int = 32) -> DataFrame:
    """The rows of spatial.grid_cells on clean points; the table at folder holds counts by finest tile and day, which add
    up, and from whose keys the distinct days of every level follow. levels are fixed by the first run."""
    keys, totals = ["x", "y", "day"], {"n": F.sum, "s": F.min, "e": F.max}
    counted = _advance_totals(spark, folder, points, lambda p: spatial.tile_days(p, max(levels)), keys, tables.adding(keys, totals), buckets)
    return spatial.cells_of_days(counted, levels)


def area_totals(points: DataFrame, zoom: int = 15, exact: bool = True) -> DataFrame:
    """By province, city, county and town: fixes, distance, times, the set of days, and the distinct tiles visited, as a set
    or (exact=False) as a theta sketch of bounded size. All of these merge."""
    tile = F.concat_ws("_", *spatial.tile(zoom))
    day = F.to_date(F.timestamp_seconds("data_time"))
    listed = F.array(*(F.struct(F.lit(c.upper()).alias("area_type"), F.col(c).alias("area_key")) for c in behavior.PLACES))
    own = points.groupBy(*behavior.PLACES, day.alias("day"), tile.alias("tile")).agg(F.count("*").alias("n"), F.sum("distance").alias("d"), F.min("data_time").alias("s"), F.max("data_time").alias("e"))
    wide = own.select("day", "tile", "n", "d", "s", "e", F.explode(listed).alias("a")).select("*", "a.*").where("area_key is not null and area_key != ''")
    cells = F.array_sort(F.collect_set("tile")) if exact else F.theta_sketch_agg("tile")
    return wide.groupBy("area_type", "area_key").agg(F.sum("n").alias("point_count"), F.sum("d").alias("total_distance"), F.min("s").alias("first_visit"), F.max("e").alias("last_visit"), F.array_sort(F.collect_set("day")).alias("days"), cells.alias("cells"))


def merged_areas(exact: bool = True) -> tables.Combine:
    """How two tables of area_totals become one."""
    cells = tables.union_of_sets if exact else tables.union_of_sketches
    totals = {"point_count": F.sum, "total_distance": F.sum, "first_visit": F.min, "last_visit": F.max, "days": tables.union_of_sets, "cells": cells}
    return tables.adding(["area_type", "area_key"], totals)


def advance_areas(spark: SparkSession, folder: str, points: DataFrame, zoom: int = 15, exact: bool = True, buckets: int = 32) -> DataFrame:
    """area_totals of clean points, brought up to new fixes, with the numbers of days and tiles in place of the sets."""
    keys = ["area_type", "area_key"]
    held = _advance_totals(spark, folder, points, lambda p: area_totals(p, zoom, exact), keys, merged_areas(exact), buckets)
    count = F.size("cells").cast("long") if exact else F.theta_sketch_estimate("cells")
    return held.select(*keys, "point_count", "total_distance", "first_visit", "last_visit", F.size("days").cast("long").alias("visit_days"), count.alias("distinct_cells"))
