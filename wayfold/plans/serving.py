"""Read queries over the operators' tables: optional filters, a choice of orders, limits and pages.

A View declares what may be asked of a table; `serve` turns a request into filters, an order with a unique last key, and
a limit, which Spark pushes down and plans as a top-k. A filter that is None, 0 or empty is not applied.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class View:
    #: name of a filter -> (column, operator); operators: = >= <= > < in, or "any" for one of several columns (comma-separated)
    filters: dict[str, tuple[str, str]]
    #: name of an order -> columns, a leading minus for descending; the first is the default
    orders: dict[str, tuple[str, ...]]
    limit: int = 100
    most: int = 1000
    #: what always holds, and filters that apply unless the request says otherwise
    where: str = ""
    defaults: dict[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    page: int
    size: int

    @property
    def pages(self) -> int:
        return -(-self.total // self.size)


def _condition(columns: str, operator: str, value: object) -> Column:
    c = F.col(columns.split(",")[0])
    if operator == "any":
        return F.lit(value).isin(*(F.col(x) for x in columns.split(",")))
    if operator == "in":
        return c.isin(*value) if isinstance(value, (list, tuple)) else c == value
    return {"=": c == value, ">=": c >= value, "<=": c <= value, ">": c > value, "<": c < value}[operator]


def _order(name: str) -> Column:
    """Nulls come last in both directions."""
    return F.col(name[1:]).desc_nulls_last() if name.startswith("-") else F.col(name).asc_nulls_last()


def select(df: DataFrame, view: View, **asked: object) -> DataFrame:
    """The rows that a request's filters leave."""
    if unknown := set(asked) - set(view.filters):
        raise ValueError(f"no such filter: {', '.join(sorted(unknown))}")
    out = df.where(view.where) if view.where else df
    for name, value in {**view.defaults, **asked}.items():
        if value not in (None, "", 0, 0.0):
            out = out.where(_condition(*view.filters[name], value))
    return out


def serve(df: DataFrame, view: View, order: str = "", limit: int = 0, page: int = 1, **asked: object) -> DataFrame:
    """One page of a request's rows. An unknown order is the default; limits are clamped."""
    keys = view.orders.get(order, next(iter(view.orders.values())))
    size = min(max(limit, 0) or view.limit, view.most)
    out = select(df, view, **asked).orderBy(*map(_order, keys))
    return (out.offset((max(page, 1) - 1) * size) if page > 1 else out).limit(size)


def serve_page(df: DataFrame, view: View, order: str = "", limit: int = 0, page: int = 1, **asked: object) -> Page:
    """A page with the number of all rows that the filters leave (one more pass over them)."""
    size = min(max(limit, 0) or view.limit, view.most)
    return Page(serve(df, view, order, limit, page, **asked), select(df, view, **asked).count(), max(page, 1), size)


_TIMES = {"start": ("start_time", ">="), "end": ("end_time", "<=")}
_AREA = {"bucket_type": ("bucket_type", "="), "bucket_key": ("bucket_key", "="), "area_type": ("area_type", "="), "area_key": ("area_key", "=")}
_KEY = ("area_type", "area_key", "bucket_type", "bucket_key")
_PLACES = {p: (p, "=") for p in ("province", "city", "county")}
_ALL = {"bucket_type": "all"}

VIEWS = {
    "track_points": View({"start": ("data_time", ">="), "end": ("data_time", "<="), **_PLACES, "min_speed": ("speed", ">="), "max_speed": ("speed", "<="), "id": ("id", "=")}, {"": ("-data_time", "-id")}),
    "ungeocoded": View({}, {"": ("data_time", "id")}, 1000, 10_000, "province is null or province = ''"),
    "segments": View({"mode": ("mode", "="), **_TIMES, **_PLACES, "min_distance": ("distance_m", ">="), "min_duration": ("duration_s", ">="), "min_confidence": ("confidence", ">="), "id": ("segment_id", "=")}, {"": ("-start_time", "-segment_id")}),
    "stays": View({"type": ("stay_type", "="), **_TIMES, **_PLACES, "min_duration": ("duration_s", ">="), "min_confidence": ("confidence", ">="), "id": ("stay_id", "=")}, {"": ("-start_time", "-stay_id")}),
    "trips": View({**_TIMES, "origin_city": ("origin_city", "="), "dest_city": ("dest_city", "="), "min_distance": ("distance_m", ">="), "mode": ("primary_mode", "="), "purpose": ("purpose", "="), "id": ("trip_id", "=")}, {"": ("-start_time", "-trip_id")}),
    "footprint": View({"stat_type": ("area_type", "="), "time_range": ("bucket_type", "="), "key": ("bucket_key", "=")}, {"points": ("-point_count", *_KEY), "visits": ("-visit_days", *_KEY), "distance": ("-total_distance", *_KEY), "duration": ("-duration_s", *_KEY)}, defaults={"stat_type": "PROVINCE", "time_range": "all"}),
    "stay_statistics": View({"stat_type": ("area_type", "="), "time_range": ("bucket_type", "="), "key": ("bucket_key", "=")}, {"count": ("-stay_count", *_KEY), "duration": ("-total_duration", *_KEY)}, defaults={"stat_type": "PROVINCE", "time_range": "all"}),
    "extreme_events": View({"type": ("event_type", "="), "category": ("event_category", "=")}, {"": ("rank", "-value", "trip_id", "event_type")}, 50, 100),
    "admin_crossings": View({"type": ("crossing_type", "="), "from_region": ("from_province,from_city,from_county,from_town", "any"), "to_region": ("to_province,to_city,to_county,to_town", "any"), "start": ("crossing_time", ">="), "end": ("crossing_time", "<=")}, {"": ("-crossing_time", "-crossing_id")}),
    "admin_view": View({"level": ("level", "="), "name": ("name", "="), "parent": ("parent", "=")}, {"visits": ("-visit_count", "level", "name", "parent"), "duration": ("-duration_s", "level", "name", "parent"), "days": ("-unique_days", "level", "name", "parent"), "distance": ("-total_distance", "level", "name", "parent")}, 50),
    "speed_space": View(_AREA, {"": ("-avg_speed", *_KEY)}, defaults=_ALL),
    "high_speed_zones": View(_AREA, {"": ("-avg_speed", *_KEY)}, 10, where="is_high_speed", defaults=_ALL),
    "slow_life_zones": View(_AREA, {"": ("avg_speed", *_KEY)}, 10, where="is_slow_life", defaults=_ALL),
    "directional_bias": View({**_AREA, "mode": ("mode", "=")}, {"": ("-total_distance", *_KEY, "mode"), "concentration": ("-concentration", *_KEY, "mode"), "bidirectional": ("-bidirectional_score", *_KEY, "mode")}, defaults={**_ALL, "mode": "ALL"}),
    "revisit_patterns": View({"min_visits": ("visit_count", ">=")}, {"": ("-strength", "geohash6")}, defaults={"min_visits": 2}),
    "habitual_places": View({"min_visits": ("visit_count", ">=")}, {"": ("-strength", "geohash6")}, where="is_habitual", defaults={"min_visits": 5}),
    "periodic_places": View({"min_visits": ("visit_count", ">=")}, {"": ("-strength", "geohash6")}, where="is_periodic", defaults={"min_visits": 3}),
    "utilization": View({k: _AREA[k] for k in ("area_type", "area_key")}, {"": ("-utilization_efficiency", "area_type", "area_key")}),
    "destinations": View({k: _AREA[k] for k in ("area_type", "area_key")}, {"": ("-utilization_efficiency", "area_type", "area_key")}, where="utilization_efficiency > 10 and transit_dominance < 0.3"),
    "corridors": View({k: _AREA[k] for k in ("area_type", "area_key")}, {"": ("-transit_dominance", "area_type", "area_key")}, where="transit_dominance > 0.7 and utilization_efficiency < 1"),
    "deep_engagement": View({k: _AREA[k] for k in ("area_type", "area_key")}, {"": ("-area_depth", "area_type", "area_key")}, where="area_depth > 20"),
    "density": View({"density_level": ("density_level", "=")}, {"": ("-score", "grid_id")}),
    "density_clusters": View({"type": ("cluster_type", "="), **_PLACES, "track": ("track_id", "=")}, {"": ("-convex_hull_area_km2", "track_id", "cluster"), "points": ("-point_count", "track_id", "cluster")}),
    "altitude": View({k: _AREA[k] for k in ("area_type", "area_key")}, {"span": ("-altitude_span", "area_type", "area_key"), "intensity": ("-vertical_intensity", "area_type", "area_key")}),
    "highest_spans": View({k: _AREA[k] for k in ("area_type", "area_key")}, {"": ("-altitude_span", "area_type", "area_key")}, where="altitude_span > 0"),
    "highest_intensity": View({k: _AREA[k] for k in ("area_type", "area_key")}, {"": ("-vertical_intensity", "area_type", "area_key")}, where="vertical_intensity > 0"),
    "compression": View(_AREA, {"": ("-time_compression_index", *_KEY)}),
    "most_intense": View(_AREA, {"": ("-movement_intensity", *_KEY)}, where="movement_intensity > 0"),
    "bursts": View(_AREA, {"": ("-burst_count", "-burst_intensity", *_KEY)}, where="burst_count > 0"),
    "time_slices": View({"slice_type": ("slice_type", "=")}, {"": ("slice_type", "slice_key")}),
    "weekly_pattern": View({}, {"": ("slice_key",)}, 168, 168, "slice_type = 'WEEKLY_HOURLY'"),
    "hourly_pattern": View({}, {"": ("slice_key",)}, 24, 24, "slice_type = 'HOURLY'"),
    "grid_cells": View({"level": ("level", "="), "min_lat": ("center_lat", ">="), "max_lat": ("center_lat", "<="), "min_lon": ("center_lon", ">="), "max_lon": ("center_lon", "<="), "min_density": ("point_count", ">=")}, {"": ("-point_count", "grid_id")}, 10_000, 10_000),
    "rendering": View({"min_lat": ("lat", ">="), "max_lat": ("lat", "<="), "min_lon": ("lon", ">="), "max_lon": ("lon", "<="), "start": ("data_time", ">="), "end": ("data_time", "<="), "mode": ("mode", "="), "lod": ("lod_level", "<=")}, {"": ("data_time", "id")}, 10_000, 50_000, defaults={"lod": 3}),
}


def footprint_summary(points: DataFrame) -> DataFrame:
    """One row: points, numbers of regions, and the sorted lists of the larger ones."""
    named = {p: F.when(F.length(p) > 0, F.col(p)) for p in ("province", "city", "county", "town")}
    lists = [F.array_sort(F.collect_set(named[p])).alias(f"{p}_list") for p in ("province", "city", "county")]
    seen = points.agg(F.count("*").alias("points"), *lists, F.count_distinct(named["town"]).alias("towns"))
    return seen.select("*", *(F.size(f"{p}_list").alias(n) for p, n in (("province", "provinces"), ("city", "cities"), ("county", "counties"))))


def time_distribution(points: DataFrame) -> DataFrame:
    return points.groupBy(F.hour(F.timestamp_seconds("data_time")).alias("hour")).agg(F.count("*").alias("points"))


def speed_distribution(points: DataFrame, edges: tuple[float, ...] = (10, 30, 60, 120)) -> DataFrame:
    """Counts by speed range, with the range's place in order."""
    band, low = F.lit(len(edges)), 0.0
    for k, e in reversed(list(enumerate(edges))):
        band = F.when(F.col("speed") < e, k).otherwise(band)
    names = []
    for e in edges:
        names.append(f"{low:g}-{e:g}")
        low = e
    names.append(f"{low:g}+")
    label = F.get(F.array(*map(F.lit, names)), F.col("band"))
    return points.where("speed > 0").withColumn("band", band).groupBy("band").agg(F.count("*").alias("points")).select("band", label.alias("speed_range"), "points")


def road_overlap_summary(roads: DataFrame) -> DataFrame:
    """By road type, and in all (road_type ALL)."""
    sums = roads.groupBy("road_type").agg(F.count("*").alias("segments"), F.sum("on_road_m").alias("on_road_m"), F.sum("off_road_m").alias("off_road_m"), F.sum("overlap_ratio").alias("_r"))
    whole = sums.agg(F.lit("ALL").alias("road_type"), *(F.sum(c).alias(c) for c in ("segments", "on_road_m", "off_road_m", "_r")))
    both = sums.unionByName(whole).where("segments > 0")
    return both.withColumn("avg_overlap_ratio", F.col("_r") / F.col("segments")).drop("_r")
