"""Density clustering of points (DBSCAN) as joins on grid cells and rounds of label spreading.

Points at one place are one node with a weight. Cells have a diagonal below eps, so all points of a cell are neighbours:
in a cell that weighs min_samples or more every point is core. Core points of a cell are one node, so labels spread over
cells. Places of other cells, fewer than min_samples in each, are held against those around them by an equi-join of tiles
of several cells (near_places). Whether two full cells touch is settled by one near pair of places, searched in two trees at
once (full_links), so no two dense cells are compared place by place.

Tables here grow with the input and their files are small for what they hold in memory, so joins are told not to broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.plans.storage import stored

#: Cells to each side that can hold neighbours: eps is at most 1.5 cell diagonals.
_REACH = 2
#: Distances eps to a side of the tiles in which places meet.
_TILE = 4
#: Depth at which nodes of places that a float hardly parts are no more divided.
_DEEPEST = 20
#: Corners that a task holds before it hands them on.
_CORNERS = 100_000
#: Parts of a cluster's points when each is measured from the centre.
_PARTS = 16


def _join(left: DataFrame, right: DataFrame, on: object, how: str = "inner") -> DataFrame:
    return left.join(right.hint("merge"), on, how)


def spread_labels(edges: DataFrame, node: str = "a", other: str = "b") -> DataFrame:
    """(node, label): the least node of each connected component of undirected edges; rounds are written as tables.

    In each round a node goes over to that of its neighbours and itself which a hash of the round puts first, and edges
    between nodes that fell together vanish. So tables shrink from round to round; the nodes' ways are followed at the end.
    """
    u, v = F.col(node), F.col(other)
    edges = stored(edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct(), "edges")
    moves: list[DataFrame] = []
    while not moves or not edges.isEmpty():

        def first(name: str, n: int = len(moves)) -> Column:
            return F.struct(F.xxhash64(F.col(name), F.lit(n)).alias("h"), F.col(name).alias("n"))

        both = edges.select("u", "v").union(edges.select("v", "u"))
        move = both.groupBy("u").agg(F.min(first("v")).alias("m")).select("u", F.least(first("u"), F.col("m"))["n"].alias("to"))
        moves.append(stored(move, "moves"))
        one, two = moves[-1].withColumnRenamed("to", "a"), moves[-1].select(F.col("u").alias("v"), F.col("to").alias("b"))
        gone = _join(_join(edges, one, "u"), two, "v").where("a != b")
        edges = stored(gone.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    ends = moves.pop()
    while moves:
        move, after = moves.pop(), ends.select(F.col("u").alias("to"), F.col("to").alias("end"))
        ends = stored(_join(move, after, "to", "left").select("u", F.coalesce("end", "to").alias("to")), "ends")
    least = ends.groupBy("to").agg(F.min("u").alias("label"))
    return stored(_join(ends, least, "to").select(F.col("u").alias("node"), "label"), "labels")


def near_places(left: DataFrame, right: DataFrame, eps_m: float, on: str = "t") -> DataFrame:
    """Pairs of rows of one `on` within eps_m: right columns, and left ones with a following underscore. Both have lat and lon.

    Right rows lie in tiles of a few eps to a side; a left row goes to the tiles that its reach touches, mostly one or two.
    """
    high = _TILE * eps_m / geo.METRES_A_DEGREE
    up = math.degrees(eps_m / geo.EARTH_M) * (1 + 1e-9)

    def wide(band: Column) -> Column:
        return F.lit(high) / F.cos(F.radians(F.least(F.abs(band), F.abs(band + 1)) * high))

    lat, lon = F.col("lat"), F.col("lon")
    narrow = F.cos(F.radians(lat)) * F.cos(F.radians(F.least(F.abs(lat) + up, F.lit(90.0))))
    aside = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.lit(math.sin(eps_m / geo.EARTH_M / 2)) / F.sqrt(narrow)))) * (1 + 1e-9)
    reach = left.withColumn("_y", F.explode(F.sequence(F.floor((lat - up) / high), F.floor((lat + up) / high))))
    reach = reach.withColumn("_x", F.explode(F.sequence(F.floor((lon - aside) / wide(F.col("_y"))), F.floor((lon + aside) / wide(F.col("_y"))))))
    reach = reach.select(on, "_y", "_x", *(F.col(c).alias(f"{c}_") for c in left.columns if c != on))
    tiled = right.withColumn("_y", F.floor(lat / high)).withColumn("_x", F.floor(lon / wide(F.col("_y"))))
    near = (F.abs(F.col("lat") - F.col("lat_")) <= up) & (geo.haversine("lat_", "lon_", "lat", "lon") <= eps_m)
    return _join(reach, tiled, [on, "_y", "_x"]).where(near)


def _quarters(inner: DataFrame, depth: int, name: str) -> DataFrame:
    """The nodes of a depth that hold places (cv, cu), by their parents (v, u)."""
    size = float(4**depth)
    own = inner.select(F.col("head").alias(name), F.floor(F.col("v") * size).alias(f"{name}cv"), F.floor(F.col("u") * size).alias(f"{name}cu")).distinct()
    return own.withColumn(f"{name}v", F.floor(F.col(f"{name}cv") / 4)).withColumn(f"{name}u", F.floor(F.col(f"{name}cu") / 4))


def _at(inner: DataFrame, depth: int, name: str) -> DataFrame:
    """The places of all nodes of a depth."""
    size = float(4**depth)
    return inner.select(F.col("head").alias(name), F.floor(F.col("v") * size).alias(f"{name}v"), F.floor(F.col("u") * size).alias(f"{name}u"), F.col("lat").alias(f"{name}lat"), F.col("lon").alias(f"{name}lon"))


def full_links(full: DataFrame, eps_m: float, side: float, width: Callable[[Column], Column]) -> DataFrame:
    """Pairs (a, b) of heads of full cells of which some two places lie within eps_m: places (t, y, x, id, lat, lon, head).

    A pair of cells needs one near pair of places, so cells are held against each other in rounds, as two trees at once. A
    pair of nodes is settled if its first places are near, if its boxes lie wholly near, or wholly apart; only the others
    go on to their sixteen quarters of quarters, and only while their cells have not been found near. Distances between
    boxes are bounds of the great-circle distance. So few places are compared, however many a cell holds.
    """
    metres = geo.METRES_A_DEGREE
    inner = full.select("t", "y", "x", "head", "id", "lat", "lon", (F.col("lat") * metres / side - F.col("y")).alias("v"), (F.col("lon") / width(F.col("y")) - F.col("x")).alias("u"))
    inner = stored(inner, "full")

    def nodes(depth: int, name: str) -> DataFrame:
        """Nodes of a depth: their cell, place in it, box, first place, and number of places."""
        size = float(4**depth)
        cut = inner.withColumn("_v", F.floor(F.col("v") * size)).withColumn("_u", F.floor(F.col("u") * size))
        box = [F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.min_by(F.struct("lat", "lon"), "id").alias("p"), F.count("*").alias("k")]
        kept = cut.groupBy("head", "_v", "_u").agg(*box).select("head", "_v", "_u", F.struct("s", "n", "w", "e", "p", "k").alias("node"))
        return kept.toDF(name, f"{name}v", f"{name}u", f"{name}n")

    def half(x: Column) -> Column:
        return F.pow(F.sin(F.radians(x) / 2), 2)

    def apart(a: Column, b: Column, farthest: bool) -> Column:
        """A bound in metres of the distance between any places of two boxes."""
        if farthest:
            dy, dx = F.greatest(a["n"], b["n"]) - F.least(a["s"], b["s"]), F.greatest(a["e"], b["e"]) - F.least(a["w"], b["w"])
            narrow = F.when((F.least(a["s"], b["s"]) <= 0) & (F.greatest(a["n"], b["n"]) >= 0), 0.0).otherwise(F.least(*(F.abs(x[c]) for x in (a, b) for c in ("s", "n"))))
        else:
            zero = F.lit(0.0)
            dy, dx = F.greatest(a["s"] - b["n"], b["s"] - a["n"], zero), F.greatest(a["w"] - b["e"], b["w"] - a["e"], zero)
            narrow = F.greatest(*(F.abs(x[c]) for x in (a, b) for c in ("s", "n")))
        h = half(dy) + F.pow(F.cos(F.radians(narrow)), 2) * half(dx)
        return 2 * geo.EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))

    cells = inner.groupBy("t", "y", "x", "head").agg(F.min("lon").alias("w"), F.max("lon").alias("e"))
    around = cells.withColumn("ny", F.explode(F.transform(F.sequence(F.lit(-_REACH), F.lit(_REACH)), lambda j: F.col("y") + j)))
    columns = F.sequence(F.floor(F.col("w") / width(F.col("ny"))) - _REACH - 1, F.floor(F.col("e") / width(F.col("ny"))) + _REACH + 1)
    around = around.select("t", F.col("ny").alias("y"), F.explode(columns).alias("x"), F.col("head").alias("a"))
    met = _join(around, cells.select("t", "y", "x", F.col("head").alias("b")), ["t", "y", "x"]).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    zero = F.lit(0).cast("long")
    open_pairs = stored(met.select("a", zero.alias("av"), zero.alias("au"), "b", zero.alias("bv"), zero.alias("bu")), "open")
    found, depth = open_pairs.select("a", "b").limit(0), 0
    while not open_pairs.isEmpty():
        one, two = nodes(depth, "a"), nodes(depth, "b")
        both = _join(_join(open_pairs, one, ["a", "av", "au"]), two, ["b", "bv", "bu"])
        x, y = F.col("an"), F.col("bn")
        first = geo.haversine(x["p"]["lat"], x["p"]["lon"], y["p"]["lat"], y["p"]["lon"]) <= eps_m
        near = first | (apart(x, y, True) <= eps_m * (1 - 1e-9))
        over = (apart(x, y, False) > eps_m * (1 + 1e-9)) | ((x["k"] == 1) & (y["k"] == 1))
        judged = stored(both.select("a", "av", "au", "b", "bv", "bu", near.alias("near"), over.alias("over")), "judged")
        found = found.union(judged.where("near").select("a", "b"))
        left = _join(judged.where("not near and not over"), judged.where("near").select("a", "b").distinct(), ["a", "b"], "left_anti")
        if depth == _DEEPEST:  # places closer than a float can part: the few that are left, one by one
            last = _join(_join(left, _at(inner, depth, "a"), ["a", "av", "au"]), _at(inner, depth, "b"), ["b", "bv", "bu"])
            return found.union(last.where(geo.haversine("alat", "alon", "blat", "blon") <= eps_m).select("a", "b")).distinct()
        depth += 1
        quarters = _join(_join(left, _quarters(inner, depth, "a"), ["a", "av", "au"]), _quarters(inner, depth, "b"), ["b", "bv", "bu"])
        open_pairs = stored(quarters.select("a", F.col("acv").alias("av"), F.col("acu").alias("au"), "b", F.col("bcv").alias("bv"), F.col("bcu").alias("bu")), "open")
    return found.distinct()


def density_clusters(points: DataFrame, eps_m: float, min_samples: int, key: str = "id", partition: str = "track_id") -> DataFrame:
    """points with cluster (the least core point's key in its cluster; null for noise), by partition.

    A point is core with min_samples points, itself included, within eps_m. Core points within eps_m of one another
    share a cluster; another point within eps_m of core points joins the least of their clusters. Needs latitudes away
    from the poles.
    """
    side = eps_m / 1.5
    metres = geo.METRES_A_DEGREE

    def width(band: Column) -> Column:
        """Degrees of longitude of a cell: one width for a whole band of cells, taken where it is narrowest in degrees."""
        middle = F.least(F.abs(band), F.abs(band + 1)) * side / metres
        return F.lit(side) / (metres * F.cos(F.radians(middle)))

    place = ["t", "lat", "lon"]
    p = points.select(F.col(partition).alias("t"), F.col(key).alias("id"), "lat", "lon").groupBy(*place).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    p = p.withColumn("y", F.floor(F.col("lat") * metres / side)).withColumn("x", F.floor(F.col("lon") / width(F.col("y"))))
    p = stored(p, "places")
    cells = p.groupBy("t", "y", "x").agg(F.sum("n").alias("weight"), F.min("id").alias("head"))
    p = stored(_join(p, cells, ["t", "y", "x"]).withColumn("full", F.col("weight") >= min_samples).drop("weight"), "cells")
    full, loose = p.where("full"), p.where("not full")
    counts = near_places(loose.select("t", "lat", "lon", "id"), p.select("t", "lat", "lon", "n"), eps_m).groupBy(F.col("id_").alias("id")).agg(F.sum("n").alias("near"))
    weighed = _join(loose, counts, "id").withColumn("core", F.col("near") >= min_samples)
    # fewer than min_samples rows a cell; the node of its core points is their least
    own = F.when(F.col("core"), F.min(F.when(F.col("core"), F.col("id"))).over(Window.partitionBy("t", "y", "x")))
    columns = ["t", "y", "x", "lat", "lon", "id", "full", "core", "head"]
    p = stored(full.withColumn("core", F.lit(True)).select(*columns).union(weighed.withColumn("head", own).select(*columns)), "cores")
    full, loose, core = p.where("full"), p.where("not full"), p.where("core")
    met = near_places(loose.select("t", "lat", "lon", "id", "core", "head"), core.select("t", "lat", "lon", "head"), eps_m)
    pairs = met.select(F.when(F.col("core_"), F.col("head_")).otherwise(F.col("id_")).alias("a"), F.col("head").alias("b"), F.col("core_").alias("core"))
    pairs = stored(pairs.where("a != b").distinct(), "pairs")
    alone = core.where("id = head").select(F.col("head").alias("a"), F.col("head").alias("b"))
    labels = spread_labels(pairs.where("core").select("a", "b").union(alone).union(full_links(full, eps_m, side, width)))
    named = _join(core, labels.withColumnRenamed("node", "head"), "head").select("t", "lat", "lon", "label")
    borders = _join(pairs.where("not core"), labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("label"))
    named = named.union(_join(p.where("not core"), borders, "id").select("t", "lat", "lon", "label"))
    found = stored(named.select(F.col("t").alias("_t"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("label").alias("cluster")), "found")
    same = points[partition].eqNullSafe(found["_t"]) & (points["lat"] == found["_lat"]) & (points["lon"] == found["_lon"])
    return _join(points, found, same, "left").drop("_t", "_lat", "_lon")


def convex_hull(places: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of (lat, lon) rows, in turn; the ends alone where all lie on one line."""
    rows = np.unique(places, axis=0)
    if len(rows) < 3:
        return rows

    def side(points: list[list[float]]) -> list[list[float]]:
        kept: list[list[float]] = []
        for p in points:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) <= (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]):
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return np.array(side(rows.tolist()) + side(rows[::-1].tolist()))


def hull_areas(points: DataFrame) -> DataFrame:
    """(cluster, hull_deg2): the convex hull's area in square degrees of each cluster of (cluster, lat, lon) rows.

    Every task keeps only the corners that it has seen so far, by cluster; the corners of all tasks make the hull.
    """
    kind = points.schema["cluster"].dataType.simpleString()

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}

        def handed() -> pa.RecordBatch:
            keys = [k for k, h in held.items() for _ in h]
            both = np.vstack([*held.values()])
            return pa.record_batch({"cluster": pa.array(keys, type_), "lat": pa.array(both[:, 0]), "lon": pa.array(both[:, 1])})

        for batch in batches:
            type_ = batch.schema.field("cluster").type
            for key, rows in batch.to_pandas().groupby("cluster"):
                places = rows[["lat", "lon"]].to_numpy()
                held[key] = convex_hull(np.vstack([held[key], places]) if key in held else places)
            if sum(map(len, held.values())) > _CORNERS:
                yield handed()
                held.clear()
        if held:
            yield handed()

    def area(table: pa.Table) -> pa.Table:
        hull = convex_hull(np.column_stack([table["lat"].to_numpy(), table["lon"].to_numpy()]))
        x, y = (hull - hull[0]).T
        size = abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2
        return pa.table({"cluster": table["cluster"].combine_chunks()[:1], "hull_deg2": [size]})

    some = points.select("cluster", "lat", "lon").mapInArrow(corners, f"cluster {kind}, lat double, lon double")
    return some.groupBy("cluster").applyInArrow(area, f"cluster {kind}, hull_deg2 double")


def cluster_figures(clustered: DataFrame, eps_m: float, key: str = "id", partition: str = "track_id") -> DataFrame:
    """One row for each cluster of density_clusters: centre, points, days, density, type, radius, hull area, places of its first fix.

    A fix counts for a minute. Noise has no row; a cluster on one line has no area.
    """
    chosen = clustered.where("cluster is not null").select(partition, "cluster", key, "data_time", "lat", "lon", "province", "city", "county")
    p = stored(chosen, "clustered")
    order = F.struct("data_time", key)
    days = p.groupBy(partition, "cluster", F.floor(F.col("data_time") / 86_400).alias("day")).agg(
        F.count("*").alias("n"), F.sum("lat").alias("y"), F.sum("lon").alias("x"), F.min_by(F.struct("province", "city", "county"), order).alias("f"), F.min(order).alias("o")
    )
    whole = days.groupBy(partition, "cluster").agg(
        F.sum("n").alias("point_count"), F.count("*").alias("visit_count"), (F.sum("y") / F.sum("n")).alias("center_lat"), (F.sum("x") / F.sum("n")).alias("center_lon"), F.min_by("f", "o").alias("_f")
    )
    centres = whole.select("cluster", "center_lat", "center_lon", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).alias("part"))
    dealt = p.select("cluster", "lat", "lon", F.pmod(F.xxhash64(key), F.lit(_PARTS)).cast("int").alias("part"))
    reach = _join(dealt, centres, ["cluster", "part"]).groupBy("cluster").agg(F.max(geo.haversine("center_lat", "center_lon", "lat", "lon")).alias("radius_m"))
    hours = F.col("duration_s") / 3600 / F.col("visit_count")
    n = F.col("point_count")
    # fixed values: limits and names of the types, square kilometres of a square degree
    named = F.when((n > 1000) & (hours > 6), "HOME").when((n > 500) & (hours > 4), "WORK").when(n > 200, "FREQUENT").otherwise("OCCASIONAL")
    found = _join(_join(whole, reach, "cluster"), hull_areas(p), "cluster").withColumn("duration_s", n * 60)
    return found.select(
        partition, "cluster", "center_lat", "center_lon", "point_count", "visit_count", "duration_s", (n / (eps_m / 1000) ** 2).alias("density_score"), named.alias("cluster_type"), "radius_m",
        (F.col("hull_deg2") * 111 * 111).alias("convex_hull_area_km2"), "_f.province", "_f.city", "_f.county", F.least(F.lit(1.0), n / 50).alias("confidence"),
    )
