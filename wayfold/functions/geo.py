"""Geodesy, geohash, tiles and plane geometry as Column expressions. Angles in degrees, distances in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.plans.windows import running

EARTH_M = 6_371_000.0
#: Fixed value: the geohash alphabet.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
METRES_A_DEGREE = 111_320.0
#: Parts of a group's points when each is measured from the centre.
_PARTS = 16
#: A geohash cell's width in metres by precision 1 to 12.
GEOHASH_CELL_M = (5_000_000.0, 1_250_000.0, 156_000.0, 39_100.0, 4_890.0, 1_220.0, 153.0, 38.2, 4.77, 1.19, 0.149, 0.037)


def col(x: str | float | Column) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; null if any input is null."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0))))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, 0 to 360."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    y, x = F.sin(d - b) * F.cos(c), F.cos(a) * F.sin(c) - F.sin(a) * F.cos(c) * F.cos(d - b)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def destination(lat, lon, bearing_deg, distance_m) -> Column:
    """struct<lat, lon> reached from a point."""
    phi, lam, theta = (F.radians(col(x)) for x in (lat, lon, bearing_deg))
    delta = col(distance_m) / EARTH_M
    to = F.asin(F.sin(phi) * F.cos(delta) + F.cos(phi) * F.sin(delta) * F.cos(theta))
    over = lam + F.atan2(F.sin(theta) * F.sin(delta) * F.cos(phi), F.cos(delta) - F.sin(phi) * F.sin(to))
    return F.struct(F.degrees(to).alias("lat"), F.degrees(over).alias("lon"))


def midpoint(lat1, lon1, lat2, lon2) -> Column:
    """struct<lat, lon> half way on the great circle."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    x, y = F.cos(c) * F.cos(d - b), F.cos(c) * F.sin(d - b)
    lat = F.atan2(F.sin(a) + F.sin(c), F.sqrt(F.pow(F.cos(a) + x, 2) + F.pow(y, 2)))
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(b + F.atan2(y, F.cos(a) + x)).alias("lon"))


def angular_difference(a, b) -> Column:
    """Signed difference b - a in degrees, above -180 and up to 180."""
    d = F.pmod(col(b) - col(a) + 180.0, F.lit(360.0)) - 180.0
    return F.when(d == -180.0, 180.0).otherwise(d)


def bounding_box_area(min_lat, min_lon, max_lat, max_lon) -> Column:
    return haversine(min_lat, min_lon, min_lat, max_lon) * haversine(min_lat, min_lon, max_lat, min_lon)


def perpendicular_distance(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Distance of a point from the line through two others, on a plane with METRES_A_DEGREE."""
    x0, y0, x1, y1, x2, y2 = (col(v) for v in (lon, lat, lon1, lat1, lon2, lat2))
    dx, dy = x2 - x1, y2 - y1
    long = F.sqrt(dx * dx + dy * dy)
    away = F.abs(dy * x0 - dx * y0 + x2 * y1 - y2 * x1)
    point = F.sqrt(F.pow(x0 - x1, 2) + F.pow(y0 - y1, 2))
    return METRES_A_DEGREE * F.when(long > 0, F.try_divide(away, long)).otherwise(point)


def _bin(value: Column, low: float, span: float, bits: int) -> Column:
    """The half-open cell (low, high] of a value among 2**bits; the lowest value is in the first."""
    cell = F.ceil((value - low) / span * float(1 << bits)) - 1
    return F.greatest(F.least(cell, F.lit((1 << bits) - 1)), F.lit(0)).cast("long")


def geohash(lat, lon, precision: int) -> Column:
    """A point exactly on a dividing line belongs to the lower cell."""
    bits = 5 * precision
    lon_bits, lat_bits = -(-bits // 2), bits // 2
    x, y = _bin(col(lon), -180.0, 360.0, lon_bits), _bin(col(lat), -90.0, 180.0, lat_bits)
    letters = []
    for k in range(precision):
        index = F.lit(0).cast("long")
        for j in range(5):
            place = 5 * k + j
            source, left = (x, lon_bits - 1 - place // 2) if place % 2 == 0 else (y, lat_bits - 1 - place // 2)
            index = index * 2 + F.shiftright(source, left).bitwiseAND(F.lit(1))
        letters.append(F.substr(F.lit(GEOHASH_ALPHABET), (index + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def geohash_bounds(hash_) -> Column:
    """struct<min_lat, max_lat, min_lon, max_lon> of a geohash column."""
    letters = F.filter(F.split(col(hash_), ""), lambda c: c != "")
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("x"), zero.alias("y"), F.lit(0).alias("k"))

    def step(s: Column, letter: Column) -> Column:
        """A letter's five bits go to longitude and latitude in turn; an odd letter begins with latitude."""
        v = (F.instr(F.lit(GEOHASH_ALPHABET), letter) - 1).cast("long")

        def bit(n: int) -> Column:
            return F.shiftright(v, n).bitwiseAND(F.lit(1))

        three, two = bit(4) * 4 + bit(2) * 2 + bit(0), bit(3) * 2 + bit(1)
        even = s["k"] % 2 == 0
        x = F.when(even, s["x"] * 8 + three).otherwise(s["x"] * 4 + two)
        y = F.when(even, s["y"] * 4 + two).otherwise(s["y"] * 8 + three)
        return F.struct(x.alias("x"), y.alias("y"), (s["k"] + 1).alias("k"))

    def edges(s: Column) -> Column:
        wide, high = F.pow(F.lit(2.0), F.ceil(s["k"] * 2.5)), F.pow(F.lit(2.0), F.floor(s["k"] * 2.5))
        return F.struct(
            (s["y"] / high * 180.0 - 90.0).alias("min_lat"), ((s["y"] + 1) / high * 180.0 - 90.0).alias("max_lat"), (s["x"] / wide * 360.0 - 180.0).alias("min_lon"), ((s["x"] + 1) / wide * 360.0 - 180.0).alias("max_lon")
        )

    return F.aggregate(letters, start, step, edges)


def geohash_decode(hash_) -> Column:
    """struct<lat, lon> of the cell's middle."""
    b = geohash_bounds(hash_)
    return F.struct(((b["min_lat"] + b["max_lat"]) / 2).alias("lat"), ((b["min_lon"] + b["max_lon"]) / 2).alias("lon"))


def geohash_neighbours(hash_, precision: int) -> Column:
    """Distinct cells around a cell; latitude stops at the poles and longitude goes round."""

    def around(b: Column) -> Column:
        lat, lon = (b["min_lat"] + b["max_lat"]) / 2, (b["min_lon"] + b["max_lon"]) / 2
        high, wide = b["max_lat"] - b["min_lat"], b["max_lon"] - b["min_lon"]
        moved = [
            F.struct(F.greatest(F.least(lat + i * high, F.lit(90.0)), F.lit(-90.0)).alias("lat"), (F.pmod(lon + j * wide + 180.0, F.lit(360.0)) - 180.0).alias("lon"))
            for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j
        ]
        return F.transform(F.array(*moved), lambda p: geohash(p["lat"], p["lon"], precision))

    cells = F.flatten(F.transform(F.array(geohash_bounds(hash_)), around))
    return F.filter(F.array_distinct(cells), lambda c: c != col(hash_))


def geohash_cell_size(precision) -> Column:
    """Width in metres of a cell of this precision, null outside 1 to 12."""
    return F.get(F.array(*map(F.lit, GEOHASH_CELL_M)), col(precision).cast("int") - 1)


def geohash_precision_for(distance_m) -> Column:
    """The finest precision whose cells are at least this wide, 1 if none is."""
    out = F.lit(1)
    for precision, width in enumerate(GEOHASH_CELL_M, 1):
        out = F.when(col(distance_m) <= width, precision).otherwise(out)
    return out


def tile_x(lon, zoom: int) -> Column:
    return F.floor((col(lon) + 180.0) / 360.0 * float(1 << zoom)).cast("int")


def tile_y(lat, zoom: int) -> Column:
    """Web-Mercator row."""
    phi = F.radians(col(lat))
    return F.floor((1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * float(1 << zoom)).cast("int")


def tile_id(lat, lon, zoom: int) -> Column:
    return F.concat(F.lit(f"L{zoom}_"), tile_x(lon, zoom), F.lit("_"), tile_y(lat, zoom))


def tile_lon(x, size) -> Column:
    """West edge of column x among `size` columns."""
    return col(x) / col(size) * 360.0 - 180.0


def tile_lat(y, size) -> Column:
    """North edge of row y among `size` rows."""
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * col(y) / col(size)))))


def polygon_area(ring) -> Column:
    """Area of array<struct<lat, lon>> in square metres on a plane; 0 for fewer than three corners."""
    r = col(ring)
    after = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    crosses = F.zip_with(r, after, lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"])
    total = F.aggregate(crosses, F.lit(0.0), lambda s, c: s + c)
    return F.when(F.size(r) < 3, 0.0).otherwise(F.abs(total) / 2 * METRES_A_DEGREE * METRES_A_DEGREE)


def point_in_polygon(lat, lon, ring) -> Column:
    """Whether a ray from the point crosses the ring's edges an odd number of times."""
    r, y, x = col(ring), col(lat), col(lon)
    before = F.concat(F.slice(r, -1, 1), F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))))

    def crosses(p: Column, q: Column) -> Column:
        level = (p["lat"] > y) != (q["lat"] > y)
        return level & (x < F.try_divide((q["lon"] - p["lon"]) * (y - p["lat"]), q["lat"] - p["lat"]) + p["lon"])

    hits = F.zip_with(r, before, crosses)
    return (F.size(r) >= 3) & (F.size(F.filter(hits, lambda h: F.coalesce(h, F.lit(False)))) % 2 == 1)


def angular_difference_radians(a, b) -> Column:
    """Signed difference b - a in radians, above -pi and up to pi."""
    d = F.pmod(col(b) - col(a) + math.pi, F.lit(2 * math.pi)) - math.pi
    return F.when(d == -math.pi, math.pi).otherwise(d)


def centroid(lat, lon, weight=1.0) -> Column:
    """In an aggregation: struct<lat, lon>, the weighted mean place; the plain one where weights add up to 0."""
    w = col(weight)
    return F.struct(*(F.coalesce(F.try_divide(F.sum(col(x) * w), F.sum(w)), F.avg(col(x))).alias(n) for n, x in (("lat", lat), ("lon", lon))))


def bounding_box(lat, lon) -> Column:
    """In an aggregation: struct<min_lat, max_lat, min_lon, max_lon>."""
    return F.struct(*(f(col(x)).alias(f"{k}_{n}") for n, x in (("lat", lat), ("lon", lon)) for k, f in (("min", F.min), ("max", F.max))))


def hull_area(lat, lon) -> Column:
    """In an aggregation: the area of the points' bounding box, which stands for that of their hull."""
    return bounding_box_area(F.min(col(lat)), F.min(col(lon)), F.max(col(lat)), F.max(col(lon)))


def radius_of_gyration(points: DataFrame, group: list[str], weight=1.0, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """group, radius_m: the root of the (weighted) mean squared distance from the group's centroid."""
    w = col(weight)
    middle = points.groupBy(*group).agg(centroid(lat, lon, weight).alias("_c"))
    # each middle once for each part, so that the points of a large group are many tasks' work
    middle = middle.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    dealt = points.withColumn("_part", F.pmod(F.xxhash64(*points.columns), F.lit(_PARTS)).cast("int"))
    d = F.pow(haversine(lat, lon, "_c.lat", "_c.lon"), 2)
    return dealt.join(middle, [*group, "_part"]).groupBy(*group).agg(F.sqrt(F.coalesce(F.try_divide(F.sum(d * w), F.sum(w)), F.avg(d))).alias("radius_m"))


def paths(points: DataFrame, group: list[str], order: list[str], lat: str = "lat", lon: str = "lon", chunk_s: int | None = None) -> DataFrame:
    """group, path_m (along the points in order), line_m (first to last) and tortuosity (their ratio, 1 without a line).

    chunk_s: cut long groups into stretches of so many of the first of `order`, see windows.running."""
    before = F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    points = running(points, chunk_s, group, [F.col(c) for c in order], order[0], befores={"_before": before})
    hop = haversine("_before.lat", "_before.lon", lat, lon)
    place, at = F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon")), F.struct(*order)
    out = points.withColumn("_hop", hop).groupBy(*group).agg(F.coalesce(F.sum("_hop"), F.lit(0.0)).alias("path_m"), F.min_by(place, at).alias("_a"), F.max_by(place, at).alias("_b"))
    out = out.withColumn("line_m", haversine("_a.lat", "_a.lon", "_b.lat", "_b.lon")).drop("_a", "_b")
    return out.withColumn("tortuosity", F.when(F.col("line_m") > 0, F.col("path_m") / F.col("line_m")).otherwise(1.0))
