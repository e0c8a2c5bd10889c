"""SQL for DuckDB that states what the queries of plans/queries.py return, built from common table expressions."""

from __future__ import annotations

from wayfold.sources.trace import points_sql


def hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))"
    return f"(2 * 6371000.0E0 * atan2(sqrt({h}), sqrt(greatest(1 - {h}, 0.0E0))))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d}) - radians({b})) * cos(radians({c}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b}))"
    return f"fmod(degrees(atan2({y}, {x})) + 360.0E0, 360.0E0)"


_B32 = "'0123456789bcdefghjkmnpqrstuvwxyz'"


def geohash(lat: str, lon: str, precision: int) -> str:
    bits = 5 * precision
    lon_bits, lat_bits = -(-bits // 2), bits // 2
    x = f"CAST(greatest(least(ceil(({lon} + 180.0E0) / 360.0E0 * {1 << lon_bits}) - 1, {(1 << lon_bits) - 1}), 0) AS BIGINT)"
    y = f"CAST(greatest(least(ceil(({lat} + 90.0E0) / 180.0E0 * {1 << lat_bits}) - 1, {(1 << lat_bits) - 1}), 0) AS BIGINT)"
    letters = []
    for k in range(precision):
        parts = []
        for j in range(5):
            place = 5 * k + j
            source, left = (x, lon_bits - 1 - place // 2) if place % 2 == 0 else (y, lat_bits - 1 - place // 2)
            parts.append(f"((({source}) >> {left}) & 1) * {1 << (4 - j)}")
        letters.append(f"substr({_B32}, CAST(1 + {' + '.join(parts)} AS BIGINT), 1)")
    return " || ".join(letters)


def tile(lat: str, lon: str, z: int) -> tuple[str, str]:
    x = f"CAST(floor(({lon} + 180.0E0) / 360.0E0 * {1 << z}) AS BIGINT)"
    y = f"CAST(floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * {1 << z}) AS BIGINT)"
    return x, y


def tile_id(lat: str, lon: str, z: int) -> str:
    x, y = tile(lat, lon, z)
    return f"'L{z}_' || {x} || '_' || {y}"


def ts(x: str) -> str:
    return f"to_timestamp({x}) AT TIME ZONE 'UTC'"


def entropy(w: str) -> str:
    return f"greatest(coalesce((ln(sum({w})) - sum({w} * ln({w})) / sum({w})) / ln(2), 0), 0)"


PLACES = "province, city, county, town"
CTES: dict[str, str] = {
    "points": "",
    "flagged": f"""SELECT *, accuracy > 100 AS r2, speed > 277.78 AS r1, coalesce(dt > 0 AND dt <= 10 AND hop >= 1000, FALSE) AS r3
  FROM (SELECT *, data_time - lag(data_time) OVER w AS dt, {hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} AS hop FROM points WINDOW w AS (PARTITION BY track_id ORDER BY data_time, id))""",
    "clean": "SELECT * FROM flagged WHERE NOT (r1 OR r2 OR r3)",
    "runs": f"""SELECT *, sum(b) OVER (PARTITION BY track_id ORDER BY data_time, id) AS run FROM (
  SELECT *, CASE WHEN pm = mode THEN 0 ELSE 1 END AS b, CASE WHEN pm = mode THEN {hav("plat", "plon", "lat", "lon")} ELSE 0 END AS step FROM (
    SELECT *, lag(mode) OVER w AS pm, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM (
      SELECT *, CASE WHEN speed < 2 THEN 'WALK' WHEN speed < 8 THEN 'BIKE' WHEN speed < 40 THEN 'CAR' WHEN speed < 60 THEN 'TRAIN' ELSE 'PLANE' END AS mode FROM clean)
    WINDOW w AS (PARTITION BY track_id ORDER BY data_time, id)))""",
    "seg": """SELECT first(id ORDER BY data_time, id) AS segment_id, track_id, run, mode, min(data_time) AS start_time, max(data_time) AS end_time, max(data_time) - min(data_time) AS duration_s,
    count(*) AS point_count, sum(step) AS distance_m, avg(speed) * 3.6 AS avg_speed_kmh, max(speed) * 3.6 AS max_speed_kmh, last(id ORDER BY data_time, id) AS end_id,
    first(lat ORDER BY data_time, id) AS start_lat, first(lon ORDER BY data_time, id) AS start_lon, last(lat ORDER BY data_time, id) AS end_lat, last(lon ORDER BY data_time, id) AS end_lon,
    first(province ORDER BY data_time, id) AS province, first(city ORDER BY data_time, id) AS city, first(county ORDER BY data_time, id) AS county, first(town ORDER BY data_time, id) AS town
  FROM runs GROUP BY track_id, run, mode HAVING max(data_time) - min(data_time) >= 10""",
    "townruns": """SELECT *, sum(CASE WHEN p = town THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY data_time, id) AS trun FROM (
    SELECT *, lag(town) OVER (PARTITION BY track_id ORDER BY data_time, id) AS p FROM clean)""",
    "stay0": f"""SELECT first(t.id ORDER BY t.data_time, t.id) AS stay_id, t.track_id, 'ADMIN_TOWN' AS stay_type, min(t.data_time) AS start_time, max(t.data_time) AS end_time, max(t.data_time) - min(t.data_time) AS duration_s,
    max(mla) AS center_lat, max(mlo) AS center_lon, max({hav("t.lat", "t.lon", "mla", "mlo")}) AS radius_m, count(*) AS point_count, least(1.0E0, count(*) / 10) AS confidence,
    first(province ORDER BY t.data_time, t.id) AS province, first(city ORDER BY t.data_time, t.id) AS city, first(county ORDER BY t.data_time, t.id) AS county, first(town ORDER BY t.data_time, t.id) AS town
  FROM townruns t JOIN (SELECT track_id, trun, avg(lat) AS mla, avg(lon) AS mlo FROM townruns GROUP BY ALL) USING (track_id, trun) GROUP BY t.track_id, t.trun""",
    "stay": f"""SELECT *, {geohash("round(center_lat, 7)", "round(center_lon, 7)", 6)} AS geohash6 FROM stay0 WHERE duration_s >= 7200 AND point_count >= 2""",
    "tripruns": """SELECT *, sum(CASE WHEN start_time - p <= 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY start_time, segment_id) AS trip FROM (
    SELECT *, lag(end_time) OVER (PARTITION BY track_id ORDER BY start_time, segment_id) AS p FROM seg)""",
    "trip": """SELECT *, row_number() OVER (PARTITION BY track_id, date ORDER BY start_time, trip_id) AS trip_number FROM (
    SELECT first(segment_id ORDER BY start_time, segment_id) AS trip_id, track_id, trip, CAST(to_timestamp(min(start_time)) AT TIME ZONE 'UTC' AS DATE) AS date, min(start_time) AS start_time, max(end_time) AS end_time,
      max(end_time) - min(start_time) AS duration_s, sum(distance_m) AS distance_m, count(*) AS segment_count, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes,
      string_agg(CAST(segment_id AS VARCHAR), ',' ORDER BY start_time, segment_id) AS segment_ids, first(city ORDER BY start_time, segment_id) AS origin_city, last(city ORDER BY start_time, segment_id) AS dest_city
    FROM tripruns GROUP BY track_id, trip)""",
    "cell0": " UNION ALL ".join(f"SELECT {z} AS level, {tile('lat', 'lon', z)[0]} AS x, {tile('lat', 'lon', z)[1]} AS y, data_time, id FROM clean" for z in (8, 10, 12, 15)),
    "cell": f"""SELECT 'L' || level || '_' || x || '_' || y AS grid_id, level, x, y, count(*) AS point_count, count(*) AS visit_count, count(DISTINCT CAST({ts("data_time")} AS DATE)) AS days, min(data_time) AS first_visit, max(data_time) AS last_visit,
    max(data_time) - min(data_time) AS duration_s FROM cell0 GROUP BY level, x, y""",
}
NEEDS = {"flagged": ["points"], "clean": ["flagged"], "runs": ["clean"], "seg": ["runs"], "townruns": ["clean"], "stay0": ["townruns"], "stay": ["stay0"], "tripruns": ["seg"], "trip": ["tripruns"], "cell0": ["clean"], "cell": ["cell0"]}


def sql(needs: str, select: str, track: str = "user_id % 4", more: dict[str, str] | None = None) -> str:
    """A statement with the common table expressions that it needs, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in ordered:
            ordered.append(name)

    for name in needs.split():
        add(name)
    parts = [points_sql(track) if n == "points" else f"{n} AS ({CTES[n]})" for n in ordered]
    parts += [f"{n} AS ({s})" for n, s in (more or {}).items()]
    return ("WITH RECURSIVE " if {"reach", "walk"} & set(more or {}) else "WITH ") + ",\n".join(parts) + "\n" + select


def clusters(eps_m: int, least: int) -> dict[str, str]:
    """Tables that end in `named`: clean points with the density cluster of each, or null."""
    return {
        "near": f"SELECT a.id AS a, b.id AS b FROM clean a JOIN clean b ON a.track_id = b.track_id AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {eps_m}",
        "core": f"SELECT a FROM near GROUP BY a HAVING count(*) >= {least}",
        "link": "SELECT near.a, near.b FROM near JOIN core ON near.a = core.a JOIN core d ON near.b = d.a",
        "reach": "SELECT a, min(b) AS l FROM link GROUP BY a UNION SELECT link.a, reach.l FROM reach JOIN link ON link.b = reach.a",
        "label": "SELECT a, min(l) AS l FROM reach GROUP BY a",
        "border": "SELECT near.a, min(l) AS l FROM near JOIN label ON near.b = label.a GROUP BY near.a",
        "named": "SELECT clean.*, coalesce(label.l, border.l) AS cluster FROM clean LEFT JOIN label ON label.a = id LEFT JOIN border ON border.a = id",
    }


def fan(source: str, areas: str, buckets: str, time: str = "data_time") -> str:
    """Rows of a table expression once per area and time bucket."""
    shown = {"year": f"strftime({ts(time)}, '%Y')", "month": f"strftime({ts(time)}, '%Y-%m')", "day": f"strftime({ts(time)}, '%Y-%m-%d')", "all": "''"}
    parts = [
        f"SELECT *, '{a.upper()}' AS area_type, {a} AS area_key, '{b}' AS bucket_type, {shown[b]} AS bucket_key FROM {source} WHERE {a} IS NOT NULL AND {a} <> ''"
        for a in areas.split()
        for b in buckets.split()
    ]
    return " UNION ALL ".join(parts)
