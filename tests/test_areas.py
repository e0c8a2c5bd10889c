"""Polygons with holes: shapefiles written and read, the index of cells, geocoding, against a ray by hand."""

import json
import random
import struct

import numpy as np
import pytest

from wayfold.operators import area_index, foundation
from wayfold.sources import shapefile
from wayfold.sources.areas import areas

NAMES = ["province", "city", "county", "town"]


def box(y, x, h, w, back=False):
    ring = [(y, x), (y, x + w), (y + h, x + w), (y + h, x)]
    return [{"lat": a, "lon": b} for a, b in (ring[::-1] if back else ring)]


def inside(y, x, rings):
    odd = False
    for ring in rings:
        for p, q in zip(ring, [ring[-1], *ring[:-1]]) if len(ring) >= 3 else ():
            if (p["lat"] > y) != (q["lat"] > y) and x < (q["lon"] - p["lon"]) * (y - p["lat"]) / (q["lat"] - p["lat"]) + p["lon"]:
                odd = not odd
    return odd


def star(rng, y, x, corners, size):
    angles = np.sort(np.array([rng.random() for _ in range(corners)])) * 2 * np.pi
    far = size * (0.4 + 0.6 * np.array([rng.random() for _ in range(corners)]))
    return [{"lat": float(y + r * np.sin(a)), "lon": float(x + r * np.cos(a))} for a, r in zip(angles, far)]


def shapes(rng):
    out = [
        ("A", [box(0.0, 0.0, 4.0, 4.0), box(1.0, 1.0, 2.0, 2.0, True), box(1.5, 1.5, 1.0, 1.0)]),  # on the cells' own lines
        ("B", [box(0.25, 4.0, 0.25, 0.25)]),
        ("C", [star(rng, 1.0, -3.0, 400, 2.5), star(rng, 1.0, -3.0, 60, 0.9)]),
        ("D", [star(rng, -7.0, 9.0, 7, 6.0), box(-7.1, 8.9, 0.2, 0.2)]),
        ("E", []),
        ("F", [[{"lat": 9.0, "lon": 9.0}, {"lat": 9.5, "lon": 9.5}]]),  # no area
        ("A2", [box(0.5, 0.5, 0.75, 3.0)]),  # over A and its hole
    ]
    return [(n, n.lower() + "é", None, "x" * 300 if n == "B" else "t", rings) for n, rings in out]


@pytest.fixture(scope="module")
def table(spark):
    kind = "province string, city string, county string, town string, rings " + shapefile.RINGS
    return spark.createDataFrame(shapes(random.Random(3)), kind)


@pytest.fixture(scope="module")
def places(spark):
    rng = random.Random(8)
    grid = [(y / 4, x / 4) for y in range(-4, 20) for x in range(-4, 20)]
    spread = [(rng.uniform(-14, 6), rng.uniform(-7, 16)) for _ in range(4000)] + [(1 + rng.uniform(-1, 1), -3 + rng.uniform(-1, 1)) for _ in range(1000)]
    rows = [(k, float(y), float(x), None, None, None, None) for k, (y, x) in enumerate(grid + spread)] + [(-1, None, 1.0, None, None, None, None), (-2, 0.5, 0.5, "own", "c", None, None)]
    return spark.createDataFrame(rows, "id long, lat double, lon double, province string, city string, county string, town string")


def wanted(places, rows):
    out = {}
    for r in places.collect():
        holds = [row[0] for row in rows if r["lat"] is not None and inside(r["lat"], r["lon"], row[4])]
        out[r["id"]] = r["province"] or min(holds, default=None)
    return out


@pytest.mark.parametrize("most", [1, 8, 1000])
def test_index_equals_ray(table, places, most):
    found = {r["id"]: r["province"] for r in foundation.reverse_geocode(places, table, most_edges=most).collect()}
    assert found == wanted(places, shapes(random.Random(3)))
    assert {found[-1], found[-2]} == {None, "own"} and len(set(found.values())) >= 6


def test_cells_split_where_edges_lie_and_stay_few_elsewhere():
    edges = area_index.edges_of([star(random.Random(1), 0.0, 0.0, 300, 20.0), star(random.Random(2), 1.1, 1.1, 900, 0.4)])
    cells = list(area_index.cells_of(edges, 16))
    assert {c[0] for c in cells} == {0, 1, 2} and max(len(c[4]) for c in cells if c[0] < 2) <= 16
    whole = [c for c in cells if not len(c[4])]
    assert whole and all(c[3] for c in whole) and len(cells) < 40 * len(edges)
    assert not list(area_index.cells_of(area_index.edges_of([]), 16))


def test_no_areas(table, places):
    rows = foundation.reverse_geocode(places, table.limit(0)).collect()
    assert {r["province"] for r in rows} == {None, "own"} and len(rows) == places.count()


def test_shapefile_round_trip_by_ranges(spark, table, places, tmp_path):
    folder = shapefile.write_shapefiles(table.repartition(2, "province"), str(tmp_path / "out"))
    assert sorted(f.suffix for f in (tmp_path / "out").iterdir() if f.name.startswith("part")) == [".cpg", ".cpg", ".dbf", ".dbf", ".shp", ".shp", ".shx", ".shx"]
    read = shapefile.shapes(spark, folder, records="2").collect()
    assert {r["record"] for r in read} == set(range(max(r["record"] for r in read) + 1)) and all(r["error"] is None for r in read)
    by = {r["attributes"]["province"]: r for r in read}
    for name, city, _, town, rings in shapes(random.Random(3)):
        got = [[(p["lat"], p["lon"]) for p in ring[:-1]] for ring in by[name]["rings"]]
        assert got == [[(p["lat"], p["lon"]) for p in ring] for ring in rings]
        assert by[name]["attributes"] == {"province": name, "city": city, "county": None, "town": town[:254]}
    back = shapefile.shapefile_areas(spark, folder, records="1")
    assert {r["id"]: r["province"] for r in foundation.reverse_geocode(places, back).collect()} == wanted(places, shapes(random.Random(3)))
    with pytest.raises(ValueError):
        shapefile.write_shapefiles(table.withColumnsRenamed({"city": "a_long_name_1", "town": "a_long_name_2"}), str(tmp_path / "no"))


def hand_written(folder, encoding, names, records, deleted=()):
    """A shapefile from the format's description: (rings of (x, y), or raw content) for each record."""
    shp, shx, at = b"", b"", 50
    for k, rec in enumerate(records):
        if not isinstance(rec, bytes):
            pts = [p for ring in rec for p in ring]
            xs, ys = [p[0] for p in pts], [p[1] for p in pts]
            starts = [sum(len(r) for r in rec[:i]) for i in range(len(rec))]
            rec = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(rec), len(pts)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        shp += struct.pack(">2i", k + 1, len(rec) // 2) + rec
        shx += struct.pack(">2i", at, len(rec) // 2)
        at += 4 + len(rec) // 2
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, at) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    rows = b"".join((b"*" if k in deleted else b" ") + n.encode(encoding).ljust(12) + b"  7" for k, n in enumerate(names))
    fields = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([12, 0]) + bytes(14) + b"N".ljust(11, b"\0") + b"N" + bytes(4) + bytes([3, 0]) + bytes(14)
    (folder / "t.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 1, 1, 1, len(names), 33 + len(fields), 16) + fields + b"\r" + rows + b"\x1a")
    (folder / "t.shp").write_bytes(head + shp)
    (folder / "t.shx").write_bytes(head + shx)


def test_shapefiles_of_others(spark, tmp_path):
    square = [[(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)], [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 0.5)]]
    records = [square, struct.pack("<i", 0), struct.pack("<i2d", 1, 1.0, 2.0), square, struct.pack("<i4d2i", 5, 0, 0, 1, 1, 9, 900)]
    hand_written(tmp_path, "gbk", ["镇", "null", "point", "gone", "cut"], records, deleted={3})
    (tmp_path / "t.cpg").write_text("GBK")
    rows = {r["record"]: r for r in shapefile.shapes(spark, str(tmp_path / "t.shp"), records="3", mode="permissive").collect()}
    assert sorted(rows) == [0, 1, 2, 4]
    assert rows[0]["attributes"] == {"NAME": "镇", "N": "7"} and [len(r) for r in rows[0]["rings"]] == [5, 4]
    assert rows[1]["rings"] == [] and "point" == rows[2]["attributes"]["NAME"] and "no polygon" in rows[2]["error"] and "do not fit" in rows[4]["error"]
    got = shapefile.shapefile_areas(spark, str(tmp_path), {"town": "NAME"}, mode="permissive").collect()
    assert [(r["town"], r["province"], len(r["rings"])) for r in got] == [("镇", None, 2)]
    with pytest.raises(Exception, match="no polygon"):
        shapefile.shapes(spark, str(tmp_path)).collect()
    hand_written(tmp_path, "latin-1", ["é"], [square])
    (tmp_path / "t.cpg").unlink()
    assert shapefile.shapes(spark, str(tmp_path), encoding="latin-1").first()["attributes"]["NAME"] == "é"


def test_holes_in_geojson(spark, tmp_path):
    def ring(y, x, s):
        return [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]

    geometry = {"type": "Polygon", "coordinates": [ring(0, 0, 6), ring(1, 1, 4), ring(2, 2, 2)]}
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"city": "c"}, "geometry": geometry}]}))
    rows = [(k, v, v, None, None, None, None) for k, v in enumerate([0.5, 1.5, 2.5, 5.5, 7.0])]
    points = spark.createDataFrame(rows, "id long, lat double, lon double, province string, city string, county string, town string")
    found = foundation.reverse_geocode(points, areas(spark, str(tmp_path / "a.json"))).orderBy("id").collect()
    assert [r["city"] for r in found] == ["c", None, "c", "c", None]
