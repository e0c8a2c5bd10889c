"""Points that lie on edges, up to rounding, get the answer of a ray held against all edges."""

from wayfold.operators import area_index, foundation
from wayfold.plans.query_geometry import CORNERS, SCALES


def test_points_on_edges_equal_ray(spark):
    from pyspark.sql import functions as F

    rows = []
    for k in range(25):
        lat, lon = 22.0 + 0.41 * (k % 5) + 0.2, 113.0 + 0.61 * (k // 5) + 0.3
        rows.append((f"n{k}", [[{"lat": lat + dy * s, "lon": lon + dx * s} for dy, dx in CORNERS] for s in SCALES]))
    areas = spark.createDataFrame(rows, "city string, rings array<array<struct<lat:double,lon:double>>>").select(F.lit("p").alias("province"), "city", *(F.lit(None).cast("string").alias(c) for c in ("county", "town")), "rings")
    spots = []
    for _, rings in rows:
        for y1, x1, y2, x2 in area_index.edges_of(rings).tolist():
            spots += [(y1 + (y2 - y1) * t / 64, x1 + (x2 - x1) * t / 64) for t in range(64)]
            east = (max(x1, x2) // 0.03125) * 0.03125  # where an edge meets a line between cells
            if x1 != x2 and min(x1, x2) < east:
                spots.append((y1 + (east - x1) * (y2 - y1) / (x2 - x1), east - 0.01))
    points = spark.createDataFrame([(k, y, x) for k, (y, x) in enumerate(spots)], "id long, lat double, lon double")
    points = points.select("*", *(F.lit(None).cast("string").alias(c) for c in ("province", "city", "county", "town")))

    def ray(y, x):
        holds = []
        for name, rings in rows:
            hits = sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for y1, x1, y2, x2 in area_index.edges_of(rings).tolist())
            holds += [name] if hits % 2 else []
        return min(holds, default=None)

    found = {r["id"]: r["city"] for r in foundation.reverse_geocode(points, areas, most_edges=4).collect()}
    assert found == {k: ray(*p) for k, p in enumerate(spots)}
