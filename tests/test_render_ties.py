"""Rendering hints where a run's mean speed equals a limit but for its last digits."""

from wayfold.operators import behavior, presentation


def test_a_mean_at_a_limit_does_not_depend_on_the_places_of_its_cells(spark):
    # 30 fixes in each of four cells; their mean is 25.58, which is also the limit of most buckets
    speeds, columns = (25.06, 25.06, 26.1, 26.1), "id long, track_id long, data_time long, lat double, lon double, speed double"
    rows = [(1000 * t + 30 * k + n, t, 30 * k + n, 22.0 + (37 * t + 11 * k) % 97 / 10, 113.0 + (53 * t + 29 * k) % 89 / 10, v) for t in range(40) for k, v in enumerate(speeds) for n in range(30)]
    rows += [(10**6 + n, 99, n, 30.0, 120.0, 25.58) for n in range(40 * 120 * 5)]
    points = spark.createDataFrame(rows, columns).selectExpr("*", *(f"'p' AS {c}" for c in behavior.PLACES))
    found = presentation.rendering_metadata(points, behavior.transport_segments(points)).where("id < 1000000").select("segment_id", "speed_bucket").distinct().collect()
    assert len(found) == 40 and len({r["speed_bucket"] for r in found}) == 1
