"""Small traces written by hand, and plain Python statements of the rules."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import behavior, foundation, presentation, spatial, statistics, temporal
from wayfold.operators.density import cluster_figures, convex_hull, density_clusters
from wayfold.plans import serving
from wayfold.streaming import live

SCHEMA = "id long, track_id long, data_time long, lat double, lon double, speed double, accuracy double, altitude double, heading double, distance double, province string, city string, county string, town string"


def point(i, t, lat=22.0, lon=113.0, speed=10.0, accuracy=5.0, altitude=100.0, heading=0.0, distance=10.0, place=("p", "c", "k", "w"), track=0):
    return (i, track, t, lat, lon, speed, accuracy, altitude, heading, distance, *place)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def metres(a, b, c, d):
    p, q, r, s = map(math.radians, (a, b, c, d))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_jump_is_seen_from_the_raw_fix_before(spark):
    rows = [point(k, 5 * k, lat=22 + 0.011 * k) for k in range(3)] + [point(3, 100, speed=None, accuracy=60.0)]
    out = {r["id"]: r for r in foundation.flag_outliers(frame(spark, rows)).collect()}
    assert [out[k]["outlier"] for k in range(4)] == [False, True, True, False]
    assert out[1]["reasons"] == ["JUMP"] and out[3]["qa_status"] == "WARNING"


def test_there_and_back_marks_the_last_fix(spark):
    rows = [point(0, 0), point(1, 60, lat=22.001), point(2, 120), point(3, 9000, accuracy=500.0)]
    out = {r["id"]: r for r in foundation.flag_outliers_by_pattern(frame(spark, rows)).collect()}
    assert out[2]["reasons"] == ["BACKTRACK"] and out[2]["outlier"]
    assert not out[1]["outlier"] and not out[3]["outlier"] and out[3]["qa_status"] == "WARNING"


@pytest.mark.parametrize("gap, n", [(300, 0), (301, 5), (1800, 30), (1801, 0)])
def test_gap_edges(spark, gap, n):
    assert foundation.fill_gaps(frame(spark, [point(0, 0), point(1, gap)])).count() == n


def test_mode_runs(spark):
    speeds = [1, 1, 1, 20, 20, 20, 20, 50]
    rows = [point(k, 5 * k, speed=float(s)) for k, s in enumerate(speeds)]
    out = behavior.transport_segments(frame(spark, rows)).orderBy("start_time").collect()
    assert [(r["mode"], r["duration_s"], r["point_count"]) for r in out] == [("WALK", 10, 3), ("CAR", 15, 4)]


def test_climb_after_flat_and_after_descent(spark):
    alts = [0, 0, 30, 60, 0, 70]
    rows = [point(k, 400 * k, altitude=float(a) + 1) for k, a in enumerate(alts)]
    out = spatial.altitude_events(frame(spark, rows)).orderBy("start_time").collect()
    assert [(r["event_type"], r["altitude_change"], r["distance_m"]) for r in out] == [("CLIMB", 60, 10), ("DESCENT", -60, 10), ("CLIMB", 70, 10)]


def test_streak_over_a_month_edge(spark):
    day = 86_400
    base = 1_706_572_800  # 30 January 2024
    rows = [point(k, base + k * day, distance=1000.0) for k in (0, 1, 2, 3)] + [point(9, base + 4 * day, distance=1.0), point(10, base + 5 * day, distance=2000.0)]
    (r,) = behavior.streaks(frame(spark, rows)).collect()
    assert (str(r["start_date"]), str(r["end_date"]), r["days"]) == ("2024-01-30", "2024-02-02", 4)


def test_crossing_names_the_highest_level(spark):
    places = [("p", "c", "k", "w"), ("q", "d", "k", "w"), ("q", "d", "k", "v"), ("q", "", "k", "v"), ("q", "", "m", "v")]
    out = statistics.admin_crossings(frame(spark, [point(k, k, place=p) for k, p in enumerate(places)])).orderBy("crossing_id").collect()
    assert [(r["crossing_id"], r["crossing_type"]) for r in out] == [(1, "PROVINCE"), (2, "TOWN"), (4, "COUNTY")]


def test_speed_events_against_a_loop(spark):
    rng = random.Random(5)
    rows, t = [], 0
    for k in range(400):
        t += rng.choice([4, 8, 11, 30])
        rows.append(point(k, t, speed=rng.choice([30.0, 36.0, 39.0])))
    want, first, last, low = [], None, None, None
    for r in rows:
        if r[5] >= 33.33:
            if first is None or (low is not None and low > last and low - last > 10):
                if first is not None:
                    want.append((first, last))
                first = r[2]
            last = r[2]
        else:
            low = r[2]
    want.append((first, last))
    got = [(r["start_time"], r["end_time"]) for r in behavior.speed_events(frame(spark, rows)).orderBy("start_time").collect()]
    assert got == [w for w in want if w[1] - w[0] >= 60]


def test_density_clusters_against_a_loop(spark):
    rng = random.Random(3)
    pts = [(k, 22 + rng.randrange(40) / 2500, 113 + rng.randrange(40) / 2500) for k in range(250)]
    near = {a[0]: [b[0] for b in pts if metres(a[1], a[2], b[1], b[2]) <= 200] for a in pts}
    core = {k for k, n in near.items() if len(n) >= 4}
    label = {k: k for k in core}
    for _ in range(300):
        label = {k: min(label[j] for j in near[k] if j in core) for k in core}
    want = {k: label[k] if k in core else min((label[j] for j in near[k] if j in core), default=None) for k in near}
    out = density_clusters(frame(spark, [point(k, k, lat=a, lon=b) for k, a, b in pts]), 200.0, 4).collect()
    assert {r["id"]: r["cluster"] for r in out} == want


def test_cluster_figures(spark):
    square = [(0, 0), (0, 2), (2, 0), (2, 2), (1, 1), (1, 0), (2, 1), (1, 1)]
    rows = [point(k, 86_400 * (k % 2), lat=22 + a / 1000, lon=113 + b / 1000, place=("p", str(k), "k", "w")) for k, (a, b) in enumerate(square)]
    rows += [point(50 + k, k, lat=30.0, lon=113 + k / 1000) for k in range(4)] + [point(99, 0, lat=60.0)]
    out = {r["cluster"]: r for r in cluster_figures(density_clusters(frame(spark, rows), 200.0, 2), 200.0).collect()}
    assert set(out) == {0, 50}
    assert (out[0]["point_count"], out[0]["visit_count"], out[0]["duration_s"], out[0]["city"], out[0]["cluster_type"]) == (8, 2, 480, "0", "OCCASIONAL")
    assert out[0]["convex_hull_area_km2"] == pytest.approx(4e-6 * 111 * 111) and out[50]["convex_hull_area_km2"] == pytest.approx(0)
    assert out[0]["radius_m"] == pytest.approx(max(metres(out[0]["center_lat"], out[0]["center_lon"], 22 + a / 1000, 113 + b / 1000) for a, b in square))


def test_convex_hull_holds_all_points():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 50, 500):
        places = rng.integers(0, 12, (n, 2)).astype(float)
        hull = convex_hull(places)
        ends = np.roll(hull, -1, axis=0)
        for a, b in zip(hull, ends, strict=True):
            assert ((b[0] - a[0]) * (places[:, 1] - a[1]) - (b[1] - a[1]) * (places[:, 0] - a[0]) >= 0).all() or len(hull) < 3
        assert {tuple(h) for h in hull} <= {tuple(p) for p in places}


def test_simplified_line_keeps_corners(spark):
    rows = [point(k, k, lat=22.0 + (0.01 if k == 5 else 0), lon=113.0 + k / 1000) for k in range(11)]
    out = {r["epsilon"]: r["kept_points"] for r in temporal.simplified_lines(frame(spark, rows), (1e-3, 1.0)).collect()}
    assert out[1e-3] >= 5 and out[1.0] == 2


def test_trips_take_the_last_stay(spark):
    seg = spark.createDataFrame([(1, 0, "CAR", 10_000, 11_000, 500.0, 0.0, 0.0, 0.0, 0.0, "c"), (2, 0, "WALK", 18_200, 18_300, 5.0, 0.0, 0.0, 0.0, 0.0, "c"), (3, 0, "WALK", 25_501, 25_600, 5.0, 0.0, 0.0, 0.0, 0.0, "d")],
        "segment_id long, track_id long, mode string, start_time long, end_time long, distance_m double, start_lat double, start_lon double, end_lat double, end_lon double, city string")
    stays = spark.createDataFrame([(7, 0, 18_400, 21_000, 2600), (8, 0, 18_500, 21_000, 2500), (9, 0, 5_000, 9_999, 4999)], "stay_id long, track_id long, start_time long, end_time long, duration_s long")
    out = behavior.trips(seg, stays).orderBy("start_time").collect()
    assert [(r["segment_ids"], r["origin_stay_id"], r["dest_stay_id"]) for r in out] == [([1, 2], 9, 8), ([3], None, None)]


def test_empty_tables(spark):
    p = frame(spark, [])
    seg, stay = behavior.transport_segments(p), behavior.admin_stays(p)
    cells = spatial.grid_cells(p)
    for df in (foundation.flag_outliers(p), foundation.fill_gaps(p), seg, stay, behavior.trips(seg, stay), behavior.streaks(p), behavior.speed_events(p), cells, spatial.density_levels(cells), statistics.footprint(p), statistics.admin_crossings(p), temporal.simplified_lines(p), presentation.rendering_metadata(p, seg), density_clusters(p, 100.0, 3), cluster_figures(density_clusters(p, 100.0, 3), 100.0)):
        assert df.count() == 0
    assert statistics.movement_intensity(seg).first()["trip_count"] == 0
    assert spatial.spatial_complexity(p, cells).first()["direction_changes"] == 0


def test_serving_clamps_and_pages(spark):
    df = frame(spark, [point(k, k) for k in range(30)])
    page = serving.serve_page(df, serving.VIEWS["track_points"], limit=10, page=3, min_speed=0)
    assert [r["id"] for r in page.rows.collect()] == list(range(9, -1, -1)) and (page.total, page.pages) == (30, 3)
    with pytest.raises(ValueError):
        serving.serve(df, serving.VIEWS["track_points"], colour="red")


def test_stream_equals_batch(spark, tmp_path):
    rows = [point(k, 1_700_000_000 + 1000 * k) for k in range(40)]
    frame(spark, rows).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.hourly_slices(stream, "10 days").writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = live.hourly_slices(frame(spark, rows))
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, batch.collect()))
    a, b = frame(spark, rows[:17]), frame(spark, rows[17:])
    both = live.merged(live.daily_totals(a), live.daily_totals(b))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, live.daily_totals(frame(spark, rows)).collect()))


def test_simplified_lines_against_recursion(spark):
    from wayfold.operators.temporal import douglas_peucker

    def kept(pts, eps):
        """The rule by recursion: indexes that stay."""
        if len(pts) < 3:
            return [p[0] for p in pts]
        (_, ay, ax), (_, by, bx) = pts[0], pts[-1]

        def away(p):
            dx, dy = bx - ax, by - ay
            chord = math.hypot(dx, dy)
            return abs(dx * (p[1] - ay) - dy * (p[2] - ax)) / chord if chord else math.hypot(p[2] - ax, p[1] - ay)

        k = max(range(1, len(pts) - 1), key=lambda i: away(pts[i]))
        if away(pts[k]) <= eps:
            return [pts[0][0], pts[-1][0]]
        return kept(pts[: k + 1], eps)[:-1] + kept(pts[k:], eps)

    rng = random.Random(6)
    for n in (1, 2, 3, 50, 400):
        pts = [(k, rng.uniform(0, 1), rng.uniform(0, 1) + k / 50) for k in range(n)]
        if n == 50:
            pts[-1] = (n - 1, *pts[0][1:])  # a closed line
        for eps in (0.0, 0.05, 0.3, 5.0):
            keep = douglas_peucker(np.array([p[1] for p in pts]), np.array([p[2] for p in pts]), eps)
            assert np.flatnonzero(keep).tolist() == sorted(set(kept(pts, eps)))
    rows = [point(k, 86_400 * (k // 20) + k, lat=22 + rng.random() / 100, lon=113 + rng.random() / 100) for k in range(60)]
    found = {(r["chunk"], r["epsilon"]): [(p["lat"], p["lon"]) for p in r["line"]] for r in temporal.simplified_lines(frame(spark, rows)).collect()}
    for chunk in range(3):
        own = [(k, r[3], r[4]) for k, r in enumerate(rows[20 * chunk : 20 * chunk + 20])]
        for eps in temporal.EPSILONS:
            assert found[chunk, eps] == [own[k][1:] for k in sorted(set(kept(own, eps)))]


def test_dense_cells_side_by_side_are_searched_in_few_comparisons(spark, monkeypatch):
    from wayfold.operators import density

    rng = random.Random(3)

    def blob(lat, lon, n, m):
        return [(lat + rng.uniform(0, m), lon + rng.uniform(0, m)) for _ in range(n)]

    # pairs of blobs near, at, and beyond the distance, and a bridge of one place
    spots = blob(22.0, 113.0, 300, 0.0004) + blob(22.0, 113.00085, 300, 0.0004) + blob(22.02, 113.0, 200, 0.0004) + blob(22.02, 113.0019, 200, 0.0004) + blob(22.04, 113.0, 200, 0.0003) + [(22.04015, 113.0008)] + blob(22.04, 113.0013, 200, 0.0003) + blob(22.06, 113.0, 3, 0.0002)
    points = frame(spark, [point(k, k, lat=a, lon=b) for k, (a, b) in enumerate(spots)])
    eps, least = 60.0, 4
    close = [[j for j, q in enumerate(spots) if metres(*p, *q) <= eps] for p in spots]
    core = [len(c) >= least for c in close]
    label = list(range(len(spots)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, c in enumerate(close):
        for j in c:
            if core[i] and core[j]:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    want = {i: top(i) if core[i] else min((top(j) for j in close[i] if core[j]), default=None) for i in range(len(spots))}
    judged, real = [], density.stored
    monkeypatch.setattr(density, "stored", lambda df, name: (judged.append(real(df, name)), judged[-1])[1] if name == "judged" else real(df, name))
    got = {r["id"]: r["cluster"] for r in density_clusters(points, eps, least).collect()}
    assert got == want and len({v for v in want.values() if v is not None}) >= 4
    assert sum(df.count() for df in judged) < 40 * len(spots)


def test_two_cells_of_many_places_just_beyond_the_distance(spark):
    from wayfold.operators import density

    side = 0.0005
    many = spark.range(60_000).select("id", (22.0 + (F.col("id") * 7919 % 20011) / 20011 * side * 0.6).alias("lat"), (113.0 + F.when(F.col("id") % 2 == 0, 0.0).otherwise(0.00115) + (F.col("id") * 104729 % 30011) / 30011 * side * 0.6).alias("lon"), F.lit(0).alias("track_id"))
    for eps, groups in ((80.0, 2), (95.0, 1)):
        assert density.density_clusters(many, eps, 5).select("cluster").distinct().count() == groups
