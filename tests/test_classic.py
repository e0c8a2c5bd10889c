"""Older rules, windows over stretches, geocoding, polygons from GeoJSON, streams with state and marks, on small rows."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, frame, metres, point

from wayfold.functions import stats
from wayfold.operators import behavior, classic, foundation, spatial, statistics
from wayfold.plans.windows import asof, islands, previous, running
from wayfold.sources.areas import areas
from wayfold.streaming import live


def walk(seed, n, tracks=1, step=0.004):
    rng, rows, t = random.Random(seed), [], 0
    for k in range(n):
        t += rng.choice([0, 5, 60, 4000, 90_000])
        rows.append(point(k, t, lat=22 + rng.randrange(5) * step, lon=113 + rng.randrange(3) * step, speed=rng.choice([0.5, 5.0, 30.0, 50.0, None]), place=("p", "c", "k", rng.choice(["u", "v", ""])), track=k % tracks))
    return rows


def told(df):
    """Rows as text, floats to ten digits: sums of floats depend on the order in which tasks add them."""
    return sorted(str([float(f"{v:.10g}") if isinstance(v, float) and k != "radius_m" else round(v, 4) if k == "radius_m" else v for k, v in r.asDict().items()]) for r in df.collect())


@pytest.mark.parametrize("chunk_s", [50, 86_400, 10**9])
def test_stretches_give_the_rows_of_whole_tracks(spark, chunk_s):
    points = frame(spark, [*walk(1, 200, 2), point(900, 70, track=None), point(901, 80, track=None)])
    for f in (lambda c: foundation.flag_outliers(points, chunk_s=c), lambda c: behavior.with_runs(points, c), lambda c: behavior.transport_segments(points, chunk_s=c), lambda c: behavior.admin_stays(points, min_s=1, chunk_s=c)):
        assert told(f(chunk_s)) == told(f(None))
    high = points.withColumn("altitude", 100 + F.col("id") % 7 * 30.0).withColumn("speed", F.when(F.col("id") % 5 < 3, 39.0).otherwise(F.col("speed"))).withColumn("heading", F.col("id") * 47.0 % 360)
    cells = spatial.grid_cells(points)
    more = [
        lambda c: foundation.fill_gaps(points, gap=1, max_gap=100_000, chunk_s=c), lambda c: foundation.flag_outliers_by_pattern(points, chunk_s=c), lambda c: statistics.admin_crossings(points, c),
        lambda c: spatial.altitude_events(high, min_m=20.0, min_s=1, chunk_s=c).select("track_id", "start_time", "event_type", "steps", F.round("distance_m", 6)), lambda c: spatial.spatial_complexity(high, cells, chunk_s=c).select("direction_changes", F.round("avg_turn_angle", 6)),
        lambda c: behavior.speed_events(high, min_s=1, min_run_s=0, gap=5, chunk_s=c).select("segment_id", "start_time", "end_time", "point_count"),
        lambda c: asof(points.select("id", "track_id", "data_time"), high.select("track_id", F.col("data_time").alias("t"), "altitude").where("id % 3 = 0"), "data_time", "t", ["track_id"], ["altitude"], "near", chunk_s=c),
        lambda c: asof(points.select("id", "track_id", "data_time"), high.select("track_id", F.col("data_time").alias("t"), "altitude").where("id % 3 = 0"), "data_time", "t", ["track_id"], ["altitude"], "near", True, c),
    ]
    for f in more:
        want = told(f(None))
        assert want and told(f(chunk_s)) == want
    empty = points.where("id < 0")
    assert previous(empty, ["lat"], "b", chunk_s).count() == 0 and islands(empty, F.col("lat") > 0, chunk_s=chunk_s).count() == 0


def test_running_columns_over_stretches_by_hand(spark):
    rows = walk(3, 150, 2)
    df = frame(spark, rows).select("id", "track_id", "data_time", "speed")
    cols = {"sums": {"s": F.lit(2)}, "firsts": {"f": F.col("speed")}, "lasts": {"l": F.col("speed")}, "befores": {"b": F.col("speed")}, "lags": {"g": (F.col("id"), 3)}}
    for chunk_s in (None, 70, 4000):
        seen = {}
        for r in running(df, chunk_s, **cols).orderBy("track_id", "data_time", "id").collect():
            own = seen.setdefault(r["track_id"], [])
            known = [x["speed"] for x in own if x["speed"] is not None]
            upto = known + ([r["speed"]] if r["speed"] is not None else [])
            assert (r["s"], r["f"], r["l"], r["b"]) == (2 * len(own) + 2, upto[0] if upto else None, upto[-1] if upto else None, known[-1] if known else None)
            assert r["g"] == [x["id"] for x in own[-3:]]
            own.append(r)
        assert sum(map(len, seen.values())) == 150


def test_one_track_makes_many_tasks_and_its_source_is_read_once(spark, tmp_path):
    path = str(tmp_path / "one")
    frame(spark, walk(5, 400)).repartition(1).write.parquet(path)
    points = spark.read.schema(SCHEMA).parquet(path)
    df = behavior.transport_segments(foundation.clean(points, 20_000), chunk_s=20_000)
    assert path not in df._jdf.queryExecution().executedPlan().toString()  # what is left reads stored stretches
    spread = behavior.with_runs(points, 20_000).withColumn("_chunk", F.floor(F.col("data_time") / 20_000)).groupBy("_chunk").count().count()
    assert spread > 20 and sorted(map(str, df.drop("distance_m").collect())) == sorted(map(str, behavior.transport_segments(foundation.clean(points)).drop("distance_m").collect()))


def test_sequential_stays_by_hand(spark):
    rows = walk(2, 300, 3) + [point(1000, None), point(1001, 5, lat=None)]
    found = {(r["track_id"], r["stay_id"], r["start_time"], r["end_time"], r["point_count"], round(r["center_lat"], 9)) for r in classic.sequential_stays(frame(spark, rows), 500.0, 3600).collect()}
    expected = set()
    for track in range(3):
        own = sorted(((r[2], r[0], r[3], r[4]) for r in rows if r[1] == track and r[2] is not None and r[3] is not None))
        groups = []
        for t, i, y, x in own:
            if groups and metres(y, x, sum(p[2] for p in groups[-1]) / len(groups[-1]), sum(p[3] for p in groups[-1]) / len(groups[-1])) <= 500:
                groups[-1].append((t, i, y, x))
            else:
                groups.append([(t, i, y, x)])
        for g in groups:
            if len(g) >= 2 and g[-1][0] - g[0][0] >= 3600:
                expected.add((track, g[0][1], g[0][0], g[-1][0], len(g), round(sum(p[2] for p in g) / len(g), 9)))
    assert found == expected and len(found) > 3
    assert classic.sequential_stays(frame(spark, [])).count() == 0


def test_rules_without_rows_or_with_nulls(spark):
    empty = frame(spark, [])
    moded = classic.rule_modes(empty)
    for df in (moded, classic.rule_segments(moded), classic.fill_rides(empty), classic.point_styles(moded)):
        assert df.count() == 0
    nulls = frame(spark, [tuple([1, 0, 0] + [None] * 11), tuple([2, 0, 10] + [None] * 11)])
    assert [r["mode"] for r in classic.point_styles(classic.rule_modes(nulls)).collect()] == ["STAY", "STAY"]
    row = point(3, 20, speed=None, accuracy=60.0)
    styled = classic.point_styles(classic.rule_modes(frame(spark, [row])), F.lit(True), F.lit(True)).first()
    assert (styled["render_color"], styled["lod_level"], round(styled["render_opacity"], 6)) == ("#808080", 5, 0.21)


def test_flights_and_trains_in_gaps(spark):
    high = [point(k, 600 * k, lat=22 + 0.8 * k, altitude=9000.0) for k in range(3)] + [point(9, 1200 + 7200, lat=22 + 1.6 + 9.6, altitude=9000.0)]
    made = classic.fill_rides(frame(spark, high)).orderBy("k").collect()
    assert [r["k"] for r in made] == list(range(1, 13)) and {r["source"] for r in made} == {"FLIGHT_INTERPOLATION"}
    assert made[5]["altitude"] == 10_000.0 and made[0]["altitude"] == pytest.approx(10_000 / 13 / 0.2) and made[-1]["altitude"] == pytest.approx(10_000 / 13 / 0.2)
    ride = [point(0, 0, place=("p", "c", "k", "t")), point(1, 7200, lat=24.0, place=("q", "c", "k", "t"))]
    made = classic.fill_rides(frame(spark, ride)).collect()
    assert len(made) == 12 and {(r["source"], r["altitude"]) for r in made} == {("TRAIN_INTERPOLATION", 0.0)}
    assert classic.fill_rides(frame(spark, [ride[0], point(1, 7200, lat=24.0)])).count() == 0


def test_geocoding_of_rows_that_share_an_id_and_geojson(spark, tmp_path):
    def square(y, x):
        return [[[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]]

    features = [
        {"type": "Feature", "properties": {"prov": "B", "city": "b"}, "geometry": {"type": "Polygon", "coordinates": square(22, 113)}},
        {"type": "Feature", "properties": {"prov": "A", "city": "a"}, "geometry": {"type": "MultiPolygon", "coordinates": [square(22.5, 113.5), square(30, 100)]}},
        {"type": "Feature", "properties": {"prov": "C"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    (tmp_path / "all.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, features)) + "\nbroken {\n")
    whole = areas(spark, str(tmp_path / "all.json"), {"province": "prov"})
    byline = areas(spark, str(tmp_path / "lines.json"), {"province": "prov"}, lines=True)
    assert sorted(map(str, whole.collect())) == sorted(map(str, byline.collect())) and whole.count() == 3
    bare = [point(7, 0, lat=22.2, lon=113.2, place=(None, None, None, None)), point(7, 1, lat=22.7, lon=113.7, place=("", None, None, None)), point(8, 2, lat=30.5, lon=100.5, place=("own", "o", None, None)), point(9, 3, lat=None, place=(None,) * 4)]
    rows = sorted((r["data_time"], r["province"], r["city"]) for r in foundation.reverse_geocode(frame(spark, bare), whole).collect())
    assert rows == [(0, "B", "b"), (1, "A", "a"), (2, "own", "o"), (3, None, None)]
    cells = sorted((r["data_time"], r["province"]) for r in foundation.reverse_geocode_by_cell(frame(spark, bare), whole).collect())
    assert cells == [(0, "B"), (1, "A"), (2, "own"), (3, None)]


def test_percentile_interval(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(1, 101)] + [(2, 5.0), (3, None)], "g int, x double")
    rows = {r["g"]: (r["lower"], r["upper"]) for r in stats.percentile_interval(df, "x", 0.5, 0.95, ["g"]).collect()}
    assert rows == {1: (40.0, 61.0), 2: (0.0, 0.0)}


def test_jumps_of_a_stream_and_marked_totals(spark, tmp_path):
    rng = random.Random(5)
    rows = [point(k, 4 * k, lat=22 + (0.02 if rng.random() < 0.2 else 0.0), track=k % 2) for k in range(60)]
    for part in range(3):
        frame(spark, rows[20 * part : 20 * part + 20]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.jumps(stream).writeStream.outputMode("append").format("memory").queryName("jumps").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {r["id"] for r in foundation.flag_outliers(frame(spark, rows)).where("array_contains(reasons, 'JUMP')").collect()}
    assert {r["id"] for r in spark.table("jumps").collect()} == batch and len(batch) > 5

    whole = live.caught_up(None, frame(spark, rows))
    first = live.caught_up(None, frame(spark, rows[:25]))
    again = live.caught_up(first, frame(spark, rows))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, live.caught_up(again, frame(spark, rows)).collect())) == sorted(map(tuple, whole.collect()))
