"""Streams with lists, timers and open events as state, against the batch operators."""

import random

import pytest
from test_operators import SCHEMA, frame, point

from wayfold.operators import spatial, statistics
from wayfold.streaming import stateful


def rows_of(seed, n=240, tracks=3):
    rng, rows, t, high = random.Random(seed), [], 0, 100.0
    for k in range(n):
        t += rng.choice([0, 30, 60, 200])
        high += rng.choice([30.0, 30.0, 30.0, 5.0, -40.0]) if (k // 15) % 2 else rng.choice([-25.0, -25.0, -3.0, 12.0])
        place = (rng.choice(["p", "p", "q", None]), rng.choice(["c", "d"]), rng.choice(["k", ""]), rng.choice(["u", "v", None]))
        rows.append(point(k, t, lat=22 + rng.random() / 50, lon=113 + rng.random() / 50, altitude=rng.choice([high, high, high, 9999.0]), place=place, track=k % tracks))
    return rows


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, stateful.PROVIDER)
    yield spark
    spark.conf.set(key, before)


def feed(spark, folder, rows, parts, rng):
    """Rows in files; each arrives up to some places away from its own, and repeated times keep their ids apart."""
    order = sorted(range(len(rows)), key=lambda k: k + rng.uniform(0, 25))
    size = -(-len(order) // parts)
    for p in range(parts):
        frame(spark, [rows[k] for k in order[p * size : (p + 1) * size]]).coalesce(1).write.mode("append").parquet(folder)


def drained(spark, make, folder, tmp, name):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    sink = make(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp / f"{name}-out")).option("checkpointLocation", str(tmp / f"{name}-c"))
    q = sink.trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.read.parquet(str(tmp / f"{name}-out"))


def shown(df):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in sorted(df.columns))]) for r in df.collect())


@pytest.mark.parametrize("name", ["crossings", "altitude"])
def test_stream_equals_batch_on_shuffled_arrival_and_after_a_restart(rocks, tmp_path, name):
    rows, rng = rows_of(4), random.Random(9)
    batch = statistics.admin_crossings if name == "crossings" else lambda p: spatial.altitude_events(p, min_m=40.0, min_s=60)
    make = (lambda s: stateful.crossings(s, "2 hours")) if name == "crossings" else (lambda s: stateful.altitude_events(s, min_m=40.0, min_s=60, late="2 hours"))
    end = [point(10_000 + t, 10**7, altitude=100.0, place=("p", "c", "k", "u"), track=99) for t in range(2)]
    folder = str(tmp_path / "in")
    feed(rocks, folder, rows[:150], 2, rng)
    first = drained(rocks, make, folder, tmp_path, name).count()
    feed(rocks, folder, rows[150:], 2, rng)
    drained(rocks, make, folder, tmp_path, name)  # goes on from the checkpoint
    frame(rocks, end).coalesce(1).write.mode("append").parquet(folder)
    got = drained(rocks, make, folder, tmp_path, name)
    whole = batch(frame(rocks, rows))
    want = shown(whole)
    if name == "altitude":  # a run that is still open at the end of its track is not given yet
        last = {r["track_id"]: r["t"] for r in frame(rocks, rows).where("altitude < 9000").groupBy("track_id").agg({"data_time": "max"}).toDF("track_id", "t").collect()}
        want = shown(whole.where(" and ".join(f"not (track_id = {k} and end_time = {t})" for k, t in last.items())))
    found = shown(got)
    assert len(found) > 5 and first < len(found)
    assert found == want


def test_stream_of_no_rows(rocks, tmp_path):
    frame(rocks, []).coalesce(1).write.parquet(str(tmp_path / "in"))
    assert drained(rocks, stateful.crossings, str(tmp_path / "in"), tmp_path, "none").count() == 0
