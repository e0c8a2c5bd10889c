"""Tables updated in place and incremental runs, on small rows: failures, repeats, marks, sets and sketches."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, frame, point

from wayfold.operators import behavior, foundation, increments, spatial
from wayfold.sources import tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/t"


def kv(spark, items):
    return spark.createDataFrame(items, "k long, v string, at long")


def test_upsert_rewrites_only_touched_partitions(spark, folder):
    keep = tables.replacing(["k"], latest="at")
    first = tables.update(spark, folder, kv(spark, [(k, "a", 1) for k in range(100)] + [(None, "n", 1), (5, "late", 3), (5, "early", 2)]), ["k"], keep)
    assert len(rows(tables.read(spark, folder))) == 101 and (5, "late", 3) in rows(tables.read(spark, folder))
    second = tables.update(spark, folder, kv(spark, [(7, "b", 2), (None, "m", 2), (1000, "new", 1)]), ["k"], keep)
    same = {k for k in first.parts if first.parts[k] == second.parts[k]}
    assert second.version == 2 and len(first.parts) - 3 <= len(same) < len(first.parts)
    got = {r[0]: r[1] for r in rows(tables.read(spark, folder))}
    assert got[7] == "b" and got[None] == "m" and got[1000] == "new" and got[8] == "a" and len(got) == 102
    before = rows(tables.read(spark, folder))
    tables.update(spark, folder, kv(spark, [(7, "b", 2), (None, "m", 2), (1000, "new", 1)]), ["k"], keep)
    tables.update(spark, folder, kv(spark, []), ["k"], keep)
    assert rows(tables.read(spark, folder)) == before
    assert tables.clear_old(folder, keep=1) > 3 and rows(tables.read(spark, folder)) == before
    with pytest.raises(ValueError):
        tables.update(spark, folder, kv(spark, []), ["v"], keep)


def test_failure_between_staging_and_publishing_leaves_the_old_table(spark, folder, monkeypatch):
    keep = tables.replacing(["k"])
    tables.update(spark, folder, kv(spark, [(1, "a", 1), (2, "a", 1)]), ["k"], keep, mark=[1])
    before = rows(tables.read(spark, folder))

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(tables, "_publish", broken)
        with pytest.raises(OSError):
            tables.update(spark, folder, kv(spark, [(1, "b", 2)]), ["k"], keep, mark=[2])
    assert rows(tables.read(spark, folder)) == before and tables.manifest(folder).mark == [1]
    tables.update(spark, folder, kv(spark, [(1, "b", 2)]), ["k"], keep, mark=[2])
    assert rows(tables.read(spark, folder)) == [(1, "b", 2), (2, "a", 1)]
    tables.update(spark, folder, kv(spark, [(1, "c", 2)]), ["k"], keep, mark=[2])  # the same batch again
    assert rows(tables.read(spark, folder)) == [(1, "b", 2), (2, "a", 1)]
    with pytest.raises(RuntimeError):
        tables._publish(folder, tables.manifest(folder))  # another writer's version
    with pytest.raises(FileNotFoundError):
        tables.read(spark, folder + "-none")


def test_first_update_without_rows(spark, folder):
    tables.update(spark, folder, kv(spark, []), ["k"], tables.replacing(["k"]))
    assert tables.read(spark, folder).columns == ["k", "v", "at"] and rows(tables.read(spark, folder)) == []
    tables.update(spark, folder, kv(spark, [(1, "a", 1)]), ["k"], tables.replacing(["k"]))
    assert rows(tables.read(spark, folder)) == [(1, "a", 1)]


def walk(seed, n=300, tracks=3):
    rng, out, t = random.Random(seed), [], 0
    for k in range(n):
        t += rng.choice([0, 5, 9, 600, 4000])
        town = "t" if (k // 40) % 2 else rng.choice(["u", "v", "", None])
        out.append(point(k, t, lat=22 + rng.randrange(5) * 0.004, lon=113 + rng.randrange(3) * 0.004, speed=rng.choice([0.5, 0.5, 0.5, 5.0, 30.0, None, 400.0]), accuracy=rng.choice([5.0, 5.0, 500.0]), place=("p", "c", "k", town), track=None if k % 7 == 6 else k % tracks))
    return out


def near(found, want):
    def told(df):
        return sorted((str([round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in sorted(df.columns))]) for r in df.collect()))

    assert told(found) == told(want)


@pytest.mark.parametrize("cuts", [(100, 200), (1, 2), (150, 150)])
def test_increments_equal_one_batch_and_repeats_change_nothing(spark, tmp_path, cuts):
    data = walk(3)
    whole = foundation.clean(frame(spark, data))
    kinds = {
        "segments": (increments.advance_segments, behavior.transport_segments(whole)),
        "stays": (lambda s, f, p: increments.advance_stays(s, f, p, min_s=600), behavior.admin_stays(whole, min_s=600)),
        "cells": (increments.advance_cells, spatial.grid_cells(whole)),
    }
    for name, (advance, want) in kinds.items():
        folder = f"file://{tmp_path}/{name}"
        for upto in (*cuts, len(data)):
            out = advance(spark, folder, frame(spark, data[:upto]))
        near(out, want)
        version = tables.manifest(folder).version
        near(advance(spark, folder, frame(spark, data)), want)
        near(advance(spark, folder, frame(spark, data + [point(9999, 1), point(9998, None)])), want)  # before the mark; no time
        assert tables.manifest(folder).version == version and want.count() > 4


def test_increments_that_failed_are_made_again(spark, tmp_path, monkeypatch):
    data, folder = walk(5, 120), f"file://{tmp_path}/f"
    increments.advance_cells(spark, folder, frame(spark, data[:50]))
    with monkeypatch.context() as m:
        m.setattr(tables, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            increments.advance_cells(spark, folder, frame(spark, data[:80]))
    near(increments.advance_cells(spark, folder, frame(spark, data)), spatial.grid_cells(foundation.clean(frame(spark, data))))


def test_runs_read_only_new_fixes_and_open_runs(spark, tmp_path, monkeypatch):
    data, folder, seen = walk(7), f"file://{tmp_path}/r", []
    real = behavior.transport_segments
    monkeypatch.setattr(behavior, "transport_segments", lambda p, *a: seen.append(p.count()) or real(p, *a))
    increments.advance_segments(spark, folder, frame(spark, data[:250]))
    increments.advance_segments(spark, folder, frame(spark, data))
    assert seen[1] < 50 + 80 < seen[0]


def test_increments_of_nothing(spark, tmp_path):
    none = frame(spark, [])
    for name, advance in (("s", increments.advance_segments), ("y", increments.advance_stays), ("c", increments.advance_cells), ("a", increments.advance_areas)):
        assert advance(spark, f"file://{tmp_path}/{name}", none).collect() == []
        assert advance(spark, f"file://{tmp_path}/{name}", frame(spark, walk(1, 40))) is not None


def test_stream_batches_count_once(spark, tmp_path):
    data, folder = walk(9, 200), f"file://{tmp_path}/areas"
    for part in range(4):
        frame(spark, data[50 * part : 50 * part + 50]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keys = ["area_type", "area_key"]
    q = tables.stream_into(stream, folder, increments.area_totals, keys, increments.merged_areas(), str(tmp_path / "c"), availableNow=True)
    q.awaitTermination(180)
    assert q.exception() is None and tables.manifest(folder).mark == [3]
    near(tables.read(spark, folder), increments.area_totals(frame(spark, data)))
    # the last batch handed over again
    tables.update(spark, folder, increments.area_totals(frame(spark, data[150:])), keys, increments.merged_areas(), mark=[3])
    near(tables.read(spark, folder), increments.area_totals(frame(spark, data)))


def test_error_of_sketches(spark, tmp_path):
    many = spark.range(60_000).select(
        F.col("id"), F.lit(1).alias("track_id"), (F.col("id") * 100).alias("data_time"), (22 + (F.col("id") % 200) * 0.02).alias("lat"), (113 + F.floor(F.col("id") / 200) % 150 * 0.02).alias("lon"), F.lit(1.0).alias("speed"), F.lit(1.0).alias("accuracy"),
        F.lit(1.0).alias("altitude"), F.lit(0.0).alias("heading"), F.lit(2.0).alias("distance"), F.lit("p").alias("province"), F.lit("c").alias("city"), F.lit("k").alias("county"), F.lit("t").alias("town"),
    )
    exact, folder = increments.area_totals(many).select(F.size("cells").alias("n")).first()["n"], f"file://{tmp_path}/k"
    for upto in (20_000, 40_000, 60_000):
        out = increments.advance_areas(spark, folder, many.where(F.col("id") < upto), exact=False).collect()
    assert exact > 20_000 and len(out) == 4 and all(abs(r["distinct_cells"] - exact) <= 0.05 * exact for r in out)
    assert {r["visit_days"] for r in out} == {70} and {r["point_count"] for r in out} == {60_000}
    assert all(r["bytes"] < 100_000 for r in tables.read(spark, folder).select(F.octet_length("cells").alias("bytes")).collect())
