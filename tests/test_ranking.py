"""Places, order statistics and ranks over ranges, against Python and the built-in aggregate."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wayfold.functions import stats
from wayfold.plans import ranking


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.5, 1.5, 2.0, rng.uniform(-5, 5)])) for k in range(3000)]
    rows += [(5000 + k, "one", 7.0) for k in range(9)] + [(6000, "single", -1.0), (6001, "void", None)] + [(1, "a", 1.5)] * 2
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(5)


def groups(table, key="g"):
    out = defaultdict(list)
    for r in table.collect():
        out[r[key]].append(r)
    return out


def test_places(table):
    placed = groups(ranking.placed(table, ["v", "id"], ["g"]))
    for g, rows in groups(table).items():
        want = sorted((r["v"] is not None, r["v"] or 0.0, r["id"]) for r in rows)
        got = sorted(placed[g], key=lambda r: r["place"])
        assert [r["place"] for r in got] == list(range(len(rows))) and [(r["v"] is not None, r["v"] or 0.0, r["id"]) for r in got] == want
    whole = ranking.placed(table, ["id", "v"], []).orderBy("place").collect()
    assert [r["place"] for r in whole] == list(range(len(whole))) and [r["id"] for r in whole] == sorted(r["id"] for r in whole)
    assert ranking.placed(table.limit(0), ["id"], ["g"]).collect() == []


def test_percentiles_equal_the_aggregate(table):
    shares = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.99, 1.0]
    want = {r["g"]: r["p"] for r in table.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).collect()}
    got = {r["g"]: r["p"] for r in ranking.percentiles(table, F.col("v"), shares, ["g"]).collect()}
    assert want.pop("void") is None and set(got) == set(want)
    assert all(math.isclose(x, y, abs_tol=1e-12) for g in want for x, y in zip(got[g], want[g]))
    whole = table.agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).first()["p"]
    assert ranking.percentiles(table, F.col("v"), shares).first()["p"] == pytest.approx(whole)
    assert ranking.percentiles(table.limit(0), F.col("v"), shares).collect()[0]["p"] is None


def test_ranks(table):
    for g, rows in groups(ranking.with_ranks(table, "v", ["g"])).items():
        for r in rows:
            assert r["_below"] == sum((s["v"] is None, s["v"]) != (True, None) and r["v"] is not None and s["v"] < r["v"] or (s["v"] is None and r["v"] is not None) for s in rows)
            assert r["_ties"] == sum(s["v"] == r["v"] for s in rows) and r["_total"] == len(rows)
    ranked = groups(stats.with_average_rank(table, "v", ["g"], "k"))
    assert {r["k"] for r in ranked["one"]} == {5.0} and ranked["single"][0]["k"] == 1.0


def test_a_large_group_spreads_over_tasks(spark):
    many = spark.range(400_000).select(((F.col("id") * 7919) % 400_009).cast("double").alias("v"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # small parts would be put together here
    spark.conf.set(key, "false")
    try:
        _, parts = ranking._parts(ranking._counted(many, F.col("v"), []), [], ["_v"], F.sum("_n"))
    finally:
        spark.conf.unset(key)
    sizes = [r["_size"] for r in parts.collect()]
    assert len(sizes) >= 4 and max(sizes) < 2 * 400_000 / len(sizes)
    shares = [0.01, 0.37, 0.5]
    assert ranking.percentiles(many, F.col("v"), shares).first()["p"] == pytest.approx(many.agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).first()["p"])
