"""Density clusters at size: what is broadcast, and how tables shrink from round to round."""

import random

from pyspark.sql import functions as F

from wayfold.operators import density


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    rows = spark.range(400).select("id", F.lit(1).alias("track_id"), (F.col("id") * 3600).alias("data_time"), (22.0 + F.col("id") % 20 / 900).alias("lat"), (113.0 + F.col("id") % 23 / 900).alias("lon"), *(F.lit("p").alias(c) for c in ("province", "city", "county")))
    plans, real = [], density.stored
    monkeypatch.setattr(density, "stored", lambda df, name: (plans.append((name, df._jdf.queryExecution().toString())), real(df, name))[1])
    clustered = density.density_clusters(rows, 200.0, 4)
    figures = density.cluster_figures(clustered, 200.0)
    assert figures.count() >= 1
    plans += [(name, df._jdf.queryExecution().toString()) for name, df in (("clustered", clustered), ("figures", figures))]
    assert len(plans) > 8 and not [name for name, plan in plans if "Broadcast" in plan]


def test_labels_of_long_chains_and_few_rows(spark, monkeypatch):
    rng = random.Random(5)
    chain = [(k, k + 1) for k in range(499)] + [(1000 + k, 1001 + k) for k in range(0, 99)] + [(7000, 7000)]
    rng.shuffle(chain)
    tables, real = [], density.stored
    monkeypatch.setattr(density, "stored", lambda df, name: (tables.append(real(df, name)), tables[-1])[1])
    got = {r["node"]: r["label"] for r in density.spread_labels(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(500)} | {1000 + k: 1000 for k in range(100)} | {7000: 7000}
    assert sum(df.count() for df in tables) < 10 * len(chain)
