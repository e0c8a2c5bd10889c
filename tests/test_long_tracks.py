"""Shapes of long tracks: no task holds a whole track."""

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo


def _rows(spark):
    return spark.range(6000).select("id", F.lit(1).alias("track_id"), (F.col("id") * 60).alias("data_time"), (22.0 + F.col("id") * 37 % 101 / 900).alias("lat"), (113.0 + F.col("id") * 53 % 89 / 900).alias("lon"), (5.0 + F.col("id") % 7).alias("accuracy"))


def test_paths_by_stretch_equal_whole(spark):
    one, two = (geo.paths(_rows(spark), ["track_id"], ["data_time", "id"], chunk_s=c).first() for c in (None, 7200))
    assert one["path_m"] == pytest.approx(two["path_m"]) and one["line_m"] == two["line_m"] and one["path_m"] > 0


def test_radius_of_gyration_deals_a_group_to_parts(spark):
    found = geo.radius_of_gyration(_rows(spark), ["track_id"], "accuracy")
    assert "_part" in found._jdf.queryExecution().optimizedPlan().toString()
    rows = _rows(spark).collect()
    w = sum(r["accuracy"] for r in rows)
    y, x = (sum(r[c] * r["accuracy"] for r in rows) / w for c in ("lat", "lon"))
    square = _rows(spark).select((F.pow(geo.haversine("lat", "lon", F.lit(y), F.lit(x)), 2) * F.col("accuracy")).alias("d")).agg(F.sum("d")).first()[0]
    assert found.first()["radius_m"] == pytest.approx((square / w) ** 0.5)
