"""Stays whose middles lie between two places of four digits."""

from decimal import Decimal

from wayfold.operators import classic


def test_halves_go_by_the_double_that_a_multiplication_gives(spark):
    halves = [22 + (2 * k + 1) / 20_000 for k in range(4000)]
    below = next(x for x in halves if Decimal(repr(x)) * 100_000 % 10 == 5 and x * 10_000 % 1 < 0.5)
    rows = [(k, "p", "c", "k", y, 113.0, 0, 9000, 9000, 0.9) for k, y in enumerate((below, int(below * 10_000) / 10_000, (int(below * 10_000) + 1) / 10_000))]
    stays = spark.createDataFrame(rows, "stay_id long, province string, city string, county string, center_lat double, center_lon double, start_time long, end_time long, duration_s long, confidence double")
    found = {r["stay_id"]: r["frequency"] for r in classic.labelled_stays(stays, 0, 0.1).collect()}
    assert found == {0: 2, 1: 2, 2: 1}
