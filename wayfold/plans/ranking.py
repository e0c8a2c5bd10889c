"""Exact places, order statistics and ranks of groups of any size, without sorting a group in one task.

Rows are dealt by ranges of (group, order), so a large group lies in many parts; a table of one row for each group and
part adds up what lies before a part; places within a part come from a window over it. Order statistics first count
equal values, then number only the parts that hold the places asked for. A value that many rows share is one row there.
Groups and values may be null (null groups are groups; null values come first in ranks and are left out of statistics).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.plans.storage import stored

#: A place (from 0, perhaps between two) for a group of so many values.
Place = Callable[[Column], Column]


def _same(by: list[str], left: str = "x", right: str = "y") -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def _parts(rows: DataFrame, by: list[str], order: list[str], size: Column) -> tuple[DataFrame, DataFrame]:
    """Stored rows with _part, and (by, _part, _start, _size, _total): what lies before a part in its group, in it, in all."""
    cut = stored(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sums = cut.groupBy(*by, "_part").agg(size.alias("_size"))
    before = F.sum("_size").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return cut, sums.select(*by, "_part", F.coalesce(before, F.lit(0)).alias("_start"), "_size", F.sum("_size").over(group).alias("_total"))


def _met(cut: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    on = (F.col("x._part") == F.col("y._part")) & _same(by)
    return cut.alias("x").join(parts.alias("y"), on).select("x.*", "y._start", "y._total")


def placed(rows: DataFrame, order: list[str], by: list[str], name: str = "place") -> DataFrame:
    """rows with their place in their group in the given order, from 0. The order should be total: of rows equal in it any
    may come first, but all places are given once."""
    cut, parts = _parts(rows, by, order, F.count("*"))
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    return _met(cut.withColumn("_own", own), parts, by).withColumn(name, F.col("_start") + F.col("_own")).drop("_part", "_own", "_start", "_total")


def _counted(rows: DataFrame, value: Column, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, value.alias("_v")).agg(F.count("*").alias("_n"))


def at_places(rows: DataFrame, value: Column, places: list[Place], by: list[str] | None = None) -> DataFrame:
    """(by, p): the values of each group at the places, in the ascending order of its values that are not null; between two
    places the values are interpolated. Without groups, one row, whose p is null where there are no values."""
    by = by or []
    cut, parts = _parts(_counted(rows.where(value.isNotNull()), value, by), by, ["_v"], F.sum("_n"))
    lows, highs = zip(*((F.floor(p(F.col("_total"))), F.ceil(p(F.col("_total")))) for p in places))

    def within(at: Column, start: str, size: str) -> Column:
        return (at >= F.col(start)) & (at < F.col(start) + F.col(size))

    holds = F.lit(False)
    for at in (*lows, *highs):
        holds = holds | within(at, "_start", "_size")
    w = Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    own = _met(cut, parts.where(holds), by).withColumn("_at", F.col("_start") + F.coalesce(F.sum("_n").over(w), F.lit(0)))
    picked = [F.max(F.when(within(at, "_at", "_n"), F.col("_v"))).alias(f"_{side}{k}") for side, ats in (("l", lows), ("h", highs)) for k, at in enumerate(ats)]
    found = own.groupBy(*by).agg(F.max("_total").alias("_total"), *picked)

    def between(k: int, place: Place) -> Column:
        at, low, high = place(F.col("_total")), F.col(f"_l{k}"), F.col(f"_h{k}")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    values = F.array(*(between(k, p) for k, p in enumerate(places)))
    return found.select(*by, F.when(F.col("_total").isNotNull(), values).alias("p"))


def percentiles(rows: DataFrame, value: Column, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, p): exact percentiles, interpolated linearly, as the aggregate function `percentile` gives them."""
    return at_places(rows, value, [lambda n, s=s: (n - 1) * F.lit(s) for s in shares], by)


def with_ranks(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """rows with _below (rows of the group with a smaller value), _ties (with this value) and _total."""
    cut, parts = _parts(_counted(rows, F.col(value), by), by, ["_v"], F.sum("_n"))
    w = Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranks = _met(cut, parts, by).select(*by, "_v", (F.col("_start") + F.coalesce(F.sum("_n").over(w), F.lit(0))).alias("_below"), F.col("_n").alias("_ties"), "_total")
    on = F.col(f"x.{value}").eqNullSafe(F.col("y._v")) & _same(by)
    return rows.alias("x").join(ranks.alias("y"), on).select("x.*", "y._below", "y._ties", "y._total")
