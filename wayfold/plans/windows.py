"""Plans that several operators share: islands, range joins, as-of joins, fan-out rollups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.plans.storage import stored

TRACK, ORDER = ["track_id"], ["data_time", "id"]


def ordered(partition: list[str] | None = None, order: list[str] | None = None):
    return Window.partitionBy(*(TRACK if partition is None else partition)).orderBy(*(ORDER if order is None else order))


def running(
    df: DataFrame, chunk_s: int | None = None, partition: list[str] | None = None, order: list[Column] | None = None, time: str = "data_time", descending: bool = False,
    sums: dict[str, Column] | None = None, firsts: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, befores: dict[str, Column] | None = None, lags: dict[str, tuple[Column, int]] | None = None,
) -> DataFrame:
    """df with columns that run along each track in order, several in one pass:

    sums: the sum up to the row, itself included; firsts, lasts: the first or last value that is not null, up to it; befores: the last
    before the row; lags: an array of the last k values before the row (none of them null), the nearest at its end.

    chunk_s: windows run over (track, stretch of chunk_s seconds), so that a long track makes many tasks. df is read once and
    stored with what each stretch gives alone; a table of one row a stretch carries all columns on to the stretches after
    it. The rows are the same. order must agree with the time (descending: run from the end, order and all).
    """
    part = TRACK if partition is None else partition
    order = [F.col(c) for c in ORDER] if order is None else order
    sums, firsts, lasts, befores, lags = sums or {}, firsts or {}, lasts or {}, befores or {}, lags or {}
    own = [*part, "_chunk"] if chunk_s else part
    w = Window.partitionBy(*own).orderBy(*order)
    upto, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    here = {n: F.sum(v).over(upto) for n, v in sums.items()} | {n: F.first(v, ignorenulls=True).over(upto) for n, v in firsts.items()} | {n: F.last(v, ignorenulls=True).over(upto) for n, v in lasts.items()}
    here |= {n: F.last(v, ignorenulls=True).over(ahead) for n, v in befores.items()} | {n: F.collect_list(v).over(w.rowsBetween(-k, -1)) for n, (v, k) in lags.items()}
    if not chunk_s:
        return df.withColumns(here)
    whole = {f"_w_{n}": F.last(v, ignorenulls=True).over(upto) for n, v in befores.items()} | {f"_w_{n}": F.collect_list(v).over(w.rowsBetween(1 - k, 0)) for n, (v, k) in lags.items()}
    columns = df.columns
    cut = df.withColumn("_chunk", F.floor(F.col(time) / chunk_s))
    cut = stored(cut.withColumns({f"_h_{n}": c for n, c in here.items()} | whole | {"_nth": F.row_number().over(w)}), "stretches")
    last = {n: F.max_by(f"_w_{n}" if n in befores or n in lags else f"_h_{n}", "_nth").alias(f"_c_{n}") for n in here}
    chunks = Window.partitionBy(*part).orderBy(F.desc("_chunk") if descending else F.col("_chunk"))
    prior = chunks.rowsBetween(Window.unboundedPreceding, -1)
    carry = {n: F.sum(f"_c_{n}").over(prior) for n in sums} | {n: F.first(f"_c_{n}", ignorenulls=True).over(prior) for n in firsts} | {n: F.last(f"_c_{n}", ignorenulls=True).over(prior) for n in (*lasts, *befores)}
    carry |= {n: F.flatten(F.collect_list(f"_c_{n}").over(chunks.rowsBetween(-k, -1))) for n, (_, k) in lags.items()}
    carried = cut.groupBy(*part, "_chunk").agg(*last.values()).select(*part, "_chunk", *(c.alias(f"_p_{n}") for n, c in carry.items()))
    same = F.lit(True)
    for c in own:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    met = cut.alias("x").join(carried.alias("y"), same).select("x.*", *(f"y._p_{n}" for n in here))

    def joined(n: str) -> Column:
        h, p = F.col(f"_h_{n}"), F.col(f"_p_{n}")
        if n in sums:
            return F.coalesce(h + F.coalesce(p, F.lit(0)), h, p)
        if n not in lags:
            return F.coalesce(p, h) if n in firsts else F.coalesce(h, p)
        both, k = F.concat(p, h), lags[n][1]
        return F.slice(both, F.greatest(F.size(both) - k, F.lit(0)) + 1, F.lit(k))

    return met.select(*(c for c in columns if c not in here), *(joined(n).alias(n) for n in here))


def previous(df: DataFrame, values: list[str], name: str, chunk_s: int | None = None) -> DataFrame:
    """df with a struct `name` of values of the row before in its track; null for a track's first row. chunk_s: see running."""
    return running(df, chunk_s, befores={name: F.struct(*values)})


def islands(df: DataFrame, begins: Column, partition: list[str] | None = None, order: list[str] | None = None, name: str = "island", chunk_s: int | None = None) -> DataFrame:
    """Number consecutive rows; an island begins where `begins` is true or null. Uses the partitioning of the order.

    chunk_s: as in running, for tracks in their usual order; `begins` must then hold no window of its own.
    """
    marked = df.withColumn("_begin", F.when(F.coalesce(begins, F.lit(True)), 1).otherwise(0))
    return running(marked, chunk_s, partition, order and [F.col(c) for c in order], sums={name: F.col("_begin")}).drop("_begin")


def range_join(points: DataFrame, intervals: DataFrame, time: str, start: str, end: str, on: list[str], width: int, how: str = "inner") -> DataFrame:
    """points with intervals that hold their time, by an equi-join on `on` and time buckets of `width`.

    An interval is copied once per bucket that it spans; choose a width near a long interval's length.
    """
    bucketed = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    left = points.withColumn("_b", F.floor(F.col(time) / width))
    inside = (F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))
    keys = [left[c] == bucketed[c] for c in [*on, "_b"]]
    condition = inside
    for key in keys:
        condition = condition & key
    joined = left.join(bucketed, condition, how)
    for c in [*on, "_b"]:
        joined = joined.drop(bucketed[c])
    return joined.drop("_b")


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, on: list[str], values: list[str], name: str, forward: bool = False, chunk_s: int | None = None) -> DataFrame:
    """left with a struct `name` of the nearest right row at or before (forward: at or after) left_time, or null.

    One shuffle on `on`: both sides in one order, the last right row carried along. Ties on time: right rows count for a
    left row at the same time; of several right rows the one with the largest values. chunk_s: see running.
    """
    carried = F.struct(*(F.col(v) for v in values))
    empty = F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType)
    columns = left.columns
    both = left.select(*columns, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), empty.alias(name)).unionByName(
        right.select(*on, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), carried.alias(name)), allowMissingColumns=True
    )
    order = [F.desc("_t"), F.col("_side"), F.desc_nulls_last(name)] if forward else [F.col("_t"), F.col("_side"), F.asc_nulls_first(name)]
    return running(both, chunk_s, on, order, "_t", forward, lasts={name: F.col(name)}).where("_side = 1").select(*columns, name)


def valid_at(left: DataFrame, dictionary: DataFrame, time: str, on: str, value: str, start: str, end: str, name: str, chunk_s: int | None = None) -> DataFrame:
    """left with `name`, the value of the dictionary's entry for its key that is valid at its time, or null.

    An entry is valid from its start (null: always) until before its end (null: for ever). Of several valid ones the latest
    begun counts, of equals the least value. Entries are first cut to pieces of one answer each, by joining the ends of a
    key's entries with its entries; then one as-of lookup serves each row, however many entries there are.
    """
    first = F.lit(-(1 << 62))
    entries = dictionary.select(F.col(on).alias("_key"), F.col(value).alias("_value"), F.coalesce(F.col(start).cast("long"), first).alias("_from"), F.col(end).cast("long").alias("_to")).where("_key is not null")
    edges = entries.select("_key", F.explode(F.array("_from", "_to")).alias("_edge")).where("_edge is not null").distinct()
    covers = (F.col("e._key") == F.col("d._key")) & (F.col("_from") <= F.col("_edge")) & (F.col("_to").isNull() | (F.col("_edge") < F.col("_to")))
    met = edges.alias("e").join(entries.alias("d"), covers, "left")
    best = met.groupBy(F.col("e._key").alias(on), "_edge").agg(F.min(F.when(F.col("_value").isNotNull(), F.struct((-F.col("_from")).alias("a"), F.col("_value").alias("v")))).alias("_best"))
    pieces = best.select(on, "_edge", F.col("_best.v").alias("_v"))
    return asof(left, pieces, time, "_edge", [on], ["_v"], "_piece", chunk_s=chunk_s).withColumn(name, F.col("_piece._v")).drop("_piece")


def fan_out(df: DataFrame, areas: dict[str, Column], buckets: dict[str, Column]) -> DataFrame:
    """Each row once per (area, bucket): area_type, area_key, bucket_type, bucket_key. Empty area names are left out."""

    def listed(kinds: dict[str, Column], prefix: str) -> Column:
        return F.array(*(F.struct(F.lit(k).alias(f"{prefix}_type"), v.alias(f"{prefix}_key")) for k, v in kinds.items()))

    wide = df.withColumn("_area", F.explode(listed(areas, "area"))).where("_area.area_key is not null and _area.area_key != ''")
    wide = wide.withColumn("_bucket", F.explode(listed(buckets, "bucket")))
    return wide.select(*df.columns, "_area.*", "_bucket.*")


def when_first(value: Column, condition: Column, order: Column) -> Column:
    """In an aggregation: `value` of the first row in `order` where `condition` holds."""
    return F.min_by(value, F.when(condition, order))


def apply_if(df: DataFrame, value: object, make: Callable[[], Column]) -> DataFrame:
    """An optional predicate: applied unless the argument is None, 0 or empty."""
    return df.where(make()) if value not in (None, 0, "", 0.0) else df
