"""Imports: raw tables of fixes, and daily counters of keys and mouse from UTF-16 INI files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.plans.ranking import placed
from wayfold.sources import tables

#: The columns of the counter tables.
MOUSE = ("lbcount", "rbcount", "mbcount", "xbcount", "wheel", "hwheel", "move")


def clean_names(df: DataFrame) -> DataFrame:
    """Column names of letters, digits and underscores; an empty one becomes unnamed."""
    names = [re.sub(r"[^\w]", "_", re.sub(r"\s+", "_", c.strip())).strip("_") or "unnamed" for c in df.columns]
    return df.toDF(*names)


def with_time_columns(df: DataFrame, seconds: str = "data_time") -> DataFrame:
    """Adds time_visually (yyyy-MM-dd HH:mm:ss.SSS) and time (yyyyMMddHHmmss) of unix seconds; null where they are none."""
    at = F.timestamp_seconds(F.expr(f"try_cast(`{seconds}` as double)"))
    return df.withColumn("time_visually", F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS")).withColumn("time", F.date_format(at, "yyyyMMddHHmmss"))


def kept_fixes(df: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted columns of rows of step type 0, where the table has such a column."""
    return (df.where("coalesce(stepType, 0) = 0") if "stepType" in df.columns else df).select(*columns)


def counters(spark: SparkSession, path: str) -> DataFrame:
    """(date, name, value) of all `name=value` lines under [YYYYMMDD] sections of UTF-16 INI files; a bad number is 0."""
    files = spark.read.format("binaryFile").load(path).select("path", F.split(F.decode("content", "UTF-16"), r"\r?\n").alias("lines"))
    lines = files.select("path", F.posexplode("lines").alias("at", "line")).withColumn("line", F.trim("line"))
    section = F.regexp_extract("line", r"^\[(\d{8})\]$", 1)
    w = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # a file's lines
    dated = lines.withColumn("date", F.last(F.when(F.length(section) > 0, section), ignorenulls=True).over(w))
    pairs = dated.where("date is not null and line like '%=%'").select("date", F.lower(F.trim(F.substring_index("line", "=", 1))).alias("name"), F.trim(F.expr("substr(line, instr(line, '=') + 1)")).alias("value"))
    return pairs.select(F.to_date("date", "yyyyMMdd").alias("date"), "name", F.coalesce(F.expr("try_cast(value as double)"), F.lit(0.0)).alias("value"))


def mouse_days(counted: DataFrame) -> DataFrame:
    """A row per date with the mouse counters, 0 where a day has none."""
    return counted.where(F.col("name").isin(*MOUSE)).groupBy("date").pivot("name", list(MOUSE)).agg(F.sum("value")).na.fill(0)


def scan_codes(counted: DataFrame) -> DataFrame:
    """(date, scan_code, count) of keys that were pressed."""
    coded = counted.where("name rlike '^[0-9]+$' and value > 0")
    return coded.groupBy("date", F.col("name").cast("int").alias("scan_code")).agg(F.sum("value").cast("long").alias("count"))


def daily_matrix(counted: DataFrame, names: list[str]) -> DataFrame:
    """Every day from the first to the last with a column per name (0 without a count), and a row `total`."""
    span = counted.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a is not null")
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    wide = counted.groupBy("date").pivot("name", names).agg(F.sum("value"))
    whole = days.join(wide, "date", "left").na.fill(0, names)
    total = whole.agg(F.lit("total").alias("date"), *(F.sum(F.col(f"`{n}`")).alias(n) for n in names)).where(F.col(f"`{names[0]}`").isNotNull())
    return whole.withColumn("date", F.col("date").cast("string")).unionByName(total)


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """An upsert: new rows, and old rows whose key no new row has. Of new rows with one key any one stays."""
    latest = new.dropDuplicates(keys)
    return old.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def orphans(coded: DataFrame, days: DataFrame) -> DataFrame:
    """Dates with scan codes but without a row among days."""
    return coded.select("date").distinct().join(days.select("date"), "date", "left_anti")


def numbered(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Rows of a load with dense numbers from 1 in the given order, null first. The order is made total by the row itself,
    so that a load made again gives the same numbers; equal rows take theirs in any order. No task sorts the whole table."""
    rest = [c for c in df.columns if c not in order]
    return placed(df, [*order, *rest], [], name).withColumn(name, F.col(name) + 1).select(name, *(c for c in df.columns if c != name))


def load_fixes(raw: DataFrame, folder: str, columns: list[str]) -> DataFrame:
    """Replace the table of fixes at folder: clean names, step type 0, the wanted columns, time columns, dense ids by time.

    Written beside the old table and published at once (sources/tables.py), so readers never see half a load."""
    kept = with_time_columns(kept_fixes(clean_names(raw), columns))
    rows = numbered(kept, ["data_time"])
    tables.replace_all(raw.sparkSession, folder, rows, ["id"])
    return tables.read(raw.sparkSession, folder)


#: Scan codes of the number pad, and the mouse's buttons and wheels.
GROUPS = {"numpad": ("55", *map(str, range(71, 84))), "buttons": ("lbcount", "rbcount", "mbcount", "xbcount"), "wheels": ("wheel", "hwheel")}


def group_sums(counted: DataFrame, groups: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(date, group, total) of counters: by day, the sum of each group's names; 0 on days that count others only."""
    own = groups or GROUPS
    sums = [F.sum(F.when(F.col("name").isin(*names), F.col("value")).otherwise(0.0)).alias(g) for g, names in own.items()]
    return counted.groupBy("date").agg(*sums).unpivot("date", list(own), "group", "total")


def counter_totals(counted: DataFrame) -> DataFrame:
    """(name, days, first_date, last_date, total) of each counter."""
    return counted.groupBy("name").agg(F.count_distinct("date").alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("value").alias("total"))
