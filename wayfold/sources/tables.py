"""Tables that are updated in place: rows are replaced or added up by key, partition by partition, under a manifest.

A table is a folder of Parquet partitions and numbered manifests. An update reads only the partitions that new rows
touch, writes them anew beside the old ones, and then publishes a manifest by one rename. Before the rename readers see
the old table, after it the new one; an update that fails in between leaves files that no manifest names. A manifest
also names tables kept beside the rows (the state of an incremental run) and a mark, the last batch that it holds, so
rows, state and mark change together, and a batch that is made again changes nothing.

One writer at a time; a second one that publishes the same version is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from wayfold.plans.storage import filesystem, stored

#: How old rows (None for a new table) and new rows of the touched partitions become one.
Combine = Callable[[DataFrame | None, DataFrame], DataFrame]
_PART = "_part"


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    schema: str = ""
    buckets: int = 0
    keys: list[str] = field(default_factory=list)
    parts: dict[str, str] = field(default_factory=dict)
    beside: dict[str, dict[str, str]] = field(default_factory=dict)
    mark: list[int] | None = None


def _numbers(fs: pafs.FileSystem, path: str) -> list[int]:
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(int(f.base_name[9:-5]) for f in found if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"))


def manifest(folder: str) -> Manifest | None:
    """The newest manifest of a table, None if it has none yet."""
    fs, path = filesystem(folder)
    numbers = _numbers(fs, path)
    if not numbers:
        return None
    with fs.open_input_file(f"{path}/manifest-{numbers[-1]:08d}.json") as f:
        return Manifest(**json.loads(f.read()))


def read(spark: SparkSession, folder: str, parts: list[str] | None = None) -> DataFrame:
    """The rows of a table, or of some of its partitions."""
    now = manifest(folder)
    if now is None:
        raise FileNotFoundError(f"{folder} holds no table")
    paths = [p for k, p in now.parts.items() if parts is None or k in parts]
    schema = StructType.fromJson(json.loads(now.schema))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_beside(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table kept beside the rows; None if there is none."""
    kept = (now := manifest(folder)) and now.beside.get(name)
    return spark.read.schema(StructType.fromJson(json.loads(kept["schema"]))).parquet(kept["path"]) if kept else None


def _publish(folder: str, made: Manifest) -> None:
    """Make a manifest the newest by a rename."""
    fs, path = filesystem(folder)
    if made.version in _numbers(fs, path):
        raise RuntimeError(f"another writer has published version {made.version} of {folder}")
    temporary = f"{path}/_manifest-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as f:
        f.write(json.dumps(asdict(made)).encode())
    fs.move(temporary, f"{path}/manifest-{made.version:08d}.json")


def update(spark: SparkSession, folder: str, new: DataFrame, keys: list[str], combine: Combine, mark: list[int] | None = None, beside: dict[str, DataFrame] | None = None, buckets: int = 32) -> Manifest:
    """Combine new rows into the table at folder (a URI that driver and executors share), made if absent.

    keys and buckets, the number of partitions over which keys are dealt by hash, are fixed by the first update. mark:
    where the table's mark is as great already, nothing is done."""
    now = manifest(folder) or Manifest(buckets=buckets, keys=keys)
    if now.keys != keys:
        raise ValueError(f"{folder} has the keys {now.keys}")
    if mark is not None and now.mark is not None and now.mark >= mark:
        return now
    rows = stored(new, "update")
    dealt = F.pmod(F.xxhash64(*keys), F.lit(now.buckets)).cast("int")
    touched = {str(r[0]) for r in rows.select(dealt).distinct().collect()}  # at most `buckets`
    old = read(spark, folder, sorted(touched)) if touched & set(now.parts) else None
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    parts, schema = dict(now.parts), now.schema
    if touched or not schema:
        out = combine(old, rows)
        schema = json.dumps(out.schema.jsonValue())
        if now.schema and [f.name for f in out.schema] != [f["name"] for f in json.loads(now.schema)["fields"]]:
            raise ValueError(f"the columns of {folder} are fixed")
        parts = {k: p for k, p in parts.items() if k not in touched} | _written(out, dealt, folder)
    kept = dict(now.beside)
    for name, table in (beside or {}).items():
        place = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        table.write.parquet(place)
        kept[name] = {"path": place, "schema": json.dumps(table.schema.jsonValue())}
    made = replace(now, version=now.version + 1, schema=schema, parts=parts, beside=kept, mark=mark if mark is not None else now.mark)
    _publish(folder, made)
    return made


def replace_all(spark: SparkSession, folder: str, rows: DataFrame, keys: list[str], buckets: int = 32) -> Manifest:
    """Publish rows as the whole table, whatever it held before; columns and keys may change."""
    now = manifest(folder)
    dealt = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    parts = _written(rows, dealt, folder)
    made = Manifest((now.version if now else 0) + 1, json.dumps(rows.schema.jsonValue()), buckets, keys, parts)
    _publish(folder, made)
    return made


def _written(rows: DataFrame, dealt: Column, folder: str) -> dict[str, str]:
    """Write rows beside the table's others; the folder of each partition that has any."""
    at = f"{folder.rstrip('/')}/rows-{uuid.uuid4().hex}"
    rows.withColumn(_PART, dealt).write.partitionBy(_PART).parquet(at)
    fs, path = filesystem(at)
    names = (f.base_name for f in fs.get_file_info(pafs.FileSelector(path)) if f.base_name.startswith(f"{_PART}="))
    return {n.split("=")[1]: f"{at}/{n}" for n in names}


def clear_old(folder: str, keep: int = 2) -> int:
    """Delete manifests but the newest `keep`, and folders that none of these names. Returns how many were deleted.

    To be run while nobody updates the table; readers of older versions lose their files."""
    fs, path = filesystem(folder)
    numbers = _numbers(fs, path)
    used = set()
    for n in numbers[-keep:]:
        with fs.open_input_file(f"{path}/manifest-{n:08d}.json") as f:
            known = Manifest(**json.loads(f.read()))
        places = [p.rsplit("/", 1)[0] for p in known.parts.values()] + [b["path"] for b in known.beside.values()]
        used |= {p.rsplit("/", 1)[1] for p in places}
    gone = 0
    for f in fs.get_file_info(pafs.FileSelector(path)):
        if f.type == pafs.FileType.Directory and f.base_name not in used:
            fs.delete_dir(f.path)
            gone += 1
    for n in numbers[:-keep]:
        fs.delete_file(f"{path}/manifest-{n:08d}.json")
        gone += 1
    return gone


def replacing(keys: list[str], latest: str | None = None) -> Combine:
    """New rows take the place of old ones with their key. Of new rows with one key that with the greatest `latest` counts,
    of equals the greatest row; null keys are keys like others."""

    def combine(old: DataFrame | None, new: DataFrame) -> DataFrame:
        row = F.struct(*([F.col(latest).alias("_latest")] if latest else []), *new.columns)
        one = new.groupBy(*keys).agg(F.max(row).alias("_row")).select(*(F.col(f"_row.{c}").alias(c) for c in new.columns))
        if old is None:
            return one
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        return old.alias("o").join(one.select(*keys).alias("n"), same, "left_anti").select(*new.columns).unionByName(one)

    return combine


def adding(keys: list[str], totals: dict[str, Callable[[str], Column]]) -> Combine:
    """Old and new rows of a key become one, each further column by its aggregate (F.sum, F.min, union_of_sets, ...)."""

    def combine(old: DataFrame | None, new: DataFrame) -> DataFrame:
        both = new if old is None else old.unionByName(new.select(*old.columns))
        return both.groupBy(*keys).agg(*(how(c).alias(c) for c, how in totals.items()))

    return combine


def union_of_sets(name: str) -> Column:
    """In an aggregation: the sorted union of array columns."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(name))))


def union_of_sketches(name: str) -> Column:
    """In an aggregation: the union of theta sketches."""
    return F.theta_union_agg(name)


def stream_into(stream: DataFrame, folder: str, make: Callable[[DataFrame], DataFrame], keys: list[str], combine: Combine, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Run a stream whose batches, through `make`, are combined into a table. The number of the last batch is the table's
    mark, so a batch that Spark hands over again after a failure counts once."""

    def take(batch: DataFrame, number: int) -> None:
        update(batch.sparkSession, folder, make(batch), keys, combine, mark=[number])

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**trigger).start()
