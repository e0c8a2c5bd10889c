"""Corpus counts of hashed n-grams, brought back to the texts that hold them.

Texts are read in parts of about PART_BYTES. A part sends each distinct n-gram once, as a sorted array for each range
of hash values (bucket), each hash as its distance from the one before; a bucket's task adds up what all parts sent and
returns to each part the totals of what it had sent. So an n-gram that every text holds is one entry a part, never a
hot row. Where there are more than WIDE partitions, what WIDE partitions sent to a bucket is added up first, those sums
are added up, and come back the same way: no group has more rows than WIDE partitions have parts, or than there are
such groups of partitions. Totals are written to the shared folder, a file for each partition of the input, in the
order of its parts, for the pass over the same rows that uses them: a task reads them part by part and holds one part's
at a time. Both passes must see the same rows in the same partitions, as scans of files do; a part's name holds a
checksum of its n-grams, so that a pass over other rows fails instead of using wrong totals.

Bytes sent are in proportion to the n-grams. Arrays are one for each part and bucket that have any n-gram in common:
beyond some hundred gigabytes they hold few n-grams each, and in the limit one, as in a plain count by n-gram. Work on
a part is in proportion to its n-grams, whatever the number of buckets, and the number of tasks grows with the input.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.shared import filesystem, fresh_folder, materialise, release, small_batches

#: Bytes of text in a part, and text whose n-grams a bucket holds.
PART_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
#: Bytes of text whose totals one task writes, and folders over which the sums of buckets are spread.
BACK_BYTES, SUM_FOLDERS = 32 << 20, 64
#: Partitions of the input whose parts one group adds up; buckets that each have a task of their own, and buckets a task beyond.
WIDE, OWN_TASKS, TASK_BUCKETS = 1024, 256, 16
#: Totals of so many buckets are read at once.
_READ_ROWS = 256
#: For each kind of n-gram: sorted distinct hashes (uint32 or uint64) and what this part adds to each one's count.
Grams = dict[int, tuple[np.ndarray, np.ndarray]]


def parts(batches: Iterator[pa.RecordBatch], text: str = "text", part_bytes: int = PART_BYTES) -> Iterator[pa.Table]:
    """A partition's rows in consecutive parts."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(text)).nbytes
        if size >= part_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _partition() -> int:
    context = TaskContext.get()
    assert context is not None
    return context.partitionId()


def part_name(number: int, grams: Grams) -> str:
    """Names sort by partition, then by the part's number; the checksum comes last."""
    seal = 0
    for kind in sorted(grams):
        seal = zlib.crc32(grams[kind][0].data, seal)
    return f"{_partition():09d}-{number:09d}-{seal:08x}"


def _cuts(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """The buckets that have any of these sorted keys, in order, and where their keys are."""
    if not len(keys):
        return []
    high = keys.astype(np.uint64) if keys.dtype.itemsize == 4 else keys >> np.uint64(32)
    bucket = (high * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    end = np.append(begin[1:], len(keys))
    return [(b, slice(i, j)) for b, i, j in zip(bucket[begin].tolist(), begin.tolist(), end.tolist(), strict=True)]


def _packed(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, the lowest bytes of all first, without the planes that are all 0; compressed."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob[1:]), dtype=np.uint8).reshape(blob[0], -1)
    values = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    values[:, : blob[0]] = planes.T
    return values.view("<u8").ravel()


def _distances(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the distances between them."""
    return int(keys[0]).to_bytes(8, "little") + _packed(np.diff(keys.astype(np.uint64)))


def _from_distances(blob: bytes) -> np.ndarray:
    first = np.frombuffer(blob, dtype="<u8", count=1)
    return np.cumsum(np.concatenate([first, _unpacked(blob[8:])]), dtype=np.uint64)


class Totals:
    """Corpus counts of all n-grams, as files by partition; sums: kind -> (distinct counted n-grams, all counts)."""

    def __init__(self, folder: str, buckets: int, sums: dict[int, tuple[int, int]]):
        self.folder, self.buckets, self.sums = folder, buckets, sums
        self._read: tuple[int, int, Iterator[tuple[str, Iterator[tuple[str, int, int, bytes]]]]] | None = None

    def _stored(self) -> Iterator[tuple[str, int, int, bytes]]:
        """In a task: (part, kind, bucket, totals) of its partition, in this order."""
        fs, path = filesystem(f"{self.folder}/source={_partition()}")
        columns = ["part", "kind", "bucket", "totals"]
        for found in sorted(fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)), key=lambda f: f.base_name):
            if found.is_file and not found.base_name.startswith(("_", ".")):
                with fs.open_input_file(found.path) as file:
                    for batch in pq.ParquetFile(file, buffer_size=1 << 20).iter_batches(_READ_ROWS, columns=columns):
                        yield from zip(*(batch[c].to_pylist() for c in columns), strict=True)

    def of_part(self, number: int, grams: Grams) -> dict[int, np.ndarray]:
        """In a task: the totals of a part's n-grams, aligned with their sorted hashes. Parts are asked for in order."""
        out = {kind: np.zeros(len(keys), dtype=np.int64) for kind, (keys, _) in grams.items()}
        if not any(len(totals) for totals in out.values()):
            return out
        if self._read is None or self._read[0] != _partition() or self._read[1] >= number:
            self._read = _partition(), number, itertools.groupby(self._stored(), itemgetter(0))
        self._read = _partition(), number, self._read[2]
        name = part_name(number, grams)
        place = name.rpartition("-")[0]
        own = next((rows for part, rows in self._read[2] if part == name or part.rpartition("-")[0] >= place), iter(()))
        for kind in sorted(grams):
            for bucket, cut in _cuts(grams[kind][0], self.buckets):
                row = next(own, None)
                if row is None or row[:3] != (name, kind, bucket):
                    raise RuntimeError(f"no counts for part {name}: the two passes read different rows; write the input as a table first")
                out[kind][cut] = _unpacked(row[3])
        return out


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Of a bucket's rows: the distinct keys and their sums, and each row's keys as places among them, with where rows end."""
    keys = [_from_distances(x) for x in table["keys"].to_pylist()]
    added = np.concatenate([_unpacked(x) for x in table["added"].to_pylist()])
    upto = np.cumsum([len(k) for k in keys]).tolist()
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(which, weights=added, minlength=len(distinct)).astype(np.int64), which, upto


def _returned(table: pa.Table, totals: np.ndarray, which: np.ndarray, upto: list[int]) -> pa.Table:
    """For each row of a bucket the totals of its keys."""
    rows = len(table)
    own = [_packed(totals[which[begin:end]]) for begin, end in zip([0, *upto[:-1]], upto, strict=True)]
    none = pa.array([0] * rows, pa.int64())
    return pa.table({**{c: table[c] for c in ("source", "part", "kind", "bucket")}, "totals": pa.array(own, pa.binary()), "n_counted": none, "n_all": none})


def corpus_counts(
    docs: DataFrame, grams_of: Callable[[pa.Table], Grams], name: str, kinds: int = 1, text: str = "text", part_bytes: int = PART_BYTES, bucket_bytes: int = BUCKET_BYTES, wide: int = WIDE
) -> Totals:
    """Count all n-grams that grams_of finds in parts of docs, of so many kinds."""
    spark = docs.sparkSession
    small_batches(spark)
    size, last = docs.select(F.octet_length(text).cast("long").alias("n"), F.spark_partition_id().alias("p")).agg(F.sum("n"), F.max("p")).first()
    size = size or 0
    buckets = max(1, -(-size // bucket_bytes))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in enumerate(parts(batches, text, part_bytes)):
            grams = grams_of(part)
            name = part_name(number, grams)
            for kind, (keys, added) in grams.items():
                cuts = _cuts(keys, buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kind] * len(cuts), pa.int32()),
                        pa.array([b for b, _ in cuts], pa.int32()),
                        pa.array([_partition()] * len(cuts), pa.int32()),
                        pa.array([name] * len(cuts), pa.string()),
                        pa.array([_distances(keys[c]) for _, c in cuts], pa.binary()),
                        pa.array([_packed(added[c]) for _, c in cuts], pa.binary()),
                    ],
                    names=["kind", "bucket", "source", "part", "keys", "added"],
                )

    def add_up(table: pa.Table) -> pa.Table:
        _, totals, which, upto = _added(table)
        bucket = table["bucket"][0].as_py()
        found = _returned(table, totals, which, upto)
        sums = [[-1 - bucket % SUM_FOLDERS], [""], [table["kind"][0].as_py()], [bucket], [b""], [int((totals > 0).sum())], [int(totals.sum())]]
        return pa.concat_tables([found, pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(sums, found.schema, strict=True)], schema=found.schema)])

    def merge(table: pa.Table) -> pa.Table:
        distinct, totals, _, _ = _added(table)
        one = table.slice(0, 1)
        return pa.table({"kind": one["kind"], "bucket": one["bucket"], "source": one["wide"], "part": [""], "keys": [_distances(distinct)], "added": [_packed(totals)]})

    def bring_back(table: pa.Table, known: pa.Table) -> pa.Table:
        _, _, which, upto = _added(table)
        return _returned(table, _unpacked(known["totals"][0].as_py()), which, upto)

    groups = kinds * buckets
    tasks = max(min(groups, OWN_TASKS), -(-groups // TASK_BUCKETS))
    sent = docs.mapInArrow(send, array_schema := "kind int, bucket int, source int, part string, keys binary, added binary")
    schema = "part string, kind int, bucket int, totals binary, n_counted long, n_all long"
    if (last or 0) < wide:
        totals = sent.repartition(tasks, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(add_up, f"source int, {schema}")
    else:
        sent, _ = materialise(sent.withColumn("wide", F.floor(F.col("source") / wide).cast("int")), f"{name}-sent")
        merged = sent.groupBy("kind", "bucket", "wide").applyInArrow(merge, array_schema)
        summed, _ = materialise(merged.groupBy("kind", "bucket").applyInArrow(add_up, f"source int, {schema}"), f"{name}-sums")
        known = summed.where("source >= 0").select("kind", "bucket", F.col("source").alias("wide"), "totals")
        by = ["kind", "bucket", "wide"]
        back = sent.groupBy(*by).cogroup(known.groupBy(*by)).applyInArrow(bring_back, f"source int, {schema}")
        totals = back.union(summed.where("source < 0"))
    folder = fresh_folder(spark, f"{name}-counts")
    dealt = totals.repartition(max(1, -(-size // BACK_BYTES)), "source").sortWithinPartitions("source", "part", "kind", "bucket")
    dealt.write.partitionBy("source").parquet(folder)
    release(spark)
    fs, path = filesystem(folder)
    own = [k for k in range(min(buckets, SUM_FOLDERS)) if fs.get_file_info(f"{path}/source={-1 - k}").type == pafs.FileType.Directory]
    if not own:
        return Totals(folder, buckets, {})
    found = spark.read.schema(schema).parquet(*(f"{folder}/source={-1 - k}" for k in own)).groupBy("kind").agg(F.sum("n_counted").alias("n"), F.sum("n_all").alias("c")).collect()
    return Totals(folder, buckets, {r["kind"]: (r["n"], r["c"]) for r in found})
