"""Token ids of a corpus as raw binary shards with a minimal perfect hash index for keyed access.

A shard is two files: `NAME.ids`, the ids of its documents in key order, little-endian unsigned (2 bytes an id where
the vocabulary allows it, else 4); and `NAME.idx`, a JSON header line followed by the index arrays. The index maps a
document's key to a slot in constant time; the slot holds a fingerprint of the key and the document's ordinal, whose
start in the payload follows. Keys lie in ascending order over all shards.

Nulls: a null text is empty; a null key comes first and is found as None. Equal keys stand side by side, and the
index returns all that a shard has. An empty table gives no shards. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm import perfecthash
from wayfold.llm.encode import encoder, vocabulary_path, with_end
from wayfold.llm.shared import filesystem, fresh_folder, materialise, publish, small_batches

_MAGIC = "wayfold-ids-1"
#: Documents in a shard at most; a partition with more begins another.
SHARD_DOCS = 500_000
_MANIFEST = "shard string, n_docs long, n_tokens long"


def key_hash(key: object) -> int:
    return xxhash.xxh64_intdigest(b"\0" if key is None else b"\1" + str(key).encode())


@dataclass
class _ShardWriter:
    """Writes one shard: payload as it comes, index at the end."""

    folder: str
    name: str
    width: int
    attempt: int
    keys: list = field(default_factory=list)
    lengths: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.fs, self.path = filesystem(self.folder)
        self.temporary = f"{self.path}/_{self.name}-{self.attempt}"
        self.payload = self.fs.open_output_stream(f"{self.temporary}.ids")

    def add(self, keys: list, ids: np.ndarray, starts: np.ndarray) -> None:
        self.payload.write(ids.astype(f"<u{self.width}").tobytes())
        self.keys += keys
        self.lengths.append(np.diff(starts))

    def close(self) -> dict:
        self.payload.close()
        starts = np.concatenate([[0], np.cumsum(np.concatenate(self.lengths))]).astype("<u8")
        first = np.array([k for k, key in enumerate(self.keys) if k == 0 or key != self.keys[k - 1]], dtype="<u4")
        count = np.diff(first, append=len(self.keys)).astype("<u4")
        hashes = np.fromiter((key_hash(self.keys[k]) for k in first), np.uint64, len(first))
        seeds = perfecthash.build(hashes)
        slot = perfecthash.lookup(seeds, len(first), hashes)
        ordinal, run, fingerprint = (np.zeros(len(first), dtype="<u4") for _ in range(3))
        ordinal[slot], run[slot], fingerprint[slot] = first, count, (hashes >> np.uint64(32)).astype("<u4")
        stored = pa.BufferOutputStream()
        table = pa.table({"key": pa.array(self.keys)})
        with pa.ipc.new_stream(stored, table.schema) as writer:
            writer.write_table(table)
        parts = {"starts": starts, "seeds": seeds.astype("<i4"), "ordinal": ordinal, "run": run, "fingerprint": fingerprint}
        header = {"magic": _MAGIC, "width": self.width, "docs": len(self.keys), "keys": len(first), "tokens": int(starts[-1]), "parts": {k: [v.dtype.str, len(v)] for k, v in parts.items()}}
        with self.fs.open_output_stream(f"{self.temporary}.idx") as out:
            out.write(json.dumps(header).encode() + b"\n")
            for part in parts.values():
                out.write(part.tobytes())
            out.write(stored.getvalue())
        for end in (".ids", ".idx"):
            publish(self.fs, f"{self.temporary}{end}", f"{self.path}/{self.name}{end}")
        return {"shard": self.name, "n_docs": len(self.keys), "n_tokens": int(starts[-1])}


class Shard:
    """A shard's index in memory and keyed access to its payload."""

    def __init__(self, folder: str, name: str):
        self.fs, path = filesystem(folder)
        with self.fs.open_input_file(f"{path}/{name}.idx") as source:
            raw = source.read()
        line, _, body = raw.partition(b"\n")
        self.header = json.loads(line)
        if self.header["magic"] != _MAGIC:
            raise ValueError(f"{name}.idx is no index of token ids")
        at = 0
        for part, (kind, n) in self.header["parts"].items():
            array = np.frombuffer(body, dtype=kind, count=n, offset=at)
            setattr(self, part, array)
            at += array.nbytes
        self.keys = pa.ipc.open_stream(body[at:]).read_all()["key"]
        self.width = self.header["width"]
        self.payload = self.fs.open_input_file(f"{path}/{name}.ids")
        if self.payload.size() != self.width * self.header["tokens"]:
            raise ValueError(f"{name}.ids has {self.payload.size()} bytes, not {self.width} x {self.header['tokens']}")

    def find(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """The first ordinal and the number of documents of each key (0: not in this shard)."""
        if not self.header["keys"]:
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        hashes = np.fromiter(map(key_hash, keys), np.uint64, len(keys))
        slot = perfecthash.lookup(self.seeds, self.header["keys"], hashes)
        known = self.fingerprint[slot] == (hashes >> np.uint64(32)).astype("<u4")
        return self.ordinal[slot].astype(np.int64), np.where(known, self.run[slot], 0).astype(np.int64)

    def read(self, ordinal: int) -> np.ndarray:
        """The ids of the document with this ordinal."""
        begin, end = int(self.starts[ordinal]), int(self.starts[ordinal + 1])
        return np.frombuffer(self.payload.read_at((end - begin) * self.width, begin * self.width), dtype=f"<u{self.width}")

    def get(self, key: object) -> list[np.ndarray]:
        """The ids of all documents with this key, in constant time."""
        (first,), (count,) = self.find([key])
        return [self.read(int(first) + k) for k in range(int(count))]


def write_shards(docs: DataFrame, vocabulary: str, keeps_space: bool = True, end_id: int = 0, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Encode every whole text, append end_id, and write shards in ascending key order.

    Returns the shards' manifest (shard, n_docs, n_tokens; by name in key order) and their folder. Rows are dealt by
    ranges of (key, hash of text), so that many rows of one key spread over partitions and still stand in order; the
    number of partitions follows spark.sql.shuffle.partitions and adaptive sizes. Each task streams its rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = fresh_folder(spark, "ids")

    def encode_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        context = TaskContext.get()
        assert context is not None
        encode = encoder(vocabulary_path(vocabulary), keeps_space)
        width = 2 if max(len(encode.token_bytes), end_id + 1) <= 1 << 16 else 4
        writer, done = None, []
        for batch in batches:
            if writer is not None and len(writer.keys) >= SHARD_DOCS:
                done.append(writer.close())
                writer = None
            if writer is None:
                writer = _ShardWriter(folder, f"shard-{context.partitionId():07d}-{len(done):05d}", width, context.taskAttemptId())
            ids, starts = with_end(*encode.encode(batch.column(1)), end_id)
            writer.add(batch.column(0).to_pylist(), ids, starts)
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("key", "h").sortWithinPartitions("key", "h", "text").select("key", "text")
    manifest, _ = materialise(ordered.mapInArrow(encode_partition, _MANIFEST), "ids-manifest")
    return manifest, folder


def read_shards(manifest: DataFrame, folder: str, key_type: str) -> DataFrame:
    """Read shards back through their index: key, start (ids of all documents before it), n_tokens, ids_crc32.

    start needs each shard's base, a running sum over the manifest's one row a shard. ids_crc32 is the unsigned CRC-32
    of the ids as little-endian unsigned 32-bit integers.
    """
    spark = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["shard"])
                keys = shard.keys.to_pylist()
                distinct = [k for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
                first, count = shard.find(distinct)
                if int(count.sum()) != len(keys):
                    raise ValueError(f"the index of {row['shard']} finds {int(count.sum())} of {len(keys)} documents")
                for k in range(0, len(distinct), 4096):
                    some = [(key, at) for key, begin, n in zip(distinct[k : k + 4096], first[k : k + 4096].tolist(), count[k : k + 4096].tolist(), strict=True) for at in range(begin, begin + n)]
                    ids = [shard.read(at) for _, at in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key for key, _ in some], shard.keys.type),
                            pa.array([row["base"] + int(shard.starts[at]) for _, at in some], pa.int64()),
                            pa.array([len(x) for x in ids], pa.int64()),
                            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        ],
                        names=["key", "start", "n_tokens", "ids_crc32"],
                    )

    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.withColumn("base", base).repartition(max(1, spark.sparkContext.defaultParallelism), "shard")
    return shards.mapInArrow(read, f"key {key_type}, start long, n_tokens long, ids_crc32 long")
