"""Media columns: payloads as 8-bit images in ZIP archives, and a data source that reads archive members in place.

A payload, padded with zero bytes to a positive multiple of 64, is stored losslessly as an 8-bit grey PNG, 64 pixels
wide; its text chunk `payload-bytes` has the length before padding. Archives are plain ZIP files with stored members.

The data source `media_archive` lists archives and cuts each into byte ranges; nothing but file names and sizes passes
the driver. A task reads the archive's directory, takes the members whose headers begin in its range, and yields them
in Arrow batches. Every member is fetched by its own offset and checked against its CRC-32; a member that fails is
fetched again up to `attempts` times without its neighbours. Then it ends the job, or with mode=permissive it becomes
a row with its error.

Nulls: a null payload is empty; a null key is read back as null. Repeated rows are members of their own. An empty
table gives no archives and no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from wayfold.llm.shared import filesystem, fresh_folder, materialise, publish, small_batches

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: An archive is closed beyond so many bytes; a range that one task reads; a batch of members.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 128 << 20, 32 << 20, 4 << 20


def padded(payload: bytes) -> bytes:
    return payload + bytes(max(WIDTH, -(-len(payload) // WIDTH) * WIDTH) - len(payload))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """The PNG of a padded payload; equal payloads have equal files."""
    samples = np.frombuffer(padded(payload), dtype=np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), dtype=np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = samples
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    note = b"payload-bytes\0" + str(len(payload)).encode()
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", note) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[np.ndarray, int]:
    """The samples of an 8-bit grey PNG, row by row, and the payload's length before padding."""
    if media[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, data, width, height, length = 8, [], 0, 0, -1
    while at < len(media):
        if len(media) < at + 8 or len(media) < at + 12 + int.from_bytes(media[at : at + 4]):
            raise ValueError("the PNG is cut off")
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"PNG chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("not a plain 8-bit grey PNG")
        elif kind == b"tEXt" and body.startswith(b"payload-bytes\0"):
            length = int(body[14:])
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered PNG rows are not supported")
    samples = rows[:, 1:].ravel()
    return samples, len(samples) if length < 0 else length


def features(samples: np.ndarray) -> dict[str, float]:
    """What a signal's samples look like: level, spread, crest, zero crossings about the mid level, and entropy."""
    x = samples.astype(np.float64) - 128
    share = np.bincount(samples, minlength=256) / len(samples)
    share = share[share > 0]
    return {
        "mean": float(x.mean()),
        "rms": float(np.sqrt((x * x).mean())),
        "peak": float(np.abs(x).max()),
        "crossings": float((np.signbit(x[1:]) != np.signbit(x[:-1])).mean()),
        "entropy": float(-(share * np.log2(share)).sum()),
    }


def write_media(rows: DataFrame, key: str, payload: str) -> tuple[DataFrame, str]:
    """Store a binary or text column as PNG members of ZIP archives; returns (archive, members) and the folder."""
    spark = rows.sparkSession
    small_batches(spark)
    folder = fresh_folder(spark, "media")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        context = TaskContext.get()
        assert context is not None
        done: list[dict] = []
        out = archive = None
        name, members = "", 0

        def close() -> None:
            if archive is not None:
                archive.close()
                out.close()
                publish(fs, f"{path}/_{name}-{context.taskAttemptId()}", f"{path}/{name}")
                done.append({"archive": name, "members": members})

        for batch in batches:
            for key_value, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive is None or out.tell() > ARCHIVE_BYTES:
                    close()
                    name, members = f"media-{context.partitionId():07d}-{len(done):05d}.zip", 0
                    out = fs.open_output_stream(f"{path}/_{name}-{context.taskAttemptId()}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                member = zipfile.ZipInfo(f"{members:08d}/{'' if key_value is None else key_value}.png")
                archive.writestr(member, to_png(value or b""))
                members += 1
        close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("archive", pa.string()), ("members", pa.int64())]))

    binary = F.col(payload) if dict(rows.dtypes)[payload] == "binary" else F.encode(F.col(payload), "UTF-8")
    written = rows.select(F.col(key).cast("string").alias("key"), binary.alias("payload")).mapInArrow(write, "archive string, members long")
    return materialise(written, "media-archives")[0], folder


@dataclass
class MemberRange(InputPartition):
    """Members of an archive whose headers begin in [begin, end)."""

    path: str
    begin: int
    end: int


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.attempts = int(options.get("attempts", "4"))
        self.permissive = options.get("mode", "failfast").lower() == "permissive"
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", str(RANGE_BYTES))))

    def partitions(self) -> list[InputPartition]:
        fs, path = filesystem(self.folder)
        files = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        found = [x for x in files if x.is_file and x.base_name.endswith(".zip") and not x.base_name.startswith(("_", "."))]
        ranges = [MemberRange(x.path, at, min(at + self.range_bytes, x.size)) for x in sorted(found, key=lambda x: x.path) for at in range(0, x.size, self.range_bytes)]
        return list(ranges) or [MemberRange("", 0, 0)]

    def _fetch(self, fs: pafs.FileSystem, path: str, member: zipfile.ZipInfo) -> bytes:
        """One member's bytes, by its offset alone."""
        for attempt in range(1, self.attempts + 1):
            try:
                with fs.open_input_file(path) as source:
                    head = source.read_at(30, member.header_offset)
                    if head[:4] != b"PK\x03\x04":
                        raise OSError(f"no member at offset {member.header_offset}")
                    name, extra = struct.unpack_from("<HH", head, 26)
                    body = source.read_at(member.compress_size, member.header_offset + 30 + name + extra)
                if member.compress_type == zipfile.ZIP_DEFLATED:
                    body = zlib.decompress(body, -15)
                if len(body) != member.file_size or zlib.crc32(body) != member.CRC:
                    raise OSError(f"member {member.filename} is damaged")
                return body
            except (OSError, zlib.error):
                if attempt == self.attempts:
                    raise
                time.sleep(0.05 * 2**attempt)
        raise AssertionError

    def read(self, partition: MemberRange) -> Iterator[pa.RecordBatch]:  # type: ignore[override]
        if not partition.path:
            return
        fs, _ = filesystem(self.folder)
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
        archive = partition.path.rpartition("/")[2]
        try:
            with fs.open_input_file(partition.path) as source, zipfile.ZipFile(source) as directory:
                members = [m for m in directory.infolist() if partition.begin <= m.header_offset < partition.end]
        except (zipfile.BadZipFile, OSError) as e:
            if not self.permissive:
                raise
            if partition.begin == 0:  # once for the archive
                yield pa.RecordBatch.from_pylist([{"archive": archive, "member": None, "offset": None, "content": None, "error": str(e)}], schema=schema)
            return
        rows: list[dict] = []
        size = 0
        for member in members:
            body, error = None, None
            try:
                body = self._fetch(fs, partition.path, member)
            except (OSError, zlib.error) as e:
                if not self.permissive:
                    raise
                error = str(e)
            rows.append({"archive": archive, "member": member.filename, "offset": member.header_offset, "content": body, "error": error})
            size += len(body or b"")
            if size > BATCH_BYTES or len(rows) == 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class MediaArchive(DataSource):
    """spark.read.format("media_archive").load(folder): archive, member, offset, content, error.

    Options: attempts (4), mode (failfast or permissive), rangeBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, content binary, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MediaArchiveReader(self.options)


def read_media(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(folder)


def member_key(member: str, kind: str) -> Column:
    """The key within a member's name, null if the row had none."""
    name = F.regexp_extract(member, r"^\d+/(.*)\.png$", 1)
    return F.when(F.length(name) > 0, name).cast(kind)


def describe(media: DataFrame, content: str = "content", permissive: bool = False) -> DataFrame:
    """Decode PNG members: adds payload (padded bytes), n_bytes (before padding) and feature (text).

    A member that is no such PNG ends the job; if permissive, its added columns are null and the column error says why."""
    schema = StructType.fromJson(media.schema.jsonValue()).add("payload", "binary").add("n_bytes", "long").add("feature", "string")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload, length, feature, errors = [], [], [], batch.column("error").to_pylist() if permissive else []
            for k, body in enumerate(batch.column(batch.schema.get_field_index(content)).to_pylist()):
                samples, n = None, None
                if body is not None:
                    try:
                        samples, n = from_png(body)
                    except (ValueError, IndexError, KeyError, struct.error, zlib.error) as e:
                        if not permissive:
                            raise
                        errors[k] = f"no such PNG: {e}"
                payload.append(None if samples is None else samples.tobytes())
                length.append(n)
                feature.append(None if samples is None else ";".join(f"{k}={v:.6f}" for k, v in features(samples).items()))
            kept = [pa.array(errors, pa.string()) if permissive and n == "error" else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
            columns = [*kept, pa.array(payload, pa.binary()), pa.array(length, pa.int64()), pa.array(feature, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "payload", "n_bytes", "feature"])

    return media.mapInArrow(decode, schema)
