"""Polygons from shapefiles: a data source that reads records by ranges, and a sink that writes a file for each partition.

A shapefile is three files side by side: shapes (.shp), their offsets (.shx) and a table of attributes (.dbf). The source
plans ranges of record numbers from the offset file's size alone; a task reads its part of the offsets and of the table,
then the shapes in blocks of consecutive records, so memory is bounded by a block and the largest shape.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayfold.plans.storage import filesystem, fresh_folder

_POINT = pa.struct([("lat", pa.float64()), ("lon", pa.float64())])
_SCHEMA = pa.schema([("file", pa.string()), ("record", pa.int64()), ("attributes", pa.map_(pa.string(), pa.string())), ("rings", pa.list_(pa.list_(_POINT))), ("error", pa.string())])
SCHEMA = "file string, record long, attributes map<string,string>, rings array<array<struct<lat:double,lon:double>>>, error string"
RINGS = "array<array<struct<lat:double,lon:double>>>"
#: Fixed values of the format: magic number, version, header bytes, shape types that are polygons (plain, with Z, with M).
_MAGIC, _VERSION, _HEADER, _POLYGONS = 9994, 1000, 100, (5, 15, 25)
#: Bytes of consecutive shapes read at once.
BLOCK_BYTES = 8 << 20


class RecordRange(InputPartition):
    def __init__(self, file: str, first: int, last: int):
        self.file, self.first, self.last = file, first, last


class ShapefileSource(DataSource):
    """Options: path (a .shp file, or a folder of such), records (a task's range, default 2000), encoding of the attributes
    (default: as the .cpg file says, else UTF-8), mode (failfast, or permissive: a broken record has an error and no rings)."""

    @classmethod
    def name(cls) -> str:
        return "wayfold_shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return ShapefileReader(self.options)


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.records = options["path"], int(options.get("records", "2000"))
        self.encoding, self.permissive = options.get("encoding"), options.get("mode", "failfast").lower() == "permissive"

    def partitions(self) -> list[RecordRange]:
        import pyarrow.fs as pafs

        fs, path = filesystem(self.path)
        info = fs.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path))
        out = []
        for name in sorted(f.path for f in found if f.path.lower().endswith(".shp")):
            total = (fs.get_file_info(name[:-4] + ".shx").size - _HEADER) // 8
            out += [RecordRange(name, k, min(k + self.records, total)) for k in range(0, total, self.records)]
        return out

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, _ = filesystem(self.path)
        stem, first, last = partition.file[:-4], partition.first, partition.last
        with fs.open_input_file(stem + ".shx") as f:
            index = np.frombuffer(f.read_at(8 * (last - first), _HEADER + 8 * first), ">i4").reshape(-1, 2).astype(np.int64) * 2
        table = _Attributes(fs, stem, self.encoding)
        rows = table.read(first, last)
        with fs.open_input_file(partition.file) as shapes:
            begin = 0
            while begin < len(index):
                start, end = int(index[begin, 0]), begin + 1
                while end < len(index) and index[end, 0] >= index[end - 1, 0] and index[end].sum() + 8 - start <= BLOCK_BYTES:
                    end += 1
                block = shapes.read_at(int(index[begin:end].sum(axis=1).max()) + 8 - start, start)
                yield self._batch(partition.file, first, begin, end, index, start, block, rows)
                begin = end

    def _batch(self, file: str, first: int, begin: int, end: int, index: np.ndarray, start: int, block: bytes, rows: list[dict | None]) -> pa.RecordBatch:
        out = []
        for k in range(begin, end):
            if rows[k] is None:
                continue
            rings, error = None, None
            try:
                rings = polygon_rings(block, int(index[k, 0]) - start, int(index[k, 1]))
            except (ValueError, struct.error) as broken:
                error = str(broken)
                if not self.permissive:
                    raise ValueError(f"{file}, record {first + k}: {error}") from broken
            out.append({"file": file, "record": first + k, "attributes": list(rows[k].items()), "rings": rings, "error": error})
        return pa.RecordBatch.from_pylist(out, schema=_SCHEMA)


def polygon_rings(block: bytes, at: int, length: int) -> list[list[dict]]:
    """The rings of the record at a place in a block of shapes; none for a null shape."""
    body = block[at + 8 : at + 8 + length]
    if len(body) < length or length < 4:
        raise ValueError("the record is cut off")
    (kind,) = struct.unpack_from("<i", body)
    if kind == 0:
        return []
    if kind not in _POLYGONS:
        raise ValueError(f"shape type {kind} is no polygon")
    parts, points = struct.unpack_from("<2i", body, 36)
    if parts < 0 or points < 0 or len(body) < 44 + 4 * parts + 16 * points:
        raise ValueError("counts of parts and points do not fit the record")
    starts = np.frombuffer(body, "<i4", parts, 44).tolist() + [points]
    corners = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    if sorted(starts) != starts or starts[0] != 0:
        raise ValueError("parts do not ascend")
    return [[{"lat": y, "lon": x} for x, y in corners[a:b].tolist()] for a, b in zip(starts, starts[1:])]


class _Attributes:
    """Rows of the table beside the shapes, by record number."""

    def __init__(self, fs: object, stem: str, encoding: str | None):
        self.fs, self.name = fs, stem + ".dbf"
        self.encoding = encoding or self._declared(stem) or "utf-8"

    def _declared(self, stem: str) -> str | None:
        info = self.fs.get_file_info(stem + ".cpg")
        if not info.is_file:
            return None
        with self.fs.open_input_file(stem + ".cpg") as f:
            name = f.read().decode("ascii", "ignore").strip()
        try:
            "".encode(name)
        except LookupError:
            return None
        return name or None

    def read(self, first: int, last: int) -> list[dict[str, str | None] | None]:
        """None for a row that is marked as deleted."""
        with self.fs.open_input_file(self.name) as f:
            head = f.read_at(32, 0)
            size, width = struct.unpack_from("<2H", head, 8)
            described = f.read_at(size - 32, 32)
            raw = f.read_at((last - first) * width, size + first * width)
        fields, at, k = [], 1, 0
        while k + 32 <= len(described) and described[k] != 0x0D:
            name = described[k : k + 11].split(b"\0")[0].decode(self.encoding, "replace")
            fields.append((name, at, at + described[k + 16]))
            at, k = at + described[k + 16], k + 32
        rows = []
        for r in range(last - first):
            row = raw[r * width : (r + 1) * width]
            values = {n: row[a:b].decode(self.encoding, "replace").strip(" \0") or None for n, a, b in fields}
            rows.append(None if row[:1] == b"*" else values)
        return rows


def shapes(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """file, record, attributes, rings, error of all polygons; null shapes have no rings, deleted rows are left out."""
    spark.dataSource.register(ShapefileSource)
    return spark.read.format("wayfold_shapefile").options(path=path, **options).load()


def shapefile_areas(spark: SparkSession, path: str, names: dict[str, str] | None = None, **options: str) -> DataFrame:
    """province, city, county, town and rings of all polygons, as `areas` gives them from GeoJSON.

    names: the attribute behind each place (by default of the same name); absent ones are null. All rings of a record
    count, so holes and islands within holes are what an even-odd rule says, whatever their order and direction."""

    def place(name: str) -> Column:
        return F.col("attributes")[(names or {}).get(name, name)].alias(name)

    found = shapes(spark, path, **options)
    return found.where("error is null and size(rings) > 0").select(*(place(n) for n in ("province", "city", "county", "town")), "rings")


def write_shapefiles(areas: DataFrame, folder: str | None = None) -> str:
    """Write areas (rings, and further columns as text attributes of up to 254 bytes in UTF-8) as one shapefile for each
    partition that has rows (a task holds its partition; the format ends at 4 GB). Returns the folder. A retried task writes the same names again, whole files by a rename.

    Text is cut at a whole character; column names are cut to ten bytes, which must leave them different."""
    folder = folder or fresh_folder(areas.sparkSession, "shapefiles")
    columns = [c for c in areas.columns if c != "rings"]
    if len({c.encode()[:10] for c in columns}) < len(columns):
        raise ValueError("names of attributes differ only beyond ten bytes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        rows = [row for batch in batches for row in batch.to_pylist()]
        if rows:
            _write_one(folder, f"part-{task.partitionId():05d}", task.taskAttemptId(), columns, rows)
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(rows)], pa.int64())})

    text = areas.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns), F.col("rings").cast(RINGS).alias("rings"))
    text.mapInArrow(write, "n long").agg(F.sum("n")).first()
    return folder


def _write_one(folder: str, name: str, attempt: int, columns: list[str], rows: list[dict]) -> None:
    records, offsets, at, low, high = [], [], _HEADER // 2, np.full(2, np.inf), np.full(2, -np.inf)
    for k, row in enumerate(rows):
        body = _record(row["rings"] or [])
        records.append(struct.pack(">2i", k + 1, len(body) // 2) + body)
        offsets.append(struct.pack(">2i", at, len(body) // 2))
        at += 4 + len(body) // 2
        for ring in row["rings"] or []:
            corners = np.array([(p["lon"], p["lat"]) for p in ring]).reshape(-1, 2)
            low, high = np.minimum(low, corners.min(axis=0, initial=np.inf)), np.maximum(high, corners.max(axis=0, initial=-np.inf))
    box = [*low, *high] if np.isfinite(low).all() else [0.0] * 4

    def head(words: int) -> bytes:
        return struct.pack(">7i", _MAGIC, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", _VERSION, _POLYGONS[0], *box, 0, 0, 0, 0)

    values = [[_fitted(row[c]) for c in columns] for row in rows]
    widths = [max(1, *(len(v[i]) for v in values)) for i in range(len(columns))]
    fields = b"".join(c.encode()[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([w, 0]) + bytes(14) for c, w in zip(columns, widths))
    table = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + len(fields), 1 + sum(widths)) + fields + b"\r"
    table += b"".join(b" " + b"".join(v.ljust(w) for v, w in zip(row, widths)) for row in values) + b"\x1a"
    content = {"shp": head(at) + b"".join(records), "shx": head(_HEADER // 2 + 4 * len(rows)) + b"".join(offsets), "dbf": table, "cpg": b"UTF-8"}
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    for kind in ("cpg", "dbf", "shx", "shp"):  # shapes last: a reader lists those
        with fs.open_output_stream(f"{path}/_{name}-{attempt}.{kind}.tmp") as f:
            f.write(content[kind])
        fs.move(f"{path}/_{name}-{attempt}.{kind}.tmp", f"{path}/{name}.{kind}")


def _fitted(value: str | None) -> bytes:
    return (value or "").encode()[:254].decode("utf-8", "ignore").encode()


def _record(rings: list[list[dict]]) -> bytes:
    """A polygon's content; each ring is closed. No rings give a null shape."""
    closed = [r if r[0] == r[-1] else [*r, r[0]] for r in rings if r]
    if not closed:
        return struct.pack("<i", 0)
    corners = np.array([(p["lon"], p["lat"]) for r in closed for p in r], "<f8")
    starts = np.cumsum([0] + [len(r) for r in closed[:-1]])
    return struct.pack("<i4d2i", _POLYGONS[0], *corners.min(axis=0), *corners.max(axis=0), len(closed), len(corners)) + starts.astype("<i4").tobytes() + corners.tobytes()
