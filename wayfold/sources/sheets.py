"""Rows of spreadsheets (.xlsx, .xlsm): a data source that streams a sheet's XML out of its ZIP archive.

A file is one task, since its sheet is one compressed stream; rows leave in batches as they are read, so memory is bounded
by a batch and the file's table of shared strings. The first row that is not empty names the columns.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import Element, ParseError, iterparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayfold.plans.storage import filesystem

SCHEMA = "file string, row long, cells map<string,string>, error string"
_ARROW = pa.schema([("file", pa.string()), ("row", pa.int64()), ("cells", pa.map_(pa.string(), pa.string())), ("error", pa.string())])
_BATCH = 5_000
#: The columns of a recorded track that an import keeps.
TRACK_COLUMNS = ("dataTime", "longitude", "latitude", "heading", "accuracy", "speed", "distance", "altitude")


class SheetFile(InputPartition):
    def __init__(self, file: str):
        self.file = file


class SheetSource(DataSource):
    """Options: path (a file, or a folder of such), sheet (its name; default: the first), mode (failfast, or permissive: a
    broken file ends with a row that has an error)."""

    @classmethod
    def name(cls) -> str:
        return "wayfold_sheet"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return SheetReader(self.options)


class SheetReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.sheet, self.permissive = options["path"], options.get("sheet"), options.get("mode", "failfast").lower() == "permissive"

    def partitions(self) -> list[SheetFile]:
        import pyarrow.fs as pafs

        fs, path = filesystem(self.path)
        info = fs.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path))
        return [SheetFile(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.lower().endswith((".xlsx", ".xlsm"))]

    def read(self, partition: SheetFile) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, _ = filesystem(self.path)
        rows: list[dict] = []
        try:
            with fs.open_input_file(partition.file) as f, zipfile.ZipFile(f) as archive:
                for number, cells in sheet_rows(archive, self.sheet):
                    rows.append({"file": partition.file, "row": number, "cells": list(cells.items()), "error": None})
                    if len(rows) >= _BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows = []
        except (zipfile.BadZipFile, ParseError, KeyError, ValueError, EOFError) as broken:
            if not self.permissive:
                raise ValueError(f"{partition.file}: {broken}") from broken
            rows.append({"file": partition.file, "row": None, "cells": None, "error": f"{type(broken).__name__}: {broken}"})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _local(element: Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _text(element: Element) -> str:
    """The text of a string item: its runs together, without phonetic hints."""
    out = []
    for child in element:
        if _local(child) == "t":
            out.append(child.text or "")
        elif _local(child) == "r":
            out += [t.text or "" for t in child if _local(t) == "t"]
    return "".join(out)


def _sheet_part(archive: zipfile.ZipFile, sheet: str | None) -> str:
    """The archive's member that holds a sheet."""
    targets, names = {}, []
    with archive.open("xl/_rels/workbook.xml.rels") as f:
        for _, e in iterparse(f):
            if _local(e) == "Relationship":
                targets[e.get("Id")] = e.get("Target")
    with archive.open("xl/workbook.xml") as f:
        for _, e in iterparse(f):
            if _local(e) == "sheet":
                names.append((e.get("name"), next(v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "id" and "}" in k)))
    found = next((i for n, i in names if sheet is None or n == sheet), None)
    if found is None:
        raise KeyError(f"no sheet {sheet!r}")
    target = targets[found]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _shared(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    out = []
    with archive.open("xl/sharedStrings.xml") as f:
        for _, e in iterparse(f):
            if _local(e) == "si":
                out.append(_text(e))
                e.clear()
    return out


def _column(reference: str | None, after: int) -> int:
    """A cell's column from its reference (B7: 1); the one after the last where it has none."""
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return after + 1
    out = 0
    for c in letters.group():
        out = out * 26 + ord(c) - 64
    return out - 1


def _value(cell: Element, shared: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return next((_text(e) for e in cell if _local(e) == "is"), None)
    raw = next((e.text for e in cell if _local(e) == "v"), None)
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(raw)]
    return {"0": "false", "1": "true"}.get(raw, raw) if kind == "b" else raw


def sheet_rows(archive: zipfile.ZipFile, sheet: str | None = None) -> Iterator[tuple[int, dict[str, str]]]:
    """(row number, cells by column name) of a sheet's rows after the one with names; empty cells, and cells under no name,
    are left out. Of columns with one name the first that has a value counts."""
    shared, names, number, within = _shared(archive), None, 0, None
    with archive.open(_sheet_part(archive, sheet)) as f:
        for event, row in iterparse(f, ("start", "end")):
            if event == "start":
                within = row if _local(row) == "sheetData" else within
                continue
            if _local(row) != "row":
                continue
            number, cells, at = int(row.get("r", number + 1)), {}, -1
            for cell in row:
                at = _column(cell.get("r"), at)
                value = _value(cell, shared)
                if value is not None and value != "":
                    cells[at] = value
            within.clear()  # rows read so far
            if names is None:
                names = cells or None
                continue
            out: dict[str, str] = {}
            for place, value in cells.items():
                if place in names:
                    out.setdefault(names[place].strip(), value)
            yield number, out


def rows(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """file, row, cells (by column name) and error of all rows."""
    spark.dataSource.register(SheetSource)
    return spark.read.format("wayfold_sheet").options(path=path, **options).load()


def track_sheet(spark: SparkSession, path: str, columns: tuple[str, ...] = TRACK_COLUMNS, step: str = "stepType", **options: str) -> DataFrame:
    """The wanted columns of a recorded track as numbers, dataTime as whole seconds; a value that is no number is null.

    Rows of another step type than 0 are left out, those without one too, if the file has that column at all; rows without
    any wanted value are left out. A column that a file lacks is null."""
    cells = F.col("cells")
    found = rows(spark, path, **options).where("error is null")
    typed = found.where(F.array_contains(F.map_keys(cells), step)).select("file").distinct().withColumn("_typed", F.lit(True))
    met = found.join(F.broadcast(typed), "file", "left")  # a row a file
    kept = met.where(F.col("_typed").isNull() | (F.expr(f"try_cast(cells['{step}'] as double)") == 0))
    values = [F.expr(f"try_cast(cells['{c}'] as double)").cast("long" if c == "dataTime" else "double").alias(c) for c in columns]
    return kept.select("file", "row", *values).where(F.coalesce(*(F.col(c).cast("double") for c in columns)).isNotNull())
