"""WARC archives compressed with a shared Zstandard dictionary: one frame per record, the dictionary in front.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, then has one Zstandard frame per
record; a reader loads the dictionary once and decodes record by record, from the start or from any record's offset.
The reader checks the version line, the mandatory headers, that the block has Content-Length bytes and is closed by
two line ends, and the payload's SHA-1.

Of equal payloads of at least `least` bytes, the record with the smallest id is the response and the others revisit it;
shorter ones are all responses. Nulls: a null payload is empty; a null url is an empty target; a null id counts as
larger than all ids and is read back as null. Repeated rows with the smallest id are all responses. An empty table
gives no files. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.shared import filesystem, fresh_folder, materialise, publish, small_batches

DICTIONARY_FRAME = 0x184D2A5D
_FRAME = zstandard.MAGIC_NUMBER.to_bytes(4, "little")
#: A file's dictionary is trained on payloads of its first records, up to so many records and bytes of each.
TRAIN_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES = 200, 16 << 10, 32 << 10
#: A file is closed beyond so many bytes.
FILE_BYTES = 256 << 20
#: Groups of equal payloads that may be sent to all executors, at 100 bytes each; more are joined by a shuffle.
BROADCAST_GROUPS = 200_000
#: Tasks over which rows with one payload are spread where there are more groups.
SALTS = 32
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
RECORD = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary, file string, offset long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: object, url: str | None, payload: bytes, response: object) -> bytes:
    """A response record, or a revisit record if `response` is another page's id."""
    digest, revisit = payload_digest(payload), response is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{response}>")]
    return _record("revisit" if revisit else "response", f"urn:page:{'' if page_id is None else page_id}", headers, http if revisit else http + payload)


class ArchiveWriter:
    """One archive file."""

    def __init__(self, folder: str, name: str, attempt: int, samples: list[bytes]):
        self.fs, path = filesystem(folder)
        self.fs.create_dir(path, recursive=True)
        self.temporary, self.final = f"{path}/_{name}-{attempt}", f"{path}/{name}"
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
        except zstandard.ZstdError:  # too few or too small samples
            dictionary = zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True)
        raw = dictionary.as_bytes()
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(DICTIONARY_FRAME.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw)
        self.size = 8 + len(raw)
        self.add(_record("warcinfo", f"urn:file:{name}", [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def add(self, record: bytes) -> None:
        frame = self.compressor.compress(record)
        self.out.write(frame)
        self.size += len(frame)

    def close(self) -> int:
        self.out.close()
        publish(self.fs, self.temporary, self.final)
        return self.size


class ArchiveError(ValueError):
    """A record or a frame that breaks the format."""


def parse_record(raw: bytes, where: str) -> dict:
    """Validate a whole record and split it up."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not blank or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError(f"{where}: no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if missing := [h for h in _MANDATORY if h.lower() not in headers]:
        raise ArchiveError(f"{where}: no {', '.join(missing)}")
    length = headers["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError(f"{where}: Content-Length {length}, but {len(rest) - 4} bytes")
    block, kind = rest[:-4], headers["warc-type"]
    out = {"record_type": kind, "record_id": headers["warc-record-id"].strip("<>"), "target_uri": unquote(headers.get("warc-target-uri", "")), "refers_to": headers.get("warc-refers-to", "").strip("<>") or None}
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"\r\nContent-Length: (\d+)", http) if kind in ("response", "revisit") else None
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response":
        if digest is not None and payload_digest(payload) != digest:
            raise ArchiveError(f"{where}: the payload's digest is not {digest}")
        if stated is not None and int(stated[1]) != len(payload):
            raise ArchiveError(f"{where}: HTTP Content-Length {stated[1].decode()}, but {len(payload)} bytes")
    return out | {"payload_digest": digest, "payload_length": int(stated[1]) if stated else len(payload), "payload": payload if kind == "response" else None}


def read_archive(folder: str, name: str, offset: int = 0) -> Iterator[dict]:
    """Records of a file in order, from the frame at `offset` (0: the first record)."""
    fs, path = filesystem(folder)
    with fs.open_input_file(f"{path}/{name}") as source:
        size = source.size()
        head = source.read(8)
        if int.from_bytes(head[:4], "little") != DICTIONARY_FRAME:
            raise ArchiveError(f"{name}: no dictionary frame in front")
        length = int.from_bytes(head[4:], "little")
        raw = source.read(length)
        if len(raw) != length:
            raise ArchiveError(f"{name}: the dictionary is cut off")
        if raw[:4] == _FRAME:  # the dictionary itself may be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        at = max(offset, 8 + length)
        source.seek(at)
        held = b""
        while at < size:
            decoder, block, used, chunk = decompressor.decompressobj(), [], 0, held
            while not decoder.eof:
                chunk = chunk or source.read(1 << 18)
                if not chunk:
                    raise ArchiveError(f"{name}, offset {at}: the frame is cut off")
                block.append(decoder.decompress(chunk))
                used, chunk = used + len(chunk), b""
            held = decoder.unused_data
            yield parse_record(b"".join(block), f"{name}, offset {at}") | {"file": name, "offset": at}
            at += used - len(held)


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", least: int = 0) -> tuple[DataFrame, str]:
    """Write a record per row; returns the files' table (file, records, bytes) and their folder."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8").alias("payload"))
    groups = rows.where(F.octet_length("payload") >= least).groupBy(F.sha1("payload").alias("digest")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    groups, _ = materialise(groups, "equal-payloads")
    salts = 1
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    else:  # rows with one very common payload are spread over several tasks
        salts = SALTS
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # payloads shorter than `least` are kept out of the join: their digest is null
    digest = F.when(F.octet_length("payload") >= least, F.sha1("payload"))
    salted = rows.withColumn("digest", digest).withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int"))
    joined = salted.join(groups, ["digest", "salt"], "left").select("id", "url", "payload", F.expr("case when first is not null and not id <=> first then first end").alias("response"))
    folder = fresh_folder(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        assert context is not None
        done: list[dict] = []
        writer, records = None, 0

        def close() -> None:
            if writer is not None:
                done.append({"file": writer.final.rpartition("/")[2], "records": records, "bytes": writer.close()})

        for batch in batches:
            payloads = batch.column(2).to_pylist()
            for k, (i, u, r) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if writer is None or writer.size > FILE_BYTES:
                    close()
                    name = f"pages-{context.partitionId():07d}-{len(done):05d}.warc.zst"
                    writer, records = ArchiveWriter(folder, name, context.taskAttemptId(), [p[:TRAIN_BYTES] for p in payloads[k : k + TRAIN_RECORDS] if p]), 0
                writer.add(page_record(i, u, payloads[k], r))
                records += 1
        close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    files, _ = materialise(joined.mapInArrow(write, "file string, records long, bytes long"), "warc-files")
    return files, folder


def read_archives(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records but warcinfo, validated; `payloads` keeps response bodies. A file is one task's work and can be re-read."""
    spark = files.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])
        for batch in batches:
            for file in batch.to_pylist():
                held, count, size = [], 0, 0
                for record in read_archive(folder, file["file"]):
                    if record["record_type"] == "warcinfo":
                        continue
                    size += len(record["payload"] or b"")
                    held.append(record if payloads else record | {"payload": None})
                    count += 1
                    if len(held) == 1000 or (payloads and size > 8 << 20):
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if count != file["records"]:
                    raise ArchiveError(f"{file['file']}: {count} records, not {file['records']}")
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    return files.repartition(max(1, spark.sparkContext.defaultParallelism), "file").mapInArrow(read, RECORD)


def page_id(column: str, kind: str) -> Column:
    """The page id within a record id, null if the page had none."""
    digits = F.regexp_replace(column, "^urn:page:", "")
    return F.when(F.length(digits) > 0, digits).cast(kind)
