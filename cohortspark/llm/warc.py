"""WARC archives as a Python data source, and the records of a crawl with repeated payloads as revisits.

``spark.read.format("warc").load(folder)`` plans whole files into partitions, hands equality and list predicates on
``record_type``, ``record_id``, ``target_uri``, ``payload_digest`` and ``refers_to`` to the reader, parses the header of
a record first, and decodes a payload only if the record passes and the option ``payload`` is not ``false``. The members
that the writer makes carry their compressed length in a gzip extra field, so an unwanted record is skipped by seeking;
members of other writers are inflated and thrown away. Uncompressed archives are skipped by their Content-Length.

``df.write.format("warc").save(folder)`` writes one or more gzip archives per task below names that hold the task and a
random part, and a list of the archives of successful tasks when the job commits. Readers take only listed archives, so
what a lost executor or a second attempt left behind is never read.

Files are opened through Arrow's file systems by URI, so folders may be local, HDFS or an object store.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = ("record_type string, record_id string, target_uri string, date string, payload_digest string, "
          "payload_bytes bigint, refers_to string, payload binary")
ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
                   ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                   ("refers_to", pa.string()), ("payload", pa.binary())])
COMMITTED = "_archives"
EPOCH = "1970-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = b"WARC/1.1"
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
           "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length", "refers_to": "WARC-Refers-To"}
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path[len("file:"):]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


# ---- records ---------------------------------------------------------------------------------------------------


def _header_value(value: str) -> str:
    """A value that fits on one header line: line breaks and controls are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def encode_record(row: dict) -> bytes:
    """One gzip member. Responses hold an HTTP message with the payload, revisits an empty block."""
    response = row["record_type"] == "response"
    block = HTTP_HEAD + (row["payload"] or b"") if response else b""
    lines = [f"{HEADERS[key]}: {_header_value(str(row[key]))}" for key in HEADERS if row.get(key) is not None]
    if response:
        lines.append("Content-Type: application/http;msgtype=response")
    else:
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines.append(f"Content-Length: {len(block)}")
    head = VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n"
    raw = head + block + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    extra = b"sl" + struct.pack("<HII", 8, len(body) + 32, len(raw) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF))


class _Inflated(io.RawIOBase):
    """The bytes of one gzip member, inflated as they are asked for."""

    def __init__(self, source, first: bytes) -> None:
        self.source, self.pending, self.unpacker = source, first, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.unpacker.eof:
            if not self.pending:
                self.pending = self.source.read(1 << 16)
                if not self.pending:
                    raise EOFError("archive ends inside a record")
            data = self.unpacker.decompress(self.pending, len(target))
            self.pending = self.unpacker.unconsumed_tail or b""
            if data:
                target[: len(data)] = data
                return len(data)
        return 0


def _parse_head(stream) -> dict | None:
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    head = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        head[name.strip().lower()] = value.strip()
    return head


def _fields(head: dict) -> dict:
    row = {key: head.get(name.lower()) for key, name in HEADERS.items()}
    row["payload_bytes"] = int(row["payload_bytes"]) if row["payload_bytes"] is not None else None
    return row


def _payload(head: dict, block: bytes) -> bytes:
    if "application/http" in head.get("content-type", ""):
        at = block.find(b"\r\n\r\n")
        return block[at + 4:] if at >= 0 else b""
    return block


def read_archive(handle, wanted, payload: bool = True) -> Iterator[dict]:
    """The rows of one archive, gzip or plain. ``wanted(fields)`` sees the parsed header of a record."""
    size = handle.size()
    while handle.tell() < size:
        at = handle.tell()
        start = handle.read(2)
        handle.seek(at)
        if start == b"\x1f\x8b":
            first = handle.read(24)
            known = first[3] == 4 and first[12:14] == b"sl" and len(first) == 24
            length = struct.unpack("<I", first[16:20])[0] if known else 0
            member = _Inflated(handle, first)
            stream = io.BufferedReader(member, 2048 if known else 1 << 16)
        else:
            member, length, stream = None, 0, handle
        head = _parse_head(stream)
        if head is None:
            if member is None:
                return
            handle.seek(handle.tell() - len(member.unpacker.unused_data))
            continue
        row = _fields(head)
        keep = wanted(row)
        size_of_block = int(head.get("content-length", 0))
        if keep and payload and row["record_type"] != "revisit":
            row["payload"] = _payload(head, stream.read(size_of_block))
        elif member is None:
            stream.seek(stream.tell() + size_of_block)
        if keep:
            yield row
        if member is not None and length:
            handle.seek(at + length)
        elif member is not None:
            while stream.read(1 << 16):
                pass
            handle.seek(handle.tell() - len(member.unpacker.unused_data))


# ---- data source -----------------------------------------------------------------------------------------------


class _Files(InputPartition):
    def __init__(self, files: list[str]) -> None:
        super().__init__(None)
        self.files = files


class WarcReader(DataSourceReader):
    """Options: ``payload`` (false leaves payloads undecoded), ``partition_bytes`` (files are put together up to it)."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))
        self.filters: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        for item in filters:
            name = item.attribute[0] if isinstance(item, (EqualTo, In)) and len(item.attribute) == 1 else None
            if name in HEADERS and name != "payload_bytes":
                self.filters.append((name, frozenset([item.value] if isinstance(item, EqualTo) else item.value)))
            else:
                yield item

    def partitions(self):
        system, path = _filesystem(self.path)
        listed = system.get_file_info(f"{path}/{COMMITTED}")
        if listed.type == pafs.FileType.File:
            with system.open_input_file(listed.path) as handle:
                files = [(f"{path}/{name}", length) for name, length in json.loads(handle.read())]
        else:
            found = system.get_file_info(pafs.FileSelector(path, recursive=True))
            files = [(f.path, f.size) for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz"))]
        plan, room = [], 0
        for name, length in sorted(files):
            if not plan or length > room:
                plan.append([])
                room = self.partition_bytes
            plan[-1].append(name)
            room -= length
        return [_Files(names) for names in plan]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, _ = _filesystem(self.path)

        def wanted(row: dict) -> bool:
            return all(row[name] in values for name, values in self.filters)

        rows, held = [], 0
        for name in partition.files:
            with system.open_input_file(name) as handle:
                for row in read_archive(handle, wanted, self.with_payload):
                    rows.append(row)
                    held += 200 + len(row.get("payload") or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Option: ``archive_bytes``, the size beyond which a task begins another archive."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.archive_bytes = int(options.get("archive_bytes", 256 << 20))
        system, path = _filesystem(self.path)
        if not overwrite and system.get_file_info(f"{path}/{COMMITTED}").type == pafs.FileType.File:
            raise ValueError(f"{self.path} already holds archives")

    def write(self, iterator) -> _Written:
        from pyspark import TaskContext

        system, path = _filesystem(self.path)
        system.create_dir(path, recursive=True)
        context = TaskContext.get()
        task, files, out = context.partitionId() if context else 0, [], None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append([f"part-{task:06d}-{len(files):04d}-{uuid.uuid4().hex}.warc.gz", 0])
                    out = system.open_output_stream(f"{path}/{files[-1][0]}", compression=None)
                record = encode_record(row)
                out.write(record)
                files[-1][1] += len(record)
                if files[-1][1] >= self.archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written([tuple(f) for f in files])

    def commit(self, messages) -> None:
        system, path = _filesystem(self.path)
        system.create_dir(path, recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        with system.open_output_stream(f"{path}/{COMMITTED}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        """Unlisted archives are never read."""


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format ``warc`` known to the session and let it receive predicates."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---- crawl records ---------------------------------------------------------------------------------------------


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1: every five hexadecimal digits are four base32 digits."""
    def four(i: Column) -> Column:
        value = F.conv(F.substr(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substr(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1))
                          for shift in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def crawl_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html",
                  least_bytes: int = 0, date: str | None = None) -> DataFrame:
    """The records of a crawl in the columns of the archive.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the smallest key is a response and the
    others are revisits of it; all other pages are responses. A null payload is empty. Pages without a key are
    responses. Repeated rows of one key with equal payloads: all are responses if the key is the smallest one.
    Only digests move before the payloads do, so a hot payload meets a table of one row per repeated digest, by a join
    that adaptive execution can split.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8")
    rows = pages.select(
        F.col(key).cast("long").alias("_key"),
        F.col(url).alias("target_uri"),
        (F.col(date) if date else F.lit(EPOCH)).alias("date"),
        body.alias("payload"),
        F.sha1(body).alias("_digest"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
    )
    firsts = (
        rows.where((F.col("payload_bytes") >= least_bytes) & F.col("_key").isNotNull())
        .groupBy("_digest")
        .agg(F.min("_key").alias("_first"), F.max("_key").alias("_last"))
        .where("_first < _last")
        .drop("_last")
    )
    again = (F.col("_first") < F.col("_key")) & (F.col("payload_bytes") >= least_bytes)
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), c.cast("string"), F.lit(">"))
    return rows.join(firsts, "_digest", "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("_key")).alias("record_id"),
        "target_uri",
        "date",
        F.concat(F.lit("sha1:"), base32_of_hex(F.col("_digest"))).alias("payload_digest"),
        "payload_bytes",
        F.when(again, urn(F.col("_first"))).alias("refers_to"),
        F.when(~F.coalesce(again, F.lit(False)), F.col("payload")).alias("payload"),
    )


def key_of(urn: Column) -> Column:
    """The page key inside a record id."""
    return F.regexp_extract(urn, r"<urn:x-page:(-?\d+)>", 1).try_cast("long")
