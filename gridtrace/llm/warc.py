"""WARC archives as a Spark data source, read and written in Python workers.

Files hold one gzip member a record. Each member carries its own length in an extra field ("sl"), as
some archives do, so a reader can step over a record without inflating it; members without that
field are inflated through. Reading is planned by files, small ones together. Filters on the record
type and on header columns are pushed down: a record's headers are parsed first, from the first few
kilobytes, and its payload is inflated only if the headers pass and payloads are wanted (option
``payload``, true unless given).

Writing: every task writes files of its own, of ``roll_bytes`` at most and a record. What a finished
write consists of is listed in a manifest, so files of lost or repeated attempts are never read.

Defined cases: a null payload is empty; a null id or address leaves its header out and reads as
null; a very long payload is a record as any other, inflated whole when it is asked for; repeated
rows are records of their own; columns other than those asked for are not looked at, whatever their
names; an empty table makes an archive without records.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from gridtrace.session import materialize

SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_length", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
ARROW = pa.schema([(f.name, {"long": pa.int64(), "binary": pa.binary()}.get(f.dataType.typeName(), pa.string())) for f in SCHEMA])
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _quote(s: str) -> str:
    return s.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unquote(s: str) -> str:
    return s.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(row: dict) -> bytes:
    """One record, not yet compressed."""
    payload = row.get("payload") or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if row["record_type"] == "revisit" else http + payload
    head = ["WARC/1.1"]
    for column, name in HEADERS.items():
        value = row.get(column)
        if value is not None:
            value = f"sha1:{value}" if column == "payload_digest" else f"<{_quote(value)}>" if column in ("record_id", "refers_to") else _quote(str(value))
            head.append(f"{name}: {value}")
    if row["record_type"] == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member that names its own length."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 24 + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if size >= 1 << 32 or len(data) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + body + tail


def parse_headers(head: bytes) -> dict:
    lines = head.decode("utf-8", "replace").split("\r\n")
    found = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}
    row = {}
    for column, name in HEADERS.items():
        value = found.get(name.lower())
        if value is not None and column == "payload_digest":
            value = value.removeprefix("sha1:")
        elif value is not None and column in ("record_id", "refers_to"):
            value = _unquote(value.removeprefix("<").removesuffix(">"))
        elif value is not None and column != "payload_length":
            value = _unquote(value)
        row[column] = int(value) if value is not None and column == "payload_length" else value
    row["_length"] = int(found.get("content-length", 0))
    row["_http"] = found.get("content-type", "").startswith("application/http")
    return row


@dataclass
class Test:
    """A pushed filter, applied to a record's headers."""

    column: str
    op: str
    value: object = None

    def __call__(self, row: dict) -> bool:
        v = row[self.column]
        if self.op == "null":
            return v is None
        if self.op == "same":
            return v == self.value
        if v is None:
            return False
        if self.op == "set":
            return True
        return {
            "eq": lambda: v == self.value, "in": lambda: v in self.value, "gt": lambda: v > self.value, "ge": lambda: v >= self.value,
            "lt": lambda: v < self.value, "le": lambda: v <= self.value, "starts": lambda: v.startswith(self.value),
            "ends": lambda: v.endswith(self.value), "contains": lambda: self.value in v,
        }[self.op]()


OPS = {
    EqualTo: "eq", EqualNullSafe: "same", In: "in", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le",
    StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains", IsNotNull: "set", IsNull: "null",
}


def to_test(f: Filter) -> Test | None:
    op = OPS.get(type(f))
    if op is None or len(f.attribute) != 1 or f.attribute[0] not in HEADERS:
        return None
    column = f.attribute[0]
    if op in ("gt", "ge", "lt", "le") and column != "payload_length":
        return None  # Spark orders strings by bytes; it tests these itself
    return Test(column, op, tuple(f.value) if op == "in" else getattr(f, "value", None))


def _open(path: str):
    from pyarrow import fs

    path = re.sub(r"^s3[an]://", "s3://", path)  # the names that Hadoop has for it
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: tuple[tuple[str, int], ...]

    def __init__(self, paths):
        super().__init__(None)
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.split = int(options.get("split_bytes", 32 << 20))
        self.tests: list[Test] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            test = to_test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self):
        from pyarrow import fs

        system, root = _open(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            files = [(root, info.size)]
        else:
            found = {x.path: x.size for x in system.get_file_info(fs.FileSelector(root, recursive=False)) if x.type == fs.FileType.File}
            manifests = [p for p in found if p.rsplit("/", 1)[-1].startswith("_manifest-")]
            names = {p for p in found if p.endswith((".warc.gz", ".warc"))}
            if manifests:
                named = set()
                for m in manifests:
                    with system.open_input_stream(m) as f:
                        named.update(json.loads(f.read()))
                names = {p for p in names if p.rsplit("/", 1)[-1] in named}
            files = sorted((p, found[p]) for p in names)
        out, held, size = [], [], 0
        for p in files:
            if held and size + p[1] > self.split:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(p)
            size += p[1]
        if held or not out:
            out.append(Files(tuple(held)))
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, _ in partition.paths:
            system, _ = _open(self.path)
            with system.open_input_file(path) as f:
                for row in records(f, self.tests, self.payload):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= 1000 or size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


def _inflate(f, pos: int, start: bytes, want: int | None):
    """Inflate the member at pos: its first ``want`` bytes at least, or all; and its length if it was read to the end."""
    d = zlib.decompressobj(31)
    out, data, at = b"", start, pos + len(start)
    parts = []
    n = 0
    while True:
        got = d.decompress(data, 0 if want is None else max(1, want - n))
        parts.append(got)
        n += len(got)
        if d.eof:
            return b"".join(parts), at - len(d.unused_data) - pos
        if want is not None and n >= want:
            return b"".join(parts), None
        data = d.unconsumed_tail
        if not data:
            f.seek(at)
            data = f.read(1 << 16)
            at += len(data)
            if not data:
                raise EOFError("a record is cut off")
    return out, None


def records(f, tests: list[Test], payload: bool) -> Iterator[dict]:
    """Records of one open file that pass the tests, headers first."""
    pos, end = 0, f.size()
    while pos < end:
        f.seek(pos)
        start = f.read(4096)
        length = None
        if start[3] & 4 and start[12:14] == b"sl":
            length = struct.unpack_from("<I", start, 16)[0]
        want, head = 2048, b""
        while True:
            data, whole = _inflate(f, pos, start, want)
            cut = data.find(b"\r\n\r\n")
            if cut >= 0 or whole is not None:
                head = data[:cut]
                break
            want *= 4
        row = parse_headers(head)
        keep = all(t(row) for t in tests)
        if keep and payload and row["record_type"] != "revisit":
            data, whole = _inflate(f, pos, start, None)
            block = data[cut + 4 : cut + 4 + row["_length"]]
            row["payload"] = block.partition(b"\r\n\r\n")[2] if row["_http"] else block
        else:
            row["payload"] = None
            if length is None and whole is None:
                _, whole = _inflate(f, pos, start, None)
        if keep:
            yield {k: row[k] for k in ARROW.names}
        pos += length or whole


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.roll = int(options.get("roll_bytes", 64 << 20))
        self.level = int(options.get("level", 3))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size >= self.roll:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    data = member(record(row), self.level)
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(tuple(names))

    def commit(self, messages):
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([n for m in messages if m for n in m.files]).encode())

    def abort(self, messages):
        system, root = _open(self.path)
        for m in messages:
            for n in m.files if m else ():
                system.delete_file(f"{root}/{n}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_pages(pages: DataFrame, path: str, least_bytes: int = 1000, broadcast_rows: int = 500_000) -> None:
    """Write one record a page. Of equal payloads of ``least_bytes`` or more, that with the largest page_id is whole.

    Digests that repeat are found from ids and digests alone. Up to ``broadcast_rows`` of them, counted,
    are broadcast, so that payloads stay where they are read; more are joined by a shuffle. Rows with the same page_id and payload are all whole; so are equal payloads whose ids are all null.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumns(
        {"payload_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")}
    )
    largest = (
        rows.where(F.col("payload_length") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("whole_id"), F.count("*").alias("n"))
        .where("n > 1 AND whole_id IS NOT NULL")
        .drop("n")
    )
    largest = materialize(largest, "repeated")
    if largest.count() <= broadcast_rows:
        largest = F.broadcast(largest)
    revisit = F.col("whole_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("whole_id"))
    out = rows.join(largest, "payload_digest", "left").select(
        F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, F.concat(F.lit("urn:page:"), F.col("whole_id").cast("string"))).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    register(pages.sparkSession)
    out.write.format("warc").mode("append").save(path)


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page by page, what the archives say, in one pass; digests of whole records are taken from their payload anew.

    The record types are pushed down, and revisits have no payload that could be decoded.
    """
    number = "CAST(substring_index({}, ':', -1) AS BIGINT)"
    whole = "record_type = 'response'"
    return read_records(spark, path).where("record_type IN ('response', 'revisit')").selectExpr(
        f"{number.format('record_id')} AS page_id",
        f"CASE WHEN {whole} THEN CAST(octet_length(payload) AS BIGINT) ELSE payload_length END AS payload_bytes",
        f"CASE WHEN {whole} THEN sha1(payload) ELSE payload_digest END AS payload_digest",
        "record_type",
        f"CASE WHEN NOT {whole} THEN {number.format('refers_to')} END AS refers_to",
    )
