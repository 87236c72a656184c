"""WARC archives as a Spark data source.

Writing: each task writes archives of gzip members, one member for one record, and rolls to a
new file at ``roll_mb``.  Files get names of their own, and the commit lists those of the
successful attempts in a manifest, so what a lost or repeated attempt left behind is not read.

Reading: one partition for each archive file.  A filter on ``record_type``, or on ``page_id``,
``refers_to`` or ``target_uri`` (headers), is pushed down.  The headers of a record are
inflated first; where they fail the filter the payload is not inflated at all if the member
tells its length (a field of the gzip header, which the writer here sets), else inflated but
neither joined nor decoded.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    InputPartition,
    WriterCommitMessage,
)

from creditloom.llm.common import column, stage
from creditloom.session import stage_path

SCHEMA = (
    "record_type string, page_id long, target_uri string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)
MIN_REVISIT_BYTES = 100
MANIFEST = "manifest.json"
BATCH_BYTES = 4 << 20
BLOCK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
URN = "urn:page:"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Struct formats: start of a gzip member; the field of its header that tells its length.
GZIP = "<4sLBB"
LENGTH = "<2sHL"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of a plain path."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path.removeprefix("file:")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


# ------------------------------------------------------------------------------- members


def pack(record: bytes) -> bytes:
    """One gzip member whose header tells the length of the member."""
    body = zlib.compressobj(1, zlib.DEFLATED, -15)
    data = body.compress(record) + body.flush()
    extra = struct.calcsize(LENGTH)
    total = struct.calcsize(GZIP) + 2 + extra + len(data) + 8
    head = struct.pack(GZIP, b"\x1f\x8b\x08\x04", 0, 0, 255) + struct.pack("<H", extra)
    field = struct.pack(LENGTH, b"LN", 4, total)
    return head + field + data + struct.pack("<LL", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class Source:
    """Forward reader of a file that can skip bytes without reading them."""

    def __init__(self, file):
        self.file, self.buffer = file, b""

    def need(self, n: int) -> bytes:
        """At least ``n`` buffered bytes, fewer at the end of the file."""
        while len(self.buffer) < n and (more := self.file.read(max(BLOCK, n - len(self.buffer)))):
            self.buffer += more
        return self.buffer

    def take(self, n: int) -> bytes:
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def skip(self, n: int) -> None:
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.file.seek(n - len(self.buffer), 1)
            self.buffer = b""


def member_length(head: bytes) -> int | None:
    """Length of the member by its own header, if it tells it."""
    if len(head) < 20 or not head[3] & 4:
        return None
    size = struct.unpack_from("<H", head, 10)[0]
    at, end = 12, 12 + size
    while at + 4 <= min(end, len(head)):
        name, n = struct.unpack_from("<2sH", head, at)
        if name == b"LN" and n == 4:
            return struct.unpack_from("<L", head, at + 4)[0]
        at += 4 + n
    return None


class Member:
    """One gzip member, inflated piece by piece."""

    def __init__(self, source: Source):
        self.source = source
        self.length = member_length(source.need(64))
        self.inflate = zlib.decompressobj(31)
        self.used = 0

    def pieces(self) -> Iterator[bytes]:
        while not self.inflate.eof:
            data = self.source.take(min(len(self.source.need(1)), 16 << 10))
            if not data:
                raise EOFError("the archive ends inside a record")
            out = self.inflate.decompress(data)
            rest = self.inflate.unused_data
            self.used += len(data) - len(rest)
            if rest:
                self.source.buffer = rest + self.source.buffer
            if out:
                yield out

    def drop(self) -> None:
        if self.length is not None:
            self.source.skip(self.length - self.used)
        else:
            for _ in self.pieces():
                pass


def parse_headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    pairs = (line.split(":", 1) for line in lines if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _page(uri: str | None) -> int | None:
    text = (uri or "").strip("<>").removeprefix(URN).split("#")[0]
    return int(text) if text.lstrip("-").isdigit() else None


def header_fields(headers: dict[str, str]) -> dict:
    length = headers.get("x-payload-length")
    digest = headers.get("warc-payload-digest", "")
    return {
        "record_type": headers.get("warc-type"),
        "page_id": _page(headers.get("warc-record-id")),
        "target_uri": headers.get("warc-target-uri"),
        "refers_to": _page(headers.get("warc-refers-to")),
        "payload_bytes": int(length) if length else None,
        "payload_digest": digest.removeprefix("sha256:") or None,
    }


def records(file, wanted: dict, with_payload: bool) -> Iterator[dict]:
    """Fields of the records whose headers equal ``wanted``; payload where it is asked for."""
    source = Source(file)
    while source.need(1):
        member = Member(source)
        pieces, block = member.pieces(), b""
        while b"\r\n\r\n" not in block:
            block += next(pieces, b"\r\n\r\n")
        head, _, begun = block.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        fields = header_fields(headers)
        unwanted = any(fields[k] != v for k, v in wanted.items())
        if unwanted or not with_payload or fields["record_type"] != "response":
            member.drop()
        else:
            body = (begun + b"".join(pieces))[: int(headers["content-length"])]
            fields["payload"] = body.partition(b"\r\n\r\n")[2]
        if not unwanted:
            yield fields


def record(kind: str, page_id, url: str | None, refers_to, digest: str, payload: bytes) -> bytes:
    """One WARC record.  A revisit holds the HTTP header alone.

    Ids are those of pages; a row with a null id, or one of repeated ids, still gets a record
    id of its own by the part behind ``#``.
    """
    block = HTTP + payload if kind == "response" else HTTP
    name = "" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{URN}{name}#{uuid.uuid4()}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        # a line end in a URL would end the header
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: <{URN}{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


# ---------------------------------------------------------------------------- data source


class Archive(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload, self.wanted = path, with_payload, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            one = len(f.attribute) == 1 if isinstance(f, EqualTo) else False
            if one and f.attribute[0] in ("record_type", "page_id", "refers_to", "target_uri"):
                self.wanted.setdefault(f.attribute[0], f.value)
                if self.wanted[f.attribute[0]] == f.value:
                    continue
            yield f

    def partitions(self) -> list[InputPartition]:
        store, path = open_store(self.path)
        listing = f"{path}/{MANIFEST}"
        if store.get_file_info(listing).type == fs.FileType.File:
            with store.open_input_stream(listing, compression=None) as f:
                names = json.loads(f.read())["files"]
        else:
            found = store.get_file_info(fs.FileSelector(path))
            names = [x.base_name for x in found if x.base_name.endswith(".warc.gz")]
        # Spark reads one partition at least
        return [Archive(f"{self.path}/{name}") for name in sorted(names)] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64()}
        types |= {"payload": pa.binary()}
        schema = pa.schema([(n, types.get(n, pa.string())) for n in names])
        if not partition.value:
            return
        store, path = open_store(partition.value)
        rows, held = [], 0
        with store.open_input_file(path) as file:
            for fields in records(file, self.wanted, self.with_payload):
                rows.append(fields)
                held += 200 + len(fields.get("payload") or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, roll_bytes: int):
        self.path, self.roll_bytes = path, roll_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = open_store(self.path)
        store.create_dir(path, recursive=True)
        files: list[str] = []
        out, written = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        name = f"{path}/{files[-1]}"
                        # the members are compressed already
                        out, written = store.open_output_stream(name, compression=None), 0
                    data = pack(
                        record(
                            row["record_type"],
                            row["page_id"],
                            row["target_uri"],
                            row["refers_to"],
                            row["payload_digest"],
                            row["payload"],
                        )
                    )
                    out.write(data)
                    written += len(data)
                    if written >= self.roll_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = open_store(self.path)
        store.create_dir(path, recursive=True)
        files = [name for m in messages if m is not None for name in m.files]
        with store.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps({"files": sorted(files)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, path = open_store(self.path)
        for name in (name for m in messages if m is not None for name in m.files):
            store.delete_file(f"{path}/{name}")


class WarcSource(DataSource):
    """``format("warc")``: options path, payload (false: headers only), roll_mb."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("roll_mb", "256")) << 20)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    spark.dataSource.register(WarcSource)


# ------------------------------------------------------------------------------ operators


def with_revisits(
    pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int
) -> DataFrame:
    """Rows of records: of equal payloads the smallest page id responds, others revisit it.

    Digests and ids alone are grouped; a digest that stands once needs no partner, so only
    those that repeat are joined back to the rows.
    """
    payload = F.encode(F.coalesce(column(html_col), F.lit("")), "UTF-8")
    rows = pages.select(
        column(id_col).cast("long").alias("page_id"),
        column(url_col).cast("string").alias("target_uri"),
        payload.alias("payload"),
    ).withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.length("payload")})
    first = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select("payload_digest", "first")
    )
    revisits = (F.col("payload_bytes") >= min_bytes) & (
        F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    )
    return rows.join(stage(first, "repeated-payloads"), "payload_digest", "left").select(
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        "page_id",
        "target_uri",
        F.when(revisits, F.col("first")).alias("refers_to"),
        F.col("payload_bytes").cast("long").alias("payload_bytes"),
        "payload_digest",
        "payload",
    )


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> None:
    """One record for each row of ``pages``, in archives under ``path``.

    A null html is an empty payload.  Payloads under ``min_revisit_bytes`` are all responses.
    Rows that repeat the smallest page id with its payload are responses too.  Null ids come
    after all others; among null ids alone every row is a response.  Further columns are not
    read; an empty table writes an empty manifest.
    """
    register(pages.sparkSession)
    rows = with_revisits(pages, id_col, url_col, html_col, min_revisit_bytes)
    rows.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records under ``path``; without ``payload`` the headers alone are inflated."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """``pages`` through archives: page_id, target_uri, payload (null for revisits) and headers.

    Length and digest of a response are those of the payload that was read; the header of a
    revisit tells those of the response it refers to.
    """
    spark = pages.sparkSession
    path = path or stage_path(spark, "llm-warc")
    write_archives(pages, path, **columns)
    back = read_archives(spark, path)
    response = F.col("record_type") == "response"
    return back.withColumns(
        {
            "payload_bytes": F.when(response, F.length("payload")).otherwise(
                F.col("payload_bytes")
            ).cast("long"),
            "payload_digest": F.when(response, F.sha2("payload", 256)).otherwise(
                F.col("payload_digest")
            ),
        }
    )


def digest_of(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()
