"""WARC archives as a PySpark data source (format ``warc``): writer, planned reader, and revisit records.

Each record is a gzip member of its own whose extra field ``SL`` holds its compressed length. The reader inflates a
member's head first, decides by record type and headers, and jumps over members that are not wanted without inflating the
rest. Tasks write files under names of their own; each commit lists the files of its successful tasks in a manifest of its own,
and only files of a manifest are read, so lost or repeated tasks leave no trace and every appended write is kept. A folder
without manifests is read as a foreign archive, all its ``.warc.gz`` files; members without ``SL`` are inflated to find
their end. Truncated members and damaged payloads raise an error.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from millspark.llm.common import picked, sized
from millspark.session import shared_folder

MANIFESTS = "_manifests"
SCHEMA = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
MIN_REVISIT = 1000
FILE_BYTES = 64 << 20
PARTITION_BYTES = 64 << 20
HEAD = 4096
STEP = 1 << 16
BATCH_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _member(data: bytes) -> bytes:
    """One gzip member with its whole compressed length in the extra field."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = b"SL" + struct.pack("<HI", 4, 10 + 2 + 8 + len(body) + len(tail))
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    """The page of an own record id; null for other ids."""
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name.lstrip("-").isdecimal() else None


def record(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit keeps the HTTP head and leaves the payload out. Line breaks in a URL are escaped."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    content = http + (payload if record_type == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if record_type == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(content)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


@dataclass
class _Files(WriterCommitMessage):
    files: list[tuple[str, int]] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int, overwrite: bool):
        self.path, self.file_bytes, self.overwrite = path, file_bytes, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        done, out, name, size = _Files(), None, "", 0
        for batch in iterator:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "target_uri", "payload", "record_type", "refers_to"))):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = _member(record(row[0], row[1], row[2] or b"", row[3], row[4]))
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    done.files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.files.append((name, size))
        return done

    def commit(self, messages: list[_Files | None]) -> None:
        """A new manifest, complete before it gets its name; an overwriting write then takes the earlier ones away."""
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        earlier = _manifests(store, root) if self.overwrite else []
        name = f"{root}/{MANIFESTS}/{uuid.uuid4().hex}"
        with store.open_output_stream(f"{name}.part", compression=None) as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())
        store.move(f"{name}.part", f"{name}.json")
        for manifest in earlier:
            listed = _listed(store, manifest)
            store.delete_file(manifest)
            for file, _ in listed:
                store.delete_file(f"{root}/{file}")

    def abort(self, messages: list[_Files | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for name, _ in (f for m in messages if m for f in m.files):
            store.delete_file(f"{root}/{name}")


def _manifests(store: fs.FileSystem, root: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(".json"))


def _listed(store: fs.FileSystem, manifest: str) -> list[tuple[str, int]]:
    with store.open_input_stream(manifest, compression=None) as f:
        return [tuple(x) for x in json.loads(f.read())]


@dataclass
class _Part(InputPartition):
    files: list[str]


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in lines[1:]) if v)


def _length(head: bytes) -> int:
    """Compressed length of the gzip member that starts here, 0 if it is not stated."""
    if head[:3] != b"\x1f\x8b\x08":
        raise ValueError("not a gzip member")
    if len(head) < 12 or not head[3] & 4:
        return 0
    size = struct.unpack("<H", head[10:12])[0]
    extra, at = head[12:12 + size], 0
    while at + 4 <= len(extra):
        n = struct.unpack("<H", extra[at + 2:at + 4])[0]
        if extra[at:at + 2] == b"SL":
            return struct.unpack("<I", extra[at + 4:at + 8])[0]
        at += 4 + n
    return 0


class _Member:
    """One gzip member, inflated as far as asked."""

    def __init__(self, f, at: int):
        f.seek(at)
        self.f, self.at, self.inflate = f, at, zlib.decompressobj(31)
        start = f.read(HEAD)
        self.stated, self.taken = _length(start), len(start)
        self.text = self.inflate.decompress(start)

    def more(self, size: int = HEAD) -> bytes:
        """The next inflated bytes; nothing behind the end of the member."""
        if self.inflate.eof:
            return b""
        data = self.f.read(size)
        if not data:
            raise ValueError(f"truncated gzip member at {self.at}")
        self.taken += len(data)
        return self.inflate.decompress(data)

    def upto(self, mark: bytes, data: bytes, most: int | None = None) -> bytes:
        """``data`` and what follows it until ``mark`` is in it, ``most`` bytes are there, or the member ends."""
        while mark not in data and (most is None or len(data) < most) and not self.inflate.eof:
            data += self.more()
        return data

    def length(self) -> int:
        while not self.stated and not self.inflate.eof:
            self.more(STEP)
        return self.stated or self.taken - len(self.inflate.unused_data)


class _Reader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int, payload: str):
        self.path, self.partition_bytes, self.payload = path, partition_bytes, payload
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        """Equality and membership on header columns decide before a payload is inflated; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in ("record_type", "page_id", "target_uri", "refers_to", "payload_digest") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[_Part]:
        store, root = fs.FileSystem.from_uri(self.path)
        manifests = _manifests(store, root)
        files = [f for m in manifests for f in _listed(store, m)]
        if not manifests:
            files = [(f.base_name, f.size) for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".warc.gz")]
        parts, size = [], self.partition_bytes
        for name, n in sorted(files):
            if size >= self.partition_bytes:
                parts.append(_Part([]))
                size = 0
            parts[-1].files.append(name)
            size += n
        return parts or [_Part([])]

    def _kept(self, head: dict) -> bool:
        return all(head[c] in values for c, values in self.wanted.items())

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for name in partition.files:
            with store.open_input_file(f"{root}/{name}") as f:
                end, at = f.size(), 0
                while at < end:
                    row, length = self._record(f, at)
                    at += length
                    if row is not None:
                        rows.append(row)
                        size += len(row[6] or b"") + 200
                        if size >= BATCH_BYTES:
                            yield self._batch(rows)
                            rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _record(self, f, at: int) -> tuple[tuple | None, int]:
        """A record, or None if it is not wanted, and the compressed length of its member."""
        member = _Member(f, at)
        block, mark, rest = member.upto(b"\r\n\r\n", member.text).partition(b"\r\n\r\n")
        if not mark:
            raise ValueError(f"no WARC header at {at}")
        warc = _headers(block)
        n = int(warc.get("content-length", 0))
        http_block, skip = b"", 0
        if warc.get("content-type", "").startswith("application/http"):
            rest = member.upto(b"\r\n\r\n", rest, n)
            http_block, mark, _ = rest.partition(b"\r\n\r\n")
            skip = len(http_block) + len(mark)
        named, url = warc.get("warc-payload-digest", ""), warc.get("warc-target-uri")
        digest = base64.b32decode(named.removeprefix("sha1:")).hex() if named.startswith("sha1:") else None
        head = {"page_id": _page(warc.get("warc-record-id")), "record_type": warc.get("warc-type"), "refers_to": _page(warc.get("warc-refers-to")),
                "target_uri": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "payload_digest": digest}
        if not self._kept(head):
            return None, member.length()
        n_payload, payload = max(0, n - skip), None
        if head["record_type"] != "response":
            n_payload = int(_headers(http_block).get("content-length", n_payload))
        elif self.payload != "skip":
            parts, size = [rest], len(rest)
            while size < n and not member.inflate.eof:
                parts.append(member.more(max(HEAD, member.stated - member.taken) if member.stated else STEP))
                size += len(parts[-1])
            payload = b"".join(parts)[skip:n]
            if len(payload) != n_payload or digest is not None and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"damaged record {warc.get('warc-record-id')} at {at}")
        return (head["page_id"], head["target_uri"], head["record_type"], head["refers_to"], n_payload, digest, payload if self.payload == "read" else None), member.length()

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])


class WarcSource(DataSource):
    """Options: ``path``; ``payload`` = read (default), verify (check the digest, return no bytes) or skip; ``fileBytes``; ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)), self.options.get("payload", "read"))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("fileBytes", FILE_BYTES)), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT, broadcast_groups: int = 100_000) -> DataFrame:
    """``page_id, target_uri, payload, record_type, refers_to``: the records to write, one per page.

    Of pages with equal payloads of at least ``min_bytes`` that with the largest ``page_id`` is the response and the others
    revisit it. A null html is an empty payload. Rows that repeat the largest id with the same payload are responses
    each; a null id is smaller than all others, and pages whose ids are all null are responses.
    """
    pages = picked(pages, page_id="long", url="string", html="string").select("page_id", F.col("url").alias("target_uri"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    keys = {"_n": F.octet_length("payload"), "_sha1": F.sha1("payload"), "_check": F.xxhash64("payload")}
    keyed = pages.withColumns(keys)
    groups = keyed.filter(F.col("_n") >= min_bytes).groupBy(*keys).agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).filter((F.col("copies") > 1) & F.col("first").isNotNull()).drop("copies")
    joined = keyed.join(sized(groups, broadcast_groups), list(keys), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "target_uri", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def archive(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT) -> None:
    """Write the pages as WARC files with a manifest into a shared folder."""
    register(pages.sparkSession)
    with_revisits(pages, min_bytes).write.format("warc").mode("append").option("path", path).save()


def read_archive(spark: SparkSession, path: str, payload: str = "read") -> DataFrame:
    """The records of an archive; an archive without records gives an empty table."""
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", payload).load()


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives, read them back, every payload checked against its digest."""
    path = f"{shared_folder(pages.sparkSession)}/warc"
    archive(pages, path)
    return read_archive(pages.sparkSession, path, "verify").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
g AS (SELECT html, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT p.page_id, n AS payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN g.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN g.first <> p.page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g ON g.html = p.html AND p.n >= 1000
"""
