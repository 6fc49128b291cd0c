"""WARC archives as a Python data source.

Writing: every row becomes a WARC/1.1 record, a ``response`` with its payload or
a ``revisit`` without, each a gzip member of its own whose ``sl`` extra field
(WARC 1.1, annex D) holds the member's length.  Tasks write files of at most
``roll_bytes`` into a staging folder; the commit moves the files of the
successful attempts and drops the rest, so a retried task leaves nothing twice.

Reading: files are dealt to partitions by size.  A task reads a record's WARC
header first and decides by the pushed-down predicates (record type, ids, URI,
digest).  The payload is inflated only if the requested schema has it; else the
task skips to the next member by the ``sl`` field, or, in archives without it,
by inflating in small pieces that it drops.  Plain ``.warc`` files are skipped
by ``Content-Length``.

Requested columns (any subset of :data:`SCHEMA`, by the reader's schema):
``page_id`` and ``refers_to`` come from extension fields, ``payload_bytes`` and
``payload_digest`` are those of the full payload, also for revisits.

Bounds: a reading task holds one record's headers, its payload if asked for, and
an output batch of about 16 MB; a writing task one record and its compressed
form.  A single file is read by one task, so archives are best rolled.

Defined cases: a null payload is empty, a null URI or id has no header field and
is read as null; payloads may have any length up to 2 GB; control characters and
spaces of a URI are percent-encoded; rows of equal id and payload are written as
equally often, all responses if their id is the largest of the payload's; a
null id counts as the smallest; an empty table gives an archive without records;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
    IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage)

from wordloom.llm.frames import materialize, ship_package

SCHEMA = ("record_type string, record_id string, target_uri string, date string, page_id long, refers_to long, payload_bytes long, "
          "payload_digest string, payload binary")
#: columns that the WARC header alone gives, and that predicates are pushed down for
HEADER = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "page_id": "x-page-id",
          "refers_to": "x-refers-to-page-id", "payload_digest": "warc-payload-digest"}
PARTITION_BYTES, ROLL_BYTES, BATCH_BYTES, BATCH_ROWS = 128 << 20, 64 << 20, 16 << 20, 10_000
CHUNK, HEADER_STEP, HEADER_LIMIT = 1 << 18, 1 << 10, 1 << 24
LEAST_REVISIT = 1000


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (``file:``, ``hdfs:``, ``s3:``, ...) or of a plain path."""
    if re.match(r"[a-z][a-z0-9+.-]*:/", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


# ---------------------------------------------------------------- records

def member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field tells its length (left out where 32 bits cannot hold it)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 14 + len(body) + 8
    if max(total, len(data)) >= 1 << 32:
        head = b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff"
    else:
        head = b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<HccHII", 12, b"s", b"l", 8, total, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def member_length(head: bytes) -> int | None:
    """Length of the gzip member that begins with ``head``, if its extra field tells it."""
    if len(head) >= 12 and head[3] & 4:
        left, at = struct.unpack_from("<H", head, 10)[0], 12
        while left >= 4 and at + 4 <= len(head):
            size = struct.unpack_from("<H", head, at + 2)[0]
            if head[at:at + 2] == b"sl" and size == 8 and at + 12 <= len(head):
                return struct.unpack_from("<I", head, at + 4)[0]
            at, left = at + 4 + size, left - 4 - size
    return None


def fields(pairs: Sequence[tuple[str, object]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs if v is not None).encode("utf-8", "replace")


def clean_uri(uri: str | None) -> str | None:
    return None if uri is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def record(kind: str, block: bytes, pairs: Sequence[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + fields([("WARC-Type", kind), *pairs, ("Content-Length", len(block))]) + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """A ``response`` or ``revisit`` of an HTTP payload; ``digest`` is its SHA-1 in hex."""
    http = b"HTTP/1.1 200 OK\r\n" + fields([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"

    def name(i) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{i}:{digest}')}>"

    pairs = [("WARC-Record-ID", name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", clean_uri(url)),
             ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("X-Page-Id", page_id)]
    if kind == "revisit":
        pairs += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to)),
                  ("X-Refers-To-Page-Id", refers_to)]
    pairs.append(("Content-Type", "application/http; msgtype=response"))
    return record(kind, http if kind == "revisit" else http + payload, pairs)


def parse_fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first of a name counts, folded lines are joined."""
    out: dict[str, str] = {}
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\n")
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if colon:
            out.setdefault(k.strip().lower(), v.strip())
    return out


def header_value(column: str, head: dict[str, str]):
    """A column's value from the WARC header."""
    v = head.get(HEADER[column])
    if v is None:
        return None
    if column in ("page_id", "refers_to"):
        return int(v)
    if column == "payload_digest":
        name, _, digest = v.partition(":")
        if len(digest) == 32 and name.lower() == "sha1":
            return base64.b32decode(digest.upper()).hex()
        return (digest or name).lower()
    return v


# ---------------------------------------------------------------- reading

class Window:
    """Random access to a file through one buffer: near positions are read on, far ones sought."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.start, self.data = file, file.size(), 0, b""

    def at(self, pos: int, least: int = 1) -> memoryview:
        """Bytes from ``pos``: ``least`` of them if the file has them, else what is left."""
        lo = pos - self.start
        if lo < 0 or lo + least > len(self.data):
            kept = bytes(self.data[lo:]) if 0 <= lo < len(self.data) else b""
            self.file.seek(pos + len(kept))
            self.start, self.data = pos, kept + self.file.read(max(CHUNK, least - len(kept)))
            lo = 0
        return memoryview(self.data)[lo:]


class Stream:
    """The inflated (or plain) bytes of the record at ``pos``, read piece by piece."""

    def __init__(self, window: Window, pos: int):
        self.window, self.begin, self.pos, self.left = window, pos, pos, b""
        head = window.at(pos, 64)
        self.gzip = head[:2] == b"\x1f\x8b"
        self.length = member_length(head) if self.gzip else None
        self.inflate = zlib.decompressobj(31) if self.gzip else None

    def more(self, limit: int = CHUNK) -> bool:
        """Reads on, by ``limit`` bytes at most; false at the end of the member or file."""
        if self.gzip and self.inflate.eof:
            return False
        got = self.window.at(self.pos)[:limit]
        if not len(got):
            return False
        if self.gzip:
            made = self.inflate.decompress(got, limit)
            rest = len(self.inflate.unconsumed_tail) + len(self.inflate.unused_data)
            self.pos += len(got) - rest
            if not made and rest == len(got) and not self.inflate.eof:
                return False
        else:
            made = bytes(got)
            self.pos += len(got)
        self.left += made
        return True

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with ``mark``; all that is left if it does not come."""
        while mark not in self.left:
            if len(self.left) > HEADER_LIMIT:
                raise ValueError("a WARC header does not end")
            if not self.more(HEADER_STEP):
                break
        at = self.left.find(mark)
        at = len(self.left) if at < 0 else at + len(mark)
        out, self.left = self.left[:at], self.left[at:]
        return out

    def take(self, n: int) -> bytes:
        pieces, have = [self.left], len(self.left)
        while have < n:
            self.left = b""
            if not self.more():
                break
            pieces.append(self.left)
            have += len(self.left)
        whole = b"".join(pieces)
        self.left = whole[n:]
        return whole[:n]

    def end(self, plain_end: int) -> int:
        """Where the next record begins; ``plain_end`` is where a plain record's block ends."""
        if self.gzip:
            if self.length:
                return self.begin + self.length
            self.left = b""
            while self.more():
                self.left = b""
            return self.pos
        return plain_end


def records(window: Window, wanted: Callable[[dict[str, str]], bool], columns: Sequence[str]) -> Iterator[tuple[dict, "Stream"]]:
    """Rows of the records that ``wanted`` accepts by their header, with their streams."""
    pos = 0
    body = {"payload", "payload_bytes"} & set(columns)
    while pos < window.size:
        if window.at(pos, 2)[:2] in (b"\r\n", b"\n\r"):
            pos += 2
            continue
        s = Stream(window, pos)
        raw = s.until(b"\r\n\r\n").lstrip(b"\r\n")
        if not raw:
            break
        if not raw.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {pos}")
        head = parse_fields(raw)
        size = int(head.get("content-length", 0))
        block_at = s.pos - len(s.left)
        if wanted(head):
            row = {c: header_value(c, head) for c in columns if c in HEADER}
            if body:
                kind, http = head.get("warc-type"), b""
                if head.get("content-type", "").startswith("application/http"):
                    http = s.until(b"\r\n\r\n")
                if kind == "revisit":
                    length = parse_fields(http).get("content-length")
                    row["payload_bytes"] = int(length) if length is not None else None
                    row["payload"] = None
                else:
                    row["payload_bytes"] = size - len(http)
                    if "payload" in body:
                        row["payload"] = s.take(size - len(http))
                        if len(row["payload"]) < size - len(http):
                            raise ValueError(f"the record at byte {pos} ends early")
            yield row, s
        after = s.end(block_at + size)
        if after <= pos:
            raise ValueError(f"the record at byte {pos} is damaged")
        pos = after


COMPARE: dict[type, Callable] = {
    EqualTo: lambda v, x: v == x, EqualNullSafe: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x, In: lambda v, x: v in x, StringStartsWith: lambda v, x: v.startswith(x)}


class WarcPartition(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], schema: T.StructType, partition_bytes: int):
        self.path, self.columns, self.partition_bytes = path, columns, partition_bytes
        self.kinds = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()] for f in schema.fields]
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            known = type(f) in COMPARE or isinstance(f, (IsNull, IsNotNull))
            if known and len(f.attribute) == 1 and f.attribute[0] in HEADER:
                self.tests.append(f)
            else:
                yield f

    def wanted(self, head: dict[str, str]) -> bool:
        for f in self.tests:
            v = header_value(f.attribute[0], head)
            if isinstance(f, IsNull) or (isinstance(f, EqualNullSafe) and f.value is None):
                ok = v is None
            elif isinstance(f, IsNotNull):
                ok = v is not None
            else:
                ok = v is not None and f.value is not None and COMPARE[type(f)](v, f.value)
            if not ok:
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        """Files, largest first, into as few partitions as hold ``partition_bytes`` each (or one larger file)."""
        fs, path = file_system(self.path)
        found = fs.get_file_info(path)
        if found.type == pafs.FileType.Directory:
            found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        else:
            found = [found]
        top = path.rstrip("/") + "/"
        files = [(f.size, f.path) for f in found if f.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path)
                 and not re.search(r"(^|/)[_.]", f.path.removeprefix(top))]
        out: list[list[str]] = []
        held = self.partition_bytes
        for size, name in sorted(files, key=lambda f: (-f[0], f[1])):
            if held + size > self.partition_bytes:
                out.append([])
                held = 0
            out[-1].append(name)
            held += size
        return [WarcPartition(f) for f in out]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, WarcPartition):  # an archive without files has one partition without a value
            return
        fs, _ = file_system(self.path)
        rows: list[dict] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array([r.get(c) for r in rows], k) for c, k in zip(self.columns, self.kinds)], names=self.columns)

        for name in partition.files:
            with fs.open_input_file(name) as file:
                for row, _ in records(Window(file), self.wanted, self.columns):
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


# ---------------------------------------------------------------- writing

class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Rows ``page_id, url, payload, payload_digest, record_type, refers_to`` as records."""

    def __init__(self, path: str, date: str, level: int, roll_bytes: int):
        self.path, self.date, self.level, self.roll_bytes = path, date, level, roll_bytes
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, top = file_system(self.path)
        own = uuid.uuid4().hex
        files: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                at = [batch.schema.get_field_index(c) for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")]
                for row in range(batch.num_rows):
                    page, url, payload, digest, kind, refers = (batch.column(i)[row].as_py() for i in at)
                    if out is None:
                        fs.create_dir(f"{top}/{self.staging}", recursive=True)
                        files.append(f"part-{own}-{len(files):05d}.warc.gz")
                        out = fs.open_output_stream(f"{top}/{self.staging}/{files[-1]}", compression=None)
                        size = out.write(member(self.info(files[-1]), self.level))
                    size += out.write(member(page_record(page, url, payload, digest, kind, refers, self.date), self.level))
                    if size >= self.roll_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def info(self, name: str) -> bytes:
        return record("warcinfo", b"software: wordloom\r\nformat: WARC File Format 1.1\r\n",
                      [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", self.date), ("WARC-Filename", name),
                       ("Content-Type", "application/warc-fields")])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, top = file_system(self.path)
        fs.create_dir(top, recursive=True)
        for m in messages:
            for name in m.files if m else []:
                fs.move(f"{top}/{self.staging}/{name}", f"{top}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, top = file_system(self.path)
        if fs.get_file_info(f"{top}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{top}/{self.staging}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc").schema(...).load(path)`` and ``df.write.format("warc").mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], schema.fieldNames(), schema, int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("an archive is written once: use mode append and a new path")
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"), int(self.options.get("level", 4)),
                          int(self.options.get("rollBytes", ROLL_BYTES)))


def register(spark: SparkSession) -> None:
    """Makes the format ``warc`` known to the session, with its filter pushdown."""
    ship_package(spark)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_archive(spark: SparkSession, path: str, columns: Sequence[str], **options: object) -> DataFrame:
    """The named columns of an archive's records; only ``payload`` makes tasks inflate payloads."""
    register(spark)
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    return spark.read.format("warc").options(**options).schema(", ".join(f"{c} {kinds[c]}" for c in columns)).load(path)


def as_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Rows for :class:`WarcWriter`: of equal payloads of 1000 bytes or more the largest id is the response, others revisit it.

    Payloads are not shuffled: repeated digests are found by a combined
    aggregation, written, and joined to a second scan, broadcast if their table
    is below Spark's threshold.  Beyond it the join deals by digest, and hot
    digests are split by the adaptive planner.
    """
    empty = F.lit("").cast("binary")
    t = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                     F.coalesce(F.col(f"`{payload_col}`").cast("binary"), empty).alias("payload"))
    t = t.withColumn("payload_digest", F.sha1("payload"))
    long = F.octet_length("payload") >= LEAST_REVISIT
    repeated = t.where(long).groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("page_id").alias("top")).where("n > 1")
    repeated = materialize(repeated.select(F.col("payload_digest").alias("digest"), "top"), pages.sparkSession, "payloads")
    revisit = F.col("digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return t.join(repeated, F.when(long, F.col("payload_digest")) == F.col("digest"), "left").select(
        "page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("top")).alias("refers_to"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", **options: object) -> None:
    """Writes the pages as WARC records under ``path``, a new folder."""
    register(pages.sparkSession)
    as_records(pages, id_col, url_col, payload_col).write.format("warc").options(**options).mode("append").save(path)


def digest_report(spark: SparkSession, path: str) -> DataFrame:
    """Per page record: length and SHA-1 of its payload (a response's from the payload itself), its type and what it revisits."""
    found = read_archive(spark, path, ["page_id", "record_type", "payload"]).where("record_type = 'response'")
    responses = found.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
                             "record_type", F.lit(None).cast("long").alias("refers_to"))
    found = read_archive(spark, path, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return responses.unionByName(found.where("record_type = 'revisit'"))


__all__ = ["WarcDataSource", "as_records", "digest_report", "read_archive", "register", "write_archive"]
