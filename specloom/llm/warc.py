"""WARC archives as a PySpark Python data source, written and read.

Writing: each task writes one archive of gzip members, one per record.  A member's extra field
``sl`` holds its compressed and plain length, so a reader can leave it out unread.  The driver
lists the finished archives, with split points about every 16 MB, in a manifest; archives of
failed tasks are not listed and not read.

Reading: partitions are planned from the manifest (from a folder without one, an archive each).
Predicates on the record type and other header fields are pushed down: a task decodes the headers
of a record first and, if they fail or payloads are not asked for (option ``payload`` = false),
goes on to the next record without decoding the rest.  Plain and foreign .warc/.warc.gz files
are read too.

Paths are those that pyarrow.fs opens (local, HDFS, S3, GCS and the like).

Columns: record_id, record_type, target_uri, refers_to, payload_digest (``sha1:`` and lower-case hex),
payload_length (of the full payload, also for revisits), content_length, payload.

Defined results: a null payload is written as empty; a null record type is ``response``; other
null fields are left out of the headers and read back as null; line ends in header values become
blanks; revisits carry no payload and read back as null; an empty table gives no records.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith, WriterCommitMessage)
from .shared import small, stored

SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string,"
          " payload_length bigint, content_length bigint, payload binary")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = {"payload_length": pa.int64(), "content_length": pa.int64(), "payload": pa.binary()}
SPLIT_BYTES = 16 << 20
MANIFEST = "_manifest.json"
DATE = "1970-01-01T00:00:00Z"
#: Payloads of at least this many bytes are stored once.
LEAST_SHARED = 1000
BROADCAST_ROWS = 500_000
SALTS = 16
#: Rows of one batch handed to Spark hold at most about this many payload bytes.
BATCH_BYTES = 8 << 20


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs, inner


# ---- records -------------------------------------------------------------------------------

def member(data: bytes) -> bytes:
    """One gzip member whose extra field holds its compressed and plain length."""
    press = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush()
    total = 10 + 14 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(fields: dict[str, str | None], content: bytes) -> bytes:
    lines = [f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}" for k, v in fields.items() if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + f"\r\nContent-Length: {len(content)}\r\n\r\n").encode() + content + b"\r\n\r\n"


def page_record(row: dict) -> bytes:
    kind, payload = row["record_type"] or "response", row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Type": kind, "WARC-Record-ID": row["record_id"], "WARC-Date": DATE, "WARC-Target-URI": row["target_uri"],
              "WARC-Refers-To": row["refers_to"], "WARC-Payload-Digest": row["payload_digest"], "X-Payload-Length": row["payload_length"],
              "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None,
              "Content-Type": "application/http; msgtype=response"}
    return record(fields, http if kind == "revisit" else http + payload)


def _fields(head: bytes) -> dict:
    """Header fields of a record by column name."""
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if colon:
            found[key.strip().lower()] = value.strip()
    number = lambda k: int(found[k]) if found.get(k, "").isdigit() else None
    return {"record_id": found.get("warc-record-id"), "record_type": found.get("warc-type"), "target_uri": found.get("warc-target-uri"),
            "refers_to": found.get("warc-refers-to"), "payload_digest": found.get("warc-payload-digest"),
            "payload_length": number("x-payload-length"), "content_length": number("content-length"), "__http": "application/http" in found.get("content-type", "")}


def _payload(fields: dict, content: bytes) -> bytes | None:
    if fields["record_type"] == "revisit":
        return None
    return content.partition(b"\r\n\r\n")[2] if fields["__http"] else content


def _members(file: io.BufferedReader, start: int, end: int, want, payloads: bool):
    """Records of the gzip members that begin in [start, end)."""
    at = start
    while at < end:
        file.seek(at)
        block = file.read(4096)
        if len(block) < 18:
            return
        size, skip = None, 10
        if block[3] & 4:
            extra = struct.unpack_from("<H", block, 10)[0]
            skip = 12 + extra
            if block[12:14] == b"sl":
                size = struct.unpack_from("<I", block, 16)[0]
        plain = size is not None and not block[3] & ~4
        inflate = zlib.decompressobj(-15) if plain else zlib.decompressobj(31)
        out, feed, used = b"", block[skip:] if plain else block, len(block)
        while b"\r\n\r\n" not in out and not inflate.eof:
            out += inflate.decompress(feed, 4096)
            feed = inflate.unconsumed_tail
            if not feed and not inflate.eof:
                feed = file.read(65536)
                used += len(feed)
                if not feed:
                    break
        head, _, rest = out.partition(b"\r\n\r\n")
        fields = _fields(head)
        wanted = want(fields)
        if not (wanted and payloads and fields["record_type"] != "revisit") and size is not None:
            at += size
        else:
            parts = [rest]
            while not inflate.eof:
                if not feed:
                    feed = file.read(65536)
                    used += len(feed)
                    if not feed:
                        break
                parts.append(inflate.decompress(feed))
                feed = b""
            at += size if size is not None else used - len(inflate.unused_data)
            rest = b"".join(parts) if wanted else b""
        if wanted:
            content = rest[:fields["content_length"]]
            yield fields, _payload(fields, content) if payloads else None


def _plain(file: io.BufferedReader, want, payloads: bool):
    while True:
        line = file.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        head = [line]
        while (line := file.readline()).strip():
            head.append(line)
        fields = _fields(b"".join(head))
        wanted = want(fields)
        length = fields["content_length"] or 0
        if wanted and payloads:
            yield fields, _payload(fields, file.read(length))
        else:
            file.seek(length, 1)
            if wanted:
                yield fields, None


# ---- data source ---------------------------------------------------------------------------

@dataclass
class Written(WriterCommitMessage):
    name: str | None
    splits: list


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches):
        from pyspark import TaskContext
        name, splits, size = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", [], 0
        fs, folder = _open(self.path)
        fs.create_dir(folder)
        stream = None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if stream is None:
                        stream = fs.open_output_stream(f"{folder}/{name}", buffer_size=1 << 20, compression=None)
                        head = member(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date": DATE,
                                              "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                        stream.write(head)
                        splits, size = [0], len(head)
                    if size - splits[-1] >= SPLIT_BYTES:
                        splits.append(size)
                    data = member(page_record(row))
                    stream.write(data)
                    size += len(data)
        finally:
            if stream is not None:
                stream.close()
        return Written(name if stream is not None else None, [*splits, size])

    def commit(self, messages):
        fs, folder = _open(self.path)
        fs.create_dir(folder)
        done = sorted((m.name, m.splits) for m in messages if m is not None and m.name)
        with fs.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(done).encode())

    def abort(self, messages):
        """Archives that no manifest lists are never read."""


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() != "false"
        self.tests: list = []

    def pushFilters(self, filters):
        for f in filters:
            test = _test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self):
        fs, folder = _open(self.path)
        if fs.get_file_info(f"{folder}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
                listed = json.loads(f.read())
            return [Part(name, a, b) for name, splits in listed for a, b in zip(splits, splits[1:])] or [Part("", 0, 0)]
        found = fs.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
        return [Part(x.path[len(folder):].lstrip("/"), 0, None) for x in found if x.path.endswith((".warc", ".warc.gz"))] or [Part("", 0, 0)]

    def read(self, part):
        if not part.path:
            return
        fs, folder = _open(self.path)
        tests = self.tests

        def want(fields):
            return all(t(fields) for t in tests)

        rows, size = [], 0
        with fs.open_input_file(f"{folder}/{part.path}") as raw:
            end = raw.size() if part.end is None else part.end
            file = io.BufferedReader(raw, 1 << 20)
            records = _members(file, part.start, end, want, self.payloads) if part.path.endswith(".gz") else _plain(file, want, self.payloads)
            for fields, payload in records:
                rows.append({**fields, "payload": payload})
                size += len(payload or b"")
                if size >= BATCH_BYTES or len(rows) >= 5000:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[n] for r in rows], TYPES.get(n, pa.string())) for n in NAMES], names=NAMES)


def _test(f):
    """A predicate on header fields, or None if it cannot be decided there."""
    if isinstance(f, Not):
        inner = f.child
        if isinstance(inner, (EqualTo, In)) and (own := _test(inner)):
            column = inner.attribute[0]
            return lambda h: h[column] is not None and not own(h)
        return None
    if len(f.attribute) != 1 or f.attribute[0] not in NAMES or f.attribute[0] == "payload":
        return None
    c = f.attribute[0]
    if isinstance(f, IsNotNull):
        return lambda h: h[c] is not None
    if isinstance(f, IsNull):
        return lambda h: h[c] is None
    value = f.value
    compare = {EqualTo: lambda x: x == value, In: lambda x: x in value, GreaterThan: lambda x: x > value, GreaterThanOrEqual: lambda x: x >= value,
               LessThan: lambda x: x < value, LessThanOrEqual: lambda x: x <= value, StringStartsWith: lambda x: x.startswith(value)}.get(type(f))
    return compare and (lambda h: h[c] is not None and compare(h[c]))


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_warc(records: DataFrame, path: str) -> None:
    records.sparkSession.dataSource.register(WarcDataSource)
    records.select(*[F.col(n) if n in records.columns else F.lit(None).cast("string").alias(n) for n in NAMES]).write.format("warc").mode("append").save(path)


# ---- pages ---------------------------------------------------------------------------------

def _record_id(column):
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(column.cast("string"), F.lit("")), F.lit(">"))


def page_of(record_id, kind: str):
    digits = F.regexp_extract(record_id, r"^<urn:x-page:(.*)>$", 1)
    return F.when(digits != "", digits).cast(kind)


def page_records(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Records of pages; of equal payloads of LEAST_SHARED bytes or more only the last page's is a response.

    A null page_id counts as the smallest; repeated rows of the last page are responses each.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_length": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    shared = _shared_payloads(rows)
    pick = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    rows = rows.withColumn("salt", pick).join(shared, ["sha1", "payload_length", "salt"], "left")
    again = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return rows.select(_record_id(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri",
                       F.when(again, _record_id(F.col("keep"))).alias("refers_to"), F.concat(F.lit("sha1:"), F.col("sha1")).alias("payload_digest"),
                       "payload_length", F.when(~again, F.col("payload")).alias("payload"))


def _shared_payloads(rows: DataFrame) -> DataFrame:
    """Payloads that several pages have, with the largest page_id; salted for the join with pages."""
    shared = (rows.where(F.col("payload_length") >= LEAST_SHARED).groupBy("sha1", "payload_length").agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
              .where("n > 1 AND keep IS NOT NULL").drop("n"))
    return small(stored(shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))), BROADCAST_ROWS)
