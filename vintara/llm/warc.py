"""WARC archives: writing with revisit records, and a splittable reader.

Archives hold one gzip member per record. A reading task is given a byte range of a file: it looks for gzip's magic
bytes, decodes a candidate's headers (type, record id, length), inflates it and the members that follow, and takes it only
if all of them are whole records of the stated length, one right after the other, up to the range's end. It owns exactly
the records that start inside its range, reading beyond the range's end as far as the last of them goes. So a file of any
length is read by as many tasks as it has ranges, without an index.

An archive may lie inside a payload, and a long one may fill a range with records of its own. So the ranges are compared
before any record is returned: the first record of a file starts at byte 0, and each range's first record must start where
the last one before it ended. Ranges that took something else are scanned again from there.

Writers give each file a name of its own attempt and report it in a manifest, which is written once; files of failed or
repeated attempts are in no manifest and are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, shared_dir

MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive that one task reads.
RANGE = 4 << 20
#: A record's headers have at most so many bytes.
HEADERS = 1 << 16
#: Payloads of at least so many bytes are stored once.
MIN_REVISIT = 0
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:vintara:page:"
RECORD = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared path, local or remote."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with a response record, or with a revisit record if it refers to another page."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        *([f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(whole) + packer.flush()


def headers(whole: bytes) -> tuple[dict[bytes, str], int] | None:
    """A record's header fields and where its block begins; None if it does not begin as a record, or not yet."""
    end = whole.find(b"\r\n\r\n")
    if end < 0 or not whole.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in whole[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    named = fields.get(b"warc-type") and fields.get(b"warc-record-id") and fields.get(b"content-length", "").isdigit()
    return (fields, end + 4) if named else None


def parse(whole: bytes) -> tuple[str | None, ...]:
    """A record's bytes as a row of RECORD."""
    fields, begin = headers(whole)
    block = whole[begin : begin + int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    kind = fields[b"warc-type"]
    n = int(length[1]) if length and kind == "revisit" else len(payload)
    digest = fields.get(b"warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response" and digest and payload_digest(payload) != digest:
        raise ValueError(f"payload of {fields[b'warc-record-id']} does not have the digest {digest}")
    strip = lambda x: x.strip("<>") if x else None
    return strip(fields[b"warc-record-id"]), kind, fields.get(b"warc-target-uri"), digest, strip(fields.get(b"warc-refers-to")), n, payload if kind == "response" else None


class NotARecord(Exception):
    pass


class _Reader:
    """Members of an open file from byte ``start`` on, read ahead as they need it."""

    def __init__(self, f, start: int, end: int, size: int, ahead: int):
        f.seek(start)
        self.f, self.start, self.ahead = f, start, ahead
        self.data = bytearray(f.read(min(end + ahead, size) - start))

    def member(self, at: int, keep: bool) -> tuple[int, bytes]:
        """The end of the record at byte ``at`` and, if kept, its bytes. Raises if there is none; EOFError if the file ends in it."""
        unpack, parts, fed, piece = zlib.decompressobj(31), [], at - self.start, 4096
        begin, found, total = b"", None, 0
        while not unpack.eof:
            if fed >= len(self.data):
                self.data += self.f.read(self.ahead)
                if fed >= len(self.data):
                    raise EOFError(f"the record at byte {at} is cut off")
            try:
                out = unpack.decompress(bytes(self.data[fed : fed + piece]))
            except zlib.error as error:
                raise NotARecord from error
            fed, piece = min(fed + piece, len(self.data)), min(2 * piece, self.ahead)
            if found is None:
                begin += out
                found = headers(begin)
                if found is None and (unpack.eof or len(begin) > HEADERS or not begin[:7].startswith(b"WARC/1."[: len(begin)])):
                    raise NotARecord
            total += len(out)
            if keep:
                parts.append(out)
        if total != found[1] + int(found[0][b"content-length"]) + 4:
            raise NotARecord
        return self.start + fed - len(unpack.unused_data), b"".join(parts)

    def chain(self, at: int, end: int, size: int) -> int:
        """Where the last of the records ends that start from byte ``at`` on before ``end``, each right after the one before."""
        while at < min(end, size):
            at, _ = self.member(at, False)
        return at

    def find(self, end: int, size: int) -> tuple[int, int] | None:
        """The first record that starts before ``end``, told by the chain that follows it, and the chain's end."""
        at = self.data.find(MAGIC)
        while 0 <= at < end - self.start:
            try:
                return self.start + at, self.chain(self.start + at, end, size)
            except (NotARecord, EOFError):
                at = self.data.find(MAGIC, at + 1)
        return None


def records_in(f, start: int, end: int, size: int, ahead: int = 1 << 20, first: int | None = None) -> Iterator[bytes]:
    """The records of the open file that start in [start, end); ``first``: the first of them, where it is known."""
    reader = _Reader(f, start if first is None else first, end, size, ahead)
    if first is None:
        found = (0, 0) if start == 0 else reader.find(end, size)
        first = found[0] if found else size
    while first < min(end, size):
        first, whole = reader.member(first, True)
        yield whole


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write a record per row of ``pages`` below ``folder`` (shared); the manifest: rows (path, bytes, records)."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("html"))
    rows = rows.withColumn("sha", F.when(F.octet_length("html") >= min_revisit, F.sha1(F.col("html").cast("binary"))))
    kept = rows.where("sha is not null").groupBy("sha").agg(F.max("id").alias("keep"), F.count("*").alias("c"))
    kept = materialize(kept.where("c > 1").select(F.col("sha").alias("s"), "keep"), "kept")
    rows = rows.join(kept, F.col("sha") == F.col("s"), "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        system, path = _open(name)
        out, size, count = None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("id", "url", "html", "refers_to"))):
                page_id, url, html, to = (x.as_py() for x in row)
                member = record(page_id, url, html.encode("utf-8", "surrogatepass"), to)
                if out is None:
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)  # by default it would pack a .gz again
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [count]})

    done = rows.select("id", "url", "html", refers).mapInArrow(written, "path string, bytes long, records long")
    return materialize(done, "manifest")


def _scanned(range_bytes: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (path, bytes, start, first, stop): a range, where its first record starts and its last one ends; given ``due``, it starts there."""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                start, size = row["start"], row["bytes"]
                end, due = min(start + range_bytes, size), 0 if start == 0 else row["due"]
                system, path = _open(row["path"])
                with system.open_input_file(path) as f:
                    reader = _Reader(f, start if due is None else due, end, size, 1 << 20)
                    found = reader.find(end, size) if due is None else (due, reader.chain(due, end, size))
                out.append((row["path"], size, start, *(found or (None, None))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), *[pa.int64()] * 4))], ["path", "bytes", "start", "first", "stop"])

    return scan


def record_ranges(manifest: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """The ranges of the files (path, bytes) of ``manifest``: (path, bytes, start, first, stop), first being where the range's first record starts, null for none."""
    spark = manifest.sparkSession
    starts = F.explode(F.expr(f"sequence(0L, bytes - 1, {range_bytes}L)")).alias("start")
    ranges = manifest.where("bytes > 0").select("path", "bytes", starts).withColumn("due", F.lit(None).cast("long"))
    ddl = "path string, bytes long, start long, first long, stop long"
    spread = lambda df: df.repartition(4 * partitions(spark), "path", "start").mapInArrow(_scanned(range_bytes), ddl)
    found = materialize(spread(ranges), "ranges")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        reached = F.coalesce(F.max("stop").over(before), F.lit(0))
        due = F.when(reached < F.least(F.col("start") + range_bytes, F.col("bytes")), reached)
        judged = materialize(found.withColumn("due", due), "judged")
        wrong = judged.where(~F.col("first").eqNullSafe(F.col("due")))
        if not wrong.limit(1).count():
            return found
        # Nothing starts in a range without a due record; in the others it is known where.
        none = wrong.where("due is null").select("path", "bytes", "start", "due", F.lit(None).cast("long").alias("stop")).withColumnRenamed("due", "first")
        right = judged.where(F.col("first").eqNullSafe(F.col("due"))).drop("due")
        again = spread(wrong.where("due is not null").select("path", "bytes", "start", "due"))
        found = materialize(right.unionByName(none).unionByName(again), "ranges")


def read_archives(manifest: DataFrame, range_bytes: int = RANGE, with_payload: bool = True) -> DataFrame:
    """Rows of RECORD for the files (path, bytes) of ``manifest``, read range by range."""
    spark = manifest.sparkSession
    ranges = record_ranges(manifest, range_bytes).where("first is not null").repartition(4 * partitions(spark), "path", "start")
    kinds = pa.schema([pa.field(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD.split(", "))])
    if not with_payload:
        kinds = kinds.remove(len(kinds) - 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _open(row["path"])
                with system.open_input_file(path) as f:
                    found = []
                    for whole in records_in(f, row["start"], row["start"] + range_bytes, row["bytes"], first=row["first"]):
                        found.append(parse(whole)[: len(kinds)])
                        if len(found) >= 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds.types)], schema=kinds)
                            found = []
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds.types)], schema=kinds)

    return ranges.mapInArrow(read, RECORD if with_payload else RECORD.rpartition(",")[0])


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, range_bytes: int = RANGE) -> DataFrame:
    """Write a record per row of ``pages`` and read all back: the id, payload_bytes, payload_digest, record_type, refers_to.

    The payload is the html in UTF-8, empty for null. Of records with equal payloads of at least ``min_revisit`` bytes
    the one with the largest id is a response and the others are revisits that refer to it; smaller ones are all
    responses. Payload length and digest (base32 SHA-1) are those of the full payload, also for revisits. Rows that
    repeat an id and its payload are equal to the one that stays, and so are responses. A null id is the smallest. Other
    columns are ignored; an empty table gives no archives and no rows.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex[:12]}"
    manifest = write_archives(pages, folder, id_col, url_col, html_col, min_revisit)
    rows = read_archives(manifest, range_bytes, with_payload=False)
    kind = pages.schema[id_col].dataType.simpleString()
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(_ID) + 1}) as {kind})")
    return rows.select(number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM k
"""
