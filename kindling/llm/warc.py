"""Operator 13: WARC archives written from page rows, and a salvage reader for them.

Writer: every page becomes a response record, or a revisit of the response with an equal
payload; each record is a gzip member of its own (or a plain record).  The archives are real
files, written by Spark's text writer with a line separator that is part of the format (an empty
gzip member, or the blank lines that end a plain record), so any file system that Spark reaches
will do, and lost tasks are written anew by its committer.  A task starts a new archive after
``archive_bytes`` of content, so an archive's size doesn't grow with the table.

Reader: each archive is scanned on its own.  A member must inflate with a right checksum, start
with a version line, have the length it names, end in two blank lines and match its SHA-1 sums.
Where a check fails, the scan looks for the next gzip magic or version line at which a whole
record passes; the bytes between are a row of kind ``gap`` with the reason of the first failure.

Defined cases: a null payload is empty; null ids are the smallest, and stay null (no id line); of
equal ids with equal payloads the one of the greatest url, then any one row, is the response; control characters and
spaces of a url are percent-encoded in its header, a null url becomes ``urn:none``; repeated rows
are records of their own; an empty table gives no archive and no record; very long payloads are
one record in an archive of its own.  Extra columns of the input are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.llm.common import Scratch, checked_broadcast, table

#: Content that a task puts into one archive before it starts the next.
ARCHIVE_BYTES = 32 << 20
#: A gzip member without content: between two members it changes nothing.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000002ff03000000000000000000")
RECORD_END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "1970-01-01T00:00:00Z"

_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_STEP = 1 << 16
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *fields,
            ("WARC-Block-Digest", "sha1:" + base32_sha1(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def _record_id(row: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'page-row-{row}').urn}>"


def page_record(row: int, page_id: int | None, url: str | None, payload: bytes, first: dict | None, date: str = WARC_DATE) -> bytes:
    """The record of a page without its two closing blank lines; ``first``: the response it revisits."""
    uri = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    fields = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
              ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first is None:
        return _record("response", _record_id(row), fields, head + payload, date)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(first["row"]))]
    if first["page_id"] is not None:
        fields.append(("X-Refers-To-Page-Id", str(first["page_id"])))
    return _record("revisit", _record_id(row), fields, head, date)


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def mark_revisits(pages: DataFrame, scratch: Scratch, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(row, page_id, url, payload, first): ``first`` is the response that a revisit repeats, else null.

    Rows are stored once with a number of their own.  Only sums that occur twice or more are
    joined back, and their greatest row is found with map-side combination; a hot payload meets
    one row of that side, so a skewed join splits it freely.
    """
    payload = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"),
                        F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = scratch.write(rows.withColumn("digest", F.unhex(F.sha1("payload"))), "rows")
    sized = rows.where(F.octet_length("payload") >= min_bytes)
    place = F.struct(F.col("page_id").isNotNull(), "page_id", "url", "row")
    groups = sized.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(place).alias("first")).where("n > 1")
    groups = scratch.write(groups.select("digest", F.struct("first.row", "first.page_id").alias("first")), "groups")
    # where the repeated sums are few, payloads needn't move
    marked = rows.join(checked_broadcast(groups, groups.count(), 100), "digest", "left")
    other = F.col("first").isNotNull() & (F.col("first.row") != F.col("row")) & (F.octet_length("payload") >= min_bytes)
    return marked.select("row", "page_id", "url", "payload", F.when(other, F.col("first")).alias("first"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, compressed: bool = True, date: str = WARC_DATE) -> None:
    """Write ``pages`` as archives below ``path`` (a new folder)."""
    scratch = Scratch(pages.sparkSession, "warc-rows")
    marked = mark_revisits(pages, scratch, id_col, url_col, payload_col, min_bytes)
    end = RECORD_END if compressed else b""

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, filled = -1, archive_bytes
        for batch in batches:
            out, of = [], []
            for r in batch.to_pylist():
                if filled >= archive_bytes:
                    archive, filled = archive + 1, 0
                    info = _record("warcinfo", f"<{uuid.uuid4().urn}>", [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", date) + end
                    out.append(gzip_member(info) if compressed else info)
                    of.append(archive)
                data = page_record(r["row"], r["page_id"], r["url"], r["payload"], r["first"], date) + end
                filled += len(data)
                out.append(gzip_member(data) if compressed else data)
                of.append(archive)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(out, pa.binary())], ["archive", "data"])

    made = marked.mapInArrow(records, "archive int, data binary").select("archive", F.col("data").cast("string").alias("value"))
    sep = EMPTY_MEMBER if compressed else RECORD_END
    made.write.partitionBy("archive").option("encoding", "ISO-8859-1").option("lineSep", sep.decode("latin-1")).text(path)
    scratch.drop_all()


class Damaged(ValueError):
    """A record that fails a check; ``end`` is where its framing says that it ends, if that holds."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


def _head(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Header lines from ``at`` to the first blank line, and where the block starts."""
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("no end of header")
    lines = data[at:stop].split(b"\r\n")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        fields[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return fields, stop + 4


def _whole(sign: str | None) -> int | None:
    return int(sign) if sign and re.fullmatch(r"-?[0-9]{1,19}", sign) else None


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` of ``data`` and where the next one starts; ``Damaged`` where a check fails."""
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at):
        raise Damaged("no version line")
    fields, start = _head(data, at)
    size = _whole(fields.get("content-length"))
    if size is None or size < 0 or "warc-type" not in fields or "warc-record-id" not in fields:
        raise Damaged("missing field")
    stop = start + size
    if stop > len(data):
        raise Damaged("truncated")
    if data[stop:stop + 4] != RECORD_END:
        raise Damaged("wrong length")
    block, end = data[start:stop], stop + 4
    said = fields.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != base32_sha1(block):
        raise Damaged("block digest", end)
    out = {"record_type": fields["warc-type"], "record_id": fields["warc-record-id"], "url": fields.get("warc-target-uri"), "payload": None, "payload_bytes": None,
           "page_id": _whole(fields.get("x-page-id")), "payload_digest": None, "refers_to": _whole(fields.get("x-refers-to-page-id"))}
    if out["record_type"] in ("response", "revisit"):
        out["payload_digest"] = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        cut = block.find(b"\r\n\r\n")
        if cut < 0:
            raise Damaged("no end of HTTP header", end)
        http, _ = _head(block, 0)
        if out["record_type"] == "response":
            out["payload"] = block[cut + 4:]
            out["payload_bytes"] = len(out["payload"])
            if out["payload_digest"] not in (None, base32_sha1(out["payload"])):
                raise Damaged("payload digest", end)
        else:
            out["payload_bytes"] = _whole(http.get("content-length"))
    return out, end


def _inflate(data: memoryview, at: int) -> tuple[bytes, int]:
    """A gzip member's content and end.  Fed in steps: what follows a member is never copied."""
    z, parts, fed = zlib.decompressobj(31), [], at
    try:
        while not z.eof and fed < len(data):
            parts.append(z.decompress(data[fed:fed + _STEP]))
            fed = min(fed + _STEP, len(data))
    except zlib.error as e:
        raise Damaged("bad gzip member") from e
    if not z.eof:
        raise Damaged("truncated")
    return b"".join(parts), fed - len(z.unused_data)


def _member(data: bytes, view: memoryview, at: int) -> tuple[list[dict], int]:
    """Records of the gzip member, or the plain record, at ``at``, and the end."""
    if not data.startswith(_MAGIC, at):
        record, end = parse_record(data, at)
        return [record], end
    content, end = _inflate(view, at)
    records, inner = [], 0
    while inner < len(content):  # a member holds one record; some writers put several into one
        try:
            record, inner = parse_record(content, inner)
        except Damaged as e:
            raise Damaged(e.reason, end) from e
        records.append(record)
    return records, end


def scan_archive(data: bytes) -> Iterator[tuple[str, int, int, str | None, dict]]:
    """(kind, start, end, reason, record) of an archive's records and quarantined gaps, in order."""
    view, at, gap = memoryview(data), 0, None
    while at < len(data):
        try:
            records, end = _member(data, view, at)
        except Damaged as e:
            if gap is None:
                gap = (at, e.reason)
            # framing that leads to another start is believed; else any later byte may be one
            known = e.end is not None and (e.end == len(data) or _START.match(data, e.end))
            found = _START.search(data, e.end if known else at + 1)
            at = found.start() if found else len(data)
            continue
        if gap:
            yield "gap", gap[0], at, gap[1], {}
            gap = None
        for r in records:
            yield "record", at, end, None, r
        at = end
    if gap:
        yield "gap", gap[0], len(data), gap[1], {}


SCAN = pa.schema([("kind", pa.string()), ("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()),
                  ("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                  ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_SCAN_DDL = ("kind string, archive string, start long, end long, reason string, record_type string, record_id string, page_id long, url string, "
             "payload_bytes long, payload_digest string, refers_to long, payload binary")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records (kind ``record``) and quarantined byte ranges (kind ``gap``) of all archives below ``path``."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for kind, start, end, reason, r in scan_archive(content.as_py()):
                    rows.append({"kind": kind, "archive": name, "start": start, "end": end, "reason": reason, **r})
                    if not with_payload:
                        rows[-1]["payload"] = None
                    size += 300 + len(rows[-1].get("payload") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, SCAN)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SCAN)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(scan, _SCAN_DDL)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'warc').root}/archives"
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path, with_payload=False).where("record_type in ('response', 'revisit')")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a SHA-1 sum: four numbers of ten hex digits, eight signs of five bits each.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, {1 + 10 * k}, 10))::BIGINT >> {35 - 5 * j}) & 31)::INT), 1)"
                      for k in range(4) for j in range(8))
OP13_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h,
                  row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS k,
                  max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
           FROM pages)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
FROM p
"""
