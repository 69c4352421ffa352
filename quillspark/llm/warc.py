"""WARC files and a reader that salvages damaged ones.

Records of equal payload are written once, as a response; the others are revisits
that refer to it. Spark's own writer commits the files (a row is a record), so lost
tasks leave no part of a record. Compressed files hold a gzip member a record; the
line separator is an empty member then, and the blank lines that end a record
otherwise.

``salvage`` reads whole files of bounded size. After a failed check (member, version
line, header, length, digest of the block or of what the payload digest covers) it
searches for the next valid member or version line, goes on from there, and reports
the bytes between as a quarantined gap. ``restore`` logs the gaps in a table and
checks each revisit against the response it refers to.

Edge cases: null html is an empty payload; null urls are empty; a null page_id is
written as such and never referred to; rows that repeat page_id and payload of the
response are responses all; empty tables give no files and no rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, durable, read, release, small_arrow

VERSION = b"WARC/1.1"
MIN_BYTES = 0
RECORDS_A_FILE = 4_000
#: Bytes of a file at most, before compression; it is read as a whole.
FILE_BYTES = 1 << 29
_HEAD_BYTES = 1_000
_EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003030000000000000000" + "00")
_MEMBER = b"\x1f\x8b\x08"
_DATE = "2020-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest) of pages."""

    def run(batches):
        for batch in batches:
            raw = [(x or "").encode() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in raw], pa.int64()), pa.array([digest(x) for x in raw], pa.string())], ["page_id", "url", "html", "payload_bytes", "payload_digest"])

    small_arrow(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, html string, payload_bytes long, payload_digest string")


def record(page_id, url, html, size, name, refers_to, compress: bool) -> bytes:
    """A record without the separator."""
    revisit = refers_to is not None
    payload = b"" if revisit else (html or "").encode()
    url = re.sub(r"[\r\n]", "", url or "")
    head = [
        VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {url}", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{name}", f"WARC-Block-Digest: sha1:{digest(payload)}", f"Payload-Length: {size}", "Content-Type: text/html",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    out = "\r\n".join([*head, f"Content-Length: {len(payload)}", "", ""]).encode() + payload
    return gzip.compress(out + b"\r\n\r\n", 6, mtime=0) if compress else out


def write(pages: DataFrame, path: str, compress: bool = True, min_bytes: int = MIN_BYTES) -> None:
    """WARC files of pages (page_id, url, html) under path. A payload moves once, by its
    page_id: which record it refers to is settled on small rows. A file has so many
    records that even the largest ones keep it under ``FILE_BYTES``."""
    largest = pages.agg(F.max(F.octet_length("html")).alias("h"), F.max(F.octet_length("url")).alias("u")).first()
    records = max(1, min(RECORDS_A_FILE, FILE_BYTES // ((largest.h or 0) + (largest.u or 0) + _HEAD_BYTES)))
    pages = digests(pages)
    light = durable(pages.where(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest"))
    again = light.groupBy("payload_digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    refers = light.join(again, "payload_digest").where("page_id is null or page_id < _last").distinct()
    refers = durable(refers.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("_last").alias("refers_to")))
    joined = pages.join(refers, pages["page_id"].eqNullSafe(refers["_page"]) & (pages["payload_digest"] == refers["_digest"]), "left").select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([record(*row, compress) for row in zip(*[c.to_pylist() for c in batch.columns], strict=True)], pa.binary())], ["record"])

    separator = _EMPTY_MEMBER.decode("latin-1") if compress else "\r\n\r\n"
    written = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    written.write.option("lineSep", separator).option("encoding", "ISO-8859-1" if compress else "UTF-8").option("maxRecordsPerFile", records).text(path)
    release(light, refers)


class _Bad(ValueError):
    pass


def _page(x: str | None) -> int | None:
    """The page_id of a record id; other ids are none. A number over 64 bits is damage."""
    m = re.fullmatch(r"<urn:page:(-?[0-9]{1,20})>", x or "")
    if m and not -(1 << 63) <= int(m[1]) < 1 << 63:
        raise _Bad("bad id")
    return int(m[1]) if m else None


def _same_digest(said: str, data: bytes) -> bool:
    """Whether a digest field fits; algorithms other than SHA-1 are not judged."""
    algorithm, _, value = said.partition(":")
    if algorithm.strip().lower() != "sha1":
        return True
    own = hashlib.sha1(data).digest()
    return value.strip().upper() in (base64.b32encode(own).decode(), own.hex().upper())


def _payload(head: dict, block: bytes) -> bytes:
    """What a payload digest covers: of an HTTP message its body."""
    if head.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _parse(data: bytes, at: int, whole: bool) -> tuple[dict, bytes, int]:
    """(headers, block, end) of the record that begins at byte at. whole: the data
    is one record's and ends with it."""
    if not data.startswith(b"WARC/1.", at):
        raise _Bad("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise _Bad("header without end")
    try:
        lines = data[at:end].decode().split("\r\n")
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        length, full = (int(re.fullmatch("[0-9]{1,18}", x)[0]) for x in (head["content-length"], head.get("payload-length", "0")))
        head["warc-type"], head["warc-record-id"]
    except (ValueError, KeyError, TypeError, UnicodeDecodeError):
        raise _Bad("bad header") from None
    stop = end + 4 + length
    if data[stop : stop + 4] != b"\r\n\r\n" or (whole and stop + 4 != len(data)):
        raise _Bad("wrong length")
    block = data[end + 4 : stop]
    head["_page"], head["_refers"], head["_full"] = _page(head["warc-record-id"]), _page(head.get("warc-refers-to")), full
    if not _same_digest(head.get("warc-block-digest", ""), block):
        raise _Bad("wrong digest")
    if head["warc-type"] == "response" and not _same_digest(head.get("warc-payload-digest", ""), _payload(head, block)):
        raise _Bad("wrong digest")
    return head, block, stop + 4


def salvage_bytes(data: bytes):
    """("record", headers, block, first, end) and ("gap", reason, None, first, end)
    in order of the file; together they cover it, but for empty members."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            if data.startswith(_MEMBER, at):
                plain, end = _inflate(data, at)
                found = _parse(plain, 0, True) if plain else None
            else:
                found = _parse(data, at, False)
                end = found[2]
        except _Bad as e:
            if gap is None:
                gap, reason = at, str(e)
            after = [x for x in (data.find(_MEMBER, at + 1), data.find(b"WARC/1.", at + 1)) if x >= 0]
            at = min(after, default=len(data))
            continue
        if gap is not None:
            yield "gap", reason, None, gap, at
            gap = None
        if found:
            yield "record", found[0], found[1], at, end
        at = end
    if gap is not None:
        yield "gap", reason, None, gap, len(data)


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """(content, end) of the gzip member at byte at; its checksum is verified. Fed
    by pieces, so that what follows the member is not copied each time."""
    z, out, step = zlib.decompressobj(31), [], 1 << 16
    try:
        for i in range(at, len(data), step):
            out.append(z.decompress(data[i : i + step]))
            if z.eof:
                return b"".join(out), min(i + step, len(data)) - len(z.unused_data)
    except zlib.error:
        raise _Bad("damaged member") from None
    raise _Bad("member without end")


def salvage(spark: SparkSession, path: str, suffix: str = "part-*") -> DataFrame:
    """(kind, file, first_byte, end_byte, page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, payload, reason) of the files under path; kind is
    record or gap."""
    schema = "kind string, file string, first_byte long, end_byte long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, reason string"
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for kind, a, block, first, end in salvage_bytes(content.as_py()):
                    if kind == "gap":
                        rows.append((kind, file, first, end, None, None, None, None, None, None, None, a))
                    else:
                        body = _payload(a, block)
                        revisit = a["warc-type"] == "revisit"
                        n = a["_full"] if revisit else len(body)
                        name = a.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest(body)
                        rows.append((kind, file, first, end, a["_page"], a.get("warc-target-uri"), a["warc-type"], a["_refers"], n, name, body, None))
                        size += len(block)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def restore(spark: SparkSession, path: str, suffix: str = "part-*") -> DataFrame:
    """The sound records under path, without payloads; what is not sound is logged as a
    table in ``<path>-gaps``. A revisit is sound if a response that was read has its
    digest, length and page_id; others are logged as orphans."""
    found = durable(salvage(spark, path, suffix).drop("payload"))
    responses = found.where("record_type = 'response'").select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).distinct()
    revisits = found.where("record_type = 'revisit'")
    same = (revisits["refers_to"] == responses["_page"]) & (revisits["payload_digest"] == responses["_digest"]) & (revisits["payload_bytes"] == responses["_bytes"])
    orphans = revisits.join(responses, same, "left_anti").withColumn("kind", F.lit("orphan")).withColumn("reason", F.lit("no response with this digest"))
    found.where("kind = 'gap'").unionByName(orphans).write.parquet(f"{path}-gaps")
    return found.where("kind = 'record' and record_type <> 'revisit'").unionByName(revisits.join(responses, same, "left_semi"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(read(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return restore(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows from the table. sha1() gives hexadecimal digits: five of them are four of base32.
OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, octet_length(b) AS n, h,
    (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1), '' ORDER BY i) FROM range(32) AS t(i)) AS digest
  FROM p),
m AS (SELECT h, max(page_id) AS last FROM d GROUP BY h)
SELECT page_id, cast(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM d JOIN m ON d.h = m.h
"""
