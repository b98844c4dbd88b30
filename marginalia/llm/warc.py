"""Conversion of legacy ARC archives into WARC archives.

An ARC file begins with a version block whose second line names the version and whose
third lists the fields of the URL records: version 1 has five of them, version 2 ten.  A
record is one header line and as many bytes as the line's last field declares.  The
converter parses both, splits the stored HTTP response, and synthesises the WARC fields:
record identifiers from the place in the archive, ISO timestamps from 14-digit dates,
record types from equal payload digests (one response, revisits refer to it), and SHA-1
digests of payloads and blocks.

Archives are gzip files of limited size, one row of the text sink each, so they are
written and read by Spark alone, in whatever store holds the checkpoint folder.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.durable import fresh_path, stored

ARCHIVE_BYTES = 8 << 20
"""Uncompressed size from which an archive is closed; a larger record has its own."""

REVISIT_BYTES = 1000
"""Shorter payloads are always stored, never referred to."""

# The field lists of the two ARC versions and the WARC revisit profile.
FIELDS_V1 = "URL IP-address Archive-date Content-type Archive-length"
FIELDS_V2 = (
    "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
KEY_HEADER = "X-Record-Key"
"""HTTP header that carries a record's own identifier through the archives."""


class ArcRecord(NamedTuple):
    offset: int
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes


def arc_version_block(name: str, version: int, date: str) -> bytes:
    """The first record of an archive."""
    fields = FIELDS_V1 if version == 1 else FIELDS_V2
    body = f"{version} {0 if version == 1 else 1} marginalia\n{fields}\n".encode()
    head = f"filedesc://{name}.arc 0.0.0.0 {date} text/plain"
    if version == 2:
        head += f" 200 - - 0 {name}.arc"
    return f"{head} {len(body)}\n".encode() + body + b"\n"


def arc_record(key, url: str | None, payload: bytes, version: int, date: str, name: str, offset: int) -> bytes:
    """One URL record holding an HTTP response; white space in URLs is percent-encoded."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "") or "-"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
    if key is not None:
        head += f"{KEY_HEADER}: {key}\r\n"
    block = head.encode() + b"\r\n" + payload
    line = f"{target} 0.0.0.0 {date} text/html"
    if version == 2:
        line += f" 200 {hashlib.sha1(block).hexdigest()} - {offset} {name}.arc"
    return f"{line} {len(block)}\n".encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The URL records of an archive of either version, by declared lengths."""
    names: list[str] = []
    at = 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # the separator after a record
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line at {at} is cut off")
        values = data[at:end].decode("utf-8").split(" ")
        length = int(values[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"record at {at} declares {length} bytes, {len(block)} are left")
        if values[0].startswith("filedesc:"):
            first, fields = block.decode("utf-8").split("\n")[:2]
            if first.split(" ")[0] not in ("1", "2"):
                raise ValueError(f"unknown archive version: {first}")
            names = fields.split(" ")
        else:
            if len(values) != len(names):
                raise ValueError(f"header line at {at} has {len(values)} fields, {len(names)} are declared")
            row = dict(zip(names, values))
            yield ArcRecord(at, row["URL"], row["IP-address"], row["Archive-date"], row["Content-type"], block)
        at = end + 1 + length


def _inflated(content: bytes) -> bytes:
    """All members of a gzip file."""
    out, rest = [], content
    while rest:
        member = zlib.decompressobj(31)
        out.append(member.decompress(rest) + member.flush())
        rest = member.unused_data
    return b"".join(out)


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Lower-cased HTTP headers and the payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(archive: str, offset: int) -> str:
    """A UUID that depends on the record's place alone, so a repeated task makes it again."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{archive}:{offset}'.encode()).digest()[:16], version=5)}"


def warc_record(archive: str, record: ArcRecord, refers: tuple[str, int] | None) -> bytes:
    """The WARC record of an ARC record; a revisit keeps the HTTP headers only."""
    _, payload = split_http(record.block)
    block = record.block if refers is None else record.block[: len(record.block) - len(payload)]
    d = record.date
    fields = [
        "WARC/1.0", f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(archive, record.offset)}>",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {record.url}", f"WARC-IP-Address: {record.ip}",
        f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers is not None:
        fields += [f"WARC-Refers-To: <{record_id(*refers)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join([*fields, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-cased headers, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(head["content-length"])
        yield head, data[end + 4 : end + 4 + length]
        at = end + 4 + length


def _write(archives: DataFrame, path: str) -> None:
    """One gzip file per row of one text column."""
    archives.write.option("maxRecordsPerFile", 1).option("compression", "gzip").mode("errorifexists").text(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    """archive (file name) and content of each archive in a folder."""
    if not spark.read.format("binaryFile").load(f"{path}/*").select("path").head(1):
        return spark.createDataFrame([], "archive string, content binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def write_arc(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url",
              payload_col: str = "html", date: str = "20240101000000") -> None:
    """Pages as ARC archives of both versions in turn; null payloads are empty."""
    rows = pages.select(F.col(key_col).cast("string"), F.col(url_col), F.col(payload_col))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, parts, size = 1, [], 0
        for batch in batches:
            for key, url, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if not parts:
                    parts.append(arc_version_block("records", version, date))
                    size = len(parts[0])
                parts.append(arc_record(key, url, (payload or "").encode("utf-8", "replace"), version, date, "records", size))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield _row(parts)
                    version, parts = 3 - version, []
        if parts:
            yield _row(parts)

    def _row(parts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts).decode("utf-8")])], ["value"])

    _write(rows.mapInArrow(archives, "value string"), path)


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """archive, offset, key, payload_bytes, digest of every record of a folder of ARCs."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(*(c.to_pylist() for c in batch.columns)):
                out = []
                for record in parse_arc(_inflated(content)):
                    head, payload = split_http(record.block)
                    out.append((archive, record.offset, head.get(KEY_HEADER.lower()), len(payload), hashlib.sha1(payload).hexdigest()))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()))],
                        ["archive", "offset", "key", "payload_bytes", "digest"],
                    )

    return _read(spark, path).mapInArrow(index, "archive string, offset bigint, key string, payload_bytes bigint, digest string")


def revisits(index: DataFrame) -> DataFrame:
    """archive, offset, to_archive, to_offset of the records that repeat a payload.

    Of equal payloads of at least REVISIT_BYTES the record with the greatest key (as a
    number; records without key last, ties to the first place) is stored.  Groups are
    reduced before they are shuffled; the join back leaves a frequent digest to Spark's
    splitting of skewed partitions.
    """
    long = index.filter(F.col("payload_bytes") >= REVISIT_BYTES).withColumn("n", F.col("key").try_cast("bigint"))
    # max_by over (key, smaller place): the place is turned round by taking minima of its complement.
    best = (
        long.groupBy("digest")
        .agg(F.max(F.struct("n", (-F.col("offset")).alias("o"))).alias("top"), F.count(F.lit(1)).alias("size"))
        .filter(F.col("size") > 1)
    )
    same = long.join(best, "digest")
    is_top = F.col("n").eqNullSafe(F.col("top.n")) & (-F.col("offset") == F.col("top.o"))
    # Several archives can hold the same key at the same offset: the first archive is taken.
    chosen = same.filter(is_top).groupBy("digest").agg(
        F.min(F.struct("archive", "offset")).alias("to")
    )
    return (
        same.select("archive", "offset", "digest").join(chosen, "digest")
        .filter((F.col("archive") != F.col("to.archive")) | (F.col("offset") != F.col("to.offset")))
        .select("archive", "offset", F.col("to.archive").alias("to_archive"), F.col("to.offset").alias("to_offset"))
    )


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Write one WARC archive for each ARC archive of a folder.

    The decisions about revisits are made on the narrow index; each archive then gets the
    list of its own revisits, whose length is bounded by the archive's.
    """
    index = stored(arc_index(spark, arc_path), "arc-index")
    own = revisits(index).groupBy("archive").agg(F.collect_list(F.struct("offset", "to_archive", "to_offset")).alias("refers"))
    archives = _read(spark, arc_path).join(own, "archive", "left")

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content, refers in zip(*(c.to_pylist() for c in batch.columns)):
                to = {r["offset"]: (r["to_archive"], r["to_offset"]) for r in refers or []}
                records = [warc_record(archive, r, to.get(r.offset)) for r in parse_arc(_inflated(content))]
                if records:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(records).decode("utf-8")])], ["value"])

    _write(archives.select("archive", "content", "refers").mapInArrow(converted, "value string"), warc_path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, key, url, payload_bytes, payload_digest, refers_to_id.

    Digests of stored payloads are computed again and must equal the declared ones.  A
    revisit's size and digest are those its HTTP and WARC headers declare.
    """
    names = ["record_id", "record_type", "key", "url", "payload_bytes", "payload_digest", "refers_to_id"]
    kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 2

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1).to_pylist():
                out = []
                for head, block in parse_warc(_inflated(content)):
                    http, payload = split_http(block)
                    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    size = int(http["content-length"])
                    if head["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"digest of {head['warc-record-id']} differs")
                    out.append((
                        head["warc-record-id"].strip("<>"), head["warc-type"], http.get(KEY_HEADER.lower()),
                        head["warc-target-uri"], size, digest, head.get("warc-refers-to", "").strip("<>") or None,
                    ))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = ", ".join(f"{n} {'bigint' if n == 'payload_bytes' else 'string'}" for n in names)
    return _read(spark, path).mapInArrow(records, schema)


def archived(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages through ARC and WARC archives and back: one row per page with its key,
    payload_bytes, payload_digest, record_type, refers_to (key of the stored response).

    Null payloads are empty, null URLs are written as "-", null keys stay null.  Of
    repeated rows one is the response and the others revisit it.  An empty table writes
    no archive and gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, key_col, url_col, payload_col)
    convert(spark, arc, warc)
    records = stored(read_warc(spark, warc), "warc-records")
    responses = records.filter(F.col("record_type") == "response").select(
        F.col("record_id").alias("refers_to_id"), F.col("key").alias("_to")
    )
    kind = pages.select(key_col).schema[0].dataType
    plain = records.filter(F.col("refers_to_id").isNull()).withColumn("_to", F.lit(None).cast("string"))
    linked = records.filter(F.col("refers_to_id").isNotNull()).join(responses, "refers_to_id", "left")
    both = plain.unionByName(linked)
    return both.select(
        F.col("key").try_cast(kind).alias(key_col), "payload_bytes", "payload_digest", "record_type",
        F.col("_to").try_cast(kind).alias("refers_to"),
    )


def op3_warc_archives(spark, sf_dir: str) -> DataFrame:
    """Every page through legacy archives, converted and read back."""
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
