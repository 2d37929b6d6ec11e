"""WARC archives by their index: written with it, and read through it.

A task writes its records to archives of its own, each record a gzip member, so that any of
them can be read alone, and hands on an index row per record: file, offset, length, URL,
digest. The index is what counts: Spark commits its rows as a table, and a file that a lost or
repeated attempt left behind has no row in it and is never read. Reading selects index rows
first, deals them out by ranges of (file, offset), and each task joins neighbouring byte
ranges to few large reads.

Equal payloads of some size are stored once; the others are ``revisit`` records that name the
one that holds it. Which one that is, is decided on digests before any payload moves.
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
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import materialise, read
from ticketloom.session import scratch_dir

MIN_REVISIT_BYTES = 1000
#: A new archive begins behind this size; ranges at most GAP bytes apart are read together, up
#: to READ_BYTES at a time (a longer record is read alone).
ARCHIVE_BYTES, GAP, READ_BYTES = 256 << 20, 64 << 10, 8 << 20
#: Archived bytes that a reading task gets, unless there are fewer tasks than cores.
TASK_BYTES = 64 << 20
#: Capture time of all records: archives of the same pages are the same, whenever written.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = (
    "file string, offset long, length long, record_id string, record_type string, url string, digest string, payload_bytes long"
)
RECORD_SCHEMA = (
    "record_id string, record_type string, url string, refers_to string, digest string, payload_bytes long, payload binary"
)


def _header_value(value: str) -> str:
    """One line: control characters would end a header."""
    return re.sub(r"[\x00-\x1F\x7F]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(record_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or the revisit record of one that is stored elsewhere, gzipped."""
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest).decode()}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", _header_value(url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(head.encode() + block + b"\r\n\r\n") + gz.flush()


def _fields(head: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {name.lower(): value.strip() for name, _, value in lines}


def parsed_record(data: bytes) -> dict:
    """The fields of one gzipped record; the digest of a payload that is there is checked."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[:int(fields["content-length"])].partition(b"\r\n\r\n")
    algorithm, _, coded = fields["warc-payload-digest"].partition(":")
    digest, revisit = base64.b32decode(coded), fields["warc-type"] == "revisit"
    if algorithm != "sha1" or not (revisit or digest == hashlib.sha1(payload).digest()):
        raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
    return {
        "record_id": fields["warc-record-id"].strip("<>"), "record_type": fields["warc-type"],
        "url": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
        "digest": digest.hex(), "payload_bytes": int(_fields(http)["content-length"]),
        "payload": None if revisit else payload,
    }


def with_originals(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, original: of equal payloads the largest page_id, else null.

    Payloads are equal by SHA-256 and length. Only digests that occur again are stored and
    joined, from a plain table, so that a payload that fills much of the pages is split by AQE.
    """
    known = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    big = F.octet_length("payload") >= min_bytes
    known = known.withColumn("key", F.when(big, F.unhex(F.sha2("payload", 256))))
    repeated = known.filter("key IS NOT NULL").groupBy("key").agg(
        F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND original IS NOT NULL")
    return known.join(materialise(repeated.drop("n"), "originals"), "key", "left").drop("key")


def write_archives(
    records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write ``records`` (record_id, url, payload, refers_to) below ``folder``; their stored index.

    ``folder`` is a path or URI that all executors reach. A null payload is empty, a null URL
    has no header, and control characters in a URL are percent-coded. A record with
    ``refers_to`` is a revisit and keeps only length and digest of its payload. Repeated rows
    are written each. Without rows the index is empty. A record is held whole in memory.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, name, offset = None, None, 0
        try:
            for batch in batches:
                rows = []
                columns = (batch.column(c).to_pylist() for c in ("record_id", "url", "payload", "refers_to"))
                for record_id, url, payload, refers_to in zip(*columns):
                    if out is None or offset >= archive_bytes:
                        if out is not None:
                            out.close()
                        else:
                            store.create_dir(base, recursive=True)
                        # Each attempt has files of its own; the index names those that count.
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    payload = payload or b""
                    data = record_bytes(record_id, url, payload, refers_to)
                    out.write(data)
                    rows.append((name, offset, len(data), record_id, "revisit" if refers_to else "response", url,
                                 hashlib.sha1(payload).hexdigest(), len(payload)))
                    offset += len(data)
                yield _batch(rows, INDEX_SCHEMA)
        finally:
            if out is not None:
                out.close()

    rows = records.select(
        "record_id", "url", F.col("payload").cast("binary").alias("payload"), "refers_to")
    return materialise(rows.mapInArrow(work, INDEX_SCHEMA), "warc-index")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def coalesced(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list]]:
    """file, start, end and the ranges in it, for sorted (file, offset, length)."""
    file, start, end, own = None, 0, 0, []
    for f, offset, length in rows:
        if own and (f != file or offset > end + gap or offset + length - start > most):
            yield file, start, end, own
            own = []
        if not own:
            file, start, end = f, offset, offset
        end = max(end, offset + length)
        own.append((offset, length))
    if own:
        yield file, start, end, own


def read_records(index: DataFrame, folder: str, gap: int = GAP, most: int = READ_BYTES) -> DataFrame:
    """The records of the selected ``index`` rows, read from the archives below ``folder``.

    Returns record_id, record_type, url, refers_to, digest, payload_bytes and payload (null for a
    revisit; the other columns hold for its whole payload). Rows of one file and offset are read
    as often as they are listed. An empty selection reads nothing. The tasks are as many as the
    selection's bytes ask for, which one pass over its lengths counts.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            ranges = zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")))
            for file, start, end, own in coalesced(ranges, gap, most):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{base}/{file}")
                data = source.read_at(end - start, start)
                found = (parsed_record(data[offset - start:offset - start + length]) for offset, length in own)
                yield _batch([tuple(r.values()) for r in found], RECORD_SCHEMA)
        if source is not None:
            source.close()

    ranges = index.select("file", "offset", "length")
    # Ranges weigh by what they read, not by their own few bytes, so the number of tasks is set here.
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    ranges = ranges.repartitionByRange(tasks, "file", "offset")
    return ranges.sortWithinPartitions("file", "offset").mapInArrow(work, RECORD_SCHEMA)


def record_uri(page_id: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")))


def archive_pages(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) below ``folder``; the index of the records.

    Of equal payloads of ``min_bytes`` or more, the largest page_id is a response and the others
    revisit it; all others are responses. A null html is an empty payload. Repeated rows of the
    largest page_id are responses each; a row without page_id revisits like any other and is a
    response where no equal row has an id. Further columns are ignored.
    """
    known = with_originals(pages, min_bytes)
    other = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    records = known.select(
        record_uri(F.col("page_id")).alias("record_id"), "url", "payload",
        F.when(other, record_uri(F.col("original"))).alias("refers_to"))
    return write_archives(records, folder)


def op13_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "warc")
    index = archive_pages(read(spark, sf_dir, "pages"), folder)

    def page(uri: str) -> Column:  # the id of a page, null for "none"
        return F.expr(f"try_cast(substring_index({uri}, ':', -1) AS BIGINT)")

    return read_records(index, folder).select(
        page("record_id").alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.col("digest")).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"),
    )


OP13_SQL = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), g AS (
  SELECT *, CASE WHEN octet_length(payload) >= {MIN_REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS original
  FROM p
)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN original IS NULL OR page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM g
"""
