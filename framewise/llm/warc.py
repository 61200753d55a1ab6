"""WARC archives: write, index, and read back by coalesced byte ranges.

Every task writes its records into archive files of its own in a shared
folder, a gzip member per record, and returns the index: archive, offset,
length, URL and digest of each record.  Only the index rows of the attempt
that Spark accepts count, so a lost executor leaves at most an unreferenced
file.  Reading selects index rows, deals them out by archive and byte range,
sorts them by offset and joins neighbouring ranges into one read.

Defined cases: NULL html is an empty payload, a NULL URL is written as
``urn:page:<id>``, control characters and spaces in URLs are percent-encoded,
rows that repeat the least page_id of a group are responses too, a NULL
page_id counts after every other id, an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import partitions_for, shared_path, stage, text_batches

INDEX_SCHEMA = ("page_id long, archive string, offset long, length long, url string, digest string, "
                "record_type string, refers_to long")
READ_SCHEMA = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
               "payload_digest string, payload binary")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")     # the URL namespace of RFC 4122


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    if not re.match(r"[a-z][a-z0-9+.-]*:", uri):
        uri = f"file://{uri}"
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def _safe(url: str | None, page_id) -> str:
    url = url if url else f"urn:page:{page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def format_record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}",
            f"WARC-Date: {date}", f"WARC-Target-URI: {_safe(url, page_id)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}",
                 f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("x-page-id"), "url": fields["warc-target-uri"], "record_type": fields["warc-type"],
            "refers_to": number("x-refers-to-page-id"), "payload_bytes": size, "payload_digest": digest,
            "payload": payload if fields["warc-type"] == "response" else None}


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and, where an equal payload of at least
    ``min_bytes`` has a smaller page_id, that id as ``refers_to``."""
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")) \
        .withColumn("key", F.sha2(F.col("payload").cast("binary"), 256))
    first = keyed.where(F.octet_length("payload") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("first"))
    return keyed.join(first, "key", "left").select(
        "page_id", "url", "payload",
        F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, uri: str, max_bytes: int = 256 << 20, date: str = "2024-01-01T00:00:00Z",
                   level: int = 6) -> DataFrame:
    """Write ``records`` (see :func:`mark_revisits`) below ``uri``; the index."""
    text_batches(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, path = open_folder(uri)
        folder.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4))):
                page_id, url, refers_to, payload = page_id.as_py(), url.as_py(), refers_to.as_py(), payload.as_py().encode()
                if out is None or at >= max_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{path}/{uuid.uuid4().hex}.warc.gz", 0
                    out = folder.open_output_stream(name, compression=None)
                digest = sha1_base32(payload)
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = member.compress(format_record(page_id, url, payload, digest, refers_to, refers_to is not None, date))
                data += member.flush()
                out.write(data)
                rows.append((page_id, name.rpartition("/")[2], at, len(data), _safe(url, page_id), digest,
                             "response" if refers_to is None else "revisit", refers_to))
                at += len(data)
            if rows:
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                 names=[x.split()[0] for x in INDEX_SCHEMA.split(", ")])
        if out is not None:
            out.close()

    return stage(records.select("page_id", "url", "payload", "refers_to").mapInArrow(write, INDEX_SCHEMA), "warc-index")


def read_archives(selected: DataFrame, uri: str, with_payload: bool = True, gap: int = 64 << 10,
                  most: int = 8 << 20, stripe: int = 16 << 20) -> DataFrame:
    """The records of the selected index rows: ranges at most ``gap`` bytes
    apart become one read of at most ``most`` bytes (or of one record)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder, path = open_folder(uri)
        file, opened = None, None
        for b in batches:
            rows = list(zip(b["archive"], b["offset"].tolist(), b["length"].tolist()))
            i = 0
            while i < len(rows):
                name, start, length = rows[i]
                stop, j = start + length, i + 1
                while j < len(rows) and rows[j][0] == name and rows[j][1] - stop <= gap and rows[j][1] + rows[j][2] - start <= most:
                    stop, j = max(stop, rows[j][1] + rows[j][2]), j + 1
                if opened != name:
                    if file is not None:
                        file.close()
                    file, opened = folder.open_input_file(f"{path}/{name}"), name
                data = file.read_at(stop - start, start)
                found = [parse_record(zlib.decompress(data[o - start:o - start + n], 31)) for _, o, n in rows[i:j]]
                frame = pd.DataFrame(found, columns=[x.split()[0] for x in READ_SCHEMA.split(", ")])
                for c in ("page_id", "refers_to"):
                    frame[c] = frame[c].astype("Int64")
                if not with_payload:
                    frame["payload"] = None
                yield frame
                i = j
        if file is not None:
            file.close()

    total = selected.agg(F.sum("length")).first()[0] or 0
    spark = selected.sparkSession
    return (selected.select("archive", "offset", "length", F.floor(F.col("offset") / stripe).alias("stripe"))
            .repartition(partitions_for(spark, total, stripe), "archive", "stripe")
            .sortWithinPartitions("archive", "offset").drop("stripe").mapInPandas(read, READ_SCHEMA))


def round_trip(pages: DataFrame, uri: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives and read every record back, without the
    payloads themselves."""
    uri = uri or shared_path(pages.sparkSession, "warc")
    return read_archives(write_archives(mark_revisits(pages, min_bytes), uri), uri, with_payload=False)
