"""WARC archives with revisit resolution.

Archives are rows (archive, content) of a Parquet table in the cluster's shared folder; `content` is a plain WARC/1.1 file
of at most about `archive_bytes`, which any reader of the format takes. `deduplicate` reads the records' headers, brings
them together by payload digest, keeps one response per payload of `least_bytes` or more (that with the largest page id)
and writes new archives with fresh headers, in which the others are revisit records without payload. `resolve` joins
revisits to their responses and checks the digests.

Of a digest that very many records have, only a partial maximum of each task is shuffled, and the join back can be split.
A null payload is empty, a null url is named by the page id. Empty and small payloads are all responses. Rows of one page id
and equal payload count alike (all responses, if that id is the largest). Rows without an id are dropped, extra columns
ignored. An empty table gives no archive and an empty table.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm._common import lean, sized, stored

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"

_ARCHIVE = "archive string, content binary"
_HEADER = "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, http binary, payload binary"


def record(page_id: int, uri: str | None, payload: bytes, digest: str, refers_to: int | None, made: str = DATE) -> bytes:
    """One record: a response with its payload, or a revisit of another page's."""
    uri = " ".join((uri or f"urn:page:{page_id}").split()) or f"urn:page:{page_id}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    kind = "revisit" if revisit else "response"
    name = lambda i, k: uuid.uuid5(uuid.NAMESPACE_URL, f"{k}:{i}:{digest}")
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name(page_id, kind)}>"), ("WARC-Date", made), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("X-Page-Id", str(page_id))]
    if revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{name(refers_to, 'response')}>"), ("X-Refers-To-Page-Id", str(refers_to))]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def records(data: bytes):
    """(headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {}
        for line in lines:
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut")
        yield head, block
        at = end + 8 + n


def _write(archive_bytes: int):
    def run(batches):
        prefix, parts, size, n = uuid.uuid4().hex, [], 0, 0

        def flush():
            nonlocal parts, size, n
            out = pa.RecordBatch.from_arrays([pa.array([f"{prefix}-{n:05d}.warc"]), pa.array([b"".join(parts)], pa.binary())], names=["archive", "content"])
            parts, size, n = [], 0, n + 1
            return out

        for batch in batches:
            ids, uris, refers = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for i, page in enumerate(ids):
                payload = batch.column(2)[i].as_py() or b""
                parts.append(record(page, uris[i], payload, hashlib.sha1(payload).hexdigest(), refers[i]))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield flush()
        if parts:
            yield flush()

    return run


def write_archives(pages: DataFrame, archive_bytes: int = 4 << 20) -> DataFrame:
    """pages: page_id, uri, payload, refers_to (null: a response)."""
    return stored(pages.select("page_id", "uri", "payload", "refers_to").mapInArrow(lean(_write(archive_bytes)), _ARCHIVE), "warc", compression="zstd")


def _read(payloads: bool):
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in records(content.as_py()):
                    cut = block.index(b"\r\n\r\n") + 4
                    http, payload = block[:cut], block[cut:]
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    revisit = head["warc-type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"page {head['x-page-id']}: the payload is not that of its digest")
                    refers = head.get("x-refers-to-page-id")
                    rows.append((int(head["x-page-id"]), head["warc-target-uri"], head["warc-type"], None if revisit else len(payload), digest, refers and int(refers), http, payload if payloads else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in _HEADER.split(", ")])

    return run


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record; payload_bytes is null for revisits until they are resolved."""
    return archives.select("content").mapInArrow(lean(_read(payloads)), _HEADER)


def deduplicate(archives: DataFrame, least_bytes: int = 1000, archive_bytes: int = 4 << 20) -> DataFrame:
    """New archives, in which equal payloads of at least least_bytes are stored once."""
    heads = read_archives(archives).where(F.col("payload_bytes") >= least_bytes).select("page_id", "payload_digest")
    heads = stored(heads, "warc-heads")
    best = heads.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    best = stored(best, "warc-best")
    known = heads.join(sized(best), "payload_digest").where("page_id != refers_to").select("page_id", "payload_digest", "refers_to").distinct()
    known = stored(known, "warc-revisits")
    rows = read_archives(archives, payloads=True).select("page_id", "uri", "payload", "payload_digest")
    rows = rows.join(sized(known), ["page_id", "payload_digest"], "left")
    return write_archives(rows, archive_bytes)


def resolve(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, uri): revisits with the length of their response's payload."""
    rows = stored(read_archives(archives).drop("http", "payload"), "warc-rows")
    asked = rows.where("refers_to is not null").select(F.col("refers_to").alias("page_id")).distinct()
    here = rows.where("record_type = 'response'").drop("refers_to").join(stored(asked, "warc-asked"), "page_id", "left_semi")
    here = stored(here.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("n")).distinct(), "warc-here")
    both = rows.join(sized(here), ["refers_to", "payload_digest"], "left")
    return both.select("page_id", F.coalesce("payload_bytes", "n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "uri")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a response for each page, deduplicate the archives, and read back what the new ones hold."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("uri"), F.col(html_col).cast("binary").alias("payload"), F.lit(None).cast("long").alias("refers_to")).where("page_id is not null")
    return resolve(deduplicate(write_archives(rows)))
