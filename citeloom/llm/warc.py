"""WARC archives: written with an index, read back by coalesced byte ranges.

The index comes first: file, offset and length of each record, URL and payload
digest.  Any reader selects index rows, and a task turns the sorted ranges of a
file into few reads, whose records it parses.  Records are members of their own
in gzip, as is usual for WARC, so each can be read alone.

Of records with equal payloads the one with the smallest page id is the
``response``; the others are ``revisit`` records without a payload, naming it.
Each attempt of a task writes a file of its own name, and only files named in
the index, written with Spark's commit protocol, count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import mapped, safe, shared_dir, written
from citeloom.llm.files import coalesced, reader, writer

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Ranges with up to GAP bytes between them are one read of up to MOST bytes; a file ends after FILE bytes.
GAP, MOST, FILE, LEVEL = 1 << 16, 8 << 20, 256 << 20, 4
EPOCH = "1970-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _header_value(text: str | None) -> str:
    """A value for one header line: what could end it or isn't ASCII is percent-encoded."""
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text or "")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One uncompressed record, its end included; a revisit if it refers to a page."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Target-URI: {_header_value(url)}", f"WARC-Date: {EPOCH}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: {page_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Headers in lower case, the HTTP header's own as ``http``, and the payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("ascii").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
    block = rest[: int(headers["content-length"])]
    if version != VERSION or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"not a {VERSION} record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers | {"http": {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in http.decode("ascii").split("\r\n")[1:])}, "payload": payload}


def owners(pages: DataFrame, minimum: int = 0) -> DataFrame:
    """pages and refers_to: the smallest page id that has the row's payload, if that has ``minimum`` bytes; null for rows of that page.

    Only digests and ids are shuffled for it; payloads move once, by page id and
    digest, since rows of one page id may hold different payloads.
    """
    payload = F.coalesce("html", F.lit(""))
    known = pages.withColumn("digest", F.sha1(F.encode(payload, "UTF-8")))
    small = written(known.filter("page_id is not null").select("page_id", "digest", F.octet_length(payload).alias("size")))
    first = small.filter(F.col("size") >= minimum).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    revisits = small.join(first, "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    return known.join(written(revisits), ["page_id", "digest"], "left").drop("digest")


def _writing(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, at, rows = None, "", 0, []
        names = ["path", "offset", "length", "page_id", "url", "digest"]

        def done() -> Iterator[pa.RecordBatch]:
            if out:
                out.close()  # the index follows the whole file
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)], names=names)

        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    path, at, rows = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, []
                    out = writer(path)
                payload = (html or "").encode()
                digest = base32_sha1(payload)
                gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = gz.compress(record(page_id, url, payload, digest, refers_to)) + gz.flush()
                out.write(member)
                rows.append((path, at, len(member), page_id, url, digest))
                at += len(member)
                if at >= FILE:
                    yield from done()
                    out = None
        yield from done()

    return run


def write_archives(pages: DataFrame, minimum: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes every row as a record and returns the index: path, offset, length, page_id, url, digest.

    Null html is an empty payload, a null URL an empty one.  A row with a null
    id is a response and nothing refers to it.  Every row is one record: rows
    that repeat the smallest id of a payload are all responses, and rows of one
    id with different payloads are judged each by its own.  An empty table
    writes no file.  Ids are integers; other columns are ignored.
    """
    rows = safe(pages, id_col, url_col, html_col).toDF("page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    ready = owners(rows, minimum).select("page_id", "url", "html", "refers_to")
    return written(mapped(ready, _writing(shared_dir(pages.sparkSession)), "path string, offset long, length long, page_id long, url string, digest string"))


def _reading(gap: int, most: int):
    def of_file(path: str, ranges: list[tuple[int, int]]) -> Iterator[dict]:
        with reader(path) as f:
            for start, end, held in coalesced(ranges, gap, most):
                data = memoryview(f.read_at(end - start, start))
                for i in held:
                    lo = ranges[i][0] - start
                    yield parsed(zlib.decompress(data[lo : lo + ranges[i][1]], 31))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranges = list(zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True))
            lo = 0
            while lo < len(ranges):
                hi = lo
                while hi < len(ranges) and ranges[hi][0] == ranges[lo][0]:
                    hi += 1
                for part in range(lo, hi, 2000):
                    yield _digests(of_file(ranges[lo][0], [r[1:] for r in ranges[part : min(hi, part + 2000)]]))
                lo = hi

    return run


def _digests(records: Iterator[dict]) -> pa.RecordBatch:
    """A row for each record; no more than one payload is held."""
    out = []
    for r in records:
        revisit = r["warc-type"] == "revisit"
        stated = r["warc-payload-digest"].removeprefix("sha1:")
        digest = stated if revisit else base32_sha1(r["payload"])
        if digest != stated:
            raise ValueError(f"{r['warc-record-id']}: the payload doesn't have the stated digest")
        size = int(r["http"]["content-length"]) if revisit else len(r["payload"])
        own, other = (re.fullmatch("<urn:page:(.*)>", x)[1] if x else "" for x in (r["warc-record-id"], r.get("warc-refers-to")))
        out.append((int(own) if own else None, size, digest, r["warc-type"], int(other) if other else None))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    columns = zip(*out, strict=True) if out else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_selected(index: DataFrame, gap: int = GAP, most: int = MOST) -> DataFrame:
    """One row for each selected index row, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's digest and size are those stated in its record; a response's
    payload must have its stated digest.
    """
    ordered = index.select("path", "offset", "length").sortWithinPartitions("path", "offset")
    return mapped(ordered, _reading(gap, most), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
