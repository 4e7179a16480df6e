"""Operator 6: WARC archives with their index, and range reads of selected records.

Writing tasks append gzip members, one for each record, to archives of their own and give
back the index rows (path, offset, length, page, URL, digest).  The index is a table that
Spark commits: an archive of a lost or repeated attempt is named nowhere in it.  Reading
starts from the index: rows are range-sorted by path and offset, neighbours are merged into
one read, and each record is checked against its digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscape.session import scratch_path, stored

ROLL_BYTES = 256 << 20   # an archive is closed beyond this
GAP_BYTES = 64 << 10     # ranges this close are read at once
READ_BYTES = 8 << 20     # and no read is longer, unless one record is

INDEX = ("path string, offset long, length long, page_id long, url string, payload_digest string, "
         "payload_bytes long, record_type string, refers_to long")
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}|{digest}'.encode()).hexdigest())}>"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, refers_url, date: str) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit without its body."""
    clean = (lambda x: x.replace("\r", "%0D").replace("\n", "%0A"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {clean(refers_url)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields of a record (lower-case names) and its payload."""
    top, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in top.decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        fields[name.lower()] = value
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _writer(root: str, date: str, level: int):
    def run(parts):
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        out, path, offset = None, None, 0
        try:
            for batch in parts:
                rows = []
                for r in batch.to_pylist():
                    if out is None or offset >= ROLL_BYTES:
                        if out is not None:
                            out.close()
                        name = f"part-{task.partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                        out, path, offset = store.open_output_stream(f"{folder}/{name}", compression=None), f"{root}/{name}", 0
                    payload = (r["html"] or "").encode()
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    refers = r["first"] if r["first"] is not None and r["first"] != r["page_id"] else None
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(record_bytes(
                        r["page_id"], r["url"], payload, digest, refers, r["first_url"], date)) + packer.flush()
                    out.write(member)
                    rows.append((path, offset, len(member), r["page_id"], r["url"], digest, len(payload),
                                 "response" if refers is None else "revisit", refers))
                    offset += len(member)
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
        finally:
            if out is not None:
                out.close()
    return run


def write_archives(pages: DataFrame, root: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Write one record per row of pages (page_id, url, html) under root; returns the stored index.

    The payload is the html in UTF-8, empty for NULL.  Of records with equal payloads of at
    least `least` bytes the one with the smallest page_id is a response (all of them, should
    the id repeat) and the others are revisits of it; smaller payloads are all responses.  A
    NULL page_id is never the smallest: such a row is a revisit if any row with an id has its
    payload, else a response.  Line breaks in a URL are percent-encoded.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = rows.withColumns({"sha": F.sha1(body), "bytes": F.length(body)})
    first = rows.where(F.col("bytes") >= least).groupBy("sha").agg(
        F.min("page_id").alias("first"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("head"),
        F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first", F.col("head.url").alias("first_url"))
    joined = rows.join(stored(first, "first"), "sha", "left").select("page_id", "url", "html", "first", "first_url")
    return stored(joined.mapInArrow(_writer(root, date, level), INDEX), "index")


def ranges(spans: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Merge sorted (offset, length) spans: (from span, to span, start, end) of each read."""
    out = []
    for i, (offset, length) in enumerate(spans):
        if out and offset - out[-1][3] <= GAP_BYTES and offset + length - out[-1][2] <= READ_BYTES:
            a, _, start, end = out[-1]
            out[-1] = (a, i + 1, start, max(end, offset + length))
        else:
            out.append((i, i + 1, offset, offset + length))
    return out


def _reader(with_payload: bool):
    def run(parts):
        from itertools import groupby

        from pyarrow import fs

        for batch in parts:
            index = sorted(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for path, group in groupby(index, key=lambda x: x[0]):
                store, name = fs.FileSystem.from_uri(path)
                spans = [(o, n) for _, o, n in group]
                with store.open_input_file(name) as file:
                    for a, b, start, end in ranges(spans):
                        data = file.read_at(end - start, start)
                        rows = []
                        for offset, length in spans[a:b]:
                            f, payload = parsed(zlib.decompress(data[offset - start : offset - start + length], 31))
                            digest, kind = f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"]
                            if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"{path} at {offset}: the payload does not have its digest")
                            page, refers = f.get("x-page-id"), f.get("x-refers-to-page")
                            rows.append((None if page is None else int(page), f.get("warc-target-uri"), int(f["x-payload-length"]),
                                         digest, kind, None if refers is None else int(refers), payload.decode() if kind == "response" else None))
                        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                        names = [x.split()[0] for x in RECORD.split(", ")] + ["html"]
                        n = len(names) if with_payload else len(names) - 1
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(n)], names=names[:n])
    return run


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read the records that the index rows name (path, offset, length): one row each, in any order.

    Columns as RECORD says, and html for responses if asked for; a revisit has no body of
    its own, so its html is NULL.  No index rows, no result rows.
    """
    spans = index.select("path", "offset", "length").repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    return spans.mapInArrow(_reader(with_payload), RECORD + (", html string" if with_payload else ""))


def archive_folder(spark) -> str:
    """A fresh folder for archives next to the checkpoints."""
    return scratch_path(spark, "warc")
