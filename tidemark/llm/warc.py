"""WARC archives as a chunked record table.

An archive is a table (archive, record, chunk, chunks, data): a record's chunks, in order, are the
bytes of a WARC 1.1 record, and an archive's records, in order, those of a .warc file. A response's
block is an HTTP response, as its readers expect. Chunk 0 holds the headers and the payload's first
chunk_bytes, each later chunk as much again, so the reader holds one chunk and a running digest however long a record is. Records of one chunk are
read where they lie; only the chunks of longer ones are brought together by a shuffle.
``export`` puts the bytes of archives into files.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column, materialize, only

END = b"\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_text(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, sha1, payload_bytes, payload_digest) of each page's whole html; null is empty."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            html = [x or b"" for x in column(batch, "html")]
            sums = [hashlib.sha1(x) for x in html]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x.hexdigest() for x in sums], pa.string()),
                    pa.array([len(x) for x in html], pa.int64()),
                    pa.array([digest_text(x) for x in sums], pa.string()),
                ],
                ["page_id", "sha1", "payload_bytes", "payload_digest"],
            )

    return only(pages, "page_id", "html").mapInArrow(
        run, "page_id long, sha1 string, payload_bytes long, payload_digest string"
    )


def plan_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """digests() and refers_to: the largest page_id of an equal payload, null for responses.

    Payloads under min_revisit_bytes are all responses, and so are rows without a page_id.
    """
    each = materialize(digests(pages), "digests")
    again = F.col("payload_bytes") >= min_revisit_bytes
    groups = each.where(again).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1 and last is not null"), "payloads").select("payload_digest", F.col("payload_bytes").alias("__n"), "last")
    both = each.join(groups, "payload_digest", "left")
    refers = F.when(again & (F.col("__n") == F.col("payload_bytes")) & (F.col("last") != F.col("page_id")), F.col("last"))
    return both.select("page_id", "sha1", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def _line(name: str, value) -> bytes:
    text = str(value).replace("\r", " ").replace("\n", " ")
    return f"{name}: {text}\r\n".encode()


def http_header(n_bytes: int) -> bytes:
    """The head of the HTTP response that a response record's block is."""
    return b"HTTP/1.1 200 OK\r\n" + _line("Content-Type", "text/html; charset=utf-8") + _line("Content-Length", n_bytes) + b"\r\n"


def header(page_id, url, n_bytes: int, digest: str, refers_to) -> bytes:
    """The headers of a record, their blank lines included: its own, and for a response HTTP's."""
    revisit = refers_to is not None
    http = b"" if revisit else http_header(n_bytes)
    out = b"WARC/1.1\r\n" + _line("WARC-Type", "revisit" if revisit else "response")
    out += _line("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>") + _line("WARC-Date", DATE)
    if url is not None:
        out += _line("WARC-Target-URI", url)
    out += _line("WARC-Payload-Digest", f"sha1:{digest}") + _line("X-Payload-Bytes", n_bytes)
    if revisit:
        out += _line("WARC-Profile", PROFILE) + _line("WARC-Refers-To", f"<urn:page:{refers_to}>")
    else:
        out += _line("Content-Type", "application/http; msgtype=response")
    return out + _line("Content-Length", 0 if revisit else len(http) + n_bytes) + b"\r\n" + http


def pieces(head: bytes, payload: bytes, chunk_bytes: int) -> Iterator[bytes]:
    """A record's chunks; their concatenation is the record."""
    view = memoryview(payload)
    last = max(0, len(payload) - 1) // chunk_bytes
    for n in range(last + 1):
        yield (head if n == 0 else b"") + bytes(view[n * chunk_bytes : (n + 1) * chunk_bytes]) + (END if n == last else b"")


ARCHIVE = "archive int, record long, chunk int, chunks int, data binary"


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0, chunk_bytes: int = 1 << 20, archives: int = 64) -> DataFrame:
    """The archive table of pages (page_id, url, html): one record per row.

    Null html is an empty payload, a null url leaves its header out. Rows with one page_id give
    records of one WARC-Record-ID. Records are numbered within a partition of the table.
    """
    again = plan_records(pages, min_revisit_bytes).where("refers_to is not null")
    again = again.groupBy("page_id", "sha1").agg(F.max("refers_to").alias("refers_to")).toDF("__p", "__h", "refers_to")
    rows = only(pages, "page_id", "url", "html")
    same = (rows.page_id == again["__p"]) & (F.sha1(F.coalesce(rows.html, F.lit(""))) == again["__h"])
    rows = rows.join(again, same, "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[tuple] = []
            held = 0
            cells = (column(batch, c) for c in ("page_id", "url", "html", "refers_to"))
            for page, url, html, refers in zip(*cells, strict=True):
                html = html or b""
                head = header(page, url and url.decode(), len(html), digest_text(hashlib.sha1(html)), refers)
                body = b"" if refers is not None else html
                chunks = 1 + max(0, len(body) - 1) // chunk_bytes
                for c, data in enumerate(pieces(head, body, chunk_bytes)):
                    out.append((part % archives, (part << 32) + n, c, chunks, data))
                    held += len(data)
                    if held > 8 << 20:
                        yield _table(out, ARCHIVE_TYPES)
                        out, held = [], 0
                n += 1
            if out:
                yield _table(out, ARCHIVE_TYPES)

    return rows.mapInArrow(run, ARCHIVE)


def _table(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))


ARCHIVE_TYPES = {"archive": pa.int32(), "record": pa.int64(), "chunk": pa.int32(), "chunks": pa.int32(), "data": pa.binary()}
RECORD_TYPES = {
    "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(),
    "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(),
}
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


class _Reader:
    """One record at a time: headers from chunk 0, then a running length and digest."""

    def __init__(self) -> None:
        self.record = None

    def start(self, record: int, data: bytes) -> None:
        head, end, rest = data.partition(END)
        if not end or not head.startswith(b"WARC/1."):
            raise ValueError(f"record {record}: no header block")
        self.record, self.sha1, self.tail = record, hashlib.sha1(), b""
        self.fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        size = int(self.fields["Content-Length"])
        if self.fields["WARC-Type"] == "response":
            http, end, rest = rest.partition(END)
            if not end or not http.startswith(b"HTTP/"):
                raise ValueError(f"record {record}: no HTTP header")
            size -= len(http) + len(end)
        self.left = self.length = size
        self.more(rest)

    def more(self, data: bytes) -> None:
        body = data[: self.left]
        self.sha1.update(body)
        self.left -= len(body)
        self.tail += data[len(body) :]

    def finish(self) -> tuple:
        f = self.fields
        if self.left or self.tail != END:
            raise ValueError(f"record {self.record}: it is cut off")
        revisit = f["WARC-Type"] == "revisit"
        told = f["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and (digest_text(self.sha1) != told or self.length != int(f["X-Payload-Bytes"])):
            raise ValueError(f"record {self.record}: its payload differs from its digest")
        number = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
        return (number(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), f["WARC-Type"], int(f["X-Payload-Bytes"]), told, number(f.get("WARC-Refers-To")))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over (record, chunk, data) with each record's chunks in order."""
    now = _Reader()
    for batch in batches:
        done = []
        for record, chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if chunk == 0:
                if now.record is not None:
                    done.append(now.finish())
                now.start(record, data.as_py())
            else:
                now.more(data.as_py())
        if done:
            yield _table(done, RECORD_TYPES)
    if now.record is not None:
        yield _table([now.finish()], RECORD_TYPES)


def read_archives(archive: DataFrame) -> DataFrame:
    """One row per record of an archive table; a payload that fails its length or digest raises."""
    parts = archive.select("record", "chunk", "data", "chunks")
    short = parts.where("chunks = 1").drop("chunks")
    long = parts.where("chunks > 1").drop("chunks").repartition("record").sortWithinPartitions("record", "chunk")
    return short.mapInArrow(_read, RECORDS).union(long.mapInArrow(_read, RECORDS))


def export(archive: DataFrame, folder: str) -> int:
    """Write each archive as folder/NNNNN.warc, a folder all executors share; gives their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name, n = None, None, 0
        for batch in batches:
            for a, data in zip(batch.column(0).to_pylist(), batch.column(4), strict=True):
                if a != name:
                    if file:
                        file.close()
                    file, name, n = open(f"{folder}/{a:05d}.warc", "wb"), a, n + 1  # noqa: SIM115
                file.write(data.as_py())
        if file:
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array(np.array([n], dtype=np.int64))], ["n"])

    ordered = archive.repartition("archive").sortWithinPartitions("archive", "record", "chunk")
    return int(ordered.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0)
