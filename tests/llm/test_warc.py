import base64
import hashlib

import pytest

from tidemark.llm import warc
from tidemark.llm.common import materialize

SCHEMA = "page_id long, url string, html string, archive string"
ROWS = [
    (1, "http://a/\r\nx", "same", ""), (2, None, "same", ""), (3, "u", "other \r\n\r\n WARC/1.1\r\n", ""), (4, "u", None, ""), (5, "u", "", ""),
    (6, "u", "é" * 5000, ""), (7, "u", "é" * 5000, ""), (8, "u", "\r\n\r\n" * 64, ""), (9, "u", "same", ""), (None, "u", "same", ""), (10, "u", "x", ""), (10, "u", "x", ""),
]


def want(rows, least):
    groups = {}
    for p, _, h, _ in rows:
        if p is not None:
            groups.setdefault((h or "").encode(), []).append(p)
    out = []
    for p, _, h, _ in rows:
        data = (h or "").encode()
        last = max(groups[data]) if data in groups else None
        revisit = len(data) >= least and p is not None and last != p
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((p, "revisit" if revisit else "response", len(data), digest, last if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk,least", [(1 << 20, 0), (7, 0), (64, 5)])
def test_round_trip(spark, tmp_path, chunk, least):
    archive = materialize(warc.write_archives(spark.createDataFrame(ROWS, SCHEMA), least, chunk), "test")
    got = warc.read_archives(archive)
    assert sorted((tuple(r) for r in got.drop("url").collect()), key=repr) == want(ROWS, least)
    assert warc.export(archive, str(tmp_path)) == archive.select("archive").distinct().count()
    payloads = []
    for file in sorted(tmp_path.glob("*.warc")):
        data = file.read_bytes()
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            assert head.startswith(b"WARC/1.1\r\n")
            n = int(head.rpartition(b"Content-Length: ")[2])
            block = data[:n]
            if b"WARC-Type: response" in head:
                http, block = block.split(b"\r\n\r\n", 1)
                assert b"application/http" in head and http.startswith(b"HTTP/1.1 200") and http.endswith(b"Content-Length: %d" % len(block))
            payloads.append((b"WARC-Type: response" in head, block))
            assert data[n : n + 4] == b"\r\n\r\n"
            data = data[n + 4 :]
    plain = sorted((r[1] == "response", r[2]) for r in want(ROWS, least))
    assert sorted((kind, len(p)) for kind, p in payloads if kind) == [x for x in plain if x[0]]


def test_damage_is_found(spark):
    archive = warc.write_archives(spark.createDataFrame(ROWS[:1], SCHEMA))
    broken = archive.selectExpr("archive", "record", "chunk", "chunks", "cast(replace(cast(data as string), 'same', 'sane') as binary) as data")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archives(broken).collect()


def test_payload_over_a_python_batch(spark):
    rows = [(i, "u", "x" * 12_000_000 + str(i % 2), "") for i in range(4)]
    archive = materialize(warc.write_archives(spark.createDataFrame(rows, SCHEMA), chunk_bytes=1 << 20), "test")
    assert archive.selectExpr("max(length(data))").first()[0] < (1 << 20) + 1000
    assert sorted((tuple(r) for r in warc.read_archives(archive).drop("url").collect()), key=repr) == want(rows, 0)


def test_empty(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], SCHEMA))).count() == 0
