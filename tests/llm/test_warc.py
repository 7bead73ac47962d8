import base64
import gzip
import hashlib
import io
import random
import string
import zlib

import pytest

from spoolglass.llm.common import fresh_path
from spoolglass.llm.warc import archive_round_trip, assemble, parse, read_records, unzipped, write_archives

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://a/x y", "<p>é\r\n\r\nWARC/1.1\r\n</p>"),
    (2, None, None),
    (3, "https://b/\n%20", ""),
    (4, "http://c", "same"),
    (5, "http://d", "same"),
    (5, "http://d", "same"),
    (5, "http://e", "same"),
    (None, "http://f", "same"),
    (None, None, "alone"),
    (6, "http://g", "z" * 300_000),
    (7, "http://g", "z" * 300_000),
    (8, "http://h", "twice"),
    (8, "http://h", "twice"),
]


def expected(rows, least=0):
    out, responses = [], {}
    for page, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        payload = (html or "").encode()
        kind = "response" if len(payload) < least or payload not in responses else "revisit"
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, responses[payload] if kind == "revisit" else None))
        responses.setdefault(payload, page)
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, PAGES).selectExpr("*", "1 AS sha", "2 AS key", "3 AS payload")
    found = archive_round_trip(pages, min_revisit_bytes=least)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, found.collect()), key=repr) == expected(ROWS, least)


def test_empty_table(spark):
    assert archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_transactions(spark):
    path = fresh_path(spark, "test-warc")
    write_archives(spark.createDataFrame(ROWS, PAGES), path)
    records = read_records(spark, path, keep_payload=True)
    kinds = {r.warc_type: r["count"] for r in records.groupBy("warc_type").count().collect()}
    assert kinds["request"] == kinds["metadata"] == kinds["response"] + kinds["revisit"] == len(ROWS)
    assert records.select("record_id").distinct().count() == 3 * len(ROWS)
    captures = assemble(records).collect()
    assert len(captures) == len(ROWS)
    assert all(r.request.record_id and len(r.metadata) == 1 for r in captures)
    payloads = {bytes(r.main.payload) for r in captures if r.main.warc_type == "response"}
    assert payloads == {(h or "").encode() for _, _, h in ROWS}


def test_assembly_of_incomplete_transactions(spark):
    ddl = "record_id string, warc_type string, concurrent_to string, target_uri string, refers_to string, page_id long, payload_bytes long, payload_digest string"
    rows = [("r", "response", None, "u", None, None, 3, "d"), ("m1", "metadata", "r", None, None, 1, None, None), ("m2", "metadata", "r", None, None, 2, None, None), ("v", "revisit", None, "u", "gone", None, None, "d"), ("q", "request", "nowhere", None, None, None, None, None)]
    found = {r.main.record_id: r for r in assemble(spark.createDataFrame(rows, ddl)).collect()}
    assert set(found) == {"r", "v"}
    assert [m.page_id for m in found["r"].metadata] == [1, 2] and found["r"].request is None
    assert found["v"].revisited is None and found["v"].metadata == []


def test_parser_reads_any_members_and_pieces():
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    for content in (one * 3, gzip.compress(one * 3), gzip.compress(one) * 3, (gzip.compress(one) + b"\0\0") * 3):
        for step in (1, 7, 1 << 20):
            pieces = unzipped(content, 5) if step > 7 else iter(lambda s=io.BytesIO(b"".join(unzipped(content))), k=step: s.read(k), b"")
            assert [b for _, b in parse(pieces)] == [b"ab\r\nc"] * 3
    with pytest.raises(ValueError):
        list(parse(iter([one[:-6]])))
    with pytest.raises(ValueError):
        list(parse(unzipped(gzip.compress(one)[:-3])))


def test_archives_are_bounded_and_a_member_holds_a_record(spark):
    path = fresh_path(spark, "test-bounded")
    r = random.Random(3)
    pages = [(i, f"http://h/{i}", "".join(r.choices(string.printable, k=5000 if i else 3_000_000))) for i in range(60)]
    write_archives(spark.createDataFrame(pages, PAGES), path, archive_bytes=50_000)
    files = [bytes(x.content) for x in spark.read.format("binaryFile").load(path).collect() if x.length]
    assert len(files) > 5 and sorted(map(len, files))[-2] < 60_000
    n = 0
    for content in files:
        assert gzip.decompress(content).count(b"WARC/1.1\r\n") >= 3
        while content.strip(b"\0"):
            packed = zlib.decompressobj(31)
            raw = packed.decompress(content)
            assert raw.startswith(b"WARC/1.1\r\n") and len(list(parse(iter([raw])))) == 1
            content, n = packed.unused_data, n + 1
    assert n == 180
    assert {x.page_id: x.payload_bytes for x in archive_round_trip(spark.createDataFrame(pages, PAGES)).collect()} == {i: len(h.encode()) for i, _, h in pages}
