import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tenderlake.llm import warc

ROWS = [
    (5, "http://a/ b?x=1%20+2", "é" * 80), (3, None, "é" * 80), (9, "u", "é" * 80), (4, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""),
    (10, "u", "日本語\r\n\r\nWARC/1.1\r\n0\r\n\r\n" * 9000), (None, "u", "é" * 80), (11, "u\r\nX: y", "b" * 100), (12, "u", "c" * 99), (13, "u", "c" * 99), (14, "u", "d" * 200), (14, "u", "d" * 200),
    (15, "u", "ü" * 50_000), (15, "u", "ü" * 50_000), (15, "v", "ü" * 50_000), (16, "u", "ü" * 50_000), (None, "w", "ü" * 50_000), (None, None, "only here" * 20),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, digest int")
    path = warc.write(df)
    raw = warc.records(spark, path)
    assert raw.where("type = 'continuation'").count() > 5
    read = warc.read(spark, path).cache()
    assert read.where("problem is not null").count() == 0
    named = {r["record_id"] for r in read.where("record_type = 'response'").collect()}
    again = [r["refers_to_record"] for r in read.where("record_type = 'revisit'").collect()]
    assert len(again) == 5 and set(again) <= named
    html = {r["page_id"]: (r["url"], bytes(r["payload"])) for r in read.where("record_type = 'response'").collect()}
    assert html[10] == ("u", ROWS[7][2].encode()) and html[7][1] == b"" and html[11][0] == "u\r\nX: y" and html[3][0] is None
    out = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["problem"]) for r in warc.resolved(read).collect()), key=str)
    want = []
    for page, _, text in ROWS:
        data = (text or "").encode()
        first = min((p for p, _, t in ROWS if t == text and p is not None), default=None)
        again = len(data) >= 100 and page != first
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None, None))
    assert out == sorted(want, key=str)
    assert warc.resolved(warc.read(spark, warc.write(df.limit(0)))).count() == 0


def test_missing_segments_and_broken_frames_are_told(spark, tmp_path):
    raw = spark.createDataFrame([("response", "<a>", 1, None, None), ("continuation", "<a:3>", 3, "<a>", 9)], "type string, id string, number long, origin string, total long")
    raw = raw.select("type", "id", F.lit("t").alias("target"), F.lit("d").alias("digest"), F.lit(None).cast("string").alias("refers_to"), "origin", "number", "total", F.encode(F.lit("abc"), "utf-8").alias("block"), F.lit(False).alias("short"), F.lit(None).cast("string").alias("problem"))
    assert [r["problem"] for r in warc.whole(raw).collect()] == ["segment missing"]
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:0>\r\nContent-Length: 44\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record + b"HTTP/1.1 200 OK\r\n\r\nhello"))
    assert [r["problem"] for r in warc.read(spark, str(tmp_path)).collect()] == ["block shorter than its length"]


def _plain(n, payload=b"hello"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d:0>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (n, len(block), block)


@pytest.mark.parametrize("size", [b"-6", b"+3", b"0x3", b"", b"g", b" ", b"1_0", b"f" * 40])
def test_sizes_that_are_no_numbers(size):
    with pytest.raises(ValueError):
        warc.dechunked(b"1\r\na\r\n" + size + b"\r\nabc\r\n0\r\n\r\n")


def test_what_cannot_be_read_is_told_and_good_records_are_read(spark, tmp_path):
    bad = _plain(2).replace(b"Content-Length: 24", b"Content-Length: x")
    files = {
        "length": _plain(1) + bad + _plain(3), "none": _plain(4) + _plain(5).replace(b"Content-Length: 24\r\n", b"") + _plain(6), "negative": _plain(7).replace(b": 24", b": -24") + _plain(8),
        "number": _plain(9).replace(b"Content-Length", b"WARC-Segment-Number: one\r\nContent-Length") + _plain(10), "head": b"junk\r\n\r\n" + _plain(11), "cut": _plain(12) + _plain(13)[:40], "empty": b"",
        "members.gz": gzip.compress(_plain(14)) + gzip.compress(_plain(15)),
    }
    damaged = bytearray(gzip.compress(b"".join(_plain(100 + i, bytes(str(i * i), "ascii") * 200) for i in range(3000)), 1))
    damaged[len(damaged) // 2 : len(damaged) // 2 + 40] = b"\xff" * 40
    files |= {"damaged.gz": bytes(damaged), "ends.gz": gzip.compress(_plain(20) + _plain(21, b"x" * 100))[:-30]}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = warc.read(spark, str(tmp_path)).collect()
    good = {r["page_id"] for r in rows if r["problem"] is None}
    assert {1, 3, 4, 6, 8, 10, 11, 12, 14, 15} <= good and not good & {2, 5, 7, 9, 13} and 100 in good
    told = sorted(r["problem"] for r in rows if r["problem"])
    assert told.count("head can't be read") == 5 and "archive's compression is damaged" in told and "archive is cut off" in told
    assert warc.resolved(warc.read(spark, str(tmp_path))).count() == len(rows)
