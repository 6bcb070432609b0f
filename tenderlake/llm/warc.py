"""WARC archives: writing pages as records, and reading records back with segments put together.

Writing: a record holds an HTTP response with a chunked body. Of pages with equal payloads of at least ``least`` bytes the
one with the smallest id is the response and the others are revisits that name its record. Which is which is told from
ids and digests alone; payloads are dealt out once, by page. A block longer than ``segment`` bytes is cut: the first
segment is in the response record, the others in continuation records that name it as their origin. A record's name holds
the page id and a digest of url and payload, so it is known before the record is written. Records are rows of a text sink
whose line separator is the end of a record, so Spark writes the archives, in each
at most as many as have ARCHIVE bytes of blocks when all are of full length.

Reading: archive files are parsed by Spark tasks, one file at a time, record by record. Continuations are grouped by
origin, put in order of their segment numbers, checked (numbers without a gap, total length as the last says), joined, and
the chunked transfer framing is decoded. A record that fails a check has a text in ``problem`` and no payload. So
has one whose head, length or number can't be read, after which reading goes on at the next record that starts as one should,
and what is left of an archive that is cut off or whose compression is damaged.

Edge cases: null or empty html is an empty payload (always a response); null urls are written as urn:none and read back
as null; rows with a null page id are written and read back, and never are responses that others refer to; repeated rows
are written each (under one name) and read back each; payloads are written and read whole, whatever their length; no pages give no records; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, new_path, small_batches, tidy, written

LEAST = 100
SEGMENT = 32 << 10
CHUNK = 4 << 10
ARCHIVE = 256 << 20  # bytes of blocks in an archive, as a reader's task holds an archive at once
_END = "\r\n\r\n"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def _cut(data: bytes, size: int) -> list[bytes]:
    """Parts of about size bytes that end between characters of UTF-8."""
    out, at = [], 0
    while at < len(data):
        stop = min(at + size, len(data))
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop += 1
        out.append(data[at:stop])
        at = stop
    return out


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(part), part) for part in _cut(payload, size)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The data of a chunked body; ValueError if its framing is broken."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        digits = body[at:stop].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,16}", digits):
            raise ValueError("a chunk's size isn't a hexadecimal number")
        size = int(digits, 16)
        at = stop + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return f"WARC/1.1\r\n{head}\r\n{block.decode()}"


def _records(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            size = 0
            for k in range(batch.num_rows):
                name, url, html, digest, first = (batch.column(n)[k].as_py() for n in ("name", "url", "html", "digest", "first"))
                target = "urn:none" if url is None else re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02x}", url)
                fields = [("WARC-Record-ID", name), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if first is not None:
                    more = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", first)]
                    out.append(_record(more + fields, _HEAD))
                else:
                    block = _HEAD + chunked(html.encode())
                    parts = _cut(block, segment)
                    for i, part in enumerate(parts):
                        if len(parts) == 1:
                            own = [("WARC-Type", "response"), *fields]
                        elif not i:
                            own = [("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)]
                        else:
                            own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{i + 1}>"), *fields[1:3], ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", i + 1)]
                            if i == len(parts) - 1:
                                own.append(("WARC-Segment-Total-Length", len(block)))
                        out.append(_record(own, part))
                size += len(out[-1])
                if len(out) > 256 or size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return run


def write(pages: DataFrame, path: str | None = None, id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, segment: int = SEGMENT) -> str:
    """Write the archives (gzip) and return their folder."""
    path = path or new_path(small_batches(pages).sparkSession, "warc")
    with tidy():
        text = F.coalesce(F.col(html), F.lit(""))
        rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"), text.alias("html"), F.sha2(text, 256).alias("digest"))
        mark = F.substring(F.sha2(F.concat_ws(" ", "digest", "url"), 256), 1, 16)
        rows = rows.withColumn("name", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(":"), mark, F.lit(">")))
        ids = written(rows.where(F.octet_length("html") >= least).select("id", "digest", "name"), "page-ids")
        firsts = ids.where("id is not null").groupBy("digest").agg(F.min(F.struct("id", "name")).alias("least")).select("digest", F.col("least.id").alias("least_id"), F.col("least.name").alias("first"))
        # Both sides of this join and of the next are tables, so that Spark can split a page of which there are very many copies.
        revisits = ids.join(written(firsts, "firsts"), "digest").where(~F.col("id").eqNullSafe(F.col("least_id"))).select("name", "first")
        revisits = written(revisits.groupBy("name").agg(F.first("first").alias("first")), "revisits")
        known = rows.join(revisits, "name", "left")
        records = known.select("name", "url", F.when(F.col("first").isNull(), F.col("html")).alias("html"), "digest", "first").mapInArrow(frugal(_records(segment)), "value string")
        records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", max(1, ARCHIVE // segment)).text(path)
    return path


class _Reader:
    """Bytes of an archive, plain or gzip (members one after another), a part at a time."""

    def __init__(self, data: bytes):
        self.view, self.at, self.have = memoryview(data), 0, bytearray()
        self.gzip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None
        self.inside, self.problem = False, None

    def more(self) -> bool:
        if self.at >= len(self.view):
            return False
        part = self.view[self.at : self.at + (1 << 13)]  # little, as what a damaged part holds before the damage is lost
        self.at += len(part)
        if self.gzip is None:
            self.have += part
            return True
        try:
            while len(part):
                self.have += self.gzip.decompress(part)
                part = self.gzip.unused_data
                if self.gzip.eof:
                    self.gzip, self.inside = zlib.decompressobj(31), False
                else:
                    self.inside = True
        except zlib.error:
            self.problem, self.at = "archive's compression is damaged", len(self.view)
            return False
        if self.at >= len(self.view) and self.inside:
            self.problem = "archive is cut off"
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (k := self.have.find(mark, seen)) < 0:
            seen = max(0, len(self.have) - len(mark))
            if not self.more():
                return None
        out = bytes(self.have[:k])
        del self.have[: k + len(mark)]
        return out

    def resume(self) -> bool:
        """Go on at the next record that starts as one should."""
        if self.until(_END.encode() + b"WARC/") is None:
            return False
        self.have[:0] = b"WARC/"
        return True

    def take(self, n: int) -> bytes:
        while len(self.have) < n and self.more():
            pass
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


_FIELDS = ["type", "id", "target", "digest", "refers_to", "origin", "number", "total", "block", "short", "problem"]
_SCHEMA = "type string, id string, target string, digest string, refers_to string, origin string, number long, total long, block binary, short boolean, problem string"
_KINDS = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.string()]
_NAMES = ["warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to", "warc-segment-origin-id"]


def _read_archive(data: bytes) -> Iterator[list]:
    """The records of an archive, in the order of _FIELDS."""
    reader = _Reader(data)
    while (head := reader.until(b"\r\n\r\n")) is not None:
        lines = head.strip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        field = {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in lines[1:])}
        said = [field.get(n) for n in _NAMES]
        length, number, total = (field.get(n) for n in ("content-length", "warc-segment-number", "warc-segment-total-length"))
        fine = all(x is None or re.fullmatch("[0-9]{1,18}", x) for x in (length, number, total))
        if not lines[0].startswith("WARC/") or length is None or not fine:
            yield [*said, None, None, None, False, "head can't be read"]
            reader.have[:0] = b"\r\n\r\n"
            if not reader.resume():
                break
            continue
        block = reader.take(int(length))
        yield [*said, number and int(number), total and int(total), block, len(block) < int(length), None]
        reader.take(4)
    if reader.problem or reader.have.strip(b"\r\n"):
        yield [None] * 9 + [False, reader.problem or "archive is cut off"]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _FIELDS)

    for batch in batches:
        for k in range(batch.num_rows):
            rows, size = [], 0
            for row in _read_archive(batch.column(0)[k].as_py()):
                rows.append(row)
                size += len(row[8] or b"")
                if size > 1 << 22:
                    yield flush(rows)
                    rows, size = [], 0
            if rows:
                yield flush(rows)


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path, as they are in the files."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(frugal(_parse), _SCHEMA)


def whole(raw: DataFrame) -> DataFrame:
    """Response, revisit and other records with their segments joined: block, and problem where a check failed."""
    problem = F.coalesce("problem", F.when(F.col("short"), "block shorter than its length"))
    single = raw.where("problem is not null or origin is null and number is null").select("type", "id", "target", "digest", "refers_to", "block", problem.alias("problem"))
    cut = raw.where("problem is null and (origin is not null or number is not null)").withColumn("id", F.coalesce("origin", "id"))
    # Rows that were written twice have the same name: their segments are equal.
    fields = ["type", "target", "digest", "refers_to"]
    cut = cut.groupBy("id", "number").agg(*[F.max(F.when(F.col("origin").isNull(), F.col(c))).alias(c) for c in fields], F.max("total").alias("total"), F.first("block").alias("block"), F.max("short").alias("short"), F.count(F.lit(1)).alias("copies"))
    part = F.struct("number", F.decode("block", "ISO-8859-1").alias("bytes"), "short")
    of = cut.groupBy("id").agg(*[F.max(c).alias(c) for c in [*fields, "total", "copies"]], F.array_sort(F.collect_list(part)).alias("parts"))
    gap = F.exists(F.transform("parts", lambda x, i: F.coalesce(x["number"] != i + 1, F.lit(True)) | x["short"]), lambda x: x)
    of = of.withColumn("block", F.encode(F.array_join(F.transform("parts", lambda x: x["bytes"]), ""), "ISO-8859-1"))
    problem = F.when(F.col("type").isNull() | gap, "segment missing").when(F.coalesce(F.octet_length("block") != F.col("total"), F.lit(True)), "segments don't have the total length")
    of = of.withColumn("problem", problem).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return single.unionByName(of.select("type", "id", "target", "digest", "refers_to", "block", "problem"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_id, record_type, refers_to (a page id), refers_to_record, digest (of the header), payload,
    problem: a row a page."""

    @F.arrow_udf("struct<payload:binary,problem:string>")
    @frugal
    def payload(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for k in range(len(batch)):
                block = batch[k].as_py()
                try:
                    head, mark, body = (block or b"").partition(b"\r\n\r\n")
                    is_chunked = re.search(rb"(?im)^transfer-encoding:.*chunked", head)
                    out.append({"payload": dechunked(body) if is_chunked else body, "problem": None if mark else "no HTTP head"})
                except ValueError:
                    out.append({"payload": None, "problem": "chunked framing is broken"})
            yield pa.array(out, pa.struct([("payload", pa.binary()), ("problem", pa.string())]))

    rows = whole(records(spark, path))
    rows = rows.withColumn("got", payload(F.when(F.col("type") == "response", F.col("block"))))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:([^:>]*)', 1) as bigint)")
    response = F.col("type") == "response"
    plain = F.url_decode(F.regexp_replace("target", "\\+", "%2b"))
    return rows.select(
        number("id").alias("page_id"), F.when(F.col("target") != "urn:none", plain).alias("url"), F.col("type").alias("record_type"), F.when(~response, number("refers_to")).alias("refers_to"), F.col("id").alias("record_id"), F.when(~response, F.col("refers_to")).alias("refers_to_record"),
        F.regexp_replace("digest", "^sha256:", "").alias("digest"), F.when(response & F.col("problem").isNull(), F.col("got.payload")).alias("payload"), F.coalesce("problem", F.when(response, F.col("got.problem"))).alias("problem"),
    )


def resolved(pages: DataFrame) -> DataFrame:
    """Pages as read, with payload_bytes and payload_digest of the full payload: a revisit's are those of the page that it
    refers to. problem also tells of a digest that isn't the header's, and of a revisit without its response."""
    # Only what a revisit needs is joined: lengths and digests, not payloads. A response is complete as it is. Both sides of
    # the join are tables, so that Spark can split the revisits of one response.
    own = pages.select("page_id", "url", "record_id", "record_type", "refers_to", "refers_to_record", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "problem")
    own = written(own, "records")
    is_revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False)) & F.col("refers_to_record").isNotNull()
    of = own.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record")).agg(F.max(F.struct("payload_bytes", "payload_digest")).alias("of"))
    revisits = own.where(is_revisit).drop("payload_bytes", "payload_digest").join(written(of, "responses"), "refers_to_record", "left").withColumns({"payload_bytes": F.col("of.payload_bytes"), "payload_digest": F.col("of.payload_digest")})
    both = own.where(~is_revisit).unionByName(revisits.drop("of"))
    wrong = F.when(F.col("payload_digest").isNull(), "no payload").when(F.col("payload_digest") != F.col("digest"), "digest differs")
    return both.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", F.coalesce("problem", wrong).alias("problem"))
