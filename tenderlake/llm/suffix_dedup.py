"""Removal of repeated substrings by suffix arrays, built shard by shard with the difference-cover algorithm.

A byte goes if a ``width``-byte string that covers it also starts earlier (in a document of smaller id, or earlier in the
same one). Sorting all suffixes of a corpus in one array would move each byte many times, so content says which suffixes
can meet at all:

1. Anchors: of the 32-byte grams in each width-byte string the one with the smallest hash is an anchor. Equal strings have
   the same anchor, so only anchors that occur twice matter. The context of an anchor is all text that a string through
   it can cover.
2. Contexts that are equal throughout need no sorting: all but the first are repeats.
3. The first occurrences of different contexts that share an anchor are shuffled by anchor. Each task sorts the suffixes
   of its shards with the difference-cover algorithm modulo 3 (sort sampled triples, recurse on their names, merge the
   remaining suffixes) and compares neighbours' prefixes of width bytes.
4. An anchor with very many contexts (more than CROWD) is split: strings through it that begin far before it share a
   longer gram that reaches left, the others one that reaches right. Both halves become shards of their own, and contexts
   that have become equal fold into one. At the last split a shard is a single string. So no group has to fit in a task.

Which contexts matter is told to the tasks by bitmaps of a fixed size; where more rows than a bitmap can stand for have to
be told apart (from some gigabytes of repeated text on), their places are joined to the texts instead.

Edge cases: null text counts as empty; texts shorter than width stay; texts are taken whole; rows with a null id take no
part and stay as they are; rows of the same id and text count as one document and get the same result; rows of the same
id with different texts are documents of their own, in an order given by a hash of the text; no rows give none; columns of
the result's names are replaced, other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, free_name, frugal, small_batches, tidy, written
from .pretokens import _mix

WIDTH = 100
GRAM = 32
CROWD = 4096  # contexts of one anchor that a task sorts together, fewer for a large width
SHARD = 1 << 16  # bytes sorted in one suffix array, unless one anchor has more: arrays of this size stay in the cache
SLICE = 1 << 18
FILTER_BITS = 27
FILL = 8  # a bitmap has at least so many bits for each row that it stands for


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers below 2**21 by the difference-cover algorithm modulo 3 (at most 2**21 of them)."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 4, np.uint64)
    t[:n] = s
    b21, low = np.uint64(21), np.uint64((1 << 21) - 1)
    # A sampled position n, where the first residue needs one, ends the triples of that residue with zeros.
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    ones, number = len(range(1, n + (n % 3 == 1), 3)), np.arange(len(sample), dtype=np.uint64)
    wide, places = int(t.max()).bit_length(), len(sample).bit_length()
    if 3 * wide + places <= 64:  # the place fits beside the triple, and sorting values is faster than sorting places
        shift, wide = np.uint64(places), np.uint64(wide)
        triple = np.sort(((t[sample] << wide | t[sample + 1]) << wide | t[sample + 2]) << shift | number)
        order = (triple & np.uint64((1 << places) - 1)).astype(np.int64)
        ordered = triple >> shift
    else:
        triple = t[sample] << np.uint64(42) | t[sample + 1] << b21 | t[sample + 2]
        order = np.argsort(triple)
        ordered = triple[order]
    new = np.ones(len(sample), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    names = np.cumsum(new)
    if names[-1] < len(sample):
        name = np.empty(len(sample), np.int64)
        name[order] = names
        order = suffix_array(name)
    rank = np.zeros(n + 4, np.uint64)
    by_sample = sample[order]
    rank[by_sample] = number + np.uint64(1)
    is_one = order < ones
    one, two = by_sample[is_one], by_sample[~is_one]
    third = one - 1
    by_first = np.sort(t[third] << b21 | np.arange(len(third), dtype=np.uint64))
    third = third[(by_first & low).astype(np.int64)]
    if n % 3 == 1:
        by_sample, one = by_sample[by_sample < n], one[one < n]
    key1 = lambda p: t[p] << b21 | rank[p + 1]
    key2 = lambda p: t[p] << np.uint64(43) | t[p + 1] << np.uint64(22) | rank[p + 2]
    at = np.arange(len(third)) + np.searchsorted(key1(one), key1(third)) + np.searchsorted(key2(two), key2(third))
    out = np.empty(n, np.int64)
    rest = np.ones(n, bool)
    rest[at] = False
    out[at], out[rest] = third, by_sample
    return out


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    n, step = len(x) - width + 1, 1
    while 2 * step <= width:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[:n], x[width - step : width - step + n])


def anchors(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of width bytes or more: text number, place and hash of each anchor."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    h, step, factor = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    h = _mix(h)
    while step < GRAM:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor, step = factor * factor % (1 << 64), 2 * step
    h = _mix(h)
    h[h == np.iinfo(np.uint64).max] = 0
    ends = np.cumsum(sizes)
    for e in ends[:-1]:
        h[max(0, e - GRAM + 1) : e] = np.iinfo(np.uint64).max  # grams over the end of a text
    grams = width - GRAM + 1
    least = _sliding(h, grams, np.minimum)
    padded = np.concatenate([np.zeros(grams - 1, np.uint64), least, np.zeros(grams - 1, np.uint64)])
    at = np.flatnonzero((_sliding(padded, grams, np.maximum) == h) & (h != np.iinfo(np.uint64).max))
    text = np.searchsorted(ends, at, "right")
    return text, at - (ends - sizes)[text], h[at].view(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], width: int):
    """Columns id, tie, text and perhaps more: ids, ties, UTF-8 texts of width bytes or more, and what more there is, about
    SLICE bytes at once."""
    out, size = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            more = [part.column(i).to_pylist() for i in range(3, part.num_columns)]
            for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), *more, strict=True):
                if row[0] is not None and row[2] is not None and len(row[2]) >= width:
                    out.append(row)
                    size += len(row[2])
                    if size >= SLICE:
                        yield _columns(out)
                        out, size = [], 0
    if out:
        yield _columns(out)


def _columns(rows: list[tuple]):
    ids, ties, *rest = zip(*rows, strict=True)
    return np.array(ids, np.int64), np.array(ties, np.int64), *rest


def _bit(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + p.view(np.uint64) + np.uint64(1))
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _pick(docs: DataFrame, rows: DataFrame, columns: list[str], places: DataFrame | None = None):
    """docs to take contexts from and what says which: a broadcast bitmap of fixed size (16 MB) with a bit for each of the
    rows, which may let others through; or, for more rows than it can stand for, docs joined with the places themselves
    (id, tie, at) and nothing to broadcast. Either way no row is lost."""
    if rows.count() > (1 << FILTER_BITS) // FILL:
        of = (rows if places is None else places).groupBy("id", "tie").agg(F.collect_set("at").alias("places"))
        return docs.join(of, ["id", "tie"]).select("id", "tie", "text", "places"), None

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bit(*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
            word = np.unique(at >> 6)
            value = np.zeros(len(word), np.uint64)
            place = np.searchsorted(word, at >> 6)
            np.bitwise_or.at(value, place, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "bits"])

    words = rows.select(*columns).mapInArrow(frugal(bits), "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return docs, rows.sparkSession.sparkContext.broadcast(out)


def _in(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def _anchor_rows(width: int):
    """Every anchor with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ties, texts in _groups(batches, width):
            text, at, gram = anchors(texts, width)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(ids[text]), pa.array(ties[text]), pa.array(at)], ["gram", "id", "tie", "at"])

    return run


def _contexts(width: int, shared=None, first=None, with_bytes: bool = False):
    """Contexts of the anchors at the places that come with the texts, or of those that the bitmaps name: shared by their
    grams, first by their places. What comes out is the contexts' 128-bit hashes, or their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for ids, ties, texts, *places in _groups(batches, width):
            text, at, gram = anchors(texts, width)
            if places:
                known = np.concatenate([np.array(p, np.int64) + (k << 32) for k, p in enumerate(places[0])])
                some = np.isin((text << 32) + at, known)
            else:
                some = np.ones(len(at), bool)
            if shared is not None:
                some &= _in(shared.value, _bit(gram))
            if first is not None:
                some &= _in(first.value, _bit(ids[text], ties[text], at))
            text, at, gram = text[some], at[some], gram[some]
            left = np.maximum(at - (width - GRAM), 0)
            parts = [texts[t][a:b] for t, a, b in zip(text.tolist(), left.tolist(), (at + width).tolist(), strict=True)]
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            columns = [pa.array(gram), pa.array(ids[text]), pa.array(ties[text]), pa.array(at), pa.array(left), pa.array(size)]
            names = ["gram", "id", "tie", "at", "left", "size"]
            if with_bytes:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())], [*names, "bytes"])
            else:
                # The place of the anchor in its context belongs to what must be equal.
                digest = b"".join(xxhash.xxh3_128_digest(p, seed=a) for p, a in zip(parts, (at - left).tolist(), strict=True))
                both = np.frombuffer(digest, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(both[:, 0]), pa.array(both[:, 1])], [*names, "c1", "c2"])

    return run


def _repeats(width: int):
    """Removed runs (id, tie, start, stop) in the contexts of each gram: suffix arrays over shards of whole grams."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        ids, ties = np.array([r[1] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
        left = np.array([r[2] for r in rows], np.int64)
        size = np.array([len(r[3]) for r in rows], np.int64)
        text = np.frombuffer(b"\0".join(r[3] for r in rows) + b"\0", np.uint8)
        begin = np.cumsum(size + 1) - (size + 1)
        owner = np.repeat(np.arange(len(rows)), size + 1)
        symbols = text.astype(np.int64) + 2
        symbols[begin + size] = 1
        order = suffix_array(symbols)
        off = order - begin[owner[order]]
        order = order[off + width <= size[owner[order]]]  # only strings inside a context
        windows = np.lib.stride_tricks.sliding_window_view(text, width)
        same = np.zeros(len(order), bool)
        for k in range(1, len(order), 1 << 15):
            a, b = order[k - 1 : k - 1 + (1 << 15)], order[k : k + (1 << 15)]
            same[k : k + len(b)] = (windows[a[: len(b)]] == windows[b]).all(1)
        by_doc = np.lexsort((ties, ids))
        rank = np.empty(len(ids), np.int64)
        rank[by_doc] = np.cumsum(np.concatenate([[False], (ids[by_doc][1:] != ids[by_doc][:-1]) | (ties[by_doc][1:] != ties[by_doc][:-1])]))
        place = rank[owner[order]] << 40 | (left[owner[order]] + order - begin[owner[order]])
        start = np.flatnonzero(~same)
        least = np.repeat(np.minimum.reduceat(place, start), np.diff(start, append=len(order))) if len(order) else place
        gone = np.zeros(len(text) + 1, bool)
        gone[order[place != least]] = True
        edge = np.flatnonzero(gone[1:] & ~gone[:-1]) + 1
        first = np.concatenate([[0] if gone[0] else [], edge]).astype(np.int64)
        last = np.flatnonzero(gone[:-1] & ~gone[1:])
        of = owner[first]
        shift = left[of] - begin[of]
        return pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(ties[of]), pa.array(first + shift), pa.array(last + shift + width)], ["id", "tie", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "id", "left", "bytes", "tie")), strict=True):
                if size > SHARD and row[0] != last:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
                last = row[0]
        if rows:
            yield solve(rows)

    return run


def _halves(width: int):
    """Contexts (from before: most bytes before the anchor of a string's start, least: fewest) cut for the strings that
    start far before the anchor and for those that start near it; gram is the hash of what each half's strings share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            for id, tie, at, left, data, least, most in zip(*(batch.column(c).to_pylist() for c in ("id", "tie", "at", "left", "bytes", "least", "most")), strict=True):
                mid = (least + most) // 2
                for lo, hi in ((least, mid), (mid + 1, most)):
                    if lo > hi:
                        continue
                    a, b = max(left, at - hi), min(left + len(data), at - lo + width)
                    if b - a < width or at - lo < left:
                        continue
                    part = data[a - left : b - left]
                    shared = data[at - lo - left : max(at - lo, at - hi + width) - left]
                    out.append((xxhash.xxh3_64_intdigest(shared, seed=lo << 32 | hi) - (1 << 63), id, tie, at, a, part, lo, hi))
            if out:
                kinds = [pa.int64()] * 5 + [pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["gram", "id", "tie", "at", "left", "bytes", "least", "most"])

    return run


def _tied(docs: DataFrame, id: str, text: str, tie: str) -> DataFrame:
    """docs with tie: 0, but a hash of the text where rows of one id hold different texts."""
    ids = docs.select(F.col(id).cast("long").alias("again"), F.col(text).alias("t")).where("again is not null")
    again = written(ids.groupBy("again").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("again"), "repeated-ids")
    if again.isEmpty():
        return docs.withColumn(tie, F.lit(0).cast("long"))
    again = ids.join(again, "again").groupBy("again").agg(F.min(F.xxhash64("t")).alias("lo"), F.max(F.xxhash64("t")).alias("hi")).where("lo <> hi").select("again")
    marked = docs.join(written(again.withColumnRenamed("again", f"{tie}_of"), "clashing-ids"), docs[id].cast("long") == F.col(f"{tie}_of"), "left")
    return marked.withColumn(tie, F.when(F.col(f"{tie}_of").isNotNull(), F.xxhash64(F.col(text))).otherwise(0)).drop(f"{tie}_of")


def repeated_runs(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs: id, tie, text -> id, tie, start, stop: runs of bytes to remove; they may overlap."""
    if width < GRAM or 4 * width >= 1 << 20:
        raise ValueError(f"width must be at least {GRAM} bytes and below 2**18")
    crowd = min(CROWD, ((1 << 20) - SHARD) // (2 * width))  # a shard with one anchor more stays below 2**21 bytes

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in _groups(batches, width):
            hashes, n = np.unique(anchors(texts, width)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.minimum(n, 2))], ["gram", "n"])

    docs = docs.select("id", "tie", "text")
    twice = docs.mapInArrow(frugal(grams), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    twice = written(twice.select("gram"), "grams")
    places = docs.mapInArrow(frugal(_anchor_rows(width)), "gram long, id long, tie long, at long").join(twice, "gram", "left_semi")
    some, shared = _pick(docs, twice, ["gram"], places)
    found = written(some.mapInArrow(frugal(_contexts(width, shared)), "gram long, id long, tie long, at long, left long, size long, c1 long, c2 long"), "contexts")
    classes = found.groupBy("gram", "c1", "c2").agg(F.min(F.struct("id", "tie", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = written(classes, "classes")
    again = found.join(classes.where("n > 1"), ["gram", "c1", "c2"]).where(F.struct("id", "tie", "at") != F.col("first"))
    runs = written(again.where(F.col("size") >= width).select("id", "tie", F.col("left").alias("start"), (F.col("left") + F.col("size")).alias("stop")), "again")
    # A table by itself, so that the join with an anchor that has very many contexts can be split.
    several = written(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1").select("gram"), "several")
    firsts = written(classes.join(several, "gram", "left_semi").select("first.id", "first.tie", "first.at"), "first-places")
    some, first = _pick(docs, firsts, ["id", "tie", "at"])
    forget(found, classes, several)
    # A bitmap may let other occurrences through; they do no harm, as their strings are repeats.
    rows = written(some.mapInArrow(frugal(_contexts(width, shared, first, True)), "gram long, id long, tie long, at long, left long, size long, bytes binary"), "firsts")
    forget(firsts, twice)
    level = rows.select("gram", "id", "tie", "at", "left", "bytes", F.lit(0).cast("long").alias("least"), F.lit(width - GRAM).cast("long").alias("most"))
    order = ["id", "tie", "left", "at", "least", "most"]
    while True:
        crowded = level.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("gram")
        crowded = written(crowded, "crowded")
        more = not crowded.isEmpty()
        calm = level.join(crowded, "gram", "left_anti") if more else level
        runs = runs.unionByName(calm.select("gram", "id", "tie", "left", "bytes").repartition("gram").sortWithinPartitions("gram").mapInArrow(frugal(_repeats(width)), "id long, tie long, start long, stop long"))
        if not more:
            return runs
        halves = written(level.join(crowded, "gram", "left_semi").mapInArrow(frugal(_halves(width)), "gram long, id long, tie long, at long, left long, bytes binary, least long, most long"), "halves")
        # Both sides of the join are tables, so that Spark can split a string with very many places.
        heads = written(halves.groupBy("gram", "bytes").agg(F.min(F.struct(*order)).alias("first")), "level")
        rest = halves.join(heads, ["gram", "bytes"]).where(F.struct(*order) != F.col("first"))
        runs = runs.unionByName(rest.select("id", "tie", F.col("left").alias("start"), (F.col("left") + F.octet_length("bytes")).alias("stop")))
        level = heads.select("gram", "bytes", "first.*")


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with kept (the remaining bytes), kept_text (the same without characters that a cut has split), n_bytes,
    n_removed and n_spans."""
    made = ("kept", "kept_text", "n_bytes", "n_removed", "n_spans")
    docs = small_batches(docs).drop(*[c for c in docs.columns if c.lower() in made])
    tie, got = free_name(docs, "tie"), free_name(docs, "got")
    tied = _tied(docs, id, text, tie)
    with tidy() as kept:
        runs = repeated_runs(tied.select(F.col(id).cast("long").alias("id"), F.col(tie).alias("tie"), F.col(text).alias("text")), width)
        runs = written(runs.select("id", "tie", F.shiftleft("start", 31).bitwiseOR(F.col("stop")).alias("run")), "runs")
        kept(runs)
    by_doc = runs.groupBy(F.col("id").alias("_id"), F.col("tie").alias("_tie")).agg(F.array_sort(F.collect_set("run")).alias("_runs"))

    @F.arrow_udf("struct<kept:binary,kept_text:string,n_bytes:long,n_removed:long,n_spans:long>")
    @frugal
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, runs in batches:
            out = []
            for k in range(len(texts)):
                t = texts[k].as_py()
                data, at, n, parts, end = t.encode() if t else b"", 0, 0, [], -1
                for r in runs[k].as_py() or []:
                    a, b = r >> 31, min(r & ((1 << 31) - 1), len(data))
                    if a >= b:
                        continue
                    if a > end:
                        n += 1
                        parts.append(data[at:a])
                    at = end = max(end, b)
                parts.append(data[at:])
                kept = b"".join(parts)
                out.append({"kept": kept, "kept_text": "".join(p.decode("utf-8", "ignore") for p in parts) if n else t or "", "n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": n})
            yield pa.array(out, pa.struct([("kept", pa.binary()), ("kept_text", pa.string()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]))

    joined = tied.join(by_doc, (F.col(id).cast("long") == F.col("_id")) & (F.col(tie) == F.col("_tie")), "left")
    return joined.withColumn(got, cut(F.col(text), F.col("_runs"))).select(*docs.columns, *[F.col(f"{got}.{c}") for c in made])
