"""Best-fit packing of tokenised documents into sequences of fixed capacity.

A packing depends on the lengths alone, and there are at most ``capacity`` different lengths, whatever the size of the
corpus. So the driver packs the histogram of lengths: it forms bin patterns (best-two-fit) and says how often each is
used; rows then find their place by their rank among the rows of equal length. No row is gathered anywhere.

Best-two-fit: a bin is filled greedily, longest fitting piece first; then its smallest piece is replaced by two unpacked
pieces whose sum fits the expanded gap more tightly. Each pattern is used as often as its lengths last, which uses up at
least one length nearly, so the number of patterns is bounded by a multiple of capacity.

Edge cases: null text counts as empty (one piece: the end id alone); texts longer than the capacity are cut into pieces
of capacity, the first of which may be shorter; repeated rows and equal lengths are packed row by row; an empty table
gives an empty result; extra columns stay, columns of the output's names in the input are replaced.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens
from .common import free_name, frugal, small_batches, written

CAPACITY = 2048
CACHED = 1 << 19  # pre-tokens that a worker keeps: some 30 MB beside the tokenizer's 50 MB
_loaded: dict = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str, cached: int = CACHED):
    if (path, cached) not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        special = {x.content: i for i, x in t.get_added_tokens_decoder().items()}

        def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
            got = [e.ids for e in t.encode_batch_fast(strings, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(got), np.int32), np.fromiter(map(len, got), np.int64, len(got))

        _loaded[path, cached] = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None, special, pretokens.Encoder(encode, limit=cached)
    return _loaded[path, cached]


def encode_texts(path: str, texts: list[str], cached: int = CACHED) -> Iterator[np.ndarray]:
    """Ids of each text as the tokenizer gives them, without added special tokens. The string of a special token, which
    the library recognises inside texts, is one id, and the text before and after it is encoded on its own."""
    mark, special, encoder = _tokenizer(path, cached)
    parts = [mark.split(x) if mark else [x] for x in texts]
    ids = encoder.texts([p for x in parts for p in x[::2]])
    for x in parts:
        first = next(ids)
        yield first if len(x) == 1 else np.concatenate([first, *(y for s in x[1::2] for y in ([special[s]], next(ids)))]).astype(np.int32)


def token_pieces(docs: DataFrame, text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, cached: int = CACHED) -> DataFrame:
    """One row per piece in place of each document's row: its other columns, then piece, start, length and ids (packed
    little-endian unsigned 32-bit integers, the last piece ends with end_id)."""
    path = path or tokenizer_path()
    keep = [f for f in docs.schema if f.name != text and f.name.lower() not in ("piece", "start", "length", "ids")]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(len(names)).to_pylist()]
            out: tuple[list, ...] = ([], [], [], [], [])
            size = 0

            def flush(out):
                other = [batch.column(k).take(pa.array(out[0], pa.int64())) for k in range(len(names))]
                return pa.RecordBatch.from_arrays([*other, pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], [*names, "piece", "start", "length", "ids"])

            for i, ids in enumerate(encode_texts(path, texts, cached)):
                ids = np.append(ids, end_id).astype("<u4")
                at, stop = 0, len(ids) % capacity or min(len(ids), capacity)
                while at < len(ids):
                    for column, x in zip(out, (i, len(out[0]) and out[0][-1] == i and out[1][-1] + 1 or 0, at, stop - at, ids[at:stop].tobytes()), strict=True):
                        column.append(x)
                    size += stop - at
                    at, stop = stop, stop + capacity
                if size > 1_000_000:
                    yield flush(out)
                    out, size = ([], [], [], [], []), 0
            if out[0]:
                yield flush(out)

    return small_batches(docs).select(*names, text).mapInArrow(frugal(run), schema)


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how often), for the given number of pieces of each length."""
    have = [0] * (capacity + 1)
    for length, n in counts.items():
        have[length] = n
    open_ = sum(1 << k for k, n in enumerate(have) if n)
    out = []
    while open_:
        use: dict[int, int] = {}
        gap, left = capacity, open_
        while gap > 0 and (fits := left & ((2 << gap) - 1)):  # the longest that fits
            k = fits.bit_length() - 1
            use[k] = use.get(k, 0) + 1
            if use[k] == have[k]:
                left &= ~(1 << k)
            gap -= k
        if gap and len(use) + sum(use.values()) > 2:
            small = min(use)
            free = np.array(have)
            for k, n in use.items():
                free[k] -= n
            free[small] += 1
            two = _best_two(free, small + 1, small + gap)
            if two:
                use[small] -= 1
                for k in two:
                    use[k] = use.get(k, 0) + 1
                use = {k: n for k, n in use.items() if n}
        times = min(have[k] // n for k, n in use.items())
        for k, n in use.items():
            have[k] -= n * times
            if not have[k]:
                open_ &= ~(1 << k)
        out.append(([k for k in sorted(use, reverse=True) for _ in range(use[k])], times))
    return out


def _best_two(free: np.ndarray, least: int, most: int) -> tuple[int, int] | None:
    """Two free lengths with the largest sum between least and most."""
    some, twice = free > 0, free > 1
    for total in range(min(most, 2 * (len(free) - 1)), least - 1, -1):
        lo = np.arange(max(1, total - len(free) + 1), total // 2 + 1)
        both = some[lo] & some[total - lo]
        if total % 2 == 0 and len(lo):
            both[-1] = twice[total // 2]
        if both.any():
            a = int(lo[both.argmax()])
            return a, total - a
    return None


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """pieces with sequence_id and offset. Rows whose length is null or not in 1..capacity are refused."""
    pieces = pieces.drop(*[c for c in pieces.columns if c.lower() in ("sequence_id", "offset")])
    part, nth, base = (free_name(pieces, c) for c in ("part", "nth", "base"))
    rows = written(pieces.withColumn(part, F.spark_partition_id()), "pieces")
    by_part = rows.groupBy(length, part).agg(F.count(F.lit(1)).alias(base))
    counts = {r[0]: r[1] for r in by_part.groupBy(length).agg(F.sum(base)).limit(capacity + 2).collect()}
    if any(k is None or not 1 <= k <= capacity for k in counts):
        raise ValueError("a piece's length must be from 1 to capacity")
    keys, first, offsets, start, taken = [], [], [], 0, dict.fromkeys(counts, 0)
    for lengths, times in patterns(counts, capacity):
        at = 0
        for k in lengths:
            keys.append(k << 44 | taken[k])
            first.append(start - taken[k])
            offsets.append(at)
            taken[k] += times
            at += k
        start += times
    order = np.argsort(np.array(keys, np.int64))
    plan = pieces.sparkSession.sparkContext.broadcast(tuple(np.array(x, np.int64)[order] for x in (keys, first, offsets)))

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(size: pa.Array, rank: pa.Array) -> pa.Array:
        keys, first, offsets = plan.value
        rank = rank.to_numpy(zero_copy_only=False).astype(np.int64)
        i = np.searchsorted(keys, size.to_numpy(zero_copy_only=False).astype(np.int64) << 44 | rank, "right") - 1
        return pa.StructArray.from_arrays([pa.array(first[i] + rank), pa.array(offsets[i])], ["sequence_id", "offset"])

    before = Window.partitionBy(length).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    own = Window.partitionBy(length, part).orderBy(*[c for c in pieces.columns if c != length and not isinstance(pieces.schema[c].dataType, T.MapType)][:4] or [part])
    ranked = rows.withColumn(nth, F.row_number().over(own) - 1).join(by_part, [length, part])
    at = free_name(ranked, "at")
    out = ranked.withColumn(at, place(F.col(length), F.col(base) + F.col(nth)))
    return out.select(*pieces.columns, f"{at}.sequence_id", f"{at}.offset")
