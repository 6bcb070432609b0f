"""Byte-level BPE encoding with a rank queue, and decoding.

The pre-tokens of a batch are one linked list of symbols in which no pair reaches over a pre-token's end. Buckets, one for
each merge rank, hold the list positions whose pair has that rank; a bitmap of three levels says which buckets hold
something, and find-first-set walks down it to the next rank. Entries whose pair has changed since are stale and skipped.
Pre-tokens don't touch each other, so one queue serves them all, and a large bucket is merged in one step, a position of
each pre-token. Long pre-tokens have a queue of their own. A merge costs a constant, so a pre-token of n bytes takes O(n)
merges whatever its length. Each worker keeps the ids of pre-tokens that it has seen in a bounded cache.

Edge cases: null text counts as empty (no ids, decodes to no bytes); texts of any length are encoded whole; repeated rows
each get their row; an empty table gives an empty result; a column of the output's name in the input is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import frugal, small_batches


def ranks_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


_NONE = (1 << 18) - 1  # no id
ALONE = 256  # longer pre-tokens have a queue of their own
TOGETHER = 400  # positions in a bucket from which on they are merged at once


class RankQueue:
    """Buckets of positions by rank under a bitmap of three levels with 64 bits a word (ranks below 2**18)."""

    def __init__(self):
        self.low, self.mid, self.top = [0] * 4096, [0] * 64, 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, positions: list[int]) -> None:
        if bucket := self.buckets.get(rank):
            bucket += positions
            return
        self.buckets[rank] = positions
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Positions with their ranks, a bucket at a time."""
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order].tolist()
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        for rank, a, b in zip(ranks[cuts].tolist(), cuts, [*cuts[1:], len(positions)], strict=True):
            self.push(rank, positions[a:b])

    def pop(self) -> tuple[int, list[int]]:
        """The smallest rank and its positions."""
        i = (self.top & -self.top).bit_length() - 1
        m = self.mid[i]
        word = i << 6 | (m & -m).bit_length() - 1
        bits = self.low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        bits &= bits - 1
        self.low[word] = bits
        if not bits:
            m &= m - 1
            self.mid[i] = m
            if not m:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= _NONE:
            raise ValueError("ranks from 2**18 - 1 on don't fit the queue's bitmap")
        self.ranks, self.single = ranks, np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs: dict[int, int] = {}  # (left id << 18 | right id) -> id of both together
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << 18 | right] = rank
        self.table = pretokens.HashTable(len(self.pairs))
        self.table.add(self._hashed(np.fromiter(self.pairs, np.int64, len(self.pairs))), np.fromiter(self.pairs.values(), np.int32, len(self.pairs)))
        of_bytes = np.arange(256 * 256)
        self.first = self._find(self.single[of_bytes >> 8] << 18 | self.single[of_bytes & 255])  # by two bytes

    @staticmethod
    def _hashed(pairs: np.ndarray) -> np.ndarray:
        return pretokens._mix(pairs.view(np.uint64) + np.uint64(1))

    def _find(self, pairs: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where they are none."""
        return self.table.find(self._hashed(pairs)).astype(np.int64)

    def encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens one after another, and how many each has."""
        pieces = [s.encode() for s in strings]
        whole = [self.ranks.get(p) for p in pieces]
        size = np.zeros(len(pieces), np.int64)
        found: list[tuple[list[int], np.ndarray]] = []  # pre-tokens that went together, their ids
        short, joined = [], []
        for k, (p, rank) in enumerate(zip(pieces, whole, strict=True)):
            if rank is None and len(p) > ALONE:
                ids, size[k : k + 1] = self._merge([p], [None], len(p))
                found.append(([k], ids))
            else:
                short.append(k)
                joined.append(p if rank is None else b"\0")
        if len(short) == len(pieces):
            return self._merge(joined, whole, TOGETHER)
        ids, size[short] = self._merge(joined, [whole[k] for k in short], TOGETHER)
        parts: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        for k, end in zip(short, np.cumsum(size[short]).tolist(), strict=True):
            parts[k] = ids[end - size[k] : end]
        for (k,), part in found:
            parts[k] = part
        return np.concatenate(parts), size

    def _merge(self, pieces: list[bytes], whole: list[int | None], together: int) -> tuple[np.ndarray, np.ndarray]:
        """All pre-tokens in one linked list and one queue; no pair reaches over an end. Buckets of at least ``together``
        positions are merged at once, one position of each pre-token at a time, from left to right."""
        n = sum(map(len, pieces))
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stop = np.cumsum(size)
        own = np.repeat(np.arange(len(pieces)), size)
        ids, after, before, at_rank, alive = np.full(n + 1, _NONE), np.arange(1, n + 2), np.arange(-1, n), np.full(n + 1, -1), np.ones(n, bool)
        ids[:n] = self.single[data]
        known = [k for k, rank in enumerate(whole) if rank is not None]
        ids[stop[known] - 1] = [whole[k] for k in known]
        after[stop - 1] = n  # place n is the end of every pre-token: no pair holds it
        before[stop - size] = n
        inside = np.flatnonzero(own[1:] == own[:-1])
        at_rank[inside] = self.first[data[inside].astype(np.int64) << 8 | data[inside + 1]]
        queue = RankQueue()
        some = np.flatnonzero(at_rank >= 0)
        queue.push_all(at_rank[some], some)
        id_of, next_of, last_of, rank_of, lives = map(memoryview, (ids, after, before, at_rank, alive))
        get, push = self.pairs.get, queue.push
        while queue.top:
            rank, positions = queue.pop()
            if len(positions) >= together:
                at = np.sort(np.array(positions))
                at = at[at_rank[at] == rank]  # others are stale
                first = np.diff(own[at], prepend=-1) > 0
                if not first.all():
                    push(rank, at[~first].tolist())
                    at = at[first]
                gone = after[at]
                nxt, prev = after[gone], before[at]
                ids[at], at_rank[gone], alive[gone] = rank, -1, False
                after[at], before[nxt] = nxt, at
                ends = np.concatenate([at, prev])
                new = self._find(np.concatenate([rank << 18 | ids[nxt], ids[prev] << 18 | rank]))
                at_rank[ends] = new
                at_rank[n] = -1
                queue.push_all(new[new >= 0], ends[new >= 0])
                continue
            positions.sort()
            for k, i in enumerate(positions):
                if rank_of[i] != rank:
                    continue  # stale
                j = next_of[i]
                nxt, prev = next_of[j], last_of[i]
                id_of[i], rank_of[j], lives[j] = rank, -1, False
                next_of[i], last_of[nxt] = nxt, i
                rank_of[i] = right = get(rank << 18 | id_of[nxt], -1)
                if right >= 0:
                    push(right, [i])
                left = -1
                if prev < n:
                    rank_of[prev] = left = get(id_of[prev] << 18 | rank, -1)
                    if left >= 0:
                        push(left, [prev])
                if 0 <= right < rank or 0 <= left < rank:  # a pair with a smaller rank has come up: it goes first
                    if k + 1 < len(positions):
                        push(rank, positions[k + 1 :])
                    break
        return ids[:n][alive].astype(np.int32), np.bincount(own[alive], minlength=len(pieces))

    def encode_pretoken(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self._merge([piece], [None], len(piece) + 1)[0].tolist()


_loaded: dict = {}


def _codec(path: str):
    if path not in _loaded:
        ranks = load_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        size = np.array([len(t) for t in tokens], np.int64)
        _loaded[path] = pretokens.Encoder(ByteBpe(ranks).encode), np.frombuffer(b"".join(tokens), np.uint8), size, np.cumsum(size) - size
    return _loaded[path]


def _by_rows(batch: pa.Array, work) -> pa.Array:
    """work over a few rows at a time, so that a batch is never held as Python objects whole."""
    parts = [pa.array(work(batch.slice(k, 512).to_pylist()), pa.binary()) for k in range(0, len(batch), 512)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def encode(docs: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids") -> DataFrame:
    """docs with the ids of each whole text as packed little-endian unsigned 32-bit integers."""
    path = path or ranks_path()

    @F.arrow_udf("binary")
    @frugal
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _codec(path)[0]
        for batch in batches:
            yield _by_rows(batch, lambda rows: [x.astype("<u4").tobytes() for x in encoder.texts([x or "" for x in rows])])

    return small_batches(docs).withColumn(ids, packed(docs[text]))


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """rows with the bytes that the packed ids stand for (null ids: none)."""
    path = path or ranks_path()

    @F.arrow_udf("binary")
    @frugal
    def plain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _, flat, size, offset = _codec(path)

        def bytes_of(ids: bytes | None) -> bytes:
            parts = []
            every = np.frombuffer(ids or b"", "<u4")
            for k in range(0, len(every), 1 << 18):
                some = every[k : k + (1 << 18)].astype(np.int64)
                n = size[some]
                parts.append(flat[np.arange(n.sum()) + np.repeat(offset[some] - (np.cumsum(n) - n), n)].tobytes())
            return b"".join(parts)

        for batch in batches:
            yield _by_rows(batch, lambda rows: [bytes_of(x) for x in rows])

    return small_batches(rows).withColumn(out, plain(rows[ids]))


def unpack(ids) -> np.ndarray:
    return np.frombuffer(ids or b"", "<u4")
