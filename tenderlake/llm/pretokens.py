"""Array kernels that cut texts into pre-tokens and look them up in hash tables.

A batch of texts becomes one array of code points; runs of character classes give the cuts, so that no
regular expression runs over the corpus. The cuts equal the matches of the public GPT-2 style pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` (``by_class``), or the
places where a word mark follows another character (``by_mark``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

OTHER, LETTER, NUMBER, SPACE, END = range(5)
SLICE = 1 << 19  # code points handled at once
LONG = 64  # longer pre-tokens bypass the hash tables
_END = "\ud800"  # no valid text holds a surrogate
# Unicode White_Space.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_MARKS = [32, 0x2581]  # blank and the word mark that stands for it

_rng = np.random.default_rng(20240)
_PLACE = _rng.integers(1, 1 << 63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_tables: dict[str, np.ndarray] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _random_by_code_point() -> np.ndarray:
    if "random" not in _tables:
        _tables["random"] = _mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _tables["random"]


def _classes() -> np.ndarray:
    if "class" not in _tables:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        out = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
            out[[ord(c) for c in regex.findall(pattern, every)]] = kind
        out[_SPACES] = SPACE
        out[0xD800] = END
        _tables["class"] = out
    return _tables["class"]


def by_class(cp: np.ndarray) -> np.ndarray:
    """True where a match of the pattern starts; cp ends with three END marks."""
    cls = _classes()[cp]
    start = np.empty(len(cp), bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    start |= cls == END
    space = cls == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & (cls[1:] != END))  # last of a run that something follows
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        one, two = cp[quote + 1], cp[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long] + 3] = True
    return start


def by_mark(cp: np.ndarray) -> np.ndarray:
    """True where a word mark follows something else."""
    mark = (cp == _MARKS[0]) | (cp == _MARKS[1])
    start = mark.copy()
    start[1:] &= ~mark[:-1]
    start |= cp == 0xD800
    start[1:] |= cp[:-1] == 0xD800
    return start


class Batch:
    """Pre-tokens of some texts: text_of, begin, end (code points in joined) and a 64-bit hash each."""

    def __init__(self, texts: list[str], cut: Callable[[np.ndarray], np.ndarray]):
        self.joined = _END.join(texts) + _END * 3
        cp = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        start = cut(cp)
        at = np.flatnonzero(start)
        length = np.diff(at, append=len(cp))
        place = np.arange(len(cp), dtype=np.int32)
        place -= np.repeat(at.astype(np.int32), length)
        place &= LONG - 1
        value = _random_by_code_point()[cp]
        value *= _PLACE[place]
        h = np.add.reduceat(value, at) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        is_end = cp[at] == 0xD800
        real = ~is_end
        self.text_of = np.cumsum(is_end)[real]
        self.begin, self.length = at[real], length[real]
        h = _mix(h[real])
        h[h == 0] = 1
        self.hash = h

    def string(self, i: int) -> str:
        b = self.begin[i]
        return self.joined[b : b + self.length[i]]


_GAPS = {"": re.compile(r"\S(?=[ \n])"), " ": re.compile("[^ \u2581](?= )")}


def slices(texts: Iterable[str], prefix: str = "") -> Iterator[tuple[list[str], list[int]]]:
    """Groups of about SLICE code points: the parts and the text that each belongs to. Long texts are cut only where a
    blank or line end follows another character, where every cut rule starts a new pre-token; the prefix goes before
    each text that isn't empty."""
    parts, owner, n = [], [], 0
    for i, text in enumerate(texts):
        text, at = prefix + text if text else text, 0
        while at < len(text):
            stop = len(text)
            if stop - at > SLICE and (gap := _GAPS[prefix].search(text, at + SLICE)):
                stop = gap.end()
            parts.append(text[at:stop])
            owner.append(i)
            n += stop - at
            at = stop
            if n >= SLICE:
                yield parts, owner
                parts, owner, n = [], [], 0
    if parts:
        yield parts, owner


class HashTable:
    """Open addressing over arrays: 64-bit keys (0 is free) to int32 values."""

    def __init__(self, capacity: int = 1 << 12):
        self.size = 1 << max(8, (capacity * 5 // 3).bit_length())
        self.keys, self.values, self.count = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is absent."""
        mask, out = self.size - 1, np.full(len(keys), -1, np.int32)
        slot = (keys & np.uint64(mask)).astype(np.int64)
        got = self.keys[slot]
        hit = got == keys
        out[hit] = self.values[slot[hit]]
        todo = np.flatnonzero(~hit & (got != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            got = self.keys[slot[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (got != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that the table doesn't hold yet."""
        if 5 * (self.count + len(keys)) > 4 * self.size:
            old = self.keys != 0
            k, v = self.keys[old], self.values[old]
            self.__init__(self.count + len(keys))
            self._put(k, v)
        self._put(keys, values)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.count += len(keys)
        mask = self.size - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            keys, values, slot = keys[lost], values[lost], (slot[lost] + 1) & mask


class Encoder:
    """Encodes whole texts through a worker's cache of pre-tokens.

    encode: list of pre-token strings to their ids one after another, and the number of ids of each. A full cache
    (limit entries, or 8 ids for each of them) keeps what has been found again since it was full last, if that is half of
    it at most, and starts anew otherwise. Long pre-tokens are held for one slice only. So memory is bounded by the limit
    and a slice. Pre-tokens are told apart by 64-bit hashes; their strings are not compared.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cut=by_class, prefix: str = "", limit: int = 1 << 19):
        self.encode, self.cut, self.prefix, self.limit = encode, cut, prefix, limit
        self._start(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))

    def _start(self, hashes: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        self.table, self.n, self.used = HashTable(max(1 << 12, len(hashes))), len(size), len(ids)
        self.size, self.ids, self.again = size, ids, np.zeros(len(size), bool)
        self.offset = (np.cumsum(size) - size).astype(np.int32)
        self.kept = self.n, self.used
        self.table.add(hashes, np.arange(self.n, dtype=np.int32))

    def _trim(self) -> None:
        full = np.flatnonzero(self.table.keys)
        hashes, entry = self.table.keys[full], self.table.values[full]
        some = self.again[entry]
        if 2 * some.sum() > self.limit:
            some[:] = False
        hashes, entry = hashes[some], entry[some]
        size = self.size[entry]
        self._start(hashes, size, self.ids[_ranges(self.offset[entry], size)] if self.used else self.ids[:0])  # none where only counts are kept

    @staticmethod
    def _grown(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, len(x) * 3 // 2) - len(x), x.dtype)])

    def _append(self, strings: list[str]) -> np.ndarray:
        flat, size = self.encode(strings)
        n, used = self.n + len(size), self.used + len(flat)
        self.size, self.offset, self.again, self.ids = self._grown(self.size, n), self._grown(self.offset, n), self._grown(self.again, n), self._grown(self.ids, used)
        self.ids[self.used : used], self.size[self.n : n], self.again[self.n : n] = flat, size, False
        self.offset[self.n : n] = self.used + np.cumsum(size) - size if len(flat) else 0
        new = np.arange(self.n, n, dtype=np.int32)
        self.n, self.used = n, used
        return new

    def entries(self, batch: Batch) -> np.ndarray:
        """Places in size and offset, valid until the next call."""
        self.n, self.used = self.kept
        if len(self.ids) > 16 * self.limit:
            self.ids = self.ids[: self.used].copy()
        if self.n > self.limit or self.used > 8 * self.limit:
            self._trim()
        found = self.table.find(batch.hash)
        self.again[found[found >= 0]] = True
        missing = np.flatnonzero((found < 0) & (batch.length <= LONG))
        if len(missing):
            keys, first, back = np.unique(batch.hash[missing], return_index=True, return_inverse=True)
            new = self._append([batch.string(i) for i in missing[first].tolist()])
            self.table.add(keys, new)
            found[missing] = new[back]
        self.kept = self.n, self.used
        long = np.flatnonzero(batch.length > LONG)
        if len(long):
            found[long] = self._append([batch.string(i) for i in long.tolist()])
        return found

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for parts, owner in slices(texts, self.prefix):
            batch = Batch(parts, self.cut)
            entry = self.entries(batch)
            out += np.bincount(np.asarray(owner)[batch.text_of], weights=self.size[entry], minlength=len(texts)).astype(np.int64)
        return out

    def pieces(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(text, ids) in order; a long text comes in several pieces, a text without pre-tokens in none."""
        for parts, owner in slices(texts, self.prefix):
            batch = Batch(parts, self.cut)
            e = self.entries(batch)
            size = self.size[e]
            ids = self.ids[_ranges(self.offset[e], size)]
            cuts = np.cumsum(np.bincount(batch.text_of, weights=size, minlength=len(parts)).astype(np.int64))
            for k, i in enumerate(owner):
                yield i, ids[cuts[k - 1] if k else 0 : cuts[k]]

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        at, have = 0, []
        for i, ids in self.pieces(texts):
            while at < i:
                yield np.concatenate(have) if len(have) != 1 and have else have[0] if have else np.zeros(0, np.int32)
                at, have = at + 1, []
            have.append(ids)
        while at < len(texts):
            yield np.concatenate(have) if len(have) != 1 and have else have[0] if have else np.zeros(0, np.int32)
            at, have = at + 1, []


def _ranges(offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """offset, offset + 1, ... of each, size of them."""
    n = size.astype(np.int64)
    return np.arange(n.sum()) + np.repeat(offset - (np.cumsum(n) - n), n)
