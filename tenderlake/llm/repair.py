"""Repair of a conversation's structure by the cheapest edits, as a run-length dynamic program.

A conversation is to read: a system turn or none, then user and assistant in turn, or nothing at all. Each turn is kept
(free), reroled to user or assistant (1) or deleted (2, a must for blank and repeated turns); turns of empty text are
inserted (5); a truncated turn that stays costs 5. Four states tell how far a reading has come, so a turn is a 4 x 4
matrix of costs, in which sums are minima and products sums. Equal role/fault symbols in a row are one run, and a run of n
is the product of those powers of its matrix that n's binary digits name; the powers are cached. The costs to go at the
ends of runs then tell the choices turn by turn: of the cheapest edits, those with the least letters (D, I, K, R).

How it is spread: turns that are alike in conversation, number, role and text become one row with a count. Rows are sorted by
ranges that may cut a conversation anywhere and get ascending positions; 4096 positions are a block. Whether a text was
seen earlier is a join by position. A block's conversations are solved where they are; one that goes on in other blocks
gives a matrix for each, along which costs to go are carried back and, once each block has said where each of its
four starts would lead, states forth: a few numbers a block, read one after the other. Texts are read in order last and
leave in slices of about SLICE bytes, so that no task holds a conversation.

Edge cases: null roles and texts count as one blank; turns come by number, nulls first, ties by role, the first 100 code
points, a hash of the text, and text; a null conversation id is a conversation; a role that starts with none of s, u, a
can't be kept; repeated rows count each; texts of any length are taken whole; a conversation whose rows all have 0 copies
gives one empty slice; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, small_batches, tidy, written

INSERT, REROLE, DELETE, TRUNCATED = 5, 1, 2, 5
BLOCK_BITS = 12
SLICE = 1 << 20
SPACE = " \t\n\x0b\x0c\r"
INF = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)  # how far a reading has come
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ADDS = [("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER)]  # what may come next by state, beside a system turn
TO_GO = (0, 10, 5, 0)  # costs of the end of a conversation by state
FINE, BLANK, SEEN, CUT = range(4)  # faults; a symbol is a fault + 4 * place of the role's initial in INITIALS
INITIALS = "sua"
GONE = BLANK  # any symbol that must be deleted

Matrix = tuple[tuple[int, ...], ...]
Costs = tuple[int, ...]


# --- The dynamic program: matrices, runs, choices.


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(INF, min(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def _back(m: Matrix, v: Costs) -> Costs:
    return tuple(min(INF, min(m[i][j] + v[j] for j in range(4))) for i in range(4))


def _edits(symbol: int, state: int) -> Iterator[tuple[str, int, int, str | None]]:
    """What may become of a turn: letter, cost, next state, new role; in the order of the letters."""
    fault, initial = symbol & 3, INITIALS[symbol >> 2 : (symbol >> 2) + 1]
    yield "D", DELETE, state, None
    if fault in (BLANK, SEEN):
        return
    extra = TRUNCATED if fault == CUT else 0
    if (after := KEEPS.get(initial, {}).get(state)) is not None:
        yield "K", extra, after, None
    role, after = ADDS[state]
    yield "R", REROLE + extra, after, role


@functools.cache
def power(symbol: int, k: int) -> Matrix:
    """The matrix of 2 ** k turns of one symbol: insertions, then the turn."""
    if k:
        return _times(power(symbol, k - 1), power(symbol, k - 1))
    out = [[INF] * 4 for _ in range(4)]
    for i in range(4):
        state, spent = i, 0
        for _ in range(3):
            for _, cost, after, _ in _edits(symbol, state):
                out[i][after] = min(out[i][after], spent + cost)
            state, spent = ADDS[state][1], spent + INSERT
    return tuple(map(tuple, out))


def run_matrix(symbol: int, n: int) -> Matrix:
    out = None
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = power(symbol, k) if out is None else _times(out, power(symbol, k))
    return out


@functools.lru_cache(1 << 16)
def _one(symbol: int, after: Costs) -> tuple[Costs, tuple[tuple[str, tuple[str, ...], str | None, int], ...]]:
    """Costs to go before a turn, less their minimum, and by state: letters, inserted roles, the turn's new role, next state."""
    before, out = _back(power(symbol, 0), after), []
    for state in range(4):
        letters, roles, at = "", (), state
        while True:
            fits = [e for e in _edits(symbol, at) if e[1] + after[e[2]] == before[at]]
            role, add = ADDS[at]
            if fits and fits[0][0] == "D" or INSERT + before[add] != before[at]:
                out.append((letters + fits[0][0], roles, fits[0][3], fits[0][2]))
                break
            letters, roles, at = letters + "I", (*roles, role), add
    least = min(before)
    return tuple(x - least for x in before), tuple(out)


def runs_of(symbols: bytes, copies: np.ndarray) -> list[tuple[int, int]]:
    """(symbol, length) of equal symbols in a row; the second and later copies of a turn must go."""
    each = []
    for symbol, n in zip(symbols, copies.tolist(), strict=True):
        symbol = GONE if symbol & 3 in (BLANK, SEEN) else symbol
        if n:
            each += [(symbol, 1), (GONE, n - 1)] if n > 1 else [(symbol, 1)]
    return [(symbol, sum(n for _, n in same)) for symbol, same in groupby(each, lambda x: x[0])]


def matrix_of(runs: list[tuple[int, int]]) -> Matrix | None:
    return functools.reduce(_times, [run_matrix(*r) for r in runs]) if runs else None


def choices(runs: list[tuple[int, int]], to_go: Costs, state: int) -> Iterator[tuple[str, tuple[str, ...], str | None, int]]:
    """For each turn: letters, inserted roles, its new role, the state after it."""
    ends = [to_go]
    for symbol, n in reversed(runs):
        v = ends[-1]
        for k in range(n.bit_length()):
            if n >> k & 1:
                v = _back(power(symbol, k), v)
        ends.append(tuple(x - min(v) for x in v))
    for i, (symbol, n) in enumerate(runs):
        if symbol == GONE:
            for _ in range(n):
                yield "D", (), None, state
            continue
        v = ends[len(runs) - 1 - i]
        steps = []
        for _ in range(n):
            v, step = _one(symbol, v)
            steps.append(step)
        for step in reversed(steps):
            letters, roles, role, state = step[state]
            yield letters, roles, role, state


# --- Tasks: blocks, carrying back and forth, slices.


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _out(rows: Iterator[tuple], schema: pa.Schema, many: int = 256, size=lambda row: 0) -> Iterator[pa.RecordBatch]:
    have, n = [], 0
    for row in rows:
        have.append(row)
        n += size(row)
        if len(have) == many or n > SLICE:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*have, strict=True), schema, strict=True)], schema=schema)
            have, n = [], 0
    if have:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*have, strict=True), schema, strict=True)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _task(make, schema: T.StructType, many: int = 256, size=lambda row: 0):
    """A mapInArrow function of make, a generator of rows from rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _out(make(_rows(batches)), _arrow(schema), many, size)

    return frugal(run)


def _blocks(rows: Iterator[tuple]) -> Iterator[tuple]:
    """block, symbols, copies, ends (where conversations end in it), edges: its first and last one, which may go on elsewhere."""
    for block, same in groupby(rows, lambda r: r[0]):
        _, _, convs, symbols, copies = zip(*same, strict=True)
        symbols, copies = bytes(symbols), np.array(copies, "<i8")
        ends = [i for i in range(1, len(convs) + 1) if i == len(convs) or convs[i] != convs[i - 1]]
        spans = sorted({(0, ends[0]), (0 if len(ends) == 1 else ends[-2], ends[-1])})
        edges = []
        for start, stop in spans:
            m = matrix_of(runs_of(symbols[start:stop], copies[start:stop]))
            edges.append({"conv": convs[start], "start": start, "stop": stop, "matrix": m and [x for row in m for x in row]})
        yield block, symbols, copies.tobytes(), ends, edges


def _carry_back(rows: Iterator[tuple]) -> Iterator[tuple]:
    """conv, block, start, matrix from the last block to the first -> block, start, costs to go, whether it is the last."""
    for _, same in groupby(rows, lambda r: r[0]):
        v, final = TO_GO, True
        for _, block, start, m in same:
            yield block, start, list(v), final
            if m:
                v = _back([m[4 * i : 4 * i + 4] for i in range(4)], v)
                v = tuple(x - min(v) for x in v)
            final = False


def _leads(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Where each of the four states at a block's start leads."""
    for conv, block, start, stop, symbols, copies, to_go, final in rows:
        runs = runs_of(symbols[start:stop], np.frombuffer(copies, "<i8")[start:stop])
        ends = []
        for state in range(4):
            for _, _, _, state in choices(runs, tuple(to_go), state):  # noqa: B020
                pass
            ends.append(state)
        yield conv, block, start, to_go, final, ends


def _carry_forth(rows: Iterator[tuple]) -> Iterator[tuple]:
    """block, start, costs to go, last, state, alone: the state before each block; alone if the conversation has no other."""
    for _, same in groupby(rows, lambda r: r[0]):
        state, first = START, True
        for _, block, start, to_go, final, ends in same:
            yield block, start, to_go, final, state, first and final
            state, first = ends[state], False


def _slices(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of a block, the first of which holds its symbols and edges -> slices of repaired conversations."""
    legal = {(0, 1), (1, 2), (2, 1)}
    for block, same in groupby(rows, lambda r: r[0]):
        head = next(same)
        symbols, copies, edges = head[6], np.frombuffer(head[7], "<i8"), {e["start"]: e for e in head[8]}
        ends = iter(head[9])
        at, nth = 0, 0
        for conv, turns in groupby(same, lambda r: r[2]):
            turns = iter(turns)
            start = at
            stop = next(ends)
            edge = edges.get(start, {"to_go": TO_GO, "final": True, "state": START, "alone": True})
            chosen = choices(runs_of(symbols[start:stop], copies[start:stop]), tuple(edge["to_go"]), edge["state"])
            state, n_slices = edge["state"], 0
            new = _Slice()
            for i, (_, _, _, turn, role, text, *_) in enumerate(turns, start):
                symbol, n = symbols[i], int(copies[i])
                at += 1
                if not n:
                    continue
                letters, roles, to, state = next(chosen)
                for _ in range(n - 1):
                    next(chosen)
                new.count(symbol, n, turn, legal)
                new.edits.append(letters + "D" * (n - 1))
                new.cost += INSERT * len(roles) + DELETE * (n - 1) + (DELETE if letters[-1] == "D" else REROLE * (letters[-1] == "R") + TRUNCATED * (symbol & 3 == CUT))
                for added in roles:
                    new.add(added, "")
                if letters[-1] != "D":
                    new.add(to or role, text)
                new.size += n
                if new.size > SLICE:
                    yield new.row(conv, block, nth, False)
                    nth, n_slices, new = nth + 1, n_slices + 1, _Slice(new.last)
            if edge["final"]:
                while TO_GO[state]:
                    role, state = ADDS[state]
                    new.edits.append("I")
                    new.cost += INSERT
                    new.add(role, "")
            yield new.row(conv, block, nth, edge["alone"] and not n_slices)
            nth += 1


class _Slice:
    """What a slice of a conversation adds up to; last is the initial before it, where it is known."""

    def __init__(self, last: int | None = None):
        self.edits, self.turns, self.size, self.cost = [], [], 0, 0
        self.faults, self.illegal, self.first, self.last, self.joined = [0] * 4, 0, None, last, last is not None
        self.lo = self.hi = None
        self.n_turns = 0

    def count(self, symbol: int, n: int, turn: int | None, legal: set) -> None:
        fault, initial = symbol & 3, symbol >> 2
        if fault in (BLANK, SEEN):
            self.faults[fault] += n
        else:
            self.faults[fault] += 1
            self.faults[SEEN] += n - 1
        if self.last is not None and (self.last, initial) not in legal:
            self.illegal += 1
        self.illegal += n - 1
        if self.first is None:
            self.first = initial
        self.last = initial
        if turn is not None:
            if self.lo is None:
                self.lo = turn
            self.n_turns += turn != self.hi
            self.hi = turn

    def add(self, role: str, text: str) -> None:
        self.turns.append({"role": role, "text": text})
        self.size += len(role) + len(text)

    def row(self, conv, block: int, nth: int, whole: bool) -> tuple:
        first = None if self.joined else self.first
        return conv, block, nth, whole, "".join(self.edits), self.turns, self.cost, *self.faults[1:], self.illegal, first, self.last, self.lo, self.hi, self.n_turns


# --- DataFrames.


def _symbol(role: Column, text: Column, seen: Column) -> Column:
    bare = F.rtrim(text, F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(seen, SEEN).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)
    initial = F.substring(role, 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return (fault + 4 * code).cast("int")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Slices of the repaired conversations, in order of (block, nth): conv, block, nth, whole (nothing of the conversation is
    elsewhere), edits (letters), turns (role and text), cost, blank, seen, cut, illegal, and what joins a slice to its
    neighbours: first and last initial, lowest, highest and number of turns. copies names a column that says how often a row stands."""
    kind = turns.schema[conv].dataType
    n = F.lit(1) if copies is None else F.coalesce(F.col(copies), F.lit(0))
    there = n > 0
    rows = turns.select(
        F.col(conv).alias("conv"), F.when(there, F.col(turn).cast("long")).alias("turn"), F.when(there, F.coalesce(role, F.lit(" "))).alias("role"),
        F.when(there, F.coalesce(text, F.lit(" "))).alias("text"), F.greatest(n, F.lit(0)).cast("long").alias("n"),
    )
    small_batches(turns)
    with tidy() as kept:
        rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
        order = ["conv", "turn", "role", "head", "tie"]
        rows = rows.withColumns({"head": F.substring("text", 1, 100), "tie": F.xxhash64("text")}).repartitionByRange(*order).sortWithinPartitions(*order, "text")
        same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
        rows = written(rows.select("conv", "turn", "role", "text", "n", F.monotonically_increasing_id().alias("pos"), same.alias("same")), "turns")
        block = F.shiftright("pos", block_bits).alias("block")

        first = rows.where("n > 0").groupBy("conv", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
        slim = rows.select("pos", "conv", "n", _symbol(F.col("role"), F.col("text"), F.lit(False)).alias("symbol")).join(first, "pos", "left")
        seen = F.when(F.col("n") == 0, FINE).when(F.col("first").isNull() & (F.col("symbol").bitwiseAND(3) != BLANK), F.col("symbol").bitwiseAND(12) + SEEN).otherwise(F.col("symbol"))
        slim = slim.select(block, "pos", "conv", seen.cast("int").alias("symbol"), "n").repartition("block").sortWithinPartitions("block", "pos")
        edge = T.StructType([T.StructField("conv", kind), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("matrix", T.ArrayType(T.LongType()))])
        schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("symbols", T.BinaryType()), T.StructField("copies", T.BinaryType()), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("edges", T.ArrayType(edge))])
        blocks = written(slim.mapInArrow(_task(_blocks, schema, 16), schema), "blocks")

        edges = blocks.select("block", "symbols", "copies", F.explode("edges").alias("e"))
        one = lambda fields: T.StructType([T.StructField(*f) for f in fields])
        ints = T.ArrayType(T.LongType())
        schema = one([("block", T.LongType()), ("start", T.IntegerType()), ("to_go", ints), ("final", T.BooleanType())])
        back = edges.select("e.conv", "block", "e.start", "e.matrix").repartition("conv").sortWithinPartitions("conv", F.desc("block"), F.desc("start"))
        back = back.mapInArrow(_task(_carry_back, schema), schema)
        leads = edges.select("block", "e.start", "e.conv", "e.stop", "symbols", "copies").join(back, ["block", "start"]).select("conv", "block", "start", "stop", "symbols", "copies", "to_go", "final")
        schema = one([("conv", kind), ("block", T.LongType()), ("start", T.IntegerType()), ("to_go", ints), ("final", T.BooleanType()), ("ends", T.ArrayType(T.IntegerType()))])
        leads = leads.mapInArrow(_task(_leads, schema), schema).repartition("conv").sortWithinPartitions("conv", "block", "start")
        schema = one([("block", T.LongType()), ("start", T.IntegerType()), ("to_go", ints), ("final", T.BooleanType()), ("state", T.IntegerType()), ("alone", T.BooleanType())])
        forth = leads.mapInArrow(_task(_carry_forth, schema), schema).groupBy("block").agg(F.collect_list(F.struct("start", "to_go", "final", "state", "alone")).alias("edges"))

        solved = blocks.drop("edges").join(forth, "block")
        texts = rows.select(block, "pos", "conv", "turn", "role", "text")
        both = texts.unionByName(solved.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
        both = both.select("block", "pos", "conv", "turn", "role", "text", "symbols", "copies", "edges", "ends").repartition("block").sortWithinPartitions("block", "pos")
        turn_ = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
        long, whole = T.LongType(), T.BooleanType()
        schema = one([
            ("conv", kind), ("block", long), ("nth", long), ("whole", whole), ("edits", T.StringType()), ("turns", T.ArrayType(turn_)), ("cost", long), ("blank", long), ("seen", long), ("cut", long), ("illegal", long),
            ("first", long), ("last", long), ("lo", long), ("hi", long), ("n_turns", long),
        ])
        out = written(both.mapInArrow(_task(_slices, schema, size=lambda row: len(row[4]) + sum(len(t["text"]) for t in row[5])), schema), "repaired")
        kept(out)
        return out


def _summed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Slices in order -> a row for each conversation. The hash reads slices one after the other."""
    for conv, same in groupby(rows, lambda r: r[0]):
        digest, edits, sums, n_turns, lo, hi, last, any_ = hashlib.sha256(), [], [0] * 5, 0, None, None, None, False
        for _, letters, turns, cost, blank, seen, cut, illegal, first, last_, lo_, hi_, n_turns_ in same:
            edits.append(letters)
            for t in turns:
                digest.update(("\n" * any_ + t["role"] + ":" + t["text"]).encode())
                any_ = True
            sums = [a + b for a, b in zip(sums, (blank, seen, cut, illegal, cost), strict=True)]
            if first is not None and last is not None and (last, first) not in {(0, 1), (1, 2), (2, 1)}:
                sums[3] += 1
            last = last if last_ is None else last_
            if lo_ is not None:
                n_turns, lo, hi = n_turns + n_turns_ - (hi == lo_), lo_ if lo is None else lo, hi_
        yield conv, 0 if lo is None else hi - lo + 1 - n_turns, *sums, "".join(edits), digest.hexdigest()


def summaries(slices: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A row for each conversation of repair(): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Only
    conversations in several slices are brought together, in order, as their hash needs all texts one after the other."""
    names = [conv, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n_turns"), F.lit(0)).cast("long")
    alone = slices.where("whole").select("conv", gaps, "blank", "seen", "cut", "illegal", "cost", "edits", F.sha2(text, 256)).toDF(*names)
    schema = T.StructType([T.StructField(conv, slices.schema["conv"].dataType), *[T.StructField(x, T.LongType()) for x in names[1:7]], *[T.StructField(x, T.StringType()) for x in names[7:]]])
    rest = slices.where("not whole").repartition("conv").sortWithinPartitions("conv", "block", "nth")
    rest = rest.select("conv", "edits", "turns", "cost", "blank", "seen", "cut", "illegal", "first", "last", "lo", "hi", "n_turns")
    return alone.unionByName(rest.mapInArrow(_task(_summed, schema), schema))


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """turns with damaged role and text and the number of copies of each row (0: dropped), and no other columns, by crc32(conv:turn) modulo 20."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(text_of(conv), F.lit(":"), text_of(turn)).cast("binary")) % 20
    return turns.select(
        conv, turn, F.when(code == 4, "user").otherwise(text_of(role)).alias(role),
        F.when(code == 1, "").when(code == 2, F.translate(text_of(text), ".!?", "")).otherwise(text_of(text)).alias(text),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    )
