import binascii
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tenderlake.llm import repair

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    """(conv, turn, role, text) of each row that is left, and all conversations."""
    out, convs = [], set()
    for conv, turn, role, text in rows:
        convs.add(conv)
        key = (" " if conv is None else str(conv)) + ":" + (" " if turn is None else str(turn))
        role, text, code = role if role is not None else " ", text if text is not None else " ", binascii.crc32(key.encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out, convs


def cheapest(turns):
    """(cost, letters, repaired) of one conversation: the best of every state from the end, letters compared as strings."""
    adds = {"": "u", "s": "u", "u": "a", "a": "u"}
    seen, faults = set(), []
    for role, text in turns:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = {"": (0, "", ()), "a": (0, "", ())}
    for state in ("u", "s"):
        name = "user" if adds[state] == "u" else "assistant"
        c = best[adds[state]]
        best[state] = (c[0] + 5, "I" + c[1], ((name, ""), *c[2]))
    for (role, text), fault in reversed(list(zip(turns, faults))):
        after, now = best, {}
        for state in ("", "s", "u", "a"):
            some = [(2 + after[state][0], "D" + after[state][1], after[state][2])]
            if fault not in ("blank", "duplicate"):
                cost = 5 if fault == "truncated" else 0
                legal = {adds[state]} | ({"s"} if state == "" else set())
                if role[:1] in legal:
                    x = after[role[0]]
                    some.append((cost + x[0], "K" + x[1], ((role, text), *x[2])))
                x = after[adds[state]]
                some.append((cost + 1 + x[0], "R" + x[1], (({"u": "user", "a": "assistant"}[adds[state]], text), *x[2])))
            now[state] = min(some, key=lambda x: x[:2])
        for _ in range(4):
            for state in now:
                x = now[adds[state]]
                now[state] = min(now[state], (x[0] + 5, "I" + x[1], (({"u": "user", "a": "assistant"}[adds[state]], ""), *x[2])), key=lambda x: x[:2])
        best = now
    return faults, best[""]


def expected(rows):
    left, convs = damaged(rows)
    by = defaultdict(list)
    for conv, *rest in left:
        by[conv].append(rest)
    out = {}
    for conv in convs:
        all_ = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, (cost, letters, new) = cheapest([tuple(r[1:]) for r in all_])
        turns = {r[0] for r in all_ if r[0] is not None}
        initials = [r[1][:1] for r in all_]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        digest = hashlib.sha256("\n".join(r + ":" + t for r, t in new).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, letters, digest)
    return out


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    slices = repair.repair(repair.damage(df), copies="copies", **options)
    found = repair.summaries(slices).collect()
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: tuple(r[1:]) for r in found}


def _random(n, seed, convs=40, turns=14):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["Yes.", "no", "", " \n", "Who? ", "Go!\t", "cut off", None, "é…", "a.b"]
    return [(r.choice([None, *range(convs)]), r.choice([None, *range(turns), *range(turns)]), r.choice(roles), r.choice(texts) if r.random() < 0.3 else f"turn {r.random()}" + r.choice([".", "", "?\n"])) for _ in range(n)]


@pytest.mark.parametrize("bits", [12, 3, 0])
def test_random_conversations_equal_brute_force(spark, bits):
    rows = _random(900, 5) + _random(60, 6, 2, 9) * 4
    assert got(spark, rows, block_bits=bits) == expected(rows)


def test_a_conversation_over_many_blocks_and_slices(spark, monkeypatch):
    r = random.Random(9)
    hot = [(7, i, r.choice(["user", "assistant"]) if i % 9 == 0 else ("user", "assistant")[i % 2], f"{i} " + "long " * 40 + r.choice([".", ".", ""])) for i in range(9000)]
    same = [(8, 3, "user", "the same.")] * 500 + [(9, i, "user", "the same.") for i in range(500)]
    rows = hot + same + [(i, t, ("user", "assistant")[t % 2], f"{t}.") for i in range(20, 60) for t in range(6)]
    assert got(spark, rows, block_bits=6) == expected(rows)
    assert got(spark, rows) == expected(rows)


def test_whole_table_and_query(spark):
    from tenderlake.llm.queries import op13_conversation_repair

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = op13_conversation_repair(spark, sf)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == expected(rows)


def test_empty_tables_and_odd_columns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.summaries(repair.repair(empty)).collect() == []
    odd = spark.createDataFrame([("x", 1, "user", "Hi.", 1, 2, 3, 4), ("x", 2, "assistant", "Yes.", 1, 2, 3, 4)], "conv_id string, turn int, role string, text string, copies int, conv int, block int, edits int")
    (row,) = repair.repair(odd).collect()
    assert (row["edits"], row["whole"], [tuple(t) for t in row["turns"]]) == ("KK", True, [("user", "Hi."), ("assistant", "Yes.")])
    damaged_ = repair.damage(odd)
    assert [r["audit"] for r in repair.summaries(repair.repair(damaged_, copies="copies")).collect()]


def test_runs_equal_single_turns():
    r = random.Random(3)
    for _ in range(200):
        symbols = bytes(r.choice([0, 3, 4, 7, 8, 12, 15, 1, 2]) for _ in range(r.randint(1, 30)))
        copies = np.array([r.choice([1, 1, 1, 5, 70]) for _ in symbols])
        m = repair.matrix_of(repair.runs_of(symbols, copies))
        one = None
        for s, n in zip(symbols, copies):
            for k in range(n):
                p = repair.power(repair.GONE if k or s & 3 in (1, 2) else s, 0)
                one = p if one is None else repair._times(one, p)
        assert repair._back(m, repair.TO_GO) == repair._back(one, repair.TO_GO)
