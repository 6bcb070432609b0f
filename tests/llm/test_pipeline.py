import os
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tenderlake.llm import credential_scan, packing, quality

from . import brute

SF = "/root/testdata/sf0.01"


def _shingles(text):
    words = brute.WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_stages_equal_brute_force(spark):
    rows, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        rows[name] = docs.collect()
        if name != "best-fit packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        before.unpersist()
    text = {n: {r["doc_id"]: r["text"] for r in rows[n]} for n in list(rows)[:4]}
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    # Quality: the base rules by brute force; what else goes reaches a chosen cutoff.
    judged = quality.filter_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(text["quality rules"]) == {r[0] for r in judged.where("kept").select("doc_id").collect()}
    assert all(not brute.quality(t)[-1] for t in text["quality rules"].values())
    # Near-duplicates.
    sets = {i: _shingles(t) for i, t in text["quality rules"].items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = brute.components(ids, links)
    assert set(text["near duplicates"]) == {i for i in ids if comp[i] == i}
    # Repeated passages.
    cut = brute.repeats(list(text["near duplicates"].items()))
    assert set(text["repeated passages"]) == {i for i, (n, gone, _, _) in cut.items() if not n or gone < n}
    assert all(0 <= cut[i][0] - cut[i][1] - len(t.encode()) <= 6 * cut[i][2] for i, t in text["repeated passages"].items())  # a cut may split a character at both ends
    # Secrets: none of the base kinds is left, and texts without any stay as they were.
    assert set(text["secrets"]) == set(text["repeated passages"])
    for i, t in text["repeated passages"].items():
        if not any(brute.secrets(t)[:3]) and not re.search(credential_scan.PARTS, t):
            assert text["secrets"][i] == t
    assert not any(any(brute.secrets(t)[:3]) for t in text["secrets"].values())
    # Packing.
    check_packing(rows["best-fit packing"], text["secrets"])
    assert len(source) == 1000


def check_packing(rows, texts, capacity=2048):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(ids[at : at + r["length"]].tobytes())) and (k == 0 or r["length"] == capacity)
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert len(by_sequence) <= 1.02 * sum(r["length"] for r in rows) / capacity + 1


def test_packing_of_odd_texts(spark):
    texts = {1: None, 2: "", 3: "a <|endoftext|> b", 4: "word " * 9000, 5: " ", 6: "é\n" * 700}
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in texts.items()], "doc_id long, text string, piece int, part string")
    pieces = packing.token_pieces(df).selectExpr("doc_id", "part", "piece", "start", "length", "crc32(ids) as ids_crc32")
    check_packing(packing.pack(pieces).collect(), texts)
    assert packing.pack(pieces.limit(0)).count() == 0


def test_patterns_use_every_piece_once():
    rng = np.random.default_rng(2)
    for high in (5, 300, 2048):
        lengths, n = np.unique(rng.integers(1, high + 1, 5000), return_counts=True)
        counts = dict(zip(lengths.tolist(), n.tolist(), strict=True))
        used: dict[int, int] = {}
        bins = packing.patterns(counts)
        for pattern, times in bins:
            assert sum(pattern) <= 2048
            for k in pattern:
                used[k] = used.get(k, 0) + times
        assert used == counts
        assert sum(t for _, t in bins) <= 1.01 * sum(k * n for k, n in counts.items()) / 2048 + 1


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (6, "é" * 300), (7, "x" + "é" * 300), (8, "word " * 20_000), (9, " ".join(f"w{i}" for i in range(400))), (9, " ".join(f"w{i}" for i in range(400))), (10, "Password = abcdefgh " + "".join(f"{i} " for i in range(300)))]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, name):
    """Nulls in every column, empty, blank and very long texts, repeated rows, a column of a clashing name, no rows."""
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(i, t, None if i == 4 else "en", None, None, "x", 1) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, spans int")
    out = stage(spark, docs, SF).collect()
    ids = sorted(str(r["doc_id"]) for r in out)
    if name == "quality rules":
        assert ids == ["10", "9", "9"]
    elif name == "near duplicates":
        # One row of each group stays, with rows that repeat it; texts without words, and rows without an id, link with nothing.
        assert ids == sorted(["1", "2", "3", "4", "None", "6", "7", "8", "9", "9", "10"])
    elif name == "repeated passages":
        text = {r["doc_id"]: r["text"] for r in out}
        assert len(ids) == len(ODD) and text[7] == "x" and text[6] == "é" and len(text[8]) < 200
    elif name == "secrets":
        assert len(ids) == len(ODD) and all("abcdefgh" not in (r["text"] or "") for r in out)
    else:
        assert {str(i) for i, _ in ODD} == set(ids) and all(0 < r["length"] <= 2048 for r in out)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_gives_the_last_stage_and_keeps_no_other(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    folders = {f.split("/pipeline-")[1].split("/")[0].rsplit("-", 1)[0] for f in out.inputFiles()}
    assert folders == {"best-fit-packing"}
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    left = {x.rsplit("-", 1)[0] for x in os.listdir(shared) if x.startswith("pipeline-")}
    assert left == {"pipeline-best-fit-packing"}
    ids = {r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in out.collect()} <= ids and all(0 < r["length"] <= 2048 for r in out.collect())
