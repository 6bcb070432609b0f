import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake.llm import embedding_dedup, minhash_dedup
from tenderlake.llm.components import connected

from . import brute


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 4000 + i) for i in range(300)]
    ids = sorted({i for x in links for i in x})
    want = brute.components(ids, links)
    got = dict(connected(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got.get(i, i) == want[i] for i in ids)
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def _links(rows, cosine):
    ok = {i: np.array(v, float) for i, v, lab in rows if v is not None and None not in v and lab is not None and np.isfinite(v).all() and np.dot(v, v) > 0}
    label = {i: lab for i, _, lab in rows}
    return [(a, b) for a in ok for b in ok if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= cosine]


@pytest.mark.parametrize(("block", "lengths", "sample"), [(8, 16, 4096), (512, 0, 4096), (4, 16, 5)])
def test_embedding_links_equal_brute_force(spark, monkeypatch, block, lengths, sample):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "LENGTHS", lengths)
    monkeypatch.setattr(embedding_dedup, "SAMPLE", sample)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centers[i % 12] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.3])], [1, 1, 2, None][i % 4]) for i in range(400)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0, 2.0], 1), (905, [1.0, 2.0], 1), (906, [], 1)]
    links = _links(rows, 0.93)
    comp = brute.components([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit(1)).withColumn("key", F.lit(1))
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link_vectors(df).collect()}
    assert out == {i: (n[i], comp[i], comp[i] == i) for i in n}
    assert embedding_dedup.link_vectors(df.limit(0)).count() == 0


def _documents(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for group in range(40):
        base = [words[k] for k in rng.integers(0, 3000, rng.integers(3, 200))]
        for _ in range(int(rng.choice([1, 2, 30]))):
            copy = [w if rng.random() > rng.choice([0, 0.03, 0.06, 0.1]) else words[rng.integers(0, 3000)] for w in base]
            rows.append((i, " ".join(copy) if rng.random() > 0.1 else "\n".join(copy).upper()))
            i += 1
    return [*rows, (i, None), (i + 1, ""), (i + 2, " \t"), (i + 3, "one"), (i + 4, "ONE"), (i + 5, "one one"), (i + 6, "one one"), (i + 7, "é É"), (i + 8, "é É")]


@pytest.mark.parametrize("block", [16, 512])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rows = _documents(spark)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(df, width=2).collect()}
    assert out == brute.near_duplicates(dict(rows))
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_repeated_and_null_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")], "doc_id long, text string")
    out = [(r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df, width=2).collect()]
    assert sorted(out, key=str) == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]


def test_rows_of_one_id_with_different_texts_are_linked(spark):
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    near = [x + " more" for x in base]
    rows = [(1, base[0]), (1, base[1]), (2, near[0]), (3, near[1]), (4, base[2]), (5, base[3]), (6, near[2]), (6, near[3]), (7, base[3] + " other words " + base[0])]
    out = {(r["doc_id"], r["component_id"]) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert out == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7)}


def test_near_duplicates_on_the_small_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(rows, width=2).collect()}
    assert out == brute.near_duplicates(dict(rows.collect()))


def test_tiny_and_huge_vectors_and_vectors_of_one_id(spark):
    rows = [
        (1, [1e-170, 1e-170], 0), (2, [1e-170, 1e-170], 0), (3, [1e200, 1e200], 0), (4, [5e-324, 5e-324], 0), (5, [-1e308, 1e308], 0), (6, [-2e-300, 2e-300], 0), (7, [1e308, 5e-324], 0),
        (11, [1.0, 0.0, 0.0], 1), (12, [0.99, 0.01, 0.0], 1), (11, [0.0, 1.0, 0.0], 1), (13, [0.0, 0.99, 0.01], 1), (14, [0.01, 0.99, 0.0], 1), (None, [1.0, 0.0, 0.0], 1), (15, [0.0, 0.0, 1.0], None),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link_vectors(df).collect())
    small = [(i, 3, 1, i == 1) for i in (1, 2, 3, 4)] + [(5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)]
    ones = [(11, 1, 11, True), (11, 2, 11, True), (12, 1, 11, False), (13, 2, 11, False), (14, 2, 11, False), (0, 0, None, True), (15, 0, 15, True)]
    assert got == sorted(small + ones, key=lambda r: (r[0], r[1], str(r[2]), r[3]))
