import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake.llm import suffix_dedup

from . import brute


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(1)
    for n in [*range(1, 40), 500, 3000]:
        for high in (2, 3, 250):
            s = rng.integers(1, high, n)
            assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist()), (n, high)


def _documents():
    rng = np.random.default_rng(4)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = [word(k) for k in (99, 100, 101, 170, 400)]
    rows = [(i, word(int(rng.integers(0, 300))) + shared[int(rng.integers(5))] + word(int(rng.integers(0, 90)))) for i in range(120)]
    rows += [(200, "é" * 300), (201, "é" * 40), (202, "a" * 350), (203, None), (204, ""), (205, "ab" * 90 + shared[4]), (206, shared[3] * 3), (150, rows[3][1]), (151, rows[3][1] + "x")]
    return rows


@pytest.mark.parametrize(("crowd", "bits"), [(3, 27), (4096, 27), (3, 6)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, crowd, bits):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "FILTER_BITS", bits)  # with 6 bits places are joined to the texts
    rows = _documents()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, kept int, got int").repartition(5)
    out = suffix_dedup.remove_repeats(df).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in out} == brute.repeats(rows)


def test_no_rows_null_ids_and_repeated_rows(spark):
    text = "x1 y2 " * 60
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text)], "doc_id long, text string")
    out = sorted((str(r["doc_id"]), r["n_removed"]) for r in suffix_dedup.remove_repeats(df).collect())
    assert out == [("1", 354), ("1", 354), ("2", 360), ("None", 0)]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_small_table_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(rows).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in out} == brute.repeats([tuple(r) for r in rows.collect()])


def test_rows_of_one_id_with_different_texts(spark):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared, other, long = word(300), word(400), word(250)
    rows = [(1, shared + word(50)), (2, word(20) + shared), (2, other), (3, long), (3, long + word(60)), (3, long)]
    out = {r["text"]: r["n_removed"] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[rows[0][1]] == 0 and out[rows[1][1]] == 300 and out[rows[2][1]] == 0
    assert sorted([out[rows[3][1]], out[rows[4][1]]]) == [0, 250]  # either text of id 3 may come first


def test_split_characters_leave_the_text(spark):
    rows = [(1, "é" * 60 + "1"), (2, "x" + "é" * 60 + "2"), (3, "aé" * 70), (4, "é" * 3 + "aé" * 70)]
    for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=101).collect():
        assert "\ufffd" not in r["kept_text"] and set(r["kept_text"]) <= set(r["text"]) and bytes(r["kept"]).decode("utf-8", "ignore") == r["kept_text"]
    with pytest.raises(ValueError):
        suffix_dedup.repeated_runs(spark.createDataFrame([], "id long, tie long, text string"), 10)
