"""The registered queries themselves, over whole small tables: columns, types and rows as the contracts say."""

import hashlib

import numpy as np
import pytest

from tenderlake.llm import byte_bpe, packing, queries, token_counts

from . import brute
from .test_pipeline import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def rows_of(spark, name, kinds):
    df = queries.QUERIES[name](spark, SF)
    assert {f.name: f.dataType.simpleString() for f in df.schema}.items() >= kinds.items()
    rows = df.collect()
    return [r.asDict() for r in rows]


def test_op1(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    rows = rows_of(spark, "op1_token_counts", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"})
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        n = len(model.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 4096)


def test_op3(spark, texts):
    import public_tokenizers
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(byte_bpe.ranks_path()), special_tokens={})
    rows = rows_of(spark, "op3_byte_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        ids = own.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op5(spark, texts):
    rows = rows_of(spark, "op5_minhash_dedup", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"})
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute.near_duplicates(texts) and len(rows) == len(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_op6(spark, texts):
    kinds = {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    df = queries.QUERIES["op6_best_fit_packing"](spark, SF)
    assert {f.name: f.dataType.simpleString() for f in df.schema}.items() >= kinds.items()
    check_packing(df.collect(), texts, packing.CAPACITY)


def test_op7(spark, texts):
    rows = rows_of(spark, "op7_secret_scan", {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"})
    assert len(rows) == len(texts)
    for r in rows:
        *counts, digest, spans = brute.secrets(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts and r["base_sha256"] == digest and set(filter(None, spans.split(","))) <= set(r["spans"].split(","))


def test_op8(spark, texts):
    rows = rows_of(spark, "op8_suffix_dedup", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"})
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute.repeats(list(texts.items())) and len(rows) == len(texts)


def test_op9(spark, texts):
    rows = rows_of(spark, "op9_quality_rules", {"doc_id": "bigint", **dict.fromkeys(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], "bigint"), "base_failed": "boolean", "kept": "boolean"})
    assert len(rows) == len(texts)
    for r in rows:
        want = brute.quality(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want and not (r["base_failed"] and r["kept"])
