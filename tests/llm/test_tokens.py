import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from tenderlake.llm import byte_bpe, pretokens, token_counts

PIECES = ["'", "'s", "'re", "s", "t", "a", " ", "  ", "\n", "\t", "é", "1", "²", "!", "<|endoftext|>", "\xa0", "　", "😀", "́", "_", "the", "ing", "\x1c", "中", "Ⅷ", "aaaa", "▁", "ab"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    odd = ["".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 5, 30, 600]))) for _ in range(800)]
    return [*odd, None, None, "", "a" * 5000, "ab" * 3000, "é" * 3000, "x" * 100 + " " * 300 + "y", "one", "one"]


def test_counts_equal_the_library(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    out = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(df, limit=500).collect()}
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert out[i] == (len((t or "").encode()), n, n > 500), t
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_long_texts_are_cut_at_safe_places_only(texts, monkeypatch):
    whole = [t or "" for t in texts]
    a = token_counts._encoder(token_counts.model_path()).counts(whole)
    b = [x.tolist() for x in byte_bpe._codec(byte_bpe.ranks_path())[0].texts(whole)]
    monkeypatch.setattr(pretokens, "SLICE", 64)
    assert a.tolist() == token_counts._encoder(token_counts.model_path()).counts(whole).tolist()
    assert b == [x.tolist() for x in byte_bpe._codec(byte_bpe.ranks_path())[0].texts(whole)]


def test_ids_equal_the_library_and_decode_to_the_text(spark, texts):
    import public_tokenizers

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(byte_bpe.ranks_path()), special_tokens={})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("ids", F.lit(1))
    for r in byte_bpe.decode(byte_bpe.encode(df)).collect():
        t = texts[r["doc_id"]] or ""
        assert byte_bpe.unpack(r["ids"]).tolist() == own.encode_ordinary(t) and bytes(r["decoded"]) == t.encode()
    assert byte_bpe.encode(df.limit(0)).count() == 0


def test_a_full_cache_starts_anew():
    codec = byte_bpe.ByteBpe(byte_bpe.load_ranks(byte_bpe.ranks_path()))
    small, large = pretokens.Encoder(codec.encode, limit=50), pretokens.Encoder(codec.encode)
    for k in range(30):
        text = [" ".join(hashlib.md5(str(k * 100 + i).encode()).hexdigest() for i in range(40))]
        assert next(small.texts(text)).tolist() == next(large.texts(text)).tolist()
    assert small.n < 400


def test_a_full_cache_of_counts_starts_anew():
    encode = token_counts._encoder(token_counts.model_path()).encode
    small, large = (pretokens.Encoder(encode, pretokens.by_mark, " ", limit=limit) for limit in (50, 1 << 19))
    for k in range(30):
        text = [" ".join(hashlib.md5(str((k + i) % 35 if i < 12 else k * 100 + i).encode()).hexdigest() for i in range(40))]
        assert small.counts(text).tolist() == large.counts(text).tolist()


def test_models_that_change_texts_are_refused():
    class Model:
        vocab_size, id_to_piece = lambda self: 1, lambda self, i: "a"

        def normalize(self, text):
            return "▁" + text.replace(" ", "▁").lower().replace("ﬁ", "fi")

    with pytest.raises(ValueError):
        token_counts.check_pieces(Model())


def test_memory_of_the_cache_is_bounded_by_ids_and_long_pretokens():
    codec = byte_bpe.ByteBpe(byte_bpe.load_ranks(byte_bpe.ranks_path()))
    cached = pretokens.Encoder(codec.encode, limit=1000)
    for k in range(12):
        long = "".join(chr(0x4E00 + (i * 7919 + k) % 20000) for i in range(20_000))
        assert sum(map(len, cached.texts([long, "one two"]))) == len(codec.encode([long])[0]) + 2
    assert cached.kept[1] < 100 and len(cached.ids) < 200_000


def test_one_queue_for_many_pretokens_equals_one_each(monkeypatch):
    rng = random.Random(5)
    codec = byte_bpe.ByteBpe(byte_bpe.load_ranks(byte_bpe.ranks_path()))
    words = ["".join(rng.choices("aabethins é中", k=rng.randint(1, 60))) for _ in range(600)] + ["ab" * 400, "a" * 999]
    want = [codec.encode_pretoken(w.encode()) for w in words]
    for together, alone in ((2, 10**6), (10**9, 10**6), (5, 16)):
        monkeypatch.setattr(byte_bpe, "TOGETHER", together)
        monkeypatch.setattr(byte_bpe, "ALONE", alone)
        ids, size = codec.encode(words)
        at = size.cumsum()
        assert [ids[b - n : b].tolist() for b, n in zip(at.tolist(), size.tolist(), strict=True)] == want
