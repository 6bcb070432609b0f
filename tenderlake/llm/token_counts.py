"""Token counts of whole texts without writing or shuffling a single pre-token.

Two tiers: a compact broadcast table holds the token counts of the pre-tokens that are frequent over the whole corpus;
what it misses is encoded once a worker and kept in that worker's bounded cache. A subword model whose pieces hold the
word mark only at their front never merges over a place where a mark follows another character, so the sum over
pre-tokens is the count of the whole text; ``check_pieces`` refuses a model for which that doesn't hold, or which changes
characters before it cuts. Pre-tokens are told apart by 64-bit hashes.

Edge cases: null text counts as empty (0 bytes, 0 tokens); texts of any length are counted whole; repeated rows each get
their row; an empty table gives an empty result; columns n_bytes, n_tokens and over_limit of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import frugal, small_batches

HOT = 1 << 16  # entries of the broadcast table: 10 bytes each, so at most 0.7 MB
PER_TASK = 1 << 13  # entries of a task's summary
_KEPT = 1 << 17  # counters a task holds before it prunes


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def check_pieces(model) -> None:
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError("pieces with a word mark after another character: counts by pre-token would differ")
    probe = "ﬁＡ①e\u0301  b\t\u3000 "
    if model.normalize(probe) != "▁" + probe.replace(" ", "▁"):
        raise ValueError("the model normalises texts: counts by pre-token would differ")


_models: dict = {}


def _encoder(path: str) -> pretokens.Encoder:
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        check_pieces(model)
        # The library puts one mark before a text: it stands for the first mark of the pre-token.
        # A lone mark is left when a text ends in one blank; an empty text would get no mark.
        lone = [model.piece_to_id("▁")] if not model.is_unknown(model.piece_to_id("▁")) else [0] * 3

        def sizes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """No ids, as only their number counts."""
            got = model.encode([s[1:] for s in strings], num_threads=1)
            return np.zeros(0, np.int32), np.array([len(lone if len(s) == 1 else ids) for s, ids in zip(strings, got, strict=True)], np.int64)

        _models[path] = pretokens.Encoder(sizes, pretokens.by_mark, " ")
    return _models[path]


def _summaries(path: str, text: str):
    """A task's most frequent pre-tokens: hash, tokens, occurrences. Counters are pruned, so a task's memory is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        keys, seen, tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            for parts, _ in pretokens.slices(texts, " "):
                b = pretokens.Batch(parts, pretokens.by_mark)
                h, first, n = np.unique(b.hash[b.length <= pretokens.LONG], return_index=True, return_counts=True)
                short = np.flatnonzero(b.length <= pretokens.LONG)
                often = n > 1
                h, n, at = h[often], n[often], short[first[often]]
                known = np.searchsorted(keys, h)
                known[known == len(keys)] = 0
                old = keys[known] == h if len(keys) else np.zeros(len(h), bool)
                seen[known[old]] += n[old]
                new = ~old
                strings = [b.string(i) for i in at[new]]
                size = encoder.encode(strings)[1]
                keys, seen, tokens = np.concatenate([keys, h[new]]), np.concatenate([seen, n[new]]), np.concatenate([tokens, size])
                if len(keys) > _KEPT:
                    top = np.argpartition(-seen, _KEPT // 4)[: _KEPT // 4]
                    keys, seen, tokens = keys[top], seen[top], tokens[top]
                order = np.argsort(keys)
                keys, seen, tokens = keys[order], seen[order], tokens[order]
        top = np.argsort(-seen, kind="stable")[:PER_TASK]
        yield pa.RecordBatch.from_arrays([pa.array(keys[top].view(np.int64)), pa.array(tokens[top]), pa.array(seen[top])], ["hash", "tokens", "seen"])

    return run


def frequent_pretokens(docs: DataFrame, path: str, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes and token counts of at most HOT frequent pre-tokens. Every task reads all its texts and hands on at most
    PER_TASK rows, which are summed by hash; the occurrences themselves are never shuffled. Which pre-tokens are in the
    table changes the speed only, never a count."""
    spread = docs.select(text).mapInArrow(frugal(_summaries(path, text)), "hash long, tokens long, seen long")
    top = spread.groupBy("hash").agg(F.first("tokens").alias("tokens"), F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "hash").limit(HOT)
    rows = top.select("hash", "tokens").toArrow()
    return rows.column("hash").to_numpy().view(np.uint64), rows.column("tokens").to_numpy().astype(np.uint16)


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, limit: int = 4096) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    path, docs = path or model_path(), small_batches(docs)
    table = docs.sparkSession.sparkContext.broadcast(frequent_pretokens(docs, path, text))

    @F.arrow_udf("long")
    @frugal
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, (keys, sizes) = _encoder(path), table.value
        hot = pretokens.HashTable(max(1, len(keys)))
        hot.add(keys, sizes.astype(np.int32))
        for batch in batches:
            texts = [x or "" for x in batch.to_pylist()]
            out = np.zeros(len(texts), np.int64)
            for parts, owner in pretokens.slices(texts, " "):
                b = pretokens.Batch(parts, pretokens.by_mark)
                size = hot.find(b.hash).astype(np.int64)
                size[b.length > pretokens.LONG] = -1
                missed = np.flatnonzero(size < 0)
                b.hash, b.begin, b.length = b.hash[missed], b.begin[missed], b.length[missed]
                entry = encoder.entries(b)
                size[missed] = encoder.size[entry]
                out += np.bincount(np.asarray(owner)[b.text_of], weights=size, minlength=len(texts)).astype(np.int64)
            yield pa.array(out)

    keep = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    out = docs.select(*[docs[c] for c in keep], F.octet_length(F.coalesce(docs[text], F.lit(""))).cast("long").alias("n_bytes"), tokens(docs[text]).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
