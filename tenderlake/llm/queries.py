"""The registered queries of this subpackage: thin uses of the operators over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroids, chat, credential_scan, embedding_dedup, minhash_dedup, packing, quality, repair, suffix_dedup, token_counts, token_files, warc
from .common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), limit=4096).drop("text")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(_table(spark, sf_dir, "pages"))
    pages = warc.resolved(warc.read(spark, archives))
    sound = F.when(F.col("problem").isNull(), F.col("payload_digest")).otherwise(F.raise_error(F.col("problem")))
    return pages.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = credential_scan.digest(credential_scan.scan(docs, keep=["doc_id"]))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = quality.judge_quality(docs.select("doc_id", "lang", "text"), labels)
    return out.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), path)
    return token_files.documents(spark, path).select("doc_id", "start", "n_tokens", token_files.ids_crc32("ids").alias("ids_crc32"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.cluster(_table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = repair.damage(_table(spark, sf_dir, "conversations"))
    return repair.summaries(repair.repair(damaged, copies="copies"))


_ROUNDS = ", ".join(
    f"""a{r} AS MATERIALIZED (
            SELECT n, vec_id, e, min(struct_pack(d := d, c := c)) AS best
            FROM (SELECT n, vec_id, v.e, c, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r} c) x GROUP BY ALL
        ), m{r} AS (SELECT c, i, sum(x) AS s, count(*) AS k FROM (SELECT best.c AS c, unnest(range(64)) AS i, unnest(e) AS x FROM a{r}) y GROUP BY c, i),
        c{r + 1} AS MATERIALIZED (
            SELECT o.c, coalesce(l.e, o.e) AS e FROM c{r} o LEFT JOIN (SELECT c, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY i) AS e FROM m{r} GROUP BY c) l ON l.c = o.c
        )"""
    for r in range(11)
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_warc": op4_warc,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_secret_scan": op7_secret_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_format": op10_chat_format,
    "op11_token_files": op11_token_files,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE: dict[str, str] = {
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.93
        ), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least.b, vec_id)) AS kept
        FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id""",
    "op4_warc": """
        WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
    "op12_centroid_clusters": f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT place - 1 AS c, e FROM (SELECT e, row_number() OVER (ORDER BY sha256('3:' || vec_id), vec_id, n) AS place FROM v WHERE vec_id IS NOT NULL) x WHERE place <= 8
        ), {_ROUNDS}
        SELECT vec_id, best.c::INT AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
            sha256(array_to_string(c10.e, ',')) AS centroid_sha256
        FROM a10 JOIN c10 ON c10.c = best.c""",
    # Costs to go by state (q0 at the start, q1 after system, q2 after user, q3 after assistant) with letters and lines, from the last turn to the first.
    "op13_conversation_repair": """
        WITH RECURSIVE d AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295::UBIGINT, list_reduce(
                list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))) % 20 AS code FROM conversations
        ), e AS (
            SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d
        ), f AS (
            SELECT *, left(role, 1) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM e
        ), g AS MATERIALIZED (
            SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS before, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd' WHEN right(bare, 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS fault FROM f
        ), r AS (
            SELECT conv_id, max(n) AS n, {'c': 0, 'a': '', 't': ''} AS q0, {'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS q1, {'c': 5, 'a': 'I', 't': chr(10) || 'assistant:'} AS q2, {'c': 0, 'a': '', 't': ''} AS q3
            FROM g GROUP BY conv_id
            UNION ALL
            SELECT conv_id, n - 1, list_min([q0, {'c': q2.c + 5, 'a': 'I' || q2.a, 't': chr(10) || 'user:' || q2.t}]), list_min([q1, {'c': q2.c + 5, 'a': 'I' || q2.a, 't': chr(10) || 'user:' || q2.t}]), q2, q3 FROM (
                SELECT conv_id, n, q0, q1, list_min([q2, {'c': q3.c + 5, 'a': 'I' || q3.a, 't': chr(10) || 'assistant:' || q3.t}]) AS q2, list_min([q3, {'c': q2.c + 5, 'a': 'I' || q2.a, 't': chr(10) || 'user:' || q2.t}]) AS q3 FROM (
                    SELECT r.conv_id, r.n,
                        list_min([{'c': q0.c + 2, 'a': 'D' || q0.a, 't': q0.t}, CASE WHEN stays THEN as_user END, CASE WHEN stays AND i = 's' THEN {'c': q1.c + x, 'a': 'K' || q1.a, 't': line || q1.t} END, CASE WHEN stays AND i = 'u' THEN kept_user END]) AS q0,
                        list_min([{'c': q1.c + 2, 'a': 'D' || q1.a, 't': q1.t}, CASE WHEN stays THEN as_user END, CASE WHEN stays AND i = 'u' THEN kept_user END]) AS q1,
                        list_min([{'c': q2.c + 2, 'a': 'D' || q2.a, 't': q2.t}, CASE WHEN stays THEN {'c': q3.c + x + 1, 'a': 'R' || q3.a, 't': chr(10) || 'assistant:' || text || q3.t} END, CASE WHEN stays AND i = 'a' THEN {'c': q3.c + x, 'a': 'K' || q3.a, 't': line || q3.t} END]) AS q2,
                        list_min([{'c': q3.c + 2, 'a': 'D' || q3.a, 't': q3.t}, CASE WHEN stays THEN as_user END, CASE WHEN stays AND i = 'u' THEN kept_user END]) AS q3
                    FROM (
                        SELECT r.*, i, text, fault NOT IN ('b', 'd') AS stays, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS x, chr(10) || role || ':' || text AS line,
                            {'c': q2.c + x + 1, 'a': 'R' || q2.a, 't': chr(10) || 'user:' || text || q2.t} AS as_user, {'c': q2.c + x, 'a': 'K' || q2.a, 't': line || q2.t} AS kept_user
                        FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.n = r.n
                    ) r
                ) o
            ) p
        ), s AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id
        )
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(q0.c, 0)::BIGINT AS cost, coalesce(q0.a, '') AS audit, sha256(coalesce(substr(q0.t, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.n = 0""",
    "op10_chat_format": """
        WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '<\\|im_') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS n FROM conversations),
        p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
        r AS (
            SELECT t.conv_id, perspective, n, n // 64 AS block_no, text || '<|im_end|>' || chr(10) AS body, speaker = perspective AS own,
                '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || translate(replace(speaker, '<|im_', '<\\|im_'), chr(10) || chr(13), '  ') END || chr(10) AS head
            FROM t JOIN p ON t.conv_id = p.conv_id
        ), s AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, block_no ORDER BY n) AS stop FROM r),
        b AS (
            SELECT conv_id, perspective, block_no, count(*) AS n_turns, max(stop) AS chars, string_agg(head || body, '' ORDER BY n) AS rendered,
                string_agg(CASE WHEN own THEN (stop - length(body))::BIGINT || ':' || stop::BIGINT END, ',' ORDER BY n) AS mask
            FROM s GROUP BY conv_id, perspective, block_no
        )
        SELECT conv_id, perspective, block_no::BIGINT AS block_no, n_turns, coalesce(sum(chars) OVER (PARTITION BY conv_id, perspective ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_offset,
            rendered, coalesce(mask, '') AS mask FROM b""",
}
