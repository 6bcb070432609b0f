"""A training corpus from ``documents``: quality rules, near-dedup, repeated passages, secrets, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the DataFrame that, written as Parquet
and read again, is the next one's docs. All but the last return the columns of documents.

Edge cases, the same at every size: a null or empty text fails the base rules of the first stage; a stage that meets one all
the same keeps it (near duplicates: it links with nothing; repeated passages: it is empty afterwards; packing: the end id
alone). Texts of any length are taken whole. Rows with a null id link with nothing and lose nothing; a null language is a
stratum of its own; other nulls are passed on. Repeated rows are judged, cleaned and packed each, and count as one document
where documents are compared. No rows give no rows. Columns beside those of documents are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm import credential_scan, minhash_dedup, packing, quality, suffix_dedup
from tenderlake.llm.common import forget, written

CACHED = 1 << 18  # pre-tokens that a packing worker keeps, few, as workers of the stages before are still there
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text) -> DataFrame:
    """docs with another text and its length."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor a risk-controlled cutoff rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.filter_quality(docs.select(*COLUMNS), labels)
    return judged.where(F.expr("if(kept, 1, 0) = 1")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near-duplicates (five-word shingles, similarity of 0.8)."""
    dropped = minhash_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages that came earlier, and without what a cut leaves of a character that it has
    split; documents of which nothing is left go."""
    out = suffix_dedup.remove_repeats(docs).where("n_bytes = 0 or n_removed < n_bytes")
    return _with_text(out, F.col("kept_text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with marks in place of secrets."""
    return _with_text(credential_scan.redact(credential_scan.scan(docs.select(*COLUMNS))), F.col("text"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in training sequences of 2048 tokens."""
    pieces = packing.token_pieces(docs.select("doc_id", "source", "text"), cached=CACHED)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("secrets", secrets), ("best-fit packing", best_fit_packing)]
#: Suffix arrays, MinHash components and tokenizers have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's output is deleted once the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        forget(before)
    return docs
