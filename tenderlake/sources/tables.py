"""The tables of the domain with fixed schemas, page caches, changed files, JSON export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "tender_project": "id long, project_code string, name string, description string, tender_file_path string, scoring_rules_summary string, created_at timestamp, status string",
    "bid_document": "id long, project_id long, bidder_name string, file_path string, file_size long, upload_time timestamp, processing_status string, error_message string, progress_total_rules int, progress_completed_rules int, progress_current_rule string, partial_analysis_results string, detailed_progress_info string, failed_pages_info string, price_extraction_attempts int, price_extraction_error string, price_extracted boolean",
    "analysis_result": "id long, project_id long, bid_document_id long, bidder_name string, total_score double, price_score double, extracted_price double, detailed_scores string, dynamic_scores string, analysis_summary string, analyzed_at timestamp, scoring_method string, ai_model string, is_modified boolean, original_scores string, modification_count int, last_modified_at timestamp, last_modified_by string",
    "scoring_rule": "id long, project_id long, Parent_Item_Name string, Parent_max_score int, Child_Item_Name string, Child_max_score int, description string, is_veto boolean, is_price_criteria boolean, price_formula string",
    "score_modification_history": "id long, result_id long, modified_by string, modified_at timestamp, old_scores string, new_scores string, reason string",
    "project_audit_log": "id long, project_id long, operation string, operation_details string, created_at timestamp",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The six tables under path; columns that a table lacks are null."""
    return {name: spark.read.schema(schema(name)).parquet(f"{path}/{name}") for name in SCHEMAS}


def load_page_cache(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """doc_path, page_no, text of cached page texts: JSON objects with file_path and pages_text, one a file or one a line."""
    files = spark.read.schema("file_path string, pages_text array<string>").option("multiLine", multi_line).json(path)
    return files.select(F.col("file_path").alias("doc_path"), F.posexplode("pages_text").alias("page_no", "text"))


def changed_documents(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (path, length, modificationTime) whose key, md5 of path|size|seconds, isn't in cache (key)."""
    seconds = F.floor(F.unix_micros(F.col("modificationTime").cast("timestamp")) / 1_000_000).cast("long")
    keyed = files.withColumn("key", F.md5(F.concat_ws("|", "path", F.col("length").cast("string"), seconds.cast("string"))))
    return keyed.join(cache.select("key").distinct(), "key", "left_anti")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object a row, with nulls, text as it is."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
