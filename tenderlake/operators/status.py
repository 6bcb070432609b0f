"""Progress of projects and bids. bids: id, project_id, processing_status, progress_completed_rules, progress_total_rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scores import price_scores

FINISHED = ["completed", "error"]


def completion_status(bids: DataFrame) -> DataFrame:
    """Per project: counts, whether all are finished, and the status that follows."""
    done = F.col("processing_status").isin(FINISHED)
    of = bids.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_bids"), F.count_if(F.col("processing_status") == "completed").alias("n_completed"), F.count_if(F.col("processing_status") == "error").alias("n_error"), F.count_if(~F.coalesce(done, F.lit(False))).alias("n_open"))
    status = F.when(F.col("n_open") > 0, "processing").when(F.col("n_error") > 0, "completed_with_errors").otherwise("completed")
    return of.withColumn("status", status)


#: Columns of bids that a report passes on as they are, where bids have them.
REPORTED = ["bidder_name", "error_message", "progress_current_rule", "detailed_progress_info"]


def progress_report(bids: DataFrame) -> DataFrame:
    """Per bid: rules done and in all, their share (0 without rules) and its project's share of finished bids, in percent;
    what else bids say of their progress; partial_analysis_results as JSON, null where it can't be read."""
    share = F.coalesce(F.try_divide(F.col("progress_completed_rules") * 100.0, F.col("progress_total_rules")), F.lit(0.0))
    own = Window.partitionBy("project_id")
    overall = F.count_if(F.col("processing_status").isin(FINISHED)).over(own) * 100.0 / F.count(F.lit(1)).over(own)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    said = [F.col(c) for c in REPORTED if c in bids.columns]
    if "partial_analysis_results" in bids.columns:
        said.append(F.to_json(F.try_parse_json("partial_analysis_results")).alias("partial_analysis_results"))
    counts = [zero("progress_completed_rules").alias("progress_completed"), zero("progress_total_rules").alias("progress_total")]
    return bids.select("id", "project_id", "processing_status", *counts, share.cast("double").alias("percent"), overall.cast("double").alias("overall_percent"), *said)


def recalc_gate(bids: DataFrame, results: DataFrame, rules: DataFrame) -> DataFrame:
    """Price scores of projects all of whose bids are finished."""
    ready = completion_status(bids).where("n_open = 0").select("project_id")
    return price_scores(results.join(ready, "project_id", "left_semi"), rules)


def project_overview(projects: DataFrame, bids: DataFrame, results: DataFrame) -> DataFrame:
    """All projects with their numbers of bids and results; created_at, where there is one, in ISO form."""
    n = lambda df, name: df.groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
    out = projects.join(n(bids, "bid_count"), "id", "left").join(n(results, "result_count"), "id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("bid_count", "result_count")})
    if "created_at" not in projects.columns:
        return out
    at = F.col("created_at").cast("timestamp")
    parts = F.when(F.date_format(at, "SSSSSS") != "000000", F.date_format(at, ".SSSSSS")).otherwise("")
    return out.withColumn("created_at", F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), parts))


def project_bidders(bids: DataFrame) -> DataFrame:
    return bids.select("project_id", "id", "bidder_name", "processing_status", "file_path", "file_size")
