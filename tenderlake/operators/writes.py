"""Idempotent changes of tables: replaced keys, patched rows, purged projects, migrated schemas."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import strip
from .scores import with_found_price_score

FAILED_RULE = "分析出错"  # fixed value: what a failed bid says it is working on


def replace_by_key(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target without the rows whose key new has, and the rows of new."""
    return target.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*target.columns).unionByName(new.select(*target.columns))


def patch_rows(target: DataFrame, patch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """target with the values of patch (one row a key) where they aren't blank; patched says which rows have got a value,
    even if it is the one they had."""
    named = patch.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = target.join(named, key, "left")
    filled = {c: F.coalesce(strip(F.col(f"_new_{c}").cast("string")) != "", F.lit(False)) for c in columns}
    new = {c: F.when(filled[c], F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    hit = reduce(lambda a, b: a | b, filled.values()) & F.coalesce("_hit", F.lit(False))
    return out.withColumns({**new, "patched": hit}).select(*target.columns, "patched")


def count_patched(patched: DataFrame, name: str = "patched_rows") -> tuple[DataFrame, Observation]:
    """patch_rows' result without its mark, and an observation whose ``get`` says how many rows were named and how many there
    were, as they are counted while the result is written: no second pass."""
    seen = Observation(name)
    counted = patched.observe(seen, F.count_if("patched").alias("patched"), F.count(F.lit(1)).alias("rows"))
    return counted.drop("patched"), seen


def purge_project(tables: dict[str, DataFrame], projects: DataFrame) -> dict[str, DataFrame]:
    """tables without the given projects (column id) and all rows of theirs: by project_id, or, where a table has none but
    names results (result_id), by the projects of those."""
    gone = projects.select(F.col("id").alias("project_id")).distinct()

    def left(name: str, df: DataFrame) -> DataFrame:
        if name == "tender_project":
            return df.join(gone.select(F.col("project_id").alias("id")), "id", "left_anti")
        if "project_id" in df.columns:
            return df.join(gone, "project_id", "left_anti")
        results = tables["analysis_result"].join(gone, "project_id", "left_semi").select(F.col("id").alias("result_id")).distinct()
        return df.join(results, "result_id", "left_anti")

    return {name: left(name, df) for name, df in tables.items()}


def migrate_rules(old: DataFrame) -> DataFrame:
    """Flat rules of the old shape in the new one: the name, cut at 20, is parent and child, maxima are integers."""
    name, top = F.substring("criteria_name", 1, 20), F.col("max_score").try_cast("int")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return old.select("id", "project_id", name.alias("Parent_Item_Name"), top.alias("Parent_max_score"), name.alias("Child_Item_Name"), top.alias("Child_max_score"), "description", flag("is_veto"), flag("is_price_criteria"))


def add_missing_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """df in the shape of schema, missing columns null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def check_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """field, exists, actual_type, n_values (rows that have one): the fields of schema and others that df has."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema}
    counts = df.agg(*[F.count(F.col(f"`{n}`")).alias(n) for n in actual])
    one = lambda n: F.struct(F.lit(n).alias("field"), F.lit(n in actual).alias("exists"), F.lit(actual.get(n)).cast("string").alias("actual_type"), (F.col(f"`{n}`") if n in actual else F.lit(0)).cast("long").alias("n_values"))
    return counts.select(F.explode(F.array(*[one(n) for n in [*schema.names, *(n for n in actual if n not in schema.names)]])).alias("x")).select("x.*")


def upsert_result(bids: DataFrame, results: DataFrame, analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New results and bids after analyses (the columns of results, and error): finished ones replace the result of their
    project and bid, failed ones set their bid's status, message and current rule. A price score of 0 or none gives way to that of the items."""
    good = analyses.where("error is null")
    asked = F.coalesce("price_score", F.lit(0.0)) == 0
    good = with_found_price_score(good, asked)
    new = replace_by_key(results, good, ["project_id", "bid_document_id"])
    failed = F.col("error").isNotNull()
    said = {"processing_status": F.when(failed, "error").otherwise("completed"), "error_message": F.col("error")}
    if "progress_current_rule" in bids.columns:
        said["progress_current_rule"] = F.when(failed, FAILED_RULE)
    named = analyses.select(F.col("bid_document_id").alias("id"), *[x.alias(c) for c, x in said.items()])
    return new, patch_rows(bids, named, "id", list(said)).drop("patched")
