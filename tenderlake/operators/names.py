"""Bidder names out of page texts and tables. pages: doc_id, page_no, text; tables: doc_id, table_no, headers, data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import let
from ..functions.text import NOT_COMPANY_WORDS, filter_bidder_name, garbled_name, valid_company_name
from .pages import leading_pages, page_set_union, tag_sections

# Where names stand.
LINE_NAMES = [r"投\s*标\s*人\s*[:：\s]([^\n]+)", r"投标(?:人|单位|方)名称\s*[:：\s]([^\n]+)", r"供\s*应\s*商\s*名\s*称\s*[:：\s]([^\n]+)", r"致\s*[:：\s]([^\n]+?)(?:\s*公司|\s*单位)", r"^\s*([^\n]+?公司)\s*$"]
SECTION_NAMES = [r"(?:投标人|投标单位|供应商|单位名称)\s*[:：]\s*([一-龥a-zA-Z0-9（）()·．\.]+?公司)", r"(?:投标人|投标单位|供应商|单位名称)[:：\s]*([^\n]+?公司)", r"([一-龥a-zA-Z0-9（）()·．\.]+?有限公司)", r"^\s*([^\n]+?有限公司)\s*$", r"(?:制造商名称|制造厂家|生产厂家)\s*[:：]\s*([^\n]+?公司)", r"(?:制造商名称|制造厂家|生产厂家)\s*[:：]\s*([^\n]+?有限公司)"]
NAME_HEADERS = ["制造商名称", "投标人名称", "供应商名称", "单位名称"]
SOURCES = ["regex", "answer", "table", "section", "file"]


def _names(text: Column, patterns: Sequence[str], invalid: Sequence[str]) -> Column:
    each = [F.transform(F.regexp_extract_all(text, F.lit(f"(?Umd){p}"), F.lit(1)), lambda x: _judged(filter_bidder_name(x), invalid)) for p in patterns]
    return F.flatten(F.array(*each))


def _judged(name: Column, invalid: Sequence[str]) -> Column:
    return let(name, lambda n: F.struct(n.alias("name"), valid_company_name(n, invalid=invalid).alias("valid"), garbled_name(n).alias("garbled")))


def name_candidates(pages: DataFrame, patterns: Sequence[str] = LINE_NAMES, invalid: Sequence[str] = NOT_COMPANY_WORDS) -> DataFrame:
    """doc_id, seq, name, valid, garbled: names by the line patterns on the first three pages, in order of pattern."""
    return leading_pages(pages).select("doc_id", F.posexplode(_names(F.col("text"), patterns, invalid)).alias("seq", "x")).select("doc_id", "seq", "x.*")


def section_names(pages: DataFrame, patterns: Sequence[str] = SECTION_NAMES, invalid: Sequence[str] = NOT_COMPANY_WORDS) -> DataFrame:
    """doc_id, name: the first valid and clean name on anchor pages and those that follow."""
    near = page_set_union(tag_sections(pages), "name_anchor")
    rows = near.select("doc_id", "page_no", F.posexplode(_names(F.col("text"), patterns, invalid)).alias("seq", "x"))
    good = rows.where("x.valid and not x.garbled")
    return good.groupBy("doc_id").agg(F.min_by("x.name", F.struct("page_no", "seq")).alias("name"))


def table_names(tables: DataFrame, headers: Sequence[str] = NAME_HEADERS, invalid: Sequence[str] = NOT_COMPANY_WORDS) -> DataFrame:
    """doc_id, name: the first valid and clean name in a column whose header holds one of the words."""
    which = [F.array_position(F.transform("headers", lambda h: F.coalesce(h.contains(w), F.lit(False))), F.lit(True)) for w in headers]
    at = F.coalesce(*[F.when(w > 0, w) for w in which])
    rows = tables.withColumn("_at", at).where("_at is not null").select("doc_id", "table_no", "_at", F.posexplode("data").alias("row_no", "cells"))
    rows = rows.where("row_no > 0").select("doc_id", "table_no", "row_no", _judged(filter_bidder_name(F.get("cells", (F.col("_at") - 1).cast("int"))), invalid).alias("x"))
    good = rows.where("x.valid and not x.garbled")
    return good.groupBy("doc_id").agg(F.min_by("x.name", F.struct("table_no", "row_no")).alias("name"))


def pick_bidder_name(candidates: DataFrame, invalid: Sequence[str] = NOT_COMPANY_WORDS) -> DataFrame:
    """doc_id, name, source of the best of candidates (doc_id, source, seq, name): of each source its first valid name, which
    must not be garbled; sources in the order regex, answer, table, section, file."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    first = F.row_number().over(Window.partitionBy("doc_id", "source").orderBy("seq"))
    valid = candidates.where(valid_company_name(F.col("name"), invalid=invalid)).withColumn("_n", first).where("_n = 1")
    good = valid.where(~garbled_name(F.col("name"))).withColumn("_r", rank)
    return good.groupBy("doc_id").agg(F.min_by("name", "_r").alias("name"), F.min_by("source", "_r").alias("source"))
