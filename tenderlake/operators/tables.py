"""Table fragments of pages: similarity, merging over pages, rows and cells.

fragments: doc_id, page, table_index, cols, headers array<string>, data array<array<string>> (data's first row is the header).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_cell_text, strip

RULE_HEADERS = ["评价项目", "评价标准"]


def header_similarity(a: Column, b: Column) -> Column:
    """Share of places where both are blank, equal, or one holds the other."""
    n = F.greatest(F.size(a), F.size(b))
    t = lambda c: strip(F.coalesce(c, F.lit("")))
    alike = F.zip_with(a, b, lambda x, y: (t(x) == t(y)) | ((t(x) != "") & (t(y) != "") & (t(x).contains(t(y)) | t(y).contains(t(x)))))
    short = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.slice(alike, F.lit(1), F.greatest(short, F.lit(0))), F.lit(0), lambda s, x: s + x.cast("int"))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), same / n).otherwise(0.0)


def _filled(data: Column) -> Column:
    cells = F.aggregate(data, F.lit(0), lambda s, r: s + F.size(F.filter(r, lambda c: strip(F.coalesce(c, F.lit(""))) != "")))
    return F.when(F.size(data) > 0, cells / F.size(data))


def content_similarity(a: Column, b: Column) -> Column:
    """By the mean number of filled cells a row: 1 if both have none, 0 if one has none or a table is empty."""
    x, y = _filled(a), _filled(b)
    return F.when(x.isNull() | y.isNull(), 0.0).when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(1 - F.abs(x - y) / F.greatest(x, y))


def continued(fragments: DataFrame) -> DataFrame:
    """fragments with island: the number of the merged table, from 1, in order of page and place. A fragment continues the
    one before on the next page, with as many columns, and a header alike above 0.6 or a content alike above 0.7."""
    order = Window.partitionBy("doc_id").orderBy("page", "table_index")
    prev = F.lag(F.struct("page", "cols", "headers", "data")).over(order)
    goes_on = (F.col("page") == F.col("_p.page") + 1) & (F.col("cols") == F.col("_p.cols")) & ((header_similarity(F.col("_p.headers"), F.col("headers")) > 0.6) | (content_similarity(F.col("_p.data"), F.col("data")) > 0.7))
    rows = fragments.withColumn("_p", prev).withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    return rows.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_p", "_new")


def merge_page_tables(fragments: DataFrame) -> DataFrame:
    """doc_id, table_no, start_page, end_page, page_count, total_rows, headers, data: the first fragment whole, the others
    without their first row, cells cleaned."""
    part = F.struct("page", "table_index", "headers", "data")
    of = continued(fragments).groupBy("doc_id", F.col("island").alias("table_no")).agg(F.array_sort(F.collect_list(part)).alias("all"))
    rows = F.flatten(F.transform("all", lambda x, i: F.when(i == 0, x["data"]).otherwise(F.slice(x["data"], F.lit(2), F.size(x["data"])))))
    clean = F.transform(rows, lambda r: F.transform(r, clean_cell_text))
    out = of.withColumn("data", clean)
    return out.select("doc_id", "table_no", F.array_min(F.transform("all", lambda x: x["page"])).alias("start_page"), F.array_max(F.transform("all", lambda x: x["page"])).alias("end_page"), F.size("all").alias("page_count"), F.size("data").alias("total_rows"), F.transform(F.get("all", F.lit(0))["headers"], clean_cell_text).alias("headers"), "data")


def merged_rows(fragments: DataFrame) -> DataFrame:
    """merge_page_tables in long form: doc_id, table_no, row_no (from 0, the header), headers, cells; a row for each row of a
    table, numbered by running sums over its fragments, so that no table is one row, over however many pages it goes."""
    order = Window.partitionBy("doc_id", "island").orderBy("page", "table_index")
    rows = continued(fragments).withColumn("nth", F.row_number().over(order))
    first = F.col("nth") == 1
    size = F.greatest(F.size("data") - F.when(first, 0).otherwise(1), F.lit(0))
    rows = rows.withColumns({"before": F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "head": F.first("headers").over(order)})
    body = F.when(first, F.col("data")).otherwise(F.slice("data", F.lit(2), F.greatest(F.size("data"), F.lit(0))))
    each = rows.select("doc_id", F.col("island").alias("table_no"), "before", F.transform("head", clean_cell_text).alias("headers"), F.posexplode(body).alias("k", "cells"))
    return each.select("doc_id", "table_no", (F.col("before") + F.col("k")).cast("int").alias("row_no"), "headers", F.transform("cells", clean_cell_text).alias("cells"))


def _long(tables: DataFrame) -> DataFrame:
    """Tables in long form, as they are or out of whole tables (data)."""
    return tables if "cells" in tables.columns else tables.select("doc_id", "table_no", "headers", F.posexplode("data").alias("row_no", "cells"))


def filter_rule_tables(tables: DataFrame, words: Sequence[str] = RULE_HEADERS) -> DataFrame:
    """Tables whose cleaned headers hold all the words."""
    has = F.lit(True)
    for w in words:
        has = has & F.exists("headers", lambda h: F.coalesce(clean_cell_text(h).contains(w), F.lit(False)))
    return tables.where(has)


def table_rows(tables: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no (from 1, the header is 0 and left out), col_no, header, cell: rows as cells; where a row has
    more or fewer cells than there are headers its columns are named column_1, column_2, ... Tables are whole or in long form."""
    rows = _long(tables).where("row_no > 0")
    odd = F.size("cells") != F.size("headers")
    cells = rows.select("doc_id", "table_no", "row_no", odd.alias("odd"), "headers", F.posexplode("cells").alias("col_no", "cell"))
    name = F.when(F.col("odd"), F.concat(F.lit("column_"), (F.col("col_no") + 1).cast("string"))).otherwise(clean_cell_text(F.get("headers", F.col("col_no"))))
    return cells.select("doc_id", "table_no", "row_no", "col_no", name.alias("header"), clean_cell_text(F.col("cell")).alias("cell"))


def rule_rows(tables: DataFrame) -> DataFrame:
    """doc, row_no, project_cell, detail, standard of rule tables: the column under 评价项目, the second, the one under 评价标准 (else 标准)."""
    rows = filter_rule_tables(_long(tables)).where("row_no > 0")
    at = lambda w: F.array_position(F.transform("headers", lambda h: F.coalesce(h.contains(w), F.lit(False))), F.lit(True))
    cell = lambda i: F.get("cells", (i - 1).cast("int"))
    standard = F.coalesce(F.nullif(at("评价标准"), F.lit(0)), at("标准"))
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("table_no", "row_no"))
    return rows.select(F.col("doc_id").alias("doc"), no.alias("row_no"), cell(at("评价项目")).alias("project_cell"), F.get("cells", F.lit(1)).alias("detail"), cell(standard).alias("standard"))
