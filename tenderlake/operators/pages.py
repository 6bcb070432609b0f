"""Page texts: pages(doc_id, page_no from 0, text). Tags, keyword counts, quality, contexts for rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, count_word, strip

# Words by which pages are told.
SECTIONS = {"summary": ["投标一览表", "开标一览表", "价格一览表"], "price_part": ["价格文件", "报价部分"], "bond": ["一览表", "保证金", "保函"], "name_anchor": ["授权委托书", "法定代表人授权书", "投标一览表", "投标报价一览表", "开标一览表", "投标函", "资格审查", "制造商名称"]}
EVALUATION_WORDS = ["评标办法", "评分标准", "评标标准"]
COUNTED_WORDS = ["评标", "评分", "标准", "商务", "技术", "价格", "分值"]
SPLIT_KEYWORDS = r"(?U)\s|，|。"


def tag_sections(pages: DataFrame, sections: dict[str, Sequence[str]] = SECTIONS) -> DataFrame:
    return pages.withColumns({tag: any_of(F.col("text"), words) for tag, words in sections.items()})


def count_keywords(pages: DataFrame, evaluation: Sequence[str] = EVALUATION_WORDS, words: Sequence[str] = COUNTED_WORDS, fragments: DataFrame | None = None) -> DataFrame:
    """Pages that mention an evaluation word: text length, one count for each word (n_0, n_1, ...) and, where the table
    fragments (doc_id, page) are given, has_tables."""
    counts = [count_word(F.col("text"), w).alias(f"n_{i}") for i, w in enumerate(words)]
    out = pages.where(any_of(F.col("text"), evaluation)).select("doc_id", "page_no", F.length("text").alias("text_length"), *counts)
    if fragments is None:
        return out
    with_tables = fragments.select("doc_id", F.col("page").alias("page_no")).distinct().withColumn("has_tables", F.lit(True))
    return out.join(with_tables, ["doc_id", "page_no"], "left").withColumn("has_tables", F.coalesce("has_tables", F.lit(False)))


def keyword_page_summary(pages: DataFrame, evaluation: Sequence[str] = EVALUATION_WORDS) -> DataFrame:
    """doc_id, pages: the numbers of the pages that mention an evaluation word, in order, comma-joined."""
    hits = pages.where(any_of(F.col("text"), evaluation)).groupBy("doc_id").agg(F.array_sort(F.collect_set("page_no")).alias("p"))
    return hits.select("doc_id", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("pages"))


def page_quality(pages: DataFrame, prior_failures: DataFrame, short: int = 20, scanned: int = 100) -> DataFrame:
    """doc_id, page_no, failed (empty and not recorded before), needs_ocr, doc_chars, doc_scanned."""
    n = F.length(strip(F.coalesce(F.col("text"), F.lit(""))))
    of_doc = pages.groupBy("doc_id").agg(F.sum(n).alias("doc_chars"))
    known = prior_failures.select("doc_id", "page_no", F.lit(True).alias("known")).distinct()
    out = pages.withColumn("n", n).join(of_doc, "doc_id").join(known, ["doc_id", "page_no"], "left")
    return out.select("doc_id", "page_no", ((F.col("n") == 0) & F.col("known").isNull()).alias("failed"), (F.col("n") < short).alias("needs_ocr"), "doc_chars", (F.col("doc_chars") < scanned).alias("doc_scanned"))


def page_with_next(pages: DataFrame) -> DataFrame:
    return pages.withColumn("context", F.concat_ws("\n", "text", F.lead("text").over(Window.partitionBy("doc_id").orderBy("page_no"))))


def page_set_union(pages: DataFrame, tag: str) -> DataFrame:
    """Tagged pages and the pages that follow one."""
    before = F.lag(tag).over(Window.partitionBy("doc_id").orderBy("page_no"))
    return pages.withColumn("_b", F.coalesce(before, F.lit(False))).where(F.col(tag) | F.col("_b")).drop("_b")


def leading_pages(pages: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, text: the first pages joined by line ends."""
    first = pages.where(F.col("page_no") < n).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return first.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def bid_rule_pairs(bids: DataFrame, rules: DataFrame) -> DataFrame:
    """Every bid with every child rule of its project that is no price rule."""
    kids = rules.where(F.col("Child_Item_Name").isNotNull() & ~F.coalesce("is_price_criteria", F.lit(False)))
    kids = kids.select("project_id", F.col("id").alias("rule_id"), F.col("Child_Item_Name").alias("item"), F.col("description"), F.col("Child_max_score").alias("max_score"), F.col("Parent_Item_Name").alias("parent"))
    return bids.select(F.col("id").alias("bid_id"), "project_id", "bidder_name").join(kids, "project_id")


def relevant_pages(pairs: DataFrame, pages: DataFrame, window: int = 2) -> DataFrame:
    """pair_id, doc_id, page_no: for each pair (pair_id, doc_id, item, description) the pages that hold one of its keywords
    and the window pages after them; the first window + 1 pages if none does. A document's pairs make up one dictionary of
    distinct words, so a page is read and gone through once however many pairs there are; its hits go back to pairs by word."""
    words = F.array_distinct(F.filter(F.split(F.concat_ws(" ", F.coalesce("item", F.lit("")), F.coalesce("description", F.lit(""))), SPLIT_KEYWORDS), lambda w: F.length(w) > 1))
    own = pairs.select("pair_id", "doc_id", F.explode_outer(F.array_distinct(F.transform(words, lambda w: F.lower(w)))).alias("word"))
    dictionary = own.where("word is not null").groupBy("doc_id").agg(F.collect_set("word").alias("words"))
    # Pages meet one row a document. A text is made lower once, by a generator, and then searched for each distinct word.
    low = pages.join(dictionary, "doc_id").select("doc_id", "page_no", "words", F.explode(F.array(F.lower("text"))).alias("low"))
    found = low.select("doc_id", "page_no", F.explode(F.filter("words", lambda w: F.col("low").contains(w))).alias("word"))
    hits = found.join(own, ["doc_id", "word"]).select("pair_id", "doc_id", "page_no").distinct()
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("last"))
    near = lambda df, first: df.join(last, "doc_id").select("pair_id", "doc_id", F.explode(F.sequence(first, F.least(first + window, F.col("last")))).alias("page_no"))
    rest = pairs.select("pair_id", "doc_id").join(hits.select("pair_id").distinct(), "pair_id", "left_anti")
    return near(hits, F.col("page_no")).distinct().unionByName(near(rest, F.lit(0)))


def page_ranges(chosen: DataFrame, pages: DataFrame, budget: int | None = None) -> DataFrame:
    """pair_id, context: chosen pages in runs, each under a heading with its first and last page (from 1), runs apart by an
    empty line. With a budget, the first so many characters: which pages they come from, and how much of each, is told from
    lengths before any text is joined, and pages are cut to the budget before they are moved."""
    text = F.coalesce(F.col("text"), F.lit(""))
    in_order = Window.partitionBy("pair_id").orderBy("page_no")
    runs = Window.partitionBy("pair_id", "run")
    rows = chosen.join(pages.select("doc_id", "page_no", F.length(text).alias("size")), ["doc_id", "page_no"])
    rows = rows.withColumn("run", F.col("page_no") - F.row_number().over(in_order)).withColumns({"a": F.min("page_no").over(runs), "b": F.max("page_no").over(runs), "first": F.min("page_no").over(Window.partitionBy("pair_id"))})
    heading = F.concat(F.lit("--- Pages "), (F.col("a") + 1).cast("string"), F.lit("-"), (F.col("b") + 1).cast("string"), F.lit(" ---\n"))
    before = F.when(F.col("page_no") > F.col("a"), "\n").when(F.col("a") > F.col("first"), F.concat(F.lit("\n\n"), heading)).otherwise(heading)
    rows = rows.withColumn("before", before)
    short = pages.select("doc_id", "page_no", text.alias("text"))
    if budget is not None:
        full = F.length("before") + F.col("size")
        room = budget - F.coalesce(F.sum(full).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("room", room).where("room > 0")
        short = short.withColumn("text", F.substring("text", 1, budget))
    rows = rows.join(short, ["doc_id", "page_no"])
    part = F.concat("before", "text")
    part = part if budget is None else F.substring(part, F.lit(1), F.col("room").cast("int"))
    of = rows.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("page_no", part.alias("part")))).alias("all"))
    return of.select("pair_id", F.array_join(F.transform("all", lambda x: x["part"]), "").alias("context"))
