"""Whole flows: scores of bids by rules, rules out of table fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import CONTEXT_LIMIT, build_prompt, parse_score_answer
from ..functions.numbers import let
from ..operators.pages import bid_rule_pairs, page_ranges, relevant_pages
from ..operators.rules import adjusted_tree, price_rule_from_text, rules_from_rows, rules_from_text
from ..operators.sections import slice_scoring_section
from ..operators.tables import merged_rows, rule_rows
from ..sources.shared import written


def prompts(bids: DataFrame, rules: DataFrame, pages: DataFrame) -> DataFrame:
    """pair_id, bid_id, project_id, item, max_score, prompt: what is asked about each bid and rule. Pages are keyed by bid id."""
    pairs = bid_rule_pairs(bids, rules).withColumn("pair_id", F.concat_ws(":", F.col("bid_id").cast("string"), F.col("rule_id").cast("string"))).withColumn("doc_id", F.col("bid_id"))
    # One character more than a prompt takes, so that the cut is told.
    context = page_ranges(relevant_pages(pairs, pages), pages, CONTEXT_LIMIT + 1)
    out = pairs.join(context, "pair_id", "left")
    return out.select("pair_id", "bid_id", "project_id", "rule_id", "parent", "item", "max_score", build_prompt(F.col("item"), F.col("description"), F.col("max_score"), F.coalesce("context", F.lit(""))).alias("prompt"))


def score_bids(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """bid_id, project_id, detailed_scores (JSON in order of rules), total_score from answers (pair_id, response); a pair
    without an answer scores 0. asked is what prompts gives; ids are numbers, so a pair_id says its bid and its rule: what is
    asked about a bid and what is answered meet in the bid's row, and nothing is sorted or joined by pair."""
    kind, at = {f.name: f.dataType for f in asked.schema}, F.instr("pair_id", ":")
    # Only a number written as concat_ws writes it names a bid or a rule.
    number = lambda text, k: F.when(text.try_cast(k).cast("string") == text, text.try_cast(k))
    bid, rule = number(F.substring("pair_id", F.lit(1), at - 1), kind["bid_id"]), number(F.substring("pair_id", at + 1, F.length("pair_id")), kind["rule_id"])
    # Answers are read before they move, as if there were no maximum, which each score is cut at below.
    answer = lambda response: parse_score_answer(response, F.lit(float("inf")))
    said = answers.select(bid.alias("bid_id"), rule.alias("rule_id"), answer(F.col("response")).alias("a")).where("bid_id is not null and rule_id is not null")
    said = said.select("bid_id", F.struct("rule_id", "a").alias("said"))
    item = F.struct("project_id", "rule_id", F.col("item").alias("name"), F.col("max_score").cast("double").alias("max_score"), "parent")
    rows = asked.select("bid_id", item.alias("asked")).unionByName(said, allowMissingColumns=True)
    of = rows.groupBy("bid_id").agg(F.collect_list("asked").alias("asked"), F.collect_list("said").alias("said"))
    of = of.select("bid_id", F.explode(F.array_distinct(F.transform("asked", lambda x: x["project_id"]))).alias("project_id"), "asked", "said").withColumn("none", F.array(answer(F.lit(None).cast("string"))))

    def scored(x: Column) -> Column:
        """x with each of its answers; without one, with none."""
        score = lambda a: F.struct(x["rule_id"].alias("rule_id"), x["name"].alias("Child_Item_Name"), x["max_score"].alias("max_score"), F.greatest(F.lit(0.0), F.least(a["score"], x["max_score"])).alias("score"), a["reason"].alias("reason"), x["parent"].alias("Parent_Item_Name"))
        own = F.transform(F.filter("said", lambda y: y["rule_id"] == x["rule_id"]), lambda y: y["a"])
        return let(own, lambda found: F.transform(F.when(F.size(found) > 0, found).otherwise(F.col("none")), score))

    items = F.array_sort(F.flatten(F.transform(F.filter("asked", lambda x: x["project_id"] == F.col("project_id")), scored)))
    of = of.select("bid_id", "project_id", F.explode(F.array(items)).alias("all"))
    json = F.to_json(F.transform("all", lambda x: x.dropFields("rule_id")))
    total = F.aggregate("all", F.lit(0.0), lambda sum_, x: sum_ + x["score"])
    return of.select("bid_id", "project_id", json.alias("detailed_scores"), total.alias("total_score"))


def rules_of_texts(docs: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Rules of running texts (doc_id, text): the scoring section, or the whole text where there is none, is read line by
    line; similar rules become one, a stated price rule is added or takes the place of the first. Rules that texts state have
    no numbering, so each is a parent."""
    text = docs if skip is None else docs.join(skip.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_anti")
    section = slice_scoring_section(text).join(text.select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("doc"), F.coalesce(F.nullif(F.trim("section"), F.lit("")), F.col("text")).alias("text"))
    section = written(section)
    lines = section.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    rules = price_rule_from_text(section, written(rules_from_text(lines)))
    return rules.select("doc", F.col("nth").cast("int").alias("parent_no"), F.lit(None).cast("int").alias("child_no"), "criteria_name", "max_score", "description", "is_price_criteria")


def extract_rules(fragments: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Rules of documents (doc, parent_no, child_no, criteria_name, max_score, description, is_price_criteria), with parents'
    maxima and totals adjusted: those of the rule tables that fragments make up; where a document has none, those of its text
    (doc_id, text), if it is given; and the default rules where neither says any."""
    found = written(rules_from_rows(rule_rows(merged_rows(fragments))))
    docs = fragments.select(F.col("doc_id").alias("doc"))
    if texts is not None:
        found = written(found.unionByName(rules_of_texts(texts, found)))
        docs = docs.unionByName(texts.select(F.col("doc_id").alias("doc")))
    return adjusted_tree(found, docs.distinct())
