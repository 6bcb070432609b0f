"""Prices, scores and rankings of bids, over many projects at once.

results: id, project_id, bid_document_id, bidder_name, total_score, price_score, extracted_price, detailed_scores (JSON text
of a list of items or of a map from item to score). rules: id, project_id, Parent_Item_Name, Parent_max_score,
Child_Item_Name, Child_max_score, description, is_price_criteria. Nothing here gathers more than a project's few items.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import let, plain_number, round_half_up
from ..functions.text import PRICE_RULE_WORDS, any_of

ITEM = "Child_Item_Name string, criteria_name string, Parent_Item_Name string, max_score double, score string, reason string, is_price_criteria boolean, extracted_price double"
ITEMS = f"array<struct<{ITEM.replace(' string', ': string').replace(' double', ': double').replace(' boolean', ': boolean')}, children: array<struct<{ITEM.replace(' string', ': string').replace(' double', ': double').replace(' boolean', ': boolean')}>>>>"
# What is read of an item where nothing else is asked for: fields that are left out need not be turned into values.
LISTED = "array<struct<Child_Item_Name: string, criteria_name: string, score: string, is_price_criteria: boolean, extracted_price: double>>"
NAMED = "array<struct<Child_Item_Name: string, criteria_name: string, score: string>>"
PRICE_ITEM = "价格"
PRICED = "array<struct<score: string, is_price_criteria: boolean, extracted_price: double>>"
LEVELS = 3  # levels of a tree of scores that column functions go through; deeper trees are walked by a function of their own
# What a recalculated price score is explained by, and a price score with and without a price.
NEW_REASON, PRICE_REASON, NO_PRICE_REASON = "根据评标规则重新计算的价格分: ", "根据价格评分规则计算得出。提取到的报价为: ", "未提取到有效报价，价格分设为0"


def _listed(text: Column, kind: str = LISTED) -> Column:
    """The items of a text of scores, a list or a map, as they are read: an array of kind, null if neither. A map's items
    have their name in criteria_name."""
    from_list = F.when(text.rlike(r"^\s*\["), F.from_json(text, kind))
    from_map = F.when(text.rlike(r"^\s*\{"), F.from_json(text, "map<string,string>"))
    pair = lambda x: F.named_struct(F.lit("Child_Item_Name"), F.lit(None).cast("string"), F.lit("criteria_name"), x["key"], F.lit("score"), x["value"], *more)
    more = [F.lit("is_price_criteria"), F.lit(None).cast("boolean"), F.lit("extracted_price"), F.lit(None).cast("double")] if kind == LISTED else []
    return F.coalesce(from_list, F.transform(F.map_entries(from_map), pair))


def _name(item: Column) -> Column:
    return F.coalesce(F.nullif(item["Child_Item_Name"], F.lit("")), item["criteria_name"])


def _number_in(text: Column) -> Column:
    """A text as a double, null if it is none. Texts without a digit or the name of a number aren't tried: it costs an exception."""
    return F.when(text.rlike("[0-9]|(?i)nan|inf"), text.try_cast("double"))


def _is_flagged(item: Column) -> Column:
    return F.coalesce(item["is_price_criteria"], F.lit(False))


def _item_array(text: Column) -> Column:
    """The items of a text of scores, a list or a map: array of (pos, item, score, price_item, item_price), null if neither."""
    return F.transform(_listed(text), lambda x, i: F.struct(i.alias("pos"), _name(x).alias("item"), _number_in(x["score"]).alias("score"), _is_flagged(x).alias("price_item"), x["extracted_price"].alias("item_price")))


def _may_hold(text: Column, *words: str) -> Column:
    """Whether a text of JSON may have one of the words in a name or a value: it has the word itself, or escapes. So texts
    that have neither need not be parsed."""
    return any_of(text, [*words, "\\u"])


def score_items(results: DataFrame) -> DataFrame:
    """results with one row an item: pos, item (Child_Item_Name, else criteria_name), score, price_item, item_price; lists
    and maps alike. Results without items give none."""
    return results.withColumn("_item", F.explode(_item_array(F.col("detailed_scores")))).select(*results.columns, "_item.*")


def _item_price(text: Column) -> Column:
    """The price of the first price item of a list."""
    items = F.filter(F.when(_may_hold(text, "is_price_criteria") & text.rlike(r"^\s*\["), F.from_json(text, PRICED)), lambda x: F.coalesce(x["is_price_criteria"], F.lit(False)))
    return F.get(F.transform(items, lambda x: F.coalesce(x["extracted_price"], x["score"].try_cast("double"))), F.lit(0))


def with_read_scores(results: DataFrame) -> DataFrame:
    """results with item_price and other_total, so that bid_prices and apply_totals need not read their texts."""
    text = F.col("detailed_scores")
    return results.withColumns({"item_price": _item_price(text), "other_total": _other_total(text)})


def bid_prices(results: DataFrame, unpriced: bool = False) -> DataFrame:
    """project_id, bidder_name, price: a price item's price in the list first, else extracted_price; of a bidder's rows the
    last (by id) with a price. Bidders without a price are left out, or with unpriced have null."""
    of_item = F.col("item_price") if "item_price" in results.columns else _item_price(F.col("detailed_scores"))
    priced = results.select("project_id", "bidder_name", "id", F.coalesce(of_item, F.col("extracted_price")).alias("price"))
    # Rows without a price have no place in the order, so that the JSON text is read once and not for a filter too. The order
    # is no struct, as groups would have to be sorted for that; a price whose row has no id counts where there is no other.
    last = F.max_by("price", F.when(F.col("price").isNotNull(), F.col("id")))
    out = priced.groupBy("project_id", "bidder_name").agg(F.coalesce(last, F.first("price", ignorenulls=True)).alias("price"))
    return out if unpriced else out.where("price is not null")


def lowest_price(prices: DataFrame) -> DataFrame:
    """The benchmark of each project, who offers it (smallest name of equals), and how many are priced."""
    return prices.groupBy("project_id").agg(F.min("price").alias("benchmark"), F.min(F.struct("price", "bidder_name"))["bidder_name"].alias("lowest_bidder"), F.count("price").alias("n_priced"))


def price_rule_max(rules: DataFrame) -> DataFrame:
    """The maximum of each project's first price rule."""
    first = F.min(F.struct("id", F.coalesce(F.nullif("Child_max_score", F.lit(0)), F.col("Parent_max_score")).alias("m")))["m"]
    return rules.where(F.coalesce("is_price_criteria", F.lit(False))).groupBy("project_id").agg(first.cast("double").alias("max_price_score"))


def score_prices(prices: DataFrame, tops: DataFrame, answers: DataFrame | None = None, mean: bool = False) -> DataFrame:
    """project_id, bidder_name, price, benchmark, price_score: benchmark / price of the maximum, two decimals. The benchmark
    is the lowest price, or with mean the arithmetic mean. Answers (project_id, bidder_name, score) go before, where a
    project has some."""
    # Over a window of bidders' prices (one row each), so that prices are not worked out a second time to be grouped.
    benchmark = (F.avg("price") if mean else F.min("price")).over(Window.partitionBy("project_id"))
    own = prices.withColumn("benchmark", benchmark).join(tops, "project_id")
    share = F.try_divide(F.col("benchmark"), F.col("price")) * F.col("max_price_score")
    own = own.withColumn("price_score", F.coalesce(round_half_up(share), F.lit(0.0)))
    if answers is not None:
        given = answers.select("project_id", "bidder_name", F.col("score").alias("given"))
        own = own.join(given, ["project_id", "bidder_name"], "left")
        own = own.withColumn("price_score", F.when(F.max("given").over(Window.partitionBy("project_id")).isNotNull(), F.coalesce("given", F.lit(0.0))).otherwise(F.col("price_score"))).drop("given")
    return own.select("project_id", "bidder_name", "price", "benchmark", "price_score")


def price_scores(results: DataFrame, rules: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Price scores of all bidders with a result, those without a price get 0; projects without a price rule are left out."""
    scored = score_prices(bid_prices(results, unpriced=True), price_rule_max(rules), answers)
    no_price = F.col("price").isNull()
    return scored.withColumns({"benchmark": F.when(~no_price, F.col("benchmark")), "price_score": F.when(no_price, 0.0).otherwise(F.col("price_score"))})


def paired_price_score(prices: DataFrame, tops: DataFrame) -> DataFrame:
    """Price scores, with their reason, only where a project has two priced bids or more, else 0; 0 without a price."""
    n = prices.groupBy("project_id").agg(F.count("price").alias("_n"))
    out = score_prices(prices, tops).join(n, "project_id").withColumn("price_score", F.when(F.col("_n") < 2, 0.0).otherwise(F.col("price_score"))).drop("_n")
    reason = F.when(F.col("price").isNull(), NO_PRICE_REASON).otherwise(F.concat(F.lit(PRICE_REASON), plain_number(F.col("price"))))
    return out.withColumn("reason", reason)


def _other_total(text: Column, price_word: str = PRICE_ITEM) -> Column:
    other = lambda x: ~_is_flagged(x) & ~F.coalesce(_name(x).startswith(price_word), F.lit(False))
    add = lambda total, x: total + F.coalesce(F.when(other(x), _number_in(x["score"])), F.lit(0.0))
    return F.coalesce(F.aggregate(_listed(text), F.lit(0.0), add), F.lit(0.0))


def other_scores_total(results: DataFrame, price_word: str = PRICE_ITEM) -> DataFrame:
    """id, other_total: the sum of numeric scores but those of price items, by flag or by name."""
    return results.select("id", _other_total(F.col("detailed_scores"), price_word).alias("other_total"))


def _items(tree: Column) -> Column:
    return F.try_variant_get(tree, "$", "array<variant>")


def _field(item: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", kind)


def _is_price_item(item: Column) -> Column:
    return let(F.lower(_field(item, "criteria_name", "string")), lambda name: any_of(name, PRICE_RULE_WORDS["scores"])) | F.coalesce(_field(item, "is_price_criteria", "boolean"), F.lit(False))


def _deeper(items: Column, levels: int = LEVELS) -> Column:
    """Whether items have children below that many levels."""
    kids = lambda x: _field(x, "children", "array<variant>")
    return F.coalesce(F.exists(items, lambda x: F.coalesce(F.size(kids(x)) > 0, F.lit(False)) if levels == 1 else _deeper(kids(x), levels - 1)), F.lit(False))


def _is_price(item: dict) -> bool:
    name = item.get("criteria_name")
    return isinstance(name, str) and any(w in name.lower() for w in PRICE_RULE_WORDS["scores"]) or item.get("is_price_criteria") is True


def _number(x: object) -> float | None:
    try:
        return None if isinstance(x, (list, dict)) else float(x)
    except (TypeError, ValueError):
        return None


def _found(items: list) -> float | None:
    """What _price_score gives, for a tree of any depth: lists that are being gone through wait on a stack."""
    stack = [iter(items)]
    while stack:
        item = next(stack[-1], stack)
        if item is stack:
            stack.pop()
        elif isinstance(item, dict):
            score = _number(item.get("score")) if _is_price(item) else None
            if score is not None and (score != 0 or len(stack) == 1):
                return score
            if score is not None:  # a score of 0 below an item ends its list
                stack.pop()
            elif isinstance(item.get("children"), list):
                stack.append(iter(item["children"]))
    return None


@F.arrow_udf(T.DoubleType())
def _deep_price_score(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else _found(json.loads(x)) for x in texts.to_pylist()], pa.float64())


@F.arrow_udf(T.StringType())
def _deep_with_price(texts: pa.Array, news: pa.Array, reasons: pa.Array) -> pa.Array:
    """What _with_price gives for the items of trees of any depth."""
    out = []
    for text, new, reason in zip(texts.to_pylist(), news.to_pylist(), reasons.to_pylist(), strict=True):
        items = None if text is None else json.loads(text)
        todo = [items] if items else []
        while todo:
            for item in todo.pop():
                if isinstance(item, dict):
                    if _is_price(item):
                        item |= {"score": new, "reason": reason, "is_price_criteria": True}
                    if isinstance(item.get("children"), list):
                        todo.append(item["children"])
        out.append(None if items is None else json.dumps(items, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
    return pa.array(out, pa.string())


def _price_score(items: Column, levels: int = LEVELS) -> Column:
    """The first price item's score, else the first score but 0 below an item; null if there is none."""
    below = lambda x: F.nullif(_price_score(_field(x, "children", "array<variant>"), levels - 1), F.lit(0.0)) if levels > 1 else F.lit(None).cast("double")
    own = lambda x: F.coalesce(F.when(_is_price_item(x), _field(x, "score", "double")), below(x))
    return F.get(F.array_compact(F.transform(items, own)), F.lit(0))


def _found_price_score(results: DataFrame) -> DataFrame:
    """results with found_score, in the row. Texts that hold no word of prices are not parsed."""
    text = F.col("detailed_scores")
    may = _may_hold(F.lower(text), *PRICE_RULE_WORDS["scores"])
    rows = results.withColumn("_items", _items(F.when(may, F.try_parse_json(text)))).withColumn("_deep", F.when(_may_hold(text, "children"), _deeper(F.col("_items"))).otherwise(False))
    listed = F.when(F.col("_deep"), _deep_price_score(F.when(F.col("_deep"), text))).otherwise(_price_score(F.col("_items")))
    pairs = F.map_entries(F.when(may & text.rlike(r"^\s*\{"), F.from_json(text, "map<string,variant>")))
    value = lambda v: F.coalesce(F.when(~F.schema_of_variant(v).startswith("STRING"), F.try_variant_get(v, "$", "double")), _field(v, "score", "double"))
    named = lambda k: any_of(k, [PRICE_ITEM]) | any_of(F.lower(k), ["price"])
    mapped = F.get(F.array_compact(F.transform(F.filter(pairs, lambda x: named(x["key"])), lambda x: value(x["value"]))), F.lit(0))
    return rows.select(*results.columns, F.coalesce(listed, mapped, F.lit(0.0)).alias("found_score"))


def find_price_score(results: DataFrame) -> DataFrame:
    """id, found_score: in a list the first price item's score, depth first at any depth, where what is found below an item
    counts if it isn't 0; in a map the first number, or object with a score, under a key that names a price; none is 0."""
    return _found_price_score(results.select("id", "detailed_scores")).select("id", "found_score")


def with_found_price_score(results: DataFrame, asked: Column) -> DataFrame:
    """results whose price_score is that of the items where it is asked for; it is found in the row, so nothing is joined."""
    found = _found_price_score(results.withColumns({"_asked": asked, "_text": F.col("detailed_scores"), "detailed_scores": F.when(asked, F.col("detailed_scores"))}))
    return found.withColumns({"detailed_scores": F.col("_text"), "price_score": F.when(F.col("_asked"), F.col("found_score")).otherwise(F.col("price_score"))}).select(*results.columns)


def first_per_bidder(results: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("project_id", "bidder_name").orderBy("id"))
    return results.withColumn("_n", place).where("_n = 1").drop("_n")


def apply_totals(results: DataFrame, scored: DataFrame) -> DataFrame:
    """results whose first row of each scored bidder has the new price score, price and total (other scores + price score)."""
    place = F.row_number().over(Window.partitionBy("project_id", "bidder_name").orderBy("id"))
    new = scored.select("project_id", "bidder_name", F.col("price_score").alias("_score"), F.col("price").alias("_price"))
    # Totals are taken before rows move, so that texts move only where they are asked for.
    other = F.col("other_total") if "other_total" in results.columns else _other_total(F.col("detailed_scores"))
    out = results.withColumn("_other", other).withColumn("_first", place == 1).join(new, ["project_id", "bidder_name"], "left")
    hit = F.col("_first") & F.col("_score").isNotNull()
    total = round_half_up(F.col("_other") + F.col("_score"))
    put = {"price_score": F.col("_score"), "extracted_price": F.coalesce("_price", "extracted_price"), "total_score": total}
    return out.withColumns({c: F.when(hit, x).otherwise(F.col(c)) for c, x in put.items()}).select(*results.columns)


def rank_bidders(results: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """results with rank 1..n in each project by total, missing totals last, equal ones by id."""
    by = order or [F.col("total_score").desc_nulls_last(), F.col("id")]
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy(*by)))


def ranking_summary(bids: DataFrame, results: DataFrame) -> DataFrame:
    return rank_bidders(bid_results(bids, results)).select("project_id", "rank", "bidder_name", "total_score", "price_score", "extracted_price")


def results_ordered(results: DataFrame) -> DataFrame:
    """Ranked results with a price score: the stored one, else that found in the items."""
    return rank_bidders(with_found_price_score(results, F.col("price_score").isNull()))


def bid_results(bids: DataFrame, results: DataFrame) -> DataFrame:
    """Results with a bid of the same project."""
    own = bids.select(F.col("id").alias("bid_document_id"), "project_id", F.col("processing_status"), F.col("file_path"))
    return results.join(own, ["bid_document_id", "project_id"])


def _children(rules: DataFrame) -> DataFrame:
    """Child rules that are no price rules: project_id, rule_id, parent, item."""
    return rules.where(F.col("Child_Item_Name").isNotNull() & ~F.coalesce("is_price_criteria", F.lit(False))).select("project_id", F.col("id").alias("rule_id"), F.col("Parent_Item_Name").alias("parent"), F.col("Child_Item_Name").alias("item"))


def _with_scores(results: DataFrame, last: bool = False) -> DataFrame:
    """results with _names and _scores, the names and the scores of its items, in order (or with last from the end)."""
    read = results.withColumn("_items", _listed(F.col("detailed_scores"), NAMED))
    names, scores = F.transform("_items", _name), F.transform("_items", lambda x: _number_in(x["score"]))
    return read.withColumns({"_names": F.reverse(names) if last else names, "_scores": F.reverse(scores) if last else scores}).drop("_items")


def _score_of(item: Column) -> Column:
    """The score of the first item of that name in _names; null without one."""
    return F.get("_scores", (F.array_position("_names", item) - 1).cast("int"))


def item_scores(results: DataFrame, rules: DataFrame, missing: float | None = None, last: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each result and child rule that is no price rule: the score of the first (or last) item of that name.
    Items are looked up in the result's own row, so results meet rules in one join by project. keep: more columns of results."""
    own = _with_scores(results, last).select("id", "project_id", "bidder_name", *keep, "_names", "_scores")
    out = own.join(_children(rules), "project_id").withColumn("score", _score_of(F.col("item")))
    return out.select("id", "item", "project_id", "bidder_name", *keep, "rule_id", "parent", F.coalesce("score", F.lit(missing).cast("double")).alias("score"))


def item_score_lists(results: DataFrame, rules: DataFrame) -> DataFrame:
    """project_id, bid_id (the result's id), scores: of each result, an array of (rule_id, score, reason, extracted_price) with
    the score of the first item of each child rule's name, and the result's price for each price rule."""
    flag = F.coalesce("is_price_criteria", F.lit(False))
    wanted = rules.where(flag | F.col("Child_Item_Name").isNotNull()).groupBy("project_id").agg(F.collect_list(F.struct(F.col("id").alias("rule_id"), flag.alias("price"), F.col("Child_Item_Name").alias("item"))).alias("_rules"))
    own = _with_scores(results).select("project_id", F.col("id").alias("bid_id"), "extracted_price", "_names", "_scores").join(wanted, "project_id")
    one = lambda r: F.struct(r["rule_id"].alias("rule_id"), F.when(~r["price"], _score_of(r["item"])).alias("score"), F.lit(None).cast("string").alias("reason"), F.when(r["price"], F.col("extracted_price")).alias("extracted_price"))
    return own.select("project_id", "bid_id", F.transform("_rules", one).alias("scores"))


def score_summary(results: DataFrame, rules: DataFrame, items: Sequence[str] | None = None) -> DataFrame:
    """A row a result: scores by item, price score, total over the present scores and the price score, rank by the stored
    total. With a list of items, one column each; else one map, so that projects may have any items."""
    # A project's child rules come to its results as one array, so that no row is multiplied and grouped again.
    children = _children(rules).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "item"))).alias("_rules"))
    own = _with_scores(rank_bidders(results)).select("id", "project_id", "bidder_name", "rank", F.coalesce("price_score", F.lit(0.0)).alias("price_score"), "_names", "_scores")
    own = own.join(children, "project_id", "left")
    of = own.withColumn("_all", F.transform("_rules", lambda r: F.struct(r["item"].alias("item"), _score_of(r["item"]).alias("score"))))
    if items:
        first = lambda name: F.get(F.filter("_all", lambda x: (x["item"] == name) & x["score"].isNotNull()), F.lit(0))["score"]
        wanted = [first(name).alias(name) for name in items]
    else:
        wanted = [F.map_from_entries(F.transform("_all", lambda x: F.struct(x["item"], F.coalesce(x["score"], F.lit(0.0))))).alias("item_scores")]
    total = round_half_up(F.coalesce(F.aggregate("_all", F.lit(0.0), lambda acc, x: acc + F.coalesce(x["score"], F.lit(0.0))), F.lit(0.0)) + F.col("price_score"))
    return of.select("id", "project_id", "bidder_name", "rank", "price_score", *wanted, total.alias("total"))


def display_table(bids: DataFrame, results: DataFrame, rules: DataFrame) -> DataFrame:
    """Long form for display: missing items count 0, two decimals, rank by total or 0."""
    own = bid_results(bids, results)
    ranked = rank_bidders(own, [F.coalesce("total_score", F.lit(0.0)).desc(), F.col("id")])
    return item_scores(ranked, rules, missing=0.0, last=True, keep=["rank"]).withColumn("score", round_half_up(F.col("score"))).select("project_id", "id", "bidder_name", "rank", "rule_id", "item", "score")


def summary_headers(rules: DataFrame) -> DataFrame:
    """project_id, row, pos, name, colspan, rowspan: rank, bidder, parents over their children, price, total; then children
    with their maxima, grouped by parent in order of their first rule."""
    kids = rules.where(F.col("Child_Item_Name").isNotNull() & ~F.coalesce("is_price_criteria", F.lit(False)))
    kids = kids.select("project_id", "id", F.coalesce("Parent_Item_Name", F.lit("")).alias("parent"), F.col("Child_Item_Name").alias("child"), F.col("Child_max_score").alias("m"))
    groups = kids.groupBy("project_id", "parent").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    in_order = Window.partitionBy("project_id").orderBy("first")
    groups = groups.withColumn("g", F.row_number().over(in_order))
    top = groups.select("project_id", F.lit(1).alias("row"), (F.col("g") + 2).alias("pos"), F.col("parent").alias("name"), F.col("n").alias("colspan"), F.lit(1).alias("rowspan"))
    n = groups.groupBy("project_id").agg(F.max("g").alias("g"))
    fixed = n.select("project_id", F.explode(F.array(*[F.struct(p.cast("int").alias("pos"), F.lit(t).alias("name")) for p, t in ((F.lit(1), "rank"), (F.lit(2), "bidder"), (F.col("g") + 3, "price"), (F.col("g") + 4, "total"))])).alias("x"))
    fixed = fixed.select("project_id", F.lit(1).alias("row"), "x.pos", "x.name", F.lit(1).cast("long").alias("colspan"), F.lit(2).alias("rowspan"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("g", "id"))
    low = kids.join(groups.select("project_id", "parent", "g"), ["project_id", "parent"]).select("project_id", F.lit(2).alias("row"), place.alias("pos"), F.concat("child", F.lit("("), F.coalesce(F.col("m").cast("string"), F.lit("")), F.lit(")")).alias("name"), F.lit(1).cast("long").alias("colspan"), F.lit(1).alias("rowspan"))
    return top.unionByName(fixed).unionByName(low)


def partial_results(results: DataFrame, n: int = 5) -> DataFrame:
    """id, partial: the first items of each result as JSON."""
    items = F.slice(F.from_json("detailed_scores", ITEMS), 1, n)
    short = F.transform(items, lambda x: F.struct(F.coalesce(x["Child_Item_Name"], x["criteria_name"]).alias("item"), x["score"].try_cast("double").alias("score")))
    return results.select("id", F.to_json(short).alias("partial"))


def _with_price(item: Column, new: Column, levels: int = LEVELS) -> Column:
    """A score item (variant) with the new price score, if it is a price item, and its children likewise."""
    said = {"score": new.cast("variant"), "reason": F.concat(F.lit(NEW_REASON), plain_number(new)).cast("variant"), "is_price_criteria": F.lit(True).cast("variant")}
    put = F.create_map(*[x for k, v in said.items() for x in (F.lit(k), v)])

    def changed(fields: Column) -> Column:
        out = F.when(_is_price_item(item), F.map_concat(F.map_filter(fields, lambda k, v: ~k.isin(*said)), put)).otherwise(fields)
        if levels > 1:
            kids = _field(item, "children", "array<variant>")
            below = F.create_map(F.lit("children"), F.to_variant_object(F.transform(kids, lambda x: _with_price(x, new, levels - 1))))
            out = let(out, lambda m: F.when(F.size(kids) > 0, F.map_concat(F.map_filter(m, lambda k, v: k != "children"), below)).otherwise(m))
        return F.to_variant_object(out)

    # An item that is no price and has no children stays as it is.
    fields = F.try_variant_get(item, "$", "map<string,variant>")
    touched = _is_price_item(item) if levels == 1 else _is_price_item(item) | F.coalesce(F.size(_field(item, "children", "array<variant>")) > 0, F.lit(False))
    return F.when(touched, F.coalesce(let(fields, lambda f: F.when(f.isNotNull(), changed(f))), item)).otherwise(item)


def update_price_in_scores(results: DataFrame, scored: DataFrame) -> DataFrame:
    """results whose price items in detailed_scores have the bidder's new price score: in a list the items named or flagged
    as prices at any depth, with reason and flag; in a map the values under keys that name a price. Everything else stays
    as it is (fields of objects come in order of name); so do texts that are neither, and bidders without one."""
    new = results.join(scored.select("project_id", "bidder_name", F.col("price_score").alias("_new")), ["project_id", "bidder_name"], "left")
    text, score = F.col("detailed_scores"), F.col("_new")
    new = new.withColumn("_tree", F.when(score.isNotNull(), F.try_parse_json(text))).withColumn("_deep", F.when(_may_hold(text, "children"), _deeper(_items(F.col("_tree")))).otherwise(False))
    tree, deep = F.col("_tree"), F.col("_deep")
    listed = F.to_json(F.transform(F.when(~deep, _items(tree)), lambda x: _with_price(x, score)))
    walked = _deep_with_price(F.when(deep, text), score, F.concat(F.lit(NEW_REASON), plain_number(score)))
    mapped = F.transform_values(F.try_variant_get(tree, "$", "map<string,variant>"), lambda k, v: F.when(any_of(k, PRICE_RULE_WORDS["scores"]), score.cast("variant")).otherwise(v))
    out = F.when(score.isNull(), text).when(deep, walked).otherwise(F.coalesce(listed, F.to_json(F.to_variant_object(mapped)), text))
    return new.withColumn("detailed_scores", out).select(*results.columns)


def merge_score_maps(results: DataFrame) -> DataFrame:
    """id, item, score: items of detailed_scores, with dynamic_scores (a number or an object with one) on top."""
    number = lambda v: F.coalesce(v.try_cast("double"), F.get_json_object(v, "$.score").try_cast("double"))

    def merged(items: Column, over: Column) -> Column:
        """Both are of one row, so they are merged in it: the last item of each name, then dynamic items of other names."""
        names = F.transform(items, lambda x: x["item"])
        pair = lambda item, score: F.struct(item.alias("item"), score.alias("score"))
        lasts = lambda n: F.filter(items, lambda x, i: ~F.exists(F.slice(n, i + 2, F.size(n)), lambda y: y.eqNullSafe(x["item"])))
        base = let(names, lambda n: F.transform(lasts(n), lambda x: pair(x["item"], F.coalesce(F.try_element_at(over, x["item"]), x["score"]))))
        more = let(names, lambda n: F.filter(F.map_entries(over), lambda e: ~F.coalesce(F.array_contains(n, e["key"]), F.lit(False))))
        return F.concat(base, F.transform(more, lambda e: pair(e["key"], e["value"])))

    none = F.array().cast("array<struct<pos:int,item:string,score:double,price_item:boolean,item_price:double>>")
    items = F.coalesce(_item_array(F.col("detailed_scores")), none)
    said = F.transform_values(F.from_json("dynamic_scores", "map<string,string>"), lambda k, v: number(v))
    over = F.coalesce(said, F.create_map().cast("map<string,double>"))
    both = let(items, lambda i: let(over, lambda o: merged(i, o)))
    return results.select("id", F.explode(both).alias("x")).select("id", "x.item", "x.score")


def price_audit(bids: DataFrame, results: DataFrame, rules: DataFrame) -> DataFrame:
    """Per bid: status, price, price items with a score, whether there is a result; and its project's rule counts."""
    items = score_items(results.select("bid_document_id", "detailed_scores")).groupBy("bid_document_id").agg(F.count_if("price_item").alias("price_items"))
    flag = F.coalesce("is_price_criteria", F.lit(False))
    counts = rules.groupBy("project_id").agg(F.count_if(F.col("Child_Item_Name").isNull() & ~flag).alias("parent_rules"), F.count_if(F.col("Child_Item_Name").isNotNull() & ~flag).alias("child_rules"), F.count_if(flag).alias("price_rules"))
    own = results.select("bid_document_id", "project_id", "extracted_price", F.lit(True).alias("has_result"))
    out = bids.select(F.col("id").alias("bid_document_id"), "project_id", "processing_status").join(own, ["bid_document_id", "project_id"], "left").join(items, "bid_document_id", "left").join(counts, "project_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("bid_document_id", "project_id", "processing_status", "extracted_price", F.coalesce("has_result", F.lit(False)).alias("has_result"), *map(zero, ("price_items", "parent_rules", "child_rules", "price_rules")))
