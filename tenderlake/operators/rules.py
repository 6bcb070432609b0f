"""Scoring rules: views, inheritance, checks, normalising, defaults, flattening of trees, rules out of rows and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import let, plain_number
from ..functions.text import clean_criteria_name, flags, is_price_rule, score_in_text, squeeze_text, strip
from ..sources.shared import written
from .similar import alike, groups, similar_names


def _flag() -> Column:
    return F.coalesce(F.col("is_price_criteria"), F.lit(False))


def rules_view(projects: DataFrame, rules: DataFrame) -> DataFrame:
    """project_id, category, name, max_score, description, weight: a project's stored summary (JSON list) wins over its rows."""
    name = F.coalesce(F.nullif("Child_Item_Name", F.lit("")), F.col("Parent_Item_Name"))
    top = F.coalesce(F.nullif("Child_max_score", F.lit(0)), F.col("Parent_max_score")).cast("double")
    rows = rules.select("project_id", F.col("Parent_Item_Name").alias("category"), name.alias("name"), top.alias("max_score"), "description", F.lit(1.0).alias("weight"))
    kind = "array<struct<category: string, criteria_name: string, max_score: double, description: string, weight: double>>"
    stored = projects.select(F.col("id").alias("project_id"), F.from_json("scoring_rules_summary", kind).alias("all")).where(F.size("all") > 0)
    own = stored.select("project_id", F.explode("all").alias("x")).select("project_id", "x.category", F.col("x.criteria_name").alias("name"), "x.max_score", "x.description", F.coalesce("x.weight", F.lit(1.0)).alias("weight"))
    return rows.join(stored.select("project_id"), "project_id", "left_anti").unionByName(own)


def inherit_parent(rules: DataFrame) -> DataFrame:
    """Missing parent names and parent maxima (null, empty, 0) filled from the rule before, each on its own, by id."""
    before = Window.partitionBy("project_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    name = F.last(F.nullif("Parent_Item_Name", F.lit("")), ignorenulls=True).over(before)
    top = F.last(F.nullif("Parent_max_score", F.lit(0)), ignorenulls=True).over(before)
    return rules.withColumns({"Parent_Item_Name": name, "Parent_max_score": top})


def drop_incomplete_rules(rules: DataFrame) -> DataFrame:
    return rules.where(_flag() | F.nullif("Child_Item_Name", F.lit("")).isNotNull() | F.nullif("Child_max_score", F.lit(0)).isNotNull())


def parent_max_totals(rules: DataFrame) -> DataFrame:
    """project_id, pos, parent, max_score, children: parents by their first rule, price rules last as one child 价格分."""
    kids = rules.where(~_flag() & F.nullif("Parent_Item_Name", F.lit("")).isNotNull() & F.nullif("Child_Item_Name", F.lit("")).isNotNull())
    of = kids.groupBy("project_id", F.col("Parent_Item_Name").alias("parent")).agg(F.min("id").alias("first"), F.sum(F.coalesce("Child_max_score", F.lit(0))).cast("double").alias("max_score"), F.array_sort(F.collect_list(F.struct("id", "Child_Item_Name"))).alias("all"))
    of = of.select("project_id", F.lit(0).alias("last"), "first", "parent", "max_score", F.array_join(F.transform("all", lambda x: x["Child_Item_Name"]), ",").alias("children"))
    top = F.coalesce(F.nullif("Child_max_score", F.lit(0)), F.col("Parent_max_score")).cast("double")
    price = rules.where(_flag()).select("project_id", F.lit(1).alias("last"), F.col("id").alias("first"), F.coalesce("Parent_Item_Name", F.lit("价格分")).alias("parent"), top.alias("max_score"), F.lit("价格分").alias("children"))
    pos = F.row_number().over(Window.partitionBy("project_id").orderBy("last", "first"))
    return of.unionByName(price).select("project_id", pos.alias("pos"), "parent", "max_score", "children")


def _parents(rules: DataFrame, project: str = "project_id") -> tuple[DataFrame, DataFrame]:
    """Parents of rules that are no price rules (project, parent, m: what they state, sums: their children's sum, null
    without children, top: m made sums where both differ by more than 0.1), and each project's last price rule (price)."""
    has = F.nullif("Child_Item_Name", F.lit("")).isNotNull()
    kids = F.sum(F.when(has, F.coalesce(F.col("Child_max_score"), F.lit(0)).cast("double")))
    own = rules.where(~_flag()).groupBy(project, F.col("Parent_Item_Name").alias("parent")).agg(F.coalesce(F.max("Parent_max_score"), F.lit(0)).cast("double").alias("m"), kids.alias("sums"))
    own = own.withColumn("top", F.when(F.abs(F.col("m") - F.col("sums")) > 0.1, F.col("sums")).otherwise(F.col("m")))
    top = F.coalesce(F.nullif("Child_max_score", F.lit(0)), F.col("Parent_max_score")).cast("double")
    return own, rules.where(_flag()).groupBy(project).agg(F.max_by(top, "id").alias("price"))


def rule_total_check(rules: DataFrame, target: float = 100.0, tolerance: float = 0.1) -> DataFrame:
    """project_id, total, off (total isn't the target), parents_off (parents whose maximum isn't their children's sum).
    Parents without children count by their own maximum; of several price rules the last one counts."""
    own, price = _parents(rules)
    of = own.groupBy("project_id").agg(F.sum("top").alias("s"), F.count_if(F.abs(F.col("sums") - F.col("m")) > tolerance).alias("parents_off"))
    out = of.join(price, "project_id", "full").withColumn("total", F.coalesce("s", F.lit(0.0)) + F.coalesce("price", F.lit(0.0)))
    return out.select("project_id", "total", (F.abs(F.col("total") - target) > tolerance).alias("off"), F.coalesce("parents_off", F.lit(0)).alias("parents_off"))


def normalise_to_100(rules: DataFrame) -> DataFrame:
    """Parents' maxima made their children's sums (those without children keep theirs); where the total isn't 100 and the
    last price rule has more than 30, the other rules are scaled to 100 less its maximum. Adds parent_max and child_max."""
    own, price = _parents(rules)
    of = own.groupBy("project_id").agg(F.sum("top").alias("others")).join(price, "project_id", "left").withColumn("price", F.coalesce("price", F.lit(0.0)))
    scale = F.when((F.abs(F.col("others") + F.col("price") - 100) > 0.1) & (F.col("price") > 30) & (F.col("others") > 0), (100 - F.col("price")) / F.col("others")).otherwise(1.0)
    tops = own.join(of.select("project_id", scale.alias("scale")), "project_id").select(F.col("project_id").alias("_project"), "parent", F.col("top") * F.col("scale"), "scale").toDF("_project", "parent", "_top", "_scale")
    rows = rules.join(tops, ~_flag() & (F.col("project_id") == F.col("_project")) & F.col("Parent_Item_Name").eqNullSafe(F.col("parent")), "left")
    stated = F.coalesce(F.nullif("Child_max_score", F.lit(0)), F.col("Parent_max_score")).cast("double")
    child = F.when(F.nullif("Child_Item_Name", F.lit("")).isNotNull(), F.coalesce("Child_max_score", F.lit(0)).cast("double") * F.col("_scale"))
    return rows.withColumns({"parent_max": F.when(_flag(), stated).otherwise(F.col("_top")), "child_max": F.when(~_flag(), child)}).select(*rules.columns, "parent_max", "child_max")


# The rules a project gets that has none.
DEFAULTS = [(1, "技术方案", 60, "技术方案评分", False, ""), (2, "价格分", 40, "价格分计算公式：评标基准价为各有效投标人投标报价的算术平均值，价格分=评标基准价/投标报价*价格分值", True, "")]


def default_rules(projects: DataFrame, rules: DataFrame) -> DataFrame:
    """project_id, nth, name, max_score, description, is_price_criteria for projects without rules."""
    without = projects.select(F.col("id").alias("project_id")).join(rules.select("project_id").distinct(), "project_id", "left_anti")
    each = F.array(*[F.struct(F.lit(n).alias("nth"), F.lit(name).alias("name"), F.lit(float(top)).alias("max_score"), F.lit(text).alias("description"), F.lit(flag).alias("is_price_criteria")) for n, name, top, text, flag, _ in DEFAULTS])
    return without.select("project_id", F.explode(each).alias("x")).select("project_id", "x.*")


def standard_rules(rules: DataFrame) -> DataFrame:
    """What is left without price rules: item, max_score, description."""
    return rules.where(~_flag()).select("project_id", F.coalesce(F.nullif("Child_Item_Name", F.lit("")), F.col("Parent_Item_Name")).alias("item"), F.coalesce("Child_max_score", "Parent_max_score").alias("max_score"), "description")


# Reasons that no answer gives.
VETO_REASON, SUM_REASON, PENDING_REASON = "否决项规则，需人工核查是否违反", "分数由子项汇总得出。", "价格分需要等所有投标方分析完成后综合计算。已提取报价: "


def veto_and_tree_scores(rules: DataFrame, leaf_scores: DataFrame) -> DataFrame:
    """project_id, bid_id, rule_id, name, level, max_score, score, reason, is_veto, leaves. Leaves (level 2) have their scores
    out of leaf_scores (project_id, bid_id, rule_id, score and perhaps reason, extracted_price), by the id of their rule, as
    items of one name may stand under several parents (or in scores, an array of these for each bid); a veto rule has maximum and score 0 and a fixed reason; a price rule
    has score 0 until prices are compared, and a reason that holds its price. Parents (level 1, without a rule id) have the
    sum of their leaves, whose number is leaves. Scores without a rule id go to the rules of their item's name (item)."""
    by_id = "scores" in leaf_scores.columns or "rule_id" in leaf_scores.columns
    key = "rule_id" if by_id else "item"
    if "scores" in leaf_scores.columns:
        of_bid = leaf_scores.select("project_id", "bid_id", F.transform("scores", lambda x: F.struct(x["rule_id"].alias("key"), x["score"].alias("given"), x["reason"].alias("said"), x["extracted_price"].alias("extracted_price"))).alias("_given"))
    else:
        text = lambda c, kind: F.col(c) if c in leaf_scores.columns else F.lit(None).cast(kind)
        one = F.struct(F.col(key).alias("key"), F.col("score").alias("given"), text("reason", "string").alias("said"), text("extracted_price", "double").alias("extracted_price"))
        of_bid = leaf_scores.groupBy("project_id", "bid_id").agg(F.collect_list(one).alias("_given"))
    # A project's rules come to its bids as one map, so that no score is moved by itself: leaves and parents are worked out
    # in the row of their bid.
    top = F.coalesce(F.nullif("Child_max_score", F.lit(0)), F.col("Parent_max_score")).cast("double")
    item = F.coalesce("Child_Item_Name", "Parent_Item_Name")
    kid = F.struct(F.col("id").alias("rule_id"), F.col("Parent_Item_Name").alias("parent"), item.alias("item"), F.coalesce("is_veto", F.lit(False)).alias("is_veto"), _flag().alias("price_leaf"), top.alias("max_score"), F.col("Child_Item_Name").isNotNull().alias("is_child"), F.coalesce("Parent_max_score", F.lit(0)).cast("double").alias("parent_max"))
    kids = rules.where(_flag() | F.col("Child_Item_Name").isNotNull()).withColumn("_key", F.col("id") if by_id else item).where("_key is not null")
    kids = kids.groupBy("project_id", "_key").agg(F.collect_list(kid).alias("_same")).groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("_key", "_same"))).alias("_kids"))

    def leaf(g: Column, k: Column) -> Column:
        pending = F.concat(F.lit(PENDING_REASON), F.coalesce(plain_number(g["extracted_price"]), F.lit("None")))
        reason = F.when(k["is_veto"], VETO_REASON).when(k["price_leaf"], pending).otherwise(g["said"])
        score = F.when(k["is_veto"] | k["price_leaf"], 0.0).otherwise(F.coalesce(g["given"].cast("double"), F.lit(0.0)))
        row = _tree_row(k["rule_id"], k["item"], F.when(k["is_child"], 2).otherwise(1), F.when(k["is_veto"], 0.0).otherwise(k["max_score"]), score, reason, k["is_veto"], F.lit(1))
        return F.struct(row.alias("row"), k["is_child"].alias("is_child"), F.coalesce(k["parent"], F.lit("")).alias("parent"), k["parent_max"].alias("parent_max"))

    def parent(name: Column, all_: Column) -> Column:
        own = F.filter(all_, lambda x: x["is_child"] & (x["parent"] == name))
        total = lambda of: F.aggregate(of, F.lit(0.0), lambda acc, x: acc + x["row"]["score"])
        return let(own, lambda of: _tree_row(F.lit(None), name, F.lit(1), F.array_max(F.transform(of, lambda x: x["parent_max"])), total(of), F.lit(SUM_REASON), F.lit(False), F.size(of)))

    def whole(all_: Column) -> Column:
        parents = F.array_distinct(F.transform(F.filter(all_, lambda x: x["is_child"]), lambda x: x["parent"]))
        return F.concat(F.transform(all_, lambda x: x["row"]), F.transform(parents, lambda name: parent(name, all_)))

    met = F.flatten(F.transform("_given", lambda g: F.coalesce(F.transform(F.try_element_at("_kids", g["key"]), lambda k: leaf(g, k)), F.array())))
    return of_bid.join(kids, "project_id").select("project_id", "bid_id", F.inline(let(met, whole)))


def _tree_row(rule_id: Column, name: Column, level: Column, top: Column, score: Column, reason: Column, veto: Column, leaves: Column) -> Column:
    return F.struct(rule_id.cast("long").alias("rule_id"), name.alias("name"), level.cast("int").alias("level"), top.cast("double").alias("max_score"), score.cast("double").alias("score"), reason.alias("reason"), veto.alias("is_veto"), leaves.cast("long").alias("leaves"))


def flatten_rules(tree: DataFrame, live: bool = True) -> DataFrame:
    """Rule rows of trees (project_id, nth, criteria_name, max_score, description, is_price_criteria, children). live: a
    parent row where there are children or a price rule, else a leaf under its own name; otherwise child rows without
    their parent's name, texts cut, integer maxima, 0 as missing."""
    has = F.size(F.coalesce(F.col("children"), F.array().cast(tree.schema["children"].dataType))) > 0
    kid = tree.where(has).select("project_id", "nth", F.col("criteria_name").alias("parent"), F.col("max_score").alias("top"), F.posexplode("children").alias("k", "c"))
    if live:
        heads = tree.select("project_id", "nth", F.lit(-1).alias("k"), F.col("criteria_name").alias("Parent_Item_Name"), F.when(has | _flag(), F.col("max_score")).cast("int").alias("Parent_max_score"), F.when(~has & ~_flag(), F.col("criteria_name")).alias("Child_Item_Name"), F.when(~has & ~_flag(), F.col("max_score")).cast("int").alias("Child_max_score"), "description", _flag().alias("is_price_criteria"))
        leaves = kid.select("project_id", "nth", "k", F.col("parent").alias("Parent_Item_Name"), F.lit(None).cast("int").alias("Parent_max_score"), F.col("c.criteria_name").alias("Child_Item_Name"), F.col("c.max_score").cast("int").alias("Child_max_score"), F.col("c.description").alias("description"), F.coalesce("c.is_price_criteria", F.lit(False)).alias("is_price_criteria"))
    else:
        zero = lambda c: F.nullif(c.cast("int"), F.lit(0))
        heads = tree.select("project_id", "nth", F.lit(-1).alias("k"), F.substring("criteria_name", 1, 20).alias("Parent_Item_Name"), zero(F.col("max_score")).alias("Parent_max_score"), F.lit(None).cast("string").alias("Child_Item_Name"), F.lit(None).cast("int").alias("Child_max_score"), F.substring("description", 1, 100).alias("description"), _flag().alias("is_price_criteria"))
        leaves = kid.select("project_id", "nth", "k", F.lit(None).cast("string").alias("Parent_Item_Name"), F.lit(None).cast("int").alias("Parent_max_score"), F.substring("c.criteria_name", 1, 20).alias("Child_Item_Name"), zero(F.col("c.max_score")).alias("Child_max_score"), F.substring("c.description", 1, 100).alias("description"), F.coalesce("c.is_price_criteria", F.lit(False)).alias("is_price_criteria"))
    out = heads.unionByName(leaves)
    return out.withColumn("id", F.row_number().over(Window.partitionBy("project_id").orderBy("nth", "k"))).drop("nth", "k")


def number_rules(rows: DataFrame) -> DataFrame:
    """rows (doc, row_no, project_cell, ...) with parent_no and child_no: a row with a project cell starts a parent, the
    others are its children; rows before the first parent are left out."""
    order = Window.partitionBy("doc").orderBy("row_no")
    is_parent = F.coalesce(strip(F.col("project_cell")) != "", F.lit(False))
    out = rows.withColumn("_p", is_parent).withColumn("parent_no", F.sum(F.col("_p").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).where("parent_no > 0")
    nth = F.sum((~F.col("_p")).cast("int")).over(Window.partitionBy("doc", "parent_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("child_no", F.when(~F.col("_p"), nth.cast("int"))).drop("_p")


def attach_parent(rules: DataFrame, block: int = 1024) -> DataFrame:
    """rules (doc, numbering array<string>) with parent: the numbering of the nearest rule before, in order of numbering,
    that is less deep, whatever the depth. A stack of the rules that may still become parents is folded over blocks of a
    document's numberings; what a block leaves on the stack is carried to the blocks after it."""
    each = rules.where("numbering is not null").select("doc", "numbering").distinct()
    each = each.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("numbering")))
    one = F.struct("n", F.size("numbering").alias("depth"), "numbering")
    blocks = each.groupBy("doc", F.floor(F.col("n") / block).alias("b")).agg(F.array_sort(F.collect_list(one)).alias("all"), F.min(F.size("numbering")).alias("least"))
    numbering, stack = rules.schema["numbering"].dataType.simpleString(), f"array<{blocks.schema['all'].dataType.elementType.simpleString()}>"
    nearest = lambda open_, depth: F.try_element_at(F.filter(open_, lambda e: e["depth"] < depth), F.lit(-1))["numbering"]

    def step(state: Column, x: Column) -> Column:
        return let(F.filter(state["open"], lambda e: e["depth"] < x["depth"]), lambda open_: F.struct(F.concat(open_, F.array(x)).alias("open"), F.concat(state["parents"], F.array(F.try_element_at(open_, F.lit(-1))["numbering"])).alias("parents")))

    folded = blocks.withColumn("f", F.aggregate("all", F.struct(F.array().cast(stack).alias("open"), F.array().cast(f"array<{numbering}>").alias("parents")), step))

    def carry(state: Column, x: Column) -> Column:
        kept = F.filter(state["open"], lambda e: e["depth"] < x["least"])
        return F.struct(F.concat(kept, x["open"]).alias("open"), F.concat(state["before"], F.array(F.struct(x["b"].alias("b"), state["open"].alias("open")))).alias("before"))

    of = folded.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("b", "least", F.col("f.open").alias("open")))).alias("blocks"))
    before = F.aggregate("blocks", F.struct(F.array().cast(stack).alias("open"), F.array().cast(f"array<struct<b:bigint,open:{stack}>>").alias("before")), carry)["before"]
    carried = of.select("doc", F.explode(before).alias("x")).select("doc", "x.b", F.col("x.open").alias("open"))
    own = F.transform("all", lambda x, i: F.struct(x["numbering"].alias("numbering"), F.coalesce(F.get("f.parents", i), nearest(F.col("open"), x["depth"])).alias("parent")))
    found = folded.join(carried, ["doc", "b"]).select("doc", F.explode(own).alias("x")).select("doc", "x.numbering", "x.parent")
    return rules.join(found, ["doc", "numbering"], "left").select(*rules.columns, "parent")


def rules_from_rows(rows: DataFrame) -> DataFrame:
    """Rules of table rows (doc, row_no, project_cell, detail, standard): parents and children numbered, names squeezed,
    score from the name's or the standard's text; a price row's detail is its description and it has no child."""
    n = number_rules(rows)
    is_parent = F.col("child_no").isNull()
    price = is_price_rule("rows", F.col("project_cell"), F.col("standard"))
    name = squeeze_text(F.when(is_parent, F.col("project_cell")).otherwise(F.col("detail")))
    score = F.greatest(score_in_text(F.col("detail")), score_in_text(F.col("standard")))
    out = n.select("doc", "parent_no", "child_no", name.alias("criteria_name"), score.alias("max_score"), F.when(is_parent & price, squeeze_text(F.col("detail"))).otherwise(squeeze_text(F.col("standard"))).alias("description"), (is_parent & price).alias("is_price_criteria"))
    under = F.max(F.col("is_price_criteria").cast("int")).over(Window.partitionBy("doc", "parent_no"))
    return out.withColumn("_u", under).where(F.col("child_no").isNull() | (F.col("_u") == 0)).drop("_u")


# Patterns of a rule in a line of text.
LINE_RULES = [r"^\s*([（\(]?\s*(?:价格分|报价分)\s*[）\)]?.*?)[\s（\(]+(\d{1,2}(?:\.\d)?)\s*分[\)）]?", r"([^\n\(]*?[一-龥]+[^\n\)]*?)\s*[\(（]\s*(\d{1,2}(?:\.\d)?)\s*分\s*[\)）]", r"([^\n\(]*?[一-龥]+[^\n\)]*?)\s+(\d{1,2}(?:\.\d)?)\s*分"]
# What every match of these patterns ends in, or holds: it is found in one pass, where a pattern goes back and forth.
LINE_ENDS_IN = [r"(?:价格分|报价分)", r"[\(（]\s*\d{1,2}(?:\.\d)?\s*分\s*[\)）]", r"\s\d{1,2}(?:\.\d)?\s*分"]


def rules_from_text(lines: DataFrame, patterns: list[str] = LINE_RULES, price_words: list[str] | None = None, fold: bool = True) -> DataFrame:
    """Rules in lines (doc, line_no, line): every match of every pattern with a valid score and a name of 3 to 99
    characters; numbered in order of line, pattern and match. With fold, similar rules of a document become one."""
    line = F.col("line")

    def matches(p: str) -> Column:
        q = flags(p)
        groups_ = lambda text: F.struct(F.regexp_extract(text, q, 1).alias("a"), F.regexp_extract(text, q, 2).alias("b"))
        if p not in LINE_RULES:
            return F.arrays_zip(F.regexp_extract_all(line, F.lit(q), F.lit(1)).alias("a"), F.regexp_extract_all(line, F.lit(q), F.lit(2)).alias("b"))
        # The groups are read out of the match, and lines without what the pattern ends in are not gone through.
        may = line.rlike(f"(?U){LINE_ENDS_IN[LINE_RULES.index(p)]}")
        return F.when(may, F.transform(F.regexp_extract_all(line, F.lit(q), F.lit(0)), groups_))

    def named(x: Column) -> Column:
        return F.struct(clean_criteria_name(x["a"]).alias("criteria_name"), x["b"].try_cast("double").alias("max_score"))

    none = F.array().cast("array<struct<a:string,b:string>>")
    every = F.transform(F.concat(*[F.coalesce(matches(p), none) for p in patterns]), named)
    fine = F.filter(every, lambda x: (F.length(x["criteria_name"]) > 2) & (F.length(x["criteria_name"]) < 100) & (x["max_score"] > 0))
    # Lines are short and their patterns dear, so they are dealt out to all tasks, however few files they come from.
    own = lines.where(line.contains("分")) if all(p in LINE_RULES for p in patterns) else lines
    found = own.repartition("doc", "line_no").select("doc", "line_no", F.posexplode(fine).alias("k", "x")).select("doc", "line_no", "k", "x.*")
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("line_no", "k"))
    out = found.select("doc", nth.alias("nth"), "criteria_name", "max_score")
    out = dedupe_similar_rules(out) if fold else out
    return out.select("doc", "nth", "criteria_name", "max_score", F.col("criteria_name").alias("description"), is_price_rule("text", F.col("criteria_name"), words=price_words).alias("is_price_criteria"))


def dedupe_similar_rules(rules: DataFrame, threshold: float = 0.8, fold: int = 256) -> DataFrame:
    """Greedy by order (nth) in each doc: a rule similar to one kept before (equal, contained, or alike in characters)
    gives way to it, or takes its place if its maximum is higher. Documents of up to ``fold`` rules are gone through in a row. Of
    longer ones the similar names are joined first, as a rule's fate depends on those alone that a chain of similar names
    leads to: each such group is gone through by itself, and no row holds the document."""
    kind = "array<struct<born:int,nth:int,criteria_name:string,max_score:double>>"

    def step(kept: Column, x: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda y: alike(y["criteria_name"], x["criteria_name"], threshold)), F.lit(True))
        instead = lambda y: F.struct(y["born"].alias("born"), x["nth"].alias("nth"), x["criteria_name"].alias("criteria_name"), x["max_score"].alias("max_score"))
        swapped = F.transform(kept, lambda y, i: F.when((i + 1 == at) & (x["max_score"] > y["max_score"]), instead(y)).otherwise(y))
        return F.when(at == 0, F.concat(kept, F.array(x))).otherwise(swapped)

    nth = F.col("nth").cast("int")
    one = F.struct(nth.alias("born"), nth.alias("nth"), F.col("criteria_name"), F.col("max_score").cast("double").alias("max_score"))

    def chosen(rows: DataFrame, by: list[str]) -> DataFrame:
        kept = F.aggregate("all", F.array().cast(kind), step)
        return rows.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("all")).select("doc", F.explode(kept).alias("x")).select("doc", "x.*")

    rows = written(rules.select("doc", "nth", F.coalesce("criteria_name", F.lit("")).alias("criteria_name"), "max_score"))
    long = written(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fold).select("doc"))
    out = chosen(rows.join(long, "doc", "left_anti"), ["doc"])
    if not long.isEmpty():
        more = rows.join(long, "doc", "left_semi")
        names = written(more.select("doc", F.col("criteria_name").alias("name")).distinct().withColumn("node", F.monotonically_increasing_id()))
        grouped = names.join(groups(names, similar_names(names, threshold)), "node").select("doc", F.col("name").alias("criteria_name"), "grp")
        out = out.unionByName(chosen(more.join(grouped, ["doc", "criteria_name"]), ["doc", "grp"]))
    slot = F.row_number().over(Window.partitionBy("doc").orderBy("born")) - 1
    return out.select("doc", slot.alias("slot"), "nth", "criteria_name", "max_score")


# Where a price rule is described and scored in a text.
PRICE_TEXTS = [r"(?s)(评标基准价.*?价格分.*?)", r"(?s)(价格分.*?评标基准价.*?)", r"(?s)(基准价.*?价格分.*?)", r"(?s)价格分计算[：:]\s*(.*?)(?=\n\n|\z)", r"(?s)价格评分[：:]\s*(.*?)(?=\n\n|\z)"]
PRICE_POINTS = [r"价格分\s*[:：]?\s*(\d{1,2}(?:\.\d)?)\s*分", r"(\d{1,2}(?:\.\d)?)\s*分\s*\(价格分\)", r"价格.*?(\d{1,2}(?:\.\d)?)\s*分"]


def price_rule_from_text(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (doc, nth, criteria_name, max_score, description, is_price_criteria) where the text (doc, text) of a document
    states a price rule of more than 10 points: its first flagged rule becomes it, or it is added as number 99."""
    t = F.col("text")
    said = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(t, f"(?U){p}", 1)), F.lit("")) for p in PRICE_TEXTS], F.lit("价格分计算"))
    points = lambda p: F.regexp_extract(t, f"(?U){p}", 1).try_cast("double")
    top = F.coalesce(*[F.when(points(p) > 10, points(p)) for p in PRICE_POINTS])
    found = texts.select("doc", top.alias("top"), said.alias("said")).where("top is not null")
    first = rules.where(_flag()).groupBy("doc").agg(F.min("nth").alias("nth"))
    at = found.join(first, "doc", "left").select("doc", F.coalesce("nth", F.lit(99)).alias("nth"), F.lit("价格分").alias("criteria_name"), F.col("top").alias("max_score"), F.col("said").alias("description"), F.lit(True).alias("is_price_criteria"))
    return rules.join(at.select("doc", "nth"), ["doc", "nth"], "left_anti").unionByName(at.select(*rules.columns))


def adjusted_tree(rules: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """rules (doc, parent_no, child_no, criteria_name, max_score, description, is_price_criteria) with parents' maxima and
    totals as normalise_to_100 makes them. Documents of docs (doc) that have no rule get the default ones."""
    flat = rules.select(F.col("doc").alias("project_id"), F.struct("parent_no", "child_no").alias("id"), F.col("parent_no").alias("Parent_Item_Name"), F.when(F.col("child_no").isNull(), F.col("max_score")).alias("Parent_max_score"), F.when(F.col("child_no").isNotNull(), F.col("criteria_name")).alias("Child_Item_Name"), F.when(F.col("child_no").isNotNull(), F.col("max_score")).alias("Child_max_score"), "is_price_criteria", F.struct("criteria_name", "description").alias("said"))
    top = F.when(F.col("id.child_no").isNotNull(), F.col("child_max")).otherwise(F.col("parent_max"))
    out = normalise_to_100(flat).select(F.col("project_id").alias("doc"), "id.parent_no", "id.child_no", "said.criteria_name", top.alias("max_score"), "said.description", "is_price_criteria")
    if docs is None:
        return out
    missing = default_rules(docs.select(F.col("doc").alias("id")).distinct(), out.select(F.col("doc").alias("project_id")))
    return out.unionByName(missing.select(F.col("project_id").alias("doc"), F.col("nth").alias("parent_no"), F.lit(None).cast("int").alias("child_no"), F.col("name").alias("criteria_name"), "max_score", "description", "is_price_criteria"))
