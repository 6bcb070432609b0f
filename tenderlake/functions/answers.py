"""Model answers and formulas: scores and prices out of free text, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import let
from .text import any_of, strip

CONTEXT_LIMIT = 8000
# Patterns of answers and formulas.
FENCED = r"(?s)```json\s*(\{.*?\})\s*```"
BRACED = r"(?s)(\{.*?\})"
POINTS = r"(?U)(\d+(?:\.\d+)?)\s*分"
DEFAULT_REASON = "未提供理由。"
FORMULA_MARK, VARIABLES_MARK, NOTES_MARK = "价格计算公式:", "变量定义:", "计算说明:"
ANSWER_FORMULAS = [r"投标报价得分\s*[:：]?\s*[=＝][^;\n]*", r"价格分\s*[:：]?\s*[=＝][^;\n]*", r"得分\s*[:：]?\s*[=＝][^;\n]*", r"评标基准价\s*[:：]?\s*[=＝][^;\n]*"]
STANDARD_FORMULAS = [
    r"投标报价得分[^\n]*?[=＝][^\n]*",
    r"价格分[^\n]*?[=＝][^\n]*",
    r"得分[^\n]*?[=＝][^\n]*?投标.*?价.*?\/.*?投标.*?价.*?[\*×].*?100",
    r"评标基准价[^\n]*?[=＝][^\n]*",
    r"基准价[^\n]*?[=＝][^\n]*",
    r"投标报价得分.*?＝.*?评标基准价.*?／.*?投标报价.*?×.*?价格分值",
    r"满足招标文件要求且投标报价最低的投标报价为评标基准价，其价格分为满分。其他投标人的价格分统一按照下列公式计算：投标报价得分＝（评标基准价/投标报价）\*40%*100",
]
PRICE_LINE = r'"([^"]+)"\s*:\s*([0-9]+\.?[0-9]*)'
FORMULA_WORDS = ["评标基准价", "投标报价", "价格分", "得分", "满分", "最低"]


def _first(text: Column, patterns: list[str], group: int = 0) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?U){p}", group), F.lit("")) for p in patterns])


def parse_score_answer(response: Column, max_score: Column) -> Column:
    """struct(score, reason): the JSON object of the answer, or else its first points; scores are kept in 0..max_score."""
    top = max_score.cast("double")
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(x, top))
    make = lambda score, reason: F.struct(score.cast("double").alias("score"), reason.alias("reason"))
    head = F.substring(response, 1, 200)
    # Each step is worked out once, and only for the answers that come to it.
    fenced = F.when(response.contains("```json"), F.nullif(F.regexp_extract(response, FENCED, 1), F.lit("")))
    braced = F.when(response.contains("{"), F.nullif(F.regexp_extract(response, BRACED, 1), F.lit("")))

    def of_object(found: Column, tree: Column) -> Column:
        kind = lambda name, body: let(F.schema_of_variant(F.variant_get(tree, f"$.{name}", "variant")), body)
        a_number = lambda k: k.startswith("BIGINT") | k.startswith("DOUBLE") | k.startswith("DECIMAL") | k.startswith("FLOAT")
        score = kind("score", lambda k: F.when(a_number(k), let(F.try_variant_get(tree, "$.score", "double"), lambda x: F.when(F.abs(x) < float("inf"), x))))
        # A reason that is no string is told as it is written, so the text is read once more.
        reason = kind("reason", lambda k: F.when(k == "STRING", F.try_variant_get(tree, "$.reason", "string")).when(k.isNotNull(), F.from_json(found, "reason string")["reason"]))
        read = make(clamp(F.coalesce(score, F.lit(0.0))), F.coalesce(reason, F.lit(DEFAULT_REASON)))
        return F.when(tree.isNull(), make(F.lit(0.0), F.lit("解析AI响应失败。"))).otherwise(read)

    of_points = lambda points: F.when(points.isNotNull(), make(clamp(points), F.concat(F.lit("从文本中提取到分数: "), head))).otherwise(make(F.lit(0.0), head))
    of_text = let(F.regexp_extract(response, POINTS, 1).try_cast("double"), of_points)
    of_answer = let(F.coalesce(fenced, braced), lambda found: F.when(found.isNull(), of_text).otherwise(let(F.try_parse_json(found), lambda tree: of_object(found, tree))))
    failed = make(F.lit(0.0), F.concat(F.lit("模型调用失败: "), F.coalesce(head, F.lit(""))))
    return F.when(response.isNull() | response.contains("Error:"), failed).otherwise(of_answer)


def parse_price_answer(response: Column) -> Column:
    """map(bidder, score) of the first reading that works: the whole text as an object (even an empty one), objects in it,
    the first "name": number of each line. Values that are no numbers are left out."""
    number = lambda m: F.map_filter(F.transform_values(m, lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())
    whole = F.when(F.try_parse_json(response).isNotNull() & response.rlike(r"^\s*\{"), F.from_json(response, "map<string,string>"))
    objects = F.transform(F.regexp_extract_all(response, F.lit(r"(\{[^}]+\})"), F.lit(1)), lambda x: number(F.coalesce(F.from_json(x, "map<string,string>"), F.create_map().cast("map<string,string>"))))
    merged = F.aggregate(objects, F.create_map().cast("map<string,double>"), lambda acc, m: F.map_from_entries(F.concat(F.map_entries(F.map_filter(acc, lambda k, v: ~F.map_contains_key(m, k))), F.map_entries(m))))
    said = lambda x: F.struct(F.regexp_extract(x, PRICE_LINE, 1).alias("n"), F.regexp_extract(x, PRICE_LINE, 2).alias("v"))
    pairs = F.filter(F.transform(F.split(strip(response), "\n"), said), lambda p: p["v"] != "")
    lines = F.aggregate(pairs, F.create_map().cast("map<string,double>"), lambda acc, p: F.map_from_entries(F.concat(F.map_entries(F.map_filter(acc, lambda k, v: k != p["n"])), F.array(F.struct(p["n"].alias("key"), p["v"].try_cast("double").alias("value"))))))
    return F.coalesce(F.when(whole.isNotNull(), number(whole)), F.when(F.size(merged) > 0, merged), lines)


def parse_formula(text: Column) -> Column:
    """struct(formula, definition, explanation, benchmark, full_score) of a described price formula."""
    after = lambda mark: F.nullif(strip(F.regexp_extract(text, f"{mark}([^\n]*)", 1)), F.lit(""))
    lines = F.split(text, "\n")
    plain = F.get(F.filter(lines, lambda x: x.contains("=") | (x.contains("/") & x.rlike("[×*]"))), F.lit(0))
    formula = F.when(text.contains(FORMULA_MARK), F.coalesce(after(FORMULA_MARK), text)).otherwise(F.coalesce(F.when(text.contains(":"), strip(plain)), text))
    benchmark = F.when(any_of(text, ["评标基准价", "基准价"]), F.lit("基准价"))
    full = F.coalesce(F.regexp_extract(text, POINTS, 1).try_cast("double"), F.regexp_extract(text, r"(?U)满分\s*(\d+(?:\.\d+)?)", 1).try_cast("double"))
    return F.struct(formula.alias("formula"), after(VARIABLES_MARK).alias("definition"), after(NOTES_MARK).alias("explanation"), benchmark.alias("benchmark"), full.alias("full_score"))


def formula_from_answer(text: Column) -> Column:
    """First line after the mark, else the first formula, else the first 200 characters."""
    marked = F.substring_index(F.regexp_extract(text, f"(?s){FORMULA_MARK}\\s*(.*)", 1), "\n", 1)
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, "").when(text.contains(FORMULA_MARK), strip(marked)).otherwise(F.coalesce(_first(text, ANSWER_FORMULAS), F.substring(text, 1, 200)))


def formula_from_standard(text: Column) -> Column:
    """The first formula, else the first 200 characters of a text about prices, else nothing."""
    return F.coalesce(_first(text, STANDARD_FORMULAS), F.when(any_of(text, FORMULA_WORDS), F.substring(text, 1, 200)), F.lit(""))


def build_prompt(name: Column, description: Column, max_score: Column, context: Column, limit: int = CONTEXT_LIMIT) -> Column:
    """What a model is asked about one rule: the rule, the context (cut at limit, with a mark), the form of the answer."""
    cut = F.concat(F.substring(context, 1, limit), F.when(F.length(context) > limit, "\n... (内容已截断)").otherwise(""))
    top = max_score.cast("string")
    return F.concat(
        F.lit("角色: 专业的评标专家\n评分标准\n名称: "), name, F.lit("\n描述: "), F.coalesce(F.nullif(description, F.lit("")), F.lit("N/A")), F.lit("\n满分: "), top,
        F.lit("\n投标文件相关内容:\n---\n"), cut, F.lit("\n---\n给出 0 到 "), top, F.lit(' 之间的分数，只输出 JSON: {"score": 分数, "reason": "理由"}\n'),
    )
