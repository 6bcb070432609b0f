"""Text: cleaning, names, predicates. Patterns are Java's, with (?U) where white space and digits of any script count."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns of the domain.
PAGE_PUNCTUATION = ("．，（）：； ", ".,():; ")
CELL_BLANKS = r"[\x00-\x20\x7f-\xa0 -‏ -  -⁯　﻿]"
CRITERIA_MARKS = "※★▲●○◆■□△▽◇"
STOP_PHRASES = ["法定代表", "授权代表", "单位地址", "通信地址", "电话", "传真", "(盖单位章)", "（盖单位章）", "投标单位", "投标人", "（盖章）", "(盖章)", "地址", "邮政编码", "联系人", "手机"]
NAME_SUFFIXES = ["公司章", "公章", "单位章"]
COMPANY_WORDS = ["公司", "有限", "股份", "集团", "厂", "院", "所", "社", "中心"]
NOT_COMPANY_WORDS = ["招标", "投标", "项目", "文件", "正本", "副本", "单位章", "法定代表"]
UPDATE_WORDS = ["公司", "有限", "股份", "集团", "厂", "院", "所", "中心"]
BRACKETS = "[\\]()（）【】〔〕\\[]"
NAME_CHARACTERS = "[一-龥A-Za-z0-9·．.（）()有限公司集团股份]"
PRICE_RULE_WORDS = {"rows": ["价格", "报价", "投标报价", "金额", "费用"], "text": ["价格", "报价", "单价", "金额", "基准价"], "scores": ["价格", "price", "报价"]}
STRIPPED = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
LINE_ENDS = r"(?U)[\s\x1c-\x1f&&[^\n]]*\n[\s\x1c-\x1f&&[^\n]]*"
SCORE_PATTERNS = [r"(?U)(\d+(?:\.\d+)?)\s*分", r"(?U)\((\d+(?:\.\d+)?)\s*分\)", r"(?U)满分\s*(\d+(?:\.\d+)?)"]


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, STRIPPED, "")


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether text contains one of the words (false for null). Words that hold another one need no search of their own."""
    found = F.lit(False)
    for w in dict.fromkeys(w for w in words if not any(v in w for v in words if v != w)):
        found = found | text.contains(w)
    return F.coalesce(found, F.lit(False))


def flags(pattern: str) -> str:
    """pattern with white space and digits of any script, whatever the case; case is left alone where the pattern has no
    letters that have one, as it makes each character of a class a comparison of its own."""
    bare = re.sub(r"\\.", "", pattern)
    return f"(?U{'' if bare.lower() == bare.upper() else 'i'}){pattern}"


def clean_page_text(text: Column) -> Column:
    """Line ends and full-width marks made plain, runs of line ends and of blanks made one, lines and text trimmed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|\r| | ", "\n")
    t = F.translate(t, *PAGE_PUNCTUATION)
    t = F.regexp_replace(F.regexp_replace(t, "\n+", "\n"), " +", " ")
    return strip(F.regexp_replace(t, LINE_ENDS, "\n"))


def clean_cell_text(text: Column) -> Column:
    """Without white space, control and format characters."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), CELL_BLANKS, "")


def squeeze_text(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), "^ | $", "")


def clean_criteria_name(text: Column) -> Column:
    """Squeezed, without a number in front, points behind, or marks."""
    t = squeeze_text(text)
    t = F.regexp_replace(t, r"(?U)^[（(]*\d+[.-]?\d*[）)]*\s*", "")
    t = F.regexp_replace(t, r"(?U)\s*[（(]*\d+分?[）)]*$", "")
    return strip(F.regexp_replace(t, f"[{CRITERIA_MARKS}]", ""))


def filter_bidder_name(text: Column, stop_phrases: Sequence[str] = STOP_PHRASES, suffixes: Sequence[str] = NAME_SUFFIXES) -> Column:
    """The name before the first stop phrase (phrases in order), without brackets and one stamp word at its end."""
    t = strip(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), "^[:：]+", ""))
    for phrase in stop_phrases:
        t = strip(F.substring_index(t, phrase, 1))
    t = F.regexp_replace(t, "^[()（）\\[\\]【】〔〕]+|[()（）\\[\\]【】〔〕]+$", "")
    t = F.regexp_replace(t, "[\\[\\]（）()]", "")
    for s in suffixes:
        t = strip(F.regexp_replace(t, f"{s}$", ""))
    return squeeze_text(t)


def valid_company_name(name: Column, words: Sequence[str] = COMPANY_WORDS, invalid: Sequence[str] = NOT_COMPANY_WORDS) -> Column:
    """invalid: words that no bidder's name holds; a project adds its buyer's name."""
    return F.coalesce((F.length(name) > 5) & any_of(name, words) & ~any_of(name, invalid), F.lit(False))


def garbled_name(name: Column, allowed: str = NAME_CHARACTERS) -> Column:
    """Empty, shorter than 6, with brackets, or with too many characters of other kinds."""
    n = F.length(name)
    noise = F.length(F.regexp_replace(name, allowed, ""))
    return F.coalesce((n < 6) | name.rlike(BRACKETS) | (noise * 5 > n) | (noise > F.greatest(F.lit(1), F.floor(n / 6))), F.lit(True))


def name_update_reason(name: Column, words: Sequence[str] = UPDATE_WORDS) -> Column:
    """Null if a new name may be stored, else why not."""
    t = strip(F.coalesce(name, F.lit("")))
    return F.when(F.length(t) < 2, "名称过短").when(~any_of(t, words), "名称缺少公司关键词")


def is_price_rule(variant: str, name: Column, standard: Column | None = None, flag: Column | None = None, words: Sequence[str] | None = None) -> Column:
    """rows: by name and standard; text: by name; scores: by name or flag."""
    text = F.coalesce(name, F.lit(""))
    if standard is not None:
        text = F.concat_ws(" ", text, standard)
    found = any_of(text if variant == "text" else F.lower(text), words or PRICE_RULE_WORDS[variant])
    return found | F.coalesce(flag, F.lit(False)) if flag is not None else found


def score_in_text(text: Column, patterns: Sequence[str] = SCORE_PATTERNS) -> Column:
    """The first pattern's first number, else 0."""
    found = [F.regexp_extract(text, p, 1).try_cast("double") for p in patterns]
    return F.coalesce(*found, F.lit(0.0))


def row_to_rule_text(cells: Column) -> Column:
    """Non-blank cells, trimmed, joined by blanks."""
    return F.array_join(F.filter(F.transform(cells, lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != ""), " ")


def count_word(text: Column, word: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters."""
    x, y = F.split(a, ""), F.split(b, "")
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
