"""The scoring section of a tender text: docs(doc_id, text) to doc_id, section."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import let
from ..functions.text import any_of

# Words of section titles and ends.
SCORING_WORDS = ["评标办法", "评分标准", "评审标准", "评价标准", "评分细则", "评标细则", "评价项目", "评价内容", "评审内容", "打分标准", "评分要求", "评审要求", "技术评分", "商务评分", "价格评分", "综合评分", "评分方法", "评审方法"]
END_WORDS = ["合同", "附件", "附录", "格式", "投标文件格式", "附表", "第四章", "第四部分", "四、", "投标须知", "投标人须知", "投标保证金", "投标有效期", "投标函", "法定代表人", "第五章", "第五部分", "五、", "六、", "第六章", "第六部分", "投标报价", "投标文件递交", "开标", "中标"]
STILL_SCORING = ["价格", "报价", "评分", "评审"]
STOPS = ["合同", "附件", "附录"]
CHAPTER = r"^第.*章|^[一二三四五六七八九十]+、|^\d+\.|^[A-Z]\."


def slice_scoring_section(docs: DataFrame, scoring: Sequence[str] = SCORING_WORDS, ends: Sequence[str] = END_WORDS, stops: Sequence[str] = STOPS, points: str = "分") -> DataFrame:
    """From the first short line with a scoring word (else 10 lines before one with points too) to the next chapter about
    something else. A section under 500 characters becomes 200 lines, then up to 500 lines or a line that ends it; one
    under 800 gets 50 lines before and 500 after. No start: empty."""
    first = lambda a: F.array_position(a, F.lit(True)) - 1  # noqa: E731  -1: none
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    part = lambda lines, a, b: F.array_join(F.slice(lines, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), "\n")

    def section(lines: Column) -> Column:
        n = F.size(lines)
        title = first(F.transform(lines, lambda x: any_of(x, scoring) & (F.length(F.regexp_replace(x, r"(?U)\s+", "")) < 100)))
        other = first(F.transform(lines, lambda x: any_of(x, scoring) & x.contains(points)))
        start = F.when(title >= 0, title).when(other >= 0, F.greatest(other - 10, F.lit(0))).otherwise(-1)

        def chapter(x: Column) -> Column:
            t = trim(x)
            return (t != "") & (t.rlike(CHAPTER) | any_of(t, ends)) & ~any_of(t, [*scoring, *STILL_SCORING])

        def from_start(s: Column) -> Column:
            end = first(F.transform(lines, lambda x, i: (i > s) & chapter(x)))
            base = part(lines, s, F.when(end >= 0, end).otherwise(n))
            wide = let(base, lambda x: F.when(F.length(x) < 500, part(lines, s, F.least(s + 200, n))).otherwise(x))
            stop = first(F.transform(lines, lambda x, i: (i >= s) & (i < s + 500) & any_of(x, stops) & (F.length(trim(x)) < 30)))
            longer = let(wide, lambda x: F.when(F.length(x) < 500, part(lines, s, F.when(stop >= 0, stop).otherwise(F.least(s + 500, n)))).otherwise(x))
            low = F.greatest(s - 50, F.lit(0))
            return let(longer, lambda x: F.when(F.length(x) < 800, part(lines, low, F.least(n, s + 500))).otherwise(x))

        return let(start, lambda s: F.when(s < 0, "").otherwise(from_start(s)))

    return docs.select("doc_id", let(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), section).alias("section"))
