"""Numbers: amounts in text and in Chinese numerals, confidences, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits and units of Chinese numerals.
DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9, "两": 2}
UNITS = {"十": 10, "百": 100, "千": 1000, "拾": 10, "佰": 100, "仟": 1000}


def let(value: Column, body) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def round_half_up(x: Column, digits: int = 2) -> Column:
    """Rounded as a decimal, so that 1.005 and 2.675 go up whatever their binary form, as a double."""
    return F.round(x.cast("decimal(28,6)"), digits).cast("double")


def plain_number(x: Column) -> Column:
    """A double as text without exponent or thousands marks, with one decimal at least."""
    return F.call_function("format_number", x.cast("double"), F.lit("#0.0###############"))


def str_to_float(text: Column) -> Column:
    """A number with thousands commas; null if it isn't one."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def _literal_map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _segment(chars: Column) -> Column:
    """Value of numerals below 万: a digit is held until a unit takes it; what is neither is skipped."""
    digits, units = _literal_map(DIGITS), _literal_map(UNITS)
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("held"))

    def step(acc: Column, c: Column) -> Column:
        digit, unit = F.try_element_at(digits, c), F.try_element_at(units, c)
        total = F.when(unit.isNotNull(), acc["total"] + F.when(acc["held"] == 0, 1).otherwise(acc["held"]) * unit).otherwise(acc["total"])
        held = F.when(digit.isNotNull(), digit).when(unit.isNotNull(), 0).otherwise(acc["held"])
        return F.struct(total.cast("long").alias("total"), held.cast("long").alias("held"))

    return F.aggregate(F.split(chars, ""), zero, step, lambda acc: acc["total"] + acc["held"])


def cn_number(text: Column) -> Column:
    """The number that Chinese numerals state, as a double; null for null or empty text. Split at 亿, or else at 万; the
    part after 亿 is read as one segment."""
    plain = F.regexp_replace(text, "[元圆角分整人民币\\\\s]", "")

    def value(t: Column) -> Column:
        split = lambda mark, unit: _segment(F.get(F.split(t, mark), F.lit(0))) * unit + _segment(F.coalesce(F.get(F.split(t, mark), F.lit(1)), F.lit("")))
        return F.when(t.contains("亿"), split("亿", 100_000_000)).when(t.contains("万"), split("万", 10_000)).otherwise(_segment(t))

    return F.when(F.length(text) > 0, let(plain, value).cast("double"))


def price_confidence(value: Column, keyword: Column, summary_page: Column, price_page: Column, chinese: Column | None = None) -> Column:
    """50 for a keyword, else 10; 40 on a summary page, else 20 in the price part; 30 if the Chinese amount agrees within
    1; one point a million, five at most; two decimals."""
    base = F.when(keyword, 50).otherwise(10) + F.when(summary_page, 40).when(price_page, 20).otherwise(0)
    if chinese is not None:
        base = base + F.when(F.abs(value - cn_number(chinese)) < 1, 30).otherwise(0)
    return round_half_up(base + F.least(value / 1_000_000, F.lit(5.0)))


def valid_score(score: Column) -> Column:
    """Above 0, at most 100, at most one decimal."""
    d = score.cast("decimal(20,8)")
    return F.coalesce((d > 0) & (d <= 100) & (d * 10 == F.floor(d * 10)), F.lit(False))


def project_code(created: Column) -> Column:
    return F.concat(F.lit("PRJ-"), F.date_format(created, "yyyyMMdd-HHmmss"))


def status_text(bidder: Column, rule: Column) -> Column:
    return F.substring(F.concat_ws(" - ", bidder, rule), 1, 100)
