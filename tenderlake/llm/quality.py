"""Quality rules with cutoffs whose false rejections are bounded, in DataFrame functions only.

``features`` measures every whole text. ``cutoffs`` takes labelled documents that pass the base rules as holdouts: nothing is
fitted on them, and the configurations are fixed beforehand. A configuration is a set of rules (all of them, or all but
one) and a level of strictness, which is a place in each rule's ladder. What is tested is its joint verdict: it passes in a
stratum if the exact binomial tail P(Bin(n, risk) <= k) is at most delta / (strata * sets of rules), where it would reject k
of n good documents. Each set's levels are tested from the mildest to the strictest and end at the first failure
(fixed-sequence testing, which needs no correction); Bonferroni covers strata and sets. So with probability 1 - delta no
stratum's verdict rejects more than a share ``risk`` of its good documents that pass the base rules, whichever passing
configuration is taken: the one that rejects most of the documents labelled bad, then the strictest, then the one with all
rules.

Strata with so few good labels that nothing could pass even without a false rejection are tested together, as one pooled
stratum, and use its cutoffs: the bound then holds for the good documents of these strata taken together. Sizes alone
decide who is pooled, and the correction counts the pool as one stratum. Strata without any good label, and a pool that is
still too small, have the base rules only. What comes to the driver is counts of strata.

Edge cases: null text counts as empty (no words: fails the base rules); words are runs of anything but ASCII white space,
so texts of any length and script are measured whole; a null stratum is a stratum of its own; a document labelled twice
counts once, as good if any label says so; equal texts (by a 64-bit hash) of one stratum and label count once in cutoffs, whatever their ids; labels that are null are ignored; repeated rows each get their row; empty
documents or labels give an empty result or unused rules; near copies among the holdouts count each, so the bound is
exact for texts drawn independently; a pooled stratum by itself has the bound of a pool in which all false rejections are its own; result columns of the input are replaced, other columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, let, tidy, written

BLANK = "\\x20\\x09-\\x0D"
RISK = 0.005  # false rejections of the joint verdict allowed in a stratum
DELTA = 0.05
#: Scores in thousandths (mean word length: hundredths) and their ladders, from mild to strict; a document is rejected from the cutoff on.
LADDERS: dict[str, list[int]] = {
    "symbol_share": [300, 200, 150, 100, 70, 50, 40, 30, 20, 10],
    "dup_line_share": [950, 900, 850, 800, 750, 700, 650, 600, 550, 500],
    "repeat_share": [900, 800, 700, 600, 500, 450, 400, 350, 300],
    "upper_share": [900, 800, 700, 600, 500, 400, 300, 250, 200],
    "shout_share": [900, 700, 500, 400, 300, 200, 150, 100],
    "word_length": [2000, 1600, 1400, 1300, 1200, 1150, 1100, 1050, 1000],
}
#: All rules, and all but one; levels of strictness (ladders that are shorter stay at their strictest cutoff).
RULE_SETS = [list(LADDERS), *[[r for r in LADDERS if r != left_out] for left_out in LADDERS]]
LEVELS = max(map(len, LADDERS.values()))
FEW_STRATA = 10_000  # rows of some 60 bytes that may be sent to all tasks
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _share(part: Column, whole: Column, unit: int = 1000) -> Column:
    return F.when(whole > 0, F.floor(part * unit / whole)).otherwise(0).cast("long")


def _hashes(words: Column) -> Column:
    """Hashes of the 3-word windows."""
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    return F.when(F.size(words) < 4, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash comes twice or more: equal hashes are neighbours in sorted order."""

    def twice(a: Column, n: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(a, i)["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(a, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))

    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p + 3 - acc["end"])).alias("n"), (p + 3).alias("end"))
    ordered = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    total = lambda a: F.aggregate(twice(a, F.size(a)), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ordered(h), total))).cast("long")


def _word_counts(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = let(trimmed, lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, f"[{BLANK}]+", -1)))
    counts = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _covered(_hashes(w)).alias("n_repeat_words"))
    return let(words, counts)


def _line_counts(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{BLANK}]"))
    return let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts, base_failed and the scores of LADDERS."""
    made = [*COUNTS, "base_failed", *LADDERS]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    t, by_word, by_line = (free_name(docs, c) for c in ("t", "by_word", "by_line"))
    own = F.col(t)
    out = docs.withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumns({by_word: _word_counts(own), by_line: _line_counts(own)})
    without = lambda pattern: F.length(F.regexp_replace(own, pattern, ""))
    out = out.withColumns(
        {c: F.col(by_word)[c] for c in ("n_words", "word_chars", "n_repeat_words")}
        | {
            "n_dup_lines": F.col(by_line)["n_dup_lines"],
            "n_symbols": (F.length(own) - without("[#*$%&|<>]+")).cast("long"),
            "upper_share": (F.length(own) - without("[A-ZÀ-ÖØ-Þ]+")).cast("long"),
            "shout_share": (F.length(own) - without("!+")).cast("long"),
        }
    )
    n_words, chars = F.col("n_words"), F.col("word_chars")
    out = out.withColumns(
        {
            "base_failed": (n_words < 50) | (100 * F.col("n_repeat_words") > 50 * n_words),
            "symbol_share": _share(F.col("n_symbols"), chars),
            "dup_line_share": _share(F.col("n_dup_lines"), F.col(by_line)["n_lines"]),
            "repeat_share": _share(F.col("n_repeat_words"), n_words),
            "upper_share": _share(F.col("upper_share"), chars),
            "shout_share": _share(F.col("shout_share"), n_words),
            "word_length": _share(chars, n_words, 100),
        }
    )
    return out.drop(t, by_word, by_line)


def _tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact sum of the terms, each from the one before in logarithms."""
    first = n * F.log1p(F.lit(-p))
    odds = F.log(F.lit(p / (1 - p)))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + odds
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, F.struct(first.alias("term"), F.exp(first).alias("sum")), step)["sum"]


def _first_level(rule: str) -> Column:
    """The mildest level at which a rule rejects a document, LEVELS if none does."""
    return F.coalesce(*[F.when(F.col(rule) >= cut, F.lit(i)) for i, cut in enumerate(LADDERS[rule])], F.lit(LEVELS))


def cutoffs(measured: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", risk: float = RISK, delta: float = DELTA, text: str | None = None) -> DataFrame:
    """A row for each stratum in which a configuration passed, with a column for each rule: its cutoff, or null if unused.
    text names a column of measured that tells texts apart (a hash, or the text): equal texts are one trial."""
    by_doc = labels.where(F.col("quality").isNotNull()).groupBy(key).agg(F.max("quality").alias("good"))
    held = measured.where("not base_failed").select(key, stratum, F.col(text or key).alias("trial"), *LADDERS).join(by_doc, key)
    # A trial counts once, by the strictest of its rows: copies of a good document say no more than it does.
    held = held.groupBy("trial", stratum, "good").agg(*[F.min(_first_level(rule)).alias(rule) for rule in LADDERS])
    first = F.array(*[F.least(*rules) for rules in RULE_SETS])  # of each set of rules
    with tidy() as kept:
        count = held.select(stratum, "good", F.posexplode(first).alias("set", "level")).groupBy(stratum, "set", "level")
        count = written(count.agg(F.count_if(F.col("good") == 1).alias("k"), F.count_if(F.col("good") == 0).alias("bad")), "levels")
        by_stratum = count.where(F.col("set") == 0).groupBy(stratum).agg(F.sum("k").alias("n")).where("n > 0")
        # No more is tested than there are strata, so a stratum that may stand alone by their number can pass by its own size.
        alone = _tail(F.col("n"), F.lit(0).cast("long"), risk) <= delta / len(RULE_SETS) / max(1, by_stratum.count())
        placed = written(by_stratum.withColumn("alone", alone).withColumn("own", F.when(alone, F.col(stratum))), "strata")
        groups = placed.where("alone").count() + bool(placed.where("not alone").limit(1).count())
        grid = F.explode(F.sequence(F.lit(0), F.lit(len(RULE_SETS) * LEVELS - 1)))
        pooled = placed.groupBy("alone", "own").agg(F.sum("n").alias("n")).withColumn("cell", grid).select("alone", "own", "n", F.floor(F.col("cell") / LEVELS).cast("int").alias("set"), (F.col("cell") % LEVELS).alias("level"))
        cells = count.join(placed.select(F.col(stratum).alias("s"), F.col("alone").alias("a"), F.col("own").alias("o")), F.col(stratum).eqNullSafe(F.col("s")))
        cells = cells.groupBy("a", "o", F.col("set").alias("s"), F.col("level").alias("l")).agg(F.sum("k").alias("k"), F.sum("bad").alias("bad"))
        rows = pooled.join(cells, (F.col("alone") == F.col("a")) & F.col("own").eqNullSafe(F.col("o")) & (F.col("set") == F.col("s")) & (F.col("level") == F.col("l")), "left")
        so_far = Window.partitionBy("alone", "own", "set").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.select("alone", "own", "n", "set", "level", *[F.sum(F.coalesce(c, F.lit(0))).over(so_far).alias(c) for c in ("k", "bad")])
        few = F.col("k") <= F.col("n") * risk  # more could not pass, and their tail would take long to add up
        passes = few & (_tail(F.col("n"), F.when(few, F.col("k")).otherwise(0), risk) <= delta / len(RULE_SETS) / max(1, groups))
        best = F.max_by(F.struct("set", "level"), F.struct("bad", "level", -F.col("set"))).alias("best")
        chosen = rows.withColumn("ok", F.min(passes).over(so_far)).where("ok").groupBy("alone", "own").agg(best)
        at = lambda rule: F.get(F.array(*[F.lit(x).cast("long") for x in LADDERS[rule]]), F.least(F.col("best.level"), F.lit(len(LADDERS[rule]) - 1)))
        used = lambda rule: F.col("best.set").isin(*[s for s, rules in enumerate(RULE_SETS) if rule in rules])
        chosen = chosen.select(F.col("alone").alias("a"), F.col("own").alias("o"), *[F.when(used(rule), at(rule)).alias(f"{rule}_from") for rule in LADDERS])
        out = placed.join(chosen, (F.col("alone") == F.col("a")) & F.col("own").eqNullSafe(F.col("o"))).select(stratum, *[f"{rule}_from" for rule in LADDERS])
        out = written(out, "cutoffs")
        kept(out)
        return out


def judge(measured: DataFrame, chosen: DataFrame, stratum: str = "lang") -> DataFrame:
    """measured with kept: false where a base rule failed or a score reaches its stratum's cutoff. Strata are few as a rule;
    if they are counted and few, their cutoffs go to all tasks and no row is dealt by stratum."""
    named = chosen.withColumnRenamed(stratum, "_stratum")
    if chosen.count() <= FEW_STRATA:
        named = F.broadcast(named)
    rejected = reduce(lambda a, b: a | b, [F.coalesce(F.col(rule) >= F.col(f"{rule}_from"), F.lit(False)) for rule in LADDERS])
    joined = measured.drop("kept").join(named, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_stratum", *[f"{rule}_from" for rule in LADDERS])


def judge_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The columns of docs but text, with features and kept. Texts are read once and never shuffled: what was measured is
    written, and labels are joined to that."""
    same = free_name(docs, "same")
    measured = written(features(docs, text).withColumn(same, F.xxhash64(text)).drop(text), "measured")
    return judge(measured, cutoffs(measured, labels, key, stratum, risk, delta, same), stratum).drop(same)


def filter_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """docs, texts included, with features and kept. Texts are measured once and written with their features; the cutoffs
    read only the columns they need, and no text is shuffled."""
    same = free_name(docs, "same")
    measured = written(features(docs, text).withColumn(same, F.xxhash64(text)), "measured")
    return judge(measured, cutoffs(measured, labels, key, stratum, risk, delta, same), stratum).drop(same)
