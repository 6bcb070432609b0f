import pytest
from pyspark.sql import functions as F

from tenderlake.functions import answers, numbers, text
from tenderlake.operators import names, prices, rules, sections, tables

# Sample pages, names and answers whose results must match.
PAGES = {
    "a": ["投标函\n投标项目：XXX项目\n投标报价：￥1,729,800.00\n大写：壹佰柒拾贰万玖仟捌佰元整", "投标一览表\n项目名称：XXX项目\n投标单位：山东创杰智慧装备科技有限公司\n小写金额：￥2,270,000.00\n大写金额：贰佰贰拾柒万元整", "其他页面内容\n分项报价：￥50,000.00\n其他内容..."],
    "b": ["没有价格", None, ""],
    "c": ["投标一览表\n投标保证金：￥50,000.00\n总价：￥80,000.00"],
    "d": ["说明 合计 123,456.00 元，投标保证金 5,000", "x" * 60 + "总价: 99,000 " + "y" * 60 + "保证金 7"],
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(d, i, t) for d, ts in PAGES.items() for i, t in enumerate(ts)], "doc_id string, page_no int, text string")


def _one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_best_prices(pages):
    out = {r["doc_id"]: r["price"] for r in prices.extract_bid_price(pages).collect()}
    assert out == {"a": 2270000.0, "b": None, "c": 80000.0, "d": 99000.0}


def test_summary_page_candidates(pages):
    rows = prices.union_candidates(pages.where("doc_id = 'a'")).orderBy("seq").collect()
    assert [(r["value"], r["page_no"], r["confidence"]) for r in rows] == [(2270000.0, 1, 100.0), (2270000.0, 1, 95.0)]
    assert rows[0]["reason"].endswith("(与大写价格匹配)")


def test_bonds(pages):
    out = {(r["doc_id"], r["page_no"], r["value"], r["confidence"]) for r in prices.extract_bonds(pages).collect()}
    assert out == {("c", 0, 50000.0, 80.0)}  # the other bonds share a line with a total


@pytest.mark.parametrize("written, value", [("贰佰贰拾柒万", 2270000.0), ("拾伍", 15.0), ("贰佰贰拾柒", 227.0), ("", None), (None, None), ("壹亿零伍拾元整", 100000050.0)])
def test_chinese_numerals(spark, written, value):
    assert _one(spark, written, numbers.cn_number) == value


@pytest.mark.parametrize("name, valid, garbled", [("山东创杰智慧装备科技有限公司", True, False), ("昆｀＂卫贸有限;？", True, True), ("中车眉山车辆有限公司", False, False), ("投标文件", False, True), ("", False, True), ("XXX公司（盖章）", True, True), ("A" * 100, False, False), (None, False, True)])
def test_names(spark, name, valid, garbled):
    buyer = [*text.NOT_COMPANY_WORDS, "中车眉山车辆有限公司"]
    assert _one(spark, name, lambda c: text.valid_company_name(c, invalid=buyer)) is valid
    assert _one(spark, name, text.garbled_name) is garbled


def test_filtered_name(spark):
    assert _one(spark, "：XXX公司（盖章） 地址 y", text.filter_bidder_name) == "XXX公司"


def test_section_name(spark):
    rows = [("t", 0, "封面"), ("t", 1, "授权委托书\n投标人：山东创杰智慧装备科技有限公司"), ("t", 2, "投标一览表\n投标单位：江苏鑫桥环保科技有限公司"), ("t", 3, "x")]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, text string")
    assert [tuple(r) for r in names.section_names(df).collect()] == [("t", "山东创杰智慧装备科技有限公司")]


@pytest.mark.parametrize("response, score, reason", [('好\n```json\n{"score": 7.5,"reason":"x"}\n```', 7.5, "x"), ('{"score": 99}', 10.0, answers.DEFAULT_REASON), ('{"score":"a"}', 0.0, answers.DEFAULT_REASON), ("得8分", 8.0, None), ("{broken}", 0.0, None), ("Error: x", 0.0, None), (None, 0.0, None), ("", 0.0, "")])
def test_score_answers(spark, response, score, reason):
    out = _one(spark, response, lambda c: answers.parse_score_answer(c, F.lit(10)))
    assert out["score"] == score and reason in (None, out["reason"])


def test_inheritance_and_cleaning(spark):
    kids = "children array<struct<criteria_name: string, max_score: double, description: string, is_price_criteria: boolean>>"
    tree = spark.createDataFrame([(1, 1, "技术部分", 40.0, "d", False, [("技术方案", 20.0, "d", False), ("技术团队", 20.0, "d", False)]), (1, 2, "", 0.0, "d", False, [("企业资质", 10.0, "d", False)])], f"project_id long, nth int, criteria_name string, max_score double, description string, is_price_criteria boolean, {kids}")
    flat = rules.drop_incomplete_rules(rules.inherit_parent(rules.flatten_rules(tree, live=False)))
    assert [(r["Parent_Item_Name"], r["Parent_max_score"], r["Child_Item_Name"], r["Child_max_score"]) for r in flat.orderBy("id").collect()] == [("技术部分", 40, "技术方案", 20), ("技术部分", 40, "技术团队", 20), ("技术部分", 40, "企业资质", 10)]


def test_similar_rules_keep_the_higher_maximum(spark):
    df = spark.createDataFrame([("d", 1, "技术方案", 10.0), ("d", 2, "技术方案完整", 20.0), ("d", 3, "服务", 5.0), ("d", 4, "技术", 1.0)], "doc string, nth int, criteria_name string, max_score double")
    assert [(r["criteria_name"], r["max_score"]) for r in rules.dedupe_similar_rules(df).orderBy("slot").collect()] == [("技术方案完整", 20.0), ("服务", 5.0)]


def test_scoring_section(spark):
    body = "\n".join(f"内容{i} " + "字" * 20 for i in range(60))
    df = spark.createDataFrame([(1, f"前言\n第三章 评标办法\n{body}\n第四章 合同\n尾"), (2, "没有"), (3, None)], "doc_id int, text string")
    out = {r["doc_id"]: r["section"] for r in sections.slice_scoring_section(df).collect()}
    assert out[1].startswith("第三章 评标办法") and out[1].endswith("字") and "第四章" not in out[1] and out[2] == out[3] == ""


def test_similarity_of_tables(spark):
    df = spark.createDataFrame([(["a", "", "bc"], ["a", "x", "b"], [["1", ""]], [["1", "2"]])], "h array<string>, g array<string>, d array<array<string>>, e array<array<string>>")
    h, c, none = df.select(tables.header_similarity(F.col("h"), F.col("g")), tables.content_similarity(F.col("d"), F.col("e")), tables.content_similarity(F.array().cast("array<array<string>>"), F.col("e"))).first()
    assert (h, c, none) == (pytest.approx(2 / 3), 0.5, 0.0)


def test_price_scores_of_seven_bidders(spark):
    from tenderlake.operators import scores

    bidders = [("江苏", 1729800.0, 40.0), ("扬州", 2270000.0, 30.48), ("武汉", 2876875.0, 24.05), ("盐城", 12144732.0, 5.7), ("湖北", 22862800.0, 3.03), ("山东", 86498326.0, 0.8), ("中车", 17247224171.0, 0.0)]
    df = spark.createDataFrame([(1, n, p) for n, p, _ in bidders], "project_id long, bidder_name string, price double")
    top = spark.createDataFrame([(1, 40.0)], "project_id long, max_price_score double")
    assert {r["bidder_name"]: r["price_score"] for r in scores.score_prices(df, top).collect()} == {n: s for n, _, s in bidders}


TREES = [
    (1, 1, "a", '[{"Child_Item_Name":"x","score":5,"weight":2.50},{"criteria_name":"t","score":1,"children":[{"criteria_name":"u","children":[{"criteria_name":"PRICE","score":3,"k":[1]}]}]},7]'),
    (2, 1, "b", '{"方案":1.5,"价格分":{"score":4}}'), (3, 1, "c", "oops"), (4, 1, "d", '[{"criteria_name":"报价","score":0},{"is_price_criteria":true,"score":9}]'), (5, 1, "e", None), (6, 1, "f", '[{"criteria_name":"报价"}]'), (7, 2, "a", '[{"criteria_name":"报价","score":1}]'),
]


def test_price_items_at_any_depth(spark):
    import json

    from tenderlake.operators import scores

    results = spark.createDataFrame(TREES, "id long, project_id long, bidder_name string, detailed_scores string")
    assert dict(scores.find_price_score(results).collect()) == {1: 3.0, 2: 4.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: 1.0}
    scored = spark.createDataFrame([(1, b, 12.5) for b in "abcdef"], "project_id long, bidder_name string, price_score double")
    out = {r["id"]: r["detailed_scores"] for r in scores.update_price_in_scores(results, scored).collect()}
    assert out[3] == "oops" and out[5] is None and out[7] == TREES[6][3]
    put = {"score": 12.5, "is_price_criteria": True, "reason": scores.NEW_REASON + "12.5"}
    want = json.loads(TREES[0][3])
    want[1]["children"][0]["children"][0] |= put
    assert json.loads(out[1]) == want and '"weight":2.5' in out[1]
    assert json.loads(out[2]) == {"方案": 1.5, "价格分": 12.5}
    assert json.loads(out[4]) == [{"criteria_name": "报价"} | put, put] and json.loads(out[6]) == [{"criteria_name": "报价"} | put]


def test_parents_without_children_count_by_their_own_maximum(spark):
    rows = [(1, 1, "T", 20, None, None, False), (2, 1, "C", 40, "c1", 40, False), (3, 1, "价格", 40, None, None, True), (4, 2, "T", 30, None, None, False), (5, 2, "P", 10, None, None, True), (6, 2, "P", 40, None, None, True)]
    df = spark.createDataFrame(rows, "id long, project_id long, Parent_Item_Name string, Parent_max_score int, Child_Item_Name string, Child_max_score int, is_price_criteria boolean")
    out = {r["id"]: (r["parent_max"], r["child_max"]) for r in rules.normalise_to_100(df).collect()}
    assert out == {1: (20.0, None), 2: (40.0, 40.0), 3: (40.0, None), 4: (60.0, None), 5: (10.0, None), 6: (40.0, None)}
    assert {r["project_id"]: (r["total"], r["off"]) for r in rules.rule_total_check(df).collect()} == {1: (100.0, False), 2: (70.0, True)}


def test_bonds_in_numerals_with_blanks_and_first_matches(spark):
    df = spark.createDataFrame([(1, 0, "投标保证金：伍 万元"), (1, 1, "x 押金: 0 和 押金: 500"), (1, 2, "押金: 合计 1" + "x" * 40 + "押金: 500")], "doc_id long, page_no int, text string")
    assert {(r["page_no"], r["value"], r["confidence"]) for r in prices.extract_bonds(df).collect()} == {(0, 50000.0, 70.0), (2, 500.0, 60.0)}


def test_white_space_of_any_kind_is_no_text(spark):
    from tenderlake.operators import pages

    df = spark.createDataFrame([(1, 0, "\n\t\u3000\n"), (1, 1, "\u3000x\x1f"), (1, 2, None)], "doc_id long, page_no int, text string")
    out = {r["page_no"]: (r["failed"], r["doc_chars"]) for r in pages.page_quality(df, df.limit(0)).collect()}
    assert out == {0: (True, 1), 1: (False, 1), 2: (True, 1)}
    assert _one(spark, "\u3000\t", text.name_update_reason) == "名称过短"


def test_price_answers_by_line(spark):
    out = _one(spark, '"甲": 3 "乙": 4\n"丙"：5\n"丁": 6.', answers.parse_price_answer)
    assert out == {"甲": 3.0, "丁": 6.0}


def test_standard_formulas(spark):
    assert _one(spark, "得分 = (投标报价最低价/投标报价) × 100", answers.formula_from_standard) == "得分 = (投标报价最低价/投标报价) × 100"
    assert _one(spark, "投标报价得分 x\n无", answers.formula_from_standard) == "投标报价得分 x\n无"


def _greedy(rows):
    kept: dict = {}
    for doc, nth, name, top in sorted(rows, key=lambda r: r[1]):
        own = kept.setdefault(doc, [])
        for k, (_, other, most) in enumerate(own):
            a, b = set(other), set(name)
            if name == other or name in other or other in name or len(a & b) / len(a | b) > 0.8:
                own[k] = (nth, name, top) if top > most else own[k]
                break
        else:
            own.append((nth, name, top))
    return {(doc, k): x for doc, own in kept.items() for k, x in enumerate(own)}


def _similar(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc int, nth int, criteria_name string, max_score double")
    return {(r["doc"], r["slot"]): (r["nth"], r["criteria_name"], r["max_score"]) for r in rules.dedupe_similar_rules(df, **options).collect()}


def test_similar_rules_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/part.parquet").selectExpr("cast(p_partkey div 20 as int)", "cast(p_partkey as int)", "p_name", "cast(p_size as double)").limit(1000).collect()]
    want = _greedy(rows)
    assert _similar(spark, rows) == want and len(want) < len(rows)
    assert _similar(spark, rows, fold=0) == want


def test_similar_rules_by_groups_equal_the_fold(spark):
    """Chains, equal, contained, one-letter and empty names, and maxima that make rules take others' places."""
    import random

    r = random.Random(6)
    letters = "abcdefgh评审技术"
    names_ = ["", "a", "b", "ab", "评", "评审"] + ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(300)]
    rows = [(d, n, r.choice(names_), float(r.randint(1, 9))) for d in range(3) for n in range(150)] + [(3, n, r.choice(names_[3:]), float(r.randint(1, 9))) for n in range(150)]
    assert _similar(spark, rows, fold=10) == _greedy(rows)


def test_ten_thousand_rules_of_one_document(spark):
    import random

    r = random.Random(1)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    base = ["".join(r.sample(letters, 8)) for _ in range(6000)]
    rows = [(1, n, x, float(r.randint(1, 9))) for n, x in enumerate(base)]
    for n in range(6000, 10_000):
        x = r.choice(base)
        rows.append((1, n, r.choice([x, x[:5], x + "一二三", x[1:] + x[0], x[:7] + x[0]]), float(r.randint(1, 9))))
    got = _similar(spark, rows)
    # The plain fold, with candidates by shared characters so that it ends in time.
    kept, by_char = [], {}
    for _, nth, name, top in rows:
        near = sorted({k for c in set(name) for k in by_char.get(c, ())})
        hit = next((k for k in near if name in kept[k][1] or kept[k][1] in name or len(set(name) & set(kept[k][1])) / len(set(name) | set(kept[k][1])) > 0.8), None)
        if hit is None:
            kept.append((nth, name, top))
            hit = len(kept) - 1
        elif top > kept[hit][2]:
            kept[hit] = (nth, name, top)
        else:
            continue
        for c in set(name):
            by_char.setdefault(c, set()).add(hit)
    assert got == {(1, k): x for k, x in enumerate(kept)}


def test_rules_hang_on_the_nearest_less_deep_one(spark):
    numbers_ = [["1"], ["1", "1"], ["1", "1", "1"], ["1", "1", "1", "1"], ["1", "2", "1"], ["2", "1", "1"], ["2", "2"]]
    df = spark.createDataFrame([("d", x) for x in numbers_], "doc string, numbering array<string>")
    out = {".".join(r["numbering"]): r["parent"] and ".".join(r["parent"]) for r in rules.attach_parent(df).collect()}
    assert out == {"1": None, "1.1": "1", "1.1.1": "1.1", "1.1.1.1": "1.1.1", "1.2.1": "1.1", "2.1.1": "1.1", "2.2": "1"}


def test_rules_of_any_depth_equal_a_plain_stack(spark):
    import random

    r = random.Random(2)
    numbers_ = [(d, [f"{r.randint(0, 2)}" for _ in range(r.choice([1, 2, 3, 40, 17, 5]))]) for d in "ab" for _ in range(300)] + [("a", [str(i) for i in range(n)]) for n in range(1, 41)]
    numbers_ += [("c", ["1"]), ("c", ["1"]), ("c", ["1", "1"]), ("d", None)]
    df = spark.createDataFrame(numbers_, "doc string, numbering array<string>")
    want = {}
    for doc in "abc":
        stack = []
        for x in sorted(n for d, n in numbers_ if d == doc):
            while stack and len(stack[-1]) >= len(x):
                stack.pop()
            want[doc, tuple(x)] = tuple(stack[-1]) if stack else None
            stack.append(x)
    for block in (1024, 7):
        rows = rules.attach_parent(df, block=block).collect()
        assert len(rows) == len(numbers_)
        assert {(r["doc"], tuple(r["numbering"])): r["parent"] and tuple(r["parent"]) for r in rows if r["numbering"]} == want


def _deep(depth, wide=0):
    item = {"criteria_name": "报价", "score": 6.5, "k": [1]}
    for i in range(depth):
        item = {"criteria_name": f"t{i}", "score": i, "children": [{"criteria_name": "x", "score": 1}, {"criteria_name": "价格", "score": 0, "children": []}] * (i % 7 == 3) + [item]}
    return [{"criteria_name": f"w{i}", "score": 1} for i in range(wide)] + [item, {"criteria_name": "last", "is_price_criteria": True, "score": 9.0}]


def _find(scores):
    for s in scores:
        if not isinstance(s, dict):
            continue
        price = any(w in s.get("criteria_name", "").lower() for w in ("价格", "price", "报价")) or s.get("is_price_criteria", False)
        if price and "score" in s:
            return float(s["score"])
        if s.get("children") and (below := _find(s["children"])) != 0.0:
            return below
    return 0.0


def _put(scores, new, put):
    out = []
    for s in scores:
        if isinstance(s, dict):
            price = any(w in s.get("criteria_name", "").lower() for w in ("价格", "price", "报价")) or s.get("is_price_criteria", False)
            s = s | (put if price else {})
            if s.get("children"):
                s = s | {"children": _put(s["children"], new, put)}
        out.append(s)
    return out


def test_score_trees_of_any_depth_and_width_equal_recursion(spark):
    import json

    from tenderlake.operators import scores

    trees = [_deep(40), _deep(41), _deep(3), _deep(0), _deep(2, 2000), [1, [2], None, "x", {"criteria_name": "a", "children": [3, {"criteria_name": "PRICE", "score": 2}]}], []]
    trees.append([{"criteria_name": "parent", "children": [{"criteria_name": f"c{i}", "score": 1} for i in range(100_000)] + [{"criteria_name": "报价", "score": 4}]}])
    results = spark.createDataFrame([(i, 1, f"b{i}", json.dumps(t, ensure_ascii=False)) for i, t in enumerate(trees)], "id long, project_id long, bidder_name string, detailed_scores string")
    assert dict(scores.find_price_score(results).collect()) == {i: _find(t) for i, t in enumerate(trees)}
    scored = spark.createDataFrame([(1, f"b{i}", 12.5) for i in range(len(trees))], "project_id long, bidder_name string, price_score double")
    put = {"score": 12.5, "is_price_criteria": True, "reason": scores.NEW_REASON + "12.5"}
    for r in scores.update_price_in_scores(results, scored).collect():
        assert json.loads(r["detailed_scores"]) == _put(trees[r["id"]], 12.5, put), r["id"]


def test_items_of_one_name_under_two_parents_are_told_apart(spark):
    rows = [(1, 1, "技术", 10, "方案", 6, False, False), (2, 1, "商务", 10, "方案", 3, False, False), (3, 1, "价格", 40, None, None, False, True)]
    df = spark.createDataFrame(rows, "id long, project_id long, Parent_Item_Name string, Parent_max_score int, Child_Item_Name string, Child_max_score int, is_veto boolean, is_price_criteria boolean")
    leaves = spark.createDataFrame([(1, 7, 1, 6.0), (1, 7, 2, 3.0), (1, 7, 3, None)], "project_id long, bid_id long, rule_id long, score double")
    out = {(r["name"], r["level"], r["rule_id"]): (r["score"], r["leaves"]) for r in rules.veto_and_tree_scores(df, leaves).collect()}
    assert out == {("方案", 2, 1): (6.0, 1), ("方案", 2, 2): (3.0, 1), ("价格", 1, 3): (0.0, 1), ("技术", 1, None): (6.0, 1), ("商务", 1, None): (3.0, 1)}


def test_budgeted_contexts_are_the_first_characters_of_whole_ones(spark):
    import random

    from tenderlake.operators import pages

    r = random.Random(7)
    texts = [(d, n, None if r.random() < 0.1 else "".join(r.choice("abcdefgh ") for _ in range(r.choice([0, 5, 300, 4000])))) for d in range(4) for n in range(12)]
    df = spark.createDataFrame(texts, "doc_id long, page_no int, text string")
    pairs = [(f"{d}:{k}", d, r.choice(["ab", "gh", "zz", "a"]) + " " + r.choice(["bc，cd", "", "Fe。hh"]), r.choice([None, "", "de"])) for d in range(4) for k in range(6)]
    pairs_df = spark.createDataFrame(pairs, "pair_id string, doc_id long, item string, description string")
    chosen = pages.relevant_pages(pairs_df, df)
    want = {}
    for pair, doc, item, said in pairs:
        words = {w.lower() for w in (item + " " + (said or "")).replace("，", " ").replace("。", " ").split() if len(w) > 1}
        hits = [n for d, n, t in texts if d == doc and t is not None and any(w in t.lower() for w in words)] or [0]
        want[pair] = {m for n in hits for m in range(n, min(n + 2, 11) + 1)}
    got = {}
    for row in chosen.collect():
        got.setdefault(row["pair_id"], []).append(row["page_no"])
    assert {k: set(v) for k, v in got.items()} == want and all(len(v) == len(set(v)) for v in got.values())
    whole = dict(pages.page_ranges(chosen, df).collect())
    text_of = {(d, n): t or "" for d, n, t in texts}
    for pair, numbers_ in want.items():
        parts, run = [], []
        for n in [*sorted(numbers_), None]:
            if run and n != run[-1] + 1:
                parts.append(f"--- Pages {run[0] + 1}-{run[-1] + 1} ---\n" + "\n".join(text_of[int(pair[0]), k] for k in run))
                run = []
            run.append(n)
        assert whole[pair] == "\n\n".join(parts)
    for budget in (1, 17, 25, 500, 8001, 10**6):
        assert dict(pages.page_ranges(chosen, df, budget).collect()) == {k: v[:budget] for k, v in whole.items()}


def test_rules_of_texts_with_and_without_a_section(spark):
    from tenderlake.plans import flows

    texts = [("a", "投标须知\n第三章 评分标准\n技术方案水平（30分）\n售后服务承诺 20分\n价格分 40分\n第四章 合同\n不算的规则(9分)"), ("b", "企业信誉情况(12分)"), ("c", "没有"), ("d", None)]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    none = spark.createDataFrame([], "doc_id string, page int, table_index int, cols int, headers array<string>, data array<array<string>>")
    out = {}
    for r in flows.extract_rules(none, docs).orderBy("doc", "parent_no").collect():
        out.setdefault(r["doc"], []).append((r["criteria_name"], round(r["max_score"], 6), r["is_price_criteria"]))
    assert {("技术方案水平", False), ("售后服务承诺", False), ("价格分", True)} <= {(n, p) for n, _, p in out["a"]} and out["b"] == [("企业信誉情况", 12.0, False)]
    assert [x[0] for x in out["c"]] == [x[0] for x in out["d"]] == ["技术方案", "价格分"]


def test_changed_rows_are_counted_as_they_are_written(spark, tmp_path):
    from tenderlake.operators import writes

    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id long, name string")
    patch = spark.createDataFrame([(1, "x"), (2, "  "), (3, "c"), (4, None), (9, "y")], "id long, name string")
    rows, seen = writes.count_patched(writes.patch_rows(target, patch, "id", ["name"]))
    rows.write.parquet(f"file://{tmp_path}/out")
    assert seen.get == {"patched": 2, "rows": 4}  # a blank and a missing name and an unknown id change nothing, an equal name counts
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").collect()), key=str) == [(1, "x"), (2, "b"), (3, "c"), (4, None)]


def test_purge_reaches_tables_without_a_project(spark):
    from tenderlake.operators import writes

    one = lambda rows, kind: spark.createDataFrame(rows, kind)
    tables_ = {"tender_project": one([(1,), (2,)], "id long"), "analysis_result": one([(10, 1), (20, 2)], "id long, project_id long"), "score_modification_history": one([(5, 10), (6, 20)], "id long, result_id long")}
    left = writes.purge_project(tables_, one([(1,)], "id long"))
    assert {k: [tuple(r) for r in df.select("id").collect()] for k, df in left.items()} == {"tender_project": [(2,)], "analysis_result": [(20,)], "score_modification_history": [(6,)]}


def test_files_are_listed(spark, tmp_path):
    from tenderlake.sources.tables import list_files

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("abc")
    assert [(r["path"].rsplit("/", 1)[1], r["length"]) for r in list_files(spark, f"file://{tmp_path}").collect()] == [("x.txt", 3)]


def test_tables_in_long_form_equal_whole_ones(spark):
    import random

    r = random.Random(8)
    rows = []
    for doc in range(12):
        for page in range(9):
            cols = r.choice([2, 2, 2, 3])
            head = ["评价项目", "评价标准", "x"][:cols] if r.random() < 0.7 else ["a", "b", "c"][:cols]
            data = [head] + [[r.choice(["", " p ", "q\t1", None]) for _ in range(cols)] for _ in range(r.randint(0, 3))]
            rows.append((doc, page if r.random() < 0.9 else page + 20, 0, cols, head, data if r.random() < 0.95 else []))
    kind = "doc_id long, page int, table_index int, cols int, headers array<string>, data array<array<string>>"
    df = spark.createDataFrame(rows, kind)
    whole = {(t["doc_id"], t["table_no"]): (t["headers"], t["data"]) for t in tables.merge_page_tables(df).collect()}
    long = {}
    for t in tables.merged_rows(df).orderBy("doc_id", "table_no", "row_no").collect():
        head, data = long.setdefault((t["doc_id"], t["table_no"]), (t["headers"], []))
        assert t["row_no"] == len(data) and head == t["headers"]
        data.append(t["cells"])
    assert long == {k: v for k, v in whole.items() if v[1]}
    both = [sorted(map(str, f(x).collect())) for f in (tables.rule_rows, tables.table_rows) for x in (tables.merge_page_tables(df), tables.merged_rows(df))]
    assert both[0] == both[1] and both[2] == both[3] and both[0]


def test_a_table_over_very_many_pages(spark):
    n = 100_000
    row = F.array(F.lit("评价项目"), F.lit("评价标准"))
    df = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("page"), F.lit(0).alias("table_index"), F.lit(2).alias("cols"), row.alias("headers"), F.array(row, F.array(F.col("id").cast("string"), F.lit("5分"))).alias("data"))
    out = tables.rule_rows(tables.merged_rows(df)).agg(F.count(F.lit(1)), F.max("row_no"), F.count_if(F.col("project_cell") == (F.col("row_no") - 1).cast("string"))).first()
    assert tuple(out) == (n, n, n)


def _section(text):
    """The scoring section in plain loops."""
    from tenderlake.operators.sections import CHAPTER, END_WORDS, SCORING_WORDS, STILL_SCORING, STOPS
    import re

    lines = (text or "").split("\n")
    n, has = len(lines), lambda x, words: any(w in x for w in words)
    start = next((i for i, x in enumerate(lines) if has(x, SCORING_WORDS) and len(re.sub(r"\s+", "", x)) < 100), -1)
    if start < 0:
        other = next((i for i, x in enumerate(lines) if has(x, SCORING_WORDS) and "分" in x), -1)
        if other < 0:
            return ""
        start = max(other - 10, 0)
    end = next((i for i in range(start + 1, n) if (t := lines[i].strip()) and (re.search(CHAPTER, t) or has(t, END_WORDS)) and not has(t, [*SCORING_WORDS, *STILL_SCORING])), n)
    out = "\n".join(lines[start:end])
    if len(out) < 500:
        out = "\n".join(lines[start : min(start + 200, n)])
    if len(out) < 500:
        stop = next((i for i in range(start, min(start + 500, n)) if has(lines[i], STOPS) and len(lines[i].strip()) < 30), min(start + 500, n))
        out = "\n".join(lines[start:stop])
    if len(out) < 800:
        out = "\n".join(lines[max(start - 50, 0) : min(n, start + 500)])
    return out


def test_sections_equal_plain_loops_on_every_branch(spark):
    import random

    r = random.Random(12)
    lines = ["普通的一行文字", "说明", "第三章 其他", "第四章 合同条款", "附件 一", "1. 投标须知", "价格 部分", "  ", "x" * 90, "二、 商务", "评审内容" + "长" * 120 + " 10分", "评标办法" + "字" * 101]
    texts = [None, "", "评分标准"]
    for k in range(300):
        n, body = r.choice([3, 12, 60, 260, 700]), r.choice([lines[:2], lines, lines[:8], ["短"], ["很长的一行" * 8]])
        all_ = [r.choice(body) for _ in range(n)]
        if k % 4:
            all_[r.randrange(n)] = r.choice(["评分标准", "第二章 评标办法", "评审内容" + "长" * 120 + " 10分"])
        texts.append("\n".join(all_))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["section"] for r in sections.slice_scoring_section(df).collect()}
    sizes = [len(got[i]) for i in got]
    assert got == {i: _section(t) for i, t in enumerate(texts)}
    assert any(0 < s < 500 for s in sizes) and any(500 <= s < 800 for s in sizes) and any(s >= 800 for s in sizes) and 0 in sizes


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_cleaned_by_patterns_alone(spark):
    import re

    cases = [" a \n \t b　\r\n\n\nc   d\x1c\n\x1f ", "\n \n", "a \n \n b", "", None, "x", "\t\n\u0085y\x0b\n", "（Ａ）：  ；\r\r b "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, text string")
    out = df.select("i", text.clean_page_text(F.col("text")).alias("t"))
    assert "transform(" not in _plan(out)

    def plain(t):
        t = re.sub("\r\n|\r| | ", "\n", t or "").translate(str.maketrans(*text.PAGE_PUNCTUATION))
        return "\n".join(x.strip() for x in re.sub(" +", " ", re.sub("\n+", "\n", t)).split("\n")).strip()

    assert [r["t"] for r in out.orderBy("i").collect()] == [plain(t) for t in cases]


def test_patterns_without_letters_leave_case_alone_and_words_lose_no_match(spark):
    assert text.flags(prices.CAPITAL[2]).startswith("(?U)") and text.flags(r"no\.\s*(\d+)").startswith("(?Ui)")
    parts = ["小写", "小写金额", "大写", "大写金额：", "投标报价", "总报价", "总价", "人民币", "￥", "元", "保证金", "：", " ", "1,234.5", "99", "壹拾万", "\n"]
    texts = ["".join(parts[(i * k + j) % len(parts)] for k in range(1, 6)) for i in range(40) for j in range(5)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [F.count_if(F.col("t").rlike(f"(?Ui){p}") & ~text.any_of(F.col("t"), w)) for p, w in prices.PATTERN_WORDS.items()]
    same = [F.count_if(~F.regexp_extract("t", f"(?Ui){p}", 0).eqNullSafe(F.regexp_extract("t", text.flags(p), 0))) for p in prices.PATTERN_WORDS]
    assert set(df.agg(*found, *same).first()) == {0}
    assert set(prices.PATTERN_WORDS) == {*prices.SMALL_EXPLICIT, *prices.SMALL_GENERAL, *prices.CAPITAL, *prices.BOND_SUMMARY}


def _joins(df):
    return _plan(df).count("Join ")


def test_scores_of_items_are_found_in_the_row(spark):
    from tenderlake.operators import scores, writes

    results = spark.createDataFrame(TREES, "id long, project_id long, bidder_name string, detailed_scores string").selectExpr("*", "id bid_document_id", "double(null) total_score", "if(id = 2, 9d, null) price_score", "1d extracted_price")
    ordered = scores.results_ordered(results)
    assert _joins(ordered) == 0
    assert {r["id"]: (r["price_score"], r["detailed_scores"]) for r in ordered.collect()} == {i: (s, t[3]) for t, (i, s) in zip(TREES, {1: 3.0, 2: 9.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: 1.0}.items(), strict=True)}
    escaped = spark.createDataFrame([(1, r'[{"criteria_name":"价格","score":4}]'), (2, r'[{"is_price_criteria":true,"score":5}]'), (3, r'{"PRICE":6}')], "id long, detailed_scores string")
    assert dict(scores.find_price_score(escaped).collect()) == {1: 4.0, 2: 5.0, 3: 6.0}
    new, _ = writes.upsert_result(results.selectExpr("id", "project_id", "'' processing_status", "'' error_message"), results, results.selectExpr("*", "string(null) error"))
    assert _joins(new) == 1 and {r["id"]: r["price_score"] for r in new.collect()} == {1: 3.0, 2: 9.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: 1.0}


def test_score_maps_are_merged_in_the_row(spark):
    from tenderlake.operators import scores

    rows = [(1, '[{"Child_Item_Name":"a","score":1},{"Child_Item_Name":"a","score":2},{"score":3},{"score":4},{"criteria_name":"b","score":"x"}]', '{"b":{"score":5},"c":6,"d":"y"}'), (2, "oops", '{"a":1}'), (3, '{"a":1}', None), (4, None, None), (5, '{"a":1}', '{"a":"x"}')]
    out = scores.merge_score_maps(spark.createDataFrame(rows, "id long, detailed_scores string, dynamic_scores string"))
    assert "Join" not in _plan(out) and "Aggregate" not in _plan(out)
    assert sorted(out.collect(), key=str) == sorted([(1, "a", 2.0), (1, None, 4.0), (1, "b", 5.0), (1, "c", 6.0), (1, "d", None), (2, "a", 1.0), (3, "a", 1.0), (5, "a", 1.0)], key=str)


def test_tables_of_scores_are_not_grouped_by_result(spark):
    from tenderlake.operators import scores

    text = '[{"Child_Item_Name":"x","score":1},{"Child_Item_Name":"y","score":"n"},{"Child_Item_Name":"x","score":3}]'
    results = spark.createDataFrame([(1, 1, 1, "a", text), (2, 1, 2, "b", None), (3, 2, 3, "c", text)], "id long, project_id long, bid_document_id long, bidder_name string, detailed_scores string").selectExpr("*", "double(id) total_score", "if(id = 1, 2d, null) price_score")
    rules_ = spark.createDataFrame([(1, 1, "p", "x", False), (2, 1, "q", "x", False), (3, 1, "p", "y", False), (4, 1, "p", "z", True)], "id long, project_id long, Parent_Item_Name string, Child_Item_Name string, is_price_criteria boolean")
    wide = scores.score_summary(results, rules_, ["x", "y"])
    assert _joins(wide) == 1
    assert sorted(tuple(r) for r in wide.select("id", "rank", "price_score", "x", "y", "total").collect()) == [(1, 2, 2.0, 1.0, None, 4.0), (2, 1, 0.0, None, None, 0.0), (3, 1, 0.0, None, None, 0.0)]
    bids = results.selectExpr("id", "project_id", "'' processing_status", "'' file_path")
    shown = scores.display_table(bids, results, rules_)
    assert _joins(shown) == 2
    assert sorted(tuple(r) for r in shown.select("id", "rank", "rule_id", "score").collect()) == [(1, 2, 1, 3.0), (1, 2, 2, 3.0), (1, 2, 3, 0.0), (2, 1, 1, 0.0), (2, 1, 2, 0.0), (2, 1, 3, 0.0)]


def test_scores_are_looked_up_in_what_is_read(spark):
    """Items are neither grouped nor made into a map, and fields that are not asked for are not read."""
    from tenderlake.operators import scores

    texts = ['[{"Child_Item_Name":"x","score":1},{"Child_Item_Name":"","criteria_name":"x","score":" 2 "},{"criteria_name":"y","score":"none"}]', '{"x":"3","y":"-Infinity"}', '[{"criteria_name":"x","score":true,"max_score":"bad"},{"score":4},{"criteria_name":"y","score":"1e1"}]', '[null,{"criteria_name":"x","score":[1],"children":5}]', "[]", "x", None]
    results = spark.createDataFrame(list(enumerate(texts)), "id long, detailed_scores string").selectExpr("*", "1L project_id", "id bid_document_id", "'b' bidder_name", "double(-id) total_score")
    rules_ = spark.createDataFrame([(1, 1, "p", "x", False), (2, 1, "p", "y", False)], "id long, project_id long, Parent_Item_Name string, Child_Item_Name string, is_price_criteria boolean")
    kept = lambda last: {(r["id"], r["item"]): r["score"] for r in scores.item_scores(results, rules_, last=last).collect()}
    want = {(0, "x"): 1.0, (0, "y"): None, (1, "x"): 3.0, (1, "y"): float("-inf"), (2, "x"): None, (2, "y"): 10.0, **{(i, k): None for i in (3, 4, 5, 6) for k in "xy"}}
    assert kept(False) == want
    assert kept(True) == {**want, (0, "x"): 2.0}
    shown = _plan(scores.display_table(results.selectExpr("id", "project_id", "'' processing_status", "'' file_path"), results, rules_))
    assert "map_from_entries" not in shown and "max_score" not in shown and "children" not in shown


def test_totals_work_prices_out_once(spark):
    """The lowest price needs no second reading of results."""
    from tenderlake.operators import scores

    price = '[{"Child_Item_Name":"a","score":2.5},{"criteria_name":"b","score":"none"},{"criteria_name":"价格分","score":9},{"is_price_criteria":true,"score":7,"extracted_price":%s}]'
    rows = [(1, 1, "a", price % 50, 1.0), (2, 1, "a", '{"a":3}', 40.0), (3, 1, "a", None, None), (4, 1, "b", '{"a":1.005,"c":"NaN?"}', 80.0), (5, 1, None, "[]", 20.0), (6, 2, "a", price % 5, 5.0), (7, 1, "c", None, None), (None, 3, "d", None, 8.0), (9, 3, "e", "x", 4.0)]
    results = spark.createDataFrame(rows, "id long, project_id long, bidder_name string, detailed_scores string, extracted_price double").selectExpr("*", "1d total_score", "2d price_score")
    tops = spark.createDataFrame([(1, 40.0), (3, 10.0)], "project_id long, max_price_score double")
    out = scores.apply_totals(results, scores.score_prices(scores.bid_prices(results), tops)).select("id", "price_score", "extracted_price", "total_score")
    assert _joins(out) == 2
    # The price of a bidder without a name is a project's lowest one all the same; the bidder itself gets no score.
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == {1: (20.0, 40.0, 22.5), 2: (2.0, 40.0, 1.0), 3: (2.0, None, 1.0), 4: (10.0, 80.0, 11.01), 5: (2.0, 20.0, 1.0), 6: (2.0, 5.0, 1.0), 7: (2.0, None, 1.0), None: (5.0, 8.0, 5.0), 9: (10.0, 4.0, 10.0)}


def test_lines_of_one_file_are_gone_through_by_many_tasks(spark):
    """A line without points is not gone through by patterns that go back and forth, however long it is."""
    lines = spark.createDataFrame([(d, n, t) for d in range(60) for n, t in enumerate([f"服务评审({d % 50 + 1}分)", "技术" * 400 + "分", "价格分 （40 分）", "方案评审 5.5分", None])], "doc int, line_no int, line string").coalesce(1)
    found = rules.rules_from_text(lines, fold=False)
    assert "line_no" in found._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(doc")[-1].split(")")[0]
    got = sorted((r["doc"], r["nth"], r["criteria_name"], r["max_score"], r["is_price_criteria"]) for r in found.where("doc < 2").collect())
    assert got == [x for d in range(2) for x in ((d, 1, "服务评审", d + 1.0, False), (d, 2, "价格分", 40.0, True), (d, 3, "价格分", 40.0, True), (d, 4, "方案评审", 5.5, False))]


def test_asked_sources_alone_are_looked_for_and_long_numbers_cost_one_pass(spark):
    import time

    rows = [(1, 0, "投标一览表\n小写金额：￥2,270,000.00\n合计 9"), (1, 1, "12.5 合计 和 1.2,3 总价 ￥7 5元\0 8 总计"), (1, 2, None)]
    own = spark.createDataFrame(rows, "doc_id int, page_no int, text string")
    every = prices.union_candidates(own, include_general=True).drop("seq")
    for rank in (0, 1, 2):
        got = prices.union_candidates(own, sources=[rank]).drop("seq")
        assert sorted(got.collect()) == sorted(every.where(F.col("source_rank") == rank).collect())
    assert sorted(r["value"] for r in every.where("page_no = 1 and source_rank = 1 and pattern_no = 1").collect()) == [8.0, 12.5, 23.0]
    long = spark.range(4).select(F.lit(1).alias("doc_id"), F.col("id").alias("page_no"), F.lit("9" * 20000 + "x 合计 1").alias("text"))
    began = time.time()
    assert [r["value"] for r in prices.union_candidates(long, sources=[1]).collect()] == [1.0] * 4 and time.time() - began < 60


def test_scores_of_a_bid_are_worked_out_in_its_row(spark):
    """Scores in one array for each bid give what rows of scores give, and only bids and rules are moved."""
    rows = [(1, 1, "技术", 10, "方案", 6, False, False), (2, 1, "商务", 10, "方案", 3, True, False), (3, 1, "价格", 40, None, None, False, True)]
    df = spark.createDataFrame(rows, "id long, project_id long, Parent_Item_Name string, Parent_max_score int, Child_Item_Name string, Child_max_score int, is_veto boolean, is_price_criteria boolean")
    leaves = spark.createDataFrame([(1, 7, 1, 6.0, "好", None), (1, 7, 2, 3.0, None, None), (1, 7, 3, None, None, 5.5), (1, 7, 9, 1.0, None, None), (2, 8, 1, 1.0, None, None)], "project_id long, bid_id long, rule_id long, score double, reason string, extracted_price double")
    lists = leaves.groupBy("project_id", "bid_id").agg(F.collect_list(F.struct("rule_id", "score", "reason", "extracted_price")).alias("scores"))
    key = lambda df_: sorted((tuple(map(str, r)) for r in df_.select("project_id", "bid_id", "rule_id", "name", "level", "max_score", "score", "reason", "is_veto", "leaves").collect()))
    got = key(rules.veto_and_tree_scores(df, lists))
    assert got == key(rules.veto_and_tree_scores(df, leaves)) and len(got) == 5
    plan = rules.veto_and_tree_scores(df, leaves)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan


def test_answers_are_read_once_and_odd_values_keep_their_meaning(spark):
    said = ['{"score": 5, "reason": 1.50}', '{"score": "7"}', '{"score": 1E400}', '{"score": 99, "reason": {"a":1}', '{"score": true, "reason": null}', '得8.5分', None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string").select("i", answers.parse_score_answer(F.col("x"), F.lit(10)).alias("a"))
    assert [tuple(r["a"]) for r in df.orderBy("i").collect()] == [(5.0, "1.5"), (0.0, "未提供理由。"), (0.0, "未提供理由。"), (0.0, "解析AI响应失败。"), (0.0, "未提供理由。"), (8.5, "从文本中提取到分数: 得8.5分"), (0.0, "模型调用失败: ")]
    assert "StructField(score" not in df._jdf.queryExecution().optimizedPlan().toString()  # the score comes with the one parse


def test_what_is_asked_and_what_is_answered_meet_in_the_row_of_their_bid(spark):
    """Nothing is joined by pair, and ids that no pair has, several answers and bids of two projects count as a join would count them."""
    from tenderlake.plans import flows

    rows = [("1:11", 1, 7, 11, "技术", "方案", 20), ("1:12", 1, 7, 12, None, "团队", 10), ("1:12", 1, 8, 12, "商务", "团队", 10), ("2:11", 2, 7, 11, "技术", "方案", 20), ("3:13", 3, 9, 13, None, "服务", None)]
    asked = spark.createDataFrame(rows, "pair_id string, bid_id long, project_id long, rule_id long, parent string, item string, max_score int")
    said = [("1:11", '{"score": 5, "reason": "a"}'), ("1:11", "得30分"), ("1:12", None), ("01:12", '{"score": 9}'), ("2:12", '{"score": 9}'), ("2:11", "Error: y"), ("9:9", '{"score": 1}'), ("7", '{"score": 1}'), (None, '{"score": 1}'), ("3:13", '{"score": 700, "reason": "b"}'), ("1:11:2", '{"score": 1}'), ("1:+11", '{"score": 1}')]
    df = flows.score_bids(asked, spark.createDataFrame(said, "pair_id string, response string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate [") == 1
    item = lambda name, top, score, reason, parent=None: f'{{"Child_Item_Name":"{name}",' + (f'"max_score":{top},' if top else "") + f'"score":{score},"reason":"{reason}"' + (f',"Parent_Item_Name":"{parent}"' if parent else "") + "}"
    first = ",".join([item("方案", 20.0, 5.0, "a", "技术"), item("方案", 20.0, 20.0, "从文本中提取到分数: 得30分", "技术"), item("团队", 10.0, 0.0, "模型调用失败: ")])
    assert sorted(tuple(r) for r in df.select("bid_id", "project_id", "detailed_scores", "total_score").collect()) == [
        (1, 7, f"[{first}]", 25.0),
        (1, 8, f"[{item('团队', 10.0, 0.0, '模型调用失败: ', '商务')}]", 0.0),
        (2, 7, f"[{item('方案', 20.0, 0.0, '模型调用失败: Error: y', '技术')}]", 0.0),
        (3, 9, f"[{item('服务', None, 700.0, 'b')}]", 700.0),
    ]
