"""Registered queries on prices, scores, rules, progress and writes, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import project_code, status_text, valid_score
from ..functions.text import is_price_rule
from ..operators import rules as R
from ..operators import scores as S
from ..operators import status as P
from ..operators import writes as W
from ..sources.tables import schema
from .views import frames, with_views

QUERIES, ORACLE = {}, {}


def query(name, *views, sql=None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*frames(spark, sf_dir, *views))
        if sql:
            ORACLE[name] = with_views(sql)
        return f

    return add


_R2 = "cast(round(cast({} AS decimal(28,6)), 2) AS double)"
_PRICES = """prices AS (SELECT project_id, bidder_name, arg_max(p, id) AS price FROM (SELECT *, CASE WHEN flag = 'R' THEN floor(price) WHEN flag = 'N' AND qty % 3 = 0 THEN NULL ELSE price END AS p FROM {v_bids}) x WHERE p IS NOT NULL GROUP BY 1, 2)"""
_TOPS = """tops AS (SELECT project_id, 40.0e0 AS top FROM {v_rules} WHERE is_price_criteria GROUP BY 1)"""
_SCORED = f"""{_PRICES}, {_TOPS}, bench AS (SELECT project_id, min(price) AS benchmark FROM prices GROUP BY 1),
    scored AS (SELECT project_id, bidder_name, price, benchmark, {_R2.format('benchmark / price * top')} AS price_score FROM prices JOIN bench USING (project_id) JOIN tops USING (project_id))"""
_RANK = "row_number() OVER (PARTITION BY project_id ORDER BY total_score DESC NULLS LAST, id)"

query("bid_prices", "v_results", sql=f"WITH {_PRICES} SELECT * FROM prices")(S.bid_prices)
query("lowest_price", "v_results", sql=f"WITH {_PRICES} SELECT project_id, min(price) AS benchmark, (min(struct_pack(a := price, b := bidder_name))).b AS lowest_bidder, count(price) AS n_priced FROM prices GROUP BY 1")(lambda r: S.lowest_price(S.bid_prices(r)))


@query("price_scores", "v_results", "v_rules", sql=f"""WITH {_SCORED} SELECT b.project_id, b.bidder_name, price, benchmark, coalesce(price_score, 0) AS price_score
    FROM (SELECT DISTINCT project_id, bidder_name FROM {{v_bids}}) b JOIN tops USING (project_id) LEFT JOIN scored USING (project_id, bidder_name)""")
def _(results, rules):
    return S.price_scores(results, rules)


@query("mean_price_scores", "v_results", "v_rules", sql=f"""WITH {_PRICES}, {_TOPS}, bench AS (SELECT project_id, cast(sum(cast(round(price * 100) AS bigint)) AS double) / count(*) AS cents FROM prices GROUP BY 1)
    SELECT project_id, bidder_name, cast(round(price * 100) AS bigint) AS price_cents, round({_R2.format('cents / (price * 100) * top')}, 1) AS price_score FROM prices JOIN bench USING (project_id) JOIN tops USING (project_id)""")
def _(results, rules):
    out = S.score_prices(S.bid_prices(results), S.price_rule_max(rules), mean=True)
    return out.select("project_id", "bidder_name", F.round(F.col("price") * 100).cast("long").alias("price_cents"), F.round("price_score", 1).alias("price_score"))


@query("paired_price_score", "v_results", "v_rules", sql=f"""WITH {_SCORED} SELECT project_id, bidder_name, price, CASE WHEN count(price) OVER (PARTITION BY project_id) < 2 THEN 0 ELSE price_score END AS price_score,
    concat('根据价格评分规则计算得出。提取到的报价为: ', cast(price AS string)) AS reason FROM scored""")
def _(results, rules):
    return S.paired_price_score(S.bid_prices(results), S.price_rule_max(rules)).drop("benchmark")


_OTHER = "other AS (SELECT id, coalesce(sum(score) FILTER (NOT price_item AND item NOT LIKE '价格%'), 0) AS other_total FROM {v_items} GROUP BY 1)"
query("other_scores_total", "v_results", sql=f"WITH {_OTHER} SELECT * FROM other")(S.other_scores_total)
query("find_price_score", "v_scores", sql="""SELECT id, CASE WHEN detailed_scores LIKE '{%' THEN 4.0e0 WHEN detailed_scores LIKE '%投标报价%' THEN 3.0e0 WHEN detailed_scores LIKE '%is_price%' THEN 7.0e0 ELSE 0.0e0 END AS found_score FROM {v_scores}""")(S.find_price_score)
query("first_per_bidder", "v_results", sql="SELECT min(id) AS id, project_id, bidder_name FROM {v_bids} GROUP BY project_id, bidder_name")(lambda r: S.first_per_bidder(r).select("id", "project_id", "bidder_name"))


@query("apply_totals", "v_results", "v_rules", sql=f"""WITH {_SCORED}, {_OTHER}, firsts AS (SELECT min(id) AS id, project_id, bidder_name FROM {{v_bids}} GROUP BY 2, 3),
    new AS (SELECT firsts.id, price_score, price, {_R2.format('other_total + price_score')} AS total FROM firsts JOIN scored USING (project_id, bidder_name) JOIN other ON other.id = firsts.id)
    SELECT r.id, coalesce(new.price_score, r.price_score) AS price_score, coalesce(new.price, r.extracted_price) AS extracted_price, coalesce(new.total, r.total_score) AS total_score FROM {{v_results}} r LEFT JOIN new ON new.id = r.id""")
def _(results, rules):
    return S.apply_totals(results, S.score_prices(S.bid_prices(results), S.price_rule_max(rules))).select("id", "price_score", "extracted_price", "total_score")


query("rank_bidders", "v_results", sql=f"SELECT id, project_id, total_score, {_RANK} AS rank FROM {{v_results}}")(lambda r: S.rank_bidders(r).select("id", "project_id", "total_score", "rank"))
query("ranking_summary", "v_bids", "v_results", sql=f"SELECT project_id, {_RANK} AS rank, bidder_name, total_score, price_score, extracted_price FROM {{v_results}}")(S.ranking_summary)
query("results_ordered", "v_results", sql=f"SELECT r.id, r.project_id, CASE WHEN flag = 'R' THEN 7.0e0 ELSE 0.0e0 END AS price_score, row_number() OVER (PARTITION BY r.project_id ORDER BY total_score DESC NULLS LAST, r.id) AS rank FROM {{v_results}} r JOIN {{v_bids}} b ON b.id = r.id".replace("{{", "{").replace("}}", "}"))(lambda r: S.results_ordered(r).select("id", "project_id", "price_score", "rank"))
query("bid_results", "v_bids", "v_results", sql="SELECT r.id, r.project_id, r.bidder_name, processing_status FROM {v_results} r JOIN {v_bids} b ON b.id = r.bid_document_id AND b.project_id = r.project_id")(lambda b, r: S.bid_results(b, r).select("id", "project_id", "bidder_name", "processing_status"))
_CHILDREN = "kids AS (SELECT project_id, id AS rule_id, Parent_Item_Name AS parent, Child_Item_Name AS item, Child_max_score AS top, is_veto FROM {v_rules} WHERE Child_Item_Name IS NOT NULL AND NOT is_price_criteria)"
query("item_scores", "v_results", "v_rules", sql=f"WITH {_CHILDREN} SELECT r.id, r.project_id, r.bidder_name, rule_id, parent, kids.item, i.score FROM {{v_results}} r JOIN kids USING (project_id) LEFT JOIN {{v_items}} i ON i.id = r.id AND i.item = kids.item")(lambda r, ru: S.item_scores(r, ru))


@query("score_summary", "v_results", "v_rules", sql=f"""WITH s AS (SELECT id, sum(score) FILTER (item = '方案') AS a, sum(score) FILTER (item = '团队') AS b, sum(score) FILTER (item = '资质') AS c, sum(score) FILTER (item = '服务') AS d FROM {{v_items}} GROUP BY 1)
    SELECT r.id, r.project_id, r.bidder_name, {_RANK.replace('id)', 'r.id)').replace('project_id', 'r.project_id')} AS rank, 0.0e0 AS price_score, a AS "方案", b AS "团队", c AS "资质", d AS "服务", {_R2.format('a + b + c + coalesce(d, 0)')} AS total FROM {{v_results}} r JOIN s ON s.id = r.id""")
def _(results, rules):
    return S.score_summary(results, rules, ["方案", "团队", "资质", "服务"])


@query("display_table", "v_bids", "v_results", "v_rules", sql=f"""WITH {_CHILDREN}, ranked AS (SELECT id, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(total_score, 0) DESC, id) AS rank FROM {{v_results}})
    SELECT r.project_id, r.id, r.bidder_name, rank, rule_id, kids.item, coalesce(i.score, 0) AS score FROM {{v_results}} r JOIN ranked ON ranked.id = r.id JOIN kids ON kids.project_id = r.project_id LEFT JOIN {{v_items}} i ON i.id = r.id AND i.item = kids.item""")
def _(bids, results, rules):
    return S.display_table(bids, results, rules)


@query("summary_headers", "v_rules", sql=f"""WITH {_CHILDREN}, g0 AS (SELECT project_id, coalesce(parent, '') AS parent, min(rule_id) AS first, count(*) AS n FROM kids GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY first) AS g FROM g0),
    m AS (SELECT project_id, max(g) AS g FROM g GROUP BY 1)
    SELECT project_id, 1 AS row, cast(g + 2 AS int) AS pos, parent AS name, n AS colspan, 1 AS rowspan FROM g
    UNION ALL SELECT project_id, 1, 1, 'rank', 1, 2 FROM m UNION ALL SELECT project_id, 1, 2, 'bidder', 1, 2 FROM m UNION ALL SELECT project_id, 1, cast(g + 3 AS int), 'price', 1, 2 FROM m UNION ALL SELECT project_id, 1, cast(g + 4 AS int), 'total', 1, 2 FROM m
    UNION ALL SELECT k.project_id, 2, cast(row_number() OVER (PARTITION BY k.project_id ORDER BY g, rule_id) AS int), concat(item, '(', cast(top AS string), ')'), 1, 1 FROM kids k JOIN g ON g.project_id = k.project_id AND g.parent = coalesce(k.parent, '')""")
def _(rules):
    return S.summary_headers(rules)


query("partial_results", "v_results", sql="""SELECT id, concat('[', string_agg(concat('{"item":"', item, '"', CASE WHEN score IS NULL THEN '' ELSE concat(',"score":', cast(cast(score AS int) AS string), '.0') END, '}'), ',' ORDER BY pos), ']') AS partial FROM {v_items} WHERE pos < 5 GROUP BY id""")(S.partial_results)


_NEW_ITEM = """'"reason":"根据评标规则重新计算的价格分: ', cast(n AS string), '","score":', cast(n AS string), '}'"""
_UPDATED = """, j AS (SELECT t.id, t.detailed_scores, b.qty, cast(b.disc AS string) AS d, s.price_score AS n FROM {v_scores} t JOIN {v_bids} b ON b.id = t.id LEFT JOIN scored s ON s.project_id = t.project_id AND s.bidder_name = t.bidder_name)
    SELECT id, CASE WHEN n IS NULL OR qty % 4 = 3 THEN detailed_scores
        WHEN qty % 4 = 0 THEN concat('[{"children":[{"criteria_name":"团队","score":1},{"criteria_name":"投标报价","extra":"e","is_price_criteria":true,', NEW_ITEM, '],"criteria_name":"技术","score":', d, ',"weight":2.5}]')
        WHEN qty % 4 = 1 THEN concat('{"价格分":', cast(n AS string), ',"其他":{"score":1},"方案":', d, '}')
        ELSE concat('[{"Child_Item_Name":"方案","score":', d, '},{"is_price_criteria":true,"note":null,', NEW_ITEM, ']') END AS detailed_scores FROM j""".replace("NEW_ITEM", _NEW_ITEM)


@query("update_price_in_scores", "v_results", "v_rules", "v_scores", sql=f"WITH {_SCORED}" + _UPDATED)
def _(results, rules, scores):
    return S.update_price_in_scores(scores, S.score_prices(S.bid_prices(results), S.price_rule_max(rules))).select("id", "detailed_scores")


@query("merge_score_maps", "v_results", "v_bids", sql="""WITH o AS (SELECT id, '团队' AS item, 9.5e0 AS score FROM {v_bids} WHERE qty % 4 = 0 UNION ALL SELECT id, '其他', 1.0e0 FROM {v_bids} WHERE qty % 4 = 0)
    SELECT coalesce(i.id, o.id) AS id, coalesce(i.item, o.item) AS item, coalesce(o.score, i.score) AS score FROM {v_items} i FULL JOIN o ON o.id = i.id AND o.item = i.item""")
def _(results, bids):
    dynamic = bids.select("id", F.when(F.col("qty") % 4 == 0, '{"团队":{"score":9.5},"其他":1}').alias("dynamic_scores"))
    return S.merge_score_maps(results.join(dynamic, "id"))


@query("price_audit", "v_bids", "v_results", "v_rules", sql="""WITH c AS (SELECT project_id, count(*) FILTER (Child_Item_Name IS NULL AND NOT is_price_criteria) AS parent_rules, count(*) FILTER (Child_Item_Name IS NOT NULL AND NOT is_price_criteria) AS child_rules, count(*) FILTER (is_price_criteria) AS price_rules FROM {v_rules} GROUP BY 1)
    SELECT b.id AS bid_document_id, b.project_id, processing_status, CASE WHEN qty % 2 = 0 THEN extracted_price END AS extracted_price, qty % 2 = 0 AS has_result, CASE WHEN flag = 'R' AND qty % 2 = 0 THEN 1 ELSE 0 END AS price_items, coalesce(parent_rules, 0) AS parent_rules, coalesce(child_rules, 0) AS child_rules, coalesce(price_rules, 0) AS price_rules
    FROM {v_bids} b JOIN {v_results} r ON r.id = b.id LEFT JOIN c ON c.project_id = b.project_id""")
def _(bids, results, rules):
    return S.price_audit(bids, results.join(bids.where("qty % 2 = 0").select("id"), "id", "left_semi"), rules)


# Rules.
query("inherit_parent", "v_rules", sql="""SELECT id, last_value(nullif(Parent_Item_Name, '') IGNORE NULLS) OVER w AS Parent_Item_Name, last_value(nullif(Parent_max_score, 0) IGNORE NULLS) OVER w AS Parent_max_score FROM {v_rules} WINDOW w AS (PARTITION BY project_id ORDER BY id ROWS UNBOUNDED PRECEDING)""")(lambda r: R.inherit_parent(r).select("id", "Parent_Item_Name", "Parent_max_score"))
query("drop_incomplete_rules", "v_rules", sql="SELECT id FROM {v_rules} WHERE is_price_criteria OR Child_Item_Name IS NOT NULL OR Child_max_score IS NOT NULL")(lambda r: R.drop_incomplete_rules(r).select("id"))
query("parent_max_totals", "v_rules", sql="""WITH k AS (SELECT project_id, 0 AS l, min(id) AS first, Parent_Item_Name AS parent, cast(sum(Child_max_score) AS double) AS max_score, string_agg(Child_Item_Name, ',' ORDER BY id) AS children FROM {v_rules} WHERE NOT is_price_criteria AND Parent_Item_Name IS NOT NULL AND Child_Item_Name IS NOT NULL GROUP BY 1, 4
    UNION ALL SELECT project_id, 1, id, Parent_Item_Name, cast(Parent_max_score AS double), '价格分' FROM {v_rules} WHERE is_price_criteria) SELECT project_id, cast(row_number() OVER (PARTITION BY project_id ORDER BY l, first) AS int) AS pos, parent, max_score, children FROM k""")(R.parent_max_totals)
_TREE = """g AS (SELECT project_id, Parent_Item_Name AS parent, coalesce(max(Parent_max_score), 0) * 1.0e0 AS m, sum(CASE WHEN Child_Item_Name IS NOT NULL THEN coalesce(Child_max_score, 0) END) * 1.0e0 AS s FROM {v_rules_more} WHERE NOT is_price_criteria GROUP BY 1, 2),
    t AS (SELECT *, CASE WHEN abs(m - s) > 0.1 THEN s ELSE m END AS top FROM g), o AS (SELECT project_id, sum(top) AS others, count(*) FILTER (abs(s - m) > 0.1) AS parents_off FROM t GROUP BY 1),
    p AS (SELECT project_id, arg_max(Parent_max_score, id) * 1.0e0 AS price FROM {v_rules_more} WHERE is_price_criteria GROUP BY 1)"""
query("rule_total_check", "v_rules_more", sql=f"WITH {_TREE} SELECT project_id, others + coalesce(price, 0) AS total, abs(others + coalesce(price, 0) - 100) > 0.1 AS off, parents_off FROM o LEFT JOIN p USING (project_id)")(R.rule_total_check)
query("normalise_to_100", "v_rules_more", sql=f"""WITH {_TREE}, f AS (SELECT project_id, CASE WHEN abs(others + coalesce(price, 0) - 100) > 0.1 AND price > 30 AND others > 0 THEN (100 - price) / others ELSE 1.0e0 END AS f FROM o LEFT JOIN p USING (project_id))
    SELECT id, cast(round(CASE WHEN is_price_criteria THEN Parent_max_score ELSE top * f END * 1000) AS bigint) AS parent_max, cast(round(CASE WHEN NOT is_price_criteria AND Child_Item_Name IS NOT NULL THEN coalesce(Child_max_score, 0) * f END * 1000) AS bigint) AS child_max
    FROM {{v_rules_more}} r JOIN f ON f.project_id = r.project_id LEFT JOIN t ON t.project_id = r.project_id AND t.parent IS NOT DISTINCT FROM r.Parent_Item_Name AND NOT r.is_price_criteria""")(lambda r: R.normalise_to_100(r).select("id", F.round(F.col("parent_max") * 1000).cast("long").alias("parent_max"), F.round(F.col("child_max") * 1000).cast("long").alias("child_max")))
query("default_rules", "v_projects", "v_rules", sql="SELECT id AS project_id, nth, name, max_score, is_price_criteria FROM (SELECT id FROM {v_projects} WHERE id % 3 = 0) p CROSS JOIN (SELECT 1 AS nth, '技术方案' AS name, 60.0e0 AS max_score, false AS is_price_criteria UNION ALL SELECT 2, '价格分', 40.0e0, true) d")(lambda p, r: R.default_rules(p, r.where("project_id % 3 <> 0")).drop("description"))
query("standard_rules", "v_rules", sql="SELECT project_id, Child_Item_Name AS item, Child_max_score AS max_score, description FROM {v_rules} WHERE NOT is_price_criteria")(R.standard_rules)
query("rules_view", "v_projects", "v_rules", sql="""SELECT project_id, Parent_Item_Name AS category, coalesce(Child_Item_Name, Parent_Item_Name) AS name, cast(coalesce(Child_max_score, Parent_max_score) AS double) AS max_score, r.description, 1.0e0 AS weight FROM {v_rules} r JOIN {v_projects} p ON p.id = r.project_id WHERE scoring_rules_summary IS NULL
    UNION ALL SELECT id, '总', status, 100.0e0, 'd', 1.0e0 FROM {v_projects} WHERE scoring_rules_summary IS NOT NULL""")(R.rules_view)
@query("veto_and_tree_scores", "v_results", "v_rules", sql=f"""WITH k AS (SELECT project_id, id AS rule_id, Parent_Item_Name AS parent, Child_Item_Name AS given, CASE WHEN Child_Item_Name = '资质' AND project_id % 2 = 0 THEN '方案' ELSE Child_Item_Name END AS item, Child_max_score * 1.0e0 AS top, coalesce(Parent_max_score, 0) * 1.0e0 AS pmax, is_veto FROM {{v_rules}} WHERE NOT is_price_criteria),
    l AS (SELECT i.project_id, i.id AS bid_id, rule_id, k.item, parent, is_veto, top, pmax, CASE WHEN is_veto THEN 0.0e0 ELSE coalesce(score, 0) END AS score FROM {{v_items}} i JOIN k ON k.project_id = i.project_id AND k.given = i.item)
    SELECT project_id, bid_id, rule_id, item AS name, 2 AS level, CASE WHEN is_veto THEN 0 ELSE top END AS max_score, score, CASE WHEN is_veto THEN '{R.VETO_REASON}' END AS reason, is_veto, cast(1 AS bigint) AS leaves FROM l
    UNION ALL SELECT project_id, bid_id, NULL, coalesce(parent, ''), 1, max(pmax), sum(score), '{R.SUM_REASON}', false, count(*) FROM l GROUP BY project_id, bid_id, coalesce(parent, '')
    UNION ALL SELECT r.project_id, r.id, u.id, '价格', 1, 40.0e0, 0.0e0, concat('{R.PENDING_REASON}', coalesce(cast(extracted_price AS string), 'None')), false, 1 FROM {{v_results}} r JOIN {{v_rules}} u ON u.project_id = r.project_id AND u.is_price_criteria""")
def _(results, rules):
    """In every second project two parents have a child of one name."""
    given = S.item_score_lists(results, rules)
    named = F.when((F.col("Child_Item_Name") == "资质") & (F.col("project_id") % 2 == 0), "方案").otherwise(F.col("Child_Item_Name"))
    return R.veto_and_tree_scores(rules.withColumn("Child_Item_Name", named), given)


@query("flatten_rules", "part", sql="""SELECT p_partkey AS project_id, CASE WHEN p_size % 2 = 0 THEN concat('T', p_brand) ELSE p_name END AS Parent_Item_Name, CASE WHEN p_size % 2 = 0 THEN p_size END AS Parent_max_score, CASE WHEN p_size % 2 <> 0 THEN p_name END AS Child_Item_Name, CASE WHEN p_size % 2 <> 0 THEN p_size END AS Child_max_score, false AS is_price_criteria, 1 AS id FROM {part}
    UNION ALL SELECT p_partkey, concat('T', p_brand), NULL, concat('c', cast(k AS string)), p_size * k, false, 1 + k FROM {part} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) ks WHERE p_size % 2 = 0
    UNION ALL SELECT p_partkey, '价格分', 40, NULL, NULL, true, CASE WHEN p_size % 2 = 0 THEN 4 ELSE 2 END FROM {part}""")
def _(part):
    kid = lambda k: F.struct(F.lit(f"c{k}").alias("criteria_name"), (F.col("p_size") * k).cast("double").alias("max_score"), F.lit("d").alias("description"), F.lit(False).alias("is_price_criteria"))
    even = F.col("p_size") % 2 == 0
    row = lambda nth, name, top, flag, children: F.struct(F.lit(nth).alias("nth"), name.alias("criteria_name"), top.cast("double").alias("max_score"), F.lit("d").alias("description"), F.lit(flag).alias("is_price_criteria"), children.alias("children"))
    kids = F.array(kid(1), kid(2))
    rows = F.array(row(1, F.when(even, F.concat(F.lit("T"), "p_brand")).otherwise(F.col("p_name")), F.col("p_size"), False, F.when(even, kids)), row(2, F.lit("价格分"), F.lit(40), True, F.when(F.lit(False), kids)))
    return R.flatten_rules(part.select(F.col("p_partkey").alias("project_id"), F.explode(rows).alias("x")).select("project_id", "x.*")).drop("description")


query("is_price_rule", "part", sql="SELECT p_partkey, contains(lower(p_name), 'a') OR contains(lower(p_name), '价格') AS by_name, contains(lower(p_type), 'brass') OR p_size % 2 = 0 AS by_flag FROM {part}")(lambda p: p.select("p_partkey", is_price_rule("rows", F.col("p_name"), words=["a", "价格"]).alias("by_name"), is_price_rule("scores", F.col("p_type"), flag=F.col("p_size") % 2 == 0, words=["brass"]).alias("by_flag")))
query("valid_score", "lineitem", sql="SELECT l_orderkey, l_linenumber, l_quantity > 0 AND l_quantity <= 100 AND cast(l_quantity * 10 AS bigint) = l_quantity * 10 AS q, round(l_discount * 100) % 10 = 0 AND l_discount > 0 AS d FROM {lineitem}")(lambda x: x.select("l_orderkey", "l_linenumber", valid_score(F.col("l_quantity")).alias("q"), valid_score(F.col("l_discount")).alias("d")))
query("project_code", "orders", sql="SELECT o_orderkey, concat('PRJ-', strftime(o_orderdate, '%Y%m%d-%H%M%S')) AS code, substr(concat(o_orderpriority, ' - ', o_orderstatus), 1, 100) AS status FROM {orders}")(lambda o: o.select("o_orderkey", project_code(F.col("o_orderdate")).alias("code"), status_text(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("status")))

# Progress.
query("completion_status", "v_bids", sql="""SELECT project_id, count(*) AS n_bids, count(*) FILTER (processing_status = 'completed') AS n_completed, count(*) FILTER (processing_status = 'error') AS n_error, count(*) FILTER (processing_status = 'processing') AS n_open,
    CASE WHEN count(*) FILTER (processing_status = 'processing') > 0 THEN 'processing' WHEN count(*) FILTER (processing_status = 'error') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM {v_bids} GROUP BY 1""")(P.completion_status)
@query("progress_report", "v_bids", sql="""SELECT id, project_id, processing_status, bidder_name, progress_completed_rules AS progress_completed, progress_total_rules AS progress_total, CASE WHEN progress_total_rules = 0 THEN 0.0e0 ELSE progress_completed_rules * 100.0e0 / progress_total_rules END AS percent,
    count(*) FILTER (processing_status IN ('completed', 'error')) OVER (PARTITION BY project_id) * 100.0e0 / count(*) OVER (PARTITION BY project_id) AS overall_percent, CASE WHEN qty % 3 = 0 THEN concat('[{"item":"a","score":', cast(qty AS string), '}]') END AS partial_analysis_results FROM {v_bids}""")
def _(bids):
    partial = F.when(F.col("qty") % 3 == 0, F.concat(F.lit('[{"score": '), F.col("qty").cast("string"), F.lit(', "item": "a"}]'))).when(F.col("qty") % 3 == 1, "{broken")
    return P.progress_report(bids.withColumn("partial_analysis_results", partial))


query("recalc_gate", "v_bids", "v_results", "v_rules", sql=f"WITH {_SCORED}, ready AS (SELECT project_id FROM {{v_bids}} GROUP BY 1 HAVING count(*) FILTER (flag <> 'N') < 20) SELECT b.project_id, b.bidder_name, price, benchmark, coalesce(price_score, 0) AS price_score FROM (SELECT DISTINCT project_id, bidder_name FROM {{v_bids}}) b JOIN ready USING (project_id) JOIN tops USING (project_id) LEFT JOIN scored USING (project_id, bidder_name)")(lambda b, r, ru: P.recalc_gate(_gated(b), r, ru))


def _gated(bids):
    """A bid is open if its project has 20 bids or more that are returned or refused."""
    from pyspark.sql import Window

    many = F.count_if(F.col("flag") != "N").over(Window.partitionBy("project_id")) >= 20
    return bids.withColumn("processing_status", F.when(many, "processing").otherwise("completed"))


@query("project_overview", "v_projects", "v_bids", "v_results", sql="""SELECT p.id, coalesce(b.n, 0) AS bid_count, coalesce(r.n, 0) AS result_count, concat('2024-01-', lpad(cast(1 + p.id % 28 AS string), 2, '0'), 'T00:00:', lpad(cast(p.id % 60 AS string), 2, '0'), CASE WHEN p.id % 2 = 1 THEN '.500000' ELSE '' END) AS created_at FROM {v_projects} p
    LEFT JOIN (SELECT project_id, count(*) AS n FROM {v_bids} GROUP BY 1) b ON b.project_id = p.id LEFT JOIN (SELECT project_id, count(*) AS n FROM {v_results} GROUP BY 1) r ON r.project_id = p.id""")
def _(projects, bids, results):
    at = F.expr("make_timestamp(2024, 1, cast(1 + id % 28 as int), 0, 0, cast(id % 60 + if(id % 2 = 1, 0.5, 0) as decimal(8, 6)))")
    return P.project_overview(projects.withColumn("created_at", at), bids, results).select("id", "bid_count", "result_count", "created_at")


query("project_bidders", "v_bids", sql="SELECT project_id, id, bidder_name, processing_status, file_path, file_size FROM {v_bids}")(P.project_bidders)
query("bid_rule_pairs", "v_bids", "v_rules", sql=f"WITH {_CHILDREN} SELECT b.id AS bid_id, b.project_id, rule_id, item FROM {{v_bids}} b JOIN kids USING (project_id)")(lambda b, r: _pairs(b, r).select("bid_id", "project_id", "rule_id", "item"))


def _pairs(bids, rules):
    from ..operators.pages import bid_rule_pairs

    return bid_rule_pairs(bids, rules)


# Writes.
query("replace_by_key", "v_results", sql="WITH n AS (SELECT DISTINCT project_id FROM {v_results} WHERE project_id % 4 = 0 AND id % 2 = 0) SELECT r.id, r.project_id, r.total_score FROM {v_results} r LEFT JOIN n ON n.project_id = r.project_id WHERE n.project_id IS NULL UNION ALL SELECT id, project_id, 1.0e0 FROM {v_results} WHERE project_id % 4 = 0 AND id % 2 = 0")(lambda r: W.replace_by_key(r.select("id", "project_id", "total_score"), r.where("project_id % 4 = 0 and id % 2 = 0").select("id", "project_id", F.lit(1.0).alias("total_score")), ["project_id"]))
query("patch_rows", "v_bids", sql="SELECT id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN concat('N', bidder_name) ELSE bidder_name END AS bidder_name, id % 3 = 0 AND id % 2 = 0 AS patched FROM {v_bids}")(lambda b: W.patch_rows(b.select("id", "bidder_name"), b.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("N"), "bidder_name")).otherwise("  ").alias("bidder_name")), "id", ["bidder_name"]))
query("purge_project", "v_projects", "v_bids", "v_results", "v_rules", sql="SELECT 'tender_project' AS t, count(*) AS n FROM {v_projects} WHERE id % 5 <> 0 UNION ALL SELECT 'bid_document', count(*) FROM {v_bids} WHERE project_id % 5 <> 0 UNION ALL SELECT 'analysis_result', count(*) FROM {v_results} WHERE project_id % 5 <> 0 UNION ALL SELECT 'scoring_rule', count(*) FROM {v_rules} WHERE project_id % 5 <> 0")(lambda p, b, r, ru: _purged(p, b, r, ru))


def _purged(projects, bids, results, rules):
    from functools import reduce

    left = W.purge_project({"tender_project": projects, "bid_document": bids, "analysis_result": results, "scoring_rule": rules}, projects.where("id % 5 = 0"))
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n") for t, df in left.items()])


query("migrate_schema", "part", sql="SELECT p_partkey AS id, p_size AS project_id, substr(p_name, 1, 20) AS Parent_Item_Name, p_size AS Parent_max_score, substr(p_name, 1, 20) AS Child_Item_Name, p_size AS Child_max_score, p_type AS description, false AS is_veto, p_size % 2 = 0 AS is_price_criteria, CAST(NULL AS string) AS price_formula FROM {part}")(lambda p: W.add_missing_columns(W.migrate_rules(p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("project_id"), F.col("p_name").alias("criteria_name"), F.col("p_size").cast("double").alias("max_score"), F.col("p_type").alias("description"), F.lit(None).cast("boolean").alias("is_veto"), (F.col("p_size") % 2 == 0).alias("is_price_criteria"))), schema("scoring_rule")))
query("upsert_result", "v_bids", "v_results", sql="SELECT b.id, CASE WHEN qty % 5 = 0 THEN 'error' WHEN qty % 5 = 1 THEN 'completed' ELSE processing_status END AS processing_status, CASE WHEN qty % 5 = 0 THEN 'failed' END AS error_message, CASE WHEN qty % 5 = 1 THEN 50.0e0 ELSE total_score END AS total_score, CASE WHEN qty % 5 = 1 THEN CASE WHEN flag = 'R' THEN 7.0e0 ELSE 0.0e0 END END AS price_score FROM {v_bids} b JOIN {v_results} r ON r.id = b.id")(lambda b, r: _upserted(b, r))


def _upserted(bids, results):
    own = results.join(bids.select("id", (F.col("qty") % 5).alias("m")), "id").where("m < 2")
    analyses = own.withColumn("error", F.when(F.col("m") == 0, "failed")).withColumn("total_score", F.lit(50.0)).drop("m")
    new, after = W.upsert_result(bids.withColumn("error_message", F.lit(None).cast("string")), results, analyses)
    return after.select("id", "processing_status", "error_message").join(new.select("id", "total_score", "price_score"), "id")
