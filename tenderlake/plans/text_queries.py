"""Registered queries on pages, text, prices, names, tables, answers and streams, with the same in SQL where it has the means."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import numbers as N
from ..functions import text as T
from ..operators import names, pages, prices, rules, sections, tables
from ..sources.tables import changed_documents, export_json, schema
from ..operators.writes import check_schema
from ..sources.kept import KeptTable
from ..sources.shared import scratch as _scratch
from ..sources.shared import forgotten, shuffles_dropped, written
from ..streaming.status import BIDS, PROGRESS, live_progress, run_status_stream, score_on_complete, status_of
from . import flows
from .score_queries import _OTHER as OTHER
from .score_queries import _R2 as R2
from .score_queries import _SCORED as SCORED
from .views import frames, with_views

QUERIES, ORACLE = {}, {}


def query(name, *views, sql=None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*frames(spark, sf_dir, *views))
        if sql:
            ORACLE[name] = with_views(sql)
        return f

    return add


def _docpages(documents):
    return documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page_no", "text"))


_DOCPAGES = "d AS (SELECT doc_id, unnest(range(len(l)))::INT AS page_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {documents}) x)"
_BLANK = r"[\s\x{000b}\x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_trim = lambda x: rf"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
_HAS = lambda c, *words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"

# Cleaning.
query("clean_page_text", "documents", sql=rf"""WITH a AS (SELECT doc_id, translate(regexp_replace(regexp_replace(text, '\r\n|\r|\x{{2028}}|\x{{2029}}', chr(10), 'g'), '\x{{00a0}}', ' ', 'g'), '．，（）：；', '.,():;') AS t FROM {{documents}}),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\n+', chr(10), 'g'), ' +', ' ', 'g') AS t FROM a) SELECT doc_id, md5({_trim("array_to_string(list_transform(string_split(t, chr(10)), lambda x: " + _trim('x') + "), chr(10))")}) AS clean FROM b""")(lambda d: d.select("doc_id", F.md5(T.clean_page_text(F.col("text"))).alias("clean")))
query("clean_cell_text", "documents", sql=r"SELECT doc_id, md5(regexp_replace(text, '[\x{0000}-\x{0020}\x{007f}-\x{00a0}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]', '', 'g')) AS clean FROM {documents}")(lambda d: d.select("doc_id", F.md5(T.clean_cell_text(F.col("text"))).alias("clean")))
query("squeeze_text", "documents", sql=r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')) AS clean FROM {documents}")(lambda d: d.select("doc_id", F.md5(T.squeeze_text(F.col("text"))).alias("clean")))
query("clean_criteria_name", "part", sql="SELECT p_partkey, p_name AS name FROM {part}")(lambda p: p.select("p_partkey", T.clean_criteria_name(F.concat(F.lit("(12) ★"), "p_name", F.lit(" （"), F.col("p_size").cast("string"), F.lit("分）"))).alias("name")))
_NAMED = _trim("regexp_replace(" + _trim("text") + ", '^[:：]+', '')")
_CUT = _trim("split_part(" + _trim(f"split_part({_NAMED}, 'the', 1)") + ", ' of', 1)")
_BARE = rf"regexp_replace(regexp_replace({_CUT}, '^[()（）\[\]【】〔〕]+|[()（）\[\]【】〔〕]+$', '', 'g'), '[\[\]（）()]', '', 'g')"
query("filter_bidder_name", "documents", sql=rf"WITH {_DOCPAGES} SELECT doc_id, page_no, regexp_replace(regexp_replace({_trim("regexp_replace(" + _BARE + ", 'ing$', '')")}, '{_BLANK}+', ' ', 'g'), '^ | $', '', 'g') AS name FROM d")(lambda d: _docpages(d).select("doc_id", "page_no", T.filter_bidder_name(F.col("text"), ["the", " of"], ["ing"]).alias("name")))
query("valid_company_name", "documents", sql=f"WITH {_DOCPAGES} SELECT doc_id, page_no, length(text) > 5 AND {_HAS('text', 'th', 'er')} AND NOT {_HAS('text', 'qu', 'ing')} AS valid FROM d")(lambda d: _docpages(d).select("doc_id", "page_no", T.valid_company_name(F.col("text"), ["th", "er"], ["qu", "ing"]).alias("valid")))
query("garbled_name", "documents", sql=rf"WITH {_DOCPAGES}, n AS (SELECT *, length(text) AS n, length(regexp_replace(text, '[a-z ]', '', 'g')) AS noise FROM d) SELECT doc_id, page_no, n < 6 OR regexp_matches(text, '[\[\]()（）【】〔〕]') OR noise * 5 > n OR noise > greatest(1, n // 6) AS garbled FROM n")(lambda d: _docpages(d).select("doc_id", "page_no", T.garbled_name(F.col("text"), "[a-z ]").alias("garbled")))
query("validate_name_update", "customer", sql="SELECT c_custkey, CASE WHEN length(trim(c_name)) < 2 THEN '名称过短' WHEN NOT contains(c_name, '7') THEN '名称缺少公司关键词' END AS reason FROM {customer}")(lambda c: c.select("c_custkey", T.name_update_reason(F.col("c_name"), ["7"]).alias("reason")))
query("score_in_text", "part", sql="SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size + 0.5e0 WHEN 1 THEN cast(p_size AS double) ELSE 0.0e0 END AS score FROM {part}")(lambda p: p.select("p_partkey", T.score_in_text(F.concat("p_name", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" ("), (F.col("p_size") + 0.5).cast("string"), F.lit(" 分)"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit(" 满分 "), F.col("p_size").cast("string"))).otherwise(""))).alias("score")))
query("row_to_rule_text", "supplier", sql="SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN s_name ELSE concat(s_name, ' ', cast(s_nationkey AS string)) END AS t FROM {supplier}")(lambda s: s.select("s_suppkey", T.row_to_rule_text(F.array(F.concat(F.lit(" "), "s_name"), F.lit("  "), F.when(F.col("s_nationkey") % 2 == 1, F.col("s_nationkey").cast("string")))).alias("t")))
query("str_to_float", "lineitem", sql="SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE cast(l_extendedprice AS decimal(18,2)) END::DOUBLE AS v FROM {lineitem}")(lambda x: x.select("l_orderkey", "l_linenumber", N.str_to_float(F.when(F.col("l_linenumber") == 7, ",").otherwise(F.format_number("l_extendedprice", 2))).alias("v")))


def _numeral(n):
    """An integer below 100 million as Chinese numerals with units."""
    digit = lambda x: F.translate(x.cast("string"), "123456789", "壹贰叁肆伍陆柒捌玖")
    place = lambda x, unit: F.when(x > 0, F.concat(digit(x), F.lit(unit))).otherwise("")
    part = lambda m: F.concat(place(F.floor(m / 1000), "仟"), place(F.floor(m / 100) % 10, "佰"), place(F.floor(m / 10) % 10, "拾"), place(m % 10, ""))
    high, low = F.floor(n / 10_000), n % 10_000
    return F.concat(F.when(high > 0, F.concat(part(high), F.lit("万"))).otherwise(""), part(low), F.lit("元整"))


query("cn_number", "lineitem", sql="SELECT l_orderkey, l_linenumber, cast(cast(floor(l_extendedprice * 100) AS bigint) AS double) AS v FROM {lineitem}")(lambda x: x.select("l_orderkey", "l_linenumber", N.cn_number(_numeral(F.floor(F.col("l_extendedprice") * 100).cast("long"))).alias("v")))
query("price_confidence", "lineitem", sql="SELECT l_orderkey, l_linenumber, cast(round(cast(CASE WHEN l_linenumber % 2 = 0 THEN 50 ELSE 10 END + CASE WHEN l_returnflag = 'R' THEN 40 WHEN l_returnflag = 'A' THEN 20 ELSE 0 END + least(l_extendedprice * 100 / 1000000, 5.0) AS decimal(28,6)), 2) AS double) AS c FROM {lineitem}")(lambda x: x.select("l_orderkey", "l_linenumber", N.price_confidence(F.col("l_extendedprice") * 100, F.col("l_linenumber") % 2 == 0, F.col("l_returnflag") == "R", F.col("l_returnflag") == "A").alias("c")))

# Pages.
_SECT = {"summary": ["the "], "price_part": ["ing"], "bond": ["or", "qu"], "name_anchor": ["with"]}
query("tag_sections", "documents", sql=f"WITH {_DOCPAGES} SELECT doc_id, page_no, {', '.join(_HAS('text', *w) + ' AS ' + t for t, w in _SECT.items())} FROM d")(lambda d: pages.tag_sections(_docpages(d), _SECT).drop("text"))
query("count_keywords", "documents", sql=f"WITH {_DOCPAGES} SELECT doc_id, page_no, length(text)::INT AS text_length, ((length(text) - length(replace(text, 'th', ''))) // 2)::INT AS n_0, ((length(text) - length(replace(text, 'ing', ''))) // 3)::INT AS n_1, (doc_id + page_no) % 3 = 0 AS has_tables FROM d WHERE {_HAS('text', 'with', 'from')}")(lambda d: pages.count_keywords(_docpages(d), ["with", "from"], ["th", "ing"], _docpages(d).where("(doc_id + page_no) % 3 = 0").select("doc_id", F.col("page_no").alias("page"))))
query("keyword_page_summary", "documents", sql=f"WITH {_DOCPAGES} SELECT doc_id, string_agg(page_no::VARCHAR, ',' ORDER BY page_no) AS pages FROM d WHERE {_HAS('text', 'with', 'from')} GROUP BY 1")(lambda d: pages.keyword_page_summary(_docpages(d), ["with", "from"]))
_BLANKED = "CASE WHEN page_no % 5 = 3 THEN concat(chr(9), chr(12288), chr(160)) WHEN page_no % 5 = 4 THEN concat(chr(11), text, chr(12288)) ELSE text END"


def _blanked(documents):
    """Pages some of which are nothing but white space of several kinds, or have it at their ends."""
    no = F.col("page_no") % 5
    return _docpages(documents).withColumn("text", F.when(no == 3, "\t\u3000\u00a0").when(no == 4, F.concat(F.lit("\x0b"), "text", F.lit("\u3000"))).otherwise(F.col("text")))


query("page_quality", "documents", sql=f"WITH {_DOCPAGES}, n AS (SELECT doc_id, page_no, length({_trim(_BLANKED)}) AS n FROM d) SELECT doc_id, page_no, n = 0 AND doc_id % 7 <> 0 AS failed, n < 20 AS needs_ocr, sum(n) OVER (PARTITION BY doc_id) AS doc_chars, sum(n) OVER (PARTITION BY doc_id) < 100 AS doc_scanned FROM n")(lambda d: pages.page_quality(_blanked(d), _docpages(d).where("doc_id % 7 = 0").select("doc_id", "page_no")))
query("page_with_next", "conversations", sql="SELECT conv_id AS doc_id, turn AS page_no, md5(concat_ws(chr(10), text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn))) AS context FROM {conversations}")(lambda c: pages.page_with_next(_turns(c)).select("doc_id", "page_no", F.md5("context").alias("context")))
query("page_set_union", "documents", sql=f"WITH {_DOCPAGES}, t AS (SELECT *, {_HAS('text', 'with')} AS t FROM d), u AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY page_no), false) AS b FROM t) SELECT doc_id, page_no FROM u WHERE t OR b")(lambda d: pages.page_set_union(pages.tag_sections(_docpages(d), {"t": ["with"]}), "t").select("doc_id", "page_no"))
query("leading_pages", "documents", sql=f"WITH {_DOCPAGES} SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no) AS text FROM d WHERE page_no < 3 GROUP BY 1")(lambda d: pages.leading_pages(_docpages(d)))


def _turns(conversations):
    return conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")


def _pairs(turns):
    docs = turns.select("doc_id").distinct()
    words = F.array(F.struct(F.lit("thereof nt").alias("item"), F.lit("zz,").alias("description")), F.struct(F.lit("with").alias("item"), F.lit("from x").alias("description")))
    return docs.select("doc_id", F.posexplode(words).alias("k", "w")).select((F.col("doc_id") * 10 + F.col("k")).alias("pair_id"), "doc_id", "w.*")


_REL = """p AS (SELECT DISTINCT conv_id AS doc_id, k, conv_id * 10 + k AS pair_id FROM {conversations}, (SELECT 0 AS k UNION ALL SELECT 1) ks), l AS (SELECT conv_id AS doc_id, max(turn) AS last FROM {conversations} GROUP BY 1),
    h AS (SELECT pair_id, p.doc_id, turn FROM p JOIN {conversations} c ON c.conv_id = p.doc_id WHERE CASE k WHEN 0 THEN contains(lower(text), 'thereof') OR contains(lower(text), 'nt') OR contains(lower(text), 'zz,') ELSE contains(lower(text), 'with') OR contains(lower(text), 'from') END),
    w AS (SELECT DISTINCT pair_id, h.doc_id, turn + j AS page_no FROM h JOIN l ON l.doc_id = h.doc_id, (SELECT unnest(range(3)) AS j) js WHERE turn + j <= last),
    r AS (SELECT * FROM w UNION ALL SELECT pair_id, p.doc_id, j FROM p JOIN l ON l.doc_id = p.doc_id, (SELECT unnest(range(3)) AS j) js WHERE j <= last AND pair_id NOT IN (SELECT pair_id FROM h))"""
query("relevant_pages", "conversations", sql=f"WITH {_REL} SELECT pair_id, doc_id, page_no FROM r")(lambda c: pages.relevant_pages(_pairs(_turns(c)), _turns(c)))
query("page_ranges", "conversations", sql=f"""WITH {_REL}, g AS (SELECT pair_id, page_no, text, page_no - row_number() OVER (PARTITION BY pair_id ORDER BY page_no) AS run FROM r JOIN {{conversations}} c ON c.conv_id = r.doc_id AND c.turn = r.page_no),
    o AS (SELECT pair_id, min(page_no) AS a, concat('--- Pages ', min(page_no) + 1, '-', max(page_no) + 1, ' ---', chr(10), string_agg(text, chr(10) ORDER BY page_no)) AS part FROM g GROUP BY pair_id, run) SELECT pair_id, md5(string_agg(part, chr(10) || chr(10) ORDER BY a)) AS context FROM o GROUP BY 1""")(lambda c: pages.page_ranges(pages.relevant_pages(_pairs(_turns(c)), _turns(c)), _turns(c)).select("pair_id", F.md5("context").alias("context")))
query("slice_scoring_section", "documents", sql=None)(lambda d: sections.slice_scoring_section(d, ["with", "from"], ["there"], ["zz"], "ing"))
query("build_prompt", "documents", sql="""SELECT doc_id, md5('角色: 专业的评标专家' || chr(10) || '评分标准' || chr(10) || '名称: a' || chr(10) || '描述: ' || CASE WHEN doc_id % 2 = 0 THEN 'N/A' ELSE lang END || chr(10) || '满分: 5' || chr(10) || '投标文件相关内容:' || chr(10) || '---' || chr(10) || substr(text, 1, 8000)
    || CASE WHEN length(text) > 8000 THEN chr(10) || '... (内容已截断)' ELSE '' END || chr(10) || '---' || chr(10) || '给出 0 到 5 之间的分数，只输出 JSON: {"score": 分数, "reason": "理由"}' || chr(10)) AS prompt FROM {documents}""")(lambda d: d.select("doc_id", F.md5(A.build_prompt(F.lit("a"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")), F.lit(5), F.col("text"))).alias("prompt")))

# Answers.
_K = "cast(json_extract(props, '$.k') AS double)"


def _answers(events):
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, F.concat(F.lit('思考\n```json\n{"score": '), k, F.lit(', "reason": "好"}\n```'))).when(kind == 1, F.concat(F.lit("得"), k, F.lit("分"))).when(kind == 2, F.concat(F.lit('x {"score": "'), k, F.lit('"} y'))).when(kind == 3, "{broken}").otherwise("Error: timeout")
    return events.select("event_id", text.alias("response"))


query("parse_score_answer", "events", sql=f"SELECT event_id, CASE WHEN event_id % 5 < 2 THEN least({_K}, 50.0) ELSE 0.0 END::DOUBLE AS score, CASE event_id % 5 WHEN 0 THEN '好' WHEN 2 THEN '未提供理由。' END AS reason FROM {{events}}")(lambda e: _answers(e).select("event_id", A.parse_score_answer(F.col("response"), F.lit(50)).alias("a")).select("event_id", "a.score", F.when(F.col("event_id") % 5 == 0, F.col("a.reason")).when(F.col("event_id") % 5 == 2, F.col("a.reason")).alias("reason")))
query("parse_price_answer", "supplier", sql="SELECT s_suppkey, s_name AS bidder, cast(s_nationkey AS double) AS score FROM {supplier} UNION ALL SELECT s_suppkey, 'other', 1.5e0 FROM {supplier} WHERE s_suppkey % 3 <> 2")(lambda s: s.select("s_suppkey", F.explode(A.parse_price_answer(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('{"'), "s_name", F.lit('": '), F.col("s_nationkey").cast("string"), F.lit(', "other": "1.5", "bad": "x"}'))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit('结果 {"'), "s_name", F.lit('": '), F.col("s_nationkey").cast("string"), F.lit('} 和 {"other": 1.5}'))).otherwise(F.concat(F.lit('"'), "s_name", F.lit('": '), F.col("s_nationkey").cast("string"))))).alias("bidder", "score")))
query("parse_formula", "part", sql="SELECT p_partkey, concat('得分=', p_size) AS formula, concat('x', p_brand) AS definition, cast(p_size AS double) AS full_score FROM {part}")(lambda p: p.select("p_partkey", A.parse_formula(F.concat(F.lit("1. 价格计算公式: 得分="), F.col("p_size").cast("string"), F.lit("\n2. 变量定义: x"), "p_brand", F.lit("\n满分"), F.col("p_size").cast("string"))).alias("f")).select("p_partkey", "f.formula", "f.definition", "f.full_score"))
query("extract_formula", "part", sql="SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat('价格分=', p_size) ELSE substr(p_name, 1, 200) END AS from_answer, CASE WHEN p_size % 2 = 0 THEN concat('价格分=', p_size) ELSE '' END AS from_standard FROM {part}")(lambda p: p.withColumn("t", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("说明\n价格分="), F.col("p_size").cast("string"))).otherwise(F.col("p_name"))).select("p_partkey", A.formula_from_answer(F.col("t")).alias("from_answer"), A.formula_from_standard(F.col("t")).alias("from_standard")))


# Prices: an order is a document, its lines are pages.
def _pricepages(lineitem):
    from pyspark.sql import Window

    no = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")) - 1
    price = F.format_number("l_extendedprice", 2)
    small = F.when(no % 4 == 0, "小写金额：￥").when(no % 4 == 1, "投标报价: ￥ ").when(no % 4 == 2, "总报价 ￥").otherwise("人民币（小写）：￥")
    total = F.when(no % 3 == 0, "合计: ").when(no % 3 == 1, "总计 ").otherwise("投标报价：")
    text = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("投标一览表\n"), small, price, F.lit("\n其他"))).when(F.col("l_returnflag") == "A", F.concat(F.lit("说明\n"), total, price)).otherwise(F.concat(F.lit("无 "), price))
    bond = F.when(F.col("l_tax") == 0, F.concat(F.lit("\n投标保证金：￥"), F.format_number(F.col("l_quantity") * 100, 2))).otherwise("")
    return lineitem.select(F.col("l_orderkey").alias("doc_id"), no.alias("page_no"), F.concat(text, bond).alias("text"))


_PRICEPAGES = "o AS (SELECT l_orderkey AS doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1)::INT AS page_no, l_returnflag AS flag, l_extendedprice AS price, l_tax AS tax, l_quantity AS q FROM {lineitem})"
_CANDS = f"""{_PRICEPAGES}, c AS (SELECT doc_id, page_no, 0 AS source_rank, price AS value, 100.0e0 AS confidence FROM o WHERE flag = 'R' AND price > 1000
    UNION ALL SELECT doc_id, page_no, 1, price, cast(round(cast(50 + least(price / 1000000, 5.0) AS decimal(28,6)), 2) AS double) FROM o WHERE flag = 'A' AND tax <> 0)"""
query("summary_page_prices", "lineitem", sql=f"WITH {_CANDS} SELECT doc_id, page_no, value, confidence FROM c WHERE source_rank = 0")(lambda x: prices.union_candidates(_pricepages(x), sources=[0]).select("doc_id", "page_no", "value", "confidence"))
query("keyword_prices", "lineitem", sql=f"WITH {_CANDS} SELECT doc_id, page_no, value, confidence FROM c WHERE source_rank = 1")(lambda x: prices.union_candidates(_pricepages(x), sources=[1]).select("doc_id", "page_no", "value", "confidence"))
_EVERY = "e AS (SELECT * FROM c UNION ALL SELECT doc_id, page_no, 2, price, cast(round(cast(50 + least(price / 1000000, 5.0) AS decimal(28,6)), 2) AS double) FROM o WHERE flag = 'R' AND tax <> 0)"
query("union_candidates", "lineitem", sql=f"WITH {_CANDS}, {_EVERY} SELECT doc_id, page_no, source_rank, value, confidence, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, source_rank) AS seq FROM e")(lambda x: prices.union_candidates(_pricepages(x), include_general=True).select("doc_id", "page_no", "source_rank", "value", "confidence", "seq"))
query("general_prices", "lineitem", sql=f"WITH {_PRICEPAGES} SELECT doc_id, page_no, price AS value FROM o WHERE flag = 'R' AND tax <> 0")(lambda x: prices.union_candidates(_pricepages(x), sources=[2]).select("doc_id", "page_no", "value"))
query("dedupe_prices", "lineitem", sql=f"WITH {_CANDS}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY page_no, source_rank) AS n FROM c) SELECT doc_id, page_no, value FROM s WHERE n = 1")(lambda x: prices.dedupe_prices(prices.union_candidates(_pricepages(x))).select("doc_id", "page_no", "value"))
query("top_candidates", "lineitem", sql=f"WITH {_CANDS}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, value DESC, page_no, source_rank) AS place FROM c) SELECT doc_id, value, place FROM s WHERE place <= 2")(lambda x: prices.top_candidates(prices.union_candidates(_pricepages(x)), 2).select("doc_id", "value", "place"))
_BEST = "b AS (SELECT doc_id, coalesce(max(value) FILTER (source_rank = 0), max(value)) AS price FROM c GROUP BY 1)"
query("select_best_price", "lineitem", sql=f"WITH {_CANDS}, {_BEST} SELECT * FROM b")(lambda x: prices.select_best_price(prices.dedupe_prices(prices.union_candidates(_pricepages(x))), _pricepages(x)))
query("extract_bid_price", "lineitem", sql=f"WITH {_CANDS}, {_BEST}, n AS (SELECT doc_id, count(DISTINCT value) AS n FROM c GROUP BY 1) SELECT d.doc_id, price, price IS NOT NULL AS price_extracted, coalesce(n, 0) AS n_candidates, (d.doc_id % 2 + 1)::INT AS price_extraction_attempts FROM (SELECT DISTINCT doc_id FROM o) d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id")(lambda x: prices.extract_bid_price(_pricepages(x), attempts=x.select(F.col("l_orderkey").alias("doc_id")).distinct().where("doc_id % 2 = 1").withColumn("price_extraction_attempts", F.lit(1))))
query("total_price_context", "lineitem", sql="SELECT l_orderkey, l_linenumber, l_returnflag = 'R' OR l_extendedprice > 10000 AS total FROM {lineitem}")(lambda x: x.select("l_orderkey", "l_linenumber", prices.total_price_context(F.concat(F.when(F.col("l_returnflag") == "R", "合计 ").otherwise("无 "), F.when(F.col("l_linenumber") % 2 == 0, F.format_number("l_extendedprice", 2)).otherwise(F.call_function("format_number", F.col("l_extendedprice"), F.lit("#0.0###")))), F.col("l_extendedprice")).alias("total")))


def _bondpages(lineitem):
    """Figures, numerals with blanks, other pages' words, and totals beside them."""
    rows = _pricepages(lineitem).drop("text")
    q, kind = F.col("page_no") + 1 + F.col("doc_id") % 40, (F.col("doc_id") + F.col("page_no")) % 5
    figure = F.concat(F.lit("履约保证金：￥"), F.format_number(q * 100, 2))
    numerals = F.concat(F.lit("投标保证金： "), F.regexp_replace(_numeral(q), "元整", ""), F.lit(" 万元"))
    other = F.concat(F.lit("说明\n押金: "), q.cast("string"), F.lit(" 和 押金: 9"))
    total = F.concat(F.lit("合计 投标保证金: "), q.cast("string"))
    return rows.withColumn("text", F.when(kind == 0, figure).when(kind == 1, numerals).when(kind == 2, other).when(kind == 3, total).otherwise("说明 押金: 0 和 押金: 7"))


query("extract_bonds", "lineitem", sql=f"""WITH {_PRICEPAGES}, b AS (SELECT doc_id, page_no, (page_no + 1 + doc_id % 40)::DOUBLE AS q, (doc_id + page_no) % 5 AS kind FROM o)
    SELECT doc_id, page_no, CASE kind WHEN 0 THEN q * 100 WHEN 1 THEN q * 10000 ELSE q END AS value, CASE kind WHEN 0 THEN 80.0e0 WHEN 1 THEN 70.0e0 ELSE 60.0e0 END AS confidence, CASE kind WHEN 0 THEN '保证金阿拉伯数字' WHEN 1 THEN '保证金中文大写' ELSE '保证金窗口匹配(押金)' END AS reason FROM b WHERE kind < 3""")(lambda x: prices.extract_bonds(_bondpages(x)))


# Names: a supplier is a document of four pages, with a wording for each pattern.
def _namepages(supplier):
    name = F.concat(F.lit("山东"), F.col("s_suppkey").cast("string"), F.lit("号创杰装备有限公司"))
    kind, v = F.col("s_suppkey") % 3, F.floor(F.col("s_suppkey") / 3) % 5
    said = lambda before: F.concat(F.lit(before), name, F.lit(" 地址 x"))
    first = F.when(v == 0, said("投 标 人：")).when(v == 1, said("投标单位名称:")).when(v == 2, said("供 应 商 名 称 ")).when(v == 3, F.concat(F.lit("  "), name, F.lit(" "))).otherwise(said("致："))
    there = lambda before: F.concat(F.lit(before), name, F.lit(" 承担"))
    second = F.when(v == 0, there("投标函\n投标单位： ")).when(v == 1, there("资格审查\n供应商 ")).when(v == 2, there("授权委托书\n由 ")).when(v == 3, F.concat(F.lit("开标一览表\n"), name)).otherwise(there("制造商名称："))
    return supplier.select(F.col("s_suppkey").alias("doc_id"), F.posexplode(F.array(F.when(kind == 0, first).otherwise("封面"), F.lit("正文"), F.lit("正文"), F.when(kind == 1, second).otherwise("目录"))).alias("page_no", "text"))


_NAME = "concat('山东', s_suppkey, '号创杰装备有限公司')"
_SHORT = f"CASE WHEN s_suppkey % 3 = 0 AND s_suppkey // 3 % 5 = 4 THEN replace({_NAME}, '公司', '') ELSE {_NAME} END"
query("name_candidates", "supplier", sql=f"SELECT s_suppkey AS doc_id, {_SHORT} AS name, true AS valid, false AS garbled FROM {{supplier}} WHERE s_suppkey % 3 = 0")(lambda s: names.name_candidates(_namepages(s)).drop("seq"))
query("section_names", "supplier", sql=f"SELECT s_suppkey AS doc_id, {_NAME} AS name FROM {{supplier}} WHERE s_suppkey % 3 = 1")(lambda s: names.section_names(_namepages(s)))


def _nametables(supplier):
    row = lambda a, b: F.array(a, b)
    name = F.concat(F.lit("山东"), F.col("s_suppkey").cast("string"), F.lit("号创杰装备有限公司"))
    data = F.array(row(F.lit("序号"), F.lit("供应商名称")), row(F.lit("1"), F.lit("无")), row(F.lit("2"), F.when(F.col("s_suppkey") % 3 == 2, name).otherwise("空")))
    return supplier.select(F.col("s_suppkey").alias("doc_id"), F.lit(1).alias("table_no"), data[0].alias("headers"), data.alias("data"))


query("table_names", "supplier", sql=f"SELECT s_suppkey AS doc_id, {_NAME} AS name FROM {{supplier}} WHERE s_suppkey % 3 = 2")(lambda s: names.table_names(_nametables(s)))


def _picked(s):
    regex = names.name_candidates(_namepages(s)).select("doc_id", F.lit("regex").alias("source"), "seq", "name")
    section = names.section_names(_namepages(s)).select("doc_id", F.lit("section").alias("source"), F.lit(0).alias("seq"), "name")
    table = names.table_names(_nametables(s)).select("doc_id", F.lit("table").alias("source"), F.lit(0).alias("seq"), "name")
    return names.pick_bidder_name(regex.unionByName(section).unionByName(table))


query("pick_bidder_name", "supplier", sql=f"SELECT s_suppkey AS doc_id, {_SHORT} AS name, CASE s_suppkey % 3 WHEN 0 THEN 'regex' WHEN 1 THEN 'section' ELSE 'table' END AS source FROM {{supplier}}")(_picked)


# Tables: an order's lines are fragments, one a page.
def _fragments(lineitem):
    one = lineitem.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")).agg(F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"), F.min("l_quantity").cast("int").alias("q"))
    head = F.array(F.col("f"), F.col("s"), F.lit("评价项目"))
    body = F.array(F.when(F.col("q") % 3 == 0, "\t").otherwise(F.col("q").cast("string")), F.lit(""), F.concat(F.lit(" a "), F.col("page").cast("string")))
    return one.select("doc_id", "page", F.lit(0).alias("table_index"), (F.col("q") % 2).alias("cols"), head.alias("headers"), F.array(head, body).alias("data"))


_FRAGS = """f AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, min(l_returnflag) AS f, min(l_linestatus) AS s, cast(min(l_quantity) AS int) AS q FROM {lineitem} GROUP BY 1, 2),
    g AS (SELECT *, lag(page) OVER w AS pp, lag(q) OVER w AS pq, lag(f) OVER w AS pf, lag(s) OVER w AS ps FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
    h AS (SELECT *, CASE WHEN page = pp + 1 AND q % 2 = pq % 2 THEN 0 ELSE 1 END AS fresh FROM g),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY page) AS island FROM h)"""
query("merge_page_tables", "lineitem", sql=f"WITH {_FRAGS} SELECT doc_id, island AS table_no, min(page) AS start_page, max(page) AS end_page, count(*)::INT AS page_count, (count(*) + 1)::INT AS total_rows, concat(arg_min(f, page), arg_min(s, page), '评价项目') AS headers, concat(arg_min(f, page), '|', arg_min(s, page), '|评价项目|', string_agg(concat(CASE WHEN q % 3 = 0 THEN '' ELSE q::VARCHAR END, '||a', page), '|' ORDER BY page)) AS data FROM i GROUP BY 1, 2")(lambda x: tables.merge_page_tables(_fragments(x)).withColumn("headers", F.array_join("headers", "")).withColumn("data", F.array_join(F.flatten("data"), "|")))
query("header_similarity", "lineitem", sql=f"WITH {_FRAGS} SELECT doc_id, page, ((f = pf)::INT + (s = ps)::INT + 1) / 3.0e0 AS similarity FROM g WHERE pf IS NOT NULL")(lambda x: _similar(x, tables.header_similarity, "headers"))
query("content_similarity", "lineitem", sql=f"WITH {_FRAGS} SELECT doc_id, page, CASE WHEN (q % 3 = 0) = (pq % 3 = 0) THEN 1.0e0 ELSE 1 - 0.5e0 / 2.5e0 END AS similarity FROM g WHERE pf IS NOT NULL")(lambda x: _similar(x, tables.content_similarity, "data"))


def _similar(lineitem, measure, column):
    from pyspark.sql import Window

    prev = F.lag(column).over(Window.partitionBy("doc_id").orderBy("page"))
    return _fragments(lineitem).withColumn("p", prev).where("p is not null").select("doc_id", "page", measure(F.col("p"), F.col(column)).alias("similarity"))


query("filter_rule_tables", "lineitem", sql=f"WITH {_FRAGS} SELECT doc_id, page FROM f WHERE f = 'R'")(lambda x: tables.filter_rule_tables(_fragments(x), ["评价 项目".replace(" ", ""), "R"]).select("doc_id", "page"))
query("table_rows", "lineitem", sql=f"WITH {_FRAGS} SELECT doc_id, page, 0 AS col_no, f AS header, CASE WHEN q % 3 = 0 THEN '' ELSE q::VARCHAR END AS cell FROM f UNION ALL SELECT doc_id, page, 1, s, '' FROM f UNION ALL SELECT doc_id, page, 2, '评价项目', concat('a', page) FROM f")(lambda x: tables.table_rows(_fragments(x).withColumn("table_no", F.col("page"))).select("doc_id", F.col("table_no").alias("page"), "col_no", "header", "cell"))


# Rule rows: fifty parts are a document's rows.
def _rulerows(part):
    price = F.col("p_partkey") % 50 == 48
    cell = F.when(price, "价格分").when(F.col("p_size") % 4 == 0, F.concat(F.lit("项目"), F.col("p_partkey").cast("string"))).when(F.col("p_size") % 4 == 1, "\u3000\t")
    points = F.when(price, 40).otherwise(F.col("p_size") % 20 + 1)
    return part.select(F.floor(F.col("p_partkey") / 50).alias("doc"), F.col("p_partkey").alias("row_no"), cell.alias("project_cell"), F.col("p_name").alias("detail"), F.concat(points.cast("string"), F.lit("分")).alias("standard"))


_ROWS = """r AS (SELECT p_partkey // 50 AS doc, p_partkey AS row_no, p_name, p_partkey % 50 = 48 AS price, p_partkey % 50 = 48 OR p_size % 4 = 0 AS is_parent, CASE WHEN p_partkey % 50 = 48 THEN 40 ELSE p_size % 20 + 1 END AS points FROM {part}),
    n AS (SELECT *, cast(sum(is_parent::INT) OVER (PARTITION BY doc ORDER BY row_no) AS int) AS parent_no FROM r),
    k AS (SELECT *, cast(CASE WHEN NOT is_parent THEN sum((NOT is_parent)::INT) OVER (PARTITION BY doc, parent_no ORDER BY row_no) END AS int) AS child_no, max(price::INT) OVER (PARTITION BY doc, parent_no) AS under FROM n WHERE parent_no > 0),
    u AS (SELECT doc, parent_no, child_no, CASE WHEN price THEN '价格分' WHEN is_parent THEN concat('项目', row_no) ELSE p_name END AS criteria_name, points * 1.0e0 AS max_score, CASE WHEN price THEN p_name ELSE concat(points, '分') END AS description, price AS is_price_criteria FROM k WHERE is_parent OR under = 0)"""
query("number_rules", "part", sql=f"WITH {_ROWS} SELECT doc, row_no, parent_no, child_no FROM k")(lambda p: rules.number_rules(_rulerows(p)).select("doc", "row_no", "parent_no", "child_no"))
query("rules_from_rows", "part", sql=f"WITH {_ROWS} SELECT * FROM u")(lambda p: rules.rules_from_rows(_rulerows(p)))


def _numberings(part):
    """Rules of up to 12 levels, in documents of up to 63; parts of every sixth size are a document of their own, so that rules
    hang on what is left above them."""
    k = F.col("p_partkey") % 9
    number = lambda x: F.lpad(x.cast("string"), 3, "0")
    deep = F.concat(F.array(number(F.floor(F.col("p_partkey") / 9) % 7), number(F.floor(k / 5)), number(k)), F.array_repeat(F.lit("001"), 9))
    depth = F.when(k == 0, 1).when(k.isin(1, 5), 2).otherwise(3 + F.col("p_size") % 10)
    doc = F.floor(F.col("p_partkey") / 63) * 2 + F.when(F.col("p_size") % 6 == 0, 1).otherwise(0)
    return part.select(doc.alias("doc"), "p_partkey", F.slice(deep, F.lit(1), depth).alias("numbering"))


query("attach_parent", "part", sql="""WITH n AS (SELECT p_partkey // 63 * 2 + CASE WHEN p_size % 6 = 0 THEN 1 ELSE 0 END AS doc, p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 1 WHEN p_partkey % 9 IN (1, 5) THEN 2 ELSE 3 + p_size % 10 END AS depth,
        concat(lpad((p_partkey // 9 % 7)::VARCHAR, 3, '0'), '.', lpad((p_partkey % 9 // 5)::VARCHAR, 3, '0'), '.', lpad((p_partkey % 9)::VARCHAR, 3, '0'), repeat('.001', 9)) AS deep FROM {part}),
    m AS (SELECT doc, p_partkey, depth, substr(deep, 1, 4 * depth - 1) AS num FROM n)
    SELECT m.doc, m.p_partkey, max(b.num) AS parent FROM m LEFT JOIN m b ON b.doc = m.doc AND b.num < m.num AND b.depth < m.depth GROUP BY 1, 2""")(lambda p: rules.attach_parent(_numberings(p)).select("doc", "p_partkey", F.array_join("parent", ".").alias("parent")))


def _rulelines(part):
    """Two lines that say the same rule, with points that differ by one."""
    name = F.concat(F.lit("评审"), F.when(F.col("p_size") % 2 == 0, "报价").otherwise("服务"))
    line = lambda k, open_, close: F.struct(F.lit(k).alias("line_no"), F.concat(name, F.lit(open_), (F.col("p_size") + k).cast("string"), F.lit(f"分{close}")).alias("line"))
    return part.select(F.col("p_partkey").alias("doc"), F.explode(F.array(line(0, "(", ")"), line(1, " ", ""))).alias("x")).select("doc", "x.*")


query("rules_from_text", "part", sql="SELECT p_partkey AS doc, 2 AS nth, concat('评审', CASE WHEN p_size % 2 = 0 THEN '报价' ELSE '服务' END) AS criteria_name, (p_size + 1)::DOUBLE AS max_score, concat('评审', CASE WHEN p_size % 2 = 0 THEN '报价' ELSE '服务' END) AS description, p_size % 2 = 0 AS is_price_criteria FROM {part}")(lambda p: rules.rules_from_text(_rulelines(p)))
#: Its greedy fold in order has no SQL that is fast on whole tables; tests compare it with brute force.
query("dedupe_similar_rules", "part")(lambda p: rules.dedupe_similar_rules(p.select(F.floor(F.col("p_partkey") / 20).alias("doc"), F.col("p_partkey").alias("nth"), F.col("p_name").alias("criteria_name"), F.col("p_size").cast("double").alias("max_score"))))
query("price_rule_from_text", "part", sql="SELECT p_partkey AS doc, 1 AS nth, CASE WHEN p_size > 10 THEN '价格分' ELSE 'old' END AS criteria_name, CASE WHEN p_size > 10 THEN p_size ELSE 5 END::DOUBLE AS max_score, CASE WHEN p_size > 10 THEN '评标基准价为最低价，价格分' ELSE '' END AS description, true AS is_price_criteria FROM {part}")(lambda p: rules.price_rule_from_text(p.select(F.col("p_partkey").alias("doc"), F.concat(F.lit("评标基准价为最低价，价格分："), F.col("p_size").cast("string"), F.lit("分")).alias("text")), p.select(F.col("p_partkey").alias("doc"), F.lit(1).alias("nth"), F.lit("old").alias("criteria_name"), F.lit(5.0).alias("max_score"), F.lit("").alias("description"), F.lit(True).alias("is_price_criteria"))))
_DEFAULTS = " UNION ALL ".join(f"SELECT {n} AS n, '{name}' AS name, {top}.0e0 AS top, '{text}' AS said, {str(flag).lower()} AS flag" for n, name, top, text, flag, _ in rules.DEFAULTS)
query("extract_rules", "part", sql=f"""WITH {_ROWS}, g AS (SELECT doc, parent_no, max(max_score) FILTER (child_no IS NULL) AS m, sum(max_score) FILTER (child_no IS NOT NULL) AS s FROM u WHERE NOT is_price_criteria GROUP BY 1, 2), t AS (SELECT *, CASE WHEN abs(m - s) > 0.1 THEN s ELSE m END AS top FROM g),
    o AS (SELECT doc, sum(top) AS others FROM t GROUP BY 1), p AS (SELECT doc, arg_max(max_score, parent_no) AS price FROM u WHERE is_price_criteria GROUP BY 1),
    f AS (SELECT d.doc, CASE WHEN abs(others + coalesce(price, 0) - 100) > 0.1 AND price > 30 AND others > 0 THEN (100 - price) / others ELSE 1.0e0 END AS f FROM (SELECT DISTINCT doc FROM u) d LEFT JOIN o ON o.doc = d.doc LEFT JOIN p ON p.doc = d.doc)
    SELECT u.doc, u.parent_no, u.child_no, replace(criteria_name, ' ', '') AS criteria_name, cast(round(CASE WHEN is_price_criteria THEN max_score WHEN child_no IS NULL THEN top * f ELSE max_score * f END * 1000) AS bigint) AS max_score, replace(description, ' ', '') AS description, is_price_criteria FROM u JOIN f ON f.doc = u.doc LEFT JOIN t ON t.doc = u.doc AND t.parent_no = u.parent_no WHERE u.doc % 7 <> 3
    UNION ALL SELECT doc, n, NULL, name, cast(round(top * 1000 * CASE WHEN flag THEN 1 ELSE 60.0e0 / (31 + doc % 20) END) AS bigint), said, flag FROM (SELECT DISTINCT p_partkey // 50 AS doc FROM {{part}}) d CROSS JOIN (SELECT 1 AS n, '技术方案水平' AS name, 30.0e0 AS top, '技术方案水平' AS said, false AS flag UNION ALL SELECT 2, '售后服务承诺', NULL, '售后服务承诺', false UNION ALL SELECT 3, '价格分', 40, '价格分计算', true) x WHERE doc % 14 = 3 AND n <> 2
    UNION ALL SELECT doc, 2, NULL, '售后服务承诺', cast(round((doc % 20 + 1) * 1000 * 60.0e0 / (31 + doc % 20)) AS bigint), '售后服务承诺', false FROM (SELECT DISTINCT p_partkey // 50 AS doc FROM {{part}}) d WHERE doc % 14 = 3
    UNION ALL SELECT doc, n, NULL, name, cast(top * 1000 AS bigint), said, flag FROM (SELECT DISTINCT p_partkey // 50 AS doc FROM {{part}}) d CROSS JOIN ({_DEFAULTS}) x WHERE doc % 14 <> 3 AND (doc % 7 = 3 OR doc NOT IN (SELECT doc FROM u))""")(lambda p: flows.extract_rules(_rulefragments(p), _ruletexts(p)).withColumn("max_score", F.round(F.col("max_score") * 1000).cast("long")))


def _ruletexts(part):
    """A text for each document; half of those without a rule table state rules, some of these under no title."""
    doc = part.select(F.floor(F.col("p_partkey") / 50).alias("doc_id")).distinct()
    title = F.when(F.col("doc_id") % 28 == 3, "评分标准\n").otherwise("")
    rules_ = F.concat(title, F.lit("技术方案水平(30分)\n售后服务承诺 "), (F.col("doc_id") % 20 + 1).cast("string"), F.lit("分\n价格分 40分\n"))
    return doc.withColumn("text", F.when(F.col("doc_id") % 7 != 3, "评分标准\n另有说明(50分)").when(F.col("doc_id") % 14 == 3, rules_).otherwise("没有规则"))


def _rulefragments(part):
    """A table for each document of fifty rows, a seventh of which have another header."""
    of = _rulerows(part).groupBy(F.col("doc").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("row_no", "project_cell", "detail", "standard"))).alias("all"))
    head = F.array(F.when(F.col("doc_id") % 7 == 3, "其他").otherwise("评价 项目"), F.lit("内容"), F.lit("评价标准"))
    rows = F.transform("all", lambda x: F.array(F.coalesce(x["project_cell"], F.lit("")), x["detail"], x["standard"]))
    return of.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("table_index"), F.lit(3).alias("cols"), head.alias("headers"), F.concat(F.array(head), rows).alias("data"))


# Flows.
def _asked(bids, rules_):
    text = F.array(F.lit("封面"), F.concat(F.lit("方案 "), F.col("id").cast("string")), F.lit("团队"))
    return flows.prompts(bids, rules_, bids.select(F.col("id").alias("doc_id"), F.posexplode(text).alias("page_no", "text")))


@query("score_bids", "v_bids", "v_rules", sql="""WITH kids AS (SELECT * FROM {v_rules} WHERE Child_Item_Name IS NOT NULL AND NOT is_price_criteria), s AS (SELECT b.id AS bid_id, r.*, CASE WHEN r.id % 10 = 4 THEN 0.0e0 ELSE least(qty % 30, Child_max_score) * 1.0e0 END AS score FROM {v_bids} b JOIN kids r ON r.project_id = b.project_id)
    SELECT bid_id, project_id, sum(score) AS total_score, concat('[', string_agg(concat('{"Child_Item_Name":"', Child_Item_Name, '","max_score":', cast(Child_max_score * 1.0e0 AS string), ',"score":', cast(score AS string), ',"reason":"', CASE WHEN id % 10 = 4 THEN '模型调用失败: ' ELSE '未提供理由。' END, '"', CASE WHEN Parent_Item_Name IS NULL THEN '' ELSE concat(',"Parent_Item_Name":"', Parent_Item_Name, '"') END, '}'), ',' ORDER BY id), ']') AS detailed_scores FROM s GROUP BY 1, 2""")
def _(bids, rules_):
    # What is asked and what is answered read the same bids, which are made up once.
    with shuffles_dropped(bids.sparkSession):
        bids = written(bids.select("id", "project_id", "bidder_name", "qty"))
    asked = _asked(bids, rules_)
    kids = rules_.where("Child_Item_Name is not null and not is_price_criteria and id % 10 <> 4").select("project_id", F.col("id").alias("rule_id"))
    said = bids.select("id", "project_id", "qty").join(kids, "project_id").select(F.concat_ws(":", F.col("id").cast("string"), F.col("rule_id").cast("string")).alias("pair_id"), F.concat(F.lit('{"score": '), (F.col("qty") % 30).cast("string"), F.lit("}")).alias("response"))
    return flows.score_bids(asked, said)


# Sources, schemas, streams.
query("load_tables", "v_projects", "v_bids", "v_results", "v_rules", sql="""SELECT 'tender_project' AS name, count(*) AS n, sum(id) AS ids, count(scoring_rules_summary) AS filled FROM {v_projects} UNION ALL SELECT 'bid_document', count(*), sum(id), count(bidder_name) FROM {v_bids} UNION ALL SELECT 'analysis_result', count(*), sum(id), count(total_score) FROM {v_results}
    UNION ALL SELECT 'scoring_rule', count(*), sum(id), count(Child_Item_Name) FROM {v_rules} UNION ALL SELECT 'score_modification_history', count(*), sum(id), count(detailed_scores) FROM {v_results} UNION ALL SELECT 'project_audit_log', count(*), sum(id), count(status) FROM {v_projects}""")(lambda *tables_: _loaded(*tables_))


def _loaded(projects, bids, results, rules_):
    """Tables written without some of their columns and loaded with the fixed schemas."""
    from functools import reduce

    from ..sources.tables import load_tables

    spark, path = projects.sparkSession, _scratch(projects.sparkSession)
    history = results.select("id", F.col("id").alias("result_id"), F.col("detailed_scores").alias("old_scores"))
    log = projects.select("id", F.col("id").alias("project_id"), F.col("status").alias("operation"))
    own = {"tender_project": projects, "bid_document": bids, "analysis_result": results, "scoring_rule": rules_, "score_modification_history": history, "project_audit_log": log}
    filled = {"tender_project": "scoring_rules_summary", "bid_document": "bidder_name", "analysis_result": "total_score", "scoring_rule": "Child_Item_Name", "score_modification_history": "old_scores", "project_audit_log": "operation"}
    for name, df in own.items():
        kinds = {f.name: f.dataType for f in schema(name)}
        df.select(*[F.col(c).cast(kinds[c]) for c in df.columns if c in kinds]).write.parquet(f"{path}/{name}")
    loaded = load_tables(spark, path)
    return reduce(lambda a, b: a.unionByName(b), [loaded[name].agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.count(c).alias("filled")).select(F.lit(name).alias("name"), "n", "ids", "filled") for name, c in filled.items()])


query("load_page_cache", "conversations", sql="SELECT conv_id::VARCHAR AS doc_path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS page_no, text FROM {conversations}")(lambda c: _cached(c))


def _cached(conversations):
    from ..sources.tables import load_page_cache

    spark = conversations.sparkSession
    path = _scratch(spark)
    of = conversations.groupBy(F.col("conv_id").cast("string").alias("file_path")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("all"))
    of.select("file_path", F.transform("all", lambda x: x["text"]).alias("pages_text")).write.json(path)
    return load_page_cache(spark, path, multi_line=False)


query("changed_documents", "orders", sql="SELECT o_orderkey::VARCHAR AS path FROM {orders} WHERE o_orderkey % 3 <> 0")(lambda o: _changed(o))


def _changed(orders):
    files = orders.select(F.col("o_orderkey").cast("string").alias("path"), F.floor("o_totalprice").cast("long").alias("length"), F.col("o_orderdate").cast("timestamp").alias("modificationTime"))
    none = files.limit(0).selectExpr("path as key")
    old = changed_documents(files, none).where("cast(path as bigint) % 3 = 0").select("key")
    return changed_documents(files, old).select("path")


query("export_json", "supplier", sql="""SELECT concat('{"s_suppkey":', s_suppkey, ',"s_name":"', s_name, '","s_nationkey":', CASE WHEN s_nationkey = 3 THEN 'null' ELSE s_nationkey::VARCHAR END, '}') AS json FROM {supplier}""")(lambda s: _exported(s))


def _exported(supplier):
    """Rows written as JSON files, and their lines."""
    path = _scratch(supplier.sparkSession)
    export_json(supplier.select("s_suppkey", "s_name", F.nullif("s_nationkey", F.lit(3)).alias("s_nationkey")), path)
    return supplier.sparkSession.read.text(path).select(F.col("value").alias("json"))


query("check_schema", "v_rules", sql="""SELECT 'id' AS field, true AS "exists", 'bigint' AS actual_type, count(id) AS n_values FROM {v_rules} UNION ALL SELECT 'project_id', true, 'bigint', count(project_id) FROM {v_rules} UNION ALL SELECT 'Parent_Item_Name', true, 'string', count(Parent_Item_Name) FROM {v_rules} UNION ALL SELECT 'Parent_max_score', true, 'int', count(Parent_max_score) FROM {v_rules}
    UNION ALL SELECT 'Child_Item_Name', true, 'string', count(Child_Item_Name) FROM {v_rules} UNION ALL SELECT 'Child_max_score', true, 'int', count(Child_max_score) FROM {v_rules} UNION ALL SELECT 'description', false, NULL, 0 UNION ALL SELECT 'is_veto', true, 'boolean', count(is_veto) FROM {v_rules}
    UNION ALL SELECT 'is_price_criteria', true, 'boolean', count(is_price_criteria) FROM {v_rules} UNION ALL SELECT 'price_formula', true, 'string', count(price_formula) FROM {v_rules} UNION ALL SELECT 'note', true, 'string', count(CASE WHEN id % 2 = 0 THEN description END) FROM {v_rules}""")(lambda r: _checked(r))


def _checked(rules_):
    """Rules written with a column missing and one more, checked as they are in the files."""
    path = _scratch(rules_.sparkSession)
    rules_.withColumn("note", F.expr("if(id % 2 = 0, description, null)")).drop("description").write.parquet(path)
    return check_schema(rules_.sparkSession.read.parquet(path), schema("scoring_rule"))


def _status_stream(spark, sf_dir):
    """Events in three files, of which some come late and one file comes again, then what is kept of the bids."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rule = F.when(F.col("event_type") == "click", (F.floor("value") % 20).cast("string"))
    rows = events.select(F.col("user_id").alias("id"), (F.col("user_id") % 10).alias("project_id"), F.col("ts").cast("timestamp").alias("ts"), status_of(F.col("event_type")).alias("status"), "value", rule.alias("rule"), "event_id")
    source = _scratch(spark)
    third = F.least(F.floor(F.col("event_id") * 3 / events.count()) + F.when(F.col("event_id") % 100 == 7, 1).otherwise(0), F.lit(2))
    for k in (0, 1, 1, 2):
        rows.where(third == k).drop("event_id").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.drop("event_id").schema).option("maxFilesPerTrigger", 1).parquet(source)
    table = KeptTable(spark, _scratch(spark), PROGRESS, ["id"], buckets=16)
    kept = run_status_stream(stream, table, _scratch(spark), delay="1000 days")
    totals = rows.select("project_id").distinct().withColumn("progress_total_rules", F.lit(20))
    report = live_progress(kept, totals).drop("processing_status")
    return report.join(kept.select("id", F.col("processing_status").alias("status"), "value"), "id")


QUERIES["status_stream"] = _status_stream
ORACLE["status_stream"] = """WITH l AS (SELECT user_id AS id, user_id % 10 AS project_id, CASE arg_max(event_type, ts) WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE arg_max(event_type, ts) END AS status, arg_max(value, ts) AS value,
    count(DISTINCT floor(value)::BIGINT % 20) FILTER (event_type = 'click')::INT AS progress_completed FROM events GROUP BY 1)
    SELECT id, project_id, status, value, progress_completed, 20 AS progress_total, progress_completed * 5.0e0 AS percent, count(*) FILTER (status IN ('completed', 'error')) OVER (PARTITION BY project_id) * 100.0e0 / count(*) OVER (PARTITION BY project_id) AS overall_percent FROM l"""


SCORES = "id long, project_id long, bidder_name string, price_score double, extracted_price double, total_score double"


def _score_stream(spark, sf_dir):
    """Bids as a stream of three parts, one of which comes again: projects that are complete get price scores, totals and status.
    A part is written by all tasks, and a run of the stream takes what is new in as one batch. The texts of results are kept at
    rest alone; after each run the versions that nothing reads any more are deleted."""
    with shuffles_dropped(spark):
        bids = written(frames(spark, sf_dir, "v_bids")[0])
        results, rules_ = frames(spark, sf_dir, "v_results", "v_rules", v_bids=bids)
        source = _scratch(spark)
        done = bids.withColumn("processing_status", F.when(F.col("project_id") % 2 == 0, "completed").otherwise(F.col("processing_status"))).select("id", "project_id", "processing_status")
        done = written(done)
        by_project = ["project_id"]
        kept = KeptTable(spark, _scratch(spark), BIDS, ["project_id", "id"], by_project, 16)
        at_rest = KeptTable(spark, _scratch(spark), results.schema, ["project_id", "id"], by_project, 16)
        at_rest.replace(results)
        forgotten(bids)
        scores, projects = KeptTable(spark, _scratch(spark), SCORES, by_project, buckets=16), KeptTable(spark, _scratch(spark), "project_id long, status string", by_project, buckets=16)
        checkpoint = _scratch(spark)
        handle = score_on_complete(kept, at_rest.read, rules_, scores, projects)
        for k in (0, 1, 0, 2):
            done.where(F.col("id") % 3 == k).write.mode("append").parquet(source)
            stream = spark.readStream.schema(done.schema).parquet(source)
            stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
            for table in (kept, scores, projects):
                table.vacuum(keep=1)
    return scores.read().select("id", "project_id", "bidder_name", "price_score", "total_score").join(projects.read(), "project_id")


QUERIES["score_on_complete_stream"] = _score_stream
ORACLE["score_on_complete_stream"] = with_views(f"""WITH {SCORED}, {OTHER}, firsts AS (SELECT min(id) AS id, project_id, bidder_name FROM {{v_bids}} GROUP BY 2, 3),
    new AS (SELECT firsts.id, price_score, {R2.format('other_total + price_score')} AS total FROM firsts JOIN scored USING (project_id, bidder_name) JOIN other ON other.id = firsts.id),
    s AS (SELECT project_id, CASE WHEN count(*) FILTER (processing_status = 'error' AND project_id % 2 = 1) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM {{v_bids}} GROUP BY 1 HAVING project_id % 2 = 0 OR count(*) FILTER (processing_status = 'processing') = 0)
    SELECT r.id, r.project_id, r.bidder_name, coalesce(new.price_score, r.price_score) AS price_score, coalesce(new.total, r.total_score) AS total_score, status FROM {{v_results}} r JOIN s ON s.project_id = r.project_id LEFT JOIN new ON new.id = r.id""")
