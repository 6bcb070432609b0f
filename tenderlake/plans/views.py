"""Views of the given tables in the shapes the operators take. The SQL runs on Spark (tables as {name}) and, as common
table expressions, on any engine with the same dialect subset, so that results can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"]

VIEWS = {
    "v_bids": """SELECT l_orderkey * 10 + l_linenumber AS id, min(l_partkey) AS project_id, concat('S', cast(min(l_suppkey) AS string)) AS bidder_name, min(l_extendedprice) AS price,
        cast(min(l_quantity) AS int) AS qty, cast(round(min(l_discount) * 100) AS int) AS disc, cast(round(min(l_tax) * 100) AS int) AS tax, min(l_returnflag) AS flag,
        CASE WHEN min(l_linestatus) = 'O' THEN 'processing' WHEN min(l_returnflag) = 'A' THEN 'error' ELSE 'completed' END AS processing_status,
        concat('/bids/', cast(l_orderkey * 10 + l_linenumber AS string)) AS file_path, cast(min(l_quantity) AS bigint) * 1000 AS file_size,
        cast(min(l_quantity) AS int) % 9 AS progress_completed_rules, cast(min(l_quantity) AS int) % 3 * 8 AS progress_total_rules
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "v_results": """SELECT id, project_id, id AS bid_document_id, bidder_name, CASE WHEN tax = 8 THEN NULL ELSE cast(qty * 2 AS double) END AS total_score, cast(NULL AS double) AS price_score,
        CASE WHEN flag = 'N' AND qty % 3 = 0 THEN NULL ELSE price END AS extracted_price,
        concat('[{"Child_Item_Name":"方案","Parent_Item_Name":"技术","score":', cast(qty % 21 AS string), '},{"Child_Item_Name":"团队","score":', cast(disc * 2 AS string), '},{"criteria_name":"资质","score":', cast(tax AS string),
            '},{"Child_Item_Name":"服务","score":', CASE WHEN flag = 'N' THEN '"none"' ELSE '5' END, '}', CASE WHEN flag = 'R' THEN concat(',{"Child_Item_Name":"价格分","is_price_criteria":true,"score":7,"extracted_price":', cast(cast(floor(price) AS bigint) AS string), '}') ELSE '' END, ']') AS detailed_scores
        FROM {v_bids}""",
    "v_items": """SELECT id, project_id, bidder_name, pos, item, score, price_item, item_price FROM (
        SELECT id, project_id, bidder_name, 0 AS pos, '方案' AS item, cast(qty % 21 AS double) AS score, false AS price_item, cast(NULL AS double) AS item_price FROM {v_bids}
        UNION ALL SELECT id, project_id, bidder_name, 1, '团队', cast(disc * 2 AS double), false, NULL FROM {v_bids}
        UNION ALL SELECT id, project_id, bidder_name, 2, '资质', cast(tax AS double), false, NULL FROM {v_bids}
        UNION ALL SELECT id, project_id, bidder_name, 3, '服务', CASE WHEN flag = 'N' THEN NULL ELSE 5.0e0 END, false, NULL FROM {v_bids}
        UNION ALL SELECT id, project_id, bidder_name, 4, '价格分', 7.0e0, true, cast(floor(price) AS double) FROM {v_bids} WHERE flag = 'R') u""",
    "v_rules": """SELECT p_partkey * 10 + k AS id, p_partkey AS project_id,
        CASE WHEN p_size % 5 = 0 AND k IN (2, 4) THEN NULL WHEN k <= 2 THEN '技术' WHEN k <= 4 THEN '商务' ELSE '价格' END AS Parent_Item_Name,
        CASE WHEN p_size % 5 = 0 AND k IN (2, 4) THEN 0 WHEN k = 5 OR k <= 2 THEN 40 ELSE 20 END AS Parent_max_score,
        CASE k WHEN 1 THEN '方案' WHEN 2 THEN '团队' WHEN 3 THEN '资质' WHEN 4 THEN '服务' END AS Child_Item_Name,
        CASE k WHEN 1 THEN CASE WHEN p_size % 7 = 0 THEN 25 ELSE 20 END WHEN 2 THEN 20 WHEN 3 THEN 10 WHEN 4 THEN 10 END AS Child_max_score,
        concat('rule ', p_name) AS description, k = 4 AND p_size % 13 = 0 AS is_veto, k = 5 AS is_price_criteria, cast(NULL AS string) AS price_formula
        FROM {part} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) ks WHERE NOT (k = 5 AND p_size % 11 = 0)""",
    "v_rules_more": """SELECT * FROM {v_rules}
        UNION ALL SELECT p_partkey * 10 + 6, p_partkey, '信誉', 10, cast(NULL AS string), cast(NULL AS int), 'no children', false, false, cast(NULL AS string) FROM {part} WHERE p_size % 3 = 0
        UNION ALL SELECT p_partkey * 10 + 7, p_partkey, '报价', 35, cast(NULL AS string), cast(NULL AS int), 'a second price rule', false, true, cast(NULL AS string) FROM {part} WHERE p_size % 4 = 0""",
    "v_scores": """SELECT id, project_id, bidder_name, CASE qty % 4
            WHEN 0 THEN concat('[{"criteria_name":"技术","score":', cast(disc AS string), ',"weight":2.5,"children":[{"criteria_name":"团队","score":1},{"criteria_name":"投标报价","score":3,"extra":"e"}]}]')
            WHEN 1 THEN concat('{"方案":', cast(disc AS string), ',"价格分":4,"其他":{"score":1}}')
            WHEN 2 THEN concat('[{"Child_Item_Name":"方案","score":', cast(disc AS string), '},{"is_price_criteria":true,"score":7,"note":null}]')
            ELSE concat('[{"criteria_name":"方案","score":', cast(disc AS string), '}]') END AS detailed_scores
        FROM {v_bids}""",
    "v_projects": """SELECT p_partkey AS id, concat('P', cast(p_partkey AS string)) AS project_code, p_name AS name, p_type AS description, p_brand AS status,
        CASE WHEN p_size % 17 = 0 THEN concat('[{"category":"总","criteria_name":"', p_brand, '","max_score":100,"description":"d"}]') END AS scoring_rules_summary FROM {part}""",
    "v_events": """SELECT user_id AS id, user_id % 10 AS project_id, event_type, ts, cast(value AS int) AS value FROM {events}""",
}


def frames(spark: SparkSession, sf_dir: str, *names: str, **made: DataFrame) -> list[DataFrame]:
    """The named views (or tables) over the tables of a folder, and over views that are made already."""
    done = dict(made)

    def get(name: str) -> DataFrame:
        if name not in done:
            if name in VIEWS:
                sql = VIEWS[name]
                own = {n: get(n) for n in [*VIEWS, *TABLES] if f"{{{n}}}" in sql}
                sql = sql.replace("{", "{{").replace("}", "}}")  # braces of JSON texts stay
                done[name] = spark.sql(_fill(sql, {f"{{{n}}}": f"{{{n}}}" for n in own}), **own)
            else:
                done[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return done[name]

    return [get(n) for n in names]


def with_views(sql: str) -> str:
    """sql with the views it names as common table expressions in front."""
    need: list[str] = []

    def add(text: str) -> None:
        for n in VIEWS:
            if f"{{{n}}}" in text and n not in need:
                add(VIEWS[n])
                need.append(n)

    add(sql)
    names = {n: n for n in [*VIEWS, *TABLES]}
    body = ", ".join(f"{n} AS ({_fill(VIEWS[n], names)})" for n in need)
    text = _fill(sql, names)
    if not need:
        return text
    return f"WITH {body}, {text.strip()[5:]}" if text.strip()[:5].upper() == "WITH " else f"WITH {body} {text}"


def _fill(sql: str, names: dict[str, str]) -> str:
    for n, to in names.items():
        sql = sql.replace(f"{{{n}}}", to)
    return sql
