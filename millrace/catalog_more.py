"""Further queries over the driver's tables: planner, records, filters, joins, aggregates, ranking, graph, limits, chunks. Each runs a function of
the library over whole tables; the SQL beside it says the same in another way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import EDGES_SQL, ORDERED, WITH_IDS, key_edges, messages, query, spread, table
from millrace.functions import records as N
from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import chunking as C
from millrace.operators import evidence as E
from millrace.operators import graph as G
from millrace.operators import limits as L
from millrace.operators import relations as R
from millrace.operators import sessions as S
from millrace.operators import similarity as X
from millrace.plans import planner as P
from millrace.sources import tables as K

# ---- planner: user turns, some of them worded as the kinds of questions that there are ----

WORDING = {0: "concat('AB-', conv_id + 1000)", 1: "cast(conv_id + 10000 as {s})", 2: "concat(text, '需要注意什么？')", 3: "concat('如何', text)", 4: "concat('对比 ', text)", 5: "concat('尘盒 ', text)", 6: "concat('who is responsible for ', text)", 7: "concat('what is XY12 ', text)", 8: "concat('上次说的方案怎么样', text)", 9: "'我叫小明'", 10: "'你好'"}


def wording(string: str) -> str:
    return "CASE conv_id % 12 " + " ".join(f"WHEN {k} THEN {v.format(s=string)}" for k, v in WORDING.items()) + " ELSE text END"


ASKED = f"u AS (SELECT conv_id, turn, {wording('VARCHAR')} AS q FROM conversations WHERE role = 'user')"


def asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").selectExpr("conv_id", "turn", f"{wording('string')} AS q")


def any_sql(patterns: list[str]) -> str:
    return "regexp_matches(q, '(?i)" + "|".join(f"(?:{p})" for p in patterns) + "')"


ENTITY_N = r"len(regexp_extract_all(q, '[A-Z]{2,4}-?\d+')) + len(regexp_extract_all(q, '\b\d{4,}\b'))"
STOP = ", ".join(f"'{w}'" for w in P.STOP_WORDS)
KIND_SQL = f"CASE WHEN {any_sql(P.EXACT)} THEN 'factual_exact' WHEN {any_sql(P.GRAPH)} THEN 'graph' WHEN {any_sql(P.RELATIONAL)} THEN 'relational' WHEN {any_sql(P.SEMANTIC)} THEN 'semantic_doc' WHEN {any_sql(P.QUESTION)} AND {ENTITY_N} > 0 THEN 'hybrid' ELSE 'semantic_doc' END"


@query(rf"""WITH {ASKED} SELECT conv_id, turn, {KIND_SQL} AS query_type,
CASE WHEN {any_sql(P.EXACT)} THEN 0.95 WHEN {any_sql(P.GRAPH)} THEN 0.9 WHEN {any_sql(P.RELATIONAL)} THEN 0.85 WHEN {any_sql(P.SEMANTIC)} THEN 0.8 WHEN {any_sql(P.QUESTION)} AND {ENTITY_N} > 0 THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence,
CAST({ENTITY_N} AS BIGINT) AS n_entities, CAST(len(list_filter(regexp_extract_all(lower(q), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1 AND w NOT IN ({STOP}))) AS BIGINT) AS n_keywords FROM u""")
def classify_query(spark, sf_dir):
    c = P.classified(F.col("q"))
    return asked(spark, sf_dir).select("conv_id", "turn", c["query_type"].alias("query_type"), c["confidence"].alias("confidence"), F.size(c["entities"]).cast("long").alias("n_entities"), F.size(c["keywords"]).cast("long").alias("n_keywords"))


@query(f"""WITH {ASKED}, k AS (SELECT *, {KIND_SQL} AS kind FROM u) SELECT conv_id, turn, CASE kind WHEN 'factual_exact' THEN 'sql' WHEN 'relational' THEN 'sql' WHEN 'graph' THEN 'graph' ELSE 'vector' END AS "primary",
CASE kind WHEN 'factual_exact' THEN 'vector' WHEN 'graph' THEN 'vector' WHEN 'relational' THEN 'vector' WHEN 'hybrid' THEN 'sql,graph,bm25' ELSE 'sql,bm25' END AS secondary,
CASE kind WHEN 'factual_exact' THEN 'first_match' ELSE 'rrf' END AS fusion, CASE kind WHEN 'graph' THEN 2 ELSE 0 END AS hop FROM k""")
def route_plan(spark, sf_dir):
    r = P.routed(P.classified(F.col("q"))["query_type"])
    return asked(spark, sf_dir).select("conv_id", "turn", r["primary"].alias("primary"), F.array_join(r["secondary"], ",").alias("secondary"), r["fusion"].alias("fusion"), r["graph_hop"].alias("hop"))


@query(rf"""WITH {ASKED}, s AS (SELECT *, trim(q, ' {chr(10)}{chr(9)}{chr(13)}') AS t FROM u) SELECT conv_id, turn, CASE WHEN t = '' THEN 'generic_knowledge' WHEN regexp_matches(replace(t, ' ', ''), '{P.EXACT_LOOKUP}') THEN 'exact_lookup'
WHEN regexp_matches(t, '{"|".join(P.MAINTENANCE)}') THEN 'maintenance' WHEN regexp_matches(t, '{P.COMPARE}') THEN 'product_compare' WHEN regexp_matches(t, '{P.HOW_TO}') THEN 'how_to'
WHEN regexp_matches(t, '应注意什么|需要注意什么|该注意什么|要注意什么|有哪些注意事项|有什么注意事项') THEN 'faq_like' ELSE 'generic_knowledge' END AS profile FROM s""")
def rewrite_profile(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", P.profile(F.col("q")).alias("profile"))


@query()
def rewritten_queries(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", F.posexplode(P.rewritten(F.col("q"))).alias("place", "variant"))


INTENT_SQL = rf"""CASE WHEN t = '' THEN 'chitchat' WHEN regexp_matches(t, '{P.SKILL}') THEN 'skill' WHEN regexp_matches(t, '{P.INTRO}') OR regexp_matches(t, '{P.PROFILE}') THEN 'profile'
WHEN length(t) < 2 OR regexp_matches(t, '{P.SKIP}') THEN 'chitchat' WHEN meta THEN 'recall' WHEN regexp_matches(t, '{P.RECALL}') AND regexp_matches(t, '{P.EVALUATE}') THEN 'recall_and_knowledge' WHEN regexp_matches(t, '{P.RECALL}') THEN 'recall' ELSE 'knowledge' END"""
TURN_SQL = rf"""{ASKED}, s AS (SELECT *, regexp_replace(q, '^\s+|\s+$', '', 'g') AS t FROM u), p AS (SELECT *, trim(regexp_replace(regexp_extract(t, '什么(.+)$', 1), '[\s?!.，。~？！吗呢]+$', '')) AS topic FROM s),
m AS (SELECT *, t <> '' AND (topic = '' OR topic IN ('问题', '内容')) AND NOT regexp_matches(t, '(是什么|是啥|是哪些)$') AND (regexp_matches(t, '{P.META_END}') OR regexp_matches(t, '{P.META_RECALL}')) AS meta FROM p),
i AS (SELECT *, {INTENT_SQL} AS intent FROM m)"""


@query(f"""WITH {TURN_SQL} SELECT conv_id, turn, intent, intent IN ('recall', 'recall_and_knowledge') AS run_session_search, intent IN ('knowledge', 'recall_and_knowledge') AS run_rag,
CASE intent WHEN 'skill' THEN 'skill_intent' WHEN 'profile' THEN 'profile_intent' WHEN 'recall' THEN 'recall_intent' END AS skip_rag,
CASE intent WHEN 'skill' THEN 'skill_intent' WHEN 'profile' THEN 'profile_intent' WHEN 'knowledge' THEN 'knowledge_intent' END AS skip_recall FROM i""")
def intent_plan(spark, sf_dir):
    rows = asked(spark, sf_dir).withColumn("intent", P.intent(F.col("q"), P.intent_predicates(F.col("q"))))
    plan = P.intent_plan(F.col("intent"))
    return rows.select("conv_id", "turn", "intent", *(plan[c].alias(c) for c in ("run_session_search", "run_rag", "skip_rag", "skip_recall")))


@query("SELECT doc_id, round(greatest(0, least(1, 0.5 + CASE WHEN source = 'web' THEN 0.18 WHEN regexp_matches(text, '^[0-9]+\\.') THEN -0.12 ELSE 0 END)), 4)::DOUBLE AS score FROM documents".replace("source = 'web'", "doc_id % 3 = 0"))
def maintenance_boost(spark, sf_dir):
    path = F.when(F.col("doc_id") % 3 == 0, F.lit("/a/维护保养.txt")).otherwise(F.lit("/a/b.txt"))
    none = F.expr("cast(array() as array<string>)")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(P.maintenance_score(F.lit("机身保养"), F.lit(0.5), path, none, F.coalesce("text", F.lit(""))), 4).alias("score"))


# ---- records and texts ----


@query(r"""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x1f\x7f]+', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, md5(t) AS text_md5, CASE WHEN regexp_matches(t, '[一-鿿]') THEN 'zh' WHEN regexp_matches(t, '[A-Za-z]') THEN 'en' ELSE 'und' END AS lang, CAST(len(regexp_extract_all(t, '[一-鿿]+|[A-Za-z0-9]+')) AS BIGINT) AS token_count FROM c""")
def record_clean(spark, sf_dir):
    text, lang, _, n = N.cleaned_record(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("text_md5"), lang, n)


@query()
def html_dom(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(N.html_text(F.col("html"))).alias("text_md5"))


@query()
def ocr_postprocess(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(N.postprocess_ocr(F.col("text"), layout=True)).alias("text_md5"))


@query()
def merged_ocr_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(N.merged_lines(F.coalesce("text", F.lit("")))).alias("text_md5"))


@query(r"""WITH l AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '\S')) AS f FROM documents)
SELECT doc_id, length(t) - length(replace(t, chr(10), '')) >= 2 AND (regexp_matches(t, '[|\t]') OR (len(f) >= 2 AND len(list_filter(f, lambda x: regexp_matches(x, '\s{2,}'))) >= greatest(1, len(f) // 2))) AS table_like FROM l""")
def table_like(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.table_like(F.coalesce("text", F.lit(""))).alias("table_like"))


@query(r"""WITH e AS (SELECT page_id, lower(regexp_extract(url, '\.([^./]+)$', 1)) AS ext FROM pages) SELECT page_id, CASE WHEN ext IN ('pdf') THEN 'pdf' WHEN ext IN ('doc', 'docx') THEN 'word' WHEN ext IN ('png', 'jpg', 'jpeg', 'bmp', 'tiff', 'tif', 'webp') THEN 'image'
WHEN ext IN ('html', 'htm') THEN 'html' WHEN ext IN ('md', 'markdown') THEN 'markdown' ELSE 'text' END AS format FROM e""")
def detect_format(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.format_of(F.col("url")).alias("format"))


def sheets(spark, sf_dir, first: str, sep: str) -> DataFrame:
    """The suppliers of a nation as one text of lines."""
    line = F.concat_ws(sep, F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line"))))
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit(first), F.array_join(F.transform(rows, lambda x: x["line"]), "\n")).alias("t"))


SHEET_SQL = "SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS pos, s_suppkey::VARCHAR || ' | ' || s_name || ' | ' || s_nationkey::VARCHAR AS line FROM supplier UNION ALL SELECT DISTINCT s_nationkey, 0, 'id | name | nation' FROM supplier"


@query(f"SELECT s_nationkey, CAST(pos AS INTEGER) AS pos, line FROM ({SHEET_SQL})")
def table_csv(spark, sf_dir):
    t = sheets(spark, sf_dir, "id,name,nation\n", ",")
    return t.select("s_nationkey", F.posexplode(F.split(N.rows_text(N.csv_rows(F.col("t"))), "\n")).alias("pos", "line"))


@query(f"SELECT s_nationkey, CAST(pos AS INTEGER) AS pos, line FROM ({SHEET_SQL})")
def table_markdown(spark, sf_dir):
    t = sheets(spark, sf_dir, "| id | name | nation |\n|---|:-:|---|\n", " | ")
    return t.select("s_nationkey", F.posexplode(F.split(N.table_extract(F.col("t")), "\n")).alias("pos", "line"))


@query(f"SELECT s_nationkey, CAST(pos AS INTEGER) AS pos, line FROM ({SHEET_SQL})")
def table_json(spark, sf_dir):
    item = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    t = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", item.alias("i")))), lambda x: x["i"])).alias("t"))
    return t.select("s_nationkey", F.posexplode(F.split(N.table_extract(F.col("t")), "\n")).alias("pos", "line"))


@query(f"SELECT s_nationkey, CAST(pos AS INTEGER) AS pos, line FROM ({SHEET_SQL})")
def table_html(spark, sf_dir):
    cells = F.concat(*[x for c in ("s_suppkey", "s_name", "s_nationkey") for x in (F.lit("<td> "), F.col(c).cast("string"), F.lit("</td>"))])
    rows = F.array_sort(F.collect_list(F.struct("s_suppkey", F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("r"))))
    html = F.concat(F.lit("<p>x</p><table><tr><th>id</th><th>name</th><th>nation</th></tr>"), F.array_join(F.transform(rows, lambda x: x["r"]), ""), F.lit("</table>"))
    t = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(html.alias("t"))
    return t.select("s_nationkey", F.posexplode(F.split(N.rows_text(N.html_rows(F.col("t"))), "\n")).alias("pos", "line"))


@query("SELECT c_custkey, c_name AS author, '2020-01-05T00:00:00' AS created_at, 'a,b' AS tags, 'x y' AS own_key FROM customer")
def metadata_normal(spark, sf_dir):
    raw = F.create_map(F.lit("Written By"), F.col("c_name"), F.lit("creation-date"), F.lit("on 2020/1/5"), F.lit("Keywords"), F.lit("a; b|"), F.lit("Own Key"), F.lit(" x\t y "), F.lit("none"), F.lit(None))
    m = N.metadata(raw)
    return table(spark, sf_dir, "customer").select("c_custkey", *(F.element_at(m, k).alias(k) for k in ("author", "created_at", "tags", "own_key")))


@query("SELECT c_custkey, 3::BIGINT AS n, 'a,b' AS tags_csv FROM customer")
def store_metadata(spark, sf_dir):
    m = N.store_metadata(F.create_map(F.lit("name"), F.col("c_name"), F.lit("tags"), F.lit("a,b"), F.lit("gone"), F.lit(None)))
    return table(spark, sf_dir, "customer").select("c_custkey", F.size(m).cast("long").alias("n"), F.element_at(m, "tags_csv").alias("tags_csv"))


@query("SELECT event_id, props AS found FROM events")
def json_from_text(spark, sf_dir):
    fence = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("so: ```json\n"), "props", F.lit("\n``` done"))).otherwise(F.concat(F.lit("it is "), "props", F.lit(" I think")))
    return table(spark, sf_dir, "events").select("event_id", N.json_in_text(fence).alias("found"))


@query("""WITH j AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) AS t FROM conversations GROUP BY 1), c AS (SELECT conv_id, t, t[:2000] AS cut, 2000 - strpos(reverse(t[:2000]), chr(10)) AS brk FROM j),
b AS (SELECT conv_id, t, CASE WHEN contains(cut, chr(10)) AND brk > 1400 THEN cut[:brk] ELSE cut END AS back FROM c)
SELECT conv_id, md5(CASE WHEN length(t) <= 2000 THEN t ELSE CASE WHEN suffix(back, chr(10)) THEN back[:length(back) - 1] ELSE back END || chr(10) || '[... truncated ...]' END) AS summary_md5 FROM b""")
def truncating_summary(spark, sf_dir):
    m = messages(spark, sf_dir).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ts", "role", "text"))).alias("m"))
    return m.select(F.col("session").alias("conv_id"), F.md5(N.summary(F.col("m.text"))).alias("summary_md5"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE c_name END AS name FROM customer")
def said_name(spark, sf_dir):
    said = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("我叫"), "c_name", F.lit("。"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("我的名字是 "), "c_name", F.lit("！"))).otherwise(F.lit("我叫什么？"))
    return table(spark, sf_dir, "customer").select("c_custkey", N.said_name(said).alias("name"))


@query("SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(coalesce(text, ''), '{p}')) AS BIGINT) AS {k}" for k, p in N.AUDIT_PII.items()) + " FROM documents")
def audit_counts(spark, sf_dir):
    c = N.audit_counts(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", *(c[k].alias(k) for k in N.AUDIT_PII))


@query("SELECT doc_id, sha256(coalesce(text, ''))[:16] || ':' || length(coalesce(text, ''))::VARCHAR AS hashed, CASE WHEN length(text) > 8000 THEN md5(text[:8000] || '...') ELSE md5(coalesce(text, '')) END AS full_md5 FROM documents")
def audit_content(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", N.audit_content(t).alias("hashed"), F.md5(N.audit_content(t, "full")).alias("full_md5"))


@query("""WITH d AS (SELECT item_id, sha256(coalesce(text, '')) AS h FROM benchmark), v AS (SELECT item_id, list_transform(range(0, 64), lambda i: ('0x' || h[(i % 32) * 2 + 1:(i % 32) * 2 + 2])::INTEGER / 127.5 - 1.0) AS v FROM d)
SELECT item_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6)::DOUBLE AS first, round(v[64] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6)::DOUBLE AS last FROM v""")
def mock_embedding(spark, sf_dir):
    v = table(spark, sf_dir, "benchmark").select("item_id", N.mock_embedding(F.col("text")).alias("v"))
    return v.select("item_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", 64), 6).alias("last"))


@query()
def search_terms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(N.search_terms(F.coalesce("text", F.lit(""))), "|").alias("terms"))


PAGES_SQL = "p AS (SELECT DISTINCT conv_id AS doc, turn AS page, text || chr(10) || 'page footer' || CASE WHEN turn % 2 = 0 THEN chr(10) || 'even' ELSE '' END AS t FROM conversations)"


@query(f"""WITH {PAGES_SQL}, l AS (SELECT doc, page, i AS pos, ls[i] AS line, trim(ls[i], ' ' || chr(9) || chr(13)) AS k FROM (SELECT doc, page, string_split(t, chr(10)) AS ls, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM p)),
n AS (SELECT doc, count(DISTINCT page) AS n FROM p GROUP BY 1), o AS (SELECT doc, k FROM l JOIN n USING (doc) WHERE length(k) >= 3 GROUP BY doc, k, n HAVING n >= 2 AND count(DISTINCT page) > 0.3 * n),
x AS (SELECT doc, page, string_agg(line, chr(10) ORDER BY pos) AS t FROM l ANTI JOIN o USING (doc, k) GROUP BY 1, 2) SELECT DISTINCT doc, page, md5(coalesce(x.t, '')) AS text_md5 FROM p LEFT JOIN x USING (doc, page)""")
def header_footer(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").selectExpr("conv_id AS doc", "turn AS page", "concat(text, '\\npage footer', CASE WHEN turn % 2 = 0 THEN '\\neven' ELSE '' END) AS text").distinct()
    return S.without_running_lines(p).select("doc", "page", F.md5("text").alias("text_md5"))


@query(r"""WITH n AS (SELECT conv_id, turn, regexp_replace(text, '[\s*：:，,。；;？?！!\-—、（）()【】\[\]「」"''《》·.…]', '', 'g') AS a, lead(regexp_replace(text, '[\s*：:，,。；;？?！!\-—、（）()【】\[\]「」"''《》·.…]', '', 'g')) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS b FROM conversations),
m AS (SELECT *, regexp_replace(a, '^[0-9]{1,3}\.?', '') AS a2, regexp_replace(b, '^[0-9]{1,3}\.?', '') AS b2, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM n WHERE b IS NOT NULL)
SELECT conv_id, turn, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a) OR (least(20, length(a), length(b)) >= 8 AND (contains(b, a[:least(20, length(a), length(b))]) OR contains(a, b[:least(20, length(a), length(b))])))
OR (a2 <> '' AND b2 <> '' AND (contains(a2, b2) OR contains(b2, a2) OR (least(20, length(a2), length(b2)) >= 8 AND (contains(b2, a2[:least(20, length(a2), length(b2))]) OR contains(a2, b2[:least(20, length(a2), length(b2))])))))
OR (length(s) >= 16 AND length(s) >= 0.55 * length(l) AND contains(l, s[:32]))) AS matches FROM m""")
def contexts_match(spark, sf_dir):
    rows = messages(spark, sf_dir).withColumn("next", F.lead("text").over(S.by_time())).where("next is not null")
    return rows.select(F.col("session").alias("conv_id"), F.col("ts").alias("turn"), N.contexts_match(F.col("text"), F.col("next")).alias("matches"))


# ---- filters ----


@query("SELECT doc_id, regexp_matches(lower(text), 'the') OR contains(text, 'é') AS any_hit, contains(lower(text), 'the') AND contains(text, 'é') AS all_hit FROM documents WHERE text IS NOT NULL")
def keyword_rules(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", R.keyword_rule(F.col("text"), ["The", "é"]).alias("any_hit"), R.keyword_rule(F.col("text"), ["The", "é"], "all").alias("all_hit"))


@query("SELECT doc_id, array_to_string(list_distinct_ordered, ',') AS tags FROM (SELECT doc_id, list_concat(CASE WHEN contains(lower(text), 'the') THEN ['english'] ELSE [] END, CASE WHEN contains(lower(text), 'und') AND contains(lower(text), 'der') THEN ['german', 'x'] ELSE [] END, ['file:a', 'plain']) AS list_distinct_ordered FROM documents WHERE text IS NOT NULL)")
def rule_tags(spark, sf_dir):
    rules = [("en", ["the"], "any", ["english"]), ("de", ["und", "der"], "all", ["german", "x"])]
    tags, _ = R.rule_tags(F.col("text"), rules, F.expr("cast(array() as array<string>)"), F.lit("/d/a.txt"), {"txt": ["plain"]})
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(tags, ",").alias("tags"))


@query("SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'a') OR contains(lower(p_type), 'a')) AND (contains(lower(p_name), 'e') OR contains(lower(p_type), 'e'))")
def tool_search(spark, sf_dir):
    return table(spark, sf_dir, "part").where(R.contains_all([F.col("p_name"), F.col("p_type")], ["a", "e"])).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END, o_orderdate) < TIMESTAMP '1997-01-01' - INTERVAL 365 DAY")
def expired_sessions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "active").otherwise("ended").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("ended_at"), F.col("o_orderdate").alias("started_at"))
    return R.expired_sessions(o, F.expr("TIMESTAMP '1997-01-01 00:00:00'"), 365).select("o_orderkey")


@query("SELECT conv_id * 1000 + turn AS message_id FROM conversations WHERE trim(coalesce(text, '')) <> '' AND conv_id % 5 <> 0 ORDER BY turn, conv_id * 1000 + turn LIMIT 50 OFFSET 20")
def reindex_page(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS message_id", "turn AS ts", "text AS content", "conv_id % 5 = 0 AS redacted")
    return R.reindexable(m, 20, 50).select("message_id")


@query("SELECT o_custkey AS query_id, max(o_totalprice) >= 200000 AS satisfactory FROM orders GROUP BY 1")
def retrieval_satisfactory(spark, sf_dir):
    return R.satisfactory(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_totalprice").alias("score")), 200000)


def skills(spark, sf_dir) -> DataFrame:
    empty = F.expr("cast(array() as array<string>)")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("skill_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("t1"))).otherwise(empty).alias("tenants"), empty.alias("channels"), F.when(F.col("p_size") % 5 == 0, "deprecated").alias("status"), F.array("p_brand", "p_type").alias("triggers"), F.array(F.lit("^x"), F.lit("BR"), F.lit("(")).alias("patterns"))


@query("SELECT p_partkey AS skill_id FROM part WHERE p_size % 2 <> 0 AND p_size % 5 <> 0")
def visible_skills(spark, sf_dir):
    return R.visible_skills(skills(spark, sf_dir), "t2").select("skill_id")


@query("SELECT p_partkey AS skill_id, (contains(lower(p_brand), 'br')::INT + contains(lower(p_type), 'br')::INT + 2 + 2 * contains(lower(p_name), 'br')::INT + contains(lower(p_name), 'br')::INT) AS score FROM part")
def skill_search(spark, sf_dir):
    return skills(spark, sf_dir).select("skill_id", R.skill_score(F.lit("br"), F.col("triggers"), F.col("patterns"), F.col("title"), F.lit(None).cast("string")).alias("score"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 IN (0, 1) AND c_nationkey = 3")
def owned_documents(spark, sf_dir):
    meta = F.when(F.col("c_custkey") % 3 == 0, F.format_string('{"user_id": "u%d"}', "c_nationkey")).when(F.col("c_custkey") % 3 == 1, F.format_string('{"user_id": "", "owner_id": "u%d"}', "c_nationkey")).otherwise(F.lit("{}"))
    return R.owned_by(table(spark, sf_dir, "customer").select("c_custkey", meta.alias("metadata")), "u3").select("c_custkey")


# ---- joins ----


@query("SELECT o_orderkey, c_nationkey AS user_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def session_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("tenant_id"), F.col("c_nationkey").alias("user_id"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("session_id"))
    return R.with_sessions(o, c, "BUILDING").where("user_id = 3").select("o_orderkey", "user_id")


@query("""WITH h AS (SELECT o_custkey AS query_id, o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 7 END AS parent_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders),
k AS (SELECT h.*, n_name AS t FROM h LEFT JOIN nation ON n_nationkey = parent_id AND n_nationkey <> 3), f AS (SELECT query_id, parent_id, min(pos) AS first_pos FROM k WHERE t IS NOT NULL GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_pos) AS no FROM f), o AS (SELECT k.*, coalesce(no <= 3 AND first_pos = pos, false) AS expanded FROM k LEFT JOIN g ON g.query_id = k.query_id AND g.parent_id = k.parent_id WHERE no IS NULL OR no > 3 OR first_pos = pos)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS rank, expanded, CASE WHEN expanded THEN t END AS parent_text FROM o""")
def parent_expand(spark, sf_dir):
    h = table(spark, sf_dir, "orders").selectExpr("o_custkey AS query_id", "o_orderkey AS id", "CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 7 END AS parent_id", "o_totalprice AS score")
    parents = table(spark, sf_dir, "nation").where("n_nationkey <> 3").selectExpr("n_nationkey AS parent_id", "n_name AS text")
    return R.parents_of(h, parents, 3).select("query_id", "id", "rank", "expanded", "parent_text")


@query("SELECT doc_id AS chunk_id, doc_id % 4 <> 0 AND doc_id % 3 <> 0 AS same FROM documents")
def fingerprint_skip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.md5(F.coalesce("text", F.lit(""))).alias("fingerprint"))
    old = d.where("chunk_id % 4 <> 0").withColumn("fingerprint", F.when(F.col("chunk_id") % 3 == 0, F.lit("changed")).otherwise(F.col("fingerprint")))
    return R.unchanged(d, old).select("chunk_id", "same")


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 5 = 0")
def orphan_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    return R.orphans(d, d.where("chunk_id % 5 <> 0"))


@query("SELECT p_partkey FROM part WHERE p_size <> 7 OR p_partkey % 2 <> 0")
def manifest_skip(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_brand AS tenant_id", "md5(cast(p_partkey AS string)) AS md5", "p_size")
    done = p.where("p_size = 7").selectExpr("tenant_id", "md5", "CASE WHEN p_partkey % 2 = 0 THEN 'm2' ELSE 'm1' END AS model_version", "'c' AS config_hash")
    return K.to_index(p, done, "m2", "c").select("p_partkey")


@query("""WITH f AS (SELECT o_orderkey, o_orderstatus AS t, o_custkey AS name, md5(o_orderkey::VARCHAR) AS h, o_orderdate AS d FROM orders) SELECT o_orderkey FROM (SELECT *, first_value(h) OVER (PARTITION BY t, name ORDER BY d DESC, h DESC) AS newest FROM f) WHERE h <> newest""")
def superseded_files(spark, sf_dir):
    f = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus AS tenant_id", "o_custkey AS filename", "md5(cast(o_orderkey AS string)) AS md5", "o_orderdate AS indexed_at")
    return R.superseded(f).select("o_orderkey")


@query("WITH s AS (SELECT p_partkey, p_retailprice AS lo, p_retailprice + p_size AS hi FROM part) SELECT s_suppkey, p_partkey FROM supplier JOIN s ON s_acctbal BETWEEN lo AND hi")
def range_join(spark, sf_dir):
    spans = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_retailprice AS lo", "p_retailprice + p_size AS hi")
    return R.interval_join(table(spark, sf_dir, "supplier"), spans, "s_acctbal", "lo", "hi", 100.0).select("s_suppkey", "p_partkey")


@query("WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 2 = 0), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) SELECT l.event_id, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    right = e.where("event_id % 2 = 1").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return R.asof_join(e.where("event_id % 2 = 0").select("event_id", "user_id", "ts"), right, "user_id", "ts", "value").select("event_id", "value")


@query("""WITH n AS (SELECT n_nationkey AS ord, n_name AS alias, n_nationkey % 7 AS id, n_name || ' ' || r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey), m AS (SELECT DISTINCT c FROM (SELECT n_name AS c FROM nation UNION ALL SELECT n_name[2:5] FROM nation UNION ALL SELECT lower(r_name) FROM region UNION ALL SELECT n_name[:1] FROM nation))
SELECT c AS mention, coalesce(arg_min(id, ord) FILTER (alias = c), arg_min(id, ord)) AS canonical_id FROM m JOIN n ON alias = c OR contains(lower(alias), lower(c)) OR contains(lower(name), lower(c)) GROUP BY c""")
def entity_resolve(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("n_nationkey AS ord", "n_name AS alias", "n_nationkey % 7 AS canonical_id", "concat(n_name, ' ', r_name) AS display_name")
    asked = n.selectExpr("n_name AS mention").union(n.selectExpr("substring(n_name, 2, 4)")).union(r.selectExpr("lower(r_name)")).union(n.selectExpr("substring(n_name, 1, 1)"))
    return R.resolved(asked, names)


# ---- aggregates ----


@query("SELECT c_custkey AS session_id, count(o_orderkey) AS message_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def message_counts(spark, sf_dir):
    return R.message_counts(table(spark, sf_dir, "customer").selectExpr("c_custkey AS session_id"), table(spark, sf_dir, "orders").selectExpr("o_custkey AS session_id"))


@query("SELECT event_type AS name, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE prefix(event_type, 'c') OR prefix(event_type, 'p') GROUP BY 1")
def prefixed_totals(spark, sf_dir):
    return R.metric_stats(table(spark, sf_dir, "events").selectExpr("event_type AS name", "value"), ["c", "p"]).select("name", "n", "total")


@query("SELECT count(*) AS samples, count(*) FILTER (value > 150) AS failures, coalesce(round(avg(value) FILTER (value > 0), 2), 0) AS value_mean, round(avg(score) FILTER (NOT value > 150), 4) AS score_mean FROM (SELECT *, user_id / 100.0::DOUBLE AS score FROM events)")
def eval_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("value", "user_id / 100.0D AS score", "CASE WHEN value > 150 THEN 'late' END AS error")
    return R.eval_summary(e, ["value"], ["score"])


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM customer")
def kv_match(spark, sf_dir):
    want = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    got = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("name"), F.concat(F.lit("it is "), "c_name"), F.lit("segment"), F.col("c_mktsegment"))).when(F.col("c_custkey") % 3 == 1, F.create_map(F.lit("name"), F.col("c_name"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    return table(spark, sf_dir, "customer").select("c_custkey", R.kv_match(got, want).alias("score"))


@query("""WITH p AS (SELECT l_orderkey AS doc_id, CASE WHEN l_quantity >= 30 AND l_quantity / 50000.0 >= 0.0005 THEN 'native' WHEN l_quantity <= 10 AND l_quantity / 50000.0 <= 0.0002 THEN 'scan' ELSE 'hybrid' END AS r FROM lineitem)
SELECT doc_id, CASE WHEN count(DISTINCT r) > 1 THEN 'hybrid' ELSE min(r) END AS route FROM p GROUP BY 1""")
def doc_route(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), R.page_route(F.col("l_quantity"), F.lit(50000.0), None, 30, 0.0005, 10, 0.0002).alias("route"))
    return R.doc_routes(pages)


QC_SQL = "q AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, count(*) AS regions, count(*) FILTER (l_discount < 0.04) AS low_regions FROM lineitem GROUP BY 1, 2), v AS (SELECT *, round(low_regions / regions, 4) AS low_ratio, CASE WHEN round(low_regions / regions, 4) >= 0.6 THEN 'fail' WHEN round(low_regions / regions, 4) >= 0.3 THEN 'retry' ELSE 'pass' END AS verdict FROM q)"


def qc(spark, sf_dir) -> DataFrame:
    return R.page_quality(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS page", "l_discount AS confidence"), 0.04)


@query(f"WITH {QC_SQL} SELECT doc_id, page, low_ratio, verdict FROM v")
def page_qc(spark, sf_dir):
    return qc(spark, sf_dir).select("doc_id", "page", "low_ratio", "verdict")


@query(f"WITH {QC_SQL} SELECT doc_id, count(*) FILTER (verdict = 'pass') AS passed, count(*) FILTER (verdict = 'fail') AS failed, count(*) FILTER (verdict = 'retry') AS retried FROM v GROUP BY 1")
def qc_summary(spark, sf_dir):
    return R.quality_summary(qc(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, round(100 * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 1) AS pct, l_quantity > 40 AS slow FROM lineitem")
def trace_waterfall(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS trace_id", "l_linenumber AS node", "l_quantity AS ms")
    return R.waterfall(t, 40).selectExpr("trace_id AS l_orderkey", "node AS l_linenumber", "pct", "slow")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def archive_summary(spark, sf_dir):
    return R.counts_by(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT count(*) AS n FROM embeddings WHERE label = 1")
def vector_count(spark, sf_dir):
    return K.counted(table(spark, sf_dir, "embeddings"), {"label": 1})


# ---- windows over turns and sentences ----


@query("SELECT conv_id AS session, turn AS ts, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, regexp_replace(text, '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g') ORDER BY turn DESC) AS n FROM conversations) WHERE role <> 'user' OR n = 1")
def collapse_turns(spark, sf_dir):
    """Every second turn has blanks around its text, which do not count."""
    m = messages(spark, sf_dir).withColumn("text", F.when(F.col("ts") % 2 == 0, F.concat(F.lit(" "), "text", F.lit("\n"))).otherwise(F.col("text")))
    return S.collapsed(m).select("session", "ts", "role")


@query(f"""WITH m AS (SELECT *, sum(CASE WHEN role = 'system' THEN 0 ELSE 1 END) OVER w AS o, sum((role = 'user')::INT) OVER w AS u, sum(length(text) // 4) OVER (PARTITION BY session ORDER BY back) AS cost FROM ({ORDERED}) WINDOW w AS (PARTITION BY session ORDER BY pos))
SELECT session, ts, role, CASE WHEN o = 0 OR (role = 'user' AND u = 1) THEN 'head' WHEN cost <= 100 OR back = 1 THEN 'tail' ELSE 'middle' END AS zone FROM m""")
def context_zones(spark, sf_dir):
    return S.zones(messages(spark, sf_dir), 100).select("session", "ts", "role", "zone")


LINES_SQL = r"l AS (SELECT doc_id, i - 1 AS place, ls[i] AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents))"


def text_lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("place", "text"))


@query(rf"""WITH {LINES_SQL}, w AS (SELECT *, list_distinct(regexp_extract_all(t, '[一-鿿]+|[A-Za-z0-9]+')) AS k FROM l), s AS (SELECT doc_id, place, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER o AS r,
list_distinct(flatten(coalesce(list(k) OVER (o ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []))) AS a, list_distinct(flatten(list(k) OVER (o ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))) AS b FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY place))
SELECT doc_id, CAST(place AS INTEGER) AS place, n >= 3 AND r > 1 AND CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END < 0.3 AS cut FROM s""")
def topic_tiling(spark, sf_dir):
    return C.topic_cuts(text_lines(spark, sf_dir)).select("doc_id", "place", "cut")


@query("""WITH s AS (SELECT event_id, user_id, value AS sim, lag(value) OVER w AS p, lead(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, coalesce(sim < p AND sim < n AND p - sim >= 20, false) AS cut FROM s""")
def embedding_valley(spark, sf_dir):
    return C.valleys(table(spark, sf_dir, "events").selectExpr("user_id AS doc_id", "event_id AS place", "value AS sim"), 20).selectExpr("place AS event_id", "cut")


@query(f"""WITH {LINES_SQL}, s AS (SELECT *, CAST(floor(least(length(t), length(lead(t) OVER w)) * 0.2) AS INTEGER) AS a, CAST(floor(least(length(t), length(lag(t) OVER w)) * 0.2) AS INTEGER) AS b FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY place))
SELECT doc_id, CAST(place AS INTEGER) AS place, md5(CASE WHEN lead(t) OVER w IS NOT NULL AND a > 0 THEN t[length(t) - a + 1:] END) AS tail, md5(CASE WHEN lag(t) OVER w IS NOT NULL AND b > 0 THEN t[:b] END) AS head FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY place)""")
def chunk_overlap(spark, sf_dir):
    return C.overlaps(text_lines(spark, sf_dir), 0.2).select("doc_id", "place", F.md5("overlap_tail").alias("tail"), F.md5("overlap_head").alias("head"))


# ---- order, limits, sets ----


@query("WITH h AS (SELECT o_custkey AS query_id, o_orderkey % 10 AS id, o_totalprice AS score, o_orderkey AS ord FROM orders), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, ord) = 1) SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS INTEGER) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) <= 3")
def dedupe_top(spark, sf_dir):
    h = table(spark, sf_dir, "orders").selectExpr("o_custkey AS query_id", "o_orderkey % 10 AS id", "o_totalprice AS score", "o_orderkey AS ord", "'' AS content")
    return R.top_distinct(h, 3).select("query_id", "id", "rank")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 30")
def paging(spark, sf_dir):
    return R.page(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 30, 10).select("o_orderkey")


@query("WITH u AS (SELECT s_nationkey AS id, s_acctbal AS score, 0 AS source FROM supplier UNION ALL SELECT c_nationkey, c_acctbal, 1 FROM customer) SELECT id, score, source FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, source) = 1")
def max_union(spark, sf_dir):
    return R.max_union(table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS id", "s_acctbal AS score"), table(spark, sf_dir, "customer").selectExpr("c_nationkey AS id", "c_acctbal AS score"))


CUTS_SQL = "c AS (SELECT l_orderkey, list_distinct(list(CAST(l_linenumber AS INTEGER)) FILTER (l_discount > 0.04)) AS a, list_distinct(list(CAST(l_linenumber AS INTEGER)) FILTER (l_tax > 0.04)) AS b FROM lineitem GROUP BY 1)"


@query(f"WITH {CUTS_SQL} SELECT l_orderkey, len(list_intersect(coalesce(a, []), coalesce(b, [])))::BIGINT AS confirmed, len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x)))::BIGINT AS weak_a, len(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x)))::BIGINT AS weak_b FROM c")
def cut_sets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_discount") > 0.04, F.col("l_linenumber"))).alias("a"), F.collect_set(F.when(F.col("l_tax") > 0.04, F.col("l_linenumber"))).alias("b"))
    s = R.cut_sets(F.col("a"), F.col("b"))
    return li.select("l_orderkey", *(F.size(s[k]).cast("long").alias(k) for k in ("confirmed", "weak_a", "weak_b")))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def dlq_latest(spark, sf_dir):
    return R.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("""WITH u AS (SELECT o_orderkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'archived' WHEN 'O' THEN 'closed' ELSE 'active' END AS status, o_orderdate AS d, 0 AS o FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, 'ended', o_orderdate, 1 FROM orders WHERE o_orderkey % 2 = 0),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY o) = 1) SELECT session_id, CASE WHEN o = 1 OR status = 'archived' THEN 'cold' WHEN status = 'closed' THEN 'online_closed' ELSE 'online' END AS storage FROM f ORDER BY d DESC, session_id LIMIT 100""")
def session_listing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cols = ["o_orderdate AS started_at", "CAST(NULL AS timestamp) AS ended_at"]
    online = o.where("o_orderkey % 3 > 0").selectExpr("o_orderkey AS session_id", "CASE o_orderstatus WHEN 'F' THEN 'archived' WHEN 'O' THEN 'closed' ELSE 'active' END AS status", *cols)
    return R.merged_listing(online, o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS session_id", "'ended' AS status", *cols)).select("session_id", "storage")


@query("WITH p AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS place FROM lineitem) SELECT l_orderkey::VARCHAR || CASE WHEN place > min(place) OVER (PARTITION BY l_orderkey) THEN '-dup' || place::VARCHAR ELSE '' END AS id, l_linenumber FROM p")
def distinct_ids(spark, sf_dir):
    return R.distinct_ids(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber", "l_shipdate", "l_orderkey"), "id", "l_shipdate", "l_orderkey", "l_linenumber").select("id", "l_linenumber")


@query("SELECT c_custkey, array_to_string(list_distinct([c_mktsegment]) || CASE WHEN c_mktsegment = 'x' THEN [] ELSE ['x'] END, ',') AS tags FROM customer")
def tag_merge(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(R.merged_tags(F.array("c_mktsegment", F.lit("x")), F.array(F.lit("x"), F.col("c_mktsegment"))), ",").alias("tags"))


@query("SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2")
def dedupe_fields(spark, sf_dir):
    return R.deduped(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey").select("c_nationkey", "c_mktsegment", "c_custkey")


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_acctbal > 9000").selectExpr("c_nationkey AS k").union(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_except_all(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_nationkey AS k").exceptAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT l_returnflag, l_shipmode, count(*) AS n FROM (SELECT l_returnflag, l_linestatus AS l_shipmode FROM lineitem) GROUP BY GROUPING SETS ((l_returnflag), (l_shipmode), ())")
def grouping_sets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "l_linestatus AS l_shipmode")
    return li.groupingSets([["l_returnflag"], ["l_shipmode"], []], "l_returnflag", "l_shipmode").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT abs(approx - exact) <= 0.05 * exact AS near, exact AS n FROM (SELECT count(DISTINCT user_id) AS exact, count(DISTINCT user_id) AS approx FROM events)")
def approx_distinct(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    # in one aggregation with the exact count, each user would have a sketch of its own
    r = e.agg(F.approx_count_distinct("user_id", 0.01).alias("approx")).crossJoin(e.agg(F.count_distinct("user_id").alias("n")))
    return r.select((F.abs(F.col("approx") - F.col("n")) <= 0.05 * F.col("n")).alias("near"), "n")


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate)::DATE::VARCHAR AS month_start, last_day(o_orderdate)::VARCHAR AS month_end, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INTEGER AS age, (o_orderdate + INTERVAL 30 DAY)::DATE::VARCHAR AS due FROM orders")
def date_functions(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.trunc(d, "month").cast("string").alias("month_start"), F.last_day(d).cast("string").alias("month_end"), F.datediff(d, F.lit("1992-01-01")).alias("age"), F.date_add(d, 30).cast("string").alias("due"))


@query("WITH m AS (SELECT o_orderkey, o_orderdate FROM orders) SELECT s.start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '15 minutes', ts), time_bucket(INTERVAL '15 minutes', ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL '15 minutes', ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL '15 minutes', ts) - INTERVAL 45 MINUTE]) AS start FROM events) s GROUP BY 1")
def sliding_windows(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


# ---- similarity and graph ----


@query("""WITH t AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '[一-鿿]+|[A-Za-z0-9]+') AS w FROM benchmark), g AS (SELECT item_id, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE w END AS s FROM t),
m AS (SELECT item_id, CASE WHEN len(s) = 0 THEN list_transform(range(0, 64), lambda i: repeat('0', 16)) ELSE list_transform(range(0, 64), lambda i: list_min(list_transform(s, lambda x: sha256(i::VARCHAR || ':' || x)[:16]))) END AS h FROM g)
SELECT a.item_id AS a, b.item_id AS b, round(list_sum(list_transform(range(1, 65), lambda i: (a.h[i] = b.h[i])::INT)) / 64.0::DOUBLE, 6) AS similarity FROM m a JOIN m b ON b.item_id = a.item_id + 1""")
def minhash_similarity(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    pairs = b.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"))
    return X.compared(pairs, X.signatures(b, "item_id", "text"))


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[A-Za-z0-9]+')) AS a, lead(list_distinct(regexp_extract_all(text, '[A-Za-z0-9]+'))) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS b FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6)::DOUBLE AS score FROM w WHERE b IS NOT NULL""")
def jaccard_turns(spark, sf_dir):
    rows = messages(spark, sf_dir).withColumn("b", F.lead(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).over(S.by_time())).where("b is not null")
    return rows.select(F.col("session").alias("conv_id"), F.col("ts").alias("turn"), F.round(V.jaccard(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))), F.array_distinct("b")), 6).alias("score"))


@query()
def greedy_dedupe(spark, sf_dir):
    """Paragraphs of the documents without near copies of an earlier one of the same document."""
    return X.greedy_signatures(C.paragraphs(spread(table(spark, sf_dir, "documents")))).select("doc_id", "place")


@query("SELECT doc_id, substr(md5(lower(trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13)))[:100]), 1, 12) AS print FROM documents")
def content_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", E.fingerprint(F.coalesce("text", F.lit(""))).alias("print"))


@query("""WITH RECURSIVE t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey - 1 END AS parent FROM customer), r AS (SELECT id, id AS root FROM t WHERE parent IS NULL OR parent NOT IN (SELECT id FROM t) UNION ALL SELECT t.id, r.root FROM t JOIN r ON t.parent = r.id),
x AS (SELECT t.id, CASE WHEN r.root % 7 = 0 THEN r.root ELSE t.id END AS root FROM t JOIN r USING (id)) SELECT root, o_orderkey AS session FROM orders JOIN x ON x.id = o_custkey WHERE root <> 7 QUALIFY row_number() OVER (PARTITION BY root ORDER BY o_totalprice DESC, o_orderdate, o_custkey) = 1""".replace("o_orderkey AS session", "o_custkey AS session"))
def lineage_dedupe(spark, sf_dir):
    p = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey - 1 END AS parent")
    hits = table(spark, sf_dir, "orders").selectExpr("o_custkey AS session", "o_totalprice AS score", "o_orderdate AS ts")
    return G.lineage_dedupe(hits, p, 7).select("root", "session")


@query(r"""WITH e AS (SELECT doc_id, list_distinct(regexp_extract_all(concat('see AB-', doc_id % 50 + 10, ' and XY', doc_id % 7 + 10, ', AB-', doc_id % 50 + 10, ' xAB-77 ', coalesce(text, '')), '\b([A-Z]{2,6}-[0-9]{2,6}|[A-Z]{2,6}[0-9]{2,6})\b')) AS es FROM documents) SELECT doc_id AS src, CAST(least(20, len(es)) AS BIGINT) AS n FROM e WHERE len(es) > 0""")
def mention_counts(spark, sf_dir):
    return G.mentions(table(spark, sf_dir, "documents").withColumn("text", F.expr(WITH_IDS))).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {EDGES_SQL}, k AS (SELECT 'r0' AS node, 0 AS hops UNION SELECT e.dst, k.hops + 1 FROM k JOIN e ON e.src = k.node WHERE k.hops < 2) SELECT DISTINCT src, dst FROM e0 WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)")
def khop_edges(spark, sf_dir):
    return G.subgraph(key_edges(spark, sf_dir), spark.createDataFrame([("r0",)], "node string"), 2)


@query("""WITH n AS (SELECT 'n' || n_nationkey AS node, n_name FROM nation ORDER BY 1 LIMIT 10), e AS (SELECT 'n' || s_nationkey AS src, 's' || s_suppkey AS dst FROM supplier ORDER BY 1, 2 LIMIT 10)
SELECT (SELECT string_agg('- ' || node || ' (name=' || n_name || ')', chr(10) ORDER BY node) FROM n) || chr(10) || (SELECT string_agg(src || ' -> ' || dst, chr(10) ORDER BY src, dst) FROM e) AS text""")
def linearise(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.create_map(F.lit("name"), F.col("n_name")).alias("props"))
    edges = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    return G.linearised(nodes, edges)


@query("SELECT n_nationkey AS node, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE n_name END AS name, n_regionkey::VARCHAR AS region FROM nation")
def node_upsert(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    old = n.select(F.col("n_nationkey").alias("node"), F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string")).alias("props"))
    out = G.upserted_nodes(old, n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("node"), F.create_map(F.lit("name"), F.lit("new")).alias("props")))
    return out.select("node", F.element_at("props", "name").alias("name"), F.element_at("props", "region").alias("region"))


@query("SELECT 'n' || s_nationkey AS src, count(*) AS n FROM supplier WHERE s_nationkey <> 3 GROUP BY 1")
def node_delete(spark, sf_dir):
    edges = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    nodes = edges.selectExpr("src AS node").distinct()
    return G.without_nodes(nodes, edges, spark.createDataFrame([("n3",)], "node string"))[1].groupBy("src").agg(F.count(F.lit(1)).alias("n"))


# ---- evidence ----


@query("SELECT o_custkey AS query_id, o_orderkey AS id FROM orders WHERE o_totalprice > 100000")
def rerank_min(spark, sf_dir):
    return E.rerank_min_score(table(spark, sf_dir, "orders").selectExpr("o_custkey AS query_id", "o_orderkey AS id", "o_totalprice AS score"), 100000).select("query_id", "id")


@query("WITH r AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS a, row_number() OVER (ORDER BY p_size, p_partkey) AS b FROM part) SELECT id, round(CASE WHEN a <= 100 THEN 1.0 / (60 + a) ELSE 0 END + CASE WHEN b <= 100 THEN 1.0 / (60 + b) ELSE 0 END, 9)::DOUBLE AS score FROM r WHERE a <= 100 OR b <= 100".replace("1.0 /", "1.0::DOUBLE /"))
def session_rrf(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_retailprice", "p_size", F.lit(0).alias("query_id"))
    lists = [E.with_ranks(p, F.desc("p_retailprice"), "id").where("rank <= 100"), E.with_ranks(p, "p_size", "id").where("rank <= 100")]
    return E.message_rrf(lists).select("id", "score")


@query("SELECT conv_id, turn, round(len(list_filter(['the', 'que'], lambda t: contains(lower(text), t))) / 2.0::DOUBLE, 6) AS score FROM conversations")
def message_share(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(E.term_share(F.col("text"), E.words_of(F.lit("The  que"))), 6).alias("score"))


@query("SELECT event_id, round(CASE WHEN event_type IN ('click', 'view') THEN value * 0.35 ELSE value END, 4) AS score FROM events")
def cron_downrank(spark, sf_dir):
    source = F.when(F.col("event_type").isin("click", "view"), "cron").otherwise("user")
    return table(spark, sf_dir, "events").select("event_id", F.round(E.cron_downrank(F.col("value"), source), 4).alias("score"))


@query("""WITH r AS (SELECT conv_id * 1000 + turn AS message_id, conv_id, role, turn AS ts, coalesce(text, '') AS text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, conv_id * 1000 + turn DESC) <= 200),
h AS (SELECT *, contains(text, 'The')::INT + contains(text, 'que')::INT + contains(text, 'é,')::INT + contains(text, 'is')::INT AS hits FROM r WHERE role = 'user') SELECT message_id, hits FROM h WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY hits DESC, ts, message_id DESC) <= 5""")
def user_fallback(spark, sf_dir):
    """Asked within every conversation."""
    m = table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS message_id", "conv_id AS session_id", "role", "text AS content", "turn AS ts")
    return E.user_fallback(m, " The que x  é, is ", 5, each=True).select("message_id", "hits")


@query("""WITH b AS (SELECT conv_id AS query_id, text AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rank FROM conversations), s AS (SELECT *, 300 - (sum(length(t)) OVER (PARTITION BY query_id ORDER BY rank) - length(t)) AS room FROM b WHERE rank <= 5)
SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(CASE WHEN length(t) <= room THEN length(t) ELSE room END AS INTEGER) AS chars FROM s WHERE length(t) <= room OR room > 80""")
def evidence_budget(spark, sf_dir):
    m = messages(spark, sf_dir)
    b = m.select(F.col("session").alias("query_id"), "text", F.row_number().over(S.by_time()).alias("rank"))
    return E.budgeted(b, 300, 5, 80).select("query_id", "rank", F.length("shown").alias("chars"))


@query()
def evidence_lines(spark, sf_dir):
    m = messages(spark, sf_dir)
    texts = lambda role: m.where(F.col("role") == role).groupBy(F.col("session").alias("query_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return E.fused_lines(texts("user"), texts("assistant")).select("query_id", "place", "source", "print")


@query("""WITH q AS (SELECT item_id AS query_id, [item_id::VARCHAR] AS e FROM benchmark WHERE item_id % 2 = 0) SELECT query_id, doc_id, 1.0::DOUBLE AS score FROM q JOIN documents ON doc_id::VARCHAR = e[1]
UNION ALL SELECT item_id, doc_id, 0.8::DOUBLE FROM benchmark, documents WHERE item_id % 100 = 1 AND contains(lower(documents.text), 'license')""")
def sql_retrieval(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").where("item_id % 2 = 0 or item_id % 100 = 1")
    none = F.expr("cast(array() as array<string>)")
    q = b.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.array(F.col("item_id").cast("string"))).otherwise(none).alias("entities"), F.when(F.col("item_id") % 2 == 1, F.array(F.lit("License"))).otherwise(none).alias("words"))
    return E.sql_retrieval(table(spark, sf_dir, "documents"), q)


# ---- chunks ----


@query(r"SELECT doc_id, count(*) AS n, sum(length(b))::BIGINT AS chars FROM (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda x: regexp_replace(x, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')), lambda x: x <> '')) AS b FROM documents) GROUP BY 1")
def chunk_plain(spark, sf_dir):
    return C.paragraphs(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, list_distinct(regexp_extract_all(coalesce(text, ''), '[一-鿿]+|[A-Za-z0-9]+')) AS w, greatest(1, length(coalesce(text, ''))) AS n, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS b FROM documents)
SELECT doc_id, round(round(0.30 * least(1.0, len(w) / (n / 8)) + 0.25 * greatest(0.0, 1.0 - CASE WHEN regexp_matches(b, '^(但是|因此|所以|然而|另外|而且)') THEN 0.35 ELSE 0 END - CASE WHEN regexp_matches(b, '(…|\.\.\.|：|:)\s*$') THEN 0.25 ELSE 0 END)
+ 0.20 * least(1.0, len(list_filter(w, lambda x: length(x) >= 2)) / 8) + 0.15 * greatest(0.0, 1.0 - CASE WHEN regexp_matches(t, '[\x00-\x08]') THEN 0.5 ELSE 0 END - CASE WHEN len(regexp_extract_all(t, '[\x{10000}-\x{10FFFF}]')) > 3 THEN 0.3 ELSE 0 END)
+ 0.10 * CASE WHEN n // 2 < 15 THEN 0.2 WHEN n // 2 > 1500 THEN 0.3 ELSE 1.0 END, 4), 3)::DOUBLE AS score FROM t""")
def chunk_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(C.quality_score(F.coalesce("text", F.lit(""))), 3).alias("score"))


@query()
def chunk_fixed(spark, sf_dir):
    return C.fixed(spread(table(spark, sf_dir, "documents"))).select("doc_id", "place", F.md5("text").alias("text_md5"))


@query()
def chunk_seven_step(spark, sf_dir):
    return C.chunked(spread(table(spark, sf_dir, "documents")), parents=True).select("doc_id", "role", "place", "chunk_id", "score")


# ---- sessions, archives, pages ----


@query(r"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' #' || (p_size + 1)::VARCHAR ELSE p_name || ' #2' END AS title FROM part")
def child_session_title(spark, sf_dir):
    title = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" #"), F.col("p_size").cast("string"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", R.child_title(title).alias("title"))


@query("SELECT conv_id AS session_id, turn AS ts, 'message' AS kind, md5(text) AS content_md5 FROM conversations WHERE trim(text) <> '' AND turn % 3 <> 1 UNION ALL SELECT user_id, event_id, 'tool', md5(event_type || ': ' || props) FROM events")
def archive_rows(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").selectExpr("conv_id AS session_id", "turn AS ts", "text AS content", "turn % 3 = 1 AS redacted")
    t = table(spark, sf_dir, "events").selectExpr("user_id AS session_id", "event_id AS ts", "event_type AS tool_name", "props AS summary")
    return R.cold_rows(m, t).select("session_id", "ts", "kind", F.md5("content").alias("content_md5"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN '[ANONYMISED]' ELSE c_name END AS c_name FROM customer")
def anonymise(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "user_id")
    return R.anonymised(c, table(spark, sf_dir, "nation").where("n_nationkey = 3").selectExpr("n_nationkey AS user_id"), ["c_name"]).select("c_custkey", "c_name")


@query("""WITH b AS (SELECT l_orderkey AS page, l_linenumber AS box, l_quantity * 2 AS x0, l_quantity * 2 + 10 AS x1, l_extendedprice AS y0, l_extendedprice + 5 AS y1 FROM lineitem), c AS (SELECT *, (x0 + x1) / 2 >= 55 AS r, count(*) OVER (PARTITION BY page) AS n, count(*) FILTER ((x0 + x1) / 2 >= 55) OVER (PARTITION BY page) AS nr FROM b),
d AS (SELECT *, CASE WHEN n >= 4 AND least(nr, n - nr) > 0 AND least(nr, n - nr) / greatest(nr, n - nr) >= 0.15 AND r THEN 1 ELSE 0 END AS col FROM c) SELECT page, box, CAST(row_number() OVER (PARTITION BY page ORDER BY col, (y0 + y1) / 2, (x0 + x1) / 2, box) AS INTEGER) AS place FROM d""")
def reading_order(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", "l_linenumber AS box", "l_quantity * 2 AS x0", "l_quantity * 2 + 10 AS x1", "l_extendedprice AS y0", "l_extendedprice + 5 AS y1")
    return R.reading_order(b, 110.0).select("page", "box", "place")


# ---- keyed tables ----


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -n_nationkey - 1, 0.0 FROM nation")
def keyed_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0)).unionByName(table(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).alias("c_custkey"), F.lit(0.0).alias("c_acctbal")))
    return K.upserted(c, new, ["c_custkey"])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_nationkey = 3)")
def keyed_delete(spark, sf_dir):
    return K.deleted(table(spark, sf_dir, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": 3}).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def keyed_update(spark, sf_dir):
    return K.updated(table(spark, sf_dir, "customer"), {"c_mktsegment": "X"}, {"c_nationkey": 3}).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 7 OFFSET 3")
def keyed_select(spark, sf_dir):
    return K.select(table(spark, sf_dir, "customer"), {"c_mktsegment": "BUILDING"}, ["c_custkey", "c_name"], [F.desc("c_acctbal"), "c_custkey"], 7, 3)


@query("SELECT c_mktsegment AS _id, count(*) AS n, max(c_acctbal) AS most FROM customer WHERE c_acctbal > 0 GROUP BY 1 ORDER BY n DESC, _id LIMIT 3")
def document_pipeline(spark, sf_dir):
    return K.aggregated(table(spark, sf_dir, "customer"), [{"$match": {"c_acctbal": {"$gt": 0}}}, {"$group": {"_id": "$c_mktsegment", "n": {"$sum": 1}, "most": {"$max": "$c_acctbal"}}}, {"$sort": {"n": -1, "_id": 1}}, {"$limit": 3}])


# ---- limits ----


def calls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("tenant"), F.col("user_id").cast("string").alias("user"), (F.unix_micros("ts") / 1e6).alias("at"), F.col("event_id").alias("call_id"))


@query("""WITH c AS (SELECT event_type AS tenant, user_id, event_id, epoch_us(ts) / 1e6 AS sec FROM events), w AS (SELECT *, floor(sec / 86400) AS win FROM c), t AS (SELECT *, row_number() OVER (PARTITION BY tenant, win ORDER BY sec, event_id) <= 50 AS ok FROM w)
SELECT event_id AS call_id, CASE WHEN NOT ok THEN 'tenant' WHEN sum(ok::INT) OVER (PARTITION BY tenant, user_id, win ORDER BY sec, event_id) > 2 THEN 'user' ELSE 'ok' END AS verdict FROM t""")
def rate_fixed_admission(spark, sf_dir):
    return L.fixed_limit(calls(spark, sf_dir), 50, 2, 86400).select("call_id", "verdict")


@query()
def rate_sliding(spark, sf_dir):
    return L.sliding_limit(calls(spark, sf_dir), 50, 2, 86400.0).select("call_id", "verdict")


@query("WITH c AS (SELECT event_id, event_type, epoch_us(ts) AS us FROM events) SELECT event_id AS call_id, count(*) OVER w AS n, CASE WHEN count(*) OVER w <= 20 THEN 'ok' ELSE 'tenant' END AS verdict FROM c WINDOW w AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)")
def qps_admission(spark, sf_dir):
    return L.qps_limit(calls(spark, sf_dir), 20, 3600.0).select("call_id", "n", "verdict")


def uses(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), (F.unix_micros("ts") / 1e6).alias("at"), F.col("event_id").alias("call_id"), (F.pmod("user_id", F.lit(3)) > 0).alias("ok"))


@query()
def breaker(spark, sf_dir):
    return L.breaker(uses(spark, sf_dir), 2, 3600.0, 2).select("call_id", "state")


@query()
def skill_ewma(spark, sf_dir):
    return L.skill_status(L.success_rates(uses(spark, sf_dir)))
