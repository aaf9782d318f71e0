"""Queries over page regions, tool calls, FAQ lines and the evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import BM25_SQL, bench_queries, query, table
from millrace.operators import evaluation as E
from millrace.operators import page_tables as P
from millrace.operators import retrieval as R
from millrace.operators import sessions as S
from millrace.operators.relations import first_by
from millrace.work import dealt

# ---- order lines as pages: a table on each, on some a header above or a text below it ----

#: A line of an order; numbers that are there twice count once.
ONE = "(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1)"


def order_lines(spark, sf_dir):
    """Dealt by order, which all that follows goes by."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return first_by(dealt(lines, "l_orderkey"), ["l_orderkey", "l_linenumber"], "l_partkey", "l_suppkey")


HTML = "'<table><tr><th>' || l_returnflag || '</th></tr><tr><td>' || l_partkey || '</td></tr>' || CASE WHEN l_partkey % 3 = 0 THEN '<tr><td>' || l_suppkey || '</td></tr>' ELSE '' END || '</table>'"


@query(f"""WITH RECURSIVE g AS (SELECT l_orderkey AS doc, l_linenumber AS page, l_returnflag AS sig, l_partkey % 7 <> 0 AS top, l_suppkey % 3 <> 0 AS bottom, {HTML} AS html, l_partkey, l_suppkey FROM {ONE}),
w AS (SELECT doc, page, false AS closed, CASE WHEN bottom THEN sig END AS carry FROM g x WHERE NOT EXISTS (SELECT 1 FROM g y WHERE y.doc = x.doc AND y.page = x.page - 1)
  UNION ALL SELECT g.doc, g.page, coalesce(g.top AND g.sig = w.carry, false), CASE WHEN g.bottom AND NOT (coalesce(g.top AND g.sig = w.carry, false) AND g.top) THEN g.sig END FROM w JOIN g ON g.doc = w.doc AND g.page = w.page + 1),
n AS (SELECT doc, count(*) AS pages FROM g GROUP BY 1),
t AS (SELECT g.*, w.closed, lead(w.closed) OVER (PARTITION BY g.doc ORDER BY g.page) AS takes, lead(g.html) OVER (PARTITION BY g.doc ORDER BY g.page) AS more FROM g JOIN w USING (doc, page))
SELECT doc, page, 1 AS idx, 'table' AS label, coalesce(takes, false) AS merged, md5(CASE WHEN takes THEN replace(html, '</table>', '') || replace(regexp_replace(more, '^<table><tr><th>.</th></tr>', ''), '</table>', '') || '</table>' ELSE html END) AS html_md5 FROM t WHERE NOT closed
UNION ALL SELECT doc, page, 0, 'header', false, md5('h') FROM g JOIN n USING (doc) WHERE NOT top AND pages = 1 UNION ALL SELECT doc, page, 2, 'text', false, md5('t') FROM g WHERE NOT bottom""")
def page_tables(spark, sf_dir):
    page = order_lines(spark, sf_dir).selectExpr("l_orderkey AS doc", "l_linenumber AS page", "l_partkey", "l_suppkey", f"{HTML} AS html")
    parts = F.array(F.when(F.col("l_partkey") % 7 == 0, F.struct(F.lit(0).alias("idx"), F.lit("header").alias("label"), F.lit("h").alias("html"))), F.struct(F.lit(1).alias("idx"), F.lit("table").alias("label"), F.col("html")), F.when(F.col("l_suppkey") % 3 == 0, F.struct(F.lit(2).alias("idx"), F.lit("text").alias("label"), F.lit("t").alias("html"))))
    regions = page.select("doc", "page", F.explode(F.array_compact(parts)).alias("r")).select("doc", "page", "r.*")
    return P.merged_tables(regions).select("doc", "page", "idx", "label", "merged", F.md5("html").alias("html_md5"))


# ---- order lines as turns with tool calls ----

TURN = "CASE l_partkey % 5 WHEN 0 THEN 'assistant' WHEN 1 THEN 'user' ELSE 'tool' END"


@query(f"""WITH m AS (SELECT l_orderkey AS session, l_linenumber AS ts, {TURN} AS role, CASE WHEN l_partkey % 10 = 0 THEN [(l_suppkey % 3)::VARCHAR, (l_suppkey % 3 + 1)::VARCHAR] ELSE [] END AS calls, CASE WHEN {TURN} = 'tool' THEN (l_suppkey % 4)::VARCHAR END AS call_id FROM {ONE}),
o AS (SELECT m.*, (SELECT max(x.ts) FROM m x WHERE x.session = m.session AND x.ts < m.ts AND x.role <> 'tool') AS owner FROM m WHERE role = 'tool'),
k AS (SELECT o.session, o.owner, o.ts, o.call_id FROM o JOIN m ON m.session = o.session AND m.ts = o.owner WHERE list_contains(m.calls, o.call_id)),
s AS (SELECT session, ts AS owner, unnest(calls) AS call_id, generate_subscripts(calls, 1) AS nth FROM m WHERE len(calls) > 0),
u AS (SELECT session, ts AS block, 0 AS kind, ts AS pos, role, call_id FROM m WHERE role <> 'tool' UNION ALL SELECT session, owner, 1, ts, 'tool', call_id FROM k
  UNION ALL SELECT session, owner, 2, nth, 'tool', call_id FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.session = s.session AND k.owner = s.owner AND k.call_id = s.call_id))
SELECT session, row_number() OVER (PARTITION BY session ORDER BY block, kind, pos)::INTEGER AS place, role, call_id, kind = 2 AS stub FROM u""")
def tool_pairs(spark, sf_dir):
    none = F.array().cast("array<string>")
    m = order_lines(spark, sf_dir).select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("ts"), F.expr(TURN).alias("role"), F.lit("x").alias("text"), F.when(F.col("l_partkey") % 10 == 0, F.array((F.col("l_suppkey") % 3).cast("string"), (F.col("l_suppkey") % 3 + 1).cast("string"))).otherwise(none).alias("calls"), F.when(F.expr(TURN) == "tool", (F.col("l_suppkey") % 4).cast("string")).alias("call_id"))
    return S.repaired_pairs(m, "stub").select("session", "place", "role", "call_id", (F.col("text") == "stub").alias("stub"))


@query("""WITH m AS (SELECT conv_id AS session, coalesce(text, '') AS a, CASE WHEN turn % 3 = 1 AND turn < 4 AND length(coalesce(text, '')) > 200 THEN '[tool result truncated]' ELSE coalesce(text, '') END AS b FROM conversations),
t AS (SELECT session, sum(length(a) // 4)::BIGINT AS tokens_before, sum(length(b) // 4)::BIGINT AS tokens_after FROM m GROUP BY 1) SELECT *, round(CASE WHEN tokens_before > 0 THEN (tokens_before - tokens_after) / tokens_before ELSE 0 END, 6)::DOUBLE AS savings, CASE WHEN tokens_before > 0 THEN (tokens_before - tokens_after) / tokens_before ELSE 0 END >= 0.1 AS kept FROM t""")
def tool_prune(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("ts"), F.when(F.col("turn") % 3 == 1, "tool").otherwise(F.col("role")).alias("role"), "text", (F.col("turn") >= 4).alias("in_tail"))
    return S.worth_compressing(m, S.pruned_results(m))


# ---- evaluation: keyword search for the benchmark items whose id is divisible by 100, and chunks for benchmark lines ----

NORMAL = r"""'[\s*：:，,。；;？?！!\-—、（）()【】\[\]「」"''《》·.…]'"""


def match_sql(a: str, b: str, overlap: int) -> str:
    """Whether two normalised texts are one passage."""

    def alike(x: str, y: str) -> str:
        n = f"least({overlap}, length({x}), length({y}))"
        return f"({x} <> '' AND {y} <> '' AND (contains({x}, {y}) OR contains({y}, {x}) OR ({n} >= 8 AND (contains({y}, {x}[:{n}]) OR contains({x}, {y}[:{n}])))))"

    def bare(x: str) -> str:
        return rf"regexp_replace({x}, '^[0-9]{{1,3}}\.?', '')"

    short, long_ = (f"CASE WHEN length({a}) <= length({b}) THEN {x} ELSE {y} END" for x, y in ((a, b), (b, a)))
    return f"({a} <> '' AND {b} <> '' AND ({alike(a, b)} OR {alike(bare(a), bare(b))} OR (least(length({a}), length({b})) >= 16 AND least(length({a}), length({b})) >= 0.55 * greatest(length({a}), length({b})) AND contains({long_}, ({short})[:32]))))"


@query(rf"""WITH {BM25_SQL.strip()}, h AS (SELECT query_id, id, rank, regexp_replace(text, {NORMAL}, '', 'g') AS b FROM bmr JOIN documents ON doc_id = id WHERE rank <= 10 AND trim(coalesce(text, '')) <> ''),
r AS (SELECT item_id AS query_id, i AS ref_no, regexp_replace(CASE i WHEN 0 THEN text WHEN 1 THEN text[:120] ELSE 'another passage ' || item_id END, {NORMAL}, '', 'g') AS a FROM benchmark, range(3) t(i) WHERE item_id % 100 = 0),
pl AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM h),
m AS (SELECT r.query_id, ref_no, n FROM r JOIN h USING (query_id) JOIN pl ON pl.query_id = h.query_id AND pl.rank = h.rank WHERE {match_sql("a", "b", 20)}),
f AS (SELECT query_id, n, bool_or(m.n IS NOT NULL) AS rel FROM pl LEFT JOIN m USING (query_id, n) GROUP BY ALL), qs AS (SELECT DISTINCT query_id FROM r)
SELECT qs.query_id, coalesce((SELECT max(rel::INT) FROM f WHERE f.query_id = qs.query_id AND n <= 5), 0)::DOUBLE AS hit_5, round(coalesce((SELECT 1.0::DOUBLE / min(n) FROM f WHERE f.query_id = qs.query_id AND rel AND n <= 5), 0), 6) AS mrr_5,
(SELECT round(count(DISTINCT ref_no) / 3.0::DOUBLE, 6) FROM m WHERE m.query_id = qs.query_id AND n <= 5) AS recall_5, (SELECT round(count(DISTINCT ref_no) / 3.0::DOUBLE, 6) FROM m WHERE m.query_id = qs.query_id AND n <= 10) AS recall_10 FROM qs""")
def retrieval_scores(spark, sf_dir):
    q, docs = bench_queries(spark, sf_dir), table(spark, sf_dir, "documents")
    hits = R.top(R.bm25(docs, q), 10, "id").select("query_id", "rank", "id").join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    texts = F.array(F.col("text"), F.substring("text", 1, 120), F.concat(F.lit("another passage "), F.col("query_id")))
    scores = E.ir_scores(q.select("query_id", F.posexplode(texts).alias("ref_no", "text")), hits, (5, 10))
    return scores.select("query_id", "hit_5", "mrr_5", "recall_5", "recall_10")


@query(rf"""WITH l AS (SELECT item_id, regexp_replace(text[:100], {NORMAL}, '', 'g') AS a FROM benchmark), d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {NORMAL}, '', 'g') AS b FROM documents)
SELECT item_id, min(doc_id) AS doc_id FROM l JOIN d ON {match_sql("a", "b", 16)} GROUP BY 1""")
def golden_chunks(spark, sf_dir):
    """For each benchmark line the first document that is, or holds, the same passage."""
    lines = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("line_id"), F.lit(None).cast("int").alias("number"), F.substring("text", 1, 100).alias("text"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("ord"), F.lit(0).alias("number"), "text")
    return E.best_chunks(lines, chunks).select(F.col("line_id").alias("item_id"), F.col("chunk_id").alias("doc_id"))


