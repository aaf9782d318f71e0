"""All queries of the library's own operators over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import metrics as M
from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import facts as K
from millrace.operators import graph as G
from millrace.operators import retrieval as R
from millrace.operators import sessions as S
from millrace.operators import similarity as X

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
NOW = "TIMESTAMP '2030-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Timestamps without a zone are read as the session's, so that all time functions take them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({n: F.col(n).cast("timestamp") for n, kind in df.dtypes if kind == "timestamp_ntz"})


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it has fewer partitions than these, for work that costs far more than moving the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    import millrace.catalog_more
    import millrace.catalog_pages
    import millrace.catalog_search  # noqa: F401, they register their queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


# ---- cleaners: a digest of each text stands for it ----


def cleaner(name: str, column: Callable, sql: str | None, of: str = "documents", key: str = "doc_id", text: str = "text") -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, of).select(key, F.md5(column(F.coalesce(F.col(text), F.lit("")))).alias("cleaned_md5"))

    f.__name__ = name
    query(f"SELECT {key}, md5({sql.replace('{t}', f"coalesce({text}, '')")}) AS cleaned_md5 FROM {of}" if sql else None)(f)


def rx(expr: str, rules: list[tuple[str, str]]) -> str:
    """Nested regexp_replace calls of DuckDB for rules in Java's form."""
    for pattern, to in rules:
        to = to.replace("$0", "\\0").replace("$1", "\\1").replace("$2", "\\2").replace("\n", "'||chr(10)||'")
        expr = f"regexp_replace({expr}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return expr


STRIP = [(r"^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$", "")]
WS = "regexp_replace(regexp_replace(array_to_string(list_transform(string_split({e}, chr(10)), lambda x: " + rx("x", STRIP) + "), chr(10)), '^[ \\t\\n\\r\\f\\x0b]+', ''), '[ \\t\\n\\r\\f\\x0b]+$', '')"


def ws_sql(expr: str) -> str:
    return WS.replace("{e}", rx(expr, [(r"[ \t]+", " "), (r"\n{3,}", "\n\n")]))


SPECIAL = [(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (rf"[^\p{{L}}\p{{N}}{T.KEPT}]", "")]
TAGS = [(r"(?is)<script[^>]*>.*</script>", ""), (r"(?is)<style[^>]*>.*</style>", ""), (r"<[^>]+>", " "), ("&nbsp;", " "), (r"&[a-zA-Z]+;|&#[0-9]+;", "")]
NOISE = [(r"Copyright[^\n]*", ""), (r"All Rights Reserved\.?", ""), (r"(?i)\[advertisement\]", ""), (r"\n{3,}", "\n\n"), *STRIP]
WIDE_SQL = "translate({t}, '" + T.WIDE + "', '" + T.NARROW.replace("'", "''") + "')"

cleaner("clean_whitespace", T.whitespace, ws_sql("{t}"))
cleaner("clean_special", T.special_chars, rx("{t}", SPECIAL))
cleaner("clean_markdown", T.markdown, rx("{t}", T.MARKDOWN))
cleaner("clean_noise", T.noise, rx("{t}", NOISE))
cleaner("clean_encoding", T.encoding, rx(WIDE_SQL, [(r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}", "")]))
cleaner("clean_html_regex", T.html_tags, rx("{t}", TAGS), "pages", "page_id", "html")
cleaner("clean_ocr_noise", T.ocr_noise, rx("{t}", [(r"[\x{FEFF}\x{FFFD}]", ""), (r"-\s*\n\s*", ""), (r"[|\x{2500}-\x{257F}]+", " "), (r"\.{2,}", "."), (r"\s{2,}", " "), *STRIP]))
cleaner("mask_pii", T.privacy, rx("{t}", [(p, to) for p, to in T.PRIVACY]))
for _name in ("legal", "technical", "medical", "financial", "academic", "news"):
    cleaner(f"clean_{_name}", T.CLEANERS[_name], rx("{t}", [(p, to) for p, to in [*getattr(T, _name.upper()), *STRIP]]))
cleaner("mask_pii_partial", T.partial_masks, rx("{t}", [(p, to) for p, to in [(r"(1[3-9][0-9])[0-9]{4}([0-9]{4})", "$1****$2"), (r"([a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]*@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", "$1***@$2"), (r"([0-9]{6})[0-9]{8}([0-9]{3}[0-9Xx])", "$1********$2"), (r"([0-9]{4})[0-9]{8,11}([0-9]{4})", "$1****$2")]]))
cleaner("length_filter", T.length_filter, "array_to_string(list_filter(string_split({t}, chr(10)), lambda x: length(" + rx("x", STRIP) + ") >= 10 AND length(" + rx(rx("x", STRIP), [(r"[\s\-.,ï¼ã]+", "")]) + ") >= 5), chr(10))")
cleaner("default_chain", lambda c: T.chain(c, T.CHAINS["default"]), None)
cleaner("match_text", T.match_text, None)
cleaner("think_blocks", T.think_blocks, rx("{t}", [(r"(?is)<think>.*?</think>", ""), *STRIP]), "conversations", "conv_id")


@query("""
WITH l AS (SELECT doc_id, i, ls[i] AS x, regexp_replace(ls[i], '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g') AS s
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, length(s) < 10, lower(regexp_replace(s, '[ \\t\\r\\f\\x0b]+', ' ', 'g')) ORDER BY i) AS rn FROM l)
SELECT doc_id, md5(string_agg(x, chr(10) ORDER BY i)) AS cleaned_md5 FROM k WHERE length(s) < 10 OR rn = 1 GROUP BY doc_id""")
def line_dedupe(spark, sf_dir):
    """Lines only, as the SQL has it; the rule on repeated quotes is tested in tests/test_records.py."""
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.md5(T.duplicate_lines(F.coalesce("text", F.lit("")), quoted=False)).alias("cleaned_md5"))


# ---- measures ----


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{17}[0-9Xx]|[0-9]{16,19}') THEN 'secret'
  WHEN regexp_matches(text, '1[3-9][0-9]{9}|[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') THEN 'pii' ELSE 'public' END AS kind,
  CASE WHEN regexp_matches(text, '[0-9]{17}[0-9Xx]|[0-9]{16,19}') THEN 0 WHEN regexp_matches(text, '1[3-9][0-9]{9}|[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') THEN 300 ELSE 900 END AS ttl FROM documents""")
def sensitivity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.sensitivity(F.col("text")).alias("kind"), T.cache_ttl(F.col("text")).alias("ttl"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]') THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'und' END AS found,
  CAST(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]+|[A-Za-z0-9]+')) AS BIGINT) AS n_run_tokens, CAST(len(regexp_extract_all(text, '[a-zA-Z0-9_]+|[\x{4e00}-\x{9fff}]')) AS BIGINT) AS n_search_tokens,
  CAST(floor(length(text) * 0.7::DOUBLE) AS BIGINT) AS n_estimated, substr(sha256(text), 1, 16) || ':' || length(text) AS audit FROM documents""")
def text_stats(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.language(t).alias("found"), F.size(T.run_tokens(t)).cast("long").alias("n_run_tokens"), F.size(T.search_tokens(t)).cast("long").alias("n_search_tokens"), T.token_estimate(t).alias("n_estimated"), T.audit_hash(t).alias("audit"))


@query()
def ocr_confidence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.ocr_confidence(F.col("text")).alias("confidence"))


@query()
def sentence_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


@query()
def threat_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.threat(F.col("text")).alias("reason"))


# ---- dedupe and similarity ----


@query("""SELECT md5(text) AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")
def exact_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(r"""
WITH t AS (SELECT item_id, regexp_extract_all(text, '[\x{4e00}-\x{9fff}]+|[A-Za-z0-9]+') AS k FROM benchmark),
s AS (SELECT item_id, unnest(CASE WHEN len(k) >= 3 THEN list_transform(range(1, len(k) - 1), lambda i: array_to_string(k[i:i + 2], ' ')) ELSE k END) AS x FROM t),
h AS (SELECT item_id, seed, min(substr(sha256(seed || ':' || x), 1, 16)) AS v FROM s, range(64) r(seed) GROUP BY ALL)
SELECT item_id, md5(string_agg(v, ',' ORDER BY seed)) AS signature FROM h GROUP BY item_id""")
def minhash_signature(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").where(F.size(T.run_tokens(F.col("text"))) > 0)
    return b.select("item_id", F.md5(F.array_join(V.minhash(V.shingles(T.run_tokens(F.col("text")))), ",")).alias("signature"))


@query()
def minhash_documents(spark, sf_dir):
    """Signatures of all documents; 64 zeros without tokens. SQL is too slow over them: tests/test_operators.py has brute force."""
    signed = X.signatures(X.side_by_side(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text"), "doc_id", "text")
    return signed.select(F.col("id").alias("doc_id"), F.md5(F.array_join("signature", ",")).alias("signature"))


@query("""
SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
  round(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS norm FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0""")
def cosine_scan(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("norm", F.round(V.norm(F.col("embedding")), 6))
    return R.vector_scores(e, vec_queries(spark, sf_dir), carry="norm").select("query_id", F.col("id").alias("vec_id"), "score", "norm")


# ---- retrieval ----


def bench_queries(spark, sf_dir) -> DataFrame:
    """The benchmark texts whose id is divisible by 100: the stated query set."""
    return table(spark, sf_dir, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")


BM25_SQL = r"""
q AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 100 = 0),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(list_transform(regexp_extract_all(text, '[a-zA-Z0-9_]+|[\x{4e00}-\x{9fff}]'), lambda x: lower(x))) AS term FROM q) GROUP BY ALL),
dt AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9_]+|[\x{4e00}-\x{9fff}]'), lambda x: lower(x)) AS ts FROM documents),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM dt),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM dt) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
bm AS (SELECT query_id, doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qf), 6) AS score
  FROM p JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL HAVING score > 0),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm)"""


@query(f"WITH {BM25_SQL} SELECT query_id, id, score, rank FROM bmr WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    return R.top(R.bm25(table(spark, sf_dir, "documents"), bench_queries(spark, sf_dir)), 5, "id").select("query_id", "id", "score", "rank")


@query(f"WITH {BM25_SQL}, f AS (SELECT bm.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm JOIN documents ON id = doc_id WHERE source = 'src1') SELECT query_id, id, score, rank FROM f WHERE rank <= 5")
def bm25_tenant_filter(spark, sf_dir):
    """Corpus statistics are those of all tenants; the filter comes after the score."""
    docs = table(spark, sf_dir, "documents")
    hits = R.bm25(docs, bench_queries(spark, sf_dir)).join(docs.where("source = 'src1'").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return R.top(hits, 5, "id").select("query_id", "id", "score", "rank")


VEC_SQL = """
v AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v)"""


def vec_queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"WITH {VEC_SQL} SELECT query_id, id, score, rank FROM vr WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    return R.top(R.nearest(table(spark, sf_dir, "embeddings"), vec_queries(spark, sf_dir), 10), 10, "id").select("query_id", "id", "score", "rank")


def ranked_lists(spark, sf_dir) -> list[DataFrame]:
    """Two lists over orders: by price and by date, for the customers as queries."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderdate")
    price = R.top(o.select("query_id", "id", F.col("o_totalprice").alias("score")), 10, "id")
    date = R.top(o.select("query_id", "id", F.unix_timestamp("o_orderdate").cast("double").alias("score")), 10, "id")
    return [price.select("query_id", "id", "score", "rank"), date.select("query_id", "id", "score", "rank")]


LISTS_SQL = """
o AS (SELECT o_custkey AS query_id, o_orderkey AS id, o_totalprice AS p, epoch(o_orderdate)::DOUBLE AS d FROM orders),
a AS (SELECT query_id, id, p AS score, 0 AS l, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, id) AS rank FROM o QUALIFY rank <= 10),
b AS (SELECT query_id, id, d AS score, 1 AS l, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, id) AS rank FROM o QUALIFY rank <= 10),
u AS (SELECT *, l * 1099511627776 + rank AS ord FROM a UNION ALL SELECT *, l * 1099511627776 + rank AS ord FROM b)"""


def fusion(name: str, sql: str) -> None:
    def f(spark, sf_dir):
        return R.fuse(ranked_lists(spark, sf_dir), name).select("query_id", "id", "score", "ord")

    f.__name__ = f"fusion_{name}"
    query(f"WITH {LISTS_SQL} {sql}")(f)


fusion("rrf", "SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(ord) AS ord FROM u GROUP BY ALL")
fusion("weighted", ", n AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM u WINDOW w AS (PARTITION BY query_id, l)) SELECT query_id, id, round(sum(0.5 * CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END), 6) AS score, min(ord) AS ord FROM n GROUP BY ALL")
fusion("cascade", "SELECT query_id, id, arg_min(score, ord) AS score, min(ord) AS ord FROM u GROUP BY ALL")
fusion("first_match", "SELECT query_id, id, score, ord FROM u WHERE l = (SELECT min(l) FROM u x WHERE x.query_id = u.query_id)")


@query(f"""WITH {BM25_SQL}, c AS (SELECT b.query_id, b.id, b.rank, count(*) OVER (PARTITION BY b.query_id) AS n, list_distinct(list_filter(regexp_split_to_array(lower(q.text), '\\s+'), lambda x: x <> '')) AS qw,
  list_distinct(list_filter(regexp_split_to_array(lower(d.text), '\\s+'), lambda x: x <> '')) AS dw FROM bmr b JOIN q USING (query_id) JOIN documents d ON d.doc_id = b.id WHERE b.rank <= 10),
s AS (SELECT query_id, id, round(len(list_intersect(qw, dw)) + 0.01 * (n - (rank - 1)), 6)::DOUBLE AS score, rank AS ord FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM s) SELECT query_id, id, score, ord, rank FROM r WHERE rank <= 5""")
def token_rerank(spark, sf_dir):
    docs, q = table(spark, sf_dir, "documents"), bench_queries(spark, sf_dir)
    hits = R.top(R.bm25(docs, q), 10, "id").join(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id").join(q.withColumnRenamed("text", "query"), "query_id")
    return R.token_rerank(hits, 5).select("query_id", "id", "score", "ord", "rank")


@query(f"WITH {VEC_SQL} SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v) WHERE score >= 0.55 OR rank <= 2")
def min_score_keep(spark, sf_dir):
    return R.keep_min_score(R.vector_scores(table(spark, sf_dir, "embeddings"), vec_queries(spark, sf_dir)), 0.55, 2).select("query_id", "id", "score", "rank")


@query()
def hybrid_topk(spark, sf_dir):
    """BM25 over documents and vectors over embeddings, both for the ids divisible by 100; doc_id and vec_id are one id space."""
    return R.hybrid(table(spark, sf_dir, "documents"), bench_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), vec_queries(spark, sf_dir)).select("query_id", "id", "score", "rank")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'")
def tag_filter(spark, sf_dir):
    return R.tag_filter(table(spark, sf_dir, "documents").withColumn("tags", F.array("lang", "source")), "tags", ["en", "src1"], match_all=True).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IS NULL OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) OR NOT EXISTS (SELECT 1 FROM labels WHERE quality = 1)")
def acl_filter(spark, sf_dir):
    return R.acl_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")).select("doc_id")


@query()
def entity_edges(spark, sf_dir):
    """doc_id, entity: up to 20 of a document, in order of appearance."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(G.entities(F.coalesce("text", F.lit("")))).alias("entity"))


#: Documents with ids in front, which their own texts do not hold.
WITH_IDS = "concat('see AB-', doc_id % 50 + 10, ' and XY', doc_id % 7 + 10, ', AB-', doc_id % 50 + 10, ' xAB-77 ', coalesce(text, ''))"


@query(rf"SELECT DISTINCT doc_id, unnest(regexp_extract_all({WITH_IDS}, '\b([A-Z]{{2,6}}-[0-9]{{2,6}}|[A-Z]{{2,6}}[0-9]{{2,6}})\b', 1)) AS entity FROM documents")
def entity_ids(spark, sf_dir):
    """The same over texts that have ids in front."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(G.entities(F.expr(WITH_IDS))).alias("entity"))


@query(f"SELECT event_id, CASE WHEN epoch_us({NOW}) < epoch_us(ts) THEN 1.0 ELSE round(pow(0.5, (epoch_us({NOW}) - epoch_us(ts)) / 86400000000.0 / 90), 4) END::DOUBLE AS decay FROM events")
def time_decay(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", R.time_decay(F.lit(None), F.col("ts"), F.expr(NOW)).alias("decay"))


# ---- sessions ----


def messages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("ts"), "role", "text")


ORDERED = "SELECT conv_id AS session, turn AS ts, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations"


@query(f"WITH m AS ({ORDERED}), a AS (SELECT session, ts AS anchor_ts, min(pos) AS at FROM m WHERE ts = 2 GROUP BY ALL) SELECT m.session, a.anchor_ts, m.ts, m.role, CAST(m.pos AS INTEGER) AS pos FROM m JOIN a USING (session) WHERE m.pos BETWEEN a.at - 1 AND a.at + 1")
def scroll(spark, sf_dir):
    m = messages(spark, sf_dir)
    return S.scroll(m, m.where("ts = 2").select("session", "ts").distinct(), 1, 1)


@query("SELECT conv_id AS session, arg_min(text, turn) AS first_text, arg_max(text, turn) AS last_text, count(*) AS n FROM conversations GROUP BY 1")
def bookends(spark, sf_dir):
    return S.bookends(messages(spark, sf_dir))


@query(f"SELECT session, ts, role, md5(text) AS text_md5 FROM ({ORDERED}) WHERE back <= 2")
def browse_last(spark, sf_dir):
    return S.last_n(messages(spark, sf_dir), 2).select("session", "ts", "role", F.md5("text").alias("text_md5"))


@query("WITH f AS (SELECT conv_id AS session, text, min(turn) AS ts FROM conversations WHERE role = 'user' GROUP BY 1, 2) SELECT session, ts, md5(text) AS text_md5 FROM f QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts DESC, text) <= 2")
def recent_user(spark, sf_dir):
    return S.recent_user(messages(spark, sf_dir), 2).select("session", "ts", F.md5("text").alias("text_md5"))


@query("WITH m AS (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS t, row_number() OVER w AS n FROM conversations WHERE trim(text) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) SELECT conv_id AS session, turn AS ts, role FROM m WHERE n = 1 OR NOT (r IS NOT DISTINCT FROM role AND t IS NOT DISTINCT FROM text)")
def dedupe_turns(spark, sf_dir):
    return S.without_repeats(messages(spark, sf_dir)).select("session", "ts", "role")


@query(f"WITH m AS (SELECT *, sum(length(text) + 8) OVER (PARTITION BY session ORDER BY back) AS cost FROM ({ORDERED})) SELECT session, ts, role, CAST(cost AS BIGINT) AS cost FROM m WHERE cost <= 1000 OR back = 1")
def tail_budget(spark, sf_dir):
    return S.tail_budget(messages(spark, sf_dir), 1000).select("session", "ts", "role", "cost")


@query(f"SELECT session, ts, role, CASE WHEN back <= 2 THEN 'recent' ELSE 'older' END AS part FROM ({ORDERED})")
def split_recent(spark, sf_dir):
    return S.split_recent(messages(spark, sf_dir), 1).select("session", "ts", "role", "part")


@query("SELECT conv_id, turn, len(list_filter(['the', 'que', 'und'], lambda t: contains(text, t))) / 3.0::DOUBLE AS score FROM conversations WHERE contains(text, 'the') OR contains(text, 'que') OR contains(text, 'und')")
def msg_search_like(spark, sf_dir):
    terms = F.array(F.lit("the"), F.lit("que"), F.lit("und"))
    score = F.size(F.filter(terms, lambda t: F.contains("text", t))) / 3
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", score.alias("score")).where("score > 0")


# ---- graph over the nation, region, supplier and customer keys ----


def key_edges(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    return n.union(s)


EDGES_SQL = "e0 AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier), e AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0)"


@query(f"WITH RECURSIVE {EDGES_SQL}, k AS (SELECT 'r0' AS node, 0 AS hops UNION SELECT e.dst, k.hops + 1 FROM k JOIN e ON e.src = k.node WHERE k.hops < 2) SELECT node, min(hops) AS hops FROM k GROUP BY node")
def khop(spark, sf_dir):
    return G.k_hops(key_edges(spark, sf_dir), spark.createDataFrame([("r0",)], "node string"), 2)


@query(f"WITH {EDGES_SQL} SELECT DISTINCT src AS node, dst AS neighbour FROM e WHERE src IN ('n1', 'n2')")
def neighbours(spark, sf_dir):
    return G.neighbours(key_edges(spark, sf_dir), spark.createDataFrame([("n1",), ("n2",)], "node string"))


@query(f"WITH RECURSIVE {EDGES_SQL}, k AS (SELECT 'n1' AS node, 0 AS hops UNION SELECT e.dst, k.hops + 1 FROM k JOIN e ON e.src = k.node WHERE k.hops < 4) SELECT 'n1' AS src, node AS dst, min(hops) AS hops FROM k GROUP BY node")
def shortest_path(spark, sf_dir):
    return G.shortest_paths(key_edges(spark, sf_dir), spark.createDataFrame([("n1",)], "node string"), 4).select("src", "dst", "hops")


@query("WITH RECURSIVE t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey - 1 END AS parent FROM customer), r AS (SELECT id, id AS root FROM t WHERE parent IS NULL OR parent NOT IN (SELECT id FROM t) UNION ALL SELECT t.id, r.root FROM t JOIN r ON t.parent = r.id) SELECT t.id, CASE WHEN x.parent IS NULL THEN r.root ELSE t.id END AS root FROM t JOIN r ON t.id = r.id JOIN t x ON x.id = r.root")
def lineage_root(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_custkey") - 1).alias("parent"))
    return G.lineage_roots(c)


# ---- relational, aggregates, windows ----


@query("SELECT user_id, event_type, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY ALL")
def threads_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS name, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def metric_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("SELECT coalesce(toxic::VARCHAR, 'all') AS kind, count(*) AS n, sum(quality)::BIGINT AS passed, round(avg(quality), 6) AS rate FROM labels GROUP BY ROLLUP (toxic)")
def kind_pass_rate(spark, sf_dir):
    return table(spark, sf_dir, "labels").rollup("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("passed"), F.round(F.avg("quality"), 6).alias("rate")).select(F.coalesce(F.col("toxic").cast("string"), F.lit("all")).alias("kind"), "n", "passed", "rate")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return li.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_inner(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 250000)")
def orphan_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def purge_semi(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT coalesce(s_nationkey, c_nationkey) AS nation, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT c_custkey) AS customers FROM (SELECT * FROM supplier WHERE s_acctbal > 0) FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON s_nationkey = c_nationkey GROUP BY 1")
def full_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.countDistinct("s_suppkey").alias("suppliers"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.countDistinct("c_custkey").alias("customers"))
    return s.join(c, "nation", "full").select("nation", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query("SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders")
def window_running(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.row_number().over(w).alias("rn"), F.lag("o_orderkey").over(w).alias("prev"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT user_id, epoch_us(ts) // 60000000 AS minute, count(*) AS n, count(*) > 1 AS over FROM events GROUP BY 1, 2")
def rate_fixed(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.unix_micros("ts") / 60_000_000).alias("minute")).agg(F.count(F.lit(1)).alias("n")).withColumn("over", F.col("n") > 1)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM events")
def qps_window(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-3_600_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count(F.lit(1)).over(w).alias("n"))


@query("SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) <= 86400000000, false) AS hit FROM events")
def ttl_hits(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w) <= 86_400_000_000, F.lit(False)).alias("hit"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000, true) AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(first::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sn FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sn")
def session_windows(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.session_window("ts", "1 hour").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


# ---- facts and measures ----


def segment_facts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"), F.col("c_custkey").alias("ord"))
    said = F.expr("CASE ord % 4 WHEN 0 THEN lower(value) || '!' WHEN 1 THEN 'segment ' || value WHEN 2 THEN 'other' ELSE value END")
    return c.where("ord % 5 <> 0"), c.where("ord % 3 <> 0").select("key", said.alias("value"), F.lit(None).cast("string").alias("source"))


FACTS_SQL = """f AS (SELECT c_custkey::VARCHAR AS key, c_mktsegment AS old FROM customer WHERE c_custkey % 5 <> 0),
d AS (SELECT c_custkey::VARCHAR AS key, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) || '!' WHEN 1 THEN 'segment ' || c_mktsegment WHEN 2 THEN 'other' ELSE c_mktsegment END AS new FROM customer WHERE c_custkey % 3 <> 0)"""


@query(f"""WITH {FACTS_SQL} SELECT key, old, coalesce(new, old) AS value, CASE WHEN new IS NOT NULL AND new IS DISTINCT FROM old THEN 'user' END AS source,
new IS NOT NULL AND new IS DISTINCT FROM old AS changed FROM f FULL JOIN d USING (key)""")
def kv_upsert(spark, sf_dir):
    return K.upserted(*segment_facts(spark, sf_dir))


@query(f"""WITH {FACTS_SQL}, j AS (SELECT key, coalesce(old, '') AS old_value, new AS new_value, coalesce(old <> '' AND new = 'other', false) AS clash FROM d LEFT JOIN f USING (key))
SELECT key, old_value, new_value, CASE WHEN clash THEN 'ask_user' ELSE 'overwrite' END AS strategy, CASE WHEN clash THEN old_value ELSE new_value END AS resolved_value, old_value = '' OR clash AS needs_hitl FROM j""")
def kv_conflicts(spark, sf_dir):
    return K.conflicts(*segment_facts(spark, sf_dir))


@query("""WITH g AS (SELECT doc_id // 10 AS query_id, list(coalesce(quality, 0) ORDER BY doc_id, coalesce(quality, 0))[1:5] AS r FROM labels GROUP BY 1),
s AS (SELECT *, list_position(r, 1) AS place, list_sum(list_transform(range(1, len(r) + 1), lambda i: r[i] / log2(i + 1))) AS dcg, list_reverse_sort(r) AS best FROM g)
SELECT query_id, CASE WHEN place > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, CASE WHEN place > 0 THEN round(1.0::DOUBLE / place, 6) ELSE 0.0 END::DOUBLE AS mrr,
CASE WHEN place > 0 THEN round(dcg / list_sum(list_transform(range(1, len(best) + 1), lambda i: best[i] / log2(i + 1))), 6) ELSE 0.0 END::DOUBLE AS ndcg FROM s""")
def ir_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").groupBy(F.floor(F.col("doc_id") / 10).alias("query_id")).agg(F.sort_array(F.collect_list(F.struct("doc_id", F.coalesce("quality", F.lit(0)).alias("quality")))).alias("r"))
    r = F.col("r.quality")
    return rows.select("query_id", M.hit_at_k(r, 5).alias("hit"), F.round(M.mrr_at_k(r, 5), 6).alias("mrr"), F.round(M.ndcg_at_k(r, 5), 6).alias("ndcg"))
