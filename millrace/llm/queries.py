"""The operators of this package applied to the whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import alignment, bpe, chat, decontaminate, jaccard, lines, mixing, quality, quantize, rans, secrets, substrings, urls
from millrace.llm.shared import new_folder, read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

HOST_RULES = [urls.host_rule("block", "net/"), urls.host_rule("allow", "example.net/en/"), urls.host_rule("block", "example.com/de/"), urls.host_rule("allow", "org/fr/")]
PATTERN_RULES = [urls.pattern_rule("block", p) for p in ("^spam-farm^", "^casino^", "^adserver^", "^doubleclick^", "/ads/", "utm_campaign=spam", "free-*-download")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"), HOST_RULES + PATTERN_RULES)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), TOKENIZER, keep_ids=False)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.read_back(spark, rans.write(read(spark, sf_dir, "documents"), TOKENIZER, new_folder(spark, "tokens"), end_id=2))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_lines(read(spark, sf_dir, "documents"), min_docs=10, min_chars=1, keep_text=False)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(read(spark, sf_dir, "documents"), window=35, keep_text=False)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role")) for t, r in enumerate(("user", "assistant"))])).alias("x"))
    extra = extra.select(F.lit(-1).cast("long").alias("conv_id"), "x.turn", "x.role", F.lit(said).alias("text"))
    return chat.read_back(chat.formatted(rows.unionByName(extra))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(read(spark, sf_dir, "documents"), shingle=5, percent=80).select("doc_id", "n_shingles", "component_id")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(mixing.plan_mix(read(spark, sf_dir, "documents"), weights=(3, 1, 2), total=1.5, cap=2))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), TOKENIZER, PIECES)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.report(read(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_bpe, op3_decontamination, op4_token_binary, op5_line_dedup, op6_secrets, op7_substring_dedup, op8_quality, op9_chat, op10_jaccard, op11_mixing, op12_alignment, op13_vector_codes)}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL_1 = rf"""
WITH u AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule,
  CASE
    WHEN NOT contains(low, '://') THEN NULL
    WHEN regexp_matches(low, '(^|[^a-z0-9])spam-farm([^a-z0-9]|$)') THEN '^spam-farm^'
    WHEN regexp_matches(low, '(^|[^a-z0-9])casino([^a-z0-9]|$)') THEN '^casino^'
    WHEN regexp_matches(low, '(^|[^a-z0-9])adserver([^a-z0-9]|$)') THEN '^adserver^'
    WHEN regexp_matches(low, '(^|[^a-z0-9])doubleclick([^a-z0-9]|$)') THEN '^doubleclick^'
    WHEN contains(low, '/ads/') THEN '/ads/'
    WHEN contains(low, 'utm_campaign=spam') THEN 'utm_campaign=spam'
    WHEN regexp_matches(low, '(?s)free-.*-download') THEN 'free-*-download' END AS pattern
  FROM u)
SELECT page_id, host, path, rule, pattern,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r"""

SQL_3 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

SQL_5 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT r, i, ls[i] AS line, translate(regexp_replace(regexp_replace(ls[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
x AS (SELECT l.*, f.k IS NOT NULL AS gone FROM l LEFT JOIN f USING (k)),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM x GROUP BY r)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN g USING (r)"""

SQL_7 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
t AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
p AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM g JOIN t USING (g)),
x AS (SELECT d.r, d.w[d.i] AS word, d.i, p.p IS NOT NULL AS gone FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) d LEFT JOIN p ON p.r = d.r AND p.p = d.i),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM x GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""

SQL_9 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(replace(text, '&', '&amp;'), '<SYS>|</SYS>|<s>|</s>', '...\0', 'g')) + 5 * len(regexp_extract_all(text, '\[INST\]|\[/INST\]|\[ROLE\]|\[:\]|\[/ROLE\]')) AS chars,
    length(regexp_replace(replace(role, '&', '&amp;'), '<SYS>|</SYS>|<s>|</s>', '...\0', 'g')) + 5 * len(regexp_extract_all(role, '\[INST\]|\[/INST\]|\[ROLE\]|\[:\]|\[/ROLE\]')) AS role_chars,
    lag(role, 1, 'start') OVER w AS before, lead(role) OVER w IS NULL AS last
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 11 ELSE 16 + role_chars END) AS BIGINT) AS formatted_chars,
  bool_and(before || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AND bool_or(last AND role = 'assistant') AS valid
FROM e GROUP BY conv_id"""

SQL_10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, md5('short ' || array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reach.y) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.x = d.doc_id GROUP BY ALL"""



def sql_13(rounds: int = 4) -> str:
    """Lloyd's rounds unrolled: distances by inner products of whole numbers, which doubles hold exactly."""
    near = "SELECT r, p, min((list_inner_product(c.v, c.v) - 2 * list_inner_product(c.v, b{k}.v) + list_inner_product(b{k}.v, b{k}.v))::BIGINT * 256 + e) AS x FROM c JOIN b{k} USING (p) GROUP BY r, p"
    steps = [f"""
a{k} AS MATERIALIZED ({near.format(k=k)}),
m{k} AS (SELECT p, e, list(x ORDER BY i) AS v FROM (SELECT p, a{k}.x % 256 AS e, i, floor(sum(v[i]) / count(*)) AS x FROM c JOIN a{k} USING (r, p), (SELECT unnest(range(1, (SELECT any_value(len(v)) FROM c) + 1)) AS i) GROUP BY ALL) GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.v, b{k}.v) AS v FROM b{k} LEFT JOIN m{k} USING (p, e)),""" for k in range(rounds)]
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS MATERIALIZED (SELECT r, p, w[p * (len(w) // 4) + 1 : (p + 1) * (len(w) // 4)] AS v FROM k, (SELECT unnest(range(4)) AS p)),
b0 AS MATERIALIZED (SELECT p, r AS e, v FROM c WHERE r < 256),{"".join(steps)}
f AS ({near.format(k=rounds)}),
g AS (SELECT r, string_agg(printf('%02x', x % 256), '' ORDER BY p) AS code, CAST(sum(x // 256) AS BIGINT) AS error FROM f GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN g USING (r), h"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": SQL_1, "op3_decontamination": SQL_3, "op5_line_dedup": SQL_5, "op7_substring_dedup": SQL_7, "op9_chat": SQL_9, "op10_jaccard": SQL_10, "op13_vector_codes": sql_13()}
