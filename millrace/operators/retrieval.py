"""BM25, vector search, fusion, reranking and filters: all queries in one job, DataFrame in and out.

Ranked lists have columns query_id, id, score, ord: ord is the position that breaks ties (input order)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import search_tokens
from millrace.operators.vector_index import nearest, scores
from millrace.work import written

#: Rows up to which a query set is broadcast.
BROADCAST_QUERIES = 10_000


def small(df: DataFrame, limit: int = BROADCAST_QUERIES) -> DataFrame:
    """df with a broadcast hint if it is known to have at most limit rows; else as it is, and the planner joins by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf, dl: the whole inverted list, with the document's length in tokens; to be stored by a caller who asks again and again."""
    return tokens(docs, id_col, text_col).where("term is not null").groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, dl, term: a row per token, and one of null for each document."""
    rows = docs.select(F.col(id_col).alias("id"), search_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))
    return rows.select("id", F.size("terms").alias("dl"), F.explode(F.concat("terms", F.array(F.lit(None).cast("string")))).alias("term"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, id, score > 0. queries: query_id, text. Document frequency and mean length are those of the whole corpus. The texts are
    tokenised once: tokens that no query asks for leave before anything is counted, and each task adds up its documents' lengths in one
    row; what is left (postings of query terms) is written to the shared folder, since frequencies and scores both need it."""
    terms = queries.select("query_id", F.explode(search_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    wanted = small(terms.select("term").distinct().withColumn("asked", F.lit(True)), 100_000)
    kept = tokens(docs, id_col, text_col).join(wanted, "term", "left").where("asked or term is null")
    in_term = F.col("term").isNotNull()
    counted = kept.select(F.when(in_term, F.col("id")).alias("id"), F.when(in_term, F.col("dl")).alias("dl"), "term", F.col("dl").alias("length"))
    found = written(counted.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"), F.sum("length").alias("total")), "postings")
    stats = found.where("term is null").select(F.col("tf").alias("n_docs"), F.col("total") / F.col("tf")).first()
    n_docs, avgdl = (stats[0], stats[1]) if stats else (0, 0.0)
    hits = found.where("term is not null")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(small(df, 100_000), "term").join(small(terms), "term")
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(avgdl or 1.0))))
    return scored.groupBy("query_id", "id").agg(F.round(F.sum(idf * tf * F.col("qf")), 6).alias("score")).where("score > 0")


def top(ranked: DataFrame, k: int, *ties: str) -> DataFrame:
    """The best k of each query, with rank from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_scores(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", carry: str | None = None) -> DataFrame:
    """query_id, id, score (cosine; 0 for zero vectors or unequal lengths) of a stated query set with all rows, in blocks of queries; carry: a
    column of the vectors' that the pairs keep."""
    return scores(vectors, queries, id_col, vec_col, carry)


def with_ordinals(lists: list[DataFrame]) -> DataFrame:
    """Ranked lists (query_id, id, score, rank) as one, with list_no and a position over all lists."""
    parts = [d.select("query_id", "id", "score", "rank", F.lit(i).alias("list_no")) for i, d in enumerate(lists)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ord", F.col("list_no").cast("long") * (1 << 40) + F.col("rank"))


def rrf(lists: list[DataFrame], weights: list[float] | None = None, k: int = 60) -> DataFrame:
    """Sum of w / (k + rank); ids found twice in a list count twice; ties go by first place seen."""
    weights = weights or [1.0] * len(lists)
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("list_no") + 1)
    return with_ordinals(lists).groupBy("query_id", "id").agg(F.round(F.sum(w / (k + F.col("rank"))), 9).alias("score"), F.min("ord").alias("ord"))


def weighted(lists: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """Sum of weight times the min-max normalised score; a list of equal scores is all ones."""
    weights = weights or [1.0 / len(lists)] * len(lists)
    by = Window.partitionBy("query_id", "list_no")
    lo, hi = F.min("score").over(by), F.max("score").over(by)
    n = F.when(hi == lo, F.lit(1.0)).otherwise((F.col("score") - lo) / (hi - lo))
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("list_no") + 1)
    rows = with_ordinals(lists).withColumn("s", n * w)
    return rows.groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score"), F.min("ord").alias("ord"))


def cascade(lists: list[DataFrame]) -> DataFrame:
    """Lists one after the other; of an id the first place stays."""
    return with_ordinals(lists).groupBy("query_id", "id").agg(F.min_by("score", "ord").alias("score"), F.min("ord").alias("ord"))


def first_match(lists: list[DataFrame]) -> DataFrame:
    """The first list that has rows for the query."""
    rows = with_ordinals(lists)
    first = rows.groupBy("query_id").agg(F.min("list_no").alias("list_no"))
    return rows.join(first, ["query_id", "list_no"]).select("query_id", "id", "score", "ord")


FUSIONS: dict[str, Callable[[list[DataFrame]], DataFrame]] = {"rrf": rrf, "weighted": weighted, "cascade": cascade, "first_match": first_match}


def register_fusion(name: str, fusion: Callable[[list[DataFrame]], DataFrame]) -> None:
    FUSIONS[name] = fusion


def fuse(lists: list[DataFrame], strategy: str) -> DataFrame:
    """A single list is returned as it is."""
    if len(lists) == 1:
        return lists[0].withColumn("ord", F.col("rank").cast("long")).select("query_id", "id", "score", "ord")
    return FUSIONS[strategy](lists)


def hybrid(docs: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int = 10, strategy: str = "weighted", weights: list[float] | None = None) -> DataFrame:
    """Vector and BM25 lists of k, fused, deduplicated by id, cut to k."""
    lists = [top(nearest(vectors, query_vectors, k), k, "id"), top(bm25(docs, queries), k, "id")]
    fused = weighted(lists, weights) if strategy == "weighted" else fuse(lists, strategy)
    return top(fused, k, "ord")


def words(c):
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))


def token_rerank(hits: DataFrame, n: int) -> DataFrame:
    """hits: query_id, id, query, content, rank (from 1). score = common words + 0.01 (rows of the query - index)."""
    size = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    score = F.size(F.array_intersect(words(F.col("query")), words(F.col("content")))) + 0.01 * (size - (F.col("rank") - 1))
    scored = hits.select("query_id", "id", F.round(score, 6).alias("score"), F.col("rank").alias("ord"))
    return top(scored, n, "ord")


def keep_min_score(ranked: DataFrame, least: float, min_keep: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return ranked.withColumn("rank", F.row_number().over(w)).where((F.col("score") >= least) | (F.col("rank") <= min_keep))


def tag_filter(df: DataFrame, tags_col: str, required: list[str], match_all: bool = False) -> DataFrame:
    if not required:
        return df
    req = F.array(*map(F.lit, required))
    hit = F.size(F.array_except(req, F.col(tags_col))) == 0 if match_all else F.arrays_overlap(F.col(tags_col), req)
    return df.where(F.coalesce(hit, F.lit(False)))


def acl_filter(df: DataFrame, allowed: DataFrame | None, id_col: str = "doc_id") -> DataFrame:
    """Rows of allowed ids and rows without an id; no list, or an empty one, allows all."""
    if allowed is None or allowed.isEmpty():
        return df
    return df.where(F.col(id_col).isNotNull()).join(allowed.select(id_col).distinct(), id_col, "left_semi").unionByName(df.where(F.col(id_col).isNull()))


def time_decay(c, ts, now, half_life_days: float = 90.0):
    """0.5 ^ (age / half life); 1 for unknown or future times and for a half life of 0 or less. 4 digits."""
    if half_life_days <= 0:
        return F.lit(1.0)
    days = (F.unix_micros(now) - F.unix_micros(ts)) / 86_400_000_000
    return F.when(ts.isNull() | (days < 0), F.lit(1.0)).otherwise(F.round(F.pow(F.lit(0.5), days / half_life_days), 4))
