"""What happens to hits between search and prompt: boosts, fusion of messages and of recall with knowledge, fingerprints, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import strip


def message_rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """id, score, ord of lists(id, rank): sum of 1 / (k + rank); empty ids do not count, ties go by first place seen."""
    parts = [d.where("id is not null and cast(id as string) <> ''").select("id", "rank", (F.lit(i).cast("long") * (1 << 40) + F.col("rank")).alias("ord")) for i, d in enumerate(lists)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"), F.min("ord").alias("ord"))


def term_share(text: Column, terms: Column) -> Column:
    """Share of the terms that the text holds, case aside; 0 without terms."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t)))) / F.size(terms)).otherwise(0.0)


def words_of(query: Column) -> Column:
    return F.filter(F.split(F.lower(strip(query)), r"\s+"), lambda x: x != "")


def message_rerank(hits: DataFrame, limit: int) -> DataFrame:
    """hits(query_id, id, query, content, rank) by the share of the query's words; equal shares keep their order."""
    rows = hits.withColumn("score", F.round(term_share(F.col("content"), words_of(F.col("query"))), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def cron_downrank(score: Column, source: Column, factor: float = 0.35) -> Column:
    """Hits of sessions that no person wrote count less."""
    return F.when(source.isin("cron", "subagent", "tool"), score * factor).otherwise(score)


def user_fallback(messages: DataFrame, query: str, limit: int, session: str | None = None, each: bool = False) -> DataFrame:
    """What stands in when a search found no user turn: of the latest min(300, 40 * limit) messages (message_id, session_id, role, content,
    ts) of any role, of one session or of all, those of the user that hold a word of the query (two characters or more, case counts):
    most words first, then the earliest, `limit` at most. A query without such words gives the latest user turns. each: the search
    stays within a session and is made in every session."""
    rows = messages if session is None else messages.where(F.col("session_id") == session)
    by = Window.partitionBy("session_id")

    def first(df: DataFrame, n: int, *order) -> DataFrame:
        if not each:
            return df.orderBy(*order).limit(n)
        return df.withColumn("_n", F.row_number().over(by.orderBy(*order))).where(F.col("_n") <= n).drop("_n")

    latest = (F.desc("ts"), F.desc("message_id"))
    recent = first(rows, min(300, 40 * limit), *latest).where("role = 'user'")
    terms = [t for t in query.split() if len(t) >= 2]
    if not terms:
        return first(recent.withColumn("hits", F.lit(0)), limit, *latest)
    hits = sum((F.contains(F.coalesce("content", F.lit("")), F.lit(t)).cast("int") for t in terms), F.lit(0))
    return first(recent.withColumn("hits", hits).where("hits > 0"), limit, F.desc("hits"), "ts", F.desc("message_id"))


def fingerprint(text: Column, chars: int = 100) -> Column:
    """12 digits of the md5 of the first characters, stripped and in lower case."""
    return F.substring(F.md5(F.substring(F.lower(strip(text)), 1, chars)), 1, 12)


def fused_lines(recall: DataFrame, knowledge: DataFrame, weights: tuple[float, float] = (0.6, 0.4), least: int = 5, most_lines: int = 20, chars: int = 6000, items: int = 10) -> DataFrame:
    """Lines of both sources' texts (query_id, text) as evidence: lines of `least` characters or more, the first most_lines of a source;
    of equal fingerprints the one of greater weight; by weight, then place, until `items` or `chars` are reached."""

    def lines(df: DataFrame, source: str, weight: float) -> DataFrame:
        rows = df.select("query_id", F.posexplode(F.slice(F.filter(F.transform(F.split("text", "\n"), strip), lambda x: F.length(x) >= least), 1, most_lines)).alias("pos", "line"))
        return rows.withColumns({"source": F.lit(source), "weight": F.lit(weight)})

    rows = lines(recall, "recall", weights[0]).unionByName(lines(knowledge, "rag", weights[1])).withColumn("print", fingerprint(F.col("line")))
    one = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "print").orderBy(F.desc("weight"), "pos"))).where("nth = 1")
    w = Window.partitionBy("query_id").orderBy(F.desc("weight"), "pos", "line")
    placed = one.withColumn("place", F.row_number().over(w)).withColumn("used", F.sum(F.length("line")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.where((F.col("place") <= items) & (F.col("used") <= chars)).select("query_id", "place", "source", "weight", "line", "print")


def budgeted(blocks: DataFrame, chars: int = 4000, items: int = 5, least_part: int = 80) -> DataFrame:
    """blocks(query_id, rank, text) until the budget is used: whole blocks, then a part of the next one if more than least_part are left."""
    w = Window.partitionBy("query_id").orderBy("rank")
    rows = blocks.where(F.col("rank") <= items).withColumn("before", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("text"))
    left = F.lit(chars) - F.col("before")
    shown = F.when(F.length("text") <= left, F.col("text")).when(left > least_part, F.substring(F.col("text"), F.lit(1), left.cast("int")))
    return rows.withColumn("shown", shown).where("shown is not null").select("query_id", "rank", "shown", (F.length("shown") < F.length("text")).alias("cut"))


def with_ranks(hits: DataFrame, *order) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def rerank_min_score(hits: DataFrame, least: float, reranked: bool = True) -> DataFrame:
    """Hits above the threshold, if a reranker has run."""
    return hits.where(F.col("score") > least) if reranked else hits


def sql_retrieval(docs: DataFrame, queries: DataFrame, most_words: int = 5) -> DataFrame:
    """query_id, doc_id, score of queries(query_id, entities, words): documents whose id is one of the entities (1.0); for queries without
    any, documents whose text holds one of the first words (0.8)."""
    q = queries.select("query_id", "entities", F.slice("words", 1, most_words).alias("words"))
    exact = q.select("query_id", F.explode("entities").alias("e")).join(docs.select("doc_id", F.col("doc_id").cast("string").alias("e")), "e").select("query_id", "doc_id", F.lit(1.0).alias("score")).distinct()
    rest = q.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    held = docs.select("doc_id", F.lower("text").alias("low"))
    near = held.join(F.broadcast(rest), F.exists("words", lambda w: F.contains("low", F.lower(w)))).select("query_id", "doc_id", F.lit(0.8).alias("score"))
    return exact.unionByName(near)
