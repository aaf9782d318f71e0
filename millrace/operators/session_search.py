"""Search over past sessions in its four forms (discover, read, scroll, browse), and the fused search over online and cold archives.

Tables: messages(message_id, session_id, role, content, ts, redacted), sessions(session_id, tenant_id, user_id, title, source, started_at, parent) and
cold(message_id, session_id, tenant_id, user_id, role, content, ts). Every function takes a table of queries and answers all of them in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import strip, threat
from millrace.operators.evidence import cron_downrank, message_rrf
from millrace.operators.fulltext import MessageIndex, match_terms, phrase_hits, search_messages
from millrace.operators.graph import lineage_roots
from millrace.operators.keyword_index import KeywordIndex
from millrace.operators.retrieval import small
from millrace.work import written

#: Messages that discovery looks at.
SCANNED = 300
UNATTENDED = ("cron", "subagent", "tool")


def linked_session(text: Column) -> Column:
    """The session that a text names as @session:<id> or @session:<profile>/<id>; null without one."""
    found = F.regexp_extract(text, r"(?i)@session:(?:[^/]+/)?([^/\s]+)", 1)
    return F.when(found != "", found)


def roots(sessions: DataFrame) -> DataFrame:
    return lineage_roots(sessions.select(F.col("session_id").alias("id"), "parent")).select(F.col("id").alias("session_id"), "root")


def discover(index: MessageIndex, queries: DataFrame, messages: DataFrame, sessions: DataFrame, limit: int = 3, oldest: bool = False) -> DataFrame:
    """For queries(query_id, text, tenant_id, user_id, current): the best hit of each lineage of sessions but the current session's own,
    unattended sessions down-ranked, with the first and the last message of the hit's session. Up to ten sessions."""
    asked = queries.where(strip(F.coalesce("text", F.lit(""))) != "")
    hits = search_messages(index, asked.select("query_id", "text", "tenant_id", "user_id"), messages, sessions, SCANNED)
    hits = hits.withColumn("score", cron_downrank(F.coalesce("score", F.lit(0.0)), F.coalesce("session_source", F.lit("user"))))
    root = written(roots(sessions), "roots")
    rows = hits.join(root, "session_id")
    own = asked.join(root, F.col("current") == F.col("session_id")).select("query_id", F.col("root").alias("own"))
    rows = rows.join(small(own), "query_id", "left").where(F.col("own").isNull() | (F.col("own") != F.col("root")))
    # of equal scores the one found first counts
    seen = [F.col("ts"), F.col("place")] if oldest else [F.col("place")]
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "root").orderBy(F.desc("score"), *seen))).where("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ts", *seen))
    best = written(one.withColumn("place", place).where(F.col("place") <= max(1, min(limit, 10))), "best")
    ends = messages.join(small(best.select("session_id").distinct()), "session_id").groupBy("session_id").agg(F.min(F.struct("ts", "message_id")).alias("a"), F.max(F.struct("ts", "message_id")).alias("b"))
    ends = ends.select("session_id", F.col("a.message_id").alias("first_id"), F.col("b.message_id").alias("last_id"))
    return best.join(ends, "session_id", "left").select("query_id", "place", "session_id", "root", "message_id", "score", "ts", "first_id", "last_id")


def read_session(queries: DataFrame, messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """For queries(query_id, text, tenant_id, user_id): the messages of the session that the text links to, oldest first, if it is the user's own.
    error says why there are none: invalid link, not found, denied."""
    q = queries.withColumn("session_id", linked_session(F.col("text")))
    s = sessions.select(F.col("session_id").alias("_s"), F.col("tenant_id").alias("_t"), F.col("user_id").alias("_u"))
    q = q.join(s, F.col("session_id") == F.col("_s").cast("string"), "left")
    allowed = F.col("_t").eqNullSafe(F.col("tenant_id")) & F.col("_u").eqNullSafe(F.col("user_id"))
    error = F.when(F.col("session_id").isNull(), "invalid link").when(F.col("_s").isNull(), "not found").when(~allowed, "denied")
    q = q.select("query_id", F.col("_s"), error.alias("error"))
    rows = messages.select(F.col("session_id").alias("_m"), "message_id", "role", "content", "ts")
    out = q.join(rows, (F.col("_s") == F.col("_m")) & F.col("error").isNull(), "left")
    place = F.when(F.col("message_id").isNotNull(), F.row_number().over(Window.partitionBy("query_id").orderBy("ts", "message_id")))
    return out.select("query_id", "error", F.col("_m").alias("session_id"), "message_id", "role", "content", "ts", place.alias("place"))


def scroll_session(queries: DataFrame, messages: DataFrame, sessions: DataFrame, before: int = 5, after: int = 5) -> DataFrame:
    """For queries(query_id, message_id, tenant_id, current): the messages around one of another lineage than the current session's, of a
    session of the tenant."""
    root = written(roots(sessions), "roots")
    at = messages.select(F.col("message_id").alias("anchor"), "session_id", F.col("ts").alias("at"))
    q = queries.select("query_id", F.col("message_id").alias("anchor"), F.col("tenant_id").alias("_t"), "current").join(at, "anchor")
    q = q.join(sessions.select("session_id", "tenant_id"), "session_id").where(F.col("tenant_id") == F.col("_t")).join(root, "session_id")
    own = queries.join(root, F.col("current") == F.col("session_id")).select("query_id", F.col("root").alias("own"))
    q = q.join(own, "query_id", "left").where(F.col("own").isNull() | (F.col("own") != F.col("root"))).select("query_id", "session_id", "anchor", "at")
    order = F.struct(F.col("ts"), F.col("message_id"))
    rows = messages.select("session_id", "message_id", "role", "content", "ts").join(small(q), "session_id").withColumn("past", order < F.struct(F.col("at"), F.col("anchor")))
    here = F.col("message_id") == F.col("anchor")
    near = F.row_number().over(Window.partitionBy("query_id", "past", here).orderBy(F.when(F.col("past"), F.col("ts")).desc(), F.when(F.col("past"), F.col("message_id")).desc(), "ts", "message_id"))
    rows = rows.withColumn("_n", near).where(here | (F.col("_n") <= F.when(F.col("past"), before).otherwise(after)))
    return rows.select("query_id", "session_id", "message_id", "ts", F.row_number().over(Window.partitionBy("query_id").orderBy("ts", "message_id")).alias("place"))


def browse_sessions(queries: DataFrame, messages: DataFrame, sessions: DataFrame, limit: int = 3, each: int = 3, oldest: bool = False) -> DataFrame:
    """For queries(query_id, tenant_id, user_id): of the user's newest `limit` sessions those that were not continued from another one and that a
    person has written, with their last messages, oldest first."""
    s = sessions.join(small(queries.select("query_id", "tenant_id", "user_id")), ["tenant_id", "user_id"])
    by = [F.asc("started_at") if oldest else F.desc("started_at"), F.col("session_id")]
    s = s.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("nth") <= limit)
    s = s.where(F.col("parent").isNull() & ~F.coalesce("source", F.lit("user")).isin(*UNATTENDED)).select("query_id", "session_id", "nth")
    rows = messages.select("session_id", "message_id", "role", "content", "ts").join(small(s), "session_id")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "session_id").orderBy(F.desc("ts"), F.desc("message_id")))).where(F.col("_n") <= each)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "session_id").orderBy("ts", "message_id"))).drop("_n")


def cold_hits(index: KeywordIndex, queries: DataFrame, cold: DataFrame, limit: int) -> DataFrame:
    """query_id, id, rank of the best `limit` archived messages of the query's tenant and user."""
    hits = phrase_hits(index, queries.select("query_id", match_terms(F.col("text")).alias("terms"))).withColumnRenamed("rank", "bm25")
    rows = hits.join(cold.withColumn("id", F.col("message_id").cast("string")), "id").join(small(queries.select("query_id", F.col("tenant_id").alias("_t"), F.col("user_id").alias("_u"))), "query_id")
    rows = rows.where((F.col("tenant_id") == F.col("_t")) & (F.col("user_id") == F.col("_u")))
    w = Window.partitionBy("query_id").orderBy("bm25", F.desc("ts"), F.desc("message_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "id", "rank")


def _fused(lists: list[DataFrame], limit: int) -> DataFrame:
    """query_id, id, rank: lists(query_id, id, rank) by reciprocal ranks; a query that only one list knows keeps its order."""
    keyed = [d.select(F.struct("query_id", "id").alias("id"), "rank") for d in lists]
    rows = message_rrf(keyed).select("id.query_id", "id.id", "score", "ord")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))).where(F.col("rank") <= limit).select("query_id", "id", "rank")


def archive_search(online: list[DataFrame], index: KeywordIndex, queries: DataFrame, cold: DataFrame, limit: int, only_if_empty: bool = False) -> DataFrame:
    """query_id, id, rank, source: ranked lists (query_id, id, rank; text, tools, vectors) fused and cut to `limit`, then with the cold archive fused and
    cut to twice as many. only_if_empty: the archive is asked for those queries alone that the online lists have nothing for."""
    found = written(_fused(online, limit), "online")
    rest = queries.join(found.select("query_id").distinct(), "query_id", "left_anti") if only_if_empty else queries
    archived = written(cold_hits(index, rest, cold, limit), "cold")
    both = _fused([found, archived], 2 * limit)
    sources = found.select("query_id", "id", F.lit("online").alias("source")).unionByName(archived.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", F.lit("cold").alias("source")))
    return both.join(sources, ["query_id", "id"])


def safe(rows: DataFrame, text_col: str = "content") -> DataFrame:
    """Rows whose text holds no threat."""
    return rows.where(threat(F.coalesce(text_col, F.lit(""))).isNull())


__all__ = ["archive_search", "browse_sessions", "cold_hits", "discover", "linked_session", "read_session", "safe", "scroll_session"]
