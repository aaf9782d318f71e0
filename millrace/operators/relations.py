"""Filters, joins, aggregates and set operations over tables of documents, chunks, sessions and messages. DataFrame in, DataFrame out."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from millrace.functions.text import strip
from millrace.work import ordinals


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


# ---- filters ----


def contains_any(text: Column, terms: list[str]) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)), F.lit(False)) if terms else F.lit(False)


def contains_all(texts: list[Column], terms: list[str]) -> Column:
    """Whether each term is in one of the texts, case aside."""
    low = [F.lower(F.coalesce(t, F.lit(""))) for t in texts]
    hit = [F.lit(False)]
    out = F.lit(True)
    for term in terms:
        one = hit[0]
        for t in low:
            one = one | t.contains(term.lower())
        out = out & one
    return out


def keyword_rule(text: Column, words: list[str], match: str = "any") -> Column:
    """ASCII words by case-insensitive substring, others exactly; no words match nothing."""
    if not words:
        return F.lit(False)
    low = F.lower(text)
    hits = [low.contains(w.lower()) if w.isascii() else text.contains(w) for w in words]
    out = hits[0]
    for h in hits[1:]:
        out = out & h if match == "all" else out | h
    return F.coalesce(out, F.lit(False))


def rule_tags(text: Column, rules: list[tuple[str, list[str], str, list[str]]], existing: Column, path: Column, extensions: dict[str, list[str]] | None = None, most: int = 32) -> tuple[Column, Column]:
    """(tags, matched rules) of a document. rules: (name, words, any or all, tags). Existing tags first (see listed_tags), then those of the rules in order, file:<stem> for a stem of 64 characters at most, and those of the extension; stripped,
    distinct, not empty, `most` at most."""
    none = F.expr("cast(array() as array<string>)")
    found = [F.when(keyword_rule(text, words, match), F.array(*map(F.lit, tags))).otherwise(none) for _, words, match, tags in rules]
    names = F.array_compact(F.array(*[F.when(keyword_rule(text, words, match), F.lit(name)) for name, words, match, _ in rules])) if rules else none
    file = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    by_file = F.when((file != "") & (F.length(file) <= 64), F.array(F.concat(F.lit("file:"), file))).otherwise(none)
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    by_ext = none
    for e, tags in (extensions or {}).items():
        by_ext = F.when(ext == e, F.array(*map(F.lit, tags))).otherwise(by_ext)
    every = F.transform(F.concat(F.coalesce(existing, none), *found, by_file, by_ext), strip)
    return F.slice(F.array_distinct(F.filter(every, lambda t: t.isNotNull() & (t != ""))), 1, most), names


def listed_tags(tags: Column) -> Column:
    """Tags that are given as one string between ; , or |."""
    return F.split(F.coalesce(tags, F.lit("")), "[;,|]+")


def expired_sessions(sessions: DataFrame, now: Column, days: int) -> DataFrame:
    """Sessions that are not active and ended (or, if unknown, began) more than `days` ago."""
    return sessions.where((F.col("status") != "active") & (F.coalesce("ended_at", "started_at") < now - F.expr(f"INTERVAL {int(days)} DAYS")))


def reindexable(messages: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Messages with text that are not redacted, by time; a page of them if a limit is given."""
    rows = messages.where(~F.coalesce("redacted", F.lit(False)) & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    return rows if limit is None else rows.orderBy("ts", "message_id").offset(offset).limit(limit)


def satisfactory(hits: DataFrame, least: float = 0.75) -> DataFrame:
    """query_id, satisfactory: whether the best score reaches the threshold."""
    return hits.groupBy("query_id").agg((F.max("score") >= least).alias("satisfactory"))


def visible_skills(skills: DataFrame, tenant: str, channel: str | None = None) -> DataFrame:
    """Skills of a tenant (or of none) that are not deprecated, on a channel if one is given."""
    ok = (F.size("tenants") == 0) | F.array_contains("tenants", tenant)
    if channel is not None:
        ok = ok & ((F.size("channels") == 0) | F.array_contains("channels", channel))
    return skills.where(ok & (F.coalesce("status", F.lit("active")) != "deprecated"))


@F.pandas_udf(IntegerType())
def patterns_found(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    """How many of the row's patterns are found in its text, case aside."""
    known: dict[str, re.Pattern | None] = {}

    def compiled(p: str) -> re.Pattern | None:
        if p not in known:
            try:
                known[p] = re.compile(p, re.IGNORECASE)
            except re.error:
                known[p] = None
        return known[p]

    return pd.Series([sum(1 for p in ([] if ps is None else ps) if p is not None and (c := compiled(p)) and c.search(t or "")) for t, ps in zip(texts, patterns, strict=True)], dtype="int32")


def skill_score(query: Column, triggers: Column, patterns: Column, title: Column, summary: Column) -> Column:
    """1 for each trigger that holds the query, 2 for each pattern that it matches, 2 for the title, 1 for the summary; case aside. Patterns
    come from skill files, in Python's form; a faulty one counts as no match."""
    q = F.lower(query)
    in_triggers = F.size(F.filter(triggers, lambda t: F.contains(F.lower(t), q)))
    return in_triggers + 2 * patterns_found(query, patterns) + F.when(F.contains(F.lower(title), q), 2).otherwise(0) + F.when(F.contains(F.lower(F.coalesce(summary, title)), q), 1).otherwise(0)


def owned_by(docs: DataFrame, user: str, meta_col: str = "metadata") -> DataFrame:
    """Documents whose JSON metadata names the user: user_id, else owner_id, else uploaded_by."""
    owner = F.coalesce(*[F.nullif(F.get_json_object(meta_col, f"$.{k}"), F.lit("")) for k in ("user_id", "owner_id", "uploaded_by")])
    return docs.where(owner == user)


# ---- joins ----


def with_sessions(rows: DataFrame, sessions: DataFrame, tenant: str | None = None, user: str | None = None) -> DataFrame:
    """Rows (messages or tool calls) of known sessions, of a tenant and user if given."""
    s = sessions
    if tenant is not None:
        s = s.where(F.col("tenant_id") == tenant)
    if user is not None:
        s = s.where(F.col("user_id") == user)
    return rows.join(s, "session_id")


def parents_of(hits: DataFrame, parents: DataFrame, most: int = 5) -> DataFrame:
    """Hits (query_id, id, parent_id, score) in order of score, with the parent's text in place of the first hit of each of the first `most`
    parents found (expanded, text); further hits of these parents go. Hits without a parent, with one that is not in parents (parent_id,
    text) or has no text, and those of later parents stay as they are. rank: place in the outcome."""
    order = [F.desc("score"), "id"]
    known = parents.where("text <> ''").select("parent_id", "text")
    rows = hits.join(known, "parent_id", "left")
    family = Window.partitionBy("query_id", "parent_id").orderBy(*order)
    first = F.col("text").isNotNull() & (F.row_number().over(family) == 1)
    rows = rows.withColumn("first", first)
    so_far = F.sum(F.col("first").cast("int")).over(Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("number", F.when(F.col("first"), so_far))
    rows = rows.withColumn("number", F.first("number", ignorenulls=True).over(family))
    taken = F.col("text").isNotNull() & (F.col("number") <= most)
    kept = rows.withColumn("expanded", taken).where("first or not expanded")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return kept.select("query_id", "id", "parent_id", "score", rank.alias("rank"), "expanded", F.when(F.col("expanded"), F.col("text")).alias("parent_text"))


def unchanged(chunks: DataFrame, previous: DataFrame) -> DataFrame:
    """Chunks (chunk_id, fingerprint) with `same`: whether the index has this fingerprint already."""
    p = previous.select("chunk_id", F.col("fingerprint").alias("old"))
    return chunks.join(p, "chunk_id", "left").withColumn("same", F.col("fingerprint").eqNullSafe(F.col("old")) & F.col("old").isNotNull()).drop("old")


def orphans(existing: DataFrame, current: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of the index whose key the current set lacks."""
    return existing.join(current.select(key).distinct(), key, "left_anti")


def superseded(files: DataFrame) -> DataFrame:
    """Rows of files(tenant_id, filename, md5, indexed_at) that a later row of the same name and another md5 replaces."""
    w = Window.partitionBy("tenant_id", "filename").orderBy(F.desc("indexed_at"), F.desc("md5"))
    return files.withColumn("newest", F.first("md5").over(w)).where("md5 <> newest")


def interval_join(points: DataFrame, spans: DataFrame, at: str, begin: str, end: str, width: float) -> DataFrame:
    """Points within spans [begin, end], by equality of buckets of `width`: a span is dealt to its buckets, a point to one, so no pair of
    other buckets meets."""
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor(F.col(end) / width))))
    return p.join(s, "_bucket").where((F.col(at) >= F.col(begin)) & (F.col(at) <= F.col(end))).drop("_bucket")


def asof_join(left: DataFrame, right: DataFrame, key: str, on: str, value: str) -> DataFrame:
    """left with the value of the last row of right at or before its time, of the same key: one sort of both together, no pairs."""
    rows = left.select(key, on, F.struct(*left.columns).alias("_row"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).union(
        right.select(key, on, F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType), F.lit(0), F.col(value))
    )
    w = Window.partitionBy(key).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", F.col("_last").alias(value))


# ---- aggregates ----


def threads(checkpoints: DataFrame, limit: int | None = None) -> DataFrame:
    """thread_id, session_id, last_at, n of checkpoints(thread_id, session_id, created_at); with a limit the latest threads."""
    out = checkpoints.groupBy("thread_id", "session_id").agg(F.max("created_at").alias("last_at"), F.count(F.lit(1)).alias("n"))
    return out if limit is None else out.orderBy(F.desc("last_at"), "thread_id", "session_id").limit(limit)


def metric_stats(metrics: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """name, n, total, mean, least, most of metrics(name, value), of names with one of the prefixes if any are given."""
    rows = metrics
    if prefixes:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.col("name").startswith(p)
        rows = rows.where(hit)
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


def message_counts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    n = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"))
    return sessions.join(n, "session_id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))


def positive_mean(c: str, digits: int = 2) -> Column:
    """Mean of the values above 0; 0 without any."""
    return F.coalesce(F.round(F.avg(F.when(F.col(c) > 0, F.col(c))), digits), F.lit(0.0))


def eval_summary(rows: DataFrame, latencies: list[str], scores: list[str]) -> DataFrame:
    """One row: samples, failures (error not null), means of latencies above 0 and of the scores of rows without error."""
    ok = F.col("error").isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(~ok).alias("failures"),
        *(positive_mean(c).alias(f"{c}_mean") for c in latencies),
        *(F.round(F.avg(F.when(ok, F.col(c))), 4).alias(f"{c}_mean") for c in scores),
    )


def kv_match(extracted: Column, expected: Column) -> Column:
    """Share of the expected pairs whose key is there with a value that holds the expected one; 1 without expectations."""
    pairs = F.map_entries(expected)

    def hit(e: Column) -> Column:
        got, want = F.trim(F.coalesce(F.element_at(extracted, e["key"]), F.lit(""))), F.trim(e["value"])
        return (got == want) | ((want != "") & F.contains(got, want))

    return F.when(F.size(pairs) == 0, F.lit(1.0)).otherwise(F.size(F.filter(pairs, hit)) / F.size(pairs))


def page_route(chars: Column, area: Column, encrypted: Column | None = None, native_chars: int = 50, native_density: float = 0.0005, scan_chars: int = 10, scan_density: float = 0.0001) -> Column:
    """native, scan or hybrid by a page's characters and their density."""
    density = chars / F.greatest(area, F.lit(1.0))
    out = F.when((chars >= native_chars) & (density >= native_density), F.lit("native")).when((chars <= scan_chars) & (density <= scan_density), F.lit("scan")).otherwise(F.lit("hybrid"))
    return out if encrypted is None else F.when(encrypted, F.lit("scan")).otherwise(out)


def doc_routes(pages: DataFrame) -> DataFrame:
    """doc_id, route of pages(doc_id, route): one kind only gives that kind (native and scan), else hybrid."""
    kinds = F.collect_set("route")
    return pages.groupBy("doc_id").agg(F.when(F.size(kinds) > 1, F.lit("hybrid")).otherwise(F.element_at(kinds, 1)).alias("route"))


def page_quality(regions: DataFrame, low: float = 0.6, retry_ratio: float = 0.3, fail_ratio: float = 0.6) -> DataFrame:
    """doc_id, page, regions, low_regions, low_ratio, verdict of regions(doc_id, page, confidence)."""
    out = regions.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("regions"), F.count_if(F.col("confidence") < low).alias("low_regions"))
    ratio = F.round(F.col("low_regions") / F.col("regions"), 4)
    return out.withColumn("low_ratio", ratio).withColumn("verdict", F.when(ratio >= fail_ratio, F.lit("fail")).when(ratio >= retry_ratio, F.lit("retry")).otherwise(F.lit("pass")))


def quality_summary(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count_if(F.col("verdict") == "pass").alias("passed"), F.count_if(F.col("verdict") == "fail").alias("failed"), F.count_if(F.col("verdict") == "retry").alias("retried"))


def waterfall(spans: DataFrame, slow_ms: float = 2000.0) -> DataFrame:
    """spans(trace_id, node, ms) with the trace's total, the share in percent (1 digit) and whether the node is slow."""
    total = F.sum("ms").over(Window.partitionBy("trace_id"))
    return spans.withColumn("total_ms", F.round(total, 4)).withColumn("pct", F.when(total > 0, F.round(100 * F.col("ms") / total, 1)).otherwise(0.0)).withColumn("slow", F.col("ms") > slow_ms)


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


# ---- order, limits, sets ----


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def top_distinct(hits: DataFrame, k: int) -> DataFrame:
    """The best k of each query after the best row of each id (of its first 80 characters, if it has none)."""
    best = first_by(hits.withColumn("_key", F.coalesce("id", F.substring("content", 1, 80))), ["query_id", "_key"], F.desc("score"), "ord")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_key")


def max_union(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Of both tables (key, score) the higher score of each key; the first table wins ties."""
    rows = a.select(key, "score", F.lit(0).alias("source")).union(b.select(key, "score", F.lit(1).alias("source")))
    return first_by(rows, [key], F.desc("score"), "source")


def cut_sets(a: Column, b: Column) -> Column:
    """struct of confirmed (in both), weak_a and weak_b cuts."""
    return F.struct(F.array_intersect(a, b).alias("confirmed"), F.array_except(a, b).alias("weak_a"), F.array_except(b, a).alias("weak_b"))


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return first_by(df, keys, *[F.desc(c) for c in order])


def merged_listing(online: DataFrame, cold: DataFrame, limit: int = 100) -> DataFrame:
    """Sessions of both stores (session_id, status, started_at, ended_at), online rows first; the latest `limit`. storage: cold for archived
    ones, online_closed for closed ones, else online."""
    rows = online.withColumn("_o", F.lit(0)).unionByName(cold.withColumn("_o", F.lit(1)))
    one = first_by(rows, ["session_id"], "_o")
    storage = F.when((F.col("_o") == 1) | (F.col("status") == "archived"), F.lit("cold")).when(F.col("status") == "closed", F.lit("online_closed")).otherwise(F.lit("online"))
    return one.withColumn("storage", storage).drop("_o").orderBy(F.desc(F.coalesce("started_at", "ended_at")), "session_id").limit(limit)


def distinct_ids(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows in the order given; an id that occurred before gets -dup and its place in the whole list, from 0. A later id that is spelled
    like such a name counts as having occurred, too."""
    rows = ordinals(df, *order).withColumn("_id", F.col(key).cast("string"))
    again = F.row_number().over(Window.partitionBy("_id").orderBy("_place")) > 1
    made = F.concat("_id", F.lit("-dup"), F.col("_place").cast("string"))
    rows = rows.withColumns({"_again": again, "_made": made})
    spelled = rows.where("_again").select(F.col("_made").alias("_id"), F.col("_place").alias("_since"))
    rows = rows.join(spelled, "_id", "left")
    seen = F.col("_again") | F.coalesce(F.col("_since") < F.col("_place"), F.lit(False))
    return rows.withColumn(key, F.when(seen, F.col("_made")).otherwise(F.col("_id"))).select(*df.columns)


def merged_tags(*tags: Column, most: int = 32) -> Column:
    return F.slice(F.array_distinct(F.concat(*tags)), 1, most)


def deduped(df: DataFrame, fields: list[str], order: str) -> DataFrame:
    """The first row of each combination of the fields (md5 of their values joined by ||; null is empty)."""
    key = F.md5(F.concat_ws("||", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))
    return first_by(df.withColumn("_key", key), ["_key"], order).drop("_key")


def anonymised(rows: DataFrame, users: DataFrame, columns: list[str], mark: str = "[ANONYMISED]") -> DataFrame:
    """The columns of rows of the users (user_id) get the mark; other rows stay."""
    u = users.select("user_id").distinct().withColumn("_gone", F.lit(True))
    out = rows.join(u, "user_id", "left")
    return out.withColumns({c: F.when(F.col("_gone"), F.lit(mark)).otherwise(F.col(c)) for c in columns}).drop("_gone")


def child_title(title: Column) -> Column:
    """The title of a continued session: ` #n` counts up, from 2."""
    n = F.regexp_extract(title, r" #([0-9]+)$", 1)
    return F.when(n != "", F.concat(F.regexp_replace(title, r"[0-9]+$", ""), (n.cast("long") + 1).cast("string"))).otherwise(F.concat(title, F.lit(" #2")))


def cold_rows(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """What an archived session keeps: messages with text that are not redacted, and tool calls as `name: summary`."""
    m = reindexable(messages).select("session_id", "ts", F.lit("message").alias("kind"), "content")
    t = tools.select("session_id", "ts", F.lit("tool").alias("kind"), F.concat_ws(": ", "tool_name", "summary").alias("content"))
    return m.unionByName(t)


def resolved(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """mention, canonical_id by names(ord, alias, canonical_id, display_name): the exact alias, else the first in order whose alias or
    display name holds the mention, case aside. Names are found by the mention's first three characters (all of it, if shorter), which
    names are filed under wherever these stand in them, and then compared in full. Without ord, the order is that of aliases."""
    names = names if "ord" in names.columns else names.withColumn("ord", F.col("alias"))
    exact = mentions.distinct().join(names.select(F.col("alias").alias("mention"), "canonical_id", "ord"), "mention").groupBy("mention").agg(F.min_by("canonical_id", "ord").alias("canonical_id"))
    rest = mentions.distinct().join(exact, "mention", "left_anti").withColumn("low", F.lower("mention"))

    def grams(c: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
        return F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(*[F.substring(c, i, F.lit(n)) for n in (1, 2, 3)]))))

    texts = names.select("ord", "canonical_id", F.explode(F.array(F.lower("alias"), F.lower(F.coalesce("display_name", "alias")))).alias("name"))
    filed = texts.select("ord", "canonical_id", "name", F.explode(grams(F.col("name"))).alias("gram"))
    near = rest.withColumn("gram", F.substring("low", 1, 3)).join(filed, "gram").where(F.contains("name", "low"))
    return exact.unionByName(near.groupBy("mention").agg(F.min_by("canonical_id", "ord").alias("canonical_id")))


def reading_order(boxes: DataFrame, page_width: float) -> DataFrame:
    """boxes(page, box, x0, y0, x1, y1) with their place: in two columns if a page has four boxes or more and the smaller side at least
    15 % of the larger, else in one; from top to bottom, then left to right."""
    p = Window.partitionBy("page")
    right = (F.col("x0") + F.col("x1")) / 2 >= page_width / 2
    n, n_right = F.count(F.lit(1)).over(p), F.count_if(right).over(p)
    least, most = F.least(n_right, n - n_right), F.greatest(n_right, n - n_right)
    column = F.when((n >= 4) & (least > 0) & (least / most >= 0.15) & right, 1).otherwise(0)
    rows = boxes.withColumn("column", column)
    w = p.orderBy("column", (F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2, "box")
    return rows.withColumn("place", F.row_number().over(w))
