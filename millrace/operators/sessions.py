"""Conversation operators: windows over the turns of a session (columns session, ts, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import strip


def by_time():
    return Window.partitionBy("session").orderBy("ts", "role", "text")


def by_time_desc():
    return Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("role"), F.desc("text"))


def scroll(messages: DataFrame, anchors: DataFrame, before: int, after: int) -> DataFrame:
    """Rows around an anchor (session, ts) of the same session; the anchors' sessions only are sorted."""
    a = anchors.select("session", F.col("ts").alias("anchor_ts"))
    rows = messages.join(a.select("session").distinct(), "session", "left_semi").withColumn("pos", F.row_number().over(by_time()))
    at = rows.join(a, "session").where("ts = anchor_ts").groupBy("session", "anchor_ts").agg(F.min("pos").alias("at"))
    return rows.join(at, "session").where((F.col("pos") >= F.col("at") - before) & (F.col("pos") <= F.col("at") + after)).select("session", "anchor_ts", "ts", "role", "pos")


def bookends(messages: DataFrame) -> DataFrame:
    """First and last text by ts; equal times go by role, then text."""
    turn = F.struct("ts", "role", "text")
    return messages.groupBy("session").agg(F.min(turn).alias("a"), F.max(turn).alias("z"), F.count(F.lit(1)).alias("n")).select("session", F.col("a.text").alias("first_text"), F.col("z.text").alias("last_text"), "n")


def last_n(messages: DataFrame, n: int) -> DataFrame:
    return messages.withColumn("rn", F.row_number().over(by_time_desc())).where(F.col("rn") <= n).drop("rn")


def recent_user(messages: DataFrame, limit: int) -> DataFrame:
    """Of each user text its earliest place; the last `limit` of these."""
    first = messages.where("role = 'user'").groupBy("session", "text").agg(F.min("ts").alias("ts"))
    w = Window.partitionBy("session").orderBy(F.desc("ts"), "text")
    return first.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)


def without_repeats(messages: DataFrame) -> DataFrame:
    """Drops a turn equal (stripped) to the one before it, and empty turns."""
    full = messages.withColumn("said", strip(F.col("text"))).where("said <> ''")
    same = F.lag("role").over(by_time()).eqNullSafe(F.col("role")) & F.lag("said").over(by_time()).eqNullSafe(F.col("said"))
    return full.withColumn("same", same).where("not same").drop("same", "said")


def tail_budget(messages: DataFrame, chars: int, overhead: int = 8) -> DataFrame:
    """Newest turns whose running cost fits; the newest always."""
    w = by_time_desc().rowsBetween(Window.unboundedPreceding, 0)
    rows = messages.withColumn("cost", F.sum(F.length("text") + overhead).over(w)).withColumn("rn", F.row_number().over(by_time_desc()))
    return rows.where((F.col("cost") <= chars) | (F.col("rn") == 1))


def split_recent(messages: DataFrame, turns: int) -> DataFrame:
    return messages.withColumn("part", F.when(F.row_number().over(by_time_desc()) <= 2 * turns, F.lit("recent")).otherwise(F.lit("older")))


def collapsed(messages: DataFrame) -> DataFrame:
    """Of user turns of a session that are equal when stripped, the latest stays; other turns all."""
    w = Window.partitionBy("session", "role", "said").orderBy(F.desc("ts"))
    rows = messages.withColumn("said", strip(F.coalesce("text", F.lit(""))))
    return rows.withColumn("nth", F.row_number().over(w)).where("role <> 'user' or nth = 1").drop("nth", "said")


def zones(messages: DataFrame, tokens: int, head_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """messages with zone: head (leading system turns and the first user turn), tail (the newest turns whose token estimates fit, at least
    one), middle."""
    w = by_time()
    other = F.sum(F.when(F.col("role").isin(*head_roles), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first_user = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    head = (other == 0) | ((F.col("role") == "user") & (first_user == 1))
    cost = F.sum(F.floor(F.length("text") / 4)).over(by_time_desc().rowsBetween(Window.unboundedPreceding, 0))
    newest = F.row_number().over(by_time_desc()) == 1
    return messages.withColumn("zone", F.when(head, F.lit("head")).when((cost <= tokens) | newest, F.lit("tail")).otherwise(F.lit("middle")))


def without_running_lines(pages: DataFrame, threshold: float = 0.3, least: int = 3) -> DataFrame:
    """pages(doc, page, text) without the lines that stand on more than `threshold` of the document's pages (headers and footers; of `least`
    characters or more, stripped). Documents of one page stay as they are."""
    lines = pages.select("doc", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    key = F.trim(F.regexp_replace("line", r"^[ \t\r\f\x0b]+|[ \t\r\f\x0b]+$", ""))
    total = pages.groupBy("doc").agg(F.count_distinct("page").alias("n"))
    often = lines.withColumn("k", key).where(F.length("k") >= least).groupBy("doc", "k").agg(F.count_distinct("page").alias("on")).join(total, "doc").where((F.col("n") >= 2) & (F.col("on") > threshold * F.col("n")))
    kept = lines.withColumn("k", key).join(often.select("doc", "k"), ["doc", "k"], "left_anti")
    whole = kept.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("kept"))
    return pages.select("doc", "page").distinct().join(whole, ["doc", "page"], "left").select("doc", "page", F.coalesce("kept", F.lit("")).alias("text"))


# ---- tool calls and their results ----


def pruned_results(messages: DataFrame, least: int = 200, placeholder: str = "[tool result truncated]") -> DataFrame:
    """messages(session, ts, role, text, in_tail) with tool results of more than `least` characters, outside of the tail, replaced; pruned says
    which."""
    cut = (F.col("role") == "tool") & ~F.col("in_tail") & (F.length(F.coalesce("text", F.lit(""))) > least)
    return messages.withColumn("pruned", F.coalesce(cut, F.lit(False))).withColumn("text", F.when(F.col("pruned"), placeholder).otherwise(F.col("text")))


def repaired_pairs(messages: DataFrame, stub: str = "[tool result missing after compression]") -> DataFrame:
    """messages(session, ts, role, text, calls array<string>, call_id) in which each tool result follows, with nothing but other results
    between, a turn of the assistant that made its call. Other results go; calls without a result get a stub after those that are there.
    Columns: those of messages and place."""
    block = F.sum((F.col("role") != "tool").cast("int")).over(Window.partitionBy("session").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    none = F.array().cast("array<string>")
    made = F.when((F.col("role") == "assistant"), F.filter(F.coalesce("calls", none), lambda c: c.isNotNull() & (c != ""))).otherwise(none)
    rows = messages.withColumn("_block", block).withColumn("_made", F.when(F.col("role") != "tool", made))
    # the calls of the turn that opens a block, for all of it
    by_ts = Window.partitionBy("session", "_block").orderBy("ts")
    rows = rows.withColumn("_made", F.first("_made", ignorenulls=True).over(by_ts))
    rows = rows.where((F.col("role") != "tool") | F.array_contains("_made", F.col("call_id")))
    # a block's last row brings the stubs
    seen = F.collect_set(F.when(F.col("role") == "tool", F.col("call_id"))).over(by_ts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumns({"_seen": seen, "_last": F.lead(F.lit(1)).over(by_ts).isNull()})
    lost = F.when(F.col("_last"), F.coalesce(F.array_except("_made", "_seen"), none)).otherwise(none)
    whole = rows.select(*messages.columns, "_block", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), lost)).alias("_nth", "_lost"))
    fixed = {"role": F.lit("tool"), "text": F.lit(stub), "calls": none, "call_id": F.col("_lost")}
    place = F.row_number().over(Window.partitionBy("session").orderBy("_block", "ts", "_nth"))
    whole = whole.withColumn("place", place)
    own = [F.col(c) if c in ("session", "ts") else F.when(F.col("_nth") == 0, F.col(c)).otherwise(fixed.get(c, F.lit(None))).alias(c) for c in messages.columns]
    return whole.select(*own, "place")


def worth_compressing(before: DataFrame, after: DataFrame, least: float = 0.1) -> DataFrame:
    """session, tokens_before, tokens_after, savings, kept: whether the shorter form (session, text) saves `least` of the tokens; else the
    session keeps its turns, so that small gains do not make it change again and again."""

    def tokens(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("session").agg(F.sum(F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)).alias(name))

    both = tokens(before, "tokens_before").join(tokens(after, "tokens_after"), "session", "left")
    short = F.coalesce("tokens_after", F.lit(0))
    savings = F.when(F.col("tokens_before") > 0, (F.col("tokens_before") - short) / F.col("tokens_before")).otherwise(0.0)
    return both.select("session", "tokens_before", short.alias("tokens_after"), F.round(savings, 6).alias("savings"), (savings >= least).alias("kept"))
