"""Key-value facts: upserts with a list of changes, and conflicts between stored facts and new ones. All are joins by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statements that are certain, then keys that are certain, then keys that are likely.
CERTAIN = [r"(?i)^(我叫|我的名字是|名字是|我是)\s*[一-龥a-zA-Z]{1,20}$", r"(?i)^(我的称呼是|叫我)\s*.+$"]
CERTAIN_KEYS = ["姓名", "名字", "称呼", "语言", "职业", "时区"]
LIKELY_KEYS = ["项目", "输出格式", "偏好"]
STRATEGIES = ("overwrite", "keep_old", "ask_user")


def confidence(key: Column, value: Column) -> Column:
    """0.95 for certain statements, 0.9 and 0.75 for known keys, else 0.6."""
    full = F.when(key == "", value).otherwise(F.concat(key, F.lit(": "), value))
    return F.when(full.rlike(CERTAIN[0]) | full.rlike(CERTAIN[1]), 0.95).when(key.isin(CERTAIN_KEYS), 0.9).when(key.isin(LIKELY_KEYS), 0.75).otherwise(0.6)


def conflicting(old: Column, new: Column) -> Column:
    """Neither holds the other, blanks, marks and case aside; an empty or null value conflicts with nothing."""
    a, b = (F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s\x{3000},，。.、！!？?]+", "") for c in (old, new))
    return (a != "") & (b != "") & ~F.contains(a, b) & ~F.contains(b, a)


def upserted(facts: DataFrame, updates: DataFrame) -> DataFrame:
    """key, old, value, source, changed for facts(key, value, ord) and updates(key, value, source), one update per key. Of a repeated
    fact the first by ord stays; an update that is null or equal to the fact changes nothing; source of a change is user if null."""
    first = facts.groupBy("key").agg(F.min_by("value", "ord").alias("old"))
    new = updates.select("key", F.col("value").alias("new"), "source")
    changed = F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))
    return first.join(new, "key", "full").select("key", "old", F.coalesce("new", "old").alias("value"), F.when(changed, F.coalesce("source", F.lit("user"))).alias("source"), changed.alias("changed"))


def conflicts(facts: DataFrame, deltas: DataFrame, strategy: str = "ask_user", least: float = 0.9) -> DataFrame:
    """A row per delta(key, value) with key and value: key, old_value, new_value, strategy, resolved_value, needs_hitl. facts(key, value)
    has one row per key. A key without a fact is written, and asked about below the least confidence; values that do not conflict
    overwrite; under ask_user a conflict is always asked about, with the new value chosen if it is certain enough."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    d = deltas.select(F.trim(F.coalesce("key", F.lit(""))).alias("key"), F.trim(F.coalesce("value", F.lit(""))).alias("new_value")).where("key <> '' and new_value <> ''")
    rows = d.join(facts.select("key", F.col("value").alias("old")), "key", "left").withColumn("old_value", F.coalesce("old", F.lit("")))
    sure, clash = confidence(F.col("key"), F.col("new_value")) >= least, conflicting(F.col("old_value"), F.col("new_value"))
    keeps = {"overwrite": F.lit(False), "keep_old": F.lit(True), "ask_user": ~sure}[strategy]
    return rows.select(
        "key",
        "old_value",
        "new_value",
        F.when(clash, F.lit(strategy)).otherwise(F.lit("overwrite")).alias("strategy"),
        F.when(clash & keeps, F.col("old_value")).otherwise(F.col("new_value")).alias("resolved_value"),
        F.when(F.col("old_value") == "", ~sure).otherwise(clash & F.lit(strategy == "ask_user")).alias("needs_hitl"),
    )
