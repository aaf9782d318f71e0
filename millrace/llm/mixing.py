"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources share `total` times all words by weight; a source whose share is above `cap` times its words gets just that, and the
excess is shared again. Expected copies: within a source they are proportional to a document's preference (a small whole number), up to
`cap`, and fill the target. Their whole parts are certain copies. The rest is a sample without replacement in which a document's inclusion
probability p is the fraction: each document draws a uniform u from a hash of its id and text, documents are ranked by the Pareto key
(u / (1 - u)) / (p / (1 - p)), and the first ones are taken. The sample's size is fixed in words: it ends before the document with which the
source would pass its target. What is left then (less than that document) is filled in the same order with documents of at most half of
it, again and again, and at last with the one document that brings the source nearest, until the target is met within `tolerance`.

A decision depends on a row and its source's few rules alone, so texts are never shuffled: sizes are counted once, cutoffs are found on
narrow rows by digits of the key (a table of sources by 8192 digits at each step), and a second pass takes the documents. Tables of a row for
each source are written, so Spark knows their size and broadcasts them only where they are small.

Defined results: null text has no words; null is a source of its own, the last; documents without words are never taken; rows that agree
in source, id and text draw the same number and share their fate; an empty table gives an empty mix. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import attached, pick, stored

#: Preferences are whole numbers up to this, so that a source has so many classes at most.
MOST_PREFERENCE = 64
#: Keys have so many bits, found in two digits of DIGIT bits and a rest.
KEY_BITS, DIGIT = 52, 13
EDGE = 1 << 62


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def longer_first(size: Column) -> Column:
    """A mild preference for long documents: the number of binary digits of their size."""
    return F.length(F.bin(size))


def waterfill(table: DataFrame, by: list[str], share: str, cap: str, total: str) -> DataFrame:
    """table with `amount`: total split by share within each group, none above its cap; what a cap leaves over is shared again. Rows have a
    positive share."""
    w = Window.partitionBy(*by).orderBy(F.col(cap) / F.col(share), share)
    upto, rest = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = table.withColumns({"_caps": F.sum(cap).over(upto) - F.col(cap), "_shares": F.sum(share).over(rest)})
    # by rising cap for each share, a row is at its cap if its part of what those before it leave is no less
    t = t.withColumn("_full", F.min(F.col(cap) * F.col("_shares") <= (F.col(total) - F.col("_caps")) * F.col(share)).over(upto))
    every = Window.partitionBy(*by)
    full, free = F.sum(F.when(F.col("_full"), F.col(cap)).otherwise(0.0)).over(every), F.sum(F.when(~F.col("_full"), F.col(share))).over(every)
    return t.withColumn("amount", F.when(F.col("_full"), F.col(cap)).otherwise((F.col(total) - full) * F.col(share) / free)).drop("_caps", "_shares", "_full")


class Plan:
    """Tables of a mix: rows (name, doc_id, size, preference, draw), sources (name, source, source_size, target), classes (name, preference,
    whole, fraction) and rules (name, rules); all but rows have a row for a source, or for one of its preferences."""

    def __init__(self, rows: DataFrame, sources: DataFrame, classes: DataFrame, rules: DataFrame):
        self.rows, self.sources, self.classes, self.rules = rows, sources, classes, rules


def measured(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, preference) -> DataFrame:
    """Adds _name, _size, _preference and _draw to the rows of docs."""
    text, source = docs[f"`{text_col}`"], docs[f"`{source_col}`"].cast("string")
    size = word_count(text)
    out = docs.withColumns({"_name": F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source)), "_size": size, "_draw": F.xxhash64(F.lit(seed), docs[f"`{id_col}`"], text)})
    return out.withColumn("_preference", F.greatest(F.lit(1), F.least(F.lit(MOST_PREFERENCE), F.coalesce(preference(F.col("_size")), F.lit(1)))).cast("int"))


def odds(x: Column) -> Column:
    return x / (1 - x)


def pareto_key(draw: Column, fraction: Column) -> Column:
    """The rank key as a whole number of KEY_BITS bits: q / (1 + q) for q, the odds of the draw over those of inclusion."""
    u = (F.shiftrightunsigned(draw, 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    q = odds(u) / odds(fraction)
    return F.floor(q / (1 + q) * F.lit(float(1 << KEY_BITS)))


def taken_by(rules: Column, size: Column, key: Column) -> Column:
    return F.exists(F.coalesce(rules, F.array().cast("array<struct<least:long,most:long,after:long,last:long>>")), lambda r: (size >= r["least"]) & (size <= r["most"]) & (key > r["after"]) & (key <= r["last"]))


def cutoffs(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """name, last, used: for each source the largest key up to which the sizes of rows (name, size, key) add up to its budget at most."""
    crossing = rows.join(budgets.select("name", "budget", F.lit(0).cast("long").alias("before")), "name")
    whole, shift = None, KEY_BITS
    order = Window.partitionBy("name").orderBy("digit")
    for step in range(3):
        shift = shift - DIGIT if step < 2 else 0
        sums = crossing.groupBy("name", "budget", "before", F.shiftright("key", shift).alias("digit")).agg(F.sum("size").alias("n"))
        sums = sums.withColumn("sum", F.col("before") + F.sum("n").over(order))
        fits = F.col("sum") <= F.col("budget")
        found = stored(sums.groupBy("name", "budget").agg(F.min(F.when(~fits, F.col("digit"))).alias("digit"), F.coalesce(F.max(F.when(fits, F.col("sum"))), F.min("before")).alias("used"), F.max(F.when(fits, F.col("digit"))).alias("fit")), "cut")
        if whole is None:
            whole = found.where("digit is null").select("name", F.lit(EDGE).alias("last"), "used")
        if step < 2:
            edge = found.where("digit is not null").select("name", "budget", F.col("used").alias("before"), "digit")
            crossing = rows.withColumn("digit", F.shiftright("key", shift)).join(edge, ["name", "digit"]).drop("digit")
            low = found.select("name", (F.shiftleft(F.coalesce("digit", F.lit(0)), shift) - 1).alias("low"))
    return whole.union(found.join(low, "name").select("name", F.coalesce("fit", "low").alias("last"), "used"))


def planned(rows: DataFrame, weights: tuple[float, ...], total: float, cap: float, tolerance: float) -> Plan:
    """rows: a stored table of name, size, preference, draw (and doc_id)."""
    groups = stored(rows.groupBy("name", "preference").agg(F.sum("size").alias("words")), "groups")
    sizes = groups.groupBy("name").agg(F.sum("words").alias("source_size")).withColumn("source", F.when(F.col("name") != "-", F.expr("substring(name, 2)")))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1  # one row for a source
    sizes = sizes.withColumns({"share": F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(place, F.lit(len(weights))) + 1), "cap": F.col("source_size") * F.lit(float(cap)), "total": F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(float(total))})
    sources = stored(waterfill(sizes.withColumn("one", F.lit(1)), ["one"], "share", "cap", "total").select("name", "source", "source_size", F.col("amount").alias("target")), "sources")
    shares = groups.where("words > 0").join(sources, "name").select("name", "preference", "words", "target", (F.col("words") * F.col("preference").cast("double")).alias("share"), (F.col("words") * F.lit(float(cap))).alias("cap"))
    copies = F.col("amount") / F.col("words")
    near = F.abs(copies - F.round(copies)) < 1e-9
    classes = waterfill(shares, ["name"], "share", "cap", "target").withColumns({"whole": F.when(near, F.round(copies)).otherwise(F.floor(copies)).cast("int"), "fraction": F.when(near, 0.0).otherwise(copies - F.floor(copies))})
    classes = stored(classes.select("name", "preference", "words", "target", "whole", "fraction"), "classes")
    left = classes.groupBy("name").agg(F.first("target").alias("target"), F.greatest(F.lit(0), F.floor(F.first("target") - F.sum(F.col("words") * F.col("whole")) + 0.5)).alias("left"))
    state = stored(left.withColumn("rules", F.array().cast("array<struct<least:long,most:long,after:long,last:long>>")), "state")
    able = classes.where("fraction > 0").select("name", "preference", "fraction")
    able = attached(rows.where("size > 0"), able, ["name", "preference"], F.lit(64)).select("name", "size", pareto_key(F.col("draw"), F.col("fraction")).alias("key"))
    able = stored(able, "candidates")
    most = F.lit(EDGE)
    while True:
        # the sources that are still short, and what may fill them
        short = state.where(F.col("left") > F.col("target") * tolerance)
        free = able.join(short.select("name", F.col("left").alias("budget"), "rules", most.alias("most")), "name").where(F.col("size") <= F.col("most")).where(~taken_by(F.col("rules"), F.col("size"), F.col("key")))
        cuts = stored(cutoffs(free.select("name", "size", "key"), short.select("name", F.col("left").alias("budget"))), "cuts")
        if not cuts.where("used > 0").take(1):
            break
        rule = F.struct(F.lit(0).cast("long").alias("least"), most.cast("long").alias("most"), F.lit(-1).cast("long").alias("after"), F.col("last").cast("long").alias("last"))
        found = state.join(cuts, "name", "left")
        state = stored(found.select("name", "target", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"), F.when(F.col("used") > 0, F.concat("rules", F.array(rule))).otherwise(F.col("rules")).alias("rules")), "state")
        most = F.floor(F.col("left") / 2)
    # the one document that brings a source nearest, if that is nearer than without it
    free = able.join(short.select("name", "left", "rules"), "name").where(F.col("size") < 2 * F.col("left")).where(~taken_by(F.col("rules"), F.col("size"), F.col("key")))
    ones = free.groupBy("name", "left", "size", "key").agg(F.sum("size").alias("n")).where("n < 2 * left")
    last = ones.groupBy("name").agg(F.min(F.struct(F.abs(F.col("n") - F.col("left")), "key", "size")).alias("x")).select("name", F.struct(F.col("x.size").alias("least"), F.col("x.size").alias("most"), (F.col("x.key") - 1).alias("after"), F.col("x.key").alias("last")).alias("rule"))
    rules = state.join(last, "name", "left").select("name", F.when(F.col("rule").isNotNull(), F.concat("rules", F.array("rule"))).otherwise(F.col("rules")).alias("rules"))
    return Plan(rows, sources, classes, stored(rules, "rules"))


def copies_of(rows: DataFrame, plan: Plan, name: str = "name", size: str = "size", preference: str = "preference", draw: str = "draw") -> DataFrame:
    """rows with source_size, target and copies."""
    c = plan.classes.select(F.col("name").alias(name), F.col("preference").alias(preference), "whole", "fraction")
    s = plan.sources.join(plan.rules, "name", "left").select(F.col("name").alias(name), "source_size", "target", "rules")
    out = attached(attached(rows, s, name, F.length(name) + 40 * F.size(F.coalesce("rules", F.array()))), c, [name, preference], F.length(name), "left")
    more = F.when((F.col("fraction") > 0) & taken_by(F.col("rules"), F.col(size), pareto_key(F.col(draw), F.col("fraction"))), 1).otherwise(0)
    return out.withColumn("copies", F.when(F.col(size) > 0, F.coalesce("whole", F.lit(0)) + more).otherwise(0).cast("int")).drop("whole", "fraction", "rules")


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, cap: float = 2, tolerance: float = 0.003, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", preference=longer_first) -> Plan:
    """weights: of the sources in order of code points, null last, repeating. preference: from the column of sizes to that of preferences."""
    rows = measured(docs, seed, id_col, text_col, source_col, preference)
    rows = rows.select(F.col("_name").alias("name"), docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.col("_size").alias("size"), F.col("_preference").alias("preference"), F.col("_draw").alias("draw"))
    return planned(stored(rows, "sizes"), weights, total, cap, tolerance)


def report(plan: Plan) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document."""
    out = copies_of(plan.rows, plan)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, plan: Plan, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", preference=longer_first) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken. One pass without a shuffle of texts; the arguments are those of the plan."""
    rows = copies_of(measured(docs, seed, id_col, text_col, source_col, preference), plan, "_name", "_size", "_preference", "_draw")
    out = rows.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(*pick(out, *docs.columns))


__all__ = ["Plan", "mixed", "plan_mix", "report", "waterfill"]
