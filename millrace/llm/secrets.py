"""Secret scans with multipart credential linking, on Spark SQL functions only.

Base kinds (strong by themselves): assign, access, hex. Weak parts: key_id (short or quoted-id access identifiers), key (40
characters of base64 with lower and upper case and a digit), endpoint (URLs). A weak part is reported only where its
complement is near: an access identifier (access or key_id) and a secret (assign, hex or key) within `scope` characters of
each other are linked, and an endpoint is reported if it is within scope of both an identifier and a secret.

The join is an interval join inside each text, by a sweep: identifiers, secrets and endpoints are sorted by start, one pass forward
carries the furthest end of any identifier and of any secret so far, one pass backward the nearest start of those to come, and
a weak part compares its own place with these. It is exact, makes no pair of spans, and nothing is shuffled. Passes are made in
blocks like the sums of positions, so n spans cost n ** 1.5 at most.

Positions: Spark tells matches but not where they are; the text is split by the same expression, and the lengths of the
pieces before a match add up to its start. The sums are made in blocks, so that a text with n matches costs n ** 1.5 at most.

Defined results: null and empty texts have no spans; rows are independent, so repeated rows, null and repeated ids stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import doc_columns

#: The base kinds' expressions.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts.
KEY_ID = r"(?:AKIA|ASIA|AROA|AIDA|AGPA)[A-Z0-9]{8,15}(?![A-Z0-9])"
KEY = r"(?<![A-Za-z0-9/+=])(?=[A-Za-z0-9/+]{0,39}[a-z])(?=[A-Za-z0-9/+]{0,39}[A-Z])(?=[A-Za-z0-9/+]{0,39}[0-9])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
ENDPOINT = r"""https?://[A-Za-z0-9][^\x00-\x20"'<>]{3,}"""
#: Kinds in the order of the report, with the bit that says what part a kind plays.
KINDS = ("assign", "access", "hex", "key_id", "key", "endpoint")
BLOCK = 256
#: More characters than a text has.
FAR = 1 << 40


def let(value: Column, body) -> Column:
    """body(value), with the value computed once, however often the body (or a lambda in it) asks for it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def starts(lengths: Column) -> Column:
    """For an array of structs (before, own): array of starts, summed in blocks."""
    return let(lengths, starts_of)


def starts_of(lengths: Column) -> Column:
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: F.slice(lengths, k * BLOCK + 1, BLOCK))
    return let(blocks, starts_in)


def starts_in(blocks: Column) -> Column:
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["before"] + x["own"]))
    offsets = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    empty = F.expr("cast(array() as array<int>)")

    def inside(b: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), empty.alias("out"))
        return F.aggregate(b, start, lambda a, x: F.struct((a["at"] + x["before"] + x["own"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["before"])).alias("out")), lambda a: a["out"])

    return F.flatten(F.zip_with(blocks, F.slice(offsets, 1, F.size(blocks)), inside))


def spans(text: Column, pattern: str, order: int, gate: str | None = None, keep=None) -> Column:
    """array<struct<start, kind_order, end>> of the leftmost matches; keep(match) may drop some after they are found."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("before"), F.length(m).alias("own")))
    all_spans = F.zip_with(starts(lengths), found, lambda s, m: F.struct(s.alias("start"), F.lit(order).alias("kind_order"), (s + F.length(m)).alias("end"), m.alias("match")))
    kept = F.filter(all_spans, lambda x: keep(x["match"])) if keep else all_spans
    out = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["kind_order"].alias("kind_order"), x["end"].alias("end")))
    none = F.expr("cast(array() as array<struct<start:int,kind_order:int,end:int>>)")
    return F.when(text.rlike(gate or pattern), out).otherwise(none)


def shown(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind_order"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, scope: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked (weak parts reported)."""
    rows = doc_columns(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = F.col("text")
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    rows = rows.select(
        "doc_id",
        spans(t, ASSIGN, 0, keep=value).alias("assign"),
        spans(t, ACCESS, 1).alias("access"),
        spans(t, HEX, 2).alias("hex"),
        spans(t, KEY_ID, 3).alias("key_id"),
        spans(t, KEY, 4).alias("key"),
        spans(t, ENDPOINT, 5).alias("endpoint"),
    )
    return linked(rows, scope)


def linked(rows: DataFrame, scope: int) -> DataFrame:
    sort = F.array_sort
    weak = F.size("key_id") + F.size("key") + F.size("endpoint") > 0
    both = weak & (F.size("access") + F.size("key_id") > 0) & (F.size("assign") + F.size("hex") + F.size("key") > 0)
    none = F.expr("cast(array() as array<struct<start:int,kind_order:int,end:int>>)")
    rows = rows.withColumn("found", F.when(both, sort(F.concat(*KINDS))))
    rows = rows.withColumns({"behind": furthest(F.col("found"), "end"), "ahead": F.reverse(furthest(F.reverse("found"), "start"))})
    swept = F.zip_with("found", F.zip_with("behind", "ahead", lambda b, a: F.struct(b.alias("b"), a.alias("a"))), lambda x, y: F.struct(x.alias("x"), y["b"].alias("b"), y["a"].alias("a")))
    order = {k: i for i, k in enumerate(KINDS)}

    def near(s: Column, part: str) -> Column:
        return (s["b"][part] >= s["x"]["start"] - scope) | (-s["a"][part] <= s["x"]["end"] + scope)

    def reported(s: Column) -> Column:
        kind = s["x"]["kind_order"]
        by_id, by_secret = near(s, "id"), near(s, "secret")
        return ((kind == order["key_id"]) & by_secret) | ((kind == order["key"]) & by_id) | ((kind == order["endpoint"]) & by_id & by_secret)

    report = F.transform(F.filter(swept, reported), lambda s: s["x"])
    rows = rows.withColumn("linked", F.when(both, report).otherwise(none)).withColumn("base", sort(F.concat("assign", "access", "hex")))
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(sort(F.concat("base", "linked"))).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )


def furthest(found: Column, side: str) -> Column:
    """For each span of an array: struct (id, secret) of the greatest end (side "end"), or the greatest negative start (side "start"), of
    any identifier and any secret up to and with it; FAR below zero if there is none."""
    sign = 1 if side == "end" else -1
    ids, secrets = [KINDS.index(k) for k in ("access", "key_id")], [KINDS.index(k) for k in ("assign", "hex", "key")]
    far = F.lit(-FAR).cast("long")

    def own(x: Column) -> Column:
        value = (x[side] * sign).cast("long")
        return F.struct(F.when(x["kind_order"].isin(ids), value).otherwise(far).alias("id"), F.when(x["kind_order"].isin(secrets), value).otherwise(far).alias("secret"))

    def most(a: Column, b: Column) -> Column:
        return F.struct(F.greatest(a["id"], b["id"]).alias("id"), F.greatest(a["secret"], b["secret"]).alias("secret"))

    first = F.struct(far.alias("id"), far.alias("secret"))
    empty = F.expr("cast(array() as array<struct<id:bigint,secret:bigint>>)")
    def cut(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, BLOCK))

    def inside(b: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), empty.alias("out"))
        return F.aggregate(b, start, lambda a, x: F.struct(most(a["at"], x).alias("at"), F.concat(a["out"], F.array(most(a["at"], x))).alias("out")), lambda a: a["out"])

    def carried(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, first, most))
        bases = F.aggregate(totals, F.array(first), lambda a, x: F.concat(a, F.array(most(F.element_at(a, -1), x))))
        return F.flatten(F.zip_with(blocks, F.slice(bases, 1, F.size(blocks)), inside))

    return let(let(F.transform(found, own), cut), carried)
