"""URL filters: rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens (runs of letters and digits between other characters) that every URL it
matches holds whole. Each rule is filed under the one of its tokens that fewest URLs hold; a URL's tokens fetch candidate
rules, and only those run their expressions. Rules without tokens are candidates for every URL. Token counts are made by Spark
over all URLs for the rules' tokens only, so the driver gets at most as many counts as the rules have tokens.

Host rules (`host/path`) come first, the longest wins; URLs that none fits get the verdict of the first pattern rule (in the
given order) that matches, else `default`. Rules are broadcast in shards of SHARD_RULES, one pass over the URLs each.

Defined results: host and path of a null URL or one without "://" are empty, no host rule fits, and no pattern rule sees it;
an empty URL likewise; repeated rows, repeated and null ids are kept row by row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import mapped, tune

#: Rules that one pass broadcasts (some hundreds of bytes each).
SHARD_RULES = 50_000

TOKEN = re.compile(r"[a-z0-9]+")


def lowered(text: str) -> str:
    """A-Z only."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    host_rule: bool


def host_rule(verdict: str, text: str) -> Rule:
    """`host/path`: the host and its subdomains, where the path starts with the rule's. Its whole tokens: the host's labels and the path's between two other characters."""
    host, slash, rest = text.partition("/")
    path = slash + rest
    body = TOKEN.findall(lowered(host)) + [m[0] for m in re.finditer("[A-Za-z0-9]+", path) if m.end() < len(path)]
    return Rule(text, verdict, rf"(?s)^://(?:[^/?#]*\.)?{re.escape(lowered(host))}(?=[/?#]|\Z)(?={re.escape(path)})", tuple(map(lowered, body)), True)


def pattern_rule(verdict: str, literal: str) -> Rule:
    """A literal with `*` for anything; `^` at an end asks for a separator or the URL's end there. Its whole tokens are those that cannot be part of longer ones."""
    left, right = literal.startswith("^"), literal.endswith("^")
    core = lowered(literal.strip("^"))
    pattern = ("(?:^|[^a-z0-9])" if left else "") + ".*".join(map(re.escape, core.split("*"))) + ("(?:[^a-z0-9]|$)" if right else "")
    marked = ("/" if left else "a") + core + ("/" if right else "a")
    whole = tuple(m[0] for m in TOKEN.finditer(marked.replace("*", "a")) if m.start() > 0 and m.end() < len(marked))
    whole = tuple(t for t in whole if t in TOKEN.findall(core))
    return Rule(literal, verdict, "(?s)" + pattern, whole, False)


def tokens_of(url: str) -> list[str]:
    return TOKEN.findall(lowered(url))


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return lowered(m[1]), m[2]


class RuleIndex:
    def __init__(self, rules: list[tuple[int, Rule]], counts: dict[str, int]):
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.rules = dict(rules)
        self.compiled = {i: re.compile(r.pattern) for i, r in rules}
        for i, r in rules:
            if r.tokens:
                self.by_token.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
            else:
                self.always.append(i)

    def matching(self, url: str, host: str, path: str) -> list[int]:
        """Rules that match. Host rules see the URL with a lower-cased host, pattern rules the lower-cased URL."""
        got = [i for t in {*tokens_of(url)} for i in self.by_token.get(t, ())] + self.always
        if not got:
            return got
        clean, low = f"://{host}{path}", lowered(url)
        return [i for i in got if self.compiled[i].search(clean if self.rules[i].host_rule else low)]


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule (the host rule's text, or null), pattern (the pattern rule's, or null), verdict."""
    spark = pages.sparkSession
    tune(spark)
    rows = pages.select(pages[f"`{id_col}`"].cast("long").alias("page_id"), pages[f"`{url_col}`"].cast("string").alias("url"))
    wanted = sorted({t for r in rules for t in r.tokens})

    def count(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen = Counter(t for u in b.column(0).to_pylist() if u for t in {*tokens_of(u)} if t in known)
        yield pa.RecordBatch.from_pydict({"token": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    known = frozenset(wanted)
    counts = {r.token: r.n for r in rows.select("url").mapInArrow(mapped(count), "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()} if wanted else {}
    numbered = list(enumerate(rules))
    # found: numbers of the best host rule and the first pattern rule so far
    state = rows.withColumn("h", F.lit(-1)).withColumn("p", F.lit(-1)).withColumn("size", F.lit(-1))
    for k in range(0, max(1, len(numbered)), SHARD_RULES):
        state = state.mapInArrow(mapped(one_pass(spark.sparkContext.broadcast((numbered[k : k + SHARD_RULES], counts)))), "page_id long, url string, h int, p int, size int")
    names = spark.sparkContext.broadcast([(r.name, r.verdict) for r in rules])

    def finish(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts = [split_url(u) for u in b.column(1).to_pylist()]
        h, p = b.column(2).to_pylist(), b.column(3).to_pylist()
        of = names.value
        yield pa.RecordBatch.from_pydict(
            {
                "page_id": b.column(0),
                "host": pa.array([x for x, _ in parts], pa.string()),
                "path": pa.array([x for _, x in parts], pa.string()),
                "rule": pa.array([of[i][0] if i >= 0 else None for i in h], pa.string()),
                "verdict": pa.array([of[i][1] if i >= 0 else of[j][1] if j >= 0 else default for i, j in zip(h, p, strict=True)], pa.string()),
                "pattern": pa.array([of[j][0] if j >= 0 else None for j in p], pa.string()),
            }
        )

    return state.mapInArrow(mapped(finish), "page_id long, host string, path string, rule string, verdict string, pattern string")


def one_pass(sent):
    held: list[RuleIndex] = []

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(RuleIndex(*sent.value))
        index = held[0]
        hs, ps, size = (b.column(c).to_pylist() for c in (2, 3, 4))
        for k, url in enumerate(b.column(1).to_pylist()):
            host, path = split_url(url)
            if not url or "://" not in url:
                continue
            for i in sorted(index.matching(url, host, path)):
                if index.rules[i].host_rule:
                    if len(index.rules[i].name) > size[k]:
                        hs[k], size[k] = i, len(index.rules[i].name)
                elif ps[k] < 0:
                    ps[k] = i
        yield pa.RecordBatch.from_pydict({"page_id": b.column(0), "url": b.column(1), "h": pa.array(hs, pa.int32()), "p": pa.array(ps, pa.int32()), "size": pa.array(size, pa.int32())})

    return run
