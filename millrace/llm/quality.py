"""Quality rules with risk-controlled thresholds.

Base rules: fewer than 20 words, or over 30 % of the words in 8-word windows that the text holds twice or more.
The method adds cutoffs on four scores (high is bad), chosen per stratum from labelled documents. A set of cutoffs is admissible
if the exact one-sided (Clopper-Pearson) upper bound on the share of good documents that any of them rejects is at most `risk`.
Sets are tested in a fixed sequence, each step one cutoff of one score lower, all at confidence 1 - delta / strata, up to the
first that fails; the sequence comes from the bad documents and the quarter of the good ones that take no part in the tests
(ORDER_SHARE, by hash of doc_id), so no correction is paid for its length, and with probability 1 - delta no stratum rejects
more than its share of good documents. Each score then uses the lowest cutoff not below the last admissible one that rejects
more bad than good labelled documents; a score without one rejects nothing.

A stratum needs log(delta / strata) / log(1 - risk) good documents in its tests: 108 for 4 strata, so about 144 labelled good
ones that pass the base rules. With fewer it gets no cutoff.

Counts of labelled documents by stratum and cutoffs reached are made by Spark over all labels, and each stratum is decided in a task
of its own group: its cells are bounded by the grid, and strata may be as many as they like. The driver only counts them.

Defined results: null and empty texts have no words and fail the base rules; null strata are the stratum ""; labels without
a document, null labels and labels other than 0 and 1 do not count; a document labelled both ways counts as good; labelled rows
that share a doc_id are one trial, of the least of their strata, which reaches what any of them reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import attached, free_name, grouped, hashed, mapped, mixed, numbered, pick, slices, spans_of, stored, texts_of, tune, windows

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Scores, and the fixed grid of cutoffs of each.
SCORES = ("symbol_share", "dup_line_share", "repeat_share", "long_words")
GRID = {
    "symbol_share": (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2),
    "dup_line_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6),
    "repeat_share": (0.05, 0.1, 0.15, 0.2, 0.25),
    "long_words": (8.0, 9.0, 10.0, 12.0, 15.0, 20.0),
}
#: One in so many good documents puts the sequence of the tests in order; the others are tested.
ORDER_SHARE = 4
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """By text: its words in 8-word windows that it holds twice or more."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    begins, ends = spans_of(counts)
    total = int(counts.sum())
    out = np.zeros(len(words), np.int64)
    if total < WINDOW:
        return out
    owner = np.repeat(np.arange(len(words)), counts)
    h = hashed([w for ws in words for w in ws])
    at = np.nonzero(np.arange(total - WINDOW + 1) + WINDOW <= ends[owner[: total - WINDOW + 1]])[0]
    with np.errstate(over="ignore"):
        key = mixed(windows(h, WINDOW)[at] ^ mixed(owner[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    twin = np.zeros(len(k), bool)
    twin[1:] = k[1:] == k[:-1]
    twin[:-1] |= twin[1:].copy()
    starts = at[order[twin]]
    step = np.zeros(total + 1, np.int64)
    step[starts] += 1
    step[starts + WINDOW] -= 1
    sums = np.append(0, np.cumsum(np.cumsum(step[:-1]) > 0))
    return sums[ends] - sums[begins]


def features(texts: list[bytes]) -> dict[str, list[int] | np.ndarray]:
    words = [t.split() for t in texts]
    word_chars, n_dup, n_lines = [], [], []
    for t in texts:
        word_chars.append(len(t.translate(None, BLANKS).decode("utf-8", "replace")))
        full = [x for x in t.split(b"\n") if x.strip(BLANKS)]
        n_lines.append(len(full))
        n_dup.append(len(full) - len({*full}))
    return {
        "n_words": np.fromiter(map(len, words), np.int64, len(words)),
        "word_chars": word_chars,
        "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
        "n_dup_lines": n_dup,
        "n_repeat_words": repeated_words(words),
        "n_lines": n_lines,
    }


def with_features(docs: DataFrame, id_col: str, text_col: str, stratum_col: str | None) -> DataFrame:
    """doc_id, stratum, and the counts of FEATURES; no shuffle."""
    tune(docs.sparkSession)
    stratum = F.coalesce(docs[f"`{stratum_col}`"].cast("string"), F.lit("")) if stratum_col else F.lit("")
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), stratum.alias("stratum"), docs[f"`{text_col}`"].cast("string").alias("text"))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = texts_of(b.column(2))
        for lo, hi in slices(texts):
            found = {k: pa.array(v, pa.int64()) for k, v in features(texts[lo:hi]).items()}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(lo, hi - lo), "stratum": b.column(1).slice(lo, hi - lo), **found})

    return rows.mapInArrow(mapped(run), f"doc_id long, stratum string, {FEATURES}")


def score_columns() -> dict:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n,
        "long_words": F.col("word_chars") / n,
    }


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p)."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return 1.0 if k >= n else 0.0
    i = np.arange(k + 1)
    logs = np.array([lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) for j in i.tolist()]) + i * log(p) + (n - i) * np.log1p(-p)
    top = logs.max()
    return float(min(1.0, np.exp(top) * np.exp(logs - top).sum()))


def upper_bound(k: int, n: int, alpha: float) -> float:
    """Clopper-Pearson: the share whose binomial would give k or fewer of n with probability alpha."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(k, n, mid) > alpha else (lo, mid)
    return hi


def stratum_cutoffs(cells: list, risk: float, alpha: float) -> dict[str, float]:
    levels = np.array([c["levels"] for c in cells], np.int64)
    n = np.array([c["n"] for c in cells], np.int64)
    good, tested = np.array([c["label"] == 1 for c in cells]), np.array([c["tested"] for c in cells])
    bad, order, test = ~good, good & ~tested, good & tested
    known = float(n[good].sum()) / max(1, int(n[order].sum()))

    def alone(of: np.ndarray, s: int, i: int) -> int:
        return int(n[of & (levels[:, s] > i)].sum())

    def joint(of: np.ndarray, at: list[int]) -> int:
        return int(n[of & (levels > np.array(at)).any(axis=1)].sum())

    grids = [GRID[s] for s in SCORES]
    # at: by score, the place of its cutoff in the grid, the grid's length for none
    at = [len(g) for g in grids]
    lowest = [next((i for i in range(len(g)) if alone(bad, s, i) > known * alone(order, s, i)), len(g)) for s, g in enumerate(grids)]
    while steps := [at[:s] + [at[s] - 1] + at[s + 1 :] for s in range(len(at)) if at[s] > lowest[s]]:
        moved = [next(s for s in range(len(at)) if x[s] != at[s]) for x in steps]
        step = min(zip(steps, moved, strict=True), key=lambda x: (joint(order, x[0]), -alone(bad, x[1], lowest[x[1]]), x[1]))[0]
        # P(X <= wrong) at the allowed share within alpha is the same as the upper bound being within that share
        if tail(joint(test, step), int(n[test].sum()), risk) > alpha:
            break
        at = step
    used = [next((i for i in range(at[s], len(g)) if alone(bad, s, i) > alone(good, s, i)), None) for s, g in enumerate(grids)]
    return {s: GRID[s][i] for s, i in zip(SCORES, used, strict=True) if i is not None}


def marked(labels: DataFrame, label_id_col: str, label_col: str) -> DataFrame:
    rows = labels.select(labels[f"`{label_id_col}`"].cast("long").alias("doc_id"), labels[f"`{label_col}`"].cast("int").alias("label"))
    return rows.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))


def cutoffs(scored: DataFrame, marks: DataFrame, risk: float, delta: float) -> DataFrame:
    """stratum, cuts (by score its cutoff, null for none) from the features of the labelled documents that pass the base rules."""
    reached = {s: sum(((column >= c).cast("int") for c in GRID[s]), F.lit(0)) for s, column in score_columns().items()}
    trials = scored.where(~base_failed()).join(marks, "doc_id").groupBy("doc_id", "label").agg(F.min("stratum").alias("stratum"), *(F.max(c).alias(s) for s, c in reached.items()))
    tested = F.pmod(F.xxhash64("doc_id"), F.lit(ORDER_SHARE)) > 0
    cells = stored(trials.groupBy("stratum", "label", tested.alias("tested"), *SCORES).agg(F.count(F.lit(1)).alias("n")), "cells")
    strata = cells.agg(F.count_distinct("stratum")).first()[0]
    alpha = delta / max(1, strata)

    def decide(t: pa.Table) -> pa.Table:
        found = stratum_cutoffs([{"label": r["label"], "tested": r["tested"], "levels": [r[s] for s in SCORES], "n": r["n"]} for r in t.to_pylist()], risk, alpha)
        return pa.table({"stratum": t.column("stratum").slice(0, 1).cast(pa.string()), "cuts": pa.array([[found.get(s) for s in SCORES]], pa.list_(pa.float64()))})

    return stored(cells.groupBy("stratum").applyInArrow(grouped(decide), "stratum string, cuts array<double>"), "cutoffs")


def judged(
    docs: DataFrame, labels: DataFrame, risk: float = 0.04, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", label_id_col: str = "doc_id", label_col: str = "quality"
) -> DataFrame:
    """Per row: doc_id, stratum, the counts, base_failed, rejected_by (the scores at or above their cutoffs), kept. The texts are read once:
    their counts are written to the shared folder, for the cutoffs and the verdicts."""
    rows = stored(with_features(docs, id_col, text_col, stratum_col), "features")
    return verdicts(rows, cutoffs(rows, marked(labels, label_id_col, label_col), risk, delta))


def verdicts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    out = attached(rows, cuts, "stratum", F.length("stratum") + 64, "left")
    by = F.array_compact(F.array(*(F.when(column >= F.col("cuts")[i], F.lit(s)) for i, (s, column) in enumerate(score_columns().items()))))
    out = out.withColumn("base_failed", base_failed()).withColumn("rejected_by", by).drop("cuts")
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def filtered(docs: DataFrame, labels: DataFrame, risk: float = 0.04, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """The rows of docs that are kept, with their columns; the texts are not shuffled (unless the cutoffs are over 16 MB). Only labelled
    documents are scored for the cutoffs, as long as their ids fit into a broadcast of 16 MB."""
    marks = stored(marked(labels, "doc_id", "quality"), "marks")
    few = marks.count() * 16 <= 16 << 20
    scored = docs.join(F.broadcast(marks.select(F.col("doc_id").alias(id_col))), id_col, "left_semi") if few else docs
    cuts = cutoffs(with_features(scored, id_col, text_col, stratum_col), marks, risk, delta)
    names = docs.columns
    at, key, mine = names.index(text_col), free_name("stratum_key", names), free_name("cuts", names)
    stratum = F.coalesce(docs[f"`{stratum_col}`"].cast("string"), F.lit("")) if stratum_col else F.lit("")
    keyed = docs.select(*pick(docs, *names), stratum.alias(key))
    with_cuts = attached(keyed, cuts.select(F.col("stratum").alias(key), F.col("cuts").alias(mine)), key, F.length(key) + 64, "left")
    last = len(names)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = texts_of(b.column(at))
        for lo, hi in slices(texts):
            keep = kept_flags(texts[lo:hi], b.column(last).slice(lo, hi - lo).to_pylist())
            yield b.select(range(last)).slice(lo, hi - lo).filter(pa.array(keep)).rename_columns(names)

    tune(docs.sparkSession)
    return numbered(with_cuts.select(*pick(with_cuts, *names, mine))).mapInArrow(mapped(run), docs.schema)


def kept_flags(texts: list[bytes], cuts: list[list[float | None] | None]) -> np.ndarray:
    f = {k: np.asarray(v, np.int64) for k, v in features(texts).items()}
    n, chars = np.maximum(f["n_words"], 1), np.maximum(f["word_chars"], 1)
    scores = {"symbol_share": f["n_symbols"] / chars, "dup_line_share": f["n_dup_lines"] / np.maximum(f["n_lines"], 1), "repeat_share": f["n_repeat_words"] / n, "long_words": f["word_chars"] / n}
    keep = (f["n_words"] >= LEAST_WORDS) & (100 * f["n_repeat_words"] <= MOST_REPEATED * f["n_words"])
    for i, x in enumerate(scores.values()):
        keep &= x < np.array([np.inf if c is None or c[i] is None else c[i] for c in cuts])
    return keep
