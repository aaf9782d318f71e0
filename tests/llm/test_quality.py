import random
import re
from collections import Counter

import pytest

import millrace.llm.quality as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    base = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), base


def texts():
    rng = random.Random(6)
    out = [None, "", " \n\t", "é" * 30, "a b c d e f g h " * 2, "x " * 200]
    for _ in range(120):
        lines = [" ".join(rng.choice(["the", "é#", "a", "|b", "c$$"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 8))]
        out.append(rng.choice(["\n", "\r\n", "\n\n"]).join(lines * rng.choice([1, 1, 2])))
    return out


def test_counts(spark):
    ts = texts()
    df = spark.createDataFrame([(i, t, "en", i) for i, t in enumerate(ts)], "doc_id long, text string, lang string, stratum int")
    labels = spark.createDataFrame([(0, 1), (None, 1), (3, None), (4, 5)], "doc_id long, quality int")
    got = {r.doc_id: r for r in q.judged(df, labels).collect()}
    for i, t in enumerate(ts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t)
        assert r.kept == (not r.base_failed)
    assert sorted(r.doc_id for r in q.filtered(df, labels).collect()) == [i for i, t in enumerate(ts) if not brute(t)[5]]
    assert q.judged(df.limit(0), labels.limit(0)).count() == 0


def test_bound_is_exact():
    assert q.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    assert q.tail(3, 10, 0.5) == pytest.approx(176 / 1024)
    assert q.upper_bound(5, 5, 0.05) == 1.0


def cuts_of(df, labels, risk=0.04, delta=0.05):
    rows = q.cutoffs(q.with_features(df, "doc_id", "text", "lang"), q.marked(labels, "doc_id", "quality"), risk, delta).collect()
    return {r.stratum: d for r in rows if (d := {s: c for s, c in zip(q.SCORES, r.cuts, strict=True) if c is not None})}


def test_cutoffs_keep_the_risk(spark):
    """Bad documents have many symbols, good ones rarely: a cutoff is found for the large stratum only, and pipeline and query agree."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 4 == 0
        words = ["w" + rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(40)]
        if bad:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en" if i < 2900 else None))
        labels.append((i, 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    cuts = cuts_of(df, lab)
    assert "symbol_share" in cuts["en"] and "" not in cuts
    kept = {r.doc_id for r in q.judged(df, lab).where("kept").collect()}
    assert kept == {r.doc_id for r in q.filtered(df, lab).collect()}
    assert not any(i % 4 == 0 for i in kept if i < 2900)
    false = sum(1 for i in range(2900) if i % 4 and i not in kept)
    assert false <= 0.04 * 2175


def test_strata_of_some_hundred_labels_get_cutoffs(spark):
    """300 to 500 labels in each of four strata are enough for the symbols; 100 are not. No stratum rejects more good documents than its risk."""
    rng = random.Random(9)
    rows, labels = [], []
    for lang, n in (("en", 500), ("de", 400), ("fr", 300), ("es", 100)):
        for i in range(n):
            words = ["w" + rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(40)]
            rows.append((len(rows), " ".join(w + "###" for w in words) if i % 10 == 0 else " ".join(words), lang))
            labels.append((len(labels), int(i % 10 > 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    cuts = cuts_of(df, lab)
    assert {"en", "de", "fr"} == {k for k, c in cuts.items() if "symbol_share" in c}
    kept = {r.doc_id for r in q.judged(df, lab).where("kept").collect()}
    assert kept == {i for (i, _, lang), (_, good) in zip(rows, labels, strict=True) if good or lang == "es"} == {r.doc_id for r in q.filtered(df, lab).collect()}


def cell(label, tested, levels, n):
    return {"label": label, "tested": tested, "levels": levels, "n": n}


def test_joint_rejection_within_the_whole_risk():
    """Scores that reject 3 % of the good documents each pass alone, not together; 107 tested good documents are too few, 108 enough."""
    assert q.stratum_cutoffs([cell(1, True, [0, 0, 0, 0], 107), cell(0, True, [1, 0, 0, 0], 9)], 0.04, 0.05 / 4) == {}
    assert q.stratum_cutoffs([cell(1, True, [0, 0, 0, 0], 108), cell(0, True, [1, 0, 0, 0], 9)], 0.04, 0.05 / 4) == {"symbol_share": 0.02}
    cells = [cell(1, tested, levels, n * (3 if tested else 1)) for tested in (True, False) for levels, n in (([0, 0, 0, 0], 940), ([7, 0, 0, 0], 30), ([0, 0, 0, 6], 30))]
    for levels in ([7, 0, 0, 0], [0, 0, 0, 6]):
        alone = [c for c in cells if c["levels"] in ([0, 0, 0, 0], levels)] + [cell(0, True, levels, 500)]
        assert len(q.stratum_cutoffs(alone, 0.04, 0.05)) == 1
    assert len(q.stratum_cutoffs(cells + [cell(0, True, [7, 0, 0, 0], 500), cell(0, True, [0, 0, 0, 6], 400)], 0.04, 0.05)) == 1


def test_many_strata_all_count(spark):
    """1,200 strata: none is left out. The cells are made directly, 300 good and 30 bad documents each."""
    from pyspark.sql import functions as F

    rows = spark.range(1200).select(F.format_string("s%04d", "id").alias("stratum"), F.explode(F.sequence(F.lit(0), F.lit(329))).alias("k"), "id")
    bad = F.col("k") >= 300
    scored = rows.select((F.col("id") * 1000 + F.col("k")).alias("doc_id"), "stratum", F.lit(50).cast("long").alias("n_words"), F.lit(200).cast("long").alias("word_chars"), F.when(bad, 60).otherwise(0).cast("long").alias("n_symbols"), *(F.lit(0).cast("long").alias(c) for c in ("n_dup_lines", "n_repeat_words")), F.lit(1).cast("long").alias("n_lines"), bad.alias("bad"))
    marks = scored.select("doc_id", (~F.col("bad")).cast("int").alias("label"))
    found = q.cutoffs(scored.drop("bad"), marks, 0.05, 0.5)
    assert found.count() == 1200 and found.where("cuts[0] is not null").count() == 1200


def test_repeated_rows_of_a_document_are_one_trial(spark):
    rows = [(i, "plain words " * 15 if i % 9 else "sym### " * 30, "en") for i in range(100)]
    once = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(100)], "doc_id long, quality int")
    assert cuts_of(once, lab) == {} == cuts_of(once.union(once).union(once).union(once), lab)
