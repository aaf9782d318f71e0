"""Substring dedup against brute force: small alphabets with runs and periods, planted passages, odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.substrings import Parsed, drop_repeats, plan_of


def brute(texts, k):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_plan():
    assert plan_of(35) == (2, 9, 11)
    assert plan_of(1) == (0, 0, 1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=35, max_size=60), st.text("abcd", max_size=12), st.text("abcd", max_size=12), st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_equal_windows_share_their_phrase(middle, a, b, c, d):
    for core in (middle, (middle[:3] * 30)[:40], ["a"] * 40):
        texts = [" ".join([*a, *core, *b]).encode(), " ".join([*c, *core, *d]).encode()]
        one, two = (Parsed([t], 35) for t in texts)
        shared_one, shared_two = np.isin(one.phrases, two.phrases), np.isin(two.phrases, one.phrases)
        for p, flags, lead in ((one, shared_one, len(a)), (two, shared_two, len(c))):
            got = set(p.candidates(flags).tolist())
            assert got >= set(range(lead, lead + len(core) - 34))


def test_like_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = [" ".join(word(3) for _ in range(rng.choice([34, 35, 36, 60]))) for _ in range(8)]
    texts = [None, "", " \n ", "x " * 100, "x " * 50, "a b " * 40, "b a " * 40]
    for _ in range(60):
        parts = [" ".join(word(2) for _ in range(rng.randint(0, 40)))]
        parts += [rng.choice(passage), " ".join(word(2) for _ in range(rng.randint(0, 30)))] * rng.randint(0, 2)
        texts.append("\n\t".join(parts))
    texts += [texts[20], texts[20] + " end", " ".join(word(2) for _ in range(9000))]
    rows = [(i, t, "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, batch_id string").repartition(3)
    got = {r.doc_id: r for r in drop_repeats(df).collect()}
    for i, want in enumerate(brute(texts, 35)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == want, i
        assert hashlib.sha256(got[i].kept.encode()).hexdigest() == want[2]
    small = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in drop_repeats(df, 5).collect()}
    assert [small[i] for i in range(len(texts))] == brute(texts, 5)
    assert drop_repeats(df.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, t), (None, t), (7, t), (7, "short")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in drop_repeats(df).collect()) == [(0, 40, 40), (0, 40, 40), (7, 1, 0), (7, 40, 40)]
