import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import millrace.llm.lines as lines


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(texts, min_docs, min_chars):
    split = [(t or "").split("\n") for t in texts]
    seen = Counter(k for ls in split for k in {key(x) for x in ls} if len(k) >= min_chars)
    out = []
    for ls in split:
        kept = [x for x in ls if not (len(key(x)) >= min_chars and seen[key(x)] >= min_docs)]
        out.append((len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
@pytest.mark.parametrize("min_docs, min_chars", [(10, 1), (2, 3), (1, 1)])
def test_like_brute_force(spark, monkeypatch, broadcast, min_docs, min_chars):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(lines, "SHARD_KEYS", 7)
    monkeypatch.setattr(lines, "HELD", 50)
    rng = random.Random(4)
    pool = ["", " ", "é", "ab", "All Rights", "all rights ", "\tALL RIGHTS\r", "É", "漢字 x", "a\x0b", *(f"line {i}" for i in range(30))]
    texts = [None, "", "\n", "\n\n"] + ["\n".join(rng.choice(pool) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 9))) for _ in range(80)] + ["x\n" * 3000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, shard int").repartition(3)
    got = {r.doc_id: r for r in lines.drop_lines(df, min_docs, min_chars).collect()}
    assert [(got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) for i in range(len(texts))] == brute(texts, min_docs, min_chars)
    assert lines.drop_lines(df.limit(0)).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(0, 2**63, (2, 5000)).astype(np.uint64)
    ph = lines.PerfectHash(hi, lo, np.arange(1, 5001))
    for x in (ph, lines.PerfectHash.load(ph.dump())):
        assert x.count(hi, lo).tolist() == list(range(1, 5001))
        assert not x.count(lo, hi).any()
        assert len(x.fingerprints) == 5000


def test_emptied_rows_stay(spark):
    """Exact copies whose lines are all frequent lose their text, not their rows."""
    df = spark.createDataFrame([(i, "Same line\nother line", 20) for i in range(12)] + [(12, "Same line\nown", 13), (13, "", 0), (14, None, None)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.without_lines(df, min_docs=10, length_col="n_chars").collect()}
    assert got == {i: ("", 0) for i in range(12)} | {12: ("own", 3), 13: ("", 0), 14: (None, None)}
