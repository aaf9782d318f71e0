"""Codes against a plain Lloyd in Python numbers; bounds against full scans."""

import hashlib
import math
import random

import numpy as np

from millrace.llm import quantize


def brute(rows, entries, rounds=4, parts=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, y):
        return min((sum((a - b) ** 2 for a, b in zip(y, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            of = {}
            for c in cut:
                of.setdefault(near(p, c[p])[1], []).append(c[p])
            for k, ys in of.items():
                new[p][k] = [sum(col) // len(ys) for col in zip(*ys, strict=True)]
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for (i, _, label), c in zip(kept, cut, strict=True):
        found = [near(p, c[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    total = {}
    for *_, e, label in out:
        total[label] = total.get(label, 0) + e
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=str)


def vectors(n, seed, dim=8, grid=None):
    rng = random.Random(seed)
    value = (lambda: rng.choice(grid)) if grid else (lambda: float(np.float32(rng.gauss(0, 1))))
    return [(i, [value() for _ in range(dim)], rng.choice([1, 2, None])) for i in range(n)]


def test_like_plain_lloyd(spark):
    odd = [(-5, None, 1), (-4, [None] * 8, 1), (-3, [math.nan] * 8, 1), (-2, [math.inf] + [0.0] * 7, 2), (-1, [], None), (None, [0.5] * 8, 1)]
    ties = vectors(200, 4, grid=[0.0, 1 / 1024, 2 / 1024])
    for rows, k in ((vectors(300, 1) + odd, 16), (ties, 32), (vectors(5, 2), 256), (vectors(150, 3) * 2, 20), ([(i, [1.0] * 8, None) for i in range(40)], 8)):
        df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)
        got = sorted((tuple(r) for r in quantize.report(df, entries=k).collect()), key=str)
        assert got == brute(rows, k)


def test_large_components_and_lengths(spark):
    rows = [(1, [3e5, 1.0, -2e5, 0.0], 1), (2, [3e5, 1.5, 2e5, 7.0], 1), (3, [1.0, 2.0], 1), (4, [1e30, 0.0, -1e30, 0.0], None), (5, [0.0] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in quantize.report(df, entries=2).collect()}
    assert set(got) == {1, 2, 4, 5}
    held = [(i, [max(-quantize.bound(4) / 1024, min(quantize.bound(4) / 1024, x)) for x in v], y) for i, v, y in rows if len(v) == 4]
    assert sorted((tuple(r) for r in got.values()), key=str) == brute(held, 2)
    assert quantize.report(spark.createDataFrame([(1, [1.0, 2.0], "a")], "vec_id long, embedding array<double>, label string")).count() == 0
    assert quantize.report(df.limit(0)).count() == 0


def test_bounds_spare_scans_and_hold():
    rng = np.random.default_rng(0)
    x = (rng.normal(0, 1, (4000, 6)) * 1000).astype(np.int64)
    books = quantize.Books(x[:32][None].copy())
    state, scans = (None, None, None), []
    for _ in range(6):
        code, upper, lower, n = quantize.assigned(x, books, 0, *state)
        d = quantize.exact(x, books.entries[0])
        assert (code == d.argmin(1)).all()
        true = np.sqrt(np.sort(d, 1).astype(float))
        assert (upper >= true[:, 0]).all() and (lower <= true[:, 1]).all()
        scans.append(n)
        sums, counts = quantize.sums_of(x, code, 32)
        new = books.entries.copy()
        new[0][counts > 0] = sums[counts > 0] // counts[counts > 0, None]
        books, state = quantize.Books(new, books.entries), (code, upper.astype(np.float32) * np.float32(1.000001), lower.astype(np.float32) * np.float32(0.999999))
    assert scans[0] == 4000 and scans[-1] < 2500
    big = x * 10**6
    assert (quantize.exact(big, big[:5]) == ((big[:, None] - big[None, :5]) ** 2).sum(2)).all()
