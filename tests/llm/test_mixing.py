"""The mix against a sequential version written from its definition."""

import math
import random

from millrace.llm import mixing

SPACE = " \t\n\x0b\x0c\r"


def n_words(text):
    for c in SPACE:
        text = (text or "").replace(c, " ")
    return len([x for x in text.split(" ") if x])


def targets(sizes, weights, total):
    """Share, cap, share again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), total
    while free:
        part = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if part[s] > 2 * sizes[s]}
        if not over:
            return out | part
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def corpus(n, seed, sources):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(min(400, int(rng.paretovariate(0.9) * 5)))) if i % 29 else None, rng.choice(sources), "x") for i in range(n)]
    return rows + [(7, "same row", "a", "x")] * 3 + [(None, "no id", "b", None)] * 2


def test_against_the_definition(spark):
    for sources, n in ((["a", "b", None, "B", "é", ""], 900), (["one"], 60), (["a", "a", "a", "z"], 40)):
        rows = corpus(n, n, sources)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string").repartition(3)
        plan = mixing.plan_mix(df)
        got = mixing.report(plan).collect()
        assert len(got) == len(rows)
        sizes, most, small = {}, {}, {}
        for i, t, s, _ in rows:
            k = n_words(t)
            sizes[s] = sizes.get(s, 0) + k
            most[s] = max(most.get(s, 0), k)
        want = targets(sizes, (3, 1, 2), 1.5 * sum(sizes.values()))
        source = {i: s for i, _, s, _ in rows if i is not None and i != 7}
        names = {r.source: r for r in plan.sources.collect()}
        assert set(names) == set(sizes)
        assert all(names[s].source_size == sizes[s] and math.isclose(names[s].target, want[s], rel_tol=1e-12) for s in sizes)
        taken = {s: 0 for s in sizes}
        for r in got:
            assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies
            if r.doc_id in source:
                assert r.source_size == sizes[source[r.doc_id]]
        for i, t, s, c in mixing.mixed(df, plan).collect():
            taken[s] += n_words(t)
        for s in sizes:
            assert abs(taken[s] - want[s]) <= max(0.003 * want[s] + 1, most[s] if n < 100 else 40), (s, taken[s], want[s])
        if n == 60:
            assert sorted(map(str, got)) == sorted(map(str, mixing.report(mixing.plan_mix(df.repartition(5))).collect()))  # reruns agree
        rules(rows, plan, {(r.doc_id, r.size): r.copies for r in got})


def rules(rows, plan, copies):
    """What the first rule takes is the prefix of Pareto keys that fits the words left after the certain copies."""
    classes = {(r.name, r.preference): r for r in plan.classes.collect()}
    cut = {r.name: r.rules for r in plan.rules.collect()}
    keyed = {}
    for r in plan.rows.collect():
        c = classes.get((r.name, r.preference))
        if r.size and c.fraction > 0:
            u = ((r.draw % 2**64 >> 11) + 0.5) / 2**53
            q = u / (1 - u) / (c.fraction / (1 - c.fraction))
            keyed.setdefault(r.name, []).append((math.floor(q / (1 + q) * 2**52), r.size))
        elif r.size:
            assert copies[r.doc_id, r.size] == c.whole
    for name, found in keyed.items():
        mine = [c for (n, _), c in classes.items() if n == name]
        budget = math.floor(mine[0].target - sum(c.words * c.whole for c in mine) + 0.5)
        total, last = 0, -1
        groups = {}
        for k, s in found:
            groups[k] = groups.get(k, 0) + s
        for k in sorted(groups):
            if total + groups[k] > budget:
                break
            total, last = total + groups[k], k
        if total:
            assert cut[name][0].most >= 2**62 and [k for k in sorted(groups) if k <= cut[name][0].last] == [k for k in sorted(groups) if k <= last]


def test_inclusion_follows_preference(spark):
    rows = [(i, "w " * (3 if i % 2 else 40), "s") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan_mix(df, total=0.4)
    got = mixing.report(plan).groupBy("size").agg({"copies": "avg"}).collect()
    expected = {r.preference: r.whole + r.fraction for r in plan.classes.collect()}
    for r in got:
        assert abs(r[1] - expected[r.size.bit_length()]) < 0.05
    assert expected[6] / expected[2] == 3


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    for d in (df, df.limit(0)):
        plan = mixing.plan_mix(d)
        assert all(r.taken == 0 and r.target == 0 for r in mixing.report(plan).collect()) and mixing.mixed(d, plan).count() == 0
