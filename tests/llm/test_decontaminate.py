import hashlib
import random
import re

import millrace.llm.decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(texts, items, size=13):
    out = []
    for t in texts:
        w, hit, names = words(t), set(), set()
        for name, x in items:
            iw = words(x)
            n = min(size, len(iw))
            for i in range(len(iw) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == iw[i : i + n]:
                        hit.update(range(j, j + n))
                        names.add(str(name))
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_like_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: rng.choice(["ab", "É", "漢字", "c3", "d", "Ee", "x_y"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 5, 12, 13, 14, 30, 200, 13])] + [(11, None), (7, "q-r;s")]
    items[1] = (1, "rare")
    texts = [None, "", "...", "RARE,rare"]
    for _ in range(40):
        t = [word() for _ in range(rng.randint(0, 60))]
        x = rng.choice(items)[1] or ""
        i = rng.randint(0, len(t))
        t[i:i] = x.split()[rng.randint(0, 3) :]
        texts.append(rng.choice([" ", ", ", "\n"]).join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    odd = docs.union(spark.createDataFrame([(None, "RARE"), (None, None), (3, "rare")], docs.schema)).selectExpr("*", "1 as `a.b`", "text as n_hit")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    for room in (400_000, 40):
        monkeypatch.setattr(d, "SHARD_WORDS", room)
        got = {r.doc_id: r for r in d.decontaminate(docs, bench, keep_spans=True).collect()}
        assert [(got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) for i in range(len(texts))] == want
        assert d.clean(odd, bench).count() == sum(not w[4] for w in want) + 1
        assert all(sum(b - a for a, b in r.hit_words) == r.n_hit for r in got.values())
    assert d.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert d.decontaminate(docs.limit(0), bench).count() == 0
