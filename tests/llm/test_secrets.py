import hashlib
import random
import re

from millrace.llm import secrets as s

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(t, scope=200):
    t = t or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    weak = [(m.start(), k, m.end()) for k, p in ((3, s.KEY_ID), (4, s.KEY), (5, s.ENDPOINT)) for m in re.finditer(p, t)]
    ids = [x for x in base + weak if x[1] in (1, 3)]
    secrets = [x for x in base + weak if x[1] in (0, 2, 4)]
    near = lambda x, ys: any(y[0] <= x[2] + scope and y[2] + scope >= x[0] for y in ys)
    linked = [x for x in weak if (x[1] == 3 and near(x, secrets)) or (x[1] == 4 and near(x, ids)) or (x[1] == 5 and near(x, ids) and near(x, secrets))]
    show = lambda xs: ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in sorted(xs))
    n = [sum(x[1] == k for x in base) for k in range(3)]
    return *n, hashlib.sha256(show(base).encode()).hexdigest(), show(base + linked), len(linked)


PARTS = [
    "password=hunter2x", "Token: 'abc'", "token=token:abcdef", "secret = \"s3cr3t.value\"", "API_KEY=ABCDEFGH", "apikey:=xx", "AKIA" + "Q" * 16, "AKIA" + "Z9" * 5, "AKIAAKIA" + "B" * 12, "0123456789abcdef" * 2, "deadbeef" * 3 + "G", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12",
    "https://db.example.org/x", "http://h", "passwd: ", "é漢🙂", "\n", "=",
]


def test_like_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", *PARTS, " ".join(PARTS), "password=abcdef " * 700, "a" * 24 + "x" + "f" * 50]
    for _ in range(300):
        texts.append("".join(rng.choice(PARTS) + rng.choice([" ", "", "\n", "é" * rng.randint(0, 150)]) for _ in range(rng.randint(1, 9))))
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, assign string")
    out = s.find_secrets(df)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans, r.n_linked) for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t
    assert s.find_secrets(df.limit(0)).count() == 0


def test_many_spans_in_one_text(spark):
    """20,000 identifiers, secrets and URLs in one text, near each other in the first half only."""
    import time

    near = [f"id ASIA{i:08d}XY key deadbeefdeadbeefdeadbeef{i:08x} at https://h{i}.example/x" for i in range(20000)]
    far = [f"at https://h{i}.example/x" for i in range(20000)]
    df = spark.createDataFrame([(1, "\n".join(near) + " " * 500 + "\n".join(far))], "doc_id long, text string")
    began = time.time()
    r = s.find_secrets(df).first()
    assert r.n_hex == 20000 and r.n_linked == 40000
    assert time.time() - began < 60
