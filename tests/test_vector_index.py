"""Vector search against all pairs in numpy."""

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import vector_index as V
from millrace.operators.retrieval import top
from millrace.sources.runs import Runs

SCHEMA = "id string, v array<double>, tenant_id string, user_id string, session_id string, content string"


def brute(rows, queries, k):
    out = {}
    for qid, q in queries:
        scored = []
        for i, v in rows:
            ok = v is not None and q is not None and len(v) == len(q) and None not in v and np.linalg.norm(v) * np.linalg.norm(q) > 0
            scored.append((-round(float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)), 6) + 0.0 if ok else -0.0, i))
        out[qid] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def clustered(n, seed, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 4, (10, dim))
    return [(f"m{i:04}", (centres[i % 10] + rng.normal(0, 0.3, dim)).tolist()) for i in range(n)]


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


def same(a, b):
    return a.keys() == b.keys() and all([x for x, _ in a[q]] == [x for x, _ in b[q]] and np.allclose([s for _, s in a[q]], [s for _, s in b[q]], atol=2e-6) for q in a)


def test_index_is_exact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    rows = [*clustered(400, 1), ("zero", [0.0] * 8), ("short", [1.0]), ("null", None), ("hole", [None] + [1.0] * 7)] + [(f"same{i}", [1.0] * 8) for i in range(30)]
    queries = [(i, v) for i, (_, v) in enumerate(clustered(7, 2))] + [(90, [1.0] * 8), (91, [0.0] * 8), (92, [2.0]), (93, None)]
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    df = spark.createDataFrame([(i, v, "t", f"u{k % 2}", f"s{k % 7}", "x" if k % 5 else "[redacted]") for k, (i, v) in enumerate(rows)], SCHEMA).repartition(3)
    assert same(got(top(V.nearest(df, q, 5, "id", "v"), 5, "id")), brute(rows, queries, 5))
    index = V.VectorIndex(Runs(spark, f"file://{tmp_path}/v"), clusters=12, sample=200)
    assert index.search(q, 5).count() == 0
    index.upsert(df.withColumn("v", F.when(F.col("id") < "m0100", F.array(F.lit(9.0))).otherwise(F.col("v"))))
    index.upsert(df.where("id < 'm0100'"))
    assert same(got(index.search(q, 5)), brute(rows, queries, 5))
    index.delete(df.where("id like '%3'").select("id"))
    index.delete(F.col("session_id") == "s2")
    left = [(k, r) for k, r in enumerate(rows) if not r[0].endswith("3") and k % 7 != 2]
    assert same(got(index.search(q, 6)), brute([r for _, r in left], queries, 6)) and index.count().first().n == len(left)
    assert same(got(index.search(q, 6, F.col("user_id") == "u1")), brute([r for k, r in left if k % 2], queries, 6))
    found = index.messages(q, 6, "t", "u1", "s4").collect()
    assert found and all(r.session_id == "s4" and r.content == "x" for r in found)


def test_clusters_are_left_out(spark, tmp_path, monkeypatch):
    index = V.VectorIndex(Runs(spark, f"file://{tmp_path}/w"), clusters=10)
    index.upsert(spark.createDataFrame([(i, v, "t", "u", "s", "x") for i, v in clustered(300, 3)], SCHEMA))
    read = []
    plain = index._scan
    monkeypatch.setattr(index, "_scan", lambda rows, ids, asked, k, needed: read.append(needed.sum()) or plain(rows, ids, asked, k, needed))
    q = spark.createDataFrame([(0, clustered(1, 4)[0][1])], "query_id long, embedding array<double>")
    assert index.search(q, 5).count() == 5 and sum(read) < 8


def test_pairs_keep_a_column_without_a_join(spark, tmp_path):
    import __spark_entry__ as E

    df = E.queries()["cosine_scan"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange hashpartitioning" not in plan
    assert df.where("norm is not null").count() == df.count() > 0
    plan = E.queries()["approx_distinct"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("approx_count_distinct" in line and "count(distinct" in line for line in plan.split("\n")), plan
