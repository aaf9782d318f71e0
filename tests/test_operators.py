import hashlib
import re

from pyspark.sql import functions as F

from millrace import catalog
from millrace.operators import graph as G
from millrace.operators import retrieval as R
from millrace.operators import sessions as S


def lists(spark):
    a = spark.createDataFrame([(1, "x", 3.0, 1), (1, "y", 1.0, 2)], "query_id int, id string, score double, rank int")
    b = spark.createDataFrame([(1, "y", 9.0, 1), (1, "z", 9.0, 2)], "query_id int, id string, score double, rank int")
    return [a, b]


def test_fusion(spark):
    got = {n: {r.id: r.score for r in R.fuse(lists(spark), n).collect()} for n in R.FUSIONS}
    assert got["rrf"] == {"x": round(1 / 61, 9), "y": round(1 / 62 + 1 / 61, 9), "z": round(1 / 62, 9)}
    assert got["weighted"] == {"x": 0.5, "y": 0.5, "z": 0.5}
    assert got["cascade"] == {"x": 3.0, "y": 1.0, "z": 9.0}
    assert got["first_match"] == {"x": 3.0, "y": 1.0}


def test_filters(spark):
    df = spark.createDataFrame([("a", ["p", "q"]), ("b", ["q"]), (None, None)], "doc_id string, tags array<string>")
    assert [r.doc_id for r in R.tag_filter(df, "tags", ["p", "q"], True).collect()] == ["a"]
    assert sorted(r.doc_id for r in R.tag_filter(df, "tags", ["q"]).collect()) == ["a", "b"]
    assert sorted(str(r.doc_id) for r in R.acl_filter(df, df.where("doc_id = 'a'")).collect()) == ["None", "a"]
    assert R.acl_filter(df, None).count() == 3


def test_decay(spark):
    r = spark.sql("SELECT timestamp '2024-01-01' AS now, timestamp '2023-10-03' AS old, timestamp '2025-01-01' AS later, cast(null as timestamp) AS none")
    x = r.select(*[R.time_decay(F.lit(None), F.col(c), F.col("now")).alias(c) for c in ("old", "later", "none")]).first()
    assert (x.old, x.later, x.none) == (0.5, 1.0, 1.0)


def test_sessions(spark):
    m = spark.createDataFrame([("s", i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(["a", "b", "b", "a", "a"])], "session string, ts long, role string, text string")
    assert [r.ts for r in S.scroll(m, m.where("ts = 2").select("session", "ts"), 1, 1).orderBy("ts").collect()] == [1, 2, 3]
    assert [(r.text, r.ts) for r in S.recent_user(m, 2).orderBy("ts").collect()] == [("a", 0), ("b", 2)]
    assert [r.ts for r in S.tail_budget(m, 18).orderBy("ts").collect()] == [3, 4]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.hops for r in G.k_hops(e, seed, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.dst: r.path for r in G.shortest_paths(e, seed, 5).collect()}["d"] == ["a", "b", "c", "d"]
    t = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "id int, parent int")
    assert {r.id: r.root for r in G.lineage_roots(t).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 9}


def test_lineage_of_any_depth(spark):
    """Chains of 17, 40 and 100 parents, a cycle of 20 rows with a tail of 3 rows, a row of its own parent, and a parent that is not there."""
    parents, want = {}, {}
    for start, n in ((1000, 17), (2000, 40), (3000, 100)):
        parents |= {start: None} | {start + i: start + i - 1 for i in range(1, n + 1)}
        want |= dict.fromkeys(range(start, start + n + 1), start)
    parents |= {4000 + i: 4000 + (i + 1) % 20 for i in range(20)} | {4020: 4000, 4021: 4020, 4022: 4021}
    parents |= {5000: 5000, 5001: 5000, 6001: 6000, 6002: 6001}
    want |= {i: i for i in parents if i >= 4000} | {5001: 5000}
    t = spark.createDataFrame(list(parents.items()), "id int, parent int")
    assert {r.id: r.root for r in G.lineage_roots(t).collect()} == want
    assert G.lineage_roots(t.limit(0)).count() == 0


def test_minhash_of_all_documents(spark, tmp_path):
    texts = [None, "", " .,;", "one", "one two", "Copy of a text", "Copy of a text", "漢字 and Latin a1", "a b c " * 40]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(text):
        w = re.findall("[\u4e00-\u9fff]+|[A-Za-z0-9]+", text or "")
        parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or w
        least = [min((hashlib.sha256(f"{s}:{x}".encode()).hexdigest()[:16] for x in parts), default="0" * 16) for s in range(64)]
        return hashlib.md5(",".join(least).encode()).hexdigest()

    got = {r.doc_id: r.signature for r in catalog.queries()["minhash_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_queries_of_filters_hybrid_and_entities(spark, tmp_path):
    docs = [(0, "AB-12 and AB-12, XY99", "en", "src1"), (100, "red fox", "en", "src2"), (2, None, "de", "src1"), (3, "red", "en", "src1")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1), (2, 1), (3, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(100, "fox")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(100, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = {n: catalog.queries()[n](spark, str(tmp_path)).collect() for n in ("tag_filter", "acl_filter", "entity_edges", "hybrid_topk")}
    assert sorted(r.doc_id for r in rows["tag_filter"]) == [0, 3]
    assert sorted(r.doc_id for r in rows["acl_filter"]) == [0, 2]
    assert sorted(map(tuple, rows["entity_edges"])) == [(0, "AB-12"), (0, "XY99")]
    assert min((r.rank, r.id) for r in rows["hybrid_topk"]) == (1, 100)
