"""Relations, evidence and graph operators on small tables."""

from pyspark.sql import functions as F

from millrace.operators import evidence as E
from millrace.operators import graph as G
from millrace.operators import relations as R
from millrace.operators import sessions as S


def test_lineage_of_any_depth(spark):
    """A chain of 1,000, a cycle with a tail, a parent that is not there."""
    rows = [(i, i - 1 if i else None) for i in range(1000)] + [(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2000), (3000, 9999)]
    got = {r.id: r.root for r in G.lineage_roots(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert all(got[i] == 0 for i in range(1000))
    assert all(got[i] == i for i in (2000, 2001, 2002, 2003, 3000))


def test_lineage_dedupe(spark):
    parents = spark.createDataFrame([("a", None), ("b", "a"), ("c", None), ("d", "c")], "id string, parent string")
    hits = spark.createDataFrame([("a", 0.5, 2), ("b", 0.9, 1), ("d", 0.9, 5), ("c", 0.9, 3), ("x", 0.1, 1)], "session string, score double, ts int")
    got = {r.root: (r.session, r.score) for r in G.lineage_dedupe(hits, parents).collect()}
    assert got == {"a": ("b", 0.9), "c": ("c", 0.9), "x": ("x", 0.1)}
    assert {r.root for r in G.lineage_dedupe(hits, parents, "d").collect()} == {"a", "x"}


def test_bookends_with_ties(spark):
    m = spark.createDataFrame([("s", 1, "user", "b"), ("s", 1, "user", "a"), ("s", 2, "user", "y"), ("s", 2, "user", "z")], "session string, ts int, role string, text string")
    assert [(r.first_text, r.last_text) for r in S.bookends(m).collect()] == [("a", "z")]


def test_joins(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "j", 9)], "id int, key string, t int")
    right = spark.createDataFrame([("k", 2, "old"), ("k", 5, "now"), ("k", 6, "late")], "key string, t int, v string")
    assert {r.id: r.v for r in R.asof_join(left, right, "key", "t", "v").collect()} == {1: "now", 2: None, 3: None}
    points = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.5, 10.0)], "x double")
    spans = spark.createDataFrame([("a", 0.5, 2.5), ("b", 2.5, 99.0), ("c", 5.0, 4.0)], "n string, lo double, hi double").where("lo <= hi")
    assert {(r.x, r.n) for r in R.interval_join(points, spans, "x", "lo", "hi", 2.0).collect()} == {(1.0, "a"), (2.5, "a"), (2.5, "b"), (10.0, "b")}


def test_parents_and_names(spark):
    hits = spark.createDataFrame([(1, "a", "p", 0.9), (1, "b", "p", 0.8), (1, "c", None, 0.7)], "query_id int, id string, parent_id string, score double")
    got = [(r.id, r.rank, r.parent_text) for r in R.parents_of(hits, spark.createDataFrame([("p", "P")], "parent_id string, text string")).orderBy("rank").collect()]
    assert got == [("a", 1, "P"), ("c", 2, None)]
    names = spark.createDataFrame([("acme", "c1", "Acme Corp"), ("beta", "c2", "Beta Inc")], "alias string, canonical_id string, display_name string")
    m = spark.createDataFrame([("acme",), ("Inc",), ("none",)], "mention string")
    assert {r.mention: r.canonical_id for r in R.resolved(m, names).collect()} == {"acme": "c1", "Inc": "c2"}


def test_rules_and_titles(spark):
    df = spark.createDataFrame([("Some Text", "/x/y.tar.gz")], "t string, p string")
    tags, names = R.rule_tags(F.col("t"), [("r", ["text"], "any", ["a"]), ("s", ["no", "text"], "all", ["b"])], F.array(F.lit("own")), F.col("p"), {"gz": ["zip"]})
    assert tuple(df.select(tags.alias("t"), names.alias("n")).first()) == (["own", "a", "file:y.tar", "zip"], ["r"])
    t = spark.createDataFrame([("a",), ("a #2",), ("a #19",)], "t string")
    assert [r.x for r in t.select(R.child_title(F.col("t")).alias("x")).collect()] == ["a #2", "a #3", "a #20"]


def test_evidence(spark):
    a = spark.createDataFrame([(1, "same line\nshort\nabc")], "query_id int, text string")
    b = spark.createDataFrame([(1, "Same line \nother line")], "query_id int, text string")
    got = [(r.place, r.source, r.line) for r in E.fused_lines(a, b).orderBy("place").collect()]
    assert got == [(1, "recall", "same line"), (2, "recall", "short"), (3, "rag", "other line")]
    blocks = spark.createDataFrame([(1, 1, "x" * 50), (1, 2, "y" * 200), (1, 3, "z")], "query_id int, rank int, text string")
    assert [(r.rank, len(r.shown), r.cut) for r in E.budgeted(blocks, 150, 5, 80).orderBy("rank").collect()] == [(1, 50, False), (2, 100, True)]
    one = spark.createDataFrame([("a", 1), ("", 2), ("b", 3)], "id string, rank int")
    two = spark.createDataFrame([("b", 1)], "id string, rank int")
    assert {r.id: round(r.score, 6) for r in E.message_rrf([one, two]).collect()} == {"a": round(1 / 61, 6), "b": round(1 / 63 + 1 / 61, 6)}


def test_graph_text(spark):
    n = spark.createDataFrame([("a", {"k": "v"}), ("b", {})], "node string, props map<string,string>")
    e = spark.createDataFrame([("a", "b", "T"), ("b", "c", "U")], "src string, dst string, edge_type string")
    assert G.linearised(n, e).first().text == "- a (k=v)\n- b\na -> b\nb -> c"
    assert [r.neighbour for r in G.neighbours(e, spark.createDataFrame([("b",)], "node string"), types=["U"]).collect()] == ["c"]
    m = G.mentions(spark.createDataFrame([(1, "AB-12 and CD34, AB-12")], "doc_id int, text string")).orderBy("ord").collect()
    assert [(r.src, r.dst) for r in m] == [(1, "AB-12"), (1, "CD34")]
    nodes, edges = G.without_nodes(n, e, spark.createDataFrame([("b",)], "node string"))
    assert [r.node for r in nodes.collect()] == ["a"] and edges.count() == 0
    up = {r.node: r.props for r in G.upserted_nodes(n, spark.createDataFrame([("a", {"x": "y"}), ("z", {})], n.schema)).collect()}
    assert up == {"a": {"k": "v", "x": "y"}, "b": {}, "z": {}}


def test_parents_are_capped_and_children_stay(spark):
    hits = [(1, 10, 1, 0.9), (1, 11, 1, 0.8), (1, 12, None, 0.7), (1, 13, 2, 0.6), (1, 14, 99, 0.5), (1, 15, 3, 0.4), (1, 16, 3, 0.3), (1, 17, 2, 0.2), (1, 18, None, 0.1), (1, 2, None, 0.05)]
    df = spark.createDataFrame(hits, "query_id int, id int, parent_id int, score double")
    parents = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "")], "parent_id int, text string")
    got = [(r.id, r.parent_text) for r in R.parents_of(df, parents, 2).orderBy("rank").collect()]
    assert got == [(10, "one"), (12, None), (13, "two"), (14, None), (15, None), (16, None), (18, None), (2, None)]


def test_user_fallback(spark):
    from millrace.operators.evidence import user_fallback

    rows = [(i, f"s{i % 2}", "user" if i % 3 else "assistant", f"word {'Alpha' if i % 4 == 0 else 'alpha'} {'beta' if i % 8 == 0 else ''}", i) for i in range(100)]
    df = spark.createDataFrame(rows, "message_id int, session_id string, role string, content string, ts int")
    window = [r for r in sorted(rows, key=lambda r: -r[4])[:80] if r[2] == "user"]
    hits = [(sum(t in r[3] for t in ("Alpha", "beta")), r) for r in window]
    want = [r[0] for h, r in sorted(((h, r) for h, r in hits if h), key=lambda x: (-x[0], x[1][4]))][:2]
    assert [r.message_id for r in user_fallback(df, "Alpha  beta x", 2).collect()] == want
    assert [r.message_id for r in user_fallback(df, "x", 2).collect()] == [98, 97]
    assert [r.message_id for r in user_fallback(df, " ", 2, "s1").collect()] == [97, 95]
    assert user_fallback(df, "gamma", 2).count() == 0


def test_listing_and_ids(spark):
    kind = "session_id string, status string, started_at string, ended_at string"
    online = spark.createDataFrame([("a", "closed", "3", None), ("b", "archived", "2", None), ("c", None, None, "9")], kind)
    cold = spark.createDataFrame([("a", "x", "1", None), ("d", "x", None, "5")], kind)
    assert [(r.session_id, r.storage) for r in R.merged_listing(online, cold).collect()] == [("c", "online"), ("d", "cold"), ("a", "online_closed"), ("b", "cold")]
    ids = ["x", "y", "x", "z", "x", "x-dup2", "y"]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(ids)], "id string, n int").repartition(3)
    want, seen = [], set()
    for i, t in enumerate(ids):
        t = f"{t}-dup{i}" if t in seen else t
        seen.add(t)
        want.append(t)
    assert [r.id for r in R.distinct_ids(df, "id", "n").orderBy("n").collect()] == want
    assert R.distinct_ids(df.limit(0), "id", "n").count() == 0


def test_faulty_patterns_and_first_names_in_order(spark):
    df = spark.createDataFrame([("Ask", ["ask me"], ["(", "a.k", r"(?P<n>A)sk", None], "Title", None)], "q string, t array<string>, p array<string>, title string, s string")
    assert df.select(R.skill_score(F.col("q"), F.col("t"), F.col("p"), F.col("title"), F.col("s"))).first()[0] == 1 + 4
    names = spark.createDataFrame([(0, "zed corp", "Z1", "Zed"), (1, "acme", "A1", "Acme corp"), (2, "Acme", "A2", "x")], "ord int, alias string, canonical_id string, display_name string")
    m = spark.createDataFrame([("Acme",), ("corp",), ("ACME",), ("e",), ("none",)], "mention string")
    assert {r.mention: r.canonical_id for r in R.resolved(m, names).collect()} == {"Acme": "A2", "corp": "Z1", "ACME": "A1", "e": "Z1"}


def test_tags_are_stripped_and_long_stems_left_out(spark):
    df = spark.createDataFrame([(" a ; b|| a", "/x/" + "n" * 65 + ".txt"), (None, "/x/ok.txt")], "tags string, p string")
    tags, _ = R.rule_tags(F.lit("text"), [("r", ["text"], "any", [" t "])], R.listed_tags(F.col("tags")), F.col("p"))
    assert [r[0] for r in df.select(tags).collect()] == [["a", "b", "t"], ["t", "file:ok"]]


def test_user_fallback_in_each_session(spark):
    from millrace.operators.evidence import user_fallback

    rows = [(i, f"s{i % 40}", "user" if i % 3 else "assistant", f"word {'Alpha' if i % 4 == 0 else ''} {'beta' if i % 8 == 0 else ''}", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "message_id int, session_id string, role string, content string, ts int")
    for q in ("Alpha beta", "x"):
        got = sorted(r.message_id for r in user_fallback(df, q, 2, each=True).collect())
        assert got == sorted(r.message_id for s in range(40) for r in user_fallback(df.where(f"session_id = 's{s}'"), q, 2).collect())
        assert len(got) > 2
