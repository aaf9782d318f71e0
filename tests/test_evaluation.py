"""Measures, golden chunks, page tables and tool pairs against plain loops."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace import work
from millrace.catalog import queries
from millrace.functions.records import contexts_match
from millrace.operators import evaluation as E
from millrace.operators import page_tables as P
from millrace.operators import sessions as S

TEXTS = ["", " ", "1. alpha beta gamma delta epsilon", "alpha beta gamma delta epsilon", "alpha beta gamma delta epsilon and much more text of it", "zeta", "the zeta function", "12 short", "short", "completely different words here", "2. alpha beta gamma", "eta theta iota kappa lambda mu nu xi omicron"]


def test_scores(spark):
    rng = random.Random(1)
    refs = [(q, i, rng.choice(TEXTS)) for q in range(25) for i in range(rng.randint(0, 3))] + [(99, 0, "zeta")]
    hits = [(q, r, rng.choice(TEXTS)) for q in range(25) for r in range(rng.randint(0, 6))]
    pairs = spark.createDataFrame([(a, b) for a in TEXTS for b in TEXTS], "a string, b string")
    same = {(r.a, r.b) for r in pairs.where(contexts_match(F.col("a"), F.col("b"))).collect()}
    got = {r.query_id: r for r in E.ir_scores(spark.createDataFrame(refs, "query_id int, ref_no int, text string"), spark.createDataFrame(hits, "query_id int, rank int, text string"), (1, 3)).collect()}
    assert set(got) == {q for q, _, _ in refs}
    for q, row in got.items():
        r = [t for x, _, t in refs if x == q and t.strip()]
        h = [t for x, _, t in sorted(hits) if x == q and t.strip()]
        rel = [int(any((a, b) in same for a in r)) for b in h]
        for k in (1, 3):
            cut = rel[:k]
            ideal = sum(v / math.log2(i + 2) for i, v in enumerate(sorted(cut, reverse=True)))
            want = {"hit": float(any(cut)), "mrr": next((1 / (i + 1) for i, v in enumerate(cut) if v), 0.0), "ndcg": sum(v / math.log2(i + 2) for i, v in enumerate(cut)) / ideal if ideal else 0.0, "recall": sum(any((a, b) in same for b in h[:k]) for a in r) / len(r) if r else 0.0}
            for name, x in want.items():
                assert math.isclose(row[f"{name}_{k}"], x, abs_tol=1e-6), (q, name, k)
    assert E.mean_scores(spark.createDataFrame([(1, 0.5), (2, 1.0)], "query_id int, hit_1 double")).first().hit_1 == 0.75


def test_best_chunks(spark):
    lines = [(i, i % 4, t) for i, t in enumerate(TEXTS)]
    chunks = [(f"c{i}", i, i % 3 if i % 2 else None, t) for i, t in enumerate(reversed(TEXTS))]
    ldf, cdf = spark.createDataFrame(lines, "line_id int, number int, text string"), spark.createDataFrame(chunks, "chunk_id string, ord int, number int, text string")
    pairs = ldf.alias("l").crossJoin(cdf.alias("c")).where(contexts_match(F.col("l.text"), F.col("c.text"), 16)).select("line_id", "chunk_id").collect()
    want = {}
    for i, c in pairs:
        number = lines[i][1]
        row = next(x for x in chunks if x[0] == c)
        want.setdefault(i, []).append((0 if row[2] == number else 1, row[1], c))
    assert {r.line_id: r.chunk_id for r in E.best_chunks(ldf, cdf).collect()} == {i: min(x)[2] for i, x in want.items()}


def html(head, rows):
    return "<table><tr><th>" + head + "</th></tr>" + "".join(f"<tr><td>{r}</td></tr>" for r in rows) + "</table>"


def merged(pages):
    """A walk over the pages with the table of the last one in hand. pages: lists of (label, html, name)."""
    if len(pages) < 2:
        return [(n, h) for p in pages for _, h, n in p]
    out, hand = [], None
    for p in pages:
        p = list(p)
        if hand is not None:
            if p and p[0][0] == "table" and re.search("<th>(.*?)</th>", p[0][1])[1] == re.search("<th>(.*?)</th>", hand[1])[1]:
                more = re.findall("<tr>.*?</tr>", p.pop(0)[1])[1:]
                hand = (hand[0], hand[1].replace("</table>", "".join(more) + "</table>"), hand[2])
            out.append(hand)
            hand = None
        if p and p[-1][0] == "table":
            hand = p.pop()
        out += [x for x in p if x[0] not in P.DROPPED]
    return sorted((n, h) for _, h, n in ([*out, hand] if hand else out))


def test_tables_over_page_breaks(spark):
    rng = random.Random(4)
    docs, name = {}, 0
    for d in range(60):
        docs[d] = []
        for _ in range(rng.randint(1, 7)):
            page = []
            for _ in range(rng.choice([0, 1, 1, 1, 2, 3]) if rng.random() < 0.9 else 0):
                label = rng.choice(["table"] * 5 + ["text", "footer"])
                page.append((label, html(rng.choice("AB"), [name, name + 1][: rng.randint(0, 2)]) if label == "table" else "t", name))
                name += 1
            docs[d].append(page)
    rows = [(d, p, i, label, h, n) for d, pages in docs.items() for p, page in enumerate(pages) for i, (label, h, n) in enumerate(page)]
    df = spark.createDataFrame(rows, "doc int, page int, idx int, label string, html string, name int")
    got = {}
    for r in P.merged_tables(df).collect():
        got.setdefault(r.doc, []).append((r.name, r.html))
    for d, pages in docs.items():
        full = [p for p in pages if p]
        # a document whose only page with regions is one is left alone, as one of one page is
        want = sorted((n, h) for p in full for _, h, n in p) if len(full) < 2 else merged(pages)
        assert sorted(got.get(d, [])) == want, d
    odd = spark.createDataFrame([("", html("A", [1])), (html("A", [1]), ""), ("<tr><td>x</td></tr>", html("A", [1])), (html("A", []), html("A", []))], "a string, b string")
    assert [r[0] for r in odd.select(P.joined_tables(F.col("a"), F.col("b"))).collect()] == [html("A", [1]), html("A", [1]), "<tr><td>x</td></tr><tr><td>1</td></tr>", html("A", [])]


def test_tool_pairs(spark):
    rng = random.Random(2)
    rows = []
    for s in range(40):
        for t in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "assistant", "tool", "tool", "tool"])
            calls = rng.sample(["a", "b", "c", ""], rng.randint(0, 3)) if role == "assistant" and rng.random() < 0.8 else None
            rows.append((s, t, role, f"m{t}", calls, rng.choice(["a", "b", "c", "d"]) if role == "tool" else None))
    got = {}
    for r in S.repaired_pairs(spark.createDataFrame(rows, "session int, ts int, role string, text string, calls array<string>, call_id string")).orderBy("session", "place").collect():
        got.setdefault(r.session, []).append((r.role, r.text, r.call_id))
    for s in range(40):
        want, asked, seen = [], [], set()

        def end(want=want):
            want += [("tool", "[tool result missing after compression]", c) for c in dict.fromkeys(asked) if c not in seen]

        for _, _, role, text, calls, call in [r for r in rows if r[0] == s]:
            if role == "tool":
                if call in asked:
                    want.append((role, text, call))
                    seen.add(call)
                continue
            end(want)
            asked, seen = [c for c in calls or [] if c], set()
            want.append((role, text, None))
        end(want)
        assert got.get(s, []) == want, s
    m = spark.createDataFrame([("s", 1, "tool", "x" * 300, False), ("s", 2, "tool", "x" * 300, True), ("s", 3, "user", "x" * 300, False), ("t", 1, "user", "abcd", False)], "session string, ts int, role string, text string, in_tail boolean")
    short = S.pruned_results(m)
    assert [r.pruned for r in short.orderBy("session", "ts").collect()] == [True, False, False, False]
    assert {r.session: (r.tokens_before, r.kept) for r in S.worth_compressing(m, short).collect()} == {"s": (225, True), "t": (1, False)}


def test_texts_do_not_travel_with_their_grams(spark, tmp_path, monkeypatch):
    """Lines and chunks that begin alike for 12 characters but are other passages are no candidates; texts are looked at for candidates alone."""
    sizes, plain = {}, E.written
    monkeypatch.setattr(E, "written", lambda df, name: [out := plain(df, name), sizes.setdefault(name, []).append((out.columns, out.count()))][0])
    lines = [(i, None, f"thesamebegin{i:03d}{'xyzuvw'[i % 6] * 20}") for i in range(40)]
    chunks = [(i, i, None, f"thesamebegin{i + 500:03d}{'abcdef'[i % 6] * 20}") for i in range(40)] + [(99, 99, None, "before it " + lines[7][2] + " after it")]
    ldf, cdf = spark.createDataFrame(lines, "line_id int, number int, text string"), spark.createDataFrame(chunks, "chunk_id int, ord int, number int, text string")
    assert [tuple(r) for r in E.best_chunks(ldf, cdf).collect()] == [(7, 99)]
    assert sizes["pairs"] == [(["line_id", "chunk_id"], 1)]


@pytest.mark.parametrize("name", ["tool_pairs", "page_tables"])
def test_order_lines_go_to_tasks_of_bounded_size(spark, monkeypatch, tmp_path, name):
    """Tasks hold about TASK_ROWS lines, however small these are when packed; where they are cut changes nothing."""
    rng = random.Random(2)
    rows = [(rng.randrange(300), rng.randrange(60), rng.randrange(20), rng.randrange(1, 6), rng.choice("AB")) for _ in range(2000)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = queries()[name]
    whole = sorted(map(str, run(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(work, "TASK_ROWS", 100)
    out = run(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == 20
    assert sorted(map(str, out.collect())) == whole and whole
