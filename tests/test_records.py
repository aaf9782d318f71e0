"""Record, table and answer text against plain Python."""

import random
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import records as N
from millrace.functions import text as T


def run(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_clean_text(spark):
    texts = [None, "", " a\x00b\tc ", "ｆｕｌｌ　width ①", "é\n\né", "x y"]
    want = [re.sub(r"\s+", " ", unicodedata.normalize("NFKC", re.sub(r"[\x00-\x1f\x7f]+", " ", t or ""))).strip() for t in texts]
    assert run(spark, texts, N.clean_text) == want


def test_html_text(spark):
    page = "<html><head><style>x{}</style></head><nav>menu</nav><p>One <b>two</b></p><script>var a='<p>';</script><a href='u'>link</a> &amp; end<footer>f</footer>"
    assert run(spark, [page, None, ""], N.html_text) == ["One two link & end", None, ""]
    assert run(spark, [page], lambda c: N.html_text(c, links=True)) == ["One two link (u) & end"]


def test_ocr_lines(spark):
    text = "a line that\ngoes on here.\nNew one\n\nand more\n漢字 starts"
    assert run(spark, [text], N.merged_lines) == ["a line that goes on here.\nNew one and more\n漢字 starts"]
    assert run(spark, ["a | b\nc | d\ne | f", "one two", "a  b\nc  d\ne f\n", "x\ny"], N.table_like) == [True, False, True, False]
    assert run(spark, ["hyphen-\nated  words.. here", None, ""], N.postprocess_ocr) == ["hyphenated words. here", "", ""]


def test_tables_in_texts(spark):
    md = "| a | b |\n|---|:-:|\n| 1 | |\ntext\n| 2 | x y |"
    html = "<p>x</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><b>2</b></td></tr><tr></tr></table><table><tr><td>no</td></tr></table>"
    texts = [md, html, '[{"a": 1, "b": null}, {"c": "z", "a": 2}]', 'a,b\n"x, y",2\n,\n', "plain text", None, ""]
    assert run(spark, texts, N.table_extract) == ["a | b\n1 | \n2 | x y", "a | b\n1 | 2", "a | b | c\n1 |  | \n2 |  | z", "a | b\nx, y | 2", "plain text", "", ""]


def test_metadata(spark):
    df = spark.range(1).select(N.metadata(F.create_map(*map(F.lit, ("Created", "at 2021-3-4", "TAG", "a; b,,c", "My Key!", " x  y ", "writer", "W", "name", "first", "Title", "last")))).alias("m"))
    assert df.first().m == {"created_at": "2021-03-04T00:00:00", "tags": "a,b,c", "my_key": "x y", "author": "W", "title": "last"}


def test_json_and_summary(spark):
    texts = ['{"a": 1}', 'see ```json\n{"b": 2}\n``` ok', 'so {"c": {"d": 3}} it is', "none", "{broken", None, ""]
    assert run(spark, texts, N.json_in_text) == ['{"a": 1}', '{"b": 2}', '{"c": {"d": 3}}', None, None, None, None]
    df = spark.createDataFrame([(["x" * 30 + "\n" + "y" * 100],), (["a", "b"],), ([],)], "f array<string>")
    assert [r.s for r in df.select(N.summary(F.col("f"), 40).alias("s")).collect()] == ["x" * 30 + "\n[... truncated ...]", "a\n\nb", "No relevant messages found"]


def test_names_and_masks(spark):
    assert run(spark, ["我叫小明。", "我是谁", "我叫" + "x" * 21, "叫Bob", "hello", None], N.said_name) == ["小明", None, None, "Bob", None, None]
    text = "13812345678 x.yz@ab.org 6222021234567890123 110105200003071233 +44 1234567890"
    assert run(spark, [text], N.audit_mask) == ["138****5678 x.***@ab.org 6222**********0123 110105********1233 +44****7890"]


def test_search_terms(spark):
    def brute(q, most=10):
        q = q.strip()
        if not q:
            return []
        whole = re.sub(r"[\s,，。！？、；;]+", "", q)
        every = re.split(r"[\s,，。！？、；;]+", q) + re.findall("[A-Za-z0-9_]{2,}", q) + [whole] + ([whole[i : i + 2] for i in range(len(whole) - 1)] if len(whole) >= 4 else [])
        return list(dict.fromkeys(t for t in every if len(t) >= 2))[:most] or [q]

    texts = ["", "a", "扫地机器人怎么保养", "hello, big world; x", "  ab  ", "漢字", "aaaaaa 中文"]
    assert run(spark, texts, N.search_terms) == [brute(t) for t in texts]


def test_chains_and_measures(spark):
    """The default chain step by step, the match text, the OCR confidence."""
    texts = ["<p>Call 13812345678</p>  now，please\n\n\n\nCopyright x\nend", ""]
    assert run(spark, texts, lambda c: T.chain(c, T.CHAINS["default"])) == [run(spark, [t], lambda c: T.noise(T.privacy(T.whitespace(T.special_chars(T.html_tags(T.encoding(c))))))) [0] for t in texts]
    assert run(spark, ["A，b. c（d）"], T.match_text) == ["Abcd"]

    def confidence(s):
        if not s:
            return 0.0
        bad = sum(not re.match(r"[A-Za-z0-9一-鿿\s.,!;:'\"\-()\[\]{}\\/]", c) for c in s)
        return round(max(0.0, 1 - min(0.8, bad / len(s) + 0.05 * len(re.findall(r"(.)\1{4,}", s)))), 3)

    rng = random.Random(1)
    texts = ["", "aaaaaa", "§§§§§§§", *("".join(rng.choice("ab §é1.") for _ in range(30)) for _ in range(30))]
    assert run(spark, texts, T.ocr_confidence) == [confidence(t) for t in texts]


def test_threats_name_the_code_point(spark):
    assert run(spark, ["a​b", "a\U000e0041b", "fine"], T.threat) == ["Invisible Unicode U+200B detected", "Invisible Unicode U+E0041 detected", None]


def test_duplicate_lines(spark):
    def brute(t):
        seen, out = set(), []
        for x in t.split("\n"):
            k = re.sub(r"\s+", " ", x.strip()).lower()
            if len(x.strip()) >= 10:
                if k in seen:
                    continue
                seen.add(k)
            out.append(x)
        return re.sub(r'(.{20,}")\1+', r"\1", "\n".join(out))

    rng = random.Random(2)
    texts = ["", "a\na\na", 'the words that were said here" ' * 1 + 'the words that were said here"the words that were said here"'] + ["\n".join(rng.choice(["long line  one", "Long line one", " another long line", "x", "", "yet a third line"]) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    assert run(spark, texts, T.duplicate_lines) == [brute(t) for t in texts]
    many = "\n".join(f"line number {i % 20000}" for i in range(40000))
    assert run(spark, [many], T.duplicate_lines)[0].count("\n") == 19999


def test_contexts(spark):
    df = spark.createDataFrame([("1. What is it?", "What is it, then"), ("", "x"), ("abc", "abd"), ("The long passage of some words here", "xx the Long passage"), ("q", "q")], "a string, b string")
    assert [r.m for r in df.select(N.contexts_match(F.col("a"), F.col("b")).alias("m")).collect()] == [True, False, False, False, True]


def test_line_dedupe_like_sql(spark, tmp_path):
    """Repeated quotes within a line stay, as in the SQL."""
    import __spark_entry__ as E
    import duckdb

    said = 'she said that it was "so"'
    rows = [(0, said + said + "\nx"), (1, f"{said}\n{said}"), (2, None), (3, "no mark at all, no mark at all")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in E.queries()["line_dedupe"](spark, str(tmp_path)).collect())
    assert got == sorted(db.execute(E.oracle_sql()["line_dedupe"]).fetchall())
    assert run(spark, [said + said], T.duplicate_lines) == [said]


def test_lambdas_use_values_that_are_worked_out_once(spark):
    """A parse or a key inside a lambda is repeated for each element, which takes quadratic time."""
    plan = lambda c: spark.range(1).select(F.col("id").cast("string").alias("c")).select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(N.json_rows(F.col("c"))).count("from_json") == 1
    assert plan(N.metadata(F.create_map(F.col("c"), F.lit("v")))).count("translate(") == 1
    many = "[" + ",".join(f'{{"a": {i}, "b{i % 3}": null}}' for i in range(2000)) + "]"
    got = spark.createDataFrame([(many,), ("[1]",), (None,)], "c string").select(N.json_rows(F.col("c")).alias("x")).collect()
    assert got[0].x == [["a", "b0", "b1", "b2"]] + [[str(i), "", "", ""] for i in range(2000)] and got[1].x == [] and got[2].x == []


def test_nfkc_sends_texts_in_pieces_and_no_plain_ones(spark, monkeypatch):
    """Texts go back a piece at a time, not as a whole Arrow batch; those of ASCII alone are not sent."""
    monkeypatch.setattr(N, "TEXTS", 3)
    rows = [None, "", "plain  text", "ﬁne １２", "é", "　x y"] * 5
    sizes = [len(b) for b in N.nfkc.func(iter([pa.array(rows, pa.string())]))]
    assert sizes == [3] * 10
    got = [b for x in N.nfkc.func(iter([pa.array(rows, pa.string())])) for b in x.to_pylist()]
    assert got == [None if x is None else unicodedata.normalize("NFKC", x) for x in rows]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    found = [r.t for r in df.select("i", N.clean_text(F.col("t")).alias("t")).orderBy("i").collect()]
    assert found == [" ".join(unicodedata.normalize("NFKC", x or "").split()) for x in rows]
