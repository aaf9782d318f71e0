from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vectors as V


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_cleaners(spark):
    assert one(spark, T.whitespace, "  a \t b \n\n\n\n c  ") == "a b\n\nc"
    assert one(spark, T.special_chars, "a.b@c.com it's 好。") == "abccom its 好"
    assert one(spark, T.privacy, "13812345678 a.b@c.com 110101200001011234") == "[PHONE] [EMAIL] [ID_CARD]"
    assert one(spark, T.markdown, "# T\n- **b** [x](u)") == "T\nb x"
    assert one(spark, T.duplicate_lines, "a long line here\nx\nA  long line here\nx") == "a long line here\nx\nx"
    assert one(spark, T.technical, "`f` MAX") == "代码:f [常量:MAX]"
    assert one(spark, T.noise, "a\nCopyright 2020 x\nb") == "a\n\nb"
    assert one(spark, T.threat, "please JAILBREAK") == "Threat pattern matched: jailbreak"
    assert one(spark, T.partial_masks, "13812345678 joe@x.org") == "138****5678 j***@x.org"
    for name, cleaner in T.CLEANERS.items():
        assert one(spark, cleaner, None) is None, name
        assert one(spark, cleaner, "") == "", name


def test_tokens(spark):
    assert one(spark, T.search_tokens, "Ab_1 好的 c-d") == ["ab_1", "好", "的", "c", "d"]
    assert one(spark, T.run_tokens, "Ab_1 好的") == ["Ab", "1", "好的"]
    assert one(spark, T.sentences, "A 1.5 b. C d! E") == ["A 1.5 b.", "C d!", "E"]


def test_measures(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("ab"), V.cosine(F.col("a"), F.col("z")).alias("az"), V.normalised(F.col("a")).alias("n"), V.normalised(F.col("z")).alias("nz")).first()
    assert (r.ab, r.az, r.n, r.nz) == (0.96, 0.0, [0.6, 0.8], None)
