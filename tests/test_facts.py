from pyspark.sql import functions as F

import __spark_entry__ as E
from millrace.functions import metrics as M
from millrace.operators import facts as K


def test_conflicts(spark):
    facts = spark.createDataFrame([("a", "Zhang"), ("b", "x"), ("姓名", "old")], "key string, value string")
    deltas = spark.createDataFrame([("a", "I am zhang!"), ("b", "y"), ("姓名", "new"), ("c", "z"), (None, "q"), ("d", " ")], "key string, value string")
    got = {r.key: (r.strategy, r.resolved_value, r.needs_hitl) for r in K.conflicts(facts, deltas).collect()}
    assert got == {"a": ("overwrite", "I am zhang!", False), "b": ("ask_user", "x", True), "姓名": ("ask_user", "new", True), "c": ("overwrite", "z", True)}
    assert {r.key: r.resolved_value for r in K.conflicts(facts, deltas, "keep_old").collect()}["姓名"] == "old"


def test_upserted(spark):
    facts = spark.createDataFrame([("a", "1", 2), ("a", "0", 1), ("b", "2", 3)], "key string, value string, ord int")
    new = spark.createDataFrame([("a", "0", None), ("b", "3", "api"), ("c", "4", None)], "key string, value string, source string")
    got = {r.key: (r.old, r.value, r.source, r.changed) for r in K.upserted(facts, new).collect()}
    assert got == {"a": ("0", "0", None, False), "b": ("2", "3", "api", True), "c": (None, "4", "user", True)}


def test_metrics(spark):
    df = spark.createDataFrame([([0, 1, 1],), ([0, 0, 0],), ([],)], "r array<int>")
    got = df.select(M.hit_at_k(F.col("r"), 2), M.mrr_at_k(F.col("r"), 2), F.round(M.ndcg_at_k(F.col("r"), 3), 4)).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.5, 0.6934), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    one = spark.range(1).select(M.keyword_recall(F.lit("Tea and milk"), F.array(F.lit("TEA"), F.lit("rum"))))
    assert one.first()[0] == 0.5


def test_like_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    for name in ("kv_upsert", "kv_conflicts", "ir_metrics"):
        df = E.queries()[name](spark, sf)
        db = duckdb.connect()
        for t in ("customer", "labels"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        out = db.execute(E.oracle_sql()[name])
        names = [c[0] for c in out.description]
        assert sorted(names) == sorted(df.columns)
        key = lambda row: tuple(map(repr, row))
        assert sorted((tuple(r) for r in df.select(*names).collect()), key=key) == sorted(out.fetchall(), key=key), name
