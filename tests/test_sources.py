"""Files, keyed tables, stores."""

import pytest
from pyspark.sql import functions as F

from millrace.sources import files as S
from millrace.sources import tables as K


def test_texts_and_objects(spark, tmp_path):
    (tmp_path / "a.md").write_text("  # hi \n")
    (tmp_path / "b.txt").write_bytes(b"\xff bad")
    (tmp_path / "c.HTML").write_text(" ")
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.text, r.status) for r in S.texts(spark, str(tmp_path)).collect()}
    assert got["a.md"] == ("markdown", "# hi", "ok") and got["c.HTML"] == ("html", "", "partial") and got["b.txt"][0] == "text"
    assert [r.path.rsplit("/", 1)[1] for r in S.objects(spark, str(tmp_path), "*.txt").collect()] == ["b.txt"]
    assert S.objects(spark, str(tmp_path), limit=2).count() == 2


def test_json(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in S.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    with pytest.raises(Exception):
        S.json_lines(spark, str(tmp_path / "x.jsonl"), "a int", strict=True).collect()
    S.append_json(spark.range(2), f"{tmp_path}/log")
    S.append_json(spark.range(3), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 5
    (tmp_path / "s.json").write_text('{"sections": [\n{"title": "A", "content": "x"}, {"title": "B", "content": "y"}]}')
    assert [r.body for r in S.sections(spark, str(tmp_path / "s.json"), "B").collect()] == ["y"]


def test_options_and_profiles(spark):
    o = S.jdbc_options("jdbc:x", "t", "id", (0, 9), 4)
    assert o["partitionColumn"] == "id" and o["numPartitions"] == "4" and "partitionColumn" not in S.jdbc_options("jdbc:x", "t")
    facts, names = S.profile(spark, "t", "u", {"facts": [{"key": "k", "value": 1}, {"value": 2}], "entities": {"a": {"canonical_id": "c", "display_name": "d"}}})
    assert facts.count() == 1 and names.first().canonical_id == "c"


def test_tables(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 2), (3, "b", 3)], "id int, k string, v int")
    assert sorted(r.id for r in K.select(df, {"v": None}).collect()) == [1]
    assert [r.id for r in K.select(df, {"k": "b"}, order_by=[F.desc("id")], limit=1, offset=1).collect()] == [2]
    new = spark.createDataFrame([(2, "z", 9), (4, "y", 4)], df.schema)
    assert {(r.id, r.k) for r in K.upserted(df, new, ["id"]).collect()} == {(1, "a"), (2, "z"), (3, "b"), (4, "y")}
    assert {(r.id, r.k) for r in K.upserted(df, new, ["id"], "skip").collect()} == {(1, "a"), (2, "b"), (3, "b"), (4, "y")}
    assert sorted(r.v for r in K.updated(df, {"v": 7}, {"k": "b"}).where("v = 7").collect()) == [7, 7]
    assert {r.id for r in K.deleted(df, {"v": None}).collect()} == {2, 3}
    assert {(r.id, r.k) for r in K.replaced(df, new.withColumn("k", F.lit("b")), ["k"]).collect()} == {(1, "a"), (2, "b"), (4, "b")}
    out = K.aggregated(df.withColumn("l", F.array(F.lit(1), F.lit(2))), [{"$unwind": "$l"}, {"$match": {"v": {"$gte": 2}}}, {"$group": {"_id": {"k": "$k"}, "s": {"$sum": "$l"}}}, {"$project": {"k": 1, "twice": "$s"}}, {"$skip": 0}])
    assert [tuple(r) for r in out.collect()] == [("b", 6)]
    with pytest.raises(ValueError):
        K.aggregated(df, [{"$other": 1}])


def test_store(spark, tmp_path):
    s = K.Store(spark, f"{tmp_path}/t")
    assert s.load() is None
    s.upsert(spark.createDataFrame([(1, "a")], "id int, k string"), ["id"])
    s.upsert(spark.createDataFrame([(1, "b"), (2, "c")], "id int, k string"), ["id"])
    assert {tuple(r) for r in s.load().collect()} == {(1, "b"), (2, "c")}
    s.delete({"id": 1})
    assert [tuple(r) for r in s.load().collect()] == [(2, "c")] and len(s.versions()) == 2
    (tmp_path / "t" / "v9").mkdir()  # a version that was never finished
    assert s.load().count() == 1
    s.drop()
    assert s.load() is None


def test_manifest_and_cache(spark):
    files = spark.createDataFrame([("t", "a"), ("t", "b")], "tenant_id string, md5 string")
    manifest = spark.createDataFrame([("t", "a", "m", "c"), ("t", "b", "old", "c")], "tenant_id string, md5 string, model_version string, config_hash string")
    assert [r.md5 for r in K.to_index(files, manifest, "m", "c").collect()] == ["b"]
    cache = spark.createDataFrame([("f", [1.0])], "fingerprint string, vector array<double>")
    chunks = spark.createDataFrame([("f", 1), ("g", 2)], "fingerprint string, n int")
    assert {r.n: r.cached for r in K.with_cached(chunks, cache).collect()} == {1: [1.0], 2: None}
