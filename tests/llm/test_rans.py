import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from millrace.llm import rans  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 300_000, 1_200_000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 5000).astype(np.int64)
    at, counts = np.unique(ids, return_counts=True)
    m = rans.Frequencies(at, counts, 50257)
    assert int(m.f.sum()) == 1 << m.bits and (m.f[at] > 0).all()
    data = rans.block([1, None], [ids[: n // 2], ids[n // 2 :]], m)
    names, back = rans.opened(data, m)
    assert names == [1, None] and (np.concatenate(back) == ids).all()
    p = counts / n
    if n > 100_000:
        assert len(data) < 1.05 * n * -(p * np.log2(p)).sum() / 8 + 8 * rans.LANES * (n // (rans.LANES * rans.STEPS) + 2)
    with pytest.raises(ValueError):
        rans.opened(data[:-9] + bytes([data[-9] ^ 1]) + data[-8:], m)


def test_stretches_stand_alone():
    ids = np.random.default_rng(0).integers(0, 300, 1_200_000)
    m = rans.Frequencies(np.arange(300), np.bincount(ids), 50257)
    data = rans.encoded(ids, m)
    n, points, made = np.frombuffer(data, np.uint64, 3).tolist()
    assert points > 1
    places = np.frombuffer(data, np.uint64, points, 24).tolist()
    at = 24 + 8 * points
    states = np.frombuffer(data, np.uint64, points * rans.LANES, at).reshape(-1, rans.LANES)
    words = np.frombuffer(data, np.uint32, made, at + 8 * points * rans.LANES).astype(np.uint64)
    out = np.zeros(n, np.int64)
    rans.stretch(out, words, states[1].copy(), places[1], rans.STEPS, m)
    lo = rans.STEPS * rans.LANES
    assert (out[lo : 2 * lo] == ids[lo : 2 * lo]).all() and not out[:lo].any()


def test_skewed_and_flat_models():
    for counts in (np.array([10**12, 1, 1]), np.ones(50257, np.int64), np.array([5])):
        m = rans.Frequencies(np.arange(len(counts)), counts, 50257)
        assert int(m.f.sum()) == 1 << m.bits and (m.f[: len(counts)] > 0).all()


def test_like_the_library(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(rans, "BLOCK_IDS", 500)
    rng = random.Random(3)
    lib = Tokenizer.from_file(PATH)
    texts = [None, "", "<|endoftext|>", " a  b\n"] + [" ".join(rng.choice(["the", "Thing,", "é漢", "x1", "\n"]) for _ in range(rng.randint(0, 80))) for _ in range(120)] + ["long " * 3000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = spark.createDataFrame([(i, texts[i], 1) for i in order], "doc_id long, text string, part int").repartition(5)
    got = sorted(rans.read_back(spark, rans.write(df, PATH, f"file://{tmp_path}/a"), keep_ids=True).collect(), key=lambda r: r.doc_id)
    start = 0
    for i, r in enumerate(got):
        ids = [*lib.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    odd = spark.createDataFrame([(None, "a"), (None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.start, r.n_tokens) for r in rans.read_back(spark, rans.write(odd, PATH, f"file://{tmp_path}/b")).collect()) == [(0, 0, 1), (0, 1, 2), (1, 3, 2), (1, 5, 2)]
    assert rans.read_back(spark, rans.write(odd.limit(0), PATH, f"file://{tmp_path}/c")).count() == 0


READER = """
import sys
from pyspark.sql import SparkSession
from millrace.llm import rans
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
print("sum", rans.read_back(spark, sys.argv[1]).selectExpr("sum(n_tokens) + sum(ids_crc32)").first()[0])
"""


def test_another_process_reads_the_folder(spark, tmp_path):
    import os
    import subprocess
    import sys

    df = spark.createDataFrame([(i, f"text {i} " * (i % 50)) for i in range(200)] + [(None, f"none {i}") for i in range(100)], "doc_id long, text string").repartition(3)
    path = rans.write(df, PATH, f"file://{tmp_path}/out")
    want = rans.read_back(spark, path).selectExpr("sum(n_tokens) + sum(ids_crc32)").first()[0]
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", READER, path, f"file://{tmp_path}/shared"], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": repo}, check=True)
    assert f"sum {want}" in out.stdout
    blocks = spark.read.parquet(f"{path}/blocks")
    assert spark.read.parquet(f"{path}/manifest").first().n_blocks == blocks.count()
    spark.createDataFrame([(1, 5)], "id int, f long").write.mode("append").parquet(f"{path}/model")
    with pytest.raises(ValueError):
        rans.read_back(spark, path)
