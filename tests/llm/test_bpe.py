"""BPE against the tokenizers library, on odd texts and on texts of every kind of character."""

import random
import sys

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from millrace.llm.bpe import encoder  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", "a \n b", "x\n \ny", "x \n\n  y  ", "don't we'll I'M", "<|endoftext|>", "a  <|endoftext|>  b<|endoftext|><|endoftext|>", "\x1c\x1d a\x85b\xa0c", "　漢字 かな 🙂🙂", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 5000 + "ab" * 3000, "é​﻿", "1234567890 ½ ⅷ ٣", "tab\t\tend ", "\n", " \n", "\t \t"]


def random_texts(n):
    rng = random.Random(5)
    alphabet = [" ", " ", "\n", "\t", "a", "b", "the", "ing", "1", "'s", "é", "漢", " ", ".", "!!", "\x00", "\x1f", "🙂"]
    for _ in range(n):
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
    for _ in range(n):
        yield "".join(c for c in (chr(rng.randrange(sys.maxunicode)) for _ in range(30)) if not 0xD800 <= ord(c) < 0xE000)


def test_like_the_library():
    import numpy as np

    v, enc = encoder(PATH)
    lib = Tokenizer.from_file(PATH)
    texts = [*ODD, *random_texts(400)]
    for _ in range(2):  # the second time from the tables
        for t, packed in zip(texts, enc(texts), strict=True):
            ids = np.frombuffer(packed, enc.kind).tolist()
            assert ids == lib.encode(t, add_special_tokens=False).ids, repr(t)
            from millrace.llm.bpe import decoded

            assert decoded(v, ids) == lib.decode(ids, skip_special_tokens=False) == t


def test_tables_stay_bounded_and_long_texts_are_cut(monkeypatch):
    import numpy as np

    import millrace.llm.bpe as bpe

    monkeypatch.setattr(bpe, "TABLE_BYTES", 2000)
    monkeypatch.setattr(bpe, "SEGMENT", 7)
    v = bpe.Vocabulary(PATH)
    enc = bpe.Encoder(bpe.PATTERN, v.special, v.size, lambda ps: bpe.joined(bpe.by_forest(v, [p.encode() for p in ps]), bpe.id_type(v.size)))
    lib = Tokenizer.from_file(PATH)
    for t in [*ODD, *random_texts(200), "one two three  four five\n six <|endoftext|> seven   eight, nine ten" * 9]:
        assert np.frombuffer(enc([t])[0], enc.kind).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
        assert enc.places.size <= 2000


def test_tables_go_with_their_stage(spark):
    from millrace.llm import shared

    def f(batches):
        shared.begin_task()
        for b in batches:
            yield b.from_pydict({"n": [sum(k.startswith("old") for k in shared._KEPT)] * b.num_rows})

    def fill(batches):
        shared.begin_task()
        for b in batches:
            shared.kept("old", dict)
            yield b.from_pydict({"n": [len(shared._KEPT)] * b.num_rows})

    assert spark.range(0, 8, 1, 8).mapInArrow(fill, "n long").agg({"n": "max"}).first()[0] == 1
    assert spark.range(0, 8, 1, 8).mapInArrow(f, "n long").agg({"n": "max"}).first()[0] == 0


def test_spark_rows(spark):
    from millrace.llm.bpe import decode, encode

    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (3, "", "y"), (4, "<|endoftext|> z", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = encode(df, PATH, keep_text=True).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in out) == [(0, 0, ""), (1, 2, "a b"), (1, 2, "a b"), (3, 0, ""), (4, 2, "<|endoftext|> z")]
    assert sorted(r.text for r in decode(encode(df, PATH), PATH).collect()) == ["", "", "<|endoftext|> z", "a b", "a b"]
    assert encode(df.limit(0), PATH).count() == 0
