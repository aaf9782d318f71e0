"""Alignment against whole-text encoding by the libraries and plain loops."""

import hashlib
import random
import sys
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from millrace.llm import alignment  # noqa: E402
from millrace.llm.bpe import byte_letters  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", " ", "  ", " a", "a ", "a  b", "a \n b", "\n b", "x\t y", "\x1c a\x1f b", "don't we'll", "<|endoftext|> <s> </s><unk>", "é▁x y", "漢字かな 🙂🙂   b", "=" * 300 + " " + "ab" * 200, "tab\t\t end  ", "\x00 \x01", "<0x41> a", "  b　 c", "é ​ x", "a" * 70 + " " * 40 + "b", "ﬁ ½ Å"]


def random_texts(n):
    rng = random.Random(9)
    alphabet = [" ", " ", " ", "\n", "\t", "a", "b", "the", "ing", "1", "'s", "é", "漢", ".", "!!", "\x00", "\x1f", "🙂", " "]
    for _ in range(n):
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
    for _ in range(n):
        yield "".join(c for c in (rng.choice([" ", chr(rng.randrange(sys.maxunicode))]) for _ in range(20)) if not 0xD800 <= ord(c) < 0xE000)


def brute(texts):
    """Whole texts through both libraries, groups by a walk over ends, links by loops."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of = {c: i for i, c in enumerate(byte_letters())}
    rows, held = [], Counter()
    for t in texts:
        xs = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ys = b.encode(t) if t else []
        bx = [bytes(of[c] for c in a.id_to_token(i)) for i in xs]
        by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ys]
        if not t or b"".join(bx) != (" " + t).encode() or b"".join(by) != (" " + t).encode():
            rows.append(([], [], []))
            continue
        groups, i, j = [], 0, 0
        while i < len(xs):
            ga, gb, na, nb = [xs[i]], [ys[j]], len(bx[i]), len(by[j])
            i, j = i + 1, j + 1
            while na != nb:
                if na < nb:
                    ga.append(xs[i])
                    na, i = na + len(bx[i]), i + 1
                else:
                    gb.append(ys[j])
                    nb, j = nb + len(by[j]), j + 1
            groups.append((ga, gb))
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        held.update(set(links))
        rows.append((xs, ys, groups))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    for xs, ys, groups in rows:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        yield len(xs), len(ys), len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else ""


def test_against_whole_texts(spark, monkeypatch):
    texts = [None, "", *ODD, *ODD[:4], *random_texts(150)]
    want = list(brute([t or "" for t in texts]))
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(3)

    def rows(out):
        return [tuple(r)[1:] for r in sorted(out.collect(), key=lambda r: r.doc_id)]

    assert rows(alignment.align(df, A, B)) == want
    found, pairs = alignment.aligned(df, A, B, keep_groups=True)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert rows(alignment.scored(found, pairs, most=0).select(*columns)) == want  # the joined form
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in found.collect() if r.groups)


def test_bounds_change_nothing(monkeypatch):
    t = alignment.Tokenizers(A, B)
    texts = [*ODD, *random_texts(60)]
    texts = [x for x in texts if x]
    want = alignment.document_links(alignment.Units(t), texts)
    monkeypatch.setattr(alignment, "LINKS", 3)
    monkeypatch.setattr(alignment, "UNIT_BYTES", 1000)
    u = alignment.Units(t)
    for k, text in enumerate(texts):
        counts, strings, pairs, times = alignment.document_links(u, [text])
        assert (counts[0] == want[0][k]).all() and strings[0] == want[1][k]
        assert (pairs[0] == want[2][k]).all() and (times[0] == want[3][k]).all()


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert [tuple(r)[4:7] for r in alignment.align(df, A, B).collect()] == [(2, 2, 6)] * 3
    assert alignment.align(df.limit(0), A, B).count() == 0
