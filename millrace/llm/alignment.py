"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how many documents hold each pair linked.

A is a byte-level BPE file of the tokenizers library, applied to a blank and the text; B a sentencepiece model that puts the blank there
itself. Special tokens spelled in a text are plain text. Token ends are cumulated byte lengths; ends that both share cut the tokens into
groups (`intersect1d` for the common cuts, `searchsorted` for the group of each token, `repeat` to expand the links of groups).

A text is cut where a blank follows a character that is no white space. No piece of either tokenizer crosses such a place (A splits there
before merging; B has no piece with its blank mark after another character, which is checked when the model is loaded), so both
tokenizers give each unit the tokens that it has inside the text, and all its ends are common cuts. A worker aligns the units that it has
not met, all at once, and keeps their counts, links and group strings.

The first pass leaves, for each document, its counts and its distinct linked pairs with multiplicities, and for each task how many
documents held each pair; these partial counts are added up in two stages, first by pair and salt, then by pair. The second pass looks
the pairs of documents up: in a broadcast sorted array up to PAIRS pairs, in a join of pairs beyond.

Defined results: texts that are null, empty, or whose bytes a tokenizer does not give back (U+2581 in a text) have no tokens: zeros and ''.
Rows are documents: repeated rows and repeated or null ids count each. Long units are aligned, but not kept.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import byte_letters, ragged
from millrace.llm.shared import Batches, begin_task, doc_columns, kept, mapped, slices, stored, tune

#: Bytes of units that a worker keeps, about.
UNIT_BYTES = 64 << 20
#: Pairs of which a task counts the documents before it hands the counts on.
COUNTED = 1 << 20
#: Links that are expanded at once.
LINKS = 1 << 21
#: Pairs whose counts are broadcast (some 20 bytes each); more are joined.
PAIRS = 2 << 20
#: Salts of the first stage of counting.
SALTS = 16
SPACE_MARK = "▁"


class Tokenizers:
    """Both libraries, with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = {c: i for i, c in enumerate(byte_letters())}
        self.size_a, self.size_b = self.a.get_vocab_size(with_added_tokens=True), self.b.get_piece_size()
        special = {i for i, _ in self.a.get_added_tokens_decoder().items()}
        names = [self.a.id_to_token(i) or "" for i in range(self.size_a)]
        self.bytes_a = [n.encode() if i in special else bytes(of[c] for c in n) for i, n in enumerate(names)]
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("a piece has the blank mark after another character, so texts cannot be cut at blanks")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id(SPACE_MARK)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a blank and each unit."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1)
        return a, [x if u else [self.blank] for u, x in zip(units, b, strict=True)]


def groups_of(t: Tokenizers, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common ends, group of each token of A, of each of B) of tokens that spell the same bytes."""
    ends_a, ends_b = np.cumsum(t.length_a[a]), np.cumsum(t.length_b[b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their times added up."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(times[order], first)


def links_of(t: Tokenizers, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, pair, times) of the linked pairs, each once for a unit. unit: of each group."""
    n = len(unit)
    count_a, count_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    first_b = np.cumsum(count_b) - count_b
    first_a = np.cumsum(count_a) - count_a
    sizes = count_a * count_b
    ends = np.cumsum(sizes)
    found, begin = [], 0
    while begin < n:
        # as many groups as make LINKS links; a larger one is expanded over its distinct ids
        end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + LINKS, "right"))
        if end == begin:
            xs, nx = np.unique(a[first_a[begin] : first_a[begin] + count_a[begin]], return_counts=True)
            ys, ny = np.unique(b[first_b[begin] : first_b[begin] + count_b[begin]], return_counts=True)
            for x, k in zip(xs.tolist(), nx.tolist(), strict=True):
                found.append((np.full(len(ys), unit[begin]), x * t.size_b + ys, k * ny))
            begin += 1
            continue
        lo, hi = first_a[begin], first_a[end - 1] + count_a[end - 1]
        of = group_a[lo:hi]
        left, right = np.repeat(a[lo:hi], count_b[of]), b[ragged(first_b[of], count_b[of])]
        found.append((np.repeat(unit[of], count_b[of]), left * t.size_b + right, np.ones(len(left), np.int64)))
        begin = end
    units, pairs, times = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    space = t.size_a * t.size_b
    keys, times = summed(units * space + pairs, times)
    return keys // space, keys % space, times


class Units(dict):
    """Place of each unit; new ones get the next place and wait in `fresh` until learn()."""

    def __init__(self, t: Tokenizers):
        super().__init__()
        self.t = t
        self.names_a, self.names_b = ([str(i) for i in range(n)] for n in (t.size_a, t.size_b))
        self.drop()

    def drop(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.names: list[str] = []
        #: a row for each unit: tokens of A, of B, groups, links, first of its pairs, number of pairs, 1 if its bytes are lost
        self.facts = np.zeros((0, 7), np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held = 0

    def __missing__(self, unit: str) -> int:
        place = self[unit] = len(self)
        self.fresh.append(unit)
        return place

    def learn(self) -> None:
        fresh, self.fresh = self.fresh, []
        t = self.t
        ids_a, ids_b = t.encode(fresh)
        same = np.array([b"".join(map(t.bytes_a.__getitem__, a)) == (whole := b" " + u.encode()) and b"".join(map(t.bytes_b.__getitem__, b)) == whole for u, a, b in zip(fresh, ids_a, ids_b, strict=True)], bool)
        ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, same, strict=True)] for ids in (ids_a, ids_b))
        size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((ids_a, size_a), (ids_b, size_b)))
        cuts, group_a, group_b = groups_of(t, a, b)
        last = np.cumsum(size_a) - 1  # a unit ends with a group, that of its last token
        after = np.where(last >= 0, np.append(group_a, 0)[last] + 1, 0)
        n_groups = np.diff(after, prepend=0)
        unit = np.repeat(np.arange(len(fresh)), n_groups)
        of, pairs, times = links_of(t, a, b, group_a, group_b, unit)
        count = np.bincount(of, minlength=len(fresh))
        n_links = np.bincount(of, times, minlength=len(fresh)).astype(np.int64)
        first = len(self.pairs) + np.cumsum(count) - count
        self.facts = np.concatenate([self.facts, np.stack([size_a, size_b, n_groups, n_links, first, count, ~same], 1)])
        self.pairs, self.times = np.append(self.pairs, pairs), np.append(self.times, times)
        ends_a, ends_b = (np.append(0, np.cumsum(np.bincount(g, minlength=len(cuts)))).tolist() for g in (group_a, group_b))
        words_a, words_b = list(map(self.names_a.__getitem__, a.tolist())), list(map(self.names_b.__getitem__, b.tolist()))
        groups = [",".join(words_a[ends_a[g] : ends_a[g + 1]]) + "|" + ",".join(words_b[ends_b[g] : ends_b[g + 1]]) for g in range(len(cuts))]
        begin = 0
        for end in after.tolist():
            self.names.append(";".join(groups[begin:end]))
            begin = end
        self.held += 250 * len(fresh) + sum(map(len, fresh)) + 16 * len(pairs) + sum(map(len, self.names[-len(fresh) :]))


ODD = re.compile(r"\s ").search
AT_BLANK = re.compile(r"(?<=\S) ").split


def units_of(text: str) -> list[str]:
    """The units of a blank and the text, each without its first blank."""
    if text[:1] != " " and not ODD(text):
        return text.split(" ")
    first, *rest = AT_BLANK(" " + text)
    return [first[1:], *rest]


def document_links(u: Units, texts: list[str]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
    """Per text: counts (tokens of A, of B, groups, links), group string, distinct pairs in order, their times."""
    lists = [units_of(t) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    at = np.fromiter(map(u.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
    if u.fresh:
        u.learn()
    facts = np.add.reduceat(u.facts[at], np.cumsum(sizes) - sizes, axis=0)
    names, ends = u.names, np.cumsum(sizes).tolist()
    order, begin, strings = at.tolist(), 0, []
    good = facts[:, 6] == 0
    for end, ok in zip(ends, good.tolist(), strict=True):
        strings.append(";".join(map(names.__getitem__, order[begin:end])) if ok else "")
        begin = end
    doc = np.repeat(np.arange(len(texts)), sizes)
    first, count = u.facts[at, 4], u.facts[at, 5]
    where = ragged(first, count)
    space = u.t.size_a * u.t.size_b
    keys, times = summed(np.repeat(doc, count) * space + u.pairs[where], u.times[where])
    doc = keys // space
    cuts = np.searchsorted(doc, np.arange(1, len(texts)))
    pairs, times = np.split(keys % space, cuts), np.split(times, cuts)
    counts = np.where(good[:, None], facts[:, :4], 0)
    none = np.zeros(0, np.int64)
    if u.held > UNIT_BYTES:
        u.drop()
    return counts, strings, [p if ok else none for p, ok in zip(pairs, good, strict=True)], [t if ok else none for t, ok in zip(times, good, strict=True)]


def packed(values: list[np.ndarray], kind: np.dtype) -> pa.Array:
    return pa.array([v.astype(kind).tobytes() for v in values], pa.binary())


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs), both written: row_id, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times and, on demand, groups;
    pair (A id times the size of B's vocabulary, plus B id), a, b, n_docs, best (no pair of that A id has more)."""
    tune(docs.sparkSession)
    probe = Tokenizers(path_a, path_b)
    size_b = probe.size_b
    pair_kind = np.dtype("<u4" if probe.size_a * size_b <= 1 << 32 else "<i8")
    columns = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary" + ", groups string" * keep_groups
    schema = columns + ", salt int, seen array<long>, n array<long>"
    fields = [x.split()[0] for x in schema.split(", ")]
    kinds = {"row_id": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.binary(), "times": pa.binary(), "groups": pa.string(), "salt": pa.int32(), "seen": pa.list_(pa.int64()), "n": pa.list_(pa.int64())}

    def row(k: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f] if f in columns else pa.nulls(k, kinds[f]) for f in fields], fields)

    def run(batches: Batches) -> Batches:
        begin_task()
        part = TaskContext.get().partitionId()
        base = part << 33
        found: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def counted() -> tuple[np.ndarray, np.ndarray]:
            return summed(*(np.concatenate(x) for x in zip(*found, strict=True)))

        def handed(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(keys), 1 << 14):
                yield row(1, salt=pa.array([part % SALTS], pa.int32()), seen=pa.array([keys[lo : lo + (1 << 14)]], kinds["seen"]), n=pa.array([n[lo : lo + (1 << 14)]], kinds["n"]))

        for batch in batches:
            if not batch.num_rows:
                continue
            u = kept(f"alignment {path_a} {path_b}", lambda: frozen(Units(Tokenizers(path_a, path_b))))
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices(texts):
                k = hi - lo
                counts, strings = np.zeros((k, 4), np.int64), [""] * k
                pairs, times = ([np.zeros(0, np.int64)] * k for _ in range(2))
                some = [i for i in range(k) if texts[lo + i]]
                if some:
                    c, s, p, n = document_links(u, [texts[lo + i] for i in some])
                    counts[some] = c
                    for i, x, y, z in zip(some, s, p, n, strict=True):
                        strings[i], pairs[i], times[i] = x, y, z
                    every = np.concatenate(pairs)
                    found.append(summed(every, np.ones(len(every), np.int64)))
                    waiting += len(found[-1][0])
                    if waiting > COUNTED:
                        found = [counted()]
                        waiting = len(found[0][0])
                        if waiting > COUNTED // 2:
                            yield from handed(*found.pop())
                            waiting = 0
                out = {f: pa.array(counts[:, i]) for i, f in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                out |= {"row_id": pa.array(np.arange(base, base + k)), "doc_id": batch.column(0).slice(lo, k), "groups_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in strings]), "pairs": packed(pairs, pair_kind), "times": packed(times, np.dtype("<u4"))}
                base += k
                yield row(k, **out, groups=pa.array(strings))
        if found:
            yield from handed(*counted())

    found = stored(doc_columns(docs, id_col, text_col).mapInArrow(run, schema), "alignments")
    each = found.where("salt is not null").select("salt", F.explode(F.arrays_zip("seen", "n")).alias("x")).select("salt", F.col("x.seen").alias("pair"), F.col("x.n").alias("n"))
    counts = each.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n_docs"))
    counts = stored(counts.select("pair", F.expr(f"pair div {size_b}").cast("int").alias("a"), F.expr(f"pair % {size_b}").cast("int").alias("b"), "n_docs"), "pair_counts")
    top = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    pairs = stored(counts.join(top, "a").select("pair", "a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best")), "pairs")
    return found.where("salt is null").select(*[x.split()[0] for x in columns.split(", ")]), pairs


def frozen(u: Units) -> Units:
    gc.set_threshold(200_000, 50, 100)  # the tables hold no cycles, and walking them is slow
    return u


def scored(docs: DataFrame, pairs: DataFrame, most: int = PAIRS) -> DataFrame:
    """docs with n_best and count_sum in place of pairs and times."""
    spark = docs.sparkSession
    n = pairs.count()
    names = [c for c in docs.columns if c not in ("pairs", "times")]
    if n <= most:
        t = pairs.select("pair", "n_docs", "best").orderBy("pair").toArrow()
        sent = spark.sparkContext.broadcast(tuple(t.column(i).to_numpy() for i in range(3)))
    else:
        sent = None
    wide = [f.dataType.simpleString() for f in docs.schema.fields if f.name not in ("pairs", "times")]
    head = ", ".join(f"`{c}` {k}" for c, k in zip(names, wide, strict=True))

    def unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        times = b.column("times").to_pylist()
        count = np.fromiter((len(x) // 4 for x in times), np.int64, len(times))
        data = b"".join(b.column("pairs").to_pylist())
        kind = np.dtype("<u4") if len(data) == 4 * count.sum() else np.dtype("<i8")
        return np.frombuffer(data, kind).astype(np.int64), np.frombuffer(b"".join(times), "<u4").astype(np.int64), count

    def looked_up(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, docs_with, best = sent.value
        flat, times, count = unpacked(b)
        at = np.searchsorted(keys, flat)
        sums = np.zeros((b.num_rows, 2), np.int64)
        some = np.flatnonzero(count)
        if len(some):
            firsts = (np.cumsum(count) - count)[some]
            sums[some, 0] = np.add.reduceat(times * best[at], firsts)
            sums[some, 1] = np.add.reduceat(times * docs_with[at], firsts)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sums[:, 0]), pa.array(sums[:, 1])], [*names, "n_best", "count_sum"])

    def listed(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flat, times, count = unpacked(b)
        ids = np.repeat(b.column("row_id").to_numpy(), count)
        for lo in range(0, len(flat), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (ids, flat, times)], ["row_id", "pair", "times"])

    if sent is not None:
        return docs.mapInArrow(mapped(looked_up), head + ", n_best long, count_sum long")
    # rows of one document and pair; a frequent pair is split by Spark as a skewed side of the join
    rows = docs.select("row_id", "pairs", "times").mapInArrow(mapped(listed), "row_id long, pair long, times long")
    sums = rows.join(pairs.select("pair", "n_docs", "best"), "pair").groupBy("row_id").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return docs.select(*names).join(sums, "row_id", "left").withColumns({"n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)})


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, on demand, groups."""
    found, pairs = aligned(docs, path_a, path_b, id_col, text_col, keep_groups)
    return scored(found, pairs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * keep_groups)


__all__ = ["align", "aligned", "scored"]
