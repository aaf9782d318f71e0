"""Benchmark decontamination: a broadcast set of hashed test windows, scanned over the documents' words and verified.

Words are what is left of the lower-cased (A-Z) text between ASCII characters that are neither letters nor digits. A window is
`size` consecutive words of an item; an item of fewer words is one window. A document's word inside any occurrence of a window
is hit.

An index is a set of sorted arrays: the 64-bit hashes of the items' windows by window length, where each window stands, and the items'
words as one string, in which every hit is verified word by word (some 30 bytes a word, against 13 words of text in a window). Items are
dealt to indices of SHARD_WORDS words, made and broadcast one after the other. One index is the usual case: the documents stream past it
without a shuffle. With more, documents are written once in batches, each index is one pass over them that gives only its hits, and
the hits of a batch are joined to it at the end; no worker holds two indices.

Defined results: null and empty texts have no words and no hits; null items have no windows; repeated items all count, an
item_id counts once; rows of documents are independent, so repeated or null ids keep their rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import attached, doc_columns, hashed, mapped, mixed, numbered, slices, spans_of, stored, texts_of, tune, windows
from millrace.llm.sharing import packed, unpacked

#: Words of benchmark items in one index.
SHARD_WORDS = 2_000_000

#: Upper case to lower, other ASCII but letters and digits to a blank; bytes above 127 stay.
TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32) for c in range(256))


HITS = pa.list_(pa.struct([("d", pa.int32()), ("i", pa.int32()), ("n", pa.int32()), ("names", pa.list_(pa.string()))]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Index:
    """The windows of some items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.names = [name for name, ws in items if ws]
        lists = [ws for _, ws in items if ws]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.begins, ends = spans_of(counts)
        flat = [w for ws in lists for w in ws]
        self.text = b" ".join(flat)
        lengths = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
        self.at = np.append(0, np.cumsum(lengths))
        h = hashed(flat)
        #: by window length: sorted distinct hashes, the first place of each in `where`, the windows' starts, a table of the hashes' top bits
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        least = np.minimum(counts, size)
        for n in np.unique(least).tolist():
            mine = np.flatnonzero(least == n)
            per = counts[mine] - n + 1
            starts = np.repeat(self.begins[mine] - np.cumsum(per) + per, per) + np.arange(int(per.sum()))
            keys = mixed(windows(h, n))[starts]
            order = np.argsort(keys, kind="stable")
            distinct, first = np.unique(keys[order], return_index=True)
            bits = min(24, max(8, len(distinct).bit_length() + 4))
            seen = np.zeros(1 << bits, bool)
            seen[distinct >> np.uint64(64 - bits)] = True
            self.lengths[n] = distinct, np.append(first, len(keys)), starts[order].astype(np.int32 if len(flat) < 2**31 else np.int64), seen

    def found(self, n: int, k: int, words: bytes) -> set[str]:
        """Names of the items whose windows of hash number k are these words."""
        _, first, where, _ = self.lengths[n]
        same = [p for p in where[first[k] : first[k + 1]].tolist() if self.text[self.at[p] : self.at[p + n] - 1] == words]
        return {self.names[i] for i in (np.searchsorted(self.begins, same, side="right") - 1).tolist()}

    def scan(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, int, set[str]]]:
        """(text, first word in it, words, items) of each window that occurs, verified."""
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        begins, ends = spans_of(counts)
        h = hashed([w for ws in texts for w in ws])
        until = np.repeat(ends, counts)
        known: dict[tuple[int, int, bytes], set[str]] = {}
        for n, (keys, _, _, seen) in self.lengths.items():
            if len(h) < n:
                continue
            w = mixed(windows(h, n))
            at = np.flatnonzero(seen[w >> np.uint64(64 - (len(seen).bit_length() - 1))] & (np.arange(n, len(h) + 1) <= until[: len(w)]))
            place = np.minimum(np.searchsorted(keys, w[at]), len(keys) - 1)
            hits = np.flatnonzero(keys[place] == w[at])
            owner = np.searchsorted(ends, at[hits], side="right")
            for i, k, d in zip(at[hits].tolist(), place[hits].tolist(), owner.tolist(), strict=True):
                i -= int(begins[d])
                here = b" ".join(texts[d][i : i + n])
                if (n, k, here) not in known:
                    known[n, k, here] = self.found(n, k, here)
                if names := known[n, k, here]:
                    yield d, i, n, names


class Hits:
    """What some texts have in common with the benchmark."""

    def __init__(self, texts: list[list[bytes]], found: Iterable[tuple[int, int, int, Iterable[str]]]):
        self.counts = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins, _ = spans_of(self.counts)
        total = int(self.counts.sum())
        step = np.zeros(total + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in texts]
        for d, i, n, names in found:
            at = int(self.begins[d]) + i
            step[at] += 1
            step[at + n] -= 1
            self.items[d].update(names)
        self.hit = np.cumsum(step[:-1]) > 0
        sums = np.append(0, np.cumsum(self.hit))
        self.n_hit = sums[self.begins + self.counts] - sums[self.begins]

    def contaminated(self, per_cent: int) -> np.ndarray:
        return (self.n_hit > 0) & (100 * self.n_hit >= per_cent * self.counts)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, size: int = 13, per_cent: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep_spans: bool = False
) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and on demand hit_words, array<array<int>> of [begin, end) in words.

    contaminated: a word is hit and the hits are at least per_cent % of the words."""

    def rows(b: pa.RecordBatch, hits: Hits) -> pa.RecordBatch:
        out = {
            "doc_id": b.column(0),
            "n_words": pa.array(hits.counts),
            "n_hit": pa.array(hits.n_hit),
            "n_items": pa.array(map(len, hits.items), pa.int64()),
            "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in hits.items],
            "contaminated": pa.array(hits.contaminated(per_cent)),
        }
        if keep_spans:
            spans = []
            for s, n in zip(hits.begins.tolist(), hits.counts.tolist(), strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hits.hit[s : s + n].astype(np.int8), [0]])))
                spans.append(edge.reshape(-1, 2).tolist())
            out["hit_words"] = pa.array(spans, pa.list_(pa.list_(pa.int32())))
        return pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", hit_words array<array<int>>" * keep_spans
    return scanned(doc_columns(docs, id_col, text_col), "text", indices(benchmark, size, item_col, item_text_col), rows, schema)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 13, per_cent: int = 5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""

    names = docs.columns

    def rows(b: pa.RecordBatch, hits: Hits) -> pa.RecordBatch:
        return b.filter(pa.array(~hits.contaminated(per_cent))).rename_columns(names)

    return scanned(docs, text_col, indices(benchmark, size, item_col, item_text_col), rows, docs.schema)


def indices(benchmark: DataFrame, size: int, item_col: str, item_text_col: str) -> Iterator[Index]:
    """Indices of the benchmark's items, one at a time on the driver: SHARD_WORDS words, or one item that has more."""
    items: list[tuple[str, list[bytes]]] = []
    room, made = SHARD_WORDS, False
    for r in benchmark.select(benchmark[f"`{item_col}`"].cast("string").alias("i"), benchmark[f"`{item_text_col}`"].cast("string").alias("t")).toLocalIterator():
        ws = words_of((r.t or "").encode())
        if room < len(ws) and items:
            yield Index(items, size)
            made, items, room = True, [], SHARD_WORDS
        items.append((r.i or "", ws))
        room -= len(ws)
    if items or not made:
        yield Index(items, size)


def scanned(docs: DataFrame, text_col: str, shards: Iterator[Index], rows: Callable[[pa.RecordBatch, Hits], pa.RecordBatch], schema) -> DataFrame:
    """rows(batch, hits) over all rows of docs, with the hits of all indices."""
    spark, at, docs = docs.sparkSession, docs.columns.index(text_col), numbered(docs)
    tune(spark)
    first, second = next(shards), next(shards, None)
    if second is None:
        sent = spark.sparkContext.broadcast(first)

        def direct(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = texts_of(b.column(at))
            for lo, hi in slices(texts):
                words = [words_of(t) for t in texts[lo:hi]]
                yield rows(b.slice(lo, hi - lo), Hits(words, sent.value.scan(words)))

        return docs.mapInArrow(mapped(direct), schema)

    batches = packed(docs, docs.columns[at], "texts")

    def words_in(t: pa.Table) -> list[list[bytes]]:
        return [words_of(x) for x in texts_of(t.column(at).combine_chunks())]

    def one_pass(index: Index) -> DataFrame:
        sent = spark.sparkContext.broadcast(index)

        def find(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row in b.to_pylist():
                found = [{"d": d, "i": i, "n": n, "names": sorted(names)} for d, i, n, names in sent.value.scan(words_in(unpacked(row["payload"])))]
                if found:
                    yield pa.RecordBatch.from_pydict({"batch_id": pa.array([row["batch_id"]], pa.int64()), "found": pa.array([found], HITS)})

        return stored(batches.mapInArrow(mapped(find), "batch_id long, found array<struct<d:int,i:int,n:int,names:array<string>>>"), "hits")

    passes = [one_pass(x) for x in chain((first, second), shards)]
    every = reduce(DataFrame.union, passes).groupBy("batch_id").agg(F.flatten(F.collect_list("found")).alias("found"))

    def finish(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in b.to_pylist():
            t = unpacked(row["payload"])
            hits = Hits(words_in(t), ((x["d"], x["i"], x["n"], x["names"]) for x in row["found"] or []))
            yield rows(t.combine_chunks().to_batches()[0], hits)

    size = F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + 64 + 16 * F.size(x["names"]))
    return attached(batches, stored(every, "found"), "batch_id", size, "left").mapInArrow(mapped(finish), schema)
