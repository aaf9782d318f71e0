"""Which of many billions of hashes occur more than once, without a row per hash.

Rows are packed into batches (a compressed Arrow payload of a few MB of text, with a batch_id) that are written once to the
shared folder. Each batch sends its distinct hashes, sorted and cut by value into shards: one row per batch and shard, six or
sixteen bytes a hash. A shard sees all copies of its hashes and answers with one bit for each; answers go back by batch_id.
A hash that a third of all rows hold is one entry per batch, so no key is hot; shards are as many as their size asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import Batches, begin_task, count_shuffles, grouped, mapped, stored, tune

#: Bytes of hashes that a shard gets, about.
SHARD_BYTES = 16 << 20
#: Level of the payloads' compression.
LEVEL = 3


def packed(df: DataFrame, weigh: str, name: str) -> DataFrame:
    """df's rows as batches of about 2 MB of the column weigh, written to the shared folder: batch_id, n_bytes, payload."""
    tune(df.sparkSession)
    at = df.columns.index(weigh)

    def run(batches: Batches) -> Batches:
        begin_task()
        compress, part, n = zstandard.ZstdCompressor(level=LEVEL).compress, TaskContext.get().partitionId(), 0

        def row(rows: pa.Table) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows.combine_chunks())
            data = sink.getvalue().to_pybytes()
            return pa.RecordBatch.from_pydict({"batch_id": pa.array([part << 32 | n], pa.int64()), "n_bytes": pa.array([len(data)], pa.int64()), "payload": pa.array([compress(data)], pa.binary())})

        waiting: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            lengths = [len(x or b"") for x in b.column(at).cast(pa.binary()).to_pylist()]
            for lo, hi in ranges(lengths):
                here = sum(lengths[lo:hi])
                if waiting and size + here > 2 << 20:
                    yield row(pa.Table.from_batches(waiting))
                    n, waiting, size = n + 1, [], 0
                waiting.append(b.slice(lo, hi - lo))
                size += here
        if waiting:
            yield row(pa.Table.from_batches(waiting))

    return stored(df.mapInArrow(run, "batch_id long, n_bytes long, payload binary"), name)


def ranges(lengths: list[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, n in enumerate(lengths):
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    yield begin, len(lengths)


def unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all()


class Keys:
    """Distinct hashes of a batch in order, those that it holds once before those that it holds more often. hi: where they go; lo: 64 bits more, or None."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray | None = None):
        self.wide = lo is not None
        if lo is None:
            self.hi, self.inverse, n = np.unique(hi >> np.uint64(16), return_inverse=True, return_counts=True)
            self.lo = None
        else:
            order = np.lexsort((lo, hi))
            h, w = hi[order], lo[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
            which = np.cumsum(new) - 1
            self.inverse = np.empty(len(h), np.int64)
            self.inverse[order] = which
            n = np.bincount(which, minlength=int(new.sum()))
            self.hi, self.lo = h[new], w[new]
        self.often = n > 1

    def shards(self, n_shards: int) -> np.ndarray:
        top = (self.hi << np.uint64(16) if not self.wide else self.hi) >> np.uint64(32)
        return ((top * np.uint64(n_shards)) >> np.uint64(32)).astype(np.int64)

    def data(self, at: np.ndarray) -> bytes:
        if self.wide:
            return np.stack([self.hi[at], self.lo[at]], axis=1).tobytes()
        return np.ascontiguousarray(self.hi[at]).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def loaded(data: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray | None]:
    if wide:
        both = np.frombuffer(data, np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.reshape(-1).view(np.uint64), None


def parts_of(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of the shards that occur in an ascending array; the work follows the array, however many shards there are."""
    begins = np.flatnonzero(np.diff(shard, prepend=-1))
    for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(shard)], strict=True):
        yield int(shard[lo]), np.arange(lo, hi)


def shared_flags(keys: Keys, answers: list[dict], n_shards: int) -> np.ndarray:
    """For each hash that the batch gave to Keys: does it occur anywhere else."""
    flags = keys.often.copy()
    by_shard = {a["shard"]: a["bits"] for a in answers}
    shard = keys.shards(n_shards)
    for s, at in parts_of(shard):
        if s not in by_shard:
            continue
        bits = by_shard[s]
        once = at[~keys.often[at]]
        flags[once] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(once)).astype(bool)
    return flags[keys.inverse]


def shards_for(batches: DataFrame, share: float) -> int:
    """share: bytes of hashes for a byte of text."""
    size = batches.agg(F.sum("n_bytes")).first()[0] or 0
    return max(count_shuffles(batches.sparkSession), int(size * share / SHARD_BYTES) + 1)


def answer_size(name: str) -> Column:
    """Bytes of a row's answers."""
    return F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + F.length(x["bits"]) + 24)


def answered(batches: DataFrame, keys_of: Callable[[dict], Keys | None], wide: bool, n_shards: int, name: str) -> DataFrame:
    """batch_id, answers: for each batch the bits that its hashes get from each shard. keys_of(row) must give the same for the same row."""

    def emit(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in b.to_pylist():
            keys = keys_of(row)
            if keys is None or not len(keys.hi):
                continue
            out: dict[str, list] = {"shard": [], "batch_id": [], "once": [], "hashes": []}
            for s, at in parts_of(keys.shards(n_shards)):
                often = keys.often[at]
                out["shard"].append(s)
                out["batch_id"].append(row["batch_id"])
                out["once"].append(int((~often).sum()))
                out["hashes"].append(keys.data(np.concatenate([at[~often], at[often]])))
            yield pa.RecordBatch.from_pydict({"shard": pa.array(out["shard"], pa.int32()), "batch_id": pa.array(out["batch_id"], pa.int64()), "once": pa.array(out["once"], pa.int32()), "hashes": pa.array(out["hashes"], pa.binary())})

    def resolve(t: pa.Table) -> pa.Table:
        rows, shard = t.drop_columns(["shard"]).to_pylist(), t.column("shard")[0].as_py()
        both = [loaded(r["hashes"], wide) for r in rows]
        weight = np.concatenate([np.where(np.arange(len(h)) < r["once"], 1, 2) for (h, _), r in zip(both, rows, strict=True)])
        hi = np.concatenate([h for h, _ in both])
        order = np.lexsort((np.concatenate([w for _, w in both]), hi)) if wide else np.argsort(hi, kind="stable")
        h, new = hi[order], np.ones(len(hi), bool)
        new[1:] = h[1:] != h[:-1]
        if wide:
            w = np.concatenate([w for _, w in both])[order]
            new[1:] |= w[1:] != w[:-1]
        which = np.empty(len(hi), np.int64)
        which[order] = np.cumsum(new) - 1
        shared = np.bincount(which, weights=weight)[which] > 1.5
        ends = np.cumsum([len(h) for h, _ in both])
        bits = [np.packbits(shared[e - len(h) : e - len(h) + r["once"]]).tobytes() for (h, _), r, e in zip(both, rows, ends, strict=True)]
        return pa.table({"batch_id": pa.array([r["batch_id"] for r in rows], pa.int64()), "shard": pa.array([shard] * len(rows), pa.int32()), "bits": pa.array(bits, pa.binary())})

    sent = batches.mapInArrow(mapped(emit), "shard int, batch_id long, once int, hashes binary")
    bits = sent.groupBy("shard").applyInArrow(grouped(resolve), "batch_id long, shard int, bits binary")
    return stored(bits.groupBy("batch_id").agg(F.collect_list(F.struct("shard", "bits")).alias(name)), name)
