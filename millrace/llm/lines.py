"""Line dedup: lines found in many documents lose all their copies; a sharded minimal perfect hash holds the counts.

1. Every document sends its distinct line hashes (128 bits of the key: blanks stripped at both ends, A-Z lower-cased). A task
   adds up what it reads before it sends, and Spark adds before and after the shuffle: a line of a third of all rows is one
   row per task.
2. The distinct hashes found in two documents or more (all, if min_docs is 1; a line of one document never reaches a higher
   min_docs, so the index leaves it out) are dealt to shards. A shard is a minimal perfect hash (levels of bit arrays; a hash that
   is alone in its cell at a level is placed, others go on; ranks are counted by bits) whose ranks index an array of 64-bit
   fingerprints and an array of counts.
3. Documents probe: the rank of a hash, its fingerprint, then its count, which decides. A hash that is not in the index fails at
   the fingerprint. While the shards together are under BROADCAST_BYTES (checked) they are broadcast. Above it, probes (hash, batch,
   without text) are dealt to the shards, each shard to as many tasks as its probes ask for, and the answers go back by batch.

Defined results: a null or empty text is one empty line and stays; keys of under min_chars code points stay; repeated rows are
documents of their own; null ids keep their rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructType

from millrace.llm.shared import ODD, Batches, begin_task, count_shuffles, doc_columns, free_name, grouped, kept, mapped, mixed, slices, stored, table, texts_of, tune
from millrace.llm.sharing import packed, unpacked

#: Bytes of all shards up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Hashes of a shard, about.
SHARD_KEYS = 250_000
#: Bytes of hashes that one task looks up in a shard, about.
ASKED_BYTES = 32 << 20
#: Cells of a level for each hash that is left.
SPARE = 2
#: Distinct lines that a task adds up before it sends them.
HELD = 300_000

BLANKS = b" \t\n\x0b\x0c\r"


def key_of(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()  # bytes: only A-Z


def line_hashes(lines: list[bytes], min_chars: int) -> list[bytes]:
    """16 bytes by line; empty where the key is too short to count."""
    digest = xxhash.xxh3_128_digest
    keys = [key_of(x) for x in lines]
    if min_chars <= 1:
        return [digest(k) if len(k) >= min_chars else b"" for k in keys]
    return [digest(k) if len(k) >= min_chars and len(k.decode("utf-8", "replace")) >= min_chars else b"" for k in keys]


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit pairs, with a fingerprint and a count at each rank. A level is an array of 64-bit words;
    before has the bits set before each word, so a rank is a lookup and a count of bits."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray):
        n = len(hi)
        self.sizes, self.levels = [], []
        todo = np.arange(n)
        place = np.empty(n, np.int64)
        rank = 0
        while len(todo):
            size = SPARE * len(todo) + 1
            cells = self._cell(hi[todo], lo[todo], len(self.levels), size)
            alone = np.bincount(cells, minlength=size) == 1
            self.sizes.append(size)
            self.levels.append(np.packbits(np.append(alone, np.zeros(-size % 64, bool)), bitorder="little").view(np.uint64))
            ranks = np.cumsum(alone) - 1
            won = alone[cells]
            place[todo[won]] = rank + ranks[cells[won]]
            rank += int(won.sum())
            todo = todo[~won]
        self.fingerprints, self.counts = np.empty(n, np.uint64), np.empty(n, np.uint32)
        self.fingerprints[place] = lo
        self.counts[place] = np.minimum(counts, 2**32 - 1)
        self._ready()

    def _ready(self) -> None:
        self.before, total = [], 0
        for level in self.levels:
            set_bits = np.bitwise_count(level).astype(np.int64)
            self.before.append((total + np.cumsum(set_bits) - set_bits).astype(np.uint32))
            total += int(set_bits.sum())

    @staticmethod
    def _cell(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(hi + lo * ODD + np.uint64(level)) % np.uint64(size)).astype(np.int64)

    def count(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The count of each pair; 0 for those that are not in the index."""
        out = np.zeros(len(hi), np.int64)
        todo = np.arange(len(hi))
        one = np.uint64(1)
        for k, (size, level) in enumerate(zip(self.sizes, self.levels, strict=True)):
            if not len(todo):
                break
            cells = self._cell(hi[todo], lo[todo], k, size)
            word, bit = cells >> 6, (cells & 63).astype(np.uint64)
            here = (level[word] >> bit & one).astype(bool)
            w = word[here]
            at = self.before[k][w].astype(np.int64) + np.bitwise_count(level[w] & ((one << bit[here]) - one))
            same = self.fingerprints[at] == lo[todo[here]]
            out[todo[here][same]] = self.counts[at[same]]
            todo = todo[~here]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.fingerprints), len(self.levels), *self.sizes], np.int64)
        return b"".join(x.tobytes() for x in (head, *self.levels, self.fingerprints, self.counts))

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        """A view of the bytes; only the arrays `before` (a sixteenth of the bits) are made anew."""
        self = cls.__new__(cls)
        n, n_levels = np.frombuffer(data, np.int64, 2).tolist()
        self.sizes = np.frombuffer(data, np.int64, n_levels, 16).tolist()
        at = 16 + 8 * n_levels
        self.levels = []
        for size in self.sizes:
            self.levels.append(np.frombuffer(data, np.uint64, -(-size // 64), at))
            at += 8 * -(-size // 64)
        self.fingerprints = np.frombuffer(data, np.uint64, n, at)
        self.counts = np.frombuffer(data, np.uint32, n, at + 8 * n)
        self._ready()
        return self


def halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def shard_of(hi: np.ndarray, n_shards: int) -> np.ndarray:
    return ((hi >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)


def counted_lines(docs: DataFrame, least: int, min_chars: int) -> DataFrame:
    """hi, lo, n: line hashes found in at least so many rows of docs(text), with their number."""

    def count(batches: Batches) -> Batches:
        begin_task()
        seen: dict[bytes, int] = {}

        def sent() -> pa.RecordBatch:
            hi, lo = halves(list(seen))
            return table(hi=pa.array(hi.view(np.int64)), lo=pa.array(lo.view(np.int64)), n=pa.array(seen.values(), pa.int64()))

        for b in batches:
            for t in texts_of(b.column(0)):
                for h in {*line_hashes(t.split(b"\n"), min_chars)} - {b""}:
                    seen[h] = seen.get(h, 0) + 1
                if len(seen) > HELD:
                    yield sent()
                    seen.clear()
        if seen:
            yield sent()

    return docs.select("text").mapInArrow(count, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def without_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of docs with the text that drop_lines() leaves, and its length in length_col if that is a column; a row that loses all
    its text stays with an empty one."""
    names = docs.columns
    others, empty = [n for n in names if n != text_col], free_name("was_null", names)
    row = F.struct(*(docs[f"`{n}`"].alias(n) for n in others), docs[f"`{text_col}`"].isNull().alias(empty))
    rows = docs.select(row.alias("row"), docs[f"`{text_col}`"].cast("string").alias("text"))
    out = probed(rows, min_docs, min_chars, "row", rows.schema["row"].dataType, True)

    def column(n: str):
        if n == text_col:
            return F.when(~F.col("row")[empty], F.col("kept")).alias(n)
        if n == length_col:
            return F.when(F.col("n_dropped") > 0, F.length("kept").cast(docs.schema[n].dataType)).otherwise(F.col("row")[n]).alias(n)
        return F.col("row")[n].alias(n)

    return out.select(*map(column, names))


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256 and, on demand, kept (the text left)."""
    return probed(doc_columns(docs, id_col, text_col), min_docs, min_chars, "doc_id", LongType(), keep_text)


def probed(rows: DataFrame, min_docs: int, min_chars: int, name_col: str, name_type: DataType, keep_text: bool) -> DataFrame:
    """rows: what to carry along in name_col, and text."""
    if min_docs < 1 or min_chars < 1:
        raise ValueError("min_docs and min_chars must be positive")
    spark = rows.sparkSession
    tune(spark)
    lines = stored(counted_lines(rows, min(2, min_docs), min_chars), "lines")
    n_shards = lines.count() // SHARD_KEYS + 1

    def shard(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = shard_of(b.column(0).to_numpy().view(np.uint64), n_shards)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *b.columns], ["shard", "hi", "lo", "n"])

    def build(t: pa.Table) -> pa.Table:
        hi, lo = (t.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
        return pa.table({"shard": t.column("shard").slice(0, 1).cast(pa.int32()), "data": pa.array([PerfectHash(hi, lo, t.column("n").to_numpy()).dump()], pa.binary())})

    shards = stored(lines.mapInArrow(mapped(shard), "shard int, hi long, lo long, n long").groupBy("shard").applyInArrow(grouped(build), "shard int, data binary"), "shards")
    size = shards.agg(F.sum(F.length("data"))).first()[0] or 0
    schema = StructType().add(name_col, name_type).add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")
    if keep_text:
        schema = schema.add("kept", "string")

    def finished(ids: pa.Array, texts: list[list[bytes]], drops: np.ndarray) -> pa.RecordBatch:
        kept, gone, at = [], [], 0
        for ls in texts:
            d = drops[at : at + len(ls)]
            at += len(ls)
            n = int(d.sum())
            gone.append(n)
            kept.append(b"\n".join([x for x, k in zip(ls, d.tolist(), strict=True) if not k]) if n else b"\n".join(ls))
        out = {name_col: ids, "n_lines": pa.array(map(len, texts), pa.int64()), "n_dropped": pa.array(gone, pa.int64()), "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
        if keep_text:
            out["kept"] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_pydict(out)

    if size <= BROADCAST_BYTES:
        sent = spark.sparkContext.broadcast({r.shard: r.data for r in shards.collect()})
        name = uuid.uuid4().hex

        def probe(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            index = held_shards(name, sent)
            texts = texts_of(b.column(1))
            for lo, hi in slices(texts):
                lists = [t.split(b"\n") for t in texts[lo:hi]]
                hashes = [h for ls in lists for h in line_hashes(ls, min_chars)]
                at = np.fromiter(map(bool, hashes), bool, len(hashes))
                drops = np.zeros(len(hashes), bool)
                if at.any():
                    drops[at] = looked_up(index, *halves(hashes), n_shards) >= min_docs
                yield finished(b.column(0).slice(lo, hi - lo), lists, drops)

        return rows.mapInArrow(mapped(probe), schema)

    batches = packed(rows, "text", "texts")

    def distinct(row: dict) -> tuple[pa.Table, list[list[bytes]], list[bytes], list[bytes]]:
        t = unpacked(row["payload"])
        lists = [x.split(b"\n") for x in texts_of(t.column("text").combine_chunks())]
        hashes = [h for ls in lists for h in line_hashes(ls, min_chars)]
        return t, lists, hashes, sorted({*hashes} - {b""})

    def emit(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in b.to_pylist():
            keys = distinct(row)[3]
            if keys:
                at = shard_of(halves(keys)[0], n_shards)
                parts = [(s, b"".join(keys[i] for i in np.nonzero(at == s)[0])) for s in np.unique(at).tolist()]
                yield table(shard=pa.array([s for s, _ in parts], pa.int32()), batch_id=pa.array([row["batch_id"]] * len(parts), pa.int64()), hashes=pa.array([x for _, x in parts], pa.binary()))

    def answer(asked: pa.Table, index: pa.Table) -> pa.Table:
        out: dict[str, list] = {"batch_id": [], "found": []}
        if index.num_rows and asked.num_rows:
            ph = PerfectHash.load(index.column("data")[0].as_py())
            for batch, data in zip(asked.column("batch_id").to_pylist(), asked.column("hashes").to_pylist(), strict=True):
                both = np.frombuffer(data, np.uint64).reshape(-1, 2)
                hit = ph.count(both[:, 0], both[:, 1]) >= min_docs
                if hit.any():
                    out["batch_id"].append(batch)
                    out["found"].append(both[hit].tobytes())
        return pa.table({"batch_id": pa.array(out["batch_id"], pa.int64()), "found": pa.array(out["found"], pa.binary())})

    # a shard is copied to as many tasks as the probes that it gets ask for, so no task's share grows with the data
    asked = stored(batches.mapInArrow(mapped(emit), "shard int, batch_id long, hashes binary"), "asked")
    copies = int((asked.agg(F.sum(F.length("hashes"))).first()[0] or 0) / n_shards / ASKED_BYTES) + 1
    p = max(count_shuffles(spark), n_shards * copies)
    asked = asked.withColumn("copy", F.pmod(F.xxhash64("batch_id"), F.lit(copies)).cast("int")).repartition(p, "shard", "copy")
    spread = shards.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    answers = asked.groupBy("shard", "copy").cogroup(spread.groupBy("shard", "copy")).applyInArrow(grouped(answer), "batch_id long, found binary")
    answers = answers.groupBy("batch_id").agg(F.collect_list("found").alias("found"))

    def finish(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in b.to_pylist():
            t, lists, hashes, _ = distinct(row)
            data = b"".join(row["found"] or [])
            found = {data[i : i + 16] for i in range(0, len(data), 16)}
            yield finished(t.column(name_col).combine_chunks(), lists, np.fromiter((h in found for h in hashes), bool, len(hashes)))

    return batches.join(answers, "batch_id", "left").mapInArrow(mapped(finish), schema)


def held_shards(name: str, sent) -> dict[int, PerfectHash]:
    """The shards that a worker has loaded, while the stage lasts."""
    return kept(f"lines {name}", lambda: {s: PerfectHash.load(d) for s, d in sent.value.items()})


def looked_up(shards: dict[int, PerfectHash], hi: np.ndarray, lo: np.ndarray, n_shards: int) -> np.ndarray:
    at, out = shard_of(hi, n_shards), np.zeros(len(hi), np.int64)
    for s, ph in shards.items():
        mine = np.nonzero(at == s)[0]
        if len(mine):
            out[mine] = ph.count(hi[mine], lo[mine])
    return out
