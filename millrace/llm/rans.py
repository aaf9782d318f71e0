"""Token-ID output in interleaved range asymmetric numeral system blocks.

The output is a folder with three Parquet tables, which Spark's commit protocol covers on any store; nothing else is needed to read it back.
model: id, f, the shared frequency table. manifest, written last, so that a folder without it is not whole: one row of format, vocabulary,
lanes, steps, bits, n_ids and n_blocks. blocks: a row is a block of whole documents with part, block, first (ids of
the part before it), n_ids and data. data holds, little-endian: the mark, the
numbers of documents and ids, the documents' ids and lengths, then LANES interleaved streams that share one static frequency
table, a checkpoint (all lanes' states and the place in the words) every STEPS steps, and a crc32 of everything before it.
Blocks decode without each other, and the stretches between a block's checkpoints do too; a damaged block is an error.

The frequency table is counted over all ids (a row of counts by task, added up by Spark) and scaled to 2^bits; it is one row per
vocabulary entry on the driver. Documents are dealt by ranges of doc_id; what lies before a range is added up in groups of
GROUP_PARTS ranges, and only the groups' totals go to the driver.

Defined results: null text is empty and has the end id only; null ids come first; equal doc_ids keep their rows, in the order
of their ids' bytes; a document of any length is one block at least.
"""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import PATTERN, Encoder, Vocabulary, byte_letters, id_type
from millrace.llm.shared import Batches, attached, begin_task, count_shuffles, doc_columns, kept, mapped, removed, slices, stored, tune

LANES, STEPS, BLOCK_IDS = 2048, 256, 1 << 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MARK = b"MRANS\x00\x00\x01"

#: Parts whose totals are added up in one task, so that the driver gets a row for so many parts.
GROUP_PARTS = 4096


def library(path: str) -> tuple[int, Encoder]:
    """The tokenizers library on the chunks that a worker has not met; one per worker and file, while the stage lasts."""

    def made() -> tuple[int, Encoder]:
        from tokenizers import Tokenizer

        gc.set_threshold(200_000, 50, 100)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        size = t.get_vocab_size(with_added_tokens=True)
        kind = id_type(size)

        merged = t.model.tokenize
        letters = dict(enumerate(byte_letters()))

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Pieces of a blank and letters below U+0250 are whole for any version of the pre-split, so the library's model gets them
            at once; the library splits the others itself."""
            blank, ids, n, others = letters[32], [], [], []
            for i, p in enumerate(pieces):
                if p[0] == " " and p[1:].isalpha():
                    if p.isascii():
                        found = merged(blank + p[1:])
                    elif max(p) < "\u0250":
                        found = merged(p.encode().decode("latin-1").translate(letters))
                    else:
                        found = None
                    if found is not None:
                        n.append(len(found))
                        ids.extend([x.id for x in found])
                        continue
                others.append((i, len(ids)))
                n.append(0)
            flat, n = np.array(ids, kind), np.array(n, np.int64)
            if others:
                got = [e.ids for e in t.encode_batch_fast([pieces[i] for i, _ in others], add_special_tokens=False)]
                sizes = np.fromiter(map(len, got), np.int64, len(got))
                n[[i for i, _ in others]] = sizes
                flat = np.insert(flat, np.repeat([k for _, k in others], sizes), np.fromiter(chain.from_iterable(got), kind, int(sizes.sum())))
            return flat, n

        special = {x.content: i for i, x in t.get_added_tokens_decoder().items()}
        return size, Encoder(PATTERN, special, size, encode)

    return kept(f"library {path}", made)


class Frequencies:
    """Static model: frequencies scaled to 2^bits, each seen id at least 1."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, size: int):
        self.bits = max(20, int(np.ceil(np.log2(4 * max(2, size)))))
        total = 1 << self.bits
        f = np.maximum(1, np.floor(counts / max(1, counts.sum()) * total)).astype(np.int64)
        while (rest := total - int(f.sum())) and len(f):
            # what is left over goes to the largest; what is too much comes off the large ones, never below 1
            order = np.argsort(-f, kind="stable")
            if rest > 0:
                f[order[0]] += rest
            else:
                room = np.minimum(f[order] - 1, np.maximum(1, f[order] * -rest // total + 1))
                take = np.minimum(room, np.maximum(0, -rest - (np.cumsum(room) - room)))
                f[order] -= take
        self.hold(np.asarray(ids), f, size)

    @classmethod
    def read(cls, ids: np.ndarray, f: np.ndarray, size: int, bits: int) -> Frequencies:
        """The model of a written table."""
        if len(f) and int(f.sum()) != 1 << bits:
            raise ValueError("the frequency table is damaged")
        out = cls.__new__(cls)
        out.bits = bits
        out.hold(ids, f, size)
        return out

    def hold(self, ids: np.ndarray, f: np.ndarray, size: int) -> None:
        self.f = np.zeros(size, np.uint64)
        self.f[ids] = f.astype(np.uint64)
        self.c = np.append(np.uint64(0), np.cumsum(self.f)[:-1]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(size, dtype=np.int64), self.f.astype(np.int64))


def encoded(ids: np.ndarray, model: Frequencies) -> bytes:
    """Streams of one block: states and words, with checkpoints."""
    n, bits = len(ids), np.uint64(model.bits)
    steps = -(-n // LANES)
    x = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    points: list[tuple[np.ndarray, int]] = []
    made = 0
    for t in range(steps - 1, -1, -1):
        s = ids[t * LANES : (t + 1) * LANES]
        k = len(s)
        f = model.f[s]
        y = x[:k]
        over = y >= ((LOW >> bits) << WORD) * f
        w = (y[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        words.append(w)
        made += len(w)
        y = np.where(over, y >> WORD, y)
        q = y // f
        x[:k] = (q << bits) + (y - q * f) + model.c[s]
        if t % STEPS == 0:
            points.append((x.copy(), made))
    points.reverse()
    words.reverse()
    head = np.array([n, len(points), made], np.uint64).tobytes() + np.array([made - m for _, m in points], np.uint64).tobytes()
    return head + b"".join(p.tobytes() for p, _ in points) + b"".join(w.tobytes() for w in words)


def decoded(data: bytes, model: Frequencies) -> np.ndarray:
    n, n_points, made = np.frombuffer(data, np.uint64, 3).tolist()
    places = np.frombuffer(data, np.uint64, n_points, 24).tolist()
    at = 24 + 8 * n_points
    states = np.frombuffer(data, np.uint64, n_points * LANES, at).reshape(-1, LANES)
    words = np.frombuffer(data, np.uint32, made, at + 8 * n_points * LANES).astype(np.uint64)
    out = np.empty(n, np.int64)
    for k in range(n_points):  # each stretch needs nothing from the others
        stretch(out, words, states[k].copy(), places[k], k * STEPS, model)
    return out


def stretch(out: np.ndarray, words: np.ndarray, x: np.ndarray, at: int, step: int, model: Frequencies) -> None:
    bits, mask = np.uint64(model.bits), np.uint64((1 << model.bits) - 1)
    for t in range(step, min(step + STEPS, -(-len(out) // LANES))):
        k = min(LANES, len(out) - t * LANES)
        y = x[:k]
        slot = y & mask
        s = model.symbol[slot.astype(np.int64)]
        out[t * LANES : t * LANES + k] = s
        y = model.f[s] * (y >> bits) + slot - model.c[s]
        under = np.nonzero(y < LOW)[0]
        y[under] = (y[under] << WORD) | words[at : at + len(under)]
        at += len(under)
        x[:k] = y


def block(doc_ids: list[int | None], ids: list[np.ndarray], model: Frequencies) -> bytes:
    null = np.array([d is None for d in doc_ids])
    body = encoded(np.concatenate(ids).astype(np.int64), model)
    index = zlib.compress(np.array([0 if d is None else d for d in doc_ids], np.int64).tobytes() + np.array([len(x) for x in ids], np.uint32).tobytes() + np.packbits(null).tobytes(), 1)
    data = MARK + np.array([len(doc_ids), len(index)], np.uint64).tobytes() + index + body
    return data + np.array([zlib.crc32(data)], np.uint32).tobytes()


def opened(data: bytes, model: Frequencies) -> tuple[list[int | None], list[np.ndarray]]:
    if data[:8] != MARK or zlib.crc32(data[:-4]) != np.frombuffer(data[-4:], np.uint32)[0]:
        raise ValueError("a block is damaged")
    n, size = np.frombuffer(data, np.uint64, 2, 8).tolist()
    index = zlib.decompress(data[24 : 24 + size])
    doc_ids = np.frombuffer(index, np.int64, n).tolist()
    lengths = np.frombuffer(index, np.uint32, n, 8 * n)
    null = np.unpackbits(np.frombuffer(index, np.uint8, -1, 12 * n), count=n).tolist()
    ids = decoded(data[24 + size : -4], model)
    ends = np.cumsum(lengths)[:-1]
    return [None if z else d for d, z in zip(doc_ids, null, strict=True)], np.split(ids, ends)


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the folder path, which must not be there yet, and returns it."""
    spark = docs.sparkSession
    tune(spark)
    size = Vocabulary(tokenizer).size

    kind = id_type(size)

    def tokens(batches: Batches) -> Batches:
        """Rows with ids; then one row with how often the task has met each id."""
        begin_task()
        seen = np.zeros(size, np.int64)
        for b in batches:
            _, enc = library(tokenizer)
            end = np.array([end_id], enc.kind).tobytes()
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in slices(texts):
                ids = [x + end for x in enc(texts[lo:hi])]
                seen += np.bincount(np.frombuffer(b"".join(ids), kind), minlength=size)
                nothing = pa.nulls(hi - lo, pa.list_(pa.int32())), pa.nulls(hi - lo, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(ids, pa.binary()), *nothing], ["doc_id", "ids", "seen", "times"])
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(1, pa.int64()), "ids": pa.nulls(1, pa.binary()), "seen": pa.array([at], pa.list_(pa.int32())), "times": pa.array([seen[at]], pa.list_(pa.int64()))})

    found = stored(doc_columns(docs, id_col, text_col).mapInArrow(tokens, "doc_id long, ids binary, seen array<int>, times array<long>"), "ids")
    ids = found.where("ids is not null").select("doc_id", "ids")
    each = found.where("ids is null").select(F.explode(F.arrays_zip("seen", "times")).alias("x"))
    counts = each.groupBy(F.col("x.seen").alias("id")).agg(F.sum("x.times").alias("n")).orderBy("id").collect()
    model = Frequencies(np.array([r.id for r in counts], np.int64), np.array([r.n for r in counts], np.int64), size)
    total = sum(r.n for r in counts)
    known = np.nonzero(model.f)[0]
    spark.createDataFrame([(int(i), int(model.f[i])) for i in known], "id int, f long").coalesce(1).write.parquet(f"{path}/model")
    sent = spark.sparkContext.broadcast(model)

    def blocks(batches: Batches) -> Batches:
        begin_task()
        part, k, first = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        n = 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([k], pa.int32()), "first": pa.array([first], pa.int64()), "n_ids": pa.array([n], pa.int64()), "data": pa.array([block(names, held, sent.value)], pa.binary())})

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                one = np.frombuffer(x, kind)
                if held and n + len(one) > BLOCK_IDS:
                    yield done()
                    k, first, n, names, held = k + 1, first + n, 0, [], []
                names.append(d)
                held.append(one)
                n += len(one)
        if held:
            yield done()

    parts = max(count_shuffles(spark), total // (8 * BLOCK_IDS) + 1)
    # equal doc_ids (all null ones, say) are dealt by their first ids, so that they do not meet in one task
    order = [F.col("doc_id").asc_nulls_first(), F.substring("ids", 1, 16)]
    dealt = ids.repartitionByRange(parts, *order).sortWithinPartitions(order[0], "ids")
    dealt.mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks")
    removed(found)
    done = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").agg(F.count(F.lit(1)), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    spark.createDataFrame([(MARK.decode("latin-1"), size, LANES, STEPS, model.bits, done[1], done[0])], MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    return path


BLOCKS = "part int, block int, first long, n_ids long, data binary"
MANIFEST = "format string, vocabulary int, lanes int, steps int, bits int, n_ids long, n_blocks long"


def read_back(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, on demand, ids, decoded block by block from a folder that write() has made."""
    head = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").first()
    if (head.format, head.lanes, head.steps) != (MARK.decode("latin-1"), LANES, STEPS):
        raise ValueError(f"{path} is of another format: {head}")
    table = spark.read.schema("id int, f long").parquet(f"{path}/model").collect()  # a row for each entry of the vocabulary at most
    model = Frequencies.read(np.array([r.id for r in table], np.int64), np.array([r.f for r in table], np.int64), head.vocabulary, head.bits)
    files = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    own = stored(files.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("in_group", F.floor(F.col("part") / GROUP_PARTS)), "totals")
    group, start = [], 0
    for r in own.groupBy("in_group").agg(F.sum("n").alias("n")).orderBy("in_group").collect():
        group.append((r.in_group, start))
        start += r.n
    ahead = F.sum("n").over(Window.partitionBy("in_group").orderBy("part")) - F.col("n")
    base = own.select("part", "in_group", ahead.alias("ahead")).join(F.broadcast(spark.createDataFrame(group, "in_group long, start long")), "in_group").select("part", (F.col("start") + F.col("ahead")).alias("base"))
    sent = spark.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for row in b.to_pylist():
            doc_ids, ids = opened(row["data"], model)
            lengths = np.array([len(x) for x in ids], np.int64)
            out = {
                "doc_id": pa.array(doc_ids, pa.int64()),
                "start": pa.array(row["base"] + row["first"] + np.cumsum(lengths) - lengths),
                "n_tokens": pa.array(lengths),
                "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
            }
            if keep_ids:
                out["ids"] = pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return attached(files, base, "part", F.lit(0)).mapInArrow(mapped(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids)
