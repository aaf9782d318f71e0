"""What the operators share: work tables in the cluster's shared folder, Arrow helpers, hashing of word windows."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.work import shuffles_removed

Batches = Iterator[pa.RecordBatch]

#: Texts of one Arrow batch are worked on in slices of about so many bytes, so memory does not follow the batch's row count.
SLICE_BYTES = 2 << 20
#: Words whose hash a Python worker keeps (some 130 bytes each). A full table is emptied, so memory is bounded.
WORD_LIMIT = 200_000

ODD = np.uint64(0x9E3779B97F4A7C15)
ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Only where that is unset and everything runs in one
    process (local mode, as in tests) a temporary folder takes its place; a cluster without the setting is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/checkpoints/millrace"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def tune(spark: SparkSession) -> None:
    """Batches of bounded size, between Spark and Python and from Parquet: 4096 texts in one column vector are an array of tens of MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there and any executor can read it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the folder of a stored() table that nothing needs any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def attached(df: DataFrame, table: DataFrame, key: str | list[str], size: Column, how: str = "inner", limit: int = 16 << 20) -> DataFrame:
    """df joined with a stored table by key. The table is broadcast only if its rows' sizes (size: bytes of a row) add up to limit at
    most, which is counted first; else the join shuffles both."""
    total = table.agg(F.sum(size + 64)).first()[0] or 0
    return df.join(F.broadcast(table) if total <= limit else table, key, how)


def count_shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(wanted: str, taken: list[str]) -> str:
    """wanted, with underscores in front until no column of that name (in any case) is there."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def pick(df: DataFrame, *names: str) -> list[Column]:
    """Columns by exact name, so that dots and further columns of the table do no harm."""
    return [df[f"`{n}`"].alias(n) for n in names]


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named by place, since mapInArrow takes no names with dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about limit bytes; a longer text is a range of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


class WordHashes(dict):
    """64-bit hash by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = WordHashes()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


_KEPT: dict[str, Any] = {}
_STAGE = [-1]


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What this worker keeps under a name from batch to batch and task to task, until a task of another stage begins here."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def begin_task() -> None:
    """At the start of a task: if the worker last worked for another stage, all its tables go and their memory goes back to the system, so
    that what stages keep does not add up in a worker that Spark uses for all of them."""
    task = TaskContext.get()
    if task is None or task.stageId() == _STAGE[0]:
        return
    _STAGE[0] = task.stageId()
    _KEPT.clear()
    WORDS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library gives memory back by itself


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads them evenly."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(h: np.ndarray, size: int, base: np.uint64 = ODD) -> np.ndarray:
    """Hash of each run of size values, by doubling: O(len log size). Windows over a document's end are the caller's to leave out."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, have, power, bits = None, 0, base, h
        width = 1
        while width <= size:
            if size & width:
                if out is None:
                    out, have = bits, width
                else:
                    n = min(len(out), len(bits) - have)
                    out, have = out[:n] * power + bits[have : have + n], have + width
            bits = bits[: len(bits) - width] * power + bits[width:] if 2 * width <= size else bits
            power = power * power
            width *= 2
        return out[: len(h) - size + 1]


def spans_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each document in the joined words."""
    ends = np.cumsum(counts, dtype=np.int64)
    return ends - counts, ends


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def mapped(f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable[[Batches], Batches]:
    """f for each Arrow batch that has rows."""

    def run(batches: Batches) -> Batches:
        begin_task()
        for b in batches:
            if b.num_rows:
                yield from f(b)

    return run


def grouped(f: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """f for each group, by its Arrow tables (one, or two of a cogroup)."""

    def one(t: pa.Table) -> pa.Table:
        begin_task()
        return f(t)

    def two(t: pa.Table, u: pa.Table) -> pa.Table:
        begin_task()
        return f(t, u)

    return two if f.__code__.co_argcount == 2 else one


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[f"`{id_col}`"].cast("long").alias("doc_id"), df[f"`{text_col}`"].cast("string").alias("text"))


