"""Vector code compression: product quantisation by Lloyd's rounds with Hamerly's two bounds, in whole numbers.

A vector's components become floor(scale * x); it is cut into equal parts, and each part position has a codebook that starts as that part
of the vectors with the smallest ids. Beside its parts, a row carries for each part its entry, an upper bound of the distance to it and a
lower bound of the distance to the second nearest entry. When entries move, the upper bound grows by the own entry's way and the lower one
shrinks by the longest way of any other. While the upper bound is strictly below the lower one (or below half the way from the own entry to
its nearest neighbour), no other entry can be as near, not even in a tie; else the upper bound is set to the exact distance, and if
that fails too, all entries are scanned in whole numbers, of which the lowest index wins a tie. Bounds are rounded outwards.

A round is one pass over the rows in numpy: it writes the rows with their new bounds and, for each task, a row of sums and a count for
each entry; Spark adds these up, and only the codebooks (entries times components, independent of the number of rows) go to the driver
and back. Each round's table is written to the shared folder; the one before is removed once it is replaced.

Defined results: rows whose vector is null, empty, or holds a null or a number that is not finite are dropped, and so are rows whose length
is not that of the first kept vector (by id, then vector), all of them if that length cannot be cut into equal parts. Components
beyond the bound at which distances fit 64 bits are held at it (`bound`). Null ids come first; rows that share an id are ordered by vector. With
fewer rows than entries, the codebooks are smaller. Labels may have any type and are compared as strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import Batches, attached, begin_task, removed, stored, tune

#: Rows by entries that one exact scan holds.
SCAN = 1 << 22


def bound(dim: int) -> int:
    """The largest component for which the squared distance of two vectors fits 62 bits."""
    return int(np.sqrt(2.0**62 / max(1, dim)) / 2)


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    most = bound(x.shape[1])
    return np.clip(np.floor(x.astype(np.float64) * scale), -most, most).astype(np.int64)


def finite(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


class Books:
    """Codebooks of all parts (parts, entries, width), with what the bounds need: each entry's way since the round before, and half its way
    to the nearest other."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        parts, n, _ = entries.shape
        self.moved = np.zeros((parts, n)) if before is None else outward(np.sqrt(((entries - before).astype(np.float64) ** 2).sum(2)))
        self.half = np.full((parts, n), np.inf)
        for p in range(parts if n > 1 else 0):
            d = exact(entries[p], entries[p])
            np.fill_diagonal(d, np.iinfo(np.int64).max)
            self.half[p] = inward(np.sqrt(d.min(1).astype(np.float64)) / 2)
        # for each entry, the longest way of any other
        self.others = np.zeros((parts, n))
        if n > 1:
            order = np.argsort(-self.moved, axis=1, kind="stable")
            top = np.take_along_axis(self.moved, order[:, :2], 1)
            self.others[:] = top[:, :1]
            self.others[np.arange(parts), order[:, 0]] = top[:, 1]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def outward(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf)).astype(np.float64) * (1 + 1e-7)


def inward(x: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.nextafter(x.astype(np.float32), np.float32(-np.inf)).astype(np.float64) * (1 - 1e-7))


def exact(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, in whole numbers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < 1 << 52:
        # every sum is a whole number that a double holds, so the product is exact
        a, c = x.astype(np.float64), entries.astype(np.float64)
        d = a @ c.T
        d *= -2
        d += (a * a).sum(1)[:, None]
        d += (c * c).sum(1)
        return d.astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - entries[:, k]) ** 2
    return out


def assigned(x: np.ndarray, books: Books, p: int, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper, lower, rows scanned in full) of part p of each row; without bounds from before, all rows are scanned."""
    entries = books.entries[p]
    if code is None:
        code, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
        todo = np.arange(len(x))
    else:
        code = code.astype(np.int64)
        upper = outward(upper.astype(np.float64) + books.moved[p][code])
        lower = inward(lower.astype(np.float64) - books.others[p][code])
        safe = np.maximum(lower, books.half[p][code])
        todo = np.flatnonzero(~(upper < safe))
        if len(todo):
            upper[todo] = outward(np.sqrt(((x[todo] - entries[code[todo]]) ** 2).sum(1).astype(np.float64)))
            todo = todo[~(upper[todo] < safe[todo])]
    step = max(1, SCAN // len(entries))
    for lo in range(0, len(todo), step):
        at = todo[lo : lo + step]
        d = exact(x[at], entries)
        best = d.argmin(1)  # the lowest index of the nearest
        rows = np.arange(len(at))
        code[at], upper[at] = best, outward(np.sqrt(d[rows, best].astype(np.float64)))
        d[rows, best] = np.iinfo(np.int64).max
        lower[at] = inward(np.sqrt(d.min(1).astype(np.float64))) if len(entries) > 1 else np.inf
    return code, upper, lower, len(todo)


def sums_of(x: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    held = code[order]
    first = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else held
    sums = np.zeros((n, x.shape[1]), np.int64)
    if len(held):
        sums[held[first]] = np.add.reduceat(x[order], first, axis=0)
    return sums, np.bincount(code, minlength=n)


STATE = "vec_id long, label string, x binary, code binary, upper binary, lower binary, error long"
SUMS = "part int, entry int, n long, sums array<long>"
KINDS = {"vec_id": pa.int64(), "label": pa.string(), "x": pa.binary(), "code": pa.binary(), "upper": pa.binary(), "lower": pa.binary(), "error": pa.int64(), "part": pa.int32(), "entry": pa.int32(), "n": pa.int64(), "sums": pa.list_(pa.int64())}


def record(k: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f] if f in columns else pa.nulls(k, kind) for f, kind in KINDS.items()], list(KINDS))


def rows_of(x: np.ndarray, kind: str) -> pa.Array:
    """A binary value of each row of a matrix."""
    data = np.ascontiguousarray(x.astype(kind))
    wide = data.dtype.itemsize * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(0, wide * (len(data) + 1), wide, dtype=np.int32)), pa.py_buffer(data)])


def matrix(column: pa.Array, kinds: dict[int, str], width: int) -> np.ndarray:
    """The rows' binary values as a matrix; kinds: number type by bytes of a value."""
    values = column.to_pylist()
    size = len(values[0])
    if all(len(v) == size for v in values):
        return np.frombuffer(b"".join(values), kinds[size]).reshape(-1, width)
    return np.stack([np.frombuffer(v, kinds[len(v)]).astype(np.int64) for v in values])


def round_of(rows: DataFrame, books: Books, parts: int, scale: float | None, last: bool) -> DataFrame:
    """One pass. scale: of vectors that come as arrays (the first pass). last: only codes and errors are needed."""
    sent = rows.sparkSession.sparkContext.broadcast(books)
    n, width = books.entries.shape[1:]
    dim = parts * width

    def run(batches: Batches) -> Batches:
        begin_task()
        books = sent.value
        sums, counts = np.zeros((parts, n, width), np.int64), np.zeros((parts, n), np.int64)
        for b in batches:
            k = b.num_rows
            if not k:
                continue
            if scale is not None:
                x = scaled(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(k, dim), scale)
            else:
                x = matrix(b.column("x"), {2 * dim: "<i2", 8 * dim: "<i8"}, dim).astype(np.int64)
                code, upper, lower = matrix(b.column("code"), {parts: "u1", 2 * parts: "<u2"}, parts), *(matrix(b.column(c), {4 * parts: "<f4"}, parts) for c in ("upper", "lower"))
            codes, uppers, lowers, error = np.zeros((k, parts), np.int64), np.zeros((k, parts)), np.zeros((k, parts)), np.zeros(k, np.int64)
            for p in range(parts):
                y = x[:, p * width : (p + 1) * width]
                before = (None, None, None) if scale is not None else (code[:, p], upper[:, p], lower[:, p])
                codes[:, p], uppers[:, p], lowers[:, p], _ = assigned(y, books, p, *before)
                if last:
                    error += ((y - books.entries[p][codes[:, p]]) ** 2).sum(1)
                else:
                    s, c = sums_of(y, codes[:, p], n)
                    sums[p] += s
                    counts[p] += c
            named = {"vec_id": b.column("vec_id"), "label": b.column("label"), "code": rows_of(codes, "u1" if n <= 256 else "<u2")}
            if last:
                yield record(k, **named, error=pa.array(error))
            else:
                small = np.abs(x).max(initial=0) < 1 << 15
                up = np.nextafter(uppers.astype(np.float32), np.float32(np.inf))
                down = np.nextafter(lowers.astype(np.float32), np.float32(-np.inf))
                yield record(k, **named, x=rows_of(x, "<i2" if small else "<i8"), upper=rows_of(up, "<f4"), lower=rows_of(down, "<f4"))
        if not last and counts.any():
            part, entry = np.nonzero(counts)
            yield record(len(part), part=pa.array(part, pa.int32()), entry=pa.array(entry, pa.int32()), n=pa.array(counts[part, entry]), sums=pa.array(sums[part, entry].tolist(), KINDS["sums"]))

    return stored(rows.mapInArrow(run, f"{STATE}, {SUMS}"), "codes")


def moved(found: DataFrame, books: Books) -> Books:
    """The entries after a round: floor of the mean of their parts."""
    width = books.entries.shape[2]
    each = found.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    entries = books.entries.copy()
    for r in each.collect():  # a row for each entry at most
        entries[r.part, r.entry] = np.array(r.sums, np.int64) // r.n
    return Books(entries, books.entries)


def compressed(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Books]:
    """(vec_id, label as a string, code as bytes, error; written), the codebooks. entries: up to 65536."""
    spark = vectors.sparkSession
    tune(spark)
    v = vectors[f"`{vector_col}`"].cast("array<double>")
    rows = vectors.select(vectors[f"`{id_col}`"].cast("long").alias("vec_id"), vectors[f"`{label_col}`"].cast("string").alias("label"), v.alias("x")).where(finite(v))
    order = [F.col("vec_id").asc_nulls_first(), F.col("x")]
    first = rows.select("vec_id", "x").orderBy(*order).limit(entries).collect()
    dim = len(first[0].x) if first else 0
    if any(len(r.x) != dim for r in first):
        first = rows.where(F.size("x") == dim).select("vec_id", "x").orderBy(*order).limit(entries).collect()
    if not first or dim % parts:
        return spark.createDataFrame([], "vec_id long, label string, code binary, error long"), Books(np.zeros((parts, 0, 0), np.int64))
    seeds = scaled(np.array([r.x for r in first]), scale)
    books = Books(np.ascontiguousarray(seeds.reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2)))
    held, given = rows.where(F.size("x") == dim), scale
    for _ in range(rounds):
        found = round_of(held, books, parts, given, last=False)
        if given is None:
            removed(held)
        books = moved(found, books)
        held, given = found.where("part is null").drop("part", "entry", "n", "sums"), None
    out = round_of(held, books, parts, given, last=True)
    if given is None:
        removed(held)
    return out.select("vec_id", "label", "code", "error"), books


def report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code (hex), error, label_error (the errors of all rows of its label), codebooks_sha256."""
    coded, books = compressed(vectors, **options)
    # null labels are equal; no label is text that begins with '-'
    name = F.when(F.col("label").isNull(), "-").otherwise(F.concat(F.lit("+"), "label"))
    coded = coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", name.alias("name"))
    sums = stored(coded.groupBy("name").agg(F.sum("error").alias("label_error")), "labels")
    return attached(coded, sums, "name", F.length("name")).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


__all__ = ["Books", "compressed", "report"]
