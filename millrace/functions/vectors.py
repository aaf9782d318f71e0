"""Shingles, MinHash and vector measures as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shingles(tokens: Column, k: int = 3) -> Column:
    """k tokens joined by a blank; with fewer tokens, the tokens."""
    n = F.size(tokens) - k + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, k), " "))).otherwise(tokens)


def minhash(parts: Column, n: int = 64) -> Column:
    """By seed, the least first 8 bytes (hex) of sha256("seed:part"); zeros without parts."""
    least = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.array_min(F.transform(parts, lambda x: F.substring(F.sha2(F.concat(s.cast("string"), F.lit(":"), x), 256), 1, 16))))
    return F.when(F.size(parts) > 0, least).otherwise(F.array_repeat(F.lit("0" * 16), n))


def signature_similarity(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths or a zero vector."""
    d = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (d == 0), F.lit(0.0)).otherwise(dot(a, b) / d)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def normalised(a: Column, tolerance: float = 0.02) -> Column:
    """Null for a zero vector; scaled if the norm is off by more than the tolerance."""
    n = norm(a)
    return F.when(n < 1e-12, None).when(F.abs(n - 1) > tolerance, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))
