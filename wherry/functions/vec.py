"""Vector and scalar statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit length; vectors shorter than 1e-9 are left as they are."""
    n = norm(v)
    return F.when(n < 1e-9, as_doubles(v)).otherwise(F.transform(as_doubles(v), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def distance_score(similarity: Column) -> Column:
    """Score of unit vectors from their dot product: 1 / (1 + L2 distance)."""
    return 1 / (1 + F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * similarity)))


def max_sim(query_tokens: Column, doc_tokens: Column) -> Column:
    """Late interaction: the best match of each query vector, summed."""
    return F.aggregate(F.transform(query_tokens, lambda q: F.array_max(F.transform(doc_tokens, lambda d: dot(q, d)))), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


Z95 = 1.96


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """95 % confidence bounds of a share; (0, 0) for no trials."""
    p = successes / n
    z2 = z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0), F.when(some, F.least(F.lit(1.0), centre + half)).otherwise(0.0)


def fnv1a32(c: Column) -> Column:
    """FNV-1a of a text's UTF-8 bytes, 32 bits."""
    codes = F.transform(F.regexp_extract_all(F.hex(c.cast("binary")), F.lit(".."), 0), lambda h: F.conv(h, 16, 10).cast("long"))
    # Products stay below 2^57: a 32-bit state times the prime 0x01000193.
    return F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda s, b: (s.bitwiseXOR(b) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))
