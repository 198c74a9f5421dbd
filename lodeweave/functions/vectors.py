"""Vector functions on array columns, inside the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for null or empty vectors, unequal lengths and zero norms."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(ok, dot(a, b) / norm).otherwise(0.0)


def deterministic_embedding(text: Column) -> Column:
    """Eight numbers in [-1, 1] from the SHA-256 of the text."""
    digest = F.sha2(text, 256)
    return F.array(*[F.round(F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double") / 255 * 2 - 1, 6) for i in range(8)])


def deterministic_vector(text: str) -> list[float]:
    """The same of one text on the driver."""
    return [round(b / 255 * 2 - 1, 6) for b in hashlib.sha256(text.encode()).digest()[:8]]
