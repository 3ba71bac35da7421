"""Vector expressions and the built-in deterministic text embedding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from memlake.functions.text import let
from memlake.schema import EMBED_DIM

# Fixed value: keeps the norm of a zero vector away from zero.
NORM_EPSILON = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(NORM_EPSILON)) * (norm(b) + F.lit(NORM_EPSILON)))


def _digest_bytes(text: Column) -> Column:
    """The 32 bytes of the SHA-256 of the text as doubles 0..255."""
    return let(F.sha2(text, 256), lambda digest: F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double"),
    ))


def _unit(values: Column) -> Column:
    """The vector divided by its norm."""
    def scale(v: Column) -> Column:
        return let(norm(v) + F.lit(NORM_EPSILON), lambda n: F.transform(v, lambda x: x / n))

    return let(values, scale)


def digest_embedding(text: Column, dim: int = EMBED_DIM) -> Column:
    """Deterministic unit vector: the digest bytes scaled to 0..1 and repeated up to ``dim``."""
    scaled = F.transform(_digest_bytes(text), lambda b: b / F.lit(255.0))
    return _unit(F.slice(F.flatten(F.array_repeat(scaled, -(-dim // 32))), 1, dim))


def digest_embedding_padded(text: Column, dim: int = EMBED_DIM) -> Column:
    """Deterministic unit vector: the digest bytes followed by zeros."""
    return _unit(F.slice(F.concat(_digest_bytes(text), F.array_repeat(F.lit(0.0), max(dim - 32, 0))), 1, dim))
