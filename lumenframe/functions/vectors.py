"""Vectors as arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD_BYTES = 4 * 513  # a head file: 512 weights and a bias, 32-bit little-endian


def dot(a: Column, b: Column) -> Column:
    """The sum of products; the longer array's rest counts for nothing."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """a with length 1; a zero vector as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 where either has no length, null where either is null."""
    n = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def aesthetic_score(vector: Column, weights: list[float], bias: float) -> Column:
    """A linear head whose scale of 1 to 10 is brought to 0 to 1."""
    raw = dot(vector, F.array(*[F.lit(float(w)) for w in weights])) + F.lit(float(bias))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (raw - 1.0) / 9.0))


def read_head(data: bytes) -> tuple[list[float], float]:
    """Weights and bias of a head file; ValueError if its size is wrong."""
    import struct

    if len(data) != HEAD_BYTES:
        raise ValueError(f"a head file has {HEAD_BYTES} bytes, this one {len(data)}")
    *weights, bias = struct.unpack("<513f", data)
    return weights, bias
