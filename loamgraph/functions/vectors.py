"""Vector expressions, Column to Column.  Vectors are compared as DOUBLE; unequal lengths score 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def _paired(a: Column, b: Column, value: Column, otherwise: float) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.lit(otherwise))


def dot(a: Column, b: Column) -> Column:
    a, b = _doubles(a), _doubles(b)
    return _paired(a, b, _sum(F.zip_with(a, b, lambda x, y: x * y)), 0.0)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """The largest FLOAT where the lengths differ."""
    a, b = _doubles(a), _doubles(b)
    return _paired(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))), 3.4028234663852886e38)


def angular(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def score(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Larger is nearer: cosine, dot, or a negated euclidean distance."""
    kinds = {"cosine": cosine, "dot": dot, "euclidean": lambda x, y: -euclidean(x, y), "l2": lambda x, y: -euclidean(x, y)}
    if metric not in kinds:
        raise ValueError(f"no such metric: {metric}")
    return kinds[metric](a, b)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of bytes, over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    bits = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.bit_count(x.cast("int").bitwiseXOR(y.cast("int"))))
    return F.aggregate(bits, F.lit(0), lambda acc, x: acc + x)


def binary_quantize(v: Column) -> Column:
    """Bytes of sign bits, 1 where a value is at least 0, the first value in the lowest bit."""
    at = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / 8).cast("int") - 1, F.lit(0)))
    bit = lambda b, j: F.when(F.coalesce(F.get(v, b * 8 + F.lit(j)), F.lit(-1.0)) >= 0, F.lit(1 << j)).otherwise(F.lit(0))
    packed = F.transform(at, lambda b: sum((bit(b, j) for j in range(1, 8)), bit(b, 0)))
    return F.when(F.size(v) > 0, packed).otherwise(F.array().cast("array<int>"))


def binary_similarity(a: Column, b: Column, dim: int) -> Column:
    """Share of equal sign bits; 1 for dimension 0."""
    return F.lit(1.0) if dim == 0 else (F.lit(dim) - hamming(a, b)) / F.lit(float(dim))


def scalar_range(v: Column) -> Column:
    """(low, high) of a vector; (0, 1) for a constant or empty one."""
    low, high = F.array_min(_doubles(v)), F.array_max(_doubles(v))
    varies = F.coalesce(low < high, F.lit(False))
    return F.struct(F.when(varies, low).otherwise(F.lit(0.0)).alias("low"), F.when(varies, high).otherwise(F.lit(1.0)).alias("high"))


def scalar_quantize(v: Column, low: Column, high: Column) -> Column:
    """Bytes 0 to 255, cut off and not rounded."""
    return F.transform(_doubles(v), lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x - low) / (high - low) * 255).cast("int"))))


def scalar_dequantize(q: Column, low: Column, high: Column) -> Column:
    return F.transform(q, lambda x: low + x / F.lit(255.0) * (high - low))
