"""Vector arithmetic and similarity scores as Column expressions.

All arithmetic is in double precision and left to right, so that scores agree
with a plain SQL engine bit by bit.  A score is higher for more similar vectors
and lies between 0 and 1: for the dot product, of unit vectors only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "dot", "cosine")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def part(v: Column, offset: int, length: int) -> Column:
    """``length`` elements from ``offset`` on, counted from 0."""
    return F.slice(v, offset + 1, length)


def total(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x)


def _same_size(a: Column, b: Column, value: Column) -> Column:
    problem = F.concat(F.lit("vectors of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" dimensions"))
    return F.when(F.size(a) == F.size(b), value).when(a.isNull() | b.isNull(), None).otherwise(F.raise_error(problem).cast("double"))


def _zip(a: Column, b: Column, f) -> Column:
    return F.zip_with(doubles(a), doubles(b), f)


def dot(a: Column, b: Column, checked: bool = False) -> Column:
    value = total(_zip(a, b, lambda x, y: x * y))
    return _same_size(a, b, value) if checked else value


def square_l2(a: Column, b: Column, checked: bool = False) -> Column:
    value = total(_zip(a, b, lambda x, y: (x - y) * (x - y)))
    return _same_size(a, b, value) if checked else value


def norm2(v: Column) -> Column:
    return dot(v, v)


def cosine(a: Column, b: Column, checked: bool = False) -> Column:
    """NaN if either vector is zero."""
    value = F.when((norm2(a) == 0) | (norm2(b) == 0), float("nan")).otherwise(F.try_divide(dot(a, b), F.sqrt(norm2(a) * norm2(b))))
    return _same_size(a, b, value) if checked else value


def score(metric: str, a: Column, b: Column, checked: bool = False) -> Column:
    """Similarity under ``l2``, ``dot`` or ``cosine``."""
    if metric == "l2":
        return 1 / (1 + square_l2(a, b, checked))
    if metric == "dot":
        return (1 + dot(a, b, checked)) / 2
    if metric == "cosine":
        return (1 + cosine(a, b, checked)) / 2
    raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")


def l2_normalized(v: Column) -> Column:
    """Unit vector; an error for the zero vector."""
    length = F.sqrt(norm2(v))
    return F.when(length > 0, F.transform(doubles(v), lambda x: x / length)).when(v.isNull(), None).otherwise(F.raise_error(F.lit("a zero vector has no direction")).cast("array<double>"))


def scaled(v: Column, k) -> Column:
    return F.transform(doubles(v), lambda x: x * k)


def added(a: Column, b) -> Column:
    return _zip(a, b, lambda x, y: x + y) if isinstance(b, Column) else F.transform(doubles(a), lambda x: x + b)


def subtracted(a: Column, b) -> Column:
    return _zip(a, b, lambda x, y: x - y) if isinstance(b, Column) else F.transform(doubles(a), lambda x: x - b)


def minimum(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: F.least(x, y))


def largest(v: Column) -> Column:
    return F.array_max(doubles(v))


def smallest(v: Column) -> Column:
    return F.array_min(doubles(v))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def sign_words(v: Column, dim: int) -> Column:
    """Bit j of word i is set if element 64 * i + j is positive."""
    def word(i: int) -> Column:
        bits = F.transform(F.slice(v, 64 * i + 1, min(64, dim - 64 * i)), lambda x, j: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), j)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))

    return F.array(*(word(i) for i in range(-(-dim // 64))))


def lookup_sum(codes: Column, table: Column, k: int) -> Column:
    """Sum over subspaces m of table[m * k + codes[m]]: the score of a code against a query's table."""
    return F.aggregate(F.transform(codes, lambda c, m: F.get(table, (m * k + c).cast("int"))), F.lit(0.0), lambda s, x: s + x)


def triangle_index(a: Column, b: Column, k: int) -> Column:
    """Place of the unordered pair of codes in a triangular table of k rows."""
    low, high = F.least(a, b), F.greatest(a, b)
    return low * k - (low * (low - 1) / 2).cast("int") + (high - low)
