"""Non-uniform quantisation: each part of a vector has its own curve of 256 levels.

The vector less the global mean is cut into parts.  A part is mapped by a
logistic curve, whose growth rate is searched for the least squared error, onto 0
to 255.  The curve is the piecewise linear one that takes a number's exponent and
mantissa apart, which is fast and has an exact inverse.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import importable
from . import quantize, search

LEVELS = 255


def logistic(x: np.ndarray, rate: np.ndarray, middle: np.ndarray | float = 0.0) -> np.ndarray:
    """2**y / (1 + 2**y) with 2**y taken linear between powers of two."""
    y = rate * (x - middle)
    whole = np.floor(y)
    power = np.ldexp(1.0 + (y - whole), np.clip(whole, -1000, 1000).astype(np.int64))
    return power / (1 + power)


def logit(p: np.ndarray, rate: np.ndarray, middle: np.ndarray | float = 0.0) -> np.ndarray:
    """Inverse of ``logistic``."""
    p = np.clip(p, 1e-300, 1 - 1e-16)
    mantissa, exponent = np.frexp(p / (1 - p))
    return (exponent - 1 + 2 * mantissa - 1) / rate + middle


def levels(x: np.ndarray, rate: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Level of each element of parts (rows); a part of one value only is at level 0."""
    a, b = logistic(low, rate), logistic(high, rate)
    span = np.where(b > a, b - a, 1.0)
    return np.clip(np.rint((logistic(x, rate) - a) / span * LEVELS), 0, LEVELS)


def values(q: np.ndarray, rate: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    a, b = logistic(low, rate), logistic(high, rate)
    return np.where(b > a, logit(a + q / LEVELS * (b - a), rate), low)


def loss(x: np.ndarray, rate: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared error of each part."""
    return ((x - values(levels(x, rate, low, high), rate, low, high)) ** 2).sum(axis=1)


def uniform_loss(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared error of each part with evenly spaced levels."""
    span = np.where(high > low, high - low, 1.0)
    return ((x - (low + np.rint((x - low) / span * LEVELS) / LEVELS * span)) ** 2).sum(axis=1)


def best_rates(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Growth rate of each part: a coarse search in steps of one up to 20, then in tenths around the best.

    Rates are for parts scaled to a span of one; a part without a span has rate one.
    """
    span = np.where(high > low, high - low, 1.0)
    best, least = np.full((len(x), 1), 1.0), np.full(len(x), np.inf)

    def consider(rate: np.ndarray) -> None:
        nonlocal best, least
        now = loss(x, rate / span, low, high)
        better = now < least
        best[better] = rate[better]
        least = np.where(better, now, least)

    for r in np.arange(1e-6, 20, 1.0):
        consider(np.full((len(x), 1), r))
    coarse = best.copy()
    for d in np.arange(-0.9, 1.0, 0.1):
        consider(np.maximum(1e-6, coarse + d))
    return best / span


@dataclass
class NonUniformQuantizer:
    mean: np.ndarray
    m: int

    @classmethod
    def train(cls, points: np.ndarray, m: int = 1) -> NonUniformQuantizer:
        return cls(points.mean(axis=0), m)

    def encode(self, points: np.ndarray) -> list[dict[str, np.ndarray]]:
        """For each part: levels, growth rate, least and largest value."""
        out = []
        for a, s in quantize.subspaces(len(self.mean), self.m):
            x = points[:, a : a + s] - self.mean[a : a + s]
            low, high = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
            rate = best_rates(x, low, high)
            out.append({"levels": levels(x, rate, low, high).astype(np.uint8), "rate": rate[:, 0], "low": low[:, 0], "high": high[:, 0]})
        return out

    def decode(self, parts: list[dict[str, np.ndarray]]) -> np.ndarray:
        return np.concatenate([values(p["levels"].astype(float), p["rate"][:, None], p["low"][:, None], p["high"][:, None]) for p in parts], axis=1) + self.mean

    def scores(self, queries: np.ndarray, parts: list[dict[str, np.ndarray]], metric: str) -> np.ndarray:
        """Scores of each query with each code, part by part; no decoded vector is put together.

        What a part gives to a product, a length or a distance is taken from its
        own levels, moved by the mean where the metric asks for it.
        """
        product = np.zeros((len(queries), len(parts[0]["rate"])))
        length2 = np.zeros(product.shape[1])
        away = np.zeros_like(product)
        for (a, s), p in zip(quantize.subspaces(len(self.mean), self.m), parts):
            x = values(p["levels"].astype(float), p["rate"][:, None], p["low"][:, None], p["high"][:, None])
            q, mean = queries[:, a : a + s], self.mean[a : a + s]
            if metric == "l2":
                moved = q - mean
                away += (moved * moved).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * moved @ x.T
            else:
                product += q @ x.T + (q @ mean)[:, None]
                length2 += ((x + mean) ** 2).sum(axis=1)
        if metric == "l2":
            return 1 / (1 + np.maximum(0, away))
        if metric == "dot":
            return (1 + product) / 2
        with np.errstate(invalid="ignore", divide="ignore"):
            return (1 + product / np.sqrt((queries * queries).sum(axis=1)[:, None] * length2[None])) / 2

    def errors(self, points: np.ndarray) -> np.ndarray:
        return ((points - self.decode(self.encode(points))) ** 2).mean(axis=1)

    def loss_ratio(self, points: np.ndarray) -> np.ndarray:
        """Loss of even levels over that of the curves; over one means that the curves are better."""
        even = own = 0.0
        for a, s in quantize.subspaces(len(self.mean), self.m):
            x = points[:, a : a + s] - self.mean[a : a + s]
            low, high = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
            even = even + uniform_loss(x, low, high)
            own = own + loss(x, best_rates(x, low, high), low, high)
        return even / np.maximum(own, 1e-300)


PART = T.StructType([T.StructField("levels", T.BinaryType()), T.StructField("rate", T.DoubleType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
ENCODED = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("parts", T.ArrayType(PART)), T.StructField("error", T.DoubleType()), T.StructField("loss_ratio", T.DoubleType())])


def nvq_encode(vectors: DataFrame, codec: NonUniformQuantizer, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Parts of each vector with the mean squared error per dimension, and the gain over even levels."""
    shared = importable(vectors.sparkSession).sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
                x = search.matrix(batch.column("v"))
                parts = own.encode(x)
                rows = [[{"levels": p["levels"][i].tobytes(), "rate": p["rate"][i], "low": p["low"][i], "high": p["high"][i]} for p in parts] for i in range(len(x))]
                error = ((x - own.decode(parts)) ** 2).mean(axis=1)
                kind = pa.list_(pa.struct([("levels", pa.binary()), ("rate", pa.float64()), ("low", pa.float64()), ("high", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(rows, kind), pa.array(error), pa.array(own.loss_ratio(x))], names=ENCODED.fieldNames())

    return vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v")).filter("v is not null").mapInArrow(run, ENCODED)


def unpack(parts: list[list[dict]]) -> list[dict[str, np.ndarray]]:
    """Column of parts, as read from a table, in the form that ``decode`` takes."""
    out = []
    for j in range(len(parts[0]) if parts else 0):
        column = [p[j] for p in parts]
        out.append({"levels": np.stack([np.frombuffer(c["levels"], dtype=np.uint8) for c in column])} | {n: np.array([c[n] for c in column]) for n in ("rate", "low", "high")})
    return out


def nvq_decode(encoded: DataFrame, codec: NonUniformQuantizer) -> DataFrame:
    """Vectors again, as (vec_id, embedding), for the second pass of a search."""
    shared = importable(encoded.sparkSession).sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = shared.value.decode(unpack(batch.column("parts").to_pylist())).astype(np.float32)
                flat, offsets = pa.array(x.ravel()), pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(offsets, flat)], names=["vec_id", "embedding"])

    return encoded.select("vec_id", "parts").mapInArrow(run, "vec_id long, embedding array<float>")


def nvq_search(encoded: DataFrame, queries: DataFrame, codec: NonUniformQuantizer, k: int | None, metric: str = "cosine", exclude_self: bool = True, threshold: float | None = None, block_bytes: int = search.BLOCK_BYTES) -> DataFrame:
    """The k best by the scores of the codes themselves, as (query_id, rank, vec_id, score)."""
    blocks = ((ids, (codec, q.astype(np.float64))) for ids, q in search.query_blocks(queries, "vec_id", "embedding", block_bytes))
    found = search.scan(encoded.select("vec_id", "parts"), blocks, lambda batch: unpack(batch.column("parts").to_pylist()), lambda q, parts: q[0].scores(q[1], parts, metric), None, k, threshold, exclude_self)
    return search.ranked(found, k)
