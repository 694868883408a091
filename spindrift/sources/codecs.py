"""Codecs as tables, so that codes can be read by whoever comes later.

A table has rows (kind, part, place, numbers): a head with the settings, and the
centroids of a product codec or the mean of a non-uniform one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.nvq import NonUniformQuantizer
from ..operators.quantize import ProductQuantizer

SCHEMA = "kind string, part int, place int, numbers array<double>"
HEAD, CENTER = -1, -2


@dataclass(frozen=True)
class BinaryCodec:
    """Signs of so many dimensions; there is nothing more to know."""

    dim: int


def save(spark: SparkSession, codec: ProductQuantizer | NonUniformQuantizer | BinaryCodec) -> DataFrame:
    """A codec as a table."""
    plain = lambda v: [float(x) for x in v]
    if isinstance(codec, ProductQuantizer):
        rows = [("product", HEAD, 0, [float(codec.dim), float(codec.weight)])]
        rows += [("product", m, c, plain(v)) for m, book in enumerate(codec.codebooks) for c, v in enumerate(book)]
        rows += [("product", CENTER, 0, plain(codec.center))] if codec.center is not None else []
    elif isinstance(codec, NonUniformQuantizer):
        rows = [("non-uniform", HEAD, 0, [float(codec.m)]), ("non-uniform", CENTER, 0, plain(codec.mean))]
    elif isinstance(codec, BinaryCodec):
        rows = [("binary", HEAD, 0, [float(codec.dim)])]
    else:
        raise TypeError(f"no codec: {type(codec).__name__}")
    return spark.createDataFrame(rows, SCHEMA)


def load(table: DataFrame) -> ProductQuantizer | NonUniformQuantizer | BinaryCodec:
    """The codec of a table; its size is that of the codec, whatever the number of vectors."""
    parts: dict[int, dict[int, list[float]]] = {}
    kinds = set()
    for r in table.select("kind", "part", "place", "numbers").toLocalIterator():
        kinds.add(r.kind)
        parts.setdefault(r.part, {})[r.place] = r.numbers
    if len(kinds) != 1 or HEAD not in parts:
        raise ValueError("not the table of one codec")
    kind, head = kinds.pop(), parts[HEAD][0]
    center = np.array(parts[CENTER][0]) if CENTER in parts else None
    if kind == "binary":
        return BinaryCodec(int(head[0]))
    if kind == "non-uniform":
        return NonUniformQuantizer(center, int(head[0]))
    if kind != "product":
        raise ValueError(f"unknown codec {kind!r}")
    books = [np.array([parts[m][c] for c in range(len(parts[m]))]) for m in range(len(parts) - 1 - (center is not None))]
    return ProductQuantizer(int(head[0]), books, center, head[1])
