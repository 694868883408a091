"""Vector files: records of a little-endian 32-bit length and so many 32-bit values.

fvecs files hold float32 vectors, ivecs files int32 neighbour ids.  Files are read
by Spark, in any store it knows; a file is cut at record boundaries into parts
that are parsed as one numpy array each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable

MAX_DIM = 100_000


def parse(data: bytes, kind: str) -> np.ndarray:
    """All records of a file as a matrix; an error for a length out of range, or one that differs, or a file cut short."""
    if not data:
        return np.zeros((0, 0), dtype=kind)
    (dim,) = struct.unpack_from("<i", data)
    if not 0 < dim <= MAX_DIM:
        raise ValueError(f"a record of {dim} values")
    if len(data) % (4 * (dim + 1)):
        raise ValueError("the file ends within a record")
    words = np.frombuffer(data, dtype="<i4").reshape(-1, dim + 1)
    if (words[:, 0] != dim).any():
        raise ValueError("records of different lengths")
    return np.ascontiguousarray(words[:, 1:]).view(kind)


def _read(spark: SparkSession, path: str, kind: str, column: str) -> DataFrame:
    item = "float" if kind == "<f4" else "int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = parse(content.as_py(), kind)
                for start in range(0, len(rows), 8192):
                    part = rows[start : start + 8192]
                    offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(part))), pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], names=["vec_id", column])

    return importable(spark).read.format("binaryFile").load(path).select("content").mapInArrow(run, f"vec_id long, {column} array<{item}>")


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding): ids count from 0 within each file."""
    return _read(spark, path, "<f4", "embedding")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, neighbors): ids count from 0 within each file."""
    return _read(spark, path, "<i4", "neighbors")


def pack(rows: list[list[float]] | np.ndarray, kind: str) -> bytes:
    """Records of one file; kind is ``<f4`` or ``<i4``."""
    return b"".join(struct.pack("<i", len(r)) + np.asarray(r, dtype=kind).tobytes() for r in rows)


def ground_truth(ivecs: DataFrame) -> DataFrame:
    """Neighbour lists as (query_id, rank, vec_id)."""
    return ivecs.select(F.col("vec_id").alias("query_id"), F.posexplode("neighbors").alias("place", "vec_id")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("vec_id").cast("long").alias("vec_id"))
