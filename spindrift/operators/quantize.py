"""Product, binary and non-uniform quantisation of vectors.

Codebooks are small and fixed in size, so they are Python objects that go to
every task; codes are columns.  Encoding streams over the base in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..session import importable
from . import kmeans, search

MAX_TRAINING = 128_000


def subspaces(dim: int, m: int) -> list[tuple[int, int]]:
    """Offset and size of each subspace; the first ones take the remainder."""
    if not 1 <= m <= dim:
        raise ValueError(f"{m} subspaces of {dim} dimensions")
    sizes = [dim // m + (i < dim % m) for i in range(m)]
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def sample(vectors: DataFrame, n: int = MAX_TRAINING, id_col: str = "vec_id", vec_col: str = "embedding") -> np.ndarray:
    """At most n vectors, those whose ids hash lowest: the same ones each time."""
    rows = vectors.select(F.col(id_col).alias("i"), F.col(vec_col).cast("array<float>").alias("v")).filter("v is not null").orderBy(F.xxhash64("i"), "i").limit(n)
    return search.matrix(rows.select("v").toArrow().column("v").combine_chunks())


def balanced_sample(sources: list[DataFrame], n: int = MAX_TRAINING, least: int = 1000, id_col: str = "vec_id") -> DataFrame:
    """A sample for retraining over several sources: by size, but at least ``least`` of each, n in all."""
    counts = [s.count() for s in sources]
    quotas = [min(c, max(least, n * c // max(1, sum(counts)))) for c in counts]
    while sum(quotas) > n:
        quotas[quotas.index(max(quotas))] -= sum(quotas) - n
    out = None
    for s, q in zip(sources, quotas):
        part = s.orderBy(F.xxhash64(id_col), id_col).limit(max(0, q))
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class ProductQuantizer:
    """A codebook of k centroids for each of m subspaces."""

    dim: int
    codebooks: list[np.ndarray]
    center: np.ndarray | None = None
    weight: float = 1.0
    parts: list[tuple[int, int]] = field(init=False)

    def __post_init__(self) -> None:
        self.parts = subspaces(self.dim, len(self.codebooks))

    @property
    def m(self) -> int:
        return len(self.codebooks)

    @property
    def k(self) -> int:
        return len(self.codebooks[0])

    @classmethod
    def train(cls, points: np.ndarray, m: int, k: int = 256, center: bool = False, rounds: int = 6, seed: int = 0, threshold: float = -1.0) -> ProductQuantizer:
        """k-means in each subspace.  threshold above -1: errors along the vector weigh more, for vectors that score that high."""
        if not 1 <= k <= 256:
            raise ValueError("a code is one byte: k must be 1 to 256")
        middle = points.mean(axis=0) if center else None
        moved = points - middle if center else points
        dim = points.shape[1]
        weight = kmeans.parallel_cost(threshold, dim)
        books = [kmeans.fit(moved[:, a : a + s], k, rounds, seed + i, weight=weight) for i, (a, s) in enumerate(subspaces(dim, m))]
        return cls(dim, books, middle, weight)

    @classmethod
    def from_vectors(cls, points: np.ndarray, m: int) -> ProductQuantizer:
        """A codebook whose centroids are the parts of the given vectors themselves."""
        return cls(points.shape[1], [points[:, a : a + s].astype(np.float64) for a, s in subspaces(points.shape[1], m)])

    def refine(self, points: np.ndarray, rounds: int = 1, seed: int = 0) -> ProductQuantizer:
        moved = points - self.center if self.center is not None else points
        books = [kmeans.fit(moved[:, a : a + s], self.k, rounds, seed + i, start=b, weight=self.weight) for i, ((a, s), b) in enumerate(zip(self.parts, self.codebooks))]
        return ProductQuantizer(self.dim, books, self.center, self.weight)

    def encode(self, points: np.ndarray) -> np.ndarray:
        """Codes, one byte for each subspace; the first of equally near centroids."""
        moved = points - self.center if self.center is not None else points
        if self.weight != 1.0:
            return self._encode_weighted(moved)
        # differences, not products: ties are then exact
        out = np.empty((len(points), self.m), dtype=np.uint8)
        for i, ((a, s), book) in enumerate(zip(self.parts, self.codebooks)):
            for start in range(0, len(points), 1024):
                away = np.zeros((len(moved[start : start + 1024]), len(book)))
                for d in range(s):  # one dimension after the other, as a plain sum goes
                    away += (moved[start : start + 1024, a + d, None] - book[None, :, d]) ** 2
                out[start : start + 1024, i] = np.argmin(away, axis=1)
        return out

    def _encode_weighted(self, points: np.ndarray, rounds: int = 10) -> np.ndarray:
        """Coordinate descent over the subspaces: each takes the centroid with the least loss given the others."""
        codes = ProductQuantizer(self.dim, self.codebooks).encode(points)
        length = np.maximum(1e-12, np.sqrt((points**2).sum(axis=1)))
        unit = points / length[:, None]
        square = [((points[:, None, a : a + s] - b[None]) ** 2).sum(axis=2) for (a, s), b in zip(self.parts, self.codebooks)]
        along = [np.einsum("ijk,ik->ij", points[:, None, a : a + s] - b[None], unit[:, a : a + s]) for (a, s), b in zip(self.parts, self.codebooks)]
        rows = np.arange(len(points))
        for _ in range(rounds):
            changed = False
            for i in range(self.m):
                rest = sum(along[j][rows, codes[:, j]] for j in range(self.m) if j != i)
                loss = square[i] + (self.weight - 1) * (along[i] + (rest[:, None] if self.m > 1 else 0)) ** 2
                best = np.argmin(loss, axis=1).astype(np.uint8)
                better = loss[rows, best] < loss[rows, codes[:, i]] - 1e-15
                changed |= bool(better.any())
                codes[better, i] = best[better]
            if not changed:
                break
        return codes

    def decode(self, codes: np.ndarray, centered: bool = False) -> np.ndarray:
        out = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.codebooks)], axis=1)
        return out if centered or self.center is None else out + self.center

    def errors(self, points: np.ndarray) -> np.ndarray:
        """Mean squared error of each vector, per dimension."""
        return ((points - self.decode(self.encode(points))) ** 2).mean(axis=1)

    def mean(self) -> np.ndarray:
        """The stored centre, or else the mean of all combinations of centroids."""
        return self.center if self.center is not None else np.concatenate([b.mean(axis=0) for b in self.codebooks])

    def table(self, query: np.ndarray, metric: str) -> np.ndarray:
        """Partial sums of a query with every centroid, k for each subspace."""
        return self.tables(query[None], metric)[0]

    def tables(self, queries: np.ndarray, metric: str) -> np.ndarray:
        """Partial sums of each query, a row each."""
        if metric not in ("l2", "dot"):
            raise ValueError("partial sums are for l2 and dot")
        moved = queries - self.center if self.center is not None and metric == "l2" else queries
        rows = []
        for (a, s), b in zip(self.parts, self.codebooks):
            total = np.zeros((len(queries), len(b)))
            for d in range(s):
                total += (moved[:, a + d, None] - b[None, :, d]) ** 2 if metric == "l2" else moved[:, a + d, None] * b[None, :, d]
            rows.append(total)
        return np.concatenate(rows, axis=1)

    def looked_up(self, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Sums of the values that each code has in each query's table."""
        total = np.zeros((len(tables), len(codes)))
        for m in range(self.m):
            total += tables[:, m * self.k + codes[:, m].astype(np.int64)]
        return total

    def scores(self, queries: np.ndarray, codes: np.ndarray, metric: str, tables: np.ndarray | None = None) -> np.ndarray:
        """Approximate scores of each query with each code."""
        tables = self.tables(queries, "l2" if metric == "l2" else "dot") if tables is None else tables
        total = self.looked_up(tables, codes)
        if metric == "l2":
            return 1 / (1 + total)
        if metric == "dot":
            return (1 + total) / 2
        length2 = self.looked_up(self.magnitudes()[None], codes)[0]
        with np.errstate(invalid="ignore", divide="ignore"):
            return (1 + total / np.sqrt(length2[None] * self._sum(queries, queries)[:, None])) / 2

    def magnitudes(self) -> np.ndarray:
        """Squared length of every centroid, k for each subspace."""
        return np.concatenate([self._sum(b, b) for b in self.codebooks])

    @staticmethod
    def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a))
        for d in range(a.shape[1]):
            total += a[:, d] * b[:, d]
        return total

    def pair_tables(self, metric: str) -> list[np.ndarray]:
        """Partial sums of every pair of centroids, a table of k by k for each subspace."""
        if metric == "l2":
            return [((b[:, None] - b[None]) ** 2).sum(axis=2) for b in self.codebooks]
        return [(b[:, None] * b[None]).sum(axis=2) for b in self.codebooks]

    def code_scores(self, left: np.ndarray, right: np.ndarray, metric: str, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """Scores of each code with each other code."""
        tables = self.pair_tables("l2" if metric == "l2" else "dot") if tables is None else tables
        total = np.zeros((len(left), len(right)))
        for m, t in enumerate(tables):
            total += t[left[:, m, None], right[None, :, m]]
        if metric == "l2":
            return 1 / (1 + total)
        if metric == "dot":
            return (1 + total) / 2
        own = [sum(t[c[:, m], c[:, m]] for m, t in enumerate(tables)) for c in (left, right)]
        with np.errstate(invalid="ignore", divide="ignore"):
            return (1 + total / np.sqrt(own[0][:, None] * own[1][None])) / 2

    def sizes(self) -> dict[str, int]:
        """Bytes of a vector, of its code, and of the codebooks as 32-bit numbers."""
        return {"vector": 4 * self.dim, "code": self.m, "codec": 4 * self.dim * self.k + (4 * self.dim if self.center is not None else 0)}


CODES = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("codes", T.ArrayType(T.IntegerType()))])


def pq_encode(vectors: DataFrame, codec: ProductQuantizer, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Codes of each vector, as (vec_id, codes); null vectors are left out."""
    shared = importable(vectors.sparkSession).sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = shared.value.encode(search.matrix(batch.column("v"))).astype(np.int32)
            flat = pa.array(codes.ravel())
            offsets = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.ListArray.from_arrays(offsets, flat)], names=CODES.fieldNames())

    return vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v")).filter("v is not null").mapInArrow(run, CODES)


def codebook_rows(spark: SparkSession, codec: ProductQuantizer) -> DataFrame:
    """The codebook as a table (m, c, centroid)."""
    return spark.createDataFrame([(m, c, [float(x) for x in v]) for m, b in enumerate(codec.codebooks) for c, v in enumerate(b)], "m int, c int, centroid array<double>")


def from_rows(rows: DataFrame, center: np.ndarray | None = None, weight: float = 1.0) -> ProductQuantizer:
    """The codec whose codebook a table (m, c, centroid) holds, as ``codebook_rows`` gives it."""
    books: dict[int, dict[int, list[float]]] = {}
    for r in rows.toLocalIterator():  # k centroids of the length of a vector in all
        books.setdefault(r.m, {})[r.c] = r.centroid
    parts = [np.array([books[m][c] for c in range(len(books[m]))], dtype=np.float64) for m in range(len(books))]
    return ProductQuantizer(sum(p.shape[1] for p in parts), parts, center, weight)


DECODED = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("decoded", T.ArrayType(T.DoubleType()))])


def lists(rows: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def code_matrix(batch: pa.RecordBatch) -> np.ndarray:
    return search.matrix(batch.column("codes")).astype(np.int64)


def pq_decode(codes: DataFrame, codec: ProductQuantizer) -> DataFrame:
    """Vectors again: centroids of the codes in order, and the centre added if there is one."""
    shared = importable(codes.sparkSession).sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists(shared.value.decode(code_matrix(batch)))], names=DECODED.fieldNames())

    return codes.select("vec_id", "codes").mapInArrow(run, DECODED)


TABLES = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("query2", T.DoubleType())])


def query_tables(queries: DataFrame, codec: ProductQuantizer, metric: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each query its table of partial sums, and its squared length."""
    shared = importable(queries.sparkSession).sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = search.matrix(batch.column("v"))
                sums = shared.value.tables(q, "l2" if metric == "l2" else "dot")
                yield pa.RecordBatch.from_arrays([batch.column("i"), lists(sums), pa.array(shared.value._sum(q, q))], names=TABLES.fieldNames())

    return queries.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v")).filter("v is not null").mapInArrow(run, TABLES)


def pq_search(codes: DataFrame, queries: DataFrame, codec: ProductQuantizer, k: int | None, metric: str = "cosine", exclude_self: bool = True, threshold: float | None = None, block_bytes: int = search.BLOCK_BYTES) -> DataFrame:
    """The k best by approximate score: sums of values looked up in the queries' tables, a block of queries at a time.

    Codes are scored where they are, each task keeps its best, and these meet in
    the ranking.  k None: all, or all that reach the threshold.
    """
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    # a query's table has m * k numbers beside the query itself
    room = max(1, block_bytes // max(1, 1 + codec.m * codec.k // codec.dim))

    def blocks() -> Iterator[tuple[np.ndarray, object]]:
        for ids, q in search.query_blocks(queries, "vec_id", "embedding", room):
            q = q.astype(np.float64)
            yield ids, (codec, q, codec.tables(q, "l2" if metric == "l2" else "dot"))

    found = search.scan(codes.select("vec_id", "codes"), blocks(), code_matrix, lambda q, c: q[0].scores(q[1], c, metric, q[2]), None, k, threshold, exclude_self)
    return search.ranked(found, k)


def pq_code_scores(left: DataFrame, right: DataFrame, codec: ProductQuantizer, metric: str, block_bytes: int = search.BLOCK_BYTES) -> DataFrame:
    """Scores of code against code, as (query_id, vec_id, score): each row of ``left``, in blocks, with each other row of ``right``."""
    tables = codec.pair_tables("l2" if metric == "l2" else "dot")
    blocks = ((ids, (codec, tables, c.astype(np.int64))) for ids, c in search.query_blocks(left, "vec_id", "codes", block_bytes))
    return search.scan(right.select("vec_id", "codes"), blocks, code_matrix, lambda q, c: q[0].code_scores(q[2], c, metric, q[1]))


def pq_pair_scores(left: DataFrame, right: DataFrame, codec: ProductQuantizer, metric: str, block_bytes: int = search.BLOCK_BYTES) -> DataFrame:
    """Scores of the pairs a of ``left`` and b of ``right`` with a < b."""
    return pq_code_scores(left, right, codec, metric, block_bytes).filter("query_id < vec_id").select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), "score")


# binary


def bq_encode(vectors: DataFrame, dim: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), V.sign_words(F.col(vec_col), dim).alias("words"))


def bq_scores(codes: DataFrame, queries: DataFrame, dim: int, k: int | None = None, exclude_self: bool = True, block_bytes: int = search.BLOCK_BYTES) -> DataFrame:
    """Scores ``1 - distance / dim`` by Hamming distance for blocks of queries, which are codes too; all, or the k best that a task meets."""

    def words(column: pa.Array) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.astype(np.int64).reshape(len(column), -1)

    def rough(q: np.ndarray, b: np.ndarray) -> np.ndarray:
        away = np.zeros((len(q), len(b)), dtype=np.int64)
        for w in range(q.shape[1]):
            away += np.bitwise_count((q[:, w, None] ^ b[None, :, w]).view(np.uint64))
        return 1 - away / dim

    return search.scan(codes.select("vec_id", "words"), search.query_blocks(queries, "vec_id", "words", block_bytes), lambda batch: words(batch.column("words")), rough, None, k, None, exclude_self)


def bq_search(codes: DataFrame, queries: DataFrame, dim: int, k: int, exclude_self: bool = True, block_bytes: int = search.BLOCK_BYTES) -> DataFrame:
    """The k nearest by Hamming distance, ranked."""
    return search.ranked(bq_scores(codes, queries, dim, k, exclude_self, block_bytes), k)


def bq_error(vec: Column) -> Column:
    """Mean squared difference between a vector and its bits as 0 and 1."""
    return V.total(F.transform(V.doubles(vec), lambda x: F.when(x > 0, (x - 1) * (x - 1)).otherwise(x * x))) / F.size(vec)
