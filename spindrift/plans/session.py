"""A session with the verbs of a small vector service: create, write, bulk load, optimise, search, memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, quantize, search
from .options import BuildOptions, rerank_k

SCHEMA = "vec_id long, embedding array<float>"


class VectorSession:
    """Vectors under one metric; exact until ``optimize`` builds graphs, which are used from then on.

    Writes after that go to a tail that is searched exactly until the next
    ``optimize``.  Deletions hide rows at once.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.dim = 0

    def create(self, dim: int, metric: str = "cosine", options: BuildOptions = BuildOptions(), segments: int = 1) -> VectorSession:
        if dim < 1 or segments < 1:
            raise ValueError("dimension and number of segments must be positive")
        self.dim, self.metric, self.options, self.segments = dim, metric, options, segments
        self.indexed = self.graph = self.codes = None
        self.tail = self.spark.createDataFrame([], SCHEMA)
        self.deleted = self.spark.createDataFrame([], "vec_id long")
        return self

    def _checked(self, vectors: DataFrame) -> DataFrame:
        if not self.dim:
            raise RuntimeError("create the index first")
        problem = F.concat(F.lit(f"{self.dim} dimensions are wanted, not "), F.size("embedding").cast("string"))
        ok = F.when(F.size("embedding") == self.dim, F.col("embedding")).otherwise(F.raise_error(problem).cast("array<float>"))
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), ok.cast("array<float>").alias("embedding"))

    def write(self, rows: list[tuple[int, list[float]]]) -> None:
        self.bulk_load(self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], SCHEMA))

    def bulk_load(self, vectors: DataFrame) -> None:
        self.tail = self.tail.unionByName(self._checked(vectors))

    def delete(self, ids: DataFrame) -> None:
        self.deleted = self.deleted.unionByName(ids.select(F.col("vec_id").cast("long").alias("vec_id")))

    def rows(self) -> DataFrame:
        all_ = self.tail if self.indexed is None else self.indexed.select("vec_id", "embedding").unionByName(self.tail)
        return all_.join(self.deleted.distinct(), "vec_id", "left_anti")

    def optimize(self) -> None:
        """Build graphs over all live rows, by segment."""
        self.indexed = graph.with_segment(self.rows(), self.segments).persist()
        self.graph = graph.build(self.indexed, self.metric, self.options).persist()
        self.graph.count()
        self.tail = self.spark.createDataFrame([], SCHEMA)
        self.deleted = self.spark.createDataFrame([], "vec_id long")

    def search(self, queries: DataFrame, k: int = 10, overquery: float = 2.0, exclude_self: bool = False) -> DataFrame:
        exact = search.search(self.tail if self.graph is not None else self.rows(), queries, k, self.metric, deleted=self.deleted, exclude_self=exclude_self)
        if self.graph is None:
            return exact
        wide = max(k, rerank_k(k, overquery))
        near = graph.graph_search(self.graph, self.indexed, queries, wide, self.metric, wide, exclude_self=exclude_self, options=self.options)
        near = near.select("query_id", "vec_id", "score").join(self.deleted.distinct(), "vec_id", "left_anti")
        return search.merge([near, exact], k)

    def memory(self) -> dict[str, int]:
        """Bytes of vectors and of neighbour lists, if they were in memory."""
        rows = self.rows().count()
        edges = 0 if self.graph is None else (self.graph.agg(F.sum(F.size("neighbors"))).first()[0] or 0)
        return {"rows": rows, "vectors": 4 * self.dim * rows, "edges": 4 * int(edges)}

    def quantizer(self, m: int, k: int = 256) -> quantize.ProductQuantizer:
        return quantize.ProductQuantizer.train(quantize.sample(self.rows()), m, k, center=self.metric == "l2")
