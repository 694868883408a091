"""Partitions of a base, live rows, renumbering and compaction of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: Weights of the splits; the last one takes what is left.
STRATEGIES = {
    "UNIFORM": lambda n: [1] * n,
    "FIBONACCI": lambda n: _fibonacci(n),
    "LOG2N": lambda n: [2**i for i in range(n)],
    "TIERED_10_90": lambda n: _tiered(n, 0.10),
    "TIERED_1_99": lambda n: _tiered(n, 0.01),
}


def _fibonacci(n: int) -> list[float]:
    a, b, out = 1, 2, []
    for _ in range(n):
        out.append(a)
        a, b = b, a + b
    return out


def _tiered(n: int, share: float) -> list[float]:
    """All but the last split share a small part evenly."""
    return [1] if n == 1 else [share / (n - 1)] * (n - 1) + [1 - share]


def bounds(total: int, n: int, strategy: str) -> list[int]:
    """Ends of n contiguous splits of ``total`` rows."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if not 1 <= n <= max(1, total):
        raise ValueError(f"{n} splits of {total} rows")
    weights = STRATEGIES[strategy](n)
    out, done = [], 0
    for w in weights[:-1]:
        done += int(total * w / sum(weights))
        out.append(done)
    return [*out, total]


def numbered(rows: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """``ord``: place by id, from 0, without gaps.

    Rows are ranged by id over partitions, once: the ranged rows are written with
    their part and their place in it.  The sums of the parts before are added, so no
    task sees all rows.
    """
    ranged = rows.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col)
    # a number that starts again in each partition, above the partition's own
    at = F.monotonically_increasing_id()
    local = staged(ranged.withColumn("_at", at), "numbered").withColumn("_part", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND(F.lit(2**33 - 1)))
    counts = local.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return local.join(before, "_part").withColumn("ord", (F.col("_before") + F.col("_place")).cast("long")).drop("_at", "_part", "_place", "_before")


def partitioned(rows: DataFrame, n: int, strategy: str, id_col: str = "vec_id") -> DataFrame:
    """``segment`` of each row: contiguous splits in order of id."""
    ordered = numbered(rows, id_col)
    column = F.lit(n - 1)
    for i, end in reversed(list(enumerate(bounds(rows.count(), n, strategy)))):
        column = F.when(F.col("ord") < end, i).otherwise(column)
    return ordered.withColumn("segment", column)


def live(rows: DataFrame, tombstones: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return rows.join(tombstones.select(id_col).distinct(), id_col, "left_anti")


def validate(sources: list[DataFrame], dims: list[int], features: list[frozenset]) -> None:
    """What merging segments asks for."""
    if len(sources) < 2:
        raise ValueError("compaction needs two sources at least")
    if not len(sources) == len(dims) == len(features):
        raise ValueError("each source needs a dimension and a set of features")
    if len(set(dims)) > 1:
        raise ValueError(f"sources of different dimensions {sorted(set(dims))}")
    if len(set(features)) > 1:
        raise ValueError("sources with different features")
    if "embedding" not in features[0]:
        raise ValueError("compaction needs the full vectors")


def compact(sources: list[DataFrame], tombstones: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Live rows of all sources under new ids without gaps, by source and old id: (source, old_id, vec_id, other columns).

    Sources with vectors must have them of one dimension.
    """
    if all(vec_col in s.columns for s in sources):
        sizes = [s.filter(F.col(vec_col).isNotNull()).select(F.size(vec_col)).limit(1).collect() for s in sources]
        known = [d[0][0] for d in sizes if d]
        validate(sources, known[:1] * len(sources) if len(set(known)) < 2 else known + known[:1] * (len(sources) - len(known)), [frozenset(s.columns) & {vec_col} for s in sources])
    out = None
    for i, s in enumerate(sources):
        part = s.withColumn("source", F.lit(i))
        out = part if out is None else out.unionByName(part)
    if tombstones is not None:
        keys = [c for c in ("source", id_col) if c in tombstones.columns]
        out = out.join(tombstones.select(*keys).distinct(), keys, "left_anti")
    ordered = numbered(out.withColumn("_key", F.struct("source", id_col)), "_key").drop("_key")
    return ordered.withColumn("old_id", F.col(id_col)).withColumn(id_col, F.col("ord")).drop("ord")


def remapped(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Neighbour lists under new ids; mapping has old_id and new_id, null new ids are left out.  Lists keep their order."""
    flat = edges.select("node", F.posexplode("neighbors").alias("place", "old_id")).join(mapping, "old_id").filter("new_id is not null")
    lists = flat.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "new_id"))).alias("x"))
    own = mapping.select(F.col("old_id").alias("node"), F.col("new_id").alias("new_node")).filter("new_node is not null")
    return edges.select("node").join(own, "node").join(lists, "node", "left").select(F.col("new_node").alias("node"), F.coalesce(F.col("x.new_id"), F.array().cast("array<long>")).alias("neighbors"))
