"""Exact nearest-neighbour search, with filters, thresholds and paging.

Queries are taken in blocks of bounded size that go to every task; the base is
read once a block and never shuffled, but where all pairs are put out.  Base rows and
queries are scored in tiles of bounded size by matrix products, which choose candidates with a margin for rounding; these are
scored again in the order of the score expression, so that results equal those of
plain SQL.  A task keeps the best rows for each query over all its batches, and
only their ids and scores meet in a final ranking.

Where every row is a query, rows are dealt to pairs of blocks instead, and no
vector passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..session import importable

#: Largest block of query vectors that goes to every task; scores that a task computes at once, and for so many queries; rows of a block where all are queries, and of a tile of it.
BLOCK_BYTES, SCORES, ASKING, PART, TILE = 8 << 20, 1 << 18, 256, 8192, 1024
MARGIN = 1e-6


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as a matrix; an error if lengths differ."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of different dimensions")
    return flat.astype(np.float64).reshape(len(sizes), -1)


def block_scores(metric: str, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of all pairs of a block."""
    product = q @ b.T
    if metric == "dot":
        return (1 + product) / 2
    q2, b2 = (q * q).sum(axis=1), (b * b).sum(axis=1)
    if metric == "l2":
        return 1 / (1 + np.maximum(0, q2[:, None] + b2[None] - 2 * product))
    with np.errstate(invalid="ignore", divide="ignore"):
        return (1 + product / np.sqrt(q2[:, None] * b2[None])) / 2


def exact_scores(metric: str, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of row i of one matrix with row i of the other, summed from left to right as the score expression does."""

    def total(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(q))
        for u, v in zip(x, y):
            out += u * v
        return out

    x, y = np.ascontiguousarray(q.T), np.ascontiguousarray(b.T)
    if metric == "l2":
        return 1 / (1 + total(x - y, x - y))
    if metric == "dot":
        return (1 + total(x, y)) / 2
    with np.errstate(invalid="ignore", divide="ignore"):
        return (1 + total(x, y) / np.sqrt(total(x, x) * total(y, y))) / 2


def summed(f: Callable[[np.ndarray, np.ndarray, np.ndarray], object], q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums over the dimensions for all pairs of a block, from left to right: ``f`` writes the terms of a dimension, of a column and a row, into its third argument."""
    out, term = np.zeros((len(q), len(b))), np.empty((len(q), len(b)))
    for u, v in zip(np.ascontiguousarray(q.T), np.ascontiguousarray(b.T)):
        f(u[:, None], v[None], term)
        out += term
    return out


def _square(u: np.ndarray, v: np.ndarray, out: np.ndarray) -> None:
    np.subtract(u, v, out)
    np.multiply(out, out, out)


def dot_sums(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    return summed(np.multiply, q, b)


def square_sums(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    return summed(_square, q, b)


def lengths2(v: np.ndarray) -> np.ndarray:
    """Squared length of each row, from left to right."""
    out = np.zeros(len(v))
    for x in np.ascontiguousarray(v.T):
        out += x * x
    return out


def cosines(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all pairs of a block; not a number if either vector is zero."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return dot_sums(q, b) / np.sqrt(lengths2(q)[:, None] * lengths2(b)[None])


def all_exact_scores(metric: str, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of all pairs of a block, summed as in ``exact_scores``."""
    if metric == "l2":
        return 1 / (1 + square_sums(q, b))
    return (1 + (dot_sums(q, b) if metric == "dot" else cosines(q, b))) / 2


def query_blocks(queries: DataFrame, id_col: str, vec_col: str, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries in blocks of about ``limit`` bytes; only a block at a time is held."""
    ids: list[int] = []
    rows: list[np.ndarray] = []
    size = 0
    for r in queries.select(F.col(id_col).alias("i"), F.col(vec_col).alias("v")).filter("v is not null").toLocalIterator():
        rows.append(np.asarray(r.v))
        ids.append(r.i)
        size += 8 * len(rows[-1])
        if size >= limit:
            yield np.array(ids, dtype=np.int64), np.stack(rows)
            ids, rows, size = [], [], 0
    if rows:
        yield np.array(ids, dtype=np.int64), np.stack(rows)


class Best:
    """The k best of each query so far, by score and then by id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        #: Least score that still gets in, once a query has k.
        self.least = np.full(n, -np.inf)

    def add(self, query: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        query, id_, score = np.concatenate([self.query, query]), np.concatenate([self.id, id_]), np.concatenate([self.score, score])
        order = np.lexsort((id_, -score, query))
        query, id_, score = query[order], id_[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        stay = place < self.k
        self.query, self.id, self.score = query[stay], id_[stay], score[stay]
        last = place[stay] == self.k - 1
        self.least[self.query[last]] = self.score[last]


SCORED = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def scored_batch(ids: np.ndarray, query: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(vec_id), pa.array(score)], names=SCORED.fieldNames())


def share(block: object, of: slice) -> object:
    """Some queries of a block, whose arrays have a row for each query."""
    return tuple(share(x, of) for x in block) if isinstance(block, tuple) else block[of] if isinstance(block, np.ndarray) else block


def chosen(s: np.ndarray, k: int | None, threshold: float | None, margin: float, least: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the scores that can be among the k best of a row and those of ``least``, or reach the threshold, within a margin for rounding."""
    wide = margin * np.maximum(1, np.abs(s)) if margin else 0
    with np.errstate(invalid="ignore"):
        keep = ~np.isnan(s) if threshold is None else s >= threshold - wide
        if k is not None:
            floor = least
            if k + 1 < s.shape[1]:  # one more, as the query may be among the rows
                floor = np.maximum(floor, np.partition(np.where(np.isnan(s), -np.inf, s), s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1])
            keep &= s >= floor[:, None] - wide
    return np.nonzero(keep)


def scan(base: DataFrame, blocks: Iterator[tuple[np.ndarray, object]], read: Callable, rough: Callable, exact: Callable | None = None, k: int | None = None, threshold: float | None = None, exclude_self: bool = True) -> DataFrame:
    """Scores of all rows of ``base`` for blocks of queries, as (query_id, vec_id, score): the k best that each task meets, or all.

    base: vec_id and whatever ``read`` turns from a batch into arrays of its rows.
    rough: a matrix of scores of the queries with these rows.  exact: scores of single
    pairs (queries, their places, rows, their places), where the matrix is rounded.
    A score that is not a number is no result.  A task scores at most ASKING queries
    and SCORES pairs at once, however large the block.
    """
    spark = importable(base.sparkSession)
    out = None
    for ids, block in blocks:
        shared = spark.sparkContext.broadcast((ids, block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, q = shared.value
            asking = [slice(i, i + ASKING) for i in range(0, len(own), ASKING)]
            best = [Best(len(own[a]), k) for a in asking] if k is not None else None
            step = max(16, SCORES // min(ASKING, len(own)))
            for whole in batches:
                for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                    rows, vec_id = read(batch), batch.column("vec_id").to_numpy()
                    for n, a in enumerate(asking):
                        part = share(q, a)
                        s = rough(part, rows)
                        if k is None and threshold is None and exact is None and not np.isnan(s).any():  # nothing is left out but a row itself
                            at_q, at_b, values = np.repeat(np.arange(len(own[a])), len(vec_id)), np.tile(np.arange(len(vec_id)), len(own[a])), s.ravel()
                        else:
                            at_q, at_b = chosen(s, k, threshold, 0 if exact is None else MARGIN, best and best[n].least)
                            values = s[at_q, at_b] if exact is None else None
                        if exclude_self:
                            other = own[a][at_q] != vec_id[at_b]
                            if not other.all():
                                at_q, at_b, values = at_q[other], at_b[other], None if values is None else values[other]
                        if exact is not None:
                            values = exact(part, at_q, rows, at_b)
                            good = ~np.isnan(values) if threshold is None else values >= threshold
                            at_q, at_b, values = at_q[good], at_b[good], values[good]
                        if best is not None:
                            best[n].add(at_q, vec_id[at_b], values)
                        elif len(at_q):
                            yield scored_batch(own[a], at_q, vec_id[at_b], values)
            for a, b in zip(asking, best or ()):
                if len(b.query):
                    yield scored_batch(own[a], b.query, b.id, b.score)

        found = base.mapInArrow(run, SCORED)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], SCORED)


def every_pair(base: DataFrame, queries: DataFrame, values: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], names: list[str], otherwise: dict[str, Column] | None = None, id_col: str = "vec_id", vec_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Numbers of each query with every row of ``base`` but itself, as (query_id, vec_id, *names).

    values: matrices of the numbers by name, of a few queries and rows.  Nothing is
    left out: what is not a number is given as such, and where a vector is null or
    has null elements, ``otherwise`` says what stands there, by the columns query
    and embedding, or else null.  Rows are dealt out, as the work grows with the
    pairs and not with the bytes of the base.
    """
    spark = importable(base.sparkSession)
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names)])
    vectors = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("embedding"), F.exists(vec_col, lambda x: x.isNull()).alias("gap"))
    whole = lambda df: df.filter("not gap")
    nothing = [(otherwise or {}).get(n, F.lit(None)).cast("double").alias(n) for n in names]
    rows = vectors(base).repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "vec_id")
    asked = vectors(queries)
    # what has no numbers: queries with gaps with all rows, and the others with rows with gaps
    empty = F.coalesce("gap", F.lit(True))
    left, right = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), empty.alias("q_gap")), rows.select("vec_id", "embedding", empty.alias("gap"))
    meet = lambda q, b: b.join(F.broadcast(q), F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", *nothing)
    out = meet(left.filter("q_gap"), right).union(meet(left.filter("not q_gap"), right.filter("gap")))
    for ids, block in query_blocks(whole(asked), "vec_id", "embedding", block_bytes):
        shared = spark.sparkContext.broadcast((ids, block.astype(np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, q = shared.value
            for batch in (w.slice(i, 2048) for w in batches for i in range(0, w.num_rows, 2048)):
                b, vec_id = matrix(batch.column("embedding")), batch.column("vec_id").to_numpy()
                if b.shape[1] != q.shape[1]:
                    raise ValueError(f"queries of {q.shape[1]} dimensions and vectors of {b.shape[1]}")
                for at in (slice(i, i + 8) for i in range(0, len(own), 8)):  # so few that a matrix stays in the cache
                    found = values(q[at], b)
                    other = (own[at][:, None] != vec_id[None]).ravel()
                    flat = [np.repeat(own[at], len(vec_id)), np.tile(vec_id, len(own[at])), *(np.broadcast_to(found[n], (len(own[at]), len(vec_id))).ravel() for n in names)]
                    yield pa.RecordBatch.from_arrays([pa.array(x if other.all() else x[other]) for x in flat], names=schema.fieldNames())

        out = out.union(whole(rows).select("vec_id", "embedding").mapInArrow(run, schema))
    return out


def candidates(base: DataFrame, queries: DataFrame, metric: str, k: int | None, threshold: float | None, exclude_self: bool, id_col: str, vec_col: str, block_bytes: int) -> DataFrame:
    """Exact scores of the pairs that can be among the k best of a query or reach the threshold."""
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    rows = base.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("embedding")).filter("embedding is not null")

    def rough(q: np.ndarray, b: np.ndarray) -> np.ndarray:
        if b.shape[1] != q.shape[1]:
            raise ValueError(f"queries of {q.shape[1]} dimensions and vectors of {b.shape[1]}")
        return block_scores(metric, q, b)

    blocks = ((ids, q.astype(np.float64)) for ids, q in query_blocks(queries, id_col, vec_col, block_bytes))
    return scan(rows, blocks, lambda batch: matrix(batch.column("embedding")), rough, lambda q, i, b, j: exact_scores(metric, q[i], b[j]), k, threshold, exclude_self)


def dealt(vectors: DataFrame, id_col: str, vec_col: str, part: int) -> DataFrame:
    """Each row in every pair of blocks that its own block is in: (i, j, own, vec_id, embedding), i <= j."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("embedding")).filter("embedding is not null")
    parts = max(1, -(-rows.count() // part))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    rows = rows.select("vec_id", "embedding", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("other"))
    return rows.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vec_id", "embedding")


def roughly(metric: str, rows: np.ndarray) -> tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], float | None]:
    """A function of places of rows that gives their scores with each other, and by how much these can be wrong; None: by MARGIN."""
    if metric == "cosine":
        with np.errstate(over="ignore", invalid="ignore"):
            size2 = (rows * rows).sum(axis=1)
        if ((size2 > 1e-100) & (size2 < 1e100) | (size2 == 0)).all():  # single precision does for directions
            with np.errstate(divide="ignore", invalid="ignore"):
                unit = (rows / np.sqrt(2 * size2)[:, None]).astype(np.float32)

            def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                s = unit[a] @ unit[b].T
                s += np.float32(0.5)
                return s

            return scores, (rows.shape[1] + 8) * 2.0**-23
    return lambda a, b: block_scores(metric, rows[a], rows[b]), None


def reached(s: np.ndarray, k: int | None, threshold: float | None, margin: float | None, least: np.ndarray | None, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of scores that can be among the k best along an axis and those of ``least``, or reach the threshold."""
    wide = MARGIN * np.maximum(1, np.abs(s)) if margin is None else np.float32(margin)
    kind = s.dtype
    with np.errstate(invalid="ignore"):
        keep = None if threshold is None else s >= kind.type(threshold) - wide
        if k is not None:
            floor = least.astype(kind)
            new = np.flatnonzero(np.isneginf(floor))  # who has k results needs no place among these
            at = s.shape[axis] - k - 1  # one more, as the query may be among the rows
            if len(new) and at > 0:
                some = s[new] if axis else s[:, new]
                some = np.partition(np.where(np.isnan(some), -np.inf, some), at, axis=axis)
                floor[new] = some[:, at] if axis else some[at]
            best = s >= (floor[:, None] if axis else floor[None]) - wide
            keep = best if keep is None else keep & best
    at = np.flatnonzero(keep)  # faster than by two axes
    return at // s.shape[1], at % s.shape[1]


def all_pairs(vectors: DataFrame, k: int | None, threshold: float | None, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", part: int = PART) -> DataFrame:
    """Every row as a query against all others, as ``scan``; without k each pair once, with query_id < vec_id.

    A task compares two blocks of about ``part`` rows.
    """
    importable(vectors.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        out = []
        ids, rows, own = table.column("vec_id").to_numpy(), matrix(table.column("embedding").combine_chunks()), table.column("own").to_numpy()
        same = (own == own[0]).all()
        left = np.flatnonzero(own == table.column("i")[0].as_py())
        right = left if same else np.flatnonzero(own != table.column("i")[0].as_py())
        scores, margin = roughly(metric, rows)
        cut = lambda side: [side[i : i + TILE] for i in range(0, len(side), TILE)]
        tiles = cut(left) if same else cut(left) + cut(right)
        best = [Best(len(t), k) if k is not None else None for t in tiles]
        ways = [(m, n) for m in range(len(tiles)) for n in range(m, len(tiles))] if same else [(m, n) for m in range(len(cut(left))) for n in range(len(cut(left)), len(tiles))]
        for m, n in ways:
            s = scores(tiles[m], tiles[n])
            # with k, the two ask each other by one product
            for ask, of, axis in ((m, n, 1), (n, m, 0)) if k is not None and m != n else ((m, n, 1),):
                places = reached(s, k, threshold, margin, best[ask] and best[ask].least, axis)
                q, b = places if axis else places[::-1]
                own, met = tiles[ask], tiles[of]
                other = ids[own][q] != ids[met][b] if k is not None or m != n else ids[own][q] < ids[met][b]
                q, b = q[other], b[other]
                if not len(q):
                    continue
                values = exact_scores(metric, rows[own][q], rows[met][b])
                good = ~np.isnan(values) if threshold is None else values >= threshold
                q, b, values = q[good], b[good], values[good]
                if k is not None:
                    best[ask].add(q, ids[met][b], values)
                else:
                    low, high = np.minimum(ids[own][q], ids[met][b]), np.maximum(ids[own][q], ids[met][b])
                    out.append(scored_batch(low, np.arange(len(low)), high, values))
        out += [scored_batch(ids[t], x.query, x.id, x.score) for t, x in zip(tiles, best) if x is not None]
        return pa.Table.from_batches(out, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    return dealt(vectors, id_col, vec_col, part).groupBy("i", "j").applyInArrow(run, SCORED)


def nearest_of_all(vectors: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", part: int = PART) -> DataFrame:
    """The k most similar other rows of every row, as ``search`` with all rows as queries."""
    return ranked(all_pairs(vectors, k, None, metric, id_col, vec_col, part), k)


def ranked(scored: DataFrame, k: int | None, skip: int = 0, by: str = "query_id") -> DataFrame:
    """Ranks ``skip + 1`` to ``skip + k`` by score, ties by id."""
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col("vec_id"))
    out = scored.withColumn("rank", F.row_number().over(w))
    if k is not None:
        out = out.filter(F.col("rank") <= skip + k)
    return (out.filter(F.col("rank") > skip) if skip else out).select(by, "rank", "vec_id", "score")


def search(
    base: DataFrame,
    queries: DataFrame,
    k: int | None = 10,
    metric: str = "cosine",
    threshold: float | None = None,
    accept: Column | DataFrame | None = None,
    deleted: DataFrame | None = None,
    skip: int = 0,
    exclude_self: bool = True,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The k most similar base rows of each query, as (query_id, rank, vec_id, score).

    threshold: scores below it are left out.  accept: a condition on base rows, or
    a table of accepted ids; deleted: a table of ids that are gone.  Both apply
    before scoring, so that a filter never costs results.  skip: leave out that
    many of the best, for the next page.  k None: all that reach the threshold.
    Null vectors are no rows; a zero vector has no cosine score and is left out.
    """
    if k is not None and k < 1:
        raise ValueError("k must be positive")
    if k is None and threshold is None:
        raise ValueError("give k or a threshold")
    if isinstance(accept, DataFrame):
        base = base.join(accept.select(id_col).distinct(), id_col, "left_semi")
    elif accept is not None:
        base = base.filter(accept)
    if deleted is not None:
        base = base.join(deleted.select(id_col).distinct(), id_col, "left_anti")
    wanted = None if k is None else k + skip
    return ranked(candidates(base, queries, metric, wanted, threshold, exclude_self, id_col, vec_col, block_bytes), k, skip)


def similar_pairs(vectors: DataFrame, threshold: float, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", part: int = PART) -> DataFrame:
    """All pairs (a, b), a < b, whose score reaches the threshold: a similarity self-join, block against block."""
    return all_pairs(vectors, None, threshold, metric, id_col, vec_col, part).select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), "score")


def merge(parts: list[DataFrame], k: int) -> DataFrame:
    """The k best of the results of several segments."""
    out = None
    for p in (p.select("query_id", "vec_id", "score") for p in parts):
        out = p if out is None else out.union(p)
    return ranked(out, k)


def rerank(approximate: DataFrame, base: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", floor: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Second pass: exact scores for approximate results, the k best of each query.

    approximate: (query_id, vec_id, score).  Results below ``floor`` are not
    rescored; where none reaches it, the best one is all the same.  Vectors are
    fetched for these candidates alone.  Adds approx_score and
    worst_approx, the least approximate score among a query's results, infinite if
    there are fewer than k.
    """
    chosen = approximate.select("query_id", "vec_id", F.col("score").alias("approx_score"))
    if floor is not None:
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("approx_score").desc(), F.col("vec_id")))
        chosen = chosen.withColumn("best", best).filter((F.col("approx_score") >= floor) | (F.col("best") == 1)).drop("best")
    left = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).alias("query"))
    right = base.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))
    scored = chosen.join(right, "vec_id").join(left, "query_id").select("query_id", "vec_id", "approx_score", V.score(metric, F.col("query"), F.col("embedding")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    top = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    all_ = Window.partitionBy("query_id")
    worst = F.when(F.count("*").over(all_) < k, float("inf")).otherwise(F.min("approx_score").over(all_))
    return top.select("query_id", "rank", "vec_id", "score", "approx_score", worst.alias("worst_approx"))


def two_pass(base: DataFrame, queries: DataFrame, k: int, rerank_k: int, approximate, metric: str = "cosine", floor: float | None = None) -> DataFrame:
    """Approximate search for ``rerank_k`` candidates by ``approximate(rerank_k)``, then ``rerank``."""
    if rerank_k < k:
        raise ValueError(f"rerank_k {rerank_k} must be at least k {k}")
    return rerank(approximate(rerank_k), base, queries, k, metric, floor)
