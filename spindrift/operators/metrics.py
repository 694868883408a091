"""Accuracy and speed of searches, as aggregations."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def check(truth: DataFrame, found: DataFrame, k_truth: int, k_found: int) -> None:
    """Errors for what makes accuracy meaningless: other queries, short or repeated results, missing ids."""
    counts = lambda df, k: df.filter(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("d"), F.count_if(F.col("vec_id").isNull()).alias("z"))
    t, f = counts(truth, k_truth).alias("t"), counts(found, k_found).alias("f")
    both = t.join(f, "query_id", "full")
    bad = both.filter(F.col("t.n").isNull() | F.col("f.n").isNull() | (F.col("t.n") < k_truth) | (F.col("f.n") < k_found) | (F.col("f.d") + F.col("f.z") < F.col("f.n")) | (F.col("f.z") > 0) | (F.col("t.z") > 0))
    if row := bad.limit(1).collect():
        raise ValueError(f"results of query {row[0].query_id} are missing, short, repeated or null")


def _hits(truth: DataFrame, found: DataFrame, k_truth: int, k_found: int) -> DataFrame:
    t = truth.filter(F.col("rank") <= k_truth).select("query_id", "vec_id").distinct().withColumn("hit", F.lit(1))
    return found.filter(F.col("rank") <= k_found).select("query_id", "rank", "vec_id").join(t, ["query_id", "vec_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def recall(truth: DataFrame, found: DataFrame, k_truth: int, k_found: int) -> DataFrame:
    """Hits over ``k_truth`` times the number of queries."""
    if k_found < k_truth:
        raise ValueError("fewer results than ground truth")
    n = truth.select("query_id").distinct().count()
    return _hits(truth, found, k_truth, k_found).agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.lit(k_truth * n)).alias("recall"))


def average_precision(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Per query: precision at each hit, summed and divided by k."""
    running = F.sum("hit").over(Window.partitionBy("query_id").orderBy("rank"))
    return _hits(truth, found, k, k).withColumn("running", running).groupBy("query_id").agg((F.sum(F.col("hit") * F.col("running") / F.col("rank")) / k).alias("ap"))


def mean_average_precision(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    return average_precision(truth, found, k).agg(F.avg("ap").alias("map"))


def latency(rows: DataFrame, value: str, by: list[str] = []) -> DataFrame:
    """Mean, population deviation, and the value that 999 of 1000 do not exceed."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.expr(f"percentile_disc(0.999) within group (order by `{value}`)").alias("p999"))


def throughput(runs: DataFrame, by: list[str] = []) -> DataFrame:
    """Average, median and largest queries per second over runs of (queries, seconds)."""
    qps = F.col("queries") / F.col("seconds")
    return runs.groupBy(*by).agg(F.avg(qps).alias("average_qps"), F.median(qps).alias("median_qps"), F.max(qps).alias("max_qps"))


def summary(runs: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Averages and deviations of the values over repeated runs."""
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), *(f(v).alias(f"{n}_{v}") for v in values for n, f in (("avg", F.avg), ("std", F.stddev_pop))))


RUNS = "name string, run int, queries long, seconds double"


def timed(spark: SparkSession, searches: dict[str, Callable[[], DataFrame]], queries: int, repeats: int = 3, warm_up: int = 1) -> DataFrame:
    """Times of whole runs, as (name, run, queries, seconds): each search is carried out over and over, and its rows are thrown away.

    The first ``warm_up`` runs start workers and compile code, and are not counted.
    ``throughput`` and ``latency`` sum the times up.
    """
    rows = []
    for name, search in searches.items():
        for run in range(-warm_up, repeats):
            began = time.perf_counter()
            search().write.format("noop").mode("overwrite").save()
            if run >= 0:
                rows.append((name, run, queries, time.perf_counter() - began))
    return spark.createDataFrame(rows, RUNS)


def centroid(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Mean and sum of all vectors, a row for each dimension: (pos, mean, total)."""
    each = vectors.select(F.posexplode(F.col(vec_col).cast("array<double>")).alias("pos", "x"))
    return each.groupBy("pos").agg(F.avg("x").alias("mean"), F.sum("x").alias("total"))
