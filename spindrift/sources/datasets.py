"""Benchmark datasets: base, queries and ground truth, described in a catalogue.

A catalogue is a mapping from name to entry, read from a JSON file or given as a
dict.  ``_defaults`` holds values for all entries, ``_include`` further files;
``${NAME}`` and ``${NAME:-default}`` stand for environment variables.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import vecs

NEAR_ZERO = 1e-5
SECRET = re.compile(r"(?i)(secret|token|password|key)")


@dataclass
class Dataset:
    name: str
    base: DataFrame
    queries: DataFrame
    truth: DataFrame
    metric: str


def expand(text: str, environment: dict[str, str] | None = None) -> str:
    """Replace ``${NAME}`` and ``${NAME:-default}``; a name without value or default is an error."""
    environment = os.environ if environment is None else environment

    def value(m: re.Match) -> str:
        if m[1] in environment:
            return environment[m[1]]
        if m[2] is None:
            raise KeyError(f"{m[1]} is not set")
        return m[2]

    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", value, text)


def load_catalog(path: str | Path, environment: dict[str, str] | None = None) -> dict[str, dict]:
    """Entries of a catalogue file and of those it includes; a nearer value wins."""
    path = Path(path)
    raw = json.loads(path.read_text())
    out: dict[str, dict] = {}
    for other in raw.get("_include", []):
        out |= load_catalog(path.parent / expand(other, environment), environment)
    defaults = raw.get("_defaults", {})
    for name, entry in raw.items():
        if not name.startswith("_"):
            out[name] = {k: expand(v, environment) if isinstance(v, str) else v for k, v in (defaults | entry).items()}
    return out


def shown(entry: dict) -> dict:
    """An entry for logs, without secrets."""
    return {k: "***" if SECRET.search(k) else v for k, v in entry.items()}


def load(spark: SparkSession, name: str, *catalogs: dict[str, dict]) -> Dataset:
    """The dataset of that name in the first catalogue that has it."""
    for catalog in catalogs:
        if name in catalog:
            e = catalog[name]
            metric = e.get("metric", "cosine")
            if metric not in V.METRICS:
                raise ValueError(f"unknown metric {metric!r}")
            found = Dataset(name, vecs.read_fvecs(spark, e["base"]), vecs.read_fvecs(spark, e["queries"]), vecs.ground_truth(vecs.read_ivecs(spark, e["truth"])), metric)
            return scrub(found) if e.get("load", "as_stored") == "scrub" else found
    raise KeyError(f"no dataset named {name!r}")


def scrub_base(base: DataFrame, metric: str) -> DataFrame:
    """Base rows without near-zero vectors (they have a direction for no metric but l2) and without repeats of an earlier one."""
    rows = base if metric == "l2" else base.filter(F.sqrt(V.norm2(F.col("embedding"))) > NEAR_ZERO)
    first = rows.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"))
    return first.select("vec_id", "embedding")


def scrub(data: Dataset) -> Dataset:
    """Drop near-zero and repeated base vectors and queries that are base vectors, renumber all, and normalise for dot products if the first vector is not a unit vector."""
    from ..operators import segments

    base = segments.numbered(scrub_base(data.base, data.metric))
    queries = data.queries if data.metric == "l2" else data.queries.filter(F.sqrt(V.norm2(F.col("embedding"))) > NEAR_ZERO)
    queries = segments.numbered(queries.join(base.select("embedding").distinct(), "embedding", "left_anti"))
    # the ground truth may name a repeat: its first copy stands for it
    same = data.base.withColumnRenamed("vec_id", "old").join(base.select("embedding", F.col("ord").alias("new")), "embedding").select("old", "new")
    truth = data.truth.join(same, data.truth.vec_id == same.old).join(queries.select(F.col("vec_id").alias("query_id"), F.col("ord").alias("q")), "query_id")
    truth = truth.groupBy("q", "new").agg(F.min("rank").alias("rank")).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).select(F.col("q").alias("query_id"), "rank", F.col("new").alias("vec_id"))
    renumber = lambda df: df.select(F.col("ord").alias("vec_id"), "embedding")
    base, queries = renumber(base), renumber(queries)
    first = base.orderBy("vec_id").limit(1).select(V.norm2(F.col("embedding")).alias("n")).first()
    if data.metric == "dot" and first and abs(first.n - 1) > 1e-3:
        unit = lambda df: df.withColumn("embedding", V.l2_normalized(F.col("embedding")).cast("array<float>"))
        base, queries = unit(base), unit(queries)
    return Dataset(data.name, base, queries, truth, data.metric)
