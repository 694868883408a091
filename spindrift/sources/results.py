"""Results of runs as files that a later run can go on from.

A result is a row with the parameters of its run.  Files are CSV or JSON, a line
for each row, and are only ever added to; a run whose parameters are there already
need not be done again.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("csv", "json")


def append(results: DataFrame, path: str, format: str = "json") -> None:
    """Add rows to the results at ``path``.  Columns of CSV must be plain values."""
    if format not in FORMATS:
        raise ValueError(f"results are written as {' or '.join(FORMATS)}, not {format!r}")
    out = results.write.mode("append")
    out.option("header", True).csv(path) if format == "csv" else out.json(path)


def read(spark: SparkSession, path: str, schema: str, format: str = "json") -> DataFrame:
    """The results at ``path``; none if nothing was written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema)
    return rows.option("header", True).csv(path) if format == "csv" else rows.json(path)


def missing(done: DataFrame, runs: Iterable[dict]) -> list[dict]:
    """Those of the runs, as parameters by name, that no row of ``done`` has."""
    runs = list(runs)
    if not runs:
        return []
    names = sorted({n for r in runs for n in r})
    if unknown := [n for n in names if n not in done.columns]:
        raise ValueError(f"the results have no {', '.join(unknown)}")
    key = lambda values: json.dumps(values, sort_keys=True, default=str)
    # as many rows as there are different parameters, not results
    known = {key([r[n] for n in names]) for r in done.select(*(F.col(n) for n in names)).distinct().toLocalIterator()}
    return [r for r in runs if key([r.get(n) for n in names]) not in known]
