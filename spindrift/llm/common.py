"""Shared plumbing: staged tables, vocabulary paths and batch helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing document id wherever ids are ordered: it comes last.
NO_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset (a
    local session, as in tests) a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spindrift-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_written = threading.local()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: losing an executor later cannot lose the rows.
    """
    path = f"{shared_dir(df.sparkSession)}/spindrift/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    paths().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def paths() -> list[str]:
    """Tables that this thread has staged and not yet dropped."""
    if not hasattr(_written, "paths"):
        _written.paths = []
    return _written.paths


def concluded(df: DataFrame, name: str, since: int) -> DataFrame:
    """Stage ``df``, and drop the tables that were staged after the first ``since`` ones, which only led to it."""
    out = staged(df, name)
    own = paths()
    spent, own[since:-1] = own[since:-1], []
    spark = df.sparkSession
    for path in spent:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return out


def id_order(column: str | Column) -> Column:
    """Ids as they are compared: a null id comes after every other."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NO_ID))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text alone, under fixed names; a null text counts as empty."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice has about ``limit`` bytes of text, and one row at least."""
    lengths = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)
