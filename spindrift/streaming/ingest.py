"""Streams of vectors and deletions, in one order.

Each micro-batch of either stream claims the next version and becomes a segment of
its own under that number.  A batch that is tried again finds the version it has
claimed and replaces what it wrote before, so every row arrives once.  Readers name
the last version they want, which pins what they see: of the vectors and deletions
of an id the latest one up to there counts, so that an id can come back.
Compaction is a batch job over segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import segments

VECTORS, TOMBSTONES = "vectors", "tombstones"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def claimed(spark: SparkSession, path: str, kind: str, batch: int) -> int:
    """The version of a batch of one of the streams: the one it has, or the next that is free.

    A version is a file ``versions/NUMBER`` that only one batch can create; it holds
    the name of the batch.
    """
    fs, folder = _files(spark, f"{path}/versions")
    fs.mkdirs(folder)
    name, taken = f"{kind}-{batch}", {}
    for status in fs.listStatus(folder):
        number = status.getPath().getName()
        if number.isdigit() and status.getLen():
            stream = fs.open(status.getPath())
            taken[int(number)] = stream.readUTF()
            stream.close()
        elif number.isdigit():
            taken[int(number)] = ""
    if name in taken.values():
        return next(v for v, n in taken.items() if n == name)
    version = max(taken, default=0) + 1
    while True:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{version:012d}")
        try:
            stream = fs.create(at, False)
        except Exception:  # another stream was first
            if not fs.exists(at):
                raise
            version += 1
            continue
        stream.writeUTF(name)
        stream.close()
        return version


def _written(stream: DataFrame, kind: str, rows, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    def write(batch: DataFrame, n: int) -> None:
        version = claimed(batch.sparkSession, path, kind, n)
        rows(batch).write.mode("overwrite").parquet(f"{path}/{kind}/version={version}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest(stream: DataFrame, path: str, checkpoint: str, id_col: str = "vec_id", vec_col: str = "embedding", **trigger) -> StreamingQuery:
    """Write a stream of vectors as segments ``path/vectors/version=n``."""
    rows = lambda batch: batch.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("embedding")).filter("vec_id is not null and embedding is not null").dropDuplicates(["vec_id"])
    return _written(stream, VECTORS, rows, path, checkpoint, trigger)


def delete(stream: DataFrame, path: str, checkpoint: str, id_col: str = "vec_id", **trigger) -> StreamingQuery:
    """Write a stream of deleted ids as ``path/tombstones/version=n``."""
    rows = lambda batch: batch.select(F.col(id_col).cast("long").alias("vec_id")).filter("vec_id is not null").distinct()
    return _written(stream, TOMBSTONES, rows, path, checkpoint, trigger)


def snapshot(spark: SparkSession, path: str, up_to: int | None = None) -> DataFrame:
    """Live rows of all versions up to ``up_to``: (vec_id, embedding, version)."""

    def read(kind: str, schema: str) -> DataFrame:
        fs, at = _files(spark, f"{path}/{kind}")
        if not fs.exists(at):
            return spark.createDataFrame([], f"{schema}, version int")
        rows = spark.read.schema(f"{schema}, version int").option("basePath", f"{path}/{kind}").parquet(f"{path}/{kind}")
        return rows if up_to is None else rows.filter(F.col("version") <= up_to)

    rows, gone = read(VECTORS, "vec_id long, embedding array<float>"), read(TOMBSTONES, "vec_id long")
    # ids and versions alone decide; vectors are read for the rows that live
    last = rows.select("vec_id", "version", F.lit(True).alias("lives")).union(gone.select("vec_id", "version", F.lit(False)))
    last = last.groupBy("vec_id").agg(F.max(F.struct("version", "lives")).alias("x")).filter("x.lives").select("vec_id", F.col("x.version").alias("version"))
    return rows.join(last, ["vec_id", "version"], "left_semi").select("vec_id", "embedding", "version")


def compact(spark: SparkSession, path: str, target: str, up_to: int | None = None) -> DataFrame:
    """Write the snapshot as one table under dense new ids, with the old ones beside them."""
    ordered = segments.numbered(snapshot(spark, path, up_to).drop("version"))
    ordered.select(F.col("ord").alias("vec_id"), F.col("vec_id").alias("old_id"), "embedding").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
