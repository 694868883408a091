"""An index as a directory of Parquet tables.

``vectors`` is written always; ``codes`` (product or binary), ``nvq``, ``graph``,
``codec`` and ``tombstones`` if there are any; ``meta`` last of all, so that a
directory without it is no index yet.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codecs

FORMAT = 1


@dataclass
class Index:
    vectors: DataFrame
    meta: dict
    codes: DataFrame | None = None
    nvq: DataFrame | None = None
    graph: DataFrame | None = None
    codec: DataFrame | None = None
    tombstones: DataFrame | None = None

    def quantizer(self):
        """The codec that the codes were made with."""
        return codecs.load(self.feature("codec"))

    def feature(self, name: str) -> DataFrame:
        """A table that the index may or may not have; an error if it has not."""
        found = getattr(self, name)
        if found is None:
            raise ValueError(f"this index has no {name}")
        return found


@dataclass
class Writer:
    """Collects what goes into an index and writes it in one go."""

    path: str
    metric: str = "cosine"
    mode: str = "error"
    parts: dict[str, DataFrame] = field(default_factory=dict)
    extra: dict = field(default_factory=dict)

    def add(self, name: str, table: DataFrame) -> Writer:
        if name not in ("vectors", "codes", "nvq", "graph", "codec", "tombstones"):
            raise ValueError(f"unknown table {name!r}")
        self.parts[name] = table
        return self

    def note(self, **values) -> Writer:
        self.extra |= values
        return self

    def write(self) -> Index:
        if "vectors" not in self.parts:
            raise ValueError("an index needs its vectors")
        spark = self.parts["vectors"].sparkSession
        for name, table in self.parts.items():
            table.write.mode(self.mode).parquet(f"{self.path}/{name}")
        vectors = spark.read.parquet(f"{self.path}/vectors")
        first = vectors.select(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), F.min(F.size("embedding")).alias("least")).first()
        if first.n and first.dim != first.least:
            raise ValueError("vectors of different dimensions")
        meta = {"format": FORMAT, "metric": self.metric, "rows": first.n, "dim": first.dim, "tables": sorted(self.parts), "checksum": checksum(vectors)} | self.extra
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(self.mode).text(f"{self.path}/meta")
        return read(spark, self.path)


def checksum(vectors: DataFrame) -> int:
    """The same for the same rows in any order and any files."""
    return vectors.select(F.xxhash64("vec_id", "embedding").alias("h")).agg(F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x")).first().x


def read(spark: SparkSession, path: str, verify: bool = False) -> Index:
    meta = json.loads("".join(r.value for r in spark.read.text(f"{path}/meta").collect()))
    if meta["format"] > FORMAT:
        raise ValueError(f"format {meta['format']} is newer than {FORMAT}")
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in meta["tables"]}
    if verify and checksum(tables["vectors"]) != meta["checksum"]:
        raise ValueError("the vectors are not those that were written")
    return Index(meta=meta, **tables)


def append(index_path: str, vectors: DataFrame) -> Index:
    """Add rows, and bring the number of rows and the checksum up to date.

    Readers that hold the index see their own files until they read it again.
    """
    spark = vectors.sparkSession
    meta = read(spark, index_path).meta
    first = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("most"), F.min(F.size("embedding")).alias("least")).first()
    if first.n and {first.most, first.least} != {meta["dim"] or first.most}:
        raise ValueError(f"vectors of {first.least} to {first.most} dimensions; the index has {meta['dim']}")
    vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), *(c for c in vectors.columns if c not in ("vec_id", "embedding"))).write.mode("append").parquet(f"{index_path}/vectors")
    held = spark.read.parquet(f"{index_path}/vectors")
    meta |= {"rows": held.count(), "dim": meta["dim"] or first.most, "checksum": checksum(held)}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{index_path}/meta")
    return read(spark, index_path)


def cached_path(root: str, **parameters) -> str:
    """Where an index with these parameters is kept: a folder named by their hash."""
    plain = {k: asdict(v) if hasattr(v, "__dataclass_fields__") else v for k, v in parameters.items()}
    return f"{root}/{hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest()[:24]}"
