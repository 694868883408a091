"""Near-duplicates by SimHash, found with vantage-point trees.

A fingerprint has a bit for each bit of the shingles' hashes, set if most of
them have it.  Two fingerprints within ``radius`` differing bits are linked.

One tree over whole fingerprints prunes little, since nearly all distances
between unrelated ones lie within a few bits of half their length.  The bits are
therefore cut into groups: of two linked fingerprints some group differs by
``radius // groups`` bits at most.  Each group has a vantage-point tree: a node
sends what lies within half the group's bits of its vantage point to the left,
the rest to the right, and a search goes by the triangle bound to every side that
can hold a match.  The leaves are shards: each fingerprint is at home in one and
is a query in those whose boundary it overlaps, and within a shard the pairs are
exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, components, hashing

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LEAF, SPLIT, SEED = 1000, 16_000, 42
BYTES = np.uint64(0x0101010101010101)


def shingle_hashes(words: list[bytes], width: int) -> list[int]:
    """XXH64 of each shingle, repeats included; of the whole sequence if it is shorter."""
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - width] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of ``sizes`` hashes, the bits that over half of them have."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    first = np.concatenate([[0], np.cumsum(sizes[full])])
    # eight counters of a byte each share a word; a counter holds 255 rows
    blocks = -(-sizes[full] // 255)
    owner = np.repeat(np.arange(len(full)), blocks)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = first[owner] + 255 * within
    lead = np.cumsum(blocks) - blocks
    bits = np.zeros((len(full), 8, 8), dtype=bool)
    for k in range(8):
        counters = np.add.reduceat((hashes >> np.uint64(k)) & BYTES, at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        bits[:, :, k] = 2 * np.add.reduceat(counters, lead, axis=0) > sizes[full][:, None]
    out[full] = np.packbits(bits.reshape(len(full), 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprint_batch(texts: pa.Array, width: int, lanes: int) -> np.ndarray:
    """Fingerprints of the texts, ``lanes`` times 64 bits each.

    The first lane takes the hashes as they are; each other lane takes a fixed
    bijection of them, which is as good as a hash with another seed.
    """
    data, offsets = hashing.text_bytes(texts)
    low, hashes, sizes = LOWER[data].tobytes(), [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        own = shingle_hashes(low[a:b].split(), width)
        hashes += own
        sizes.append(len(own))
    flat, n = np.array(hashes, dtype=np.uint64), np.array(sizes, dtype=np.int64)
    return np.stack([majority(hashing.mix(flat + np.uint64(lane * hashing.BASE % 2**64)) if lane else flat, n) for lane in range(lanes)], axis=1)


PRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.BinaryType())])


def fingerprints(docs: DataFrame, width: int = 4, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each row, lanes in little-endian order.

    A null or wordless text has the fingerprint zero; a null id stays null; one
    row comes out for each row, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                found = fingerprint_batch(batch.column("text"), width, lanes)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in found], pa.binary())], names=["doc_id", "fp"])

    return common.documents(docs, id_col, text_col).mapInArrow(run, PRINTS)


class Forest:
    """A vantage-point tree of ``depth`` levels for each group of bits."""

    def __init__(self, bits: int, groups: int, reach: int, depth: int) -> None:
        edges = [bits * g // groups for g in range(groups + 1)]
        self.ranges = list(zip(edges, edges[1:]))
        self.radius, self.depth = reach, depth
        self.vantage = [hashing.mix(np.arange(2**depth, dtype=np.uint64) + np.uint64(1 + g * 0x9E3779B97F4A)) & np.uint64(2 ** (b - a) - 1) for g, (a, b) in enumerate(self.ranges)]

    def group(self, prints: np.ndarray, g: int) -> np.ndarray:
        """The bits of a group; a group is within 64 bits and may span two lanes."""
        a, b = self.ranges[g]
        lane, shift = divmod(a, 64)
        out = prints[:, lane] >> np.uint64(shift)
        if b > 64 * (lane + 1):
            out = out | (prints[:, lane + 1] << np.uint64(64 - shift))
        return out & np.uint64(2 ** (b - a) - 1)

    def shards(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each group: rows, their shards, and whether they are at home there."""
        for g, (a, b) in enumerate(self.ranges):
            values, half, r = self.group(prints, g), (b - a - 1) // 2, self.radius
            rows, nodes, home = np.arange(len(prints)), np.zeros(len(prints), dtype=np.int64), np.ones(len(prints), dtype=bool)
            for level in range(self.depth):
                away = np.bitwise_count(values[rows] ^ self.vantage[g][2**level - 1 + nodes]).astype(np.int64)
                left = np.where(home, away <= half, away <= half + r)
                right = np.where(home, away > half, away > half - r)
                # of two at home on either side, the right one goes over as a query
                over = home & right & (away <= half + r)
                rows, nodes, home = (
                    np.concatenate([rows[left], rows[right], rows[over]]),
                    np.concatenate([2 * nodes[left], 2 * nodes[right] + 1, 2 * nodes[over]]),
                    np.concatenate([home[left], home[right], np.zeros(int(over.sum()), dtype=bool)]),
                )
            yield rows, nodes + g * 2**self.depth, home


def join_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Unite the sets of u[i] and v[i]; labels[i] is a smaller member of i's set, or i."""
    while len(u):
        a, b = labels[u], labels[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


def linked(prints: np.ndarray, home: np.ndarray, radius: int, step: int = 1 << 22, asking: np.ndarray | None = None) -> np.ndarray:
    """Labels that join each row at home with all rows within the radius, or with those that ask."""
    labels, at = np.arange(len(prints)), np.flatnonzero(home)
    asked = labels.copy() if asking is None else np.flatnonzero(asking)
    base, rows = prints[at], max(1, step // max(1, len(at)))
    for i in range(0, len(asked), rows):
        part = prints[asked[i : i + rows]]
        away = np.zeros((len(part), len(base)), dtype=np.uint16)
        for lane in range(prints.shape[1]):
            away += np.bitwise_count(part[:, lane, None] ^ base[None, :, lane])
        q, h = np.nonzero(away <= radius)
        join_labels(labels, asked[q + i], at[h])
    return labels


SHARDS = T.StructType([T.StructField("shard", T.LongType()), T.StructField("home", T.BooleanType()), T.StructField("rep", T.LongType()), T.StructField("fp", T.BinaryType())])


def links(classes: DataFrame, n: int, lanes: int, radius: int, groups: int, reach: int) -> DataFrame:
    """Links (a, b) between the representatives of distinct fingerprints that span every linked set.

    classes has ``rep`` and ``fp``, each fingerprint once; n is about their number
    and sets the depth of the trees.  A task holds 2 * SPLIT rows of a shard at most.
    """
    forest = Forest(64 * lanes, groups, reach, max(0, int(n / LEAF)).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                prints = np.frombuffer(b"".join(batch.column("fp").to_pylist()), dtype=np.uint64).reshape(-1, lanes)
                for rows, shard, home in forest.shards(prints):
                    taken = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(home), taken.column("rep"), taken.column("fp")], names=SHARDS.fieldNames())

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        prints = np.frombuffer(b"".join(pdf["fp"]), dtype=np.uint64).reshape(-1, lanes)
        reps, labels = pdf["rep"].to_numpy(), linked(prints, pdf["home"].to_numpy(), radius, asking=pdf["ask"].to_numpy())
        out = pd.DataFrame({"a": reps, "b": reps[labels]})
        return out[out.a != out.b].drop_duplicates()

    dealt = classes.select("rep", "fp").mapInArrow(deal, SHARDS)
    # a large shard is cut into parts of those at home and parts of the queries, and each pair of parts is a task's
    share = lambda n: F.ceil(F.sum(n) / SPLIT).cast("long")
    large = dealt.groupBy("shard").agg(F.count("*").alias("n"), share(F.col("home").cast("long")).alias("homes"), share((~F.col("home")).cast("long")).alias("asking")).filter(F.col("n") > SPLIT).drop("n")
    split = dealt.join(large, "shard", "left")
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("asking")))
    block = lambda i, j, home, ask: F.struct(i.alias("i"), j.alias("j"), home.alias("home"), ask.alias("ask"))
    count = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    none = F.array().cast("array<struct<i:bigint,j:bigint,home:boolean,ask:boolean>>")
    at_home = F.transform(count(F.col("homes")), lambda o: block(F.least(own, o), F.greatest(own, o), own <= o, own >= o))
    asked = F.when(F.col("asking") > 0, F.transform(count(F.greatest("asking", F.lit(1))), lambda o: block(own, -1 - o, F.lit(True), F.lit(False)))).otherwise(none)
    asks = F.when(F.col("homes") > 0, F.transform(count(F.greatest("homes", F.lit(1))), lambda o: block(o, -1 - own, F.lit(False), F.lit(True)))).otherwise(none)
    whole = F.array(block(F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("home"), F.lit(True)))
    blocks = F.when(F.col("homes").isNull(), whole).when(F.col("home"), F.concat(at_home, asked)).otherwise(asks)
    parts = split.select("shard", "rep", "fp", F.explode(blocks).alias("at")).select("shard", "rep", "fp", "at.*")
    return parts.groupBy("shard", "i", "j").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, lanes: int = 1, radius: int = 4, groups: int = 3, reach: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of each row, as (doc_id, fp, component_id).

    component_id is the smallest id reachable over links, the row's own included.
    Rows with equal fingerprints, empty texts among them, are one class; rows that
    share an id are one document.  Rows without an id share the last one, which
    is returned as null.  A ``reach`` of less than ``radius // groups`` differing
    bits a group makes the search approximate; by default all links are found.
    An empty table gives no rows; other columns are ignored, whatever their names.
    A very long text is fingerprinted whole, with a number for each of its words.
    """
    prints, since = common.staged(fingerprints(docs, width, lanes, id_col, text_col), "prints"), len(common.paths())
    classes = common.staged(prints.groupBy("fp").agg(F.min(common.id_order("doc_id")).alias("rep")), "classes")
    n = classes.count()
    found = components.components(links(classes, n, lanes, radius, groups, radius // groups if reach is None else reach))
    of = classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    of = common.concluded(of, "components", since)
    out = prints.join(of, "fp").select("doc_id", "fp", F.col("component_id"))
    return out.withColumn("component_id", F.when(F.col("component_id") == common.NO_ID, None).otherwise(F.col("component_id")))


def digests(found: DataFrame) -> DataFrame:
    """Fingerprints of one lane in hexadecimal digits, highest first."""
    digits = F.lower(F.hex("fp"))
    return found.select("doc_id", F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(8)))).alias("fingerprint"), "component_id")
