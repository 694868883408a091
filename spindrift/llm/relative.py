"""Substring dedup by relative Lempel-Ziv parsing against all documents.

Every document is both a reference and a text to be factored.  The reference is
indexed in blocks that the content itself delimits: in each window of ``window``
words the least hashed run of ``anchor`` words is its anchor, and the windows that
follow each other with the same anchor make a block.  Equal windows have equal
anchors wherever they stand, so that a text needs to look into the index only
under its own anchors, and it meets every reference block that can matter.

A factor has a place and a length in the text, and the place in an earlier
document where the same words stand.  Its seeds are blocks and windows: a block
whose anchor has no other content in the corpus stands whole in the first document
that has it; where the blocks of an anchor differ, a factor begins or ends, and
the windows at this boundary are looked up singly.  From its first seed on a
factor is extended greedily, as long as the next seed lies on the same diagonal of
the same source.  Factors are ``window`` words long or longer, and their words are
the duplicate spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, hashing

WINDOW, ANCHOR = 50, 8


class Parsed:
    """Words, windows and anchors of some texts."""

    def __init__(self, texts: pa.Array, window: int, anchor: int) -> None:
        self.starts, _, keys, self.first = hashing.word_table(*hashing.text_bytes(texts))
        self.sums = hashing.prefix(keys)
        n = len(self.starts) - window + 1
        if n <= 0:
            self.at = self.anchors = np.zeros(0, dtype=np.int64)
            return
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        at = np.arange(len(self.starts) - anchor + 1)
        least = hashing.sliding_min(hashing.runs(self.sums, at, at + anchor), window - anchor + 1)
        #: First words of the windows, which lie within one text, and their anchors.
        self.at = np.flatnonzero(doc[:n] == doc[window - 1 :])
        self.anchors, self.doc = least[self.at], doc[self.at]


BLOCKS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("copy", T.LongType()), T.StructField("anchor", T.LongType()), T.StructField("block", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())])


def index(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The blocks of all documents: anchor, hash of the words, first window and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                p = Parsed(batch.column("text"), window, anchor)
                if not len(p.at):
                    continue
                new = np.concatenate([[True], (p.anchors[1:] != p.anchors[:-1]) | (np.diff(p.at) != 1)])
                lead = np.flatnonzero(new)
                size = np.diff(np.append(lead, len(p.at)))
                start = p.at[lead]
                block = hashing.runs(p.sums, start, start + size + window - 1)
                owner = p.doc[lead]
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").take(take),
                        batch.column("copy").take(take),
                        pa.array(p.anchors[lead].view(np.int64)),
                        pa.array(block.view(np.int64)),
                        pa.array((start - p.first[owner]).astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                    ],
                    names=BLOCKS.fieldNames(),
                )

    return rows.mapInArrow(run, BLOCKS)


WINDOWS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("copy", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("check", T.LongType()), T.StructField("start", T.IntegerType())])


def windows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """Single windows of the runs (column ``runs`` of first window and number) of each text, with 128 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                _, _, keys, first = hashing.word_table(*hashing.text_bytes(batch.column("text")))
                runs = batch.column("runs")
                owner = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
                flat = runs.flatten()
                begin, size = flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
                doc = np.repeat(owner, size)
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
                place = at + first[doc]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").take(take),
                        batch.column("copy").take(take),
                        pa.array(hashing.runs(hashing.prefix(keys), place, place + window).view(np.int64)),
                        pa.array(hashing.runs(hashing.prefix(hashing.mix(keys)), place, place + window).view(np.int64)),
                        pa.array(at.astype(np.int32)),
                    ],
                    names=WINDOWS.fieldNames(),
                )

    return rows.mapInArrow(run, WINDOWS)


def extended(seeds: list[dict], window: int) -> list[tuple[int, int, int, int, int]]:
    """Factors (start, words, source, source_copy, source_start) from seeds, each as long as its source goes along with the text."""
    out: list[list] = []
    for s in sorted(seeds, key=lambda s: s["start"]):
        start, n, diagonal = s["start"], s["n"], (s["source"], s["source_copy"], s["source_start"] - s["start"])
        if out and out[-1][0] + out[-1][1] == start and out[-1][2] == diagonal:
            out[-1][1] += n
        else:
            out.append([start, n, diagonal])
    return [(start, n + window - 1, source, copy, start + shift) for start, n, (source, copy, shift) in out]


def seeds(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """Per text the runs of windows that stand in an earlier document, with the place of the first such run, as an array."""
    blocks = common.staged(index(rows.select("doc", "copy", "text"), window, anchor), "blocks")
    # anchors that an earlier document has too; the rest of the index matches nothing
    # (tables of their own, so that a join with them can split a common key)
    known = blocks.groupBy("anchor").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.min("block").alias("low"), F.max("block").alias("high")).filter("first < last")
    known = common.staged(known.select("anchor", "first", (F.col("low") == F.col("high")).alias("same")), "known")
    shared = common.staged(blocks.join(known, "anchor").select("doc", "copy", "anchor", "start", "n", "first", "same"), "shared")
    place = F.struct(F.col("copy").alias("source_copy"), F.col("start").alias("source_start"))
    origin = common.staged(shared.filter("same and first = doc").groupBy("anchor").agg(F.min(place).alias("at")), "origins")
    whole = shared.filter("same and first < doc").join(origin, "anchor").select("doc", "copy", "start", "n", F.col("first").alias("source"), "at.*")
    runs = shared.filter("not same").groupBy("doc", "copy").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    single = common.staged(windows(rows.select("doc", "copy", "text").join(runs, ["doc", "copy"]), window, anchor), "windows")
    earliest = common.staged(single.groupBy("hash", "check").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").drop("last"), "earliest")
    met = common.staged(single.join(earliest, ["hash", "check"]), "met")
    origin = common.staged(met.filter("first = doc").groupBy("hash", "check").agg(F.min(place).alias("at")), "origins")
    ends = met.filter("first < doc").join(origin, ["hash", "check"]).select("doc", "copy", "start", F.lit(1).alias("n"), F.col("first").alias("source"), "at.*")
    return whole.union(ends).groupBy("doc", "copy").agg(F.collect_set(F.struct("start", "n", "source", "source_copy", "source_start")).alias("seeds"))


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc orders the documents; copy tells texts of one id apart."""
    return common.documents(docs, id_col, text_col).withColumn("doc", common.id_order("doc_id")).withColumn("copy", F.xxhash64("text"))


FACTORS = T.StructType(
    [T.StructField("doc", T.LongType()), T.StructField("copy", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType())]
    + [T.StructField("source", T.LongType()), T.StructField("source_copy", T.LongType()), T.StructField("source_start", T.LongType())]
)


def factors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Factors of each text: its words from ``start`` on stand in ``source``, from ``source_start`` on.

    ``copy`` and ``source_copy`` are hashes of the texts, as an id may have several;
    a null id is ``common.NO_ID``.  Factors that meet in the middle of a window
    overlap; what no factor covers is literal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d, c, *f) for d, c, s in zip(*(batch.column(x).to_pylist() for x in ("doc", "copy", "seeds"))) for f in extended(s, window)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out)], names=FACTORS.fieldNames())

    return seeds(prepared(docs, id_col, text_col), window, anchor).mapInArrow(run, FACTORS)


KEPT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])


def apply(rows: DataFrame, window: int) -> DataFrame:
    """Take out the words of the factors that grow from column ``seeds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                words = [t.encode().split() for t in batch.column("text").to_pylist()]
                removed, kept = [], []
                for own, found in zip(words, batch.column("seeds").to_pylist()):
                    if found:
                        gone = np.zeros(len(own), dtype=bool)
                        for start, n, *_ in extended(found, window):
                            gone[start : start + n] = True
                        kept.append(b" ".join([w for w, g in zip(own, gone.tolist()) if not g]))
                        removed.append(int(gone.sum()))
                    else:
                        kept.append(b" ".join(own))
                        removed.append(0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(list(map(len, words)), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                    names=KEPT.fieldNames(),
                )

    return rows.mapInArrow(run, KEPT)


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of each text without those of duplicate spans, as (doc_id, n_words, n_removed, kept).

    A word goes if a factor covers it, that is if a window of ``window`` words
    covers it that also starts in a document with a smaller id.  Rows that share an
    id don't count against each other; repeated rows get the same result.  A null id
    comes after all others; a null text has no words.  One row comes out for each
    row, none for an empty table; other columns are ignored.  A very long text is
    hashed in parts, and what is held at once is a few numbers for each word.
    """
    rows, since = prepared(docs, id_col, text_col), len(common.paths())
    found = common.concluded(seeds(rows, window, anchor), "seeds", since)
    return apply(rows.join(found, ["doc", "copy"], "left").select("doc_id", "text", "seeds"), window)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
