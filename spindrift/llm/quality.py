"""Quality classifier: naive Bayes support vectors.

The indicators of a text's n-grams are scaled by the log-count ratio of the two
classes, and a linear model with hinge loss is fitted to them by dual coordinate
descent.  N-grams are pairs and triples of bytes and pairs of words, by hash; the
words of a pair are hashed as their difference, so that all pairs of one word
twice share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, hashing

TRIPLES, PAIRS = 1 << 16, 1 << 15
SIZE = (1 << 16) + TRIPLES + PAIRS
#: Bound of the labelled rows that are brought to the driver for the fit.
MAX_ROWS = 6000


def features(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Mask of the n-grams of one text, from its bytes and the hashes of its words."""
    seen = np.zeros(SIZE, dtype=bool)
    b = data.astype(np.uint32)
    if len(b) > 1:
        two = (b[:-1] << 8) | b[1:]
        seen[two] = True
        three = (two[:-1] << 8) | b[2:]
        seen[(1 << 16) + ((three * np.uint32(0x9E3779B1)) >> np.uint32(16))] = True
    if len(words) > 1:
        seen[(1 << 16) + TRIPLES + (hashing.mix(words[1:] - words[:-1]) & np.uint64(PAIRS - 1)).astype(np.int64)] = True
    return seen


def batch_features(texts: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = hashing.text_bytes(texts)
    starts, ends, first = hashing.words(data, offsets)
    words = hashing.word_hashes(data, starts, ends)
    for i in range(len(texts)):
        yield features(data[offsets[i] : offsets[i + 1]], words[first[i] : first[i + 1]])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, seen: np.ndarray) -> float:
        return float(self.weights[seen].sum() + self.bias)

    def score(self, seen: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(seen) + self.shift, -30, 30))))


def fit_hinge(rows, at: np.ndarray, values: np.ndarray, signs: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss over the rows ``at``; a row has ``values`` at its indices, scaled to unit length, and a bias."""
    w, bias = np.zeros(len(values)), 0.0
    alpha = np.zeros(len(at))
    squares = values**2
    norm = np.array([max(1e-12, squares[rows[r]].sum()) for r in at])
    scale = 1 / np.sqrt(norm)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(at)):
            r = rows[at[i]]
            x = values[r] * scale[i]
            gradient = signs[i] * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost[i])  # the row and its bias have squared length 2
            step = (new - alpha[i]) * signs[i]
            if step:
                w[r] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def fit(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0, cost: float = 1.0) -> Model:
    """Fit on indices of n-grams and labels 0 or 1; with one class alone the score is that class's smoothed share."""
    labels = np.asarray(labels)
    share = (labels.sum() + 1) / (len(labels) + 2)
    prior = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(SIZE), 0.0, 1.0, prior)
    p, q = np.full(SIZE, smooth), np.full(SIZE, smooth)
    for r, y in zip(rows, labels):
        (p if y else q)[r] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    signs = np.where(labels == 1, 1.0, -1.0)
    weight = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (len(labels) - labels.sum())))
    part = np.arange(len(rows)) % 5 == 4  # a fifth sets the scores' scale and is not fitted

    def solve(use: np.ndarray) -> tuple[np.ndarray, float]:
        at = np.flatnonzero(use)
        w, bias = fit_hinge(rows, at, ratio, signs[at], cost * weight[at])
        return w * ratio, bias

    def margins(w: np.ndarray, bias: float, at: np.ndarray) -> np.ndarray:
        # rows have unit length in the fit
        return np.array([w[rows[i]].sum() / np.sqrt(max(1e-12, (ratio[rows[i]] ** 2).sum())) + bias for i in at])

    slope, shift = 1.0, 0.0
    if len(set(labels[part].tolist())) == 2 and len(set(labels[~part].tolist())) == 2:
        slope, shift = calibrate(margins(*solve(~part), np.flatnonzero(part)), labels[part], np.ones(int(part.sum())))
    w, bias = solve(np.ones(len(rows), dtype=bool))
    return Scaled(w, bias, slope, shift, ratio**2)


@dataclass
class Scaled(Model):
    squares: np.ndarray | None = None

    def margin(self, seen: np.ndarray) -> float:
        return float(self.weights[seen].sum() / np.sqrt(max(1e-12, self.squares[seen].sum())) + self.bias)


def calibrate(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope (positive) and shift of a logistic curve over margins, by damped Newton steps with a mild prior."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = weight * (p - labels)
        h = weight * p * (1 - p) + 1e-9
        grad = np.array([g @ margins + 1e-2 * (a - 1), g.sum() + 1e-2 * b])
        hess = np.array([[h @ margins**2 + 1e-2, h @ margins], [h @ margins, h.sum() + 1e-2]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = max(1e-3, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def packed(seen: np.ndarray) -> bytes:
    """The n-grams of a text as their indices, or as bits if that is shorter: SIZE // 8 bytes at most, whatever the text's length."""
    at = np.flatnonzero(seen).astype("<u4")
    return at.tobytes() if at.nbytes < SIZE // 8 else np.packbits(seen).tobytes()


class Rows:
    """Indices of the n-grams of each text, of which bits are unpacked when they are looked at."""

    def __init__(self, grams: list[bytes]) -> None:
        self.grams = grams

    def __len__(self) -> int:
        return len(self.grams)

    def __getitem__(self, i: int) -> np.ndarray:
        if i >= len(self.grams):
            raise IndexError(i)
        own = self.grams[i]
        return np.frombuffer(own, dtype="<u4") if len(own) < SIZE // 8 else np.flatnonzero(np.unpackbits(np.frombuffer(own, dtype=np.uint8), count=SIZE))


ROWS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("grams", T.BinaryType())])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Model:
    """Fit on the labelled documents, or on the ``max_rows`` of them that a hash of the id puts first.

    The driver gets 20 kB for each row, however long its text: 123 MB at most by
    default.  A label other than 0 or 1, a null one too, is left out; of several labels for
    one id the highest counts.  Labels without a document are ignored.
    """
    chosen = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("label_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
        .filter("label_id is not null and y in (0, 1)")
        .groupBy("label_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    )
    rows = common.documents(docs, id_col, text_col)
    # at most max_rows ids and labels
    joined = rows.join(F.broadcast(chosen), rows.doc_id == chosen.label_id).select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                grams = [packed(f) for f in batch_features(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(grams, pa.binary())], names=ROWS.fieldNames())

    found = joined.mapInArrow(run, ROWS).orderBy(F.xxhash64("doc_id"), "doc_id", "grams").limit(max_rows).collect()
    return fit(Rows([r.grams for r in found]), np.array([r.y for r in found]))


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of each row, between 0 and 1.

    A null text is scored as an empty one, which gets the model's bias alone; a
    null id stays null; repeated rows get the same score, and an empty table gives
    no rows; other columns are not looked at.  A very long text is scored whole.
    """
    # the model has a fixed number of buckets
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in common.slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.score(f) for f in batch_features(batch.column("text"))], pa.float64())], names=SCORED.fieldNames())

    return common.documents(docs, id_col, text_col).mapInArrow(run, SCORED)


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32 of the id, as text, leaves 1 modulo 3; a null id is held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(True))
