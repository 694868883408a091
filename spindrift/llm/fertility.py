"""Quality rules from tokeniser fertility.

Public vocabularies say how well a text fits the languages they were made for.
Three measures are taken over all words of a text: characters per token of a
byte-level vocabulary, the share of byte-fallback pieces of a piece vocabulary,
and the entropy of the byte-level tokens.  Each language, or else script, has a
band for each measure; a text outside one of them is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, common, hashing

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Lowest and highest characters per token, highest byte-fallback share, and
#: lowest entropy as a part of the highest that so many tokens can have.
#: The bands of the languages were set on labelled rows; those of the scripts
#: are wide, and hold for languages without a band of their own.
BANDS = {
    "en": (2.02, 8.0, 0.05, 0.40),
    "fr": (1.87, 8.0, 0.05, 0.40),
    "de": (2.04, 8.0, 0.05, 0.40),
    "es": (1.905, 8.0, 0.05, 0.40),
    "latin": (1.5, 9.0, 0.10, 0.35),
    "cyrillic": (0.9, 9.0, 0.20, 0.35),
    "other": (0.3, 9.0, 0.95, 0.30),
}


def script(text: str) -> str:
    """The script of most letters, as far as the bands tell them apart."""
    latin = cyrillic = other = 0
    if text.isascii():
        return "latin"
    for c in set(text):
        if c.isalpha():
            n, at = text.count(c), ord(c)
            latin, cyrillic, other = latin + n * (at < 0x250), cyrillic + n * (0x400 <= at < 0x530), other + n * (at >= 0x250 and not 0x400 <= at < 0x530)
    return "latin" if latin >= max(cyrillic, other) else "cyrillic" if cyrillic >= other else "other"


class Meter:
    """Measures of one text by two public vocabularies."""

    def __init__(self, ranks_path: str, pattern: str, pieces_path: str) -> None:
        self.codec = bpe.codec(ranks_path, pattern)
        pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        #: A character falls back to its bytes if it is no piece by itself.
        self.known = {p for p in map(pieces.id_to_piece, range(pieces.get_piece_size())) if len(p) == 1} | set(SPACES)

    def fertility(self, text: str, word_chars: int) -> tuple[float, float, float]:
        """Characters per token, byte-fallback share, and entropy as a part of its highest value."""
        ids = self.codec.encode(text)
        if not len(ids) or not word_chars:
            return 0.0, 0.0, 0.0
        p = np.bincount(ids)
        p = p[p > 0] / len(ids)
        unknown = set(text) - self.known
        fallback = sum(text.count(c) * len(c.encode()) for c in unknown)
        return word_chars / len(ids), fallback / len(text.encode()), float(-(p @ np.log2(p))) / np.log2(len(ids)) if len(ids) > 1 else 0.0


def repeated(keys: np.ndarray, first: np.ndarray, width: int = 3) -> np.ndarray:
    """For each text, the words in windows of ``width`` words that it has twice or more.

    keys: hashes of all words; first: for each text the index of its first word,
    with the number of words at the end.
    """
    n = len(keys) - width + 1
    counts = np.zeros(len(keys) + 1, dtype=np.int64)
    if n > 0:
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        starts = np.flatnonzero(doc[:n] == doc[width - 1 :])
        window = hashing.runs(hashing.prefix(keys), starts, starts + width)
        window = hashing.mix(window ^ hashing.mix(doc[starts].astype(np.uint64)))
        order = np.argsort(window)
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(starts), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        found = starts[twice]
        marks = np.bincount(found, minlength=len(keys) + 1) - np.bincount(found + width, minlength=len(keys) + 1)
        counts[1:] = np.cumsum(np.cumsum(marks)[:-1] > 0)
    return np.diff(counts[first])


MEASURED = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField(n, T.DoubleType()) for n in ("chars_per_token", "fallback_share", "token_entropy")]
)


def measure_batch(meter: Meter, batch: pa.RecordBatch, text_col: str, langs: list[str | None]) -> list[tuple]:
    """The columns of MEASURED after the first, for each row."""
    column = batch.column(text_col).fill_null("")
    _, _, keys, first = hashing.word_table(*hashing.text_bytes(column))
    repeats = repeated(keys, first)
    out = []
    for text, lang, n, repeat in zip(column.to_pylist(), langs, np.diff(first).tolist(), repeats.tolist()):
        word_chars = len(text) - sum(map(text.count, SPACES))
        seen: set[str] = set()
        dups = 0
        for line in text.split("\n"):
            if line.strip(SPACES):
                dups += line in seen
                seen.add(line)
        failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
        per_token, fallback, entropy = meter.fertility(text, word_chars)
        low, high, most, least = BANDS[lang if lang in BANDS else script(text)]
        kept = not failed and low <= per_token <= high and fallback <= most and entropy >= least
        out.append((n, word_chars, sum(map(text.count, SYMBOLS)), dups, repeat, failed, kept, per_token, fallback, entropy))
    return out


_meters: dict[tuple, Meter] = {}


def meter(*paths: str) -> Meter:
    if paths not in _meters:
        _meters[paths] = Meter(*paths)
    return _meters[paths]


def measure(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Counts, fertility measures and verdict of each row.

    One row comes out for each row.  A null text has no words and so fails the
    base rules; a null id stays null; a null or unknown language falls back to
    the script of the text.  Repeated rows give repeated results, an empty table
    none.  Columns other than those named are ignored.  A very long text is measured
    whole.  White space never counts as byte fallback, though the piece vocabulary
    writes line feeds and tabs as bytes.
    """
    lang = F.col(f"`{lang_col}`") if lang_col and lang_col in docs.columns else F.lit(None)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), lang.cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = meter(ranks_path, pattern, pieces_path)
        for whole in batches:
            for batch in common.slices(whole, "text"):
                found = measure_batch(own, batch, "text", batch.column("lang").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, f.type) for v, f in zip(zip(*found), OUT))], names=MEASURED.fieldNames())

    return rows.mapInArrow(run, MEASURED)


OUT = [pa.field("", t) for t in [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3]


def keep(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose verdict is to keep them, with all their columns.

    The verdict is that of ``measure``: a null or empty text is not kept, repeated
    rows share their fate, a missing language column leaves the script to decide.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = meter(ranks_path, pattern, pieces_path)
        for whole in batches:
            for batch in common.slices(whole, text_col):
                langs = batch.column(lang_col).to_pylist() if lang_col in batch.schema.names else [None] * batch.num_rows
                yield batch.filter(pa.array([row[6] for row in measure_batch(own, batch, text_col, langs)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
