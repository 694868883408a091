"""Byte-level BPE encoding and decoding over overlapping chunks.

A text is cut into chunks that overlap.  Each chunk is pre-tokenised on its own,
from its first character on.  Where the pre-token boundaries of two neighbours
coincide inside their overlap, the two have resynchronised: from there on the
second chunk's boundaries are those of the whole text, because no branch of the
pattern looks back.  The chunks are stitched at such a point and the pieces
between the points are encoded.  Decoding concatenates the bytes of the ids.

Pre-tokens repeat often, so that each worker keeps the encoding of those it has
met, in a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

CHUNK, OVERLAP = 16_384, 1_024
#: A match is certain if this many characters follow it: the longest look ahead.
LOOKAHEAD = 3
MEMO = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


#: The usual pattern, for texts of these characters alone.  The standard engine
#: needs the letters spelled out but is faster; letters come first as no other
#: branch can start with what they start with.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = re.compile("[\\t-\\r -~\u00a1\u00ab\u00bb\u00bf-\u017f\u2013\u2014\u2018-\u201e\u2026\u20ac]*")
USUAL_PLAIN = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\\s\\w]|_)+|\\s+(?!\\S)|\\s+")


class PreTokens:
    """Boundaries of pre-tokens, found chunk by chunk."""

    def __init__(self, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        if overlap <= LOOKAHEAD or chunk <= overlap:
            raise ValueError("the overlap must be larger than the look-ahead and smaller than the chunk")
        self.general, self.chunk, self.overlap = regex.compile(pattern), chunk, overlap
        self.usual = pattern == USUAL

    def engine(self, text: str):
        return USUAL_PLAIN if self.usual and PLAIN.fullmatch(text) else self.general

    def _certain(self, text: str, start: int, end: int) -> list[int]:
        """Boundaries of text[start:end] that hold in the whole text if ``start`` is one."""
        last = end if end == len(text) else end - LOOKAHEAD
        part = text[start:end]
        found = [m.end() + start for m in self.engine(part).finditer(part)]
        while found and found[-1] > last:
            found.pop()
        return found

    def split(self, text: str) -> list[str]:
        if len(text) <= self.chunk + self.overlap:
            return self.engine(text).findall(text)
        spans = [(s, min(len(text), s + self.chunk + self.overlap)) for s in range(0, len(text), self.chunk)]
        marks = [self._certain(text, *span) for span in spans]
        out: list[int] = [0]
        k = 0
        while k < len(spans):
            out += [b for b in marks[k] if b > out[-1]]
            if k + 1 == len(spans) or spans[k][1] == len(text):
                break
            own, other = marks[k], set(marks[k + 1])
            at = next((b for b in own if b >= spans[k + 1][0] and b in other), None)
            if at is None:  # one pre-token fills the overlap: go on from the last certain boundary
                del out[next((i for i, b in enumerate(out) if b > (own[-1] if own else out[-1])), len(out)) :]
                start, end = out[-1], spans[k + 1][1]
                spans[k + 1] = (start, end)
                marks[k + 1] = self._certain(text, start, end)
            else:
                while out[-1] > at:
                    out.pop()
            k += 1
        return [text[a:b] for a, b in zip(out, out[1:])]


class Codec:
    """Encoder and decoder for a rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.base = tiktoken.Encoding("spindrift", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pre = PreTokens(pattern, chunk, overlap)
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.memo: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text; the same as encoding each pre-token by itself."""
        pieces, memo = self.pre.split(text), self.memo
        try:
            packed = b"".join([memo[p] for p in pieces])
        except KeyError:
            for p in pieces:
                if p not in memo:
                    memo[p] = array("I", self.base.encode_ordinary(p)).tobytes()
            packed = b"".join([memo[p] for p in pieces])
            if len(memo) > MEMO:
                memo.clear()
        return np.frombuffer(packed, dtype="<u4")

    def decode(self, ids: Iterable[int]) -> bytes:
        table = self.table
        return b"".join([table[i] for i in ids])


_codecs: dict[tuple, Codec] = {}


def codec(path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Codec:
    key = (path, pattern, chunk, overlap)
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(path), pattern, chunk, overlap)
    return _codecs[key]


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])


def _encoded(batches: Iterator[pa.RecordBatch], own: Codec) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.slices(whole, "text"):
            ids = [own.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([own.decode(i.tolist()) for i in ids], pa.binary())],
                names=["doc_id", "ids", "decoded"],
            )


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Ids (little-endian unsigned 32-bit) and decoded bytes of each row.

    One row comes out for each row, in no order, with the columns ``doc_id``,
    ``ids`` and ``decoded`` alone.  A null text counts as empty and gives no ids;
    a null id stays null; repeated rows give repeated results, an empty table none;
    other columns are ignored, whatever their names.  A very long text is cut into
    chunks, one after the other within its row, whose ids it gives whole.
    """

    return common.documents(docs, id_col, text_col).mapInArrow(lambda batches: _encoded(batches, codec(path, pattern, chunk, overlap)), ENCODED)


DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.frombuffer(b, dtype="<u4").tolist() for b in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() for i in ids]),
                pa.array([hashlib.sha256(b).hexdigest() for b in batch.column("decoded").to_pylist()]),
            ],
            names=DIGEST.fieldNames(),
        )


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of ids, digest of the decimal ids and digest of the decoded bytes, of what ``encode`` gives, in the same worker."""
    return common.documents(docs, id_col, text_col).mapInArrow(lambda batches: _digested(_encoded(batches, codec(path, pattern))), DIGEST)


def texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with each text encoded and decoded again; all columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for whole in batches:
            for batch in common.slices(whole, text_col):
                back = [None if t is None else own.decode(own.encode(t).tolist()).decode("utf-8") for t in batch.column(text_col).to_pylist()]
                i = batch.schema.get_field_index(text_col)
                yield batch.set_column(i, batch.schema.field(i), pa.array(back, batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
