"""Token ids in files of fixed-width bits.

File image, little-endian: 8 bytes magic; unsigned 32-bit width in bits and ids a
block; unsigned 64-bit numbers of ids, documents and blocks; for each document
its id (signed 64 bit, the least value for null) and its first id's place
(unsigned 64 bit), with the number of ids at the end; for each block its place
in the payload (unsigned 64 bit); the payload.  A block holds the same number of
ids, lowest bit first, so that any range of ids is unpacked alone.

Images are rows of a table, written by Spark into the shared folder: a lost
executor's files are written again, and any file system that Spark knows will do.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import re
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from . import common

MAGIC, HEADER = b"SPINPACK", struct.Struct("<8sIIQQQ")
BLOCK, FILE_IDS, PARTITION_CHARS, MOST_PARTITIONS, MEMO = 4096, 1 << 20, 16 << 20, 1 << 15, 500_000
NULL_ID = -(2**63)


def width(vocabulary: int) -> int:
    """The least bits that hold every id."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):  # the same bytes, without going by single bits
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1 == 1, axis=None, bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_image(doc_ids: list[int | None], docs: list[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    if block % 8:
        raise ValueError("a block must fill whole bytes")
    ids = np.concatenate([np.zeros(0, dtype=np.uint32), *docs])
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    blocks = [pack_bits(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    places = np.cumsum([0, *map(len, blocks)])[: len(blocks)]
    starts = np.cumsum([0, *map(len, docs)])
    return b"".join(
        [
            HEADER.pack(MAGIC, bits, block, len(ids), len(docs), len(blocks)),
            np.array([NULL_ID if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
            starts.astype("<u8").tobytes(),
            places.astype("<u8").tobytes(),
            *blocks,
        ]
    )


class Image:
    """Random access to the ids of a file image."""

    def __init__(self, data: bytes) -> None:
        magic, self.bits, self.block, self.n, docs, blocks = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        at = HEADER.size
        self.doc_ids = np.frombuffer(data, dtype="<i8", count=docs, offset=at)
        self.starts = np.frombuffer(data, dtype="<u8", count=docs + 1, offset=at + 8 * docs).astype(np.int64)
        self.places = np.frombuffer(data, dtype="<u8", count=blocks, offset=at + 16 * docs + 8).astype(np.int64)
        self.payload = memoryview(data)[at + 16 * docs + 8 + 8 * blocks :]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end); only the blocks that hold them are unpacked."""
        if not 0 <= start <= end <= self.n:
            raise IndexError(f"{start}:{end} is outside of 0:{self.n}")
        if start == end:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        n = min(self.n, (last + 1) * self.block) - first * self.block
        return unpack_bits(self.payload[self.places[first] :], n, self.bits)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


#: Characters that normal form C leaves alone, whose lower case depends on
#: nothing else, and that both pattern engines class alike.
PLAIN = re.compile("[\\t-\\r -~¡-įı-ſЀ-џ–—‘-„…€一-龥]*")


class WordBpe:
    """Ids as the tokenizers library gives them, with a bounded table of the pre-tokens met.

    The table serves texts of plain characters, for a tokenizer that drops white
    space, lower-cases and splits by the usual word pattern.  Any other text or
    tokenizer goes through the library whole.
    """

    SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    #: The same for plain texts in lower case, letters first.
    FAST = regex.compile("\\p{L}+|\\p{N}|'(?:s|t|re|ve|m|ll|d)|[^\\s\\p{L}\\p{N}]+")
    ASCII = re.compile("[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-z0-9]+")

    def __init__(self, path: str) -> None:
        import json

        with open(path, encoding="utf-8") as file:
            text = file.read()
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.encode_special_tokens = True
        self.vocabulary = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        spec = json.loads(text)
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.tabled = normal == ["NFC", "Replace", "Lowercase"] and (split.get("pattern") or {}).get("Regex") == self.SPLIT
        self.memo: dict[str, bytes] = {}

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        mapped = "".join([BYTES[b] for b in piece.encode()])
        return array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers in little-endian order."""
        if not (self.tabled and PLAIN.fullmatch(text)):
            return self.library(text)
        memo, text = self.memo, text.lower()
        pieces = (self.ASCII if text.isascii() else self.FAST).findall(text)
        try:
            return b"".join([memo[p] for p in pieces])
        except KeyError:
            for p in pieces:
                if p not in memo:
                    memo[p] = self._piece(p)
            out = b"".join([memo[p] for p in pieces])
            if len(memo) > MEMO:
                memo.clear()
            return out


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


BYTES = _byte_letters()
_models: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    if path not in _models:
        _models[path] = WordBpe(path)
    return _models[path]


FILES = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("image", T.BinaryType())])


def write(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS, block: int = BLOCK) -> DataFrame:
    """Encode every text, append ``end_id`` and write file images in ascending order of document id.

    Returns the table of files, already written: ``shard`` and ``part`` give
    their order.  Ties of the id are ordered by a hash of the text, so that many rows of one id are not one task's; a null id comes last and is
    read back as null; a null text counts as empty, so gives the end id alone.
    An empty table gives no files; other columns are ignored, whatever their names.
    A very long text is encoded whole and stands in one file.
    """
    rows = common.documents(docs, id_col, text_col).withColumn("key", common.id_order("doc_id"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = min(MOST_PARTITIONS, max(1, -(-chars // PARTITION_CHARS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = model(path), TaskContext.get().partitionId()
        bits = width(max(own.vocabulary, end_id + 1))
        end = struct.pack("<I", end_id)
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        part = total = 0

        def flush() -> pa.RecordBatch:
            image = write_image(doc_ids, ids, bits, block)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([total], pa.int64()), pa.array([image], pa.binary())], names=FILES.fieldNames())

        for whole in batches:
            for batch in common.slices(whole, "text"):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    doc_ids.append(doc_id)
                    ids.append(np.frombuffer(own.encode(text) + end, dtype="<u4"))
                    total += len(ids[-1])
                    if total >= file_ids:
                        yield flush()
                        doc_ids, ids, part, total = [], [], part + 1, 0
        if doc_ids:
            yield flush()

    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie", "text").select("doc_id", "text")
    return common.staged(ordered.mapInArrow(run, FILES), "packed")


READ = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("place", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], Iterator[bytes]]]:
    """For each image: the columns of its documents but for the ids, and the ids of each document, unpacked as they are asked for."""
    for whole in batches:
        for batch in (whole.slice(i, 1) for i in range(whole.num_rows)):
            image = Image(batch.column("image")[0].as_py())
            n = len(image.doc_ids)
            columns = [
                pa.array([batch.column("shard")[0].as_py()] * n, pa.int32()),
                pa.array([batch.column("part")[0].as_py()] * n, pa.int32()),
                pa.array(image.doc_ids, pa.int64(), mask=image.doc_ids == NULL_ID),
                pa.array(image.starts[:-1], pa.int64()),
                pa.array(np.diff(image.starts), pa.int64()),
            ]
            yield columns, (image.document(i).astype("<u4").tobytes() for i in range(n))


def read(files: DataFrame) -> DataFrame:
    """The documents of file images: id, place in the file, number of ids, and the ids as unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, ids in _documents(batches):
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(ids), pa.binary())], names=READ.fieldNames())

    return files.mapInArrow(run, READ)


def starts(files: DataFrame) -> DataFrame:
    """For each file, the ids in all files before it.

    Only numbers of ids are summed: first by shard, of which there are
    MOST_PARTITIONS at most, then by file within a shard.
    """
    sizes = files.select("shard", "part", "n_ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("ids")).select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(shards, "shard").select("shard", "part", (F.col("shard_start") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("file_start"))


SUMMED = T.StructType([*READ.fields[:-1], T.StructField("ids_crc32", T.LongType())])


def digests(files: DataFrame) -> DataFrame:
    """Per document: id, place of its first id among all, number of ids, and crc32 of the ids read back.

    Images are read and summed by one worker a task, so that an executor has no more
    workers than tasks and no ids travel between them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, ids in _documents(batches):
            yield pa.RecordBatch.from_arrays([*columns, pa.array(map(zlib.crc32, ids), pa.int64())], names=SUMMED.fieldNames())

    rows = files.mapInArrow(run, SUMMED)
    return rows.join(starts(files), ["shard", "part"]).select("doc_id", (F.col("file_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
