"""Benchmark decontamination by q-gram lemma filtering.

An item is cut into overlapping regions: of a fixed size, and of 13 words from
each word on, so that any excerpt of 13 words holds one.  A text that holds a region of m bytes
with at most e edits shares at least m + 1 - q * (1 + e) of its q-grams, all on
diagonals that differ by e at most.  The q-grams that a text shares with the items
are counted in overlapping diagonal bands; bands that reach the bound are
verified by an alignment within the band.  Regions too short for an edit within
the bound are looked up as they are; items too short for a q-gram stand as whole
words.

Items are compared with documents in blocks of bounded size: a block of items
goes to every task, and each document passes through it whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, hashing

Q, REGION, ERRORS, BLOCK_BYTES = 12, 160, 0.06, 4 << 20
#: Any run of so many words of an item is a region as well.
WORDS = 13
#: Bytes of a text that are looked up at once, so that what is held for a byte stays bounded.
PIECE = 1 << 16
TABLE_BITS = 22
#: Upper case as lower case, and all white space as one kind.
NORMAL = np.arange(256, dtype=np.uint8)
NORMAL[65:91] += 32
NORMAL[hashing.SPACES] = 0x20


def normal(text: str) -> bytes:
    """Lower case of A-Z, with runs of white space as one space and none at the ends."""
    return b" ".join(NORMAL[np.frombuffer(text.encode(), dtype=np.uint8)].tobytes().split())


def edit_budget(m: int, errors: float, q: int) -> int:
    """Edits allowed in a region of m bytes: the share, as far as the q-gram bound stays positive."""
    return max(0, min(int(errors * m), (m + 1) // q - 1 - ((m + 1) % q == 0)))


def aligned(region: np.ndarray, text: np.ndarray, start: int, width: int, budget: int) -> int | None:
    """Fewest edits between the region and a part of the text, on the ``width`` diagonals from ``start``; None above the budget."""
    m, far = len(region), budget + 1
    padded = np.full(m + width, 256, dtype=np.int16)  # equals no byte
    low, high = max(0, start), min(len(text), start + m + width)
    if low < high:
        padded[low - start : high - start] = text[low:high]
    steps = np.arange(width)
    row = np.zeros(width, dtype=np.int64)
    for i in range(m):
        # diagonal k of row i + 1 ends at text byte start + i + k
        cost = row + (padded[i : i + width] != region[i])
        cost[:-1] = np.minimum(cost[:-1], row[1:] + 1)
        cost = np.minimum.accumulate(cost - steps) + steps  # bytes of the text left out
        row = np.minimum(cost, far)
        if row.min() > budget:
            return None
    return int(row.min())


#: Bytes of text that are aligned side by side, as far as one region does not need more.
SIDE = 1 << 16


def aligned_all(asked: list[tuple[np.ndarray, int, int, int]], text: np.ndarray) -> list[int | None]:
    """What ``aligned`` gives for each (region, start, width, budget), worked out side by side."""
    out: list[int | None] = [None] * len(asked)
    whole, left = text.tobytes(), []
    for i, (region, start, width, _) in enumerate(asked):
        # a copy without edits on one of the diagonals
        if region.tobytes() in whole[max(0, start) : max(0, start + len(region) + width - 1)]:
            out[i] = 0
        else:
            left.append(i)
    left.sort(key=lambda i: (asked[i][2], -len(asked[i][0])))
    at = 0
    while at < len(left):
        width, longest = asked[left[at]][2], len(asked[left[at]][0])
        part = [i for i in left[at : at + max(1, SIDE // (longest + width))] if asked[i][2] == width]
        at += len(part)
        sizes = np.array([len(asked[i][0]) for i in part])
        padded = np.full((longest + width, len(part)), 256, dtype=np.int16)  # equals no byte
        regions = np.zeros((longest, len(part)), dtype=np.int16)
        for n, i in enumerate(part):
            region, start, _, _ = asked[i]
            regions[: len(region), n] = region
            low, high = max(0, start), min(len(text), start + len(region) + width)
            if low < high:
                padded[low - start : high - start, n] = text[low:high]
        kind = np.int16 if longest + width < 1 << 14 else np.int64
        budgets = np.array([asked[i][3] for i in part], dtype=kind)
        steps = np.arange(width, dtype=kind)[:, None]
        least, here = np.zeros(len(part), dtype=kind), np.arange(len(part))
        row = np.zeros((width, len(part)), dtype=kind)
        for i in range(longest):
            cost = row + (padded[i : i + width, here] != regions[i, here])
            np.minimum(cost[:-1], row[1:] + 1, out=cost[:-1])
            cost -= steps
            row = np.minimum.accumulate(cost, axis=0)
            row += steps
            least[here] = row.min(axis=0)
            on = (least[here] <= budgets[here]) & (sizes[here] > i + 1)
            if not on.all():
                here, row = here[on], row[:, on]
                if not len(here):
                    break
        for n, i in enumerate(part):
            out[i] = int(least[n]) if least[n] <= budgets[n] else None
    return out


class Items:
    """A block of benchmark items, indexed by q-gram."""

    def __init__(self, items: list[tuple[int, bytes]], q: int, region: int, errors: float) -> None:
        self.q, self.errors = q, errors
        self.regions: list[tuple[int, int, np.ndarray, int]] = []  # item, place in it, bytes, budget
        for item, text in items:
            data = np.frombuffer(text, dtype=np.uint8)
            last = max(0, len(data) - region)
            starts = sorted({*range(0, last + 1, region // 2), last}) if len(data) else []
            spans = {(s, min(s + region, len(data))) for s in starts}
            begins = [0, *(np.flatnonzero(data == 0x20) + 1).tolist(), len(data) + 1]
            spans |= {(a, b - 1) for a, b in zip(begins, begins[WORDS:])}
            self.regions += [(item, a, data[a:b], edit_budget(b - a, errors, q)) for a, b in sorted(spans)]
        # items of fewer bytes than a q-gram, by their size
        self.short: dict[int, dict[bytes, list[int]]] = {}
        long = [r for r in self.regions if len(r[2]) >= q]
        short = [r for r in self.regions if 0 < len(r[2]) < q]
        for i, r in enumerate(short):
            self.short.setdefault(len(r[2]), {}).setdefault(r[2].tobytes(), []).append(len(long) + i)
        self.regions = long
        grams = [hashing.runs(hashing.prefix(hashing.BYTE[r[2]]), np.arange(len(r[2]) - q + 1), np.arange(q, len(r[2]) + 1)) for r in self.regions]
        flat = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(grams)), list(map(len, grams)))
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else owner
        order = np.argsort(flat, kind="stable")
        self.keys, self.owner, self.place = flat[order], owner[order], place[order]
        self.known, self.first, self.times = np.unique(self.keys, return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[self.known >> np.uint64(64 - TABLE_BITS)] = True
        self.size = np.array([len(r[2]) for r in self.regions], dtype=np.int64)
        self.budget = np.array([r[3] for r in self.regions], dtype=np.int64)
        self.bound = self.size + 1 - q * (1 + self.budget)
        #: What two neighbouring pieces of a text share, so that one of them holds all of a region and its band.
        self.overlap = int(self.size.max() + 6 * self.budget.max()) + 2 * q if long else 0
        self.regions = long + short

    def hits(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(region, place in the text, edits) of what the text holds; the best place for each region."""
        out: dict[int, tuple[int, int]] = {}
        step = max(PIECE, 2 * self.overlap)
        for start in range(0, max(1, len(data) - self.overlap), step):
            for r, place, edits in self._hits(data[start : start + step + self.overlap]):
                if r not in out or edits < out[r][1]:
                    out[r] = start + place, edits
        return [(r, *v) for r, v in out.items()] + self._short_hits(data)

    def _short_hits(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """Short items that stand in the text as whole words."""
        if not self.short or not len(data):
            return []
        edge = np.concatenate([[0], np.flatnonzero(data == 0x20) + 1, [len(data) + 1]])  # where words begin
        out, text = [], data.tobytes()
        for size, items in self.short.items():
            places: dict[bytes, int] = {}
            for at in edge[np.isin(edge + size + 1, edge)].tolist():
                places.setdefault(text[at : at + size], at)
            out += [(r, places[t], 0) for t, regions in items.items() if t in places for r in regions]
        return out

    def _hits(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        q = self.q
        if len(data) < q or not len(self.known):
            return []
        at = np.arange(len(data) - q + 1)
        grams = hashing.runs(hashing.prefix(hashing.BYTE[data]), at, at + q)
        at = np.flatnonzero(self.table[grams >> np.uint64(64 - TABLE_BITS)])
        found = np.searchsorted(self.known, grams[at])
        found[found == len(self.known)] = 0
        exact = self.known[found] == grams[at]
        at, found = at[exact], found[exact]
        if len(at) < int(self.bound.min()):
            return []
        times = self.times[found]
        text_at = np.repeat(at, times)
        entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.first[found], times)
        region = self.owner[entry]
        diagonal = text_at - self.place[entry] + self.size[region]  # never negative
        # bands of twice the budget and one more, each overlapping the next by half
        half = self.budget[region] + 1
        band = diagonal // half
        out: dict[int, tuple[int, int]] = {}
        span = int(band.max()) + 2
        keys = np.concatenate([region * span + band, (region * span + band - 1)[band > 0]])
        gram = np.concatenate([self.place[entry], self.place[entry][band > 0]])
        # each q-gram of the region counts once in a band
        both = np.unique(keys * (int(self.size.max()) + 1) + gram) // (int(self.size.max()) + 1)
        band_key, shared = np.unique(both, return_counts=True)
        enough = shared >= self.bound[band_key // span]
        bands: dict[int, list[int]] = {}
        for key in band_key[enough].tolist():
            bands.setdefault(key // span, []).append(key % span)
        n = 0
        while bands:  # the first band of each region, then the second of those that are left
            asked = []
            for r, own in bands.items():
                _, _, content, budget = self.regions[r]
                # the region's ends can lie off the diagonals of the shared q-grams by the budget
                asked.append((content, own[n] * (budget + 1) - len(content) - 2 * budget, 6 * budget + 2, budget))
            for r, (_, start, _, _), edits in zip(list(bands), asked, aligned_all(asked, data)):
                if edits is not None:
                    out[r] = (max(0, start), edits)
                if edits is not None or len(bands[r]) == n + 1:
                    del bands[r]
            n += 1
        return [(r, *v) for r, v in out.items()]


LEAKS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("copy", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("n_regions", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("edits", T.IntegerType())])


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """Normalised items in blocks of about ``limit`` bytes; only a block at a time is held."""
    block: list[tuple[int, bytes]] = []
    size = 0
    for row in benchmark.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t")).filter("t is not null").toLocalIterator():
        text = normal(row.t)
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((row.i, text))
        size += len(text)
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, region: int = REGION, errors: float = ERRORS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents that hold a region of an item, as (doc_id, copy, item_id, n_regions, place, edits).

    One row for each text and item: the regions of the item that were found, and
    place (in bytes of the normalised text, to within the band) and edits of the
    best.  ``copy`` is a hash of the text, which tells rows with one id apart.
    Items of fewer than ``q`` bytes must stand as whole words; empty or null ones
    match nothing; null texts hold nothing; null ids stay null.  Repeated items give
    a row each, repeated rows repeated results.  No items, or no documents, give no
    rows.  A very long text is looked up in overlapping pieces.  Other columns are
    ignored, whatever their names.
    """
    if region < 2 * q:
        raise ValueError("a region must hold two q-grams")
    rows = common.documents(docs, id_col, text_col).withColumn("copy", F.xxhash64("text"))
    out = None
    for block in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        # a block has a fixed bound in bytes, so that it can go to every task
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found = rows.mapInArrow(_search(shared, q, region, errors), LEAKS)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], LEAKS)


_last: tuple[list, tuple, Items] | None = None


def _prepared(shared, q: int, region: int, errors: float) -> Items:
    """The index of a block, made once in each worker; holding the block keeps its identity its own."""
    global _last
    block, options = shared.value, (q, region, errors)
    if _last is None or _last[0] is not block or _last[1] != options:
        _last = block, options, Items(block, q, region, errors)
    return _last[2]


def _search(shared, q: int, region: int, errors: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _prepared(shared, q, region, errors)
        for batch in (part for whole in batches for part in common.slices(whole, "text")):
            out: list[tuple] = []
            for doc_id, copy, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "copy", "text"))):
                best: dict[int, list] = {}
                for r, place, edits in items.hits(np.frombuffer(normal(text), dtype=np.uint8)):
                    old = best.setdefault(items.regions[r][0], [0, place, edits])
                    old[0] += 1
                    if edits < old[2]:
                        old[1:] = place, edits
                out += [(doc_id, copy, item, *v) for item, v in best.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f) for v, f in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()))], names=LEAKS.fieldNames())

    return run


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, region: int = REGION, errors: float = ERRORS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text holds no region of an item, with all their columns.

    What counts as held is that of ``leaks``; a null text holds nothing.  After every
    few blocks of items the rows are written, so that the chain of passes stays short.
    """
    for n, block in enumerate(item_blocks(benchmark, item_col, item_text_col, block_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.mapInArrow(_without(shared, q, region, errors, text_col), docs.schema)
        if n % 4 == 3:
            docs = common.staged(docs, "clean")
    return docs


def _without(shared, q: int, region: int, errors: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _prepared(shared, q, region, errors)
        for whole in batches:
            for batch in common.slices(whole, text_col):
                texts = batch.column(text_col).to_pylist()
                yield batch.filter(pa.array([not items.hits(np.frombuffer(normal(t or ""), dtype=np.uint8)) for t in texts], pa.bool_()))

    return run
