"""Benchmark decontamination by the q-gram lemma.

An occurrence of an item of ``m`` characters with at most ``k`` edits keeps at least
``m - q + 1 - k q`` of its q-grams, all within ``k + 1`` neighbouring diagonals (text
position less item position). Shared q-grams are counted in overlapping bands of
diagonals; a band that meets the bound is a region, and a banded alignment decides it.
Q-grams are compared by one byte a character, so the counts may exceed the number of
shared q-grams, but never fall short, and the filter loses nothing. An item too short for
the bound at its budget is aligned with the whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, released

Q = 8
MAX_ERROR = 0.06
#: Benchmark bytes that executors hold at once; a larger benchmark is taken in blocks of about this size.
BLOCK_BYTES = 8 << 20
_FAR = 1 << 20


def normal(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def codes_of(text: str) -> np.ndarray:
    """The characters as numbers."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def folded(text: str) -> bytes:
    """One byte for each character; different characters may share one."""
    if text.isascii():
        return text.encode()
    c = codes_of(text)
    return (c ^ (c >> np.uint32(8)) ^ (c >> np.uint32(16))).astype(np.uint8).tobytes()


def qgram_codes(text: bytes) -> np.ndarray:
    """A scrambled 64-bit code for each q-gram, one load of eight bytes."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), "<u8", text, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, free: bool) -> tuple[int, int]:
    """Least edits of all of ``item`` against text that ends at the returned position.

    Only cells whose text position less item position lies in ``low .. high`` count.
    ``free``: the occurrence may begin anywhere in the band, else at position 0.
    """
    width, m, n, far = high - low + 1, len(item), len(text), 1 << 28
    ramp = np.arange(width)
    col = low + ramp
    row = np.where((col < 0) | (col > n), far, 0 if free else col)
    padded = np.full(n + m + 2 * width + abs(low) + abs(high) + 2, -1, np.int32)
    shift = m + width + abs(low)
    padded = np.concatenate([np.full(shift, -1, np.int32), text.astype(np.int32), padded])
    for i in range(1, m + 1):
        left = i + low
        differs = padded[shift + left - 1 : shift + left - 1 + width] != item[i - 1]
        new = row + differs
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        if left <= 0 or left + width > n:
            j = left + ramp
            new[(j < 0) | (j > n)] = far
        new = np.minimum.accumulate(new - ramp) + ramp
        if left + width > n:
            new[left + ramp > n] = far
        row = new
    best = int(np.argmin(row))
    return int(row[best]), m + low + best


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], max_error: float = MAX_ERROR):
        self.items = [(i, t) for i, x in items if (t := normal(x))]
        self.k = np.array([int(max_error * len(t)) for _, t in self.items], np.int64)
        sizes = np.array([len(t) for _, t in self.items], np.int64)
        self.tau = sizes - Q + 1 - self.k * Q
        #: Items without a bound that tells anything.
        self.whole = np.flatnonzero(self.tau < 1).tolist()
        codes, owner, offset = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, (_, t) in enumerate(self.items):
            if self.tau[x] >= 1:
                c = qgram_codes(folded(t))
                codes.append(c)
                owner.append(np.full(len(c), x))
                offset.append(np.arange(len(c)))
        c = np.concatenate(codes)
        order = np.argsort(c, kind="stable")
        self.codes, self.owner, self.offset = c[order], np.concatenate(owner)[order], np.concatenate(offset)[order]
        self.bits = min(26, max(21, (8 * len(c)).bit_length()))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.codes >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.step = np.maximum(2 * self.k + 1, 16)

    def regions(self, text: bytes):
        """``(item, band)`` pairs whose count of shared q-grams meets the item's bound."""
        codes = qgram_codes(text)
        pos = np.flatnonzero(self.table[(codes >> np.uint64(64 - self.bits)).astype(np.int64)])
        if not len(pos) or not len(self.codes):
            return []
        own = codes[pos]
        first, last = np.searchsorted(self.codes, own, "left"), np.searchsorted(self.codes, own, "right")
        each = last - first
        total = int(each.sum())
        if not total:
            return []
        at = np.repeat(first - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(total)
        item, diagonal = self.owner[at], np.repeat(pos, each) - self.offset[at]
        often = np.bincount(item, minlength=len(self.items)) >= self.tau
        keep = often[item]
        if not keep.any():
            return []
        item, diagonal = item[keep], diagonal[keep]
        step, k = self.step[item], self.k[item]
        band = diagonal // step
        lower = diagonal - band * step < k
        key = np.concatenate([item * (1 << 40) + band + _FAR, item[lower] * (1 << 40) + band[lower] - 1 + _FAR])
        key, count = np.unique(key, return_counts=True)
        good = count >= self.tau[key >> 40]
        return [(int(x >> 40), int(x & ((1 << 40) - 1)) - _FAR) for x in key[good]]

    def matches(self, text: str | None):
        """``(item_id, start, end, edits, most edits)`` of the best occurrence of each item; places in characters of the normal form."""
        t = normal(text)
        best: dict[int, tuple] = {}
        if not t:
            return []
        data = None

        def numbers():
            nonlocal data
            if data is None:
                data = codes_of(t)
            return data

        def occurrence(x: int, start: int, end: int, low: int, high: int):
            """The best place of an item in part of the text, on diagonals from low to high."""
            item, k = self.items[x][1], int(self.k[x])
            at = t.find(item, start, end)
            if at >= 0:
                return 0, at, at + len(item)
            if not k:
                return None
            part, pattern = numbers()[start:end], codes_of(item)
            edits, stop = aligned(pattern, part, low, high, True)
            if edits > k:
                return None
            _, length = aligned(pattern[::-1], part[:stop][::-1], -k, k, False)
            return edits, start + stop - length, start + stop

        for x, band in self.regions(folded(t)):
            if x in best and best[x][0] == 0:
                continue
            k, step = int(self.k[x]), int(self.step[x])
            start = max(0, band * step - k)
            end = min(len(t), band * step + step + 2 * k + len(self.items[x][1]))
            found = occurrence(x, start, end, band * step - k - start, band * step + step + 2 * k - start)
            if found and (x not in best or found < best[x]):
                best[x] = found
        for x in self.whole:
            k = int(self.k[x])
            if found := occurrence(x, 0, len(t), -k, max(len(t) - len(self.items[x][1]) + k, -k)):
                best[x] = found
        return [(self.items[x][0], s, e, edits, int(self.k[x])) for x, (edits, s, e) in sorted(best.items())]


def blocks_of(benchmark: DataFrame, max_error: float, block_bytes: int):
    """Indexes of the benchmark, block by block; one block while its texts have at most ``block_bytes``."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Index([(r[0], r[1]) for r in part.distinct().collect()], max_error)


FOUND = "doc_id long, item_id long, start_char long, end_char long, edits int, max_edits int"


def matches(docs: DataFrame, benchmark: DataFrame, max_error: float = MAX_ERROR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, start_char, end_char, edits, max_edits``: each item that a document holds, at its best place.

    Both sides are compared in lower case with white space runs as one space; an item
    may have up to ``max_error`` of its characters in edits. Null or empty texts on either
    side match nothing; ids may be null; repeated documents each give rows, repeated
    items (same id and text) count once; empty tables give no rows; other columns are
    left out. A map over the documents: nothing is shuffled.
    """
    spark = docs.sparkSession
    out = None
    for index in blocks_of(benchmark, max_error, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for batch in in_slices(batches, 512):
                rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in index.matches(t)]
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.int32()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "start_char", "end_char", "edits", "max_edits"])

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, max_error: float = MAX_ERROR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that hold no benchmark item.

    Null and empty texts and null ids stay, rows that repeat stay or go together, and an
    empty benchmark drops nothing.
    """
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for index in blocks_of(benchmark, max_error, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for batch in in_slices(batches, 512):
                yield batch.filter(pa.array([not index.matches(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(released(run), docs.schema)
    return docs
