"""Language-model scores by a probabilistic suffix tree over words.

Every node is a context (the last words before a symbol) with a next-symbol distribution.
The root holds all training tokens, additively smoothed. A longer context is a node if it
occurs ``LEAST_CONTEXT`` times, its parent (the context without its first word) is a node,
and it passes a divergence test: the training tokens that follow it must gain at least
``LEAST_GAIN`` nats (and ``GAIN_PER_ENTRY`` per entry) over the parent. A node keeps the
symbols seen ``LEAST_ENTRY`` times after it, discounted by ``DISCOUNT``; the mass left over
is spread like the parent, so every distribution sums to one. A symbol is scored in the
longest context that is a node. Depth grows until no context passes.

All counts are over all training documents, summed in Spark, and nodes and entries are
tables there. The logarithm of a score is a sum of values, one for the word, one for each
node on the way down and one for each entry met, so scoring looks up keys and adds. Only
the ``SHIPPED`` most frequent values (and ``SHIPPED_WORDS`` words) are sent to executors;
the others are joined. Bitmaps of bounded size tell which keys can't be in a table; a key
they let through in error finds no row, so they change no result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, as_bytes, collected, dropped, give_back, in_slices, mix, released, shuffles_let_go, written

SHIPPED_WORDS = 1_000_000
SHIPPED = 2_000_000
LEAST_CONTEXT = 8
LEAST_ENTRY = 2
DISCOUNT = 0.5
LEAST_GAIN = 6.0
GAIN_PER_ENTRY = 1.0
ALPHA = 0.1
#: The end of a text, as a token; no word has a space.
END = int(np.uint64(xxhash.xxh3_64_intdigest(b" end")).astype(np.int64))
#: What stands before the first word of a text.
START = int(np.uint64(xxhash.xxh3_64_intdigest(b" start")).astype(np.int64))
_KEYS = 4_000_000
#: Rows of keys up to which a table is sent to all executors.
BROADCAST_ROWS = 500_000
_MOST_BITS = 1 << 28
_PIECES = 256
#: Parts in which documents are scored, so that the rows that are joined lie on disk for one part at a time.
_PARTS = 2


def tokens(text: bytes, hasher: WordHasher) -> np.ndarray:
    return np.append(hasher(text.lower().split()).view(np.int64), END)


class Numbered:
    """Local numbers of words, and their fingerprints; starts anew beyond ``limit`` words."""

    def __init__(self, limit: int = 500_000, make=None):
        self.limit, self.make = limit, make or (lambda prints: None)
        self.reset()

    def reset(self):
        own = self

        class Seen(dict):
            def __missing__(self, word):
                self[word] = n = len(own.prints)
                own.prints.append(xxhash.xxh3_64_intdigest(word))
                return n

        self.prints, self.seen = [END & (2**64 - 1)], Seen({None: 0})

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of texts, each text with 0 for its end, and where each begins."""
        found, words, sizes = [np.zeros(0, np.int64)], [], [0]
        for text in texts:
            own = text.lower().split()
            own.append(None)
            sizes.append(len(own))
            words += own
            if len(words) > 100_000:
                found.append(np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words)))
                words = []
        found.append(np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words)))
        return np.concatenate(found), np.cumsum(sizes)

    @property
    def full(self) -> bool:
        return len(self.prints) > self.limit

    def fingerprints(self) -> np.ndarray:
        return np.array(self.prints, np.uint64).view(np.int64)


def packed_counts(docs: DataFrame, rows, width: int, least: int, total: int, finish, schema: str) -> DataFrame:
    """Distinct rows that occur ``least`` times, with their counts, as ``finish(columns, counts)`` gives them.

    ``rows`` makes tuples of ``width`` arrays from batches of ``docs``. Each task counts
    what it has, a bounded number of rows at a time, and sends the distinct ones as
    packed arrays, dealt out by their fingerprints; there is one group of them for each
    half million of ``total`` rows. A row that occurs everywhere is one row from each pass.
    """
    bits = max(8, math.ceil(math.log2(max(1, total / 500_000))))

    def keys(columns):
        out = mix(columns[0])
        for c in columns[1:]:
            out = mix(out + mix(c ^ np.uint64(0xD1B54A32D192ED03)))
        return out

    def send(batches):
        held, size = [], 0

        def flush():
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            key = keys(columns)
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            columns, n = [c[order[first]] for c in columns], np.diff(np.append(first, len(key))).astype(np.uint32)
            key = key[first]
            cuts = np.searchsorted(key, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(key)]
            group, data, counts = [], [], []
            for g, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if i < j:
                    group.append(g)
                    data.append(b"".join(c[i:j].tobytes() for c in columns))
                    counts.append(n[i:j].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(data, pa.binary()), pa.array(counts, pa.binary())], ["g", "data", "counts"])

        for x in rows(batches):
            held.append(x)
            size += len(x[0])
            if size >= _KEYS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def add(table):
        n = [np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]
        data = [np.frombuffer(x, np.uint64).reshape(width, -1) for x in table.column("data").to_pylist()]
        columns, n = np.concatenate(data, axis=1), np.concatenate(n).astype(np.int64)
        key = keys(columns)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n, columns = np.add.reduceat(n[order], first), columns[:, order[first]]
        good = n >= least
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in finish(list(columns[:, good]), n[good])], names)

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.mapInArrow(released(send), "g int, data binary, counts binary").groupBy("g").applyInArrow(add, schema)


def word_counts(docs: DataFrame) -> DataFrame:
    """``k, n``: fingerprints and counts of all tokens of ``text``."""

    def run(batches):
        words, counts = Numbered(), np.zeros(0, np.int64)

        def batch_of():
            seen = counts > 0
            return pa.RecordBatch.from_arrays([pa.array(words.fingerprints()[: len(counts)][seen]), pa.array(counts[seen])], ["k", "n"])

        for batch in in_slices(batches, 256):
            ids, _ = words(as_bytes(batch.column(0)))
            new = np.bincount(ids, minlength=len(words.prints))
            new[: len(counts)] += counts
            counts = new
            if words.full:
                yield batch_of()
                words.reset()
                counts = np.zeros(0, np.int64)
        if len(counts):
            yield batch_of()

    return docs.select("text").mapInArrow(released(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def _find(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places of ``of`` in sorted ``keys``; -1 where absent."""
    if not len(keys):
        return np.full(len(of), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return np.where(keys[at] == of, at, -1)


class Index:
    """Finds keys, whose bits are as good as random, among sorted ones, by their first bits."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.shift, self.size = np.uint64(64 - bits), len(keys)
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, of: np.ndarray) -> np.ndarray:
        """Places of ``of``; -1 where absent."""
        out, own, at = np.full(len(of), -1, np.int64), np.arange(len(of)), self.first[of >> self.shift].astype(np.int64)
        while len(own):
            here = self.keys[at]
            good = (here == of) & (at < self.size)
            out[own[good]] = at[good]
            on = here < of
            own, of, at = own[on], of[on], at[on] + 1
        return out


#: Contexts are named by a sum over their words, the last one first, each times a power of this.
_POWER = 0x9E3779B97F4A7C15


def _times(word: np.ndarray, depth: int) -> np.ndarray:
    """What a word adds to the sum of a context that it is ``depth`` words back in."""
    return word * np.uint64(pow(_POWER, depth, 1 << 64))


def _key(sums: np.ndarray, depth: int) -> np.ndarray:
    """Keys of contexts of a depth, from their sums."""
    return mix(sums + np.uint64(depth))


def _entry(context: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Keys of a word after a context, given those of the word after the next shorter context (at the root, the word)."""
    return mix(context + mix(above ^ np.uint64(0xD1B54A32D192ED03)))


class Bits:
    """A bitmap of keys: false for most of the keys that a table does not have, never for one that it has.

    Executors make it in up to ``_PIECES`` pieces, so that the driver is sent its bytes and no rows of keys.
    """

    def __init__(self, table: DataFrame, key: str = "k"):
        size = 64
        while size < min(_MOST_BITS, 16 * table.count()):
            size *= 2
        self.mask = size // 64 - 1
        mask, width = self.mask, max(1, size // 64 // _PIECES)
        place = F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(mask).cast("long"))

        def piece(rows):
            k = rows.column("k").to_numpy().view(np.uint64)
            at, words = ((k >> np.uint64(6)) & np.uint64(mask)).astype(np.int64), np.zeros(width, np.uint64)
            np.bitwise_or.at(words, at % width, np.uint64(1) << (k & np.uint64(63)))
            return pa.table({"piece": pa.array(at[:1] // width, pa.int64()), "words": pa.array([words.tobytes()], pa.binary())})

        with shuffles_let_go(table.sparkSession):
            rows = table.select(F.shiftright(place, width.bit_length() - 1).alias("piece"), F.col(key).alias("k")).groupBy("piece").applyInArrow(piece, "piece long, words binary").toArrow()
        self.words = np.zeros(mask + 1, np.uint64)
        for at, words in zip(rows.column(0).to_pylist(), (x for c in rows.column(1).chunks for x in c), strict=True):
            self.words[at * width : (at + 1) * width] = np.frombuffer(words.as_buffer(), np.uint64)
        del rows
        give_back()

    def has(self, keys: np.ndarray) -> np.ndarray:
        return (self.words[(keys >> np.uint64(6)) & np.uint64(self.mask)] >> (keys & np.uint64(63))) & np.uint64(1) > 0


def _sent(table: DataFrame) -> Broadcast:
    """The bitmap of a table's keys, sent to executors once; the driver keeps none of it, nor of what came before."""
    bits = table.sparkSession.sparkContext.broadcast(Bits(table))
    collected(table.sparkSession)
    return bits


class Places:
    """The words of documents, each with ``START`` before it, and their contexts."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray):
        n = np.diff(offsets)
        self.words = np.insert(words, offsets[:-1], np.int64(START).astype(np.uint64))
        #: Where each word of the documents is among these, and how many it has before it in its document.
        self.at = np.arange(len(words)) + np.repeat(np.arange(len(n)), n) + 1
        self.before = np.arange(len(words)) - np.repeat(offsets[:-1], n) + 1

    def sums(self, at: np.ndarray, depth: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j in range(1, depth + 1):
            out += _times(self.words[at - j], j)
        return out

    def entries(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Keys of the words at places after their contexts of ``depth`` words."""
        out, sums = self.words[at], np.zeros(len(at), np.uint64)
        for j in range(1, depth + 1):
            sums += _times(self.words[at - j], j)
            out = _entry(_key(sums, j), out)
        return out

    def within(self, node: Bits | None, depth: int):
        """``at, sums, key``: places whose context of ``depth`` words can be a node (any, at the root) and is followed by one more word back."""
        at = self.at[self.before > depth]
        sums = self.sums(at, depth)
        if not depth:
            return at, sums, sums
        key = _key(sums, depth)
        good = node.has(key)
        return at[good], sums[good], key[good]


class Tree:
    """What executors are sent: frequent words and frequent values. ``tables`` has all nodes and entries, ``nodes`` and ``entries`` their bitmaps, which are sent apart."""

    def __init__(self, heavy: np.ndarray, counts: np.ndarray, total: int, distinct: int, docs: int = 0):
        self.heavy, self.total, self.distinct = heavy, total, distinct
        self.start = len(heavy)
        self.counts = np.append(counts, docs)
        self.root = (counts + ALPHA) / (total + ALPHA * (distinct + 1))
        self.nodes: list[Broadcast] = []
        self.entries: list[Broadcast] = []
        self.tables: list[tuple[DataFrame, DataFrame]] = []
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)
        self.index: Index | None = None

    def __getstate__(self):
        return self.__dict__ | {"tables": [], "nodes": [], "entries": [], "index": None}

    def all_values(self) -> DataFrame | None:
        """``k, n, v`` of all nodes and entries."""
        out = None
        for pair in self.tables:
            for t in pair:
                t = t.select("k", "n", "v")
                out = t if out is None else out.unionByName(t)
        return out

    def _keys_of(self, depth: int) -> np.ndarray:
        return self.tables[depth - 1][1].select("k").toArrow().column(0).to_numpy() if depth <= len(self.tables) else np.zeros(0, np.int64)

    @property
    def keys1(self) -> np.ndarray:
        return self._keys_of(1)

    @property
    def keys2(self) -> np.ndarray:
        return self._keys_of(2)

    def _values(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of keys as far as they are here, and which are not."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.ones(len(keys), bool)
        if self.index is None:
            self.index = Index(self.keys)
        at = self.index.find(keys)
        return np.where(at >= 0, self.values[at], 0.0), at < 0

    def gains(self, words: np.ndarray, offsets: np.ndarray, bitmaps: list[tuple[Broadcast, Broadcast]]):
        """Sums of values below the root for each place, and places and keys that are to be joined; ``bitmaps`` of nodes and entries by depth."""
        total, places, keys = np.zeros(len(words)), [], []
        p = Places(words, offsets)
        own, above = np.arange(len(words)), words
        sums = np.zeros(len(words), np.uint64)
        for depth, (node, entry) in enumerate(bitmaps, 1):
            node, entry = node.value, entry.value
            far = p.before[own] >= depth
            own, sums, above = own[far], sums[far], above[far]
            at = p.at[own]
            sums = sums + _times(p.words[at - depth], depth)
            key = _key(sums, depth)
            good = node.has(key)
            own, sums, key = own[good], sums[good], key[good]
            above = _entry(key, above[good])
            kept = entry.has(above)
            for k, of in ((key, own), (above[kept], own[kept])):
                v, open_ = self._values(k)
                total[of] += v
                places.append(of[open_])
                keys.append(k[open_])
        none = np.zeros(0, np.int64)
        return total, np.concatenate([none, *places]), np.concatenate([none.view(np.uint64), *keys])

    def score(self, word: np.ndarray, before: np.ndarray, before2: np.ndarray) -> np.ndarray:
        """Natural log probabilities given the last word and the one before it, all by number (-1: another word, of which the mass left over is given)."""
        print_of = np.append(self.heavy, [START, 0]).view(np.uint64)
        out = np.where(word >= 0, np.log(self.root[np.maximum(word, 0)]), 0.0)
        sums, good, entry = np.zeros(len(word), np.uint64), np.ones(len(word), bool), print_of[word]
        for depth, x in enumerate((before, before2), 1):
            good &= x >= 0
            sums = sums + _times(print_of[x], depth)
            key = _key(sums, depth)
            entry = _entry(key, entry)
            at, e = _find(self.keys, key), _find(self.keys, entry)
            good &= at >= 0
            out += np.where(good, self.values[at], 0.0) + np.where(good & (e >= 0) & (word >= 0), self.values[e], 0.0)
        return out


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and offsets of a column ``ids``; every document has a number (its end)."""
    _, at, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.int32).astype(np.int64) if len(column) else np.zeros(0, np.int64)
    return values, (offsets - offsets[0]) // 4


def encoded(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """``rid, doc_id, held_out, learn, ids, light``: heavy words by number (four bytes each), others as -1 and as fingerprints."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        words, prints, numbers = Numbered(), np.zeros(0, np.int64), np.zeros(0, np.int32)
        for batch in in_slices(batches, 256):
            if words.full:
                words.reset()
                prints, numbers = np.zeros(0, np.int64), np.zeros(0, np.int32)
            own, offsets = words(as_bytes(batch.column(4)))
            if len(words.prints) > len(prints):  # words met for the first time
                more = np.array(words.prints[len(prints) :], np.uint64).view(np.int64)
                prints, numbers = np.append(prints, more), np.append(numbers, _find(shared.value, more).astype(np.int32))
            ids = numbers[own]
            rare = ids < 0
            packed = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(ids)])
            light = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rare))[offsets], pa.int32()), pa.array(prints[own[rare]], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], packed, light], ["rid", "doc_id", "held_out", "learn", "ids", "light"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "learn", "text")
    return written(rows.mapInArrow(released(run), "rid long, doc_id long, held_out boolean, learn boolean, ids binary, light array<long>"), "lm-encoded")


def _words(batch, heavy: np.ndarray, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of encoded documents (columns ``ids, light`` from ``at`` on), and offsets."""
    ids, offsets = _flat(batch.column(at))
    light = batch.column(at + 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    words = heavy[ids] if len(heavy) else np.zeros(len(ids), np.int64)
    words[ids < 0] = light
    return words.view(np.uint64), offsets


def _first_symbols(tree: Tree, learned: DataFrame, counts: DataFrame, shared) -> DataFrame:
    """``k, e, n, size, parent, k2, c2`` of all words after one word that occurs often enough.

    Pairs of shipped words go by number. ``k2`` and its parent ``c2`` are the key of the
    pair as a context, where the pair occurs often enough.
    """
    spark = learned.sparkSession
    start, names = len(tree.heavy), "k long, e long, n long, size long, parent double, k2 long, c2 long"
    any_spare = start >= SHIPPED_WORDS
    if any_spare:
        shipped = spark.createDataFrame(pa.table({"k": pa.array(tree.heavy, pa.int64())}))  # as many rows as are shipped at most
        spare = written(counts.where((F.col("n") >= LEAST_ENTRY) & (F.col("n") <= tree.least)).select("k", "n").join(shipped, "k", "left_anti"), "lm-spare")
        any_spare = not spare.isEmpty()
    light = spark.sparkContext.broadcast(Bits(spare) if any_spare else None)

    def numbers(batch):
        ids, offsets = _flat(batch.column(0))
        before = np.empty(len(ids), np.int64)
        before[1:] = ids[:-1]
        before[offsets[:-1]] = start
        return ids, before, offsets

    def pairs(batches):
        often = shared.value.counts >= LEAST_CONTEXT
        for batch in in_slices(batches, 256):
            w, f, _ = numbers(batch)
            good = (w >= 0) & (f >= 0)
            w, f = w[good], f[good]
            good = often[f] & (shared.value.counts[w] >= LEAST_ENTRY)
            yield ((f[good] << 32 | w[good]).astype(np.uint64),)

    def longer_pairs(f, w, n):
        """Keys of pairs as contexts of two words, null where they are too rare or end a text."""
        none = (n < LEAST_CONTEXT) | (w == np.int64(END).astype(np.uint64))
        last = _times(w, 1)
        return pa.array(_key(last + _times(f, 2), 2).view(np.int64), mask=none), pa.array(_key(last, 1).view(np.int64), mask=none)

    def named(columns, n):
        tree = shared.value
        prints = np.append(tree.heavy, START).view(np.uint64)
        at, to = (columns[0] >> np.uint64(32)).astype(np.int64), (columns[0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        f, w = prints[at], prints[to]
        k = _key(_times(f, 1), 1)
        return k.view(np.int64), _entry(k, w).view(np.int64), n, tree.counts[at], tree.root[to], *longer_pairs(f, w, n)

    found = packed_counts(learned, pairs, 1, LEAST_ENTRY, tree.total, named, names)
    if not any_spare:
        return found

    def spare_pairs(batches):
        for batch in in_slices(batches, 256):
            words, offsets = _words(batch, shared.value.heavy)
            w, f, _ = numbers(batch)
            before = np.empty(len(words), np.uint64)
            before[1:] = words[:-1]
            before[offsets[:-1]] = np.int64(START).astype(np.uint64)
            good = ((w < 0) | (f < 0)) & ((w >= 0) | light.value.has(words)) & ((f >= 0) | light.value.has(before))
            yield before[good], words[good]

    def keyed(columns, n):
        f, w = columns
        k = _key(_times(f, 1), 1)
        return f.view(np.int64), w.view(np.int64), k.view(np.int64), _entry(k, w).view(np.int64), n, *longer_pairs(f, w, n)

    rows = packed_counts(learned, spare_pairs, 2, LEAST_ENTRY, tree.total, keyed, "f long, w long, k long, e long, n long, k2 long, c2 long")
    rows = written(rows, "lm-spare-pairs")
    starts = spark.createDataFrame([(START, int(tree.counts[-1]))], "k long, n long")
    sizes = counts.unionByName(starts).where(F.col("n") >= LEAST_CONTEXT).select(F.col("k").alias("f"), F.col("n").alias("size"))
    above = counts.select(F.col("k").alias("w"), ((F.col("n") + ALPHA) / F.lit(float(tree.total + ALPHA * (tree.distinct + 1)))).alias("parent"))
    return found.unionByName(rows.join(sizes, "f").join(above, "w").select("k", "e", "n", "size", "parent", "k2", "c2"))


def _symbols(tree: Tree, learned: DataFrame, candidates: DataFrame, shared):
    """``k, up, n`` of all words after contexts of the next depth that may be among ``candidates``.

    ``up`` is the entry of the parent; what is no entry there is seen too seldom here as well.
    """
    depth = len(tree.nodes)
    large, above, below = _sent(candidates), tree.nodes[-1], tree.entries[-1]

    def rows(batches):
        node, wanted, entry = above.value, large.value, below.value
        for batch in in_slices(batches, 256):
            p = Places(*_words(batch, shared.value.heavy))
            at, sums, _ = p.within(node, depth)
            longer = _key(sums + _times(p.words[at - depth - 1], depth + 1), depth + 1)
            good = wanted.has(longer)
            longer, up = longer[good], p.entries(at[good], depth)
            good = entry.has(up)
            yield longer[good], up[good]

    return packed_counts(learned, rows, 2, LEAST_ENTRY, tree.total, lambda c, n: (c[0].view(np.int64), c[1].view(np.int64), n), "k long, up long, n long"), large


def _contexts(tree: Tree, learned: DataFrame, shared) -> DataFrame:
    """``k, c, size`` of contexts of the next depth that occur often enough, with their parents."""
    depth, node = len(tree.nodes), tree.nodes[-1]

    def rows(batches):
        for batch in in_slices(batches, 256):
            p = Places(*_words(batch, shared.value.heavy))
            at, sums, key = p.within(node.value, depth)
            yield _key(sums + _times(p.words[at - depth - 1], depth + 1), depth + 1), key

    return packed_counts(learned, rows, 2, LEAST_CONTEXT, tree.total, lambda c, n: (c[0].view(np.int64), c[1].view(np.int64), n), "k long, c long, size long")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _tested(tree: Tree, rows: DataFrame) -> bool:
    """Adds the nodes and entries of ``k, e, n, size, parent`` that pass the divergence test; false if none does."""
    held = rows.groupBy("k").agg(F.first("size").alias("n"), F.sum(F.col("n") - DISCOUNT).alias("held"), F.sum("n").alias("known"), F.count("*").alias("m"))
    held = held.withColumn("left", F.greatest(1 - F.col("held") / F.col("n"), F.lit(1e-12))).withColumn("rest", F.greatest(F.col("n") - F.col("known"), F.lit(0)) * F.log("left"))
    held = written(held.select(F.col("k").alias("of"), F.col("n").alias("size_"), "m", "left", "rest"), "lm-held")
    p = (F.col("n") - DISCOUNT) / F.col("size") + F.col("left") * F.col("parent")
    with_left = rows.join(_small(held.select("of", "left")), F.col("k") == F.col("of")).select("k", "e", "n", "left", "parent", p.alias("p"))
    gain = written(with_left.groupBy("k").agg(F.sum(F.col("n") * F.log(F.col("p") / F.col("parent"))).alias("gain")), "lm-gains")
    good = held.join(gain, F.col("of") == F.col("k")).where(F.col("gain") + F.col("rest") >= LEAST_GAIN + GAIN_PER_ENTRY * F.col("m"))
    good = written(good.select("k", F.col("size_").alias("n"), F.log("left").alias("v")), "lm-nodes")
    if good.isEmpty():
        dropped(held, gain, good)
        return False
    entries = with_left.join(_small(good.select(F.col("k").alias("good"))), F.col("k") == F.col("good")).select(F.col("e").alias("k"), "n", (F.log(F.col("p") / F.col("parent")) - F.log("left")).alias("v"), "p")
    entries = written(entries, "lm-entries")
    dropped(held, gain)
    tree.tables.append((good, entries))
    tree.nodes.append(_sent(good))
    tree.entries.append(_sent(entries))
    return True


def _grow(tree: Tree, learned: DataFrame, counts: DataFrame) -> None:
    """Adds one depth after the other until no context passes."""
    spark = learned.sparkSession
    shared = spark.sparkContext.broadcast(tree)
    rows = written(_first_symbols(tree, learned, counts, shared), "lm-symbols")

    def keyed(batches):
        for batch in batches:
            k, up = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_entry(k, up).view(np.int64)), *batch.columns[2:]], ["k", "e", "n", "size", "parent"])

    while _tested(tree, rows):
        nodes, entries = tree.tables[-1]
        if len(tree.nodes) == 1:  # the counts of pairs are those of contexts of two words
            contexts = rows.where("k2 is not null").select(F.col("k2").alias("k"), F.col("c2").alias("c"), F.col("n").alias("size"))
        else:
            contexts = _contexts(tree, learned, shared)
        # what the bitmaps let through in error has no parent among the nodes
        contexts = written(contexts.join(_small(nodes.select(F.col("k").alias("c"))), "c").select(F.col("k").alias("of"), "size"), "lm-contexts")
        if contexts.isEmpty():
            dropped(contexts)
            break
        dropped(rows)
        found, sent = _symbols(tree, learned, contexts.select(F.col("of").alias("k")), shared)
        found = found.join(_small(contexts), F.col("k") == F.col("of")).join(entries.select(F.col("k").alias("up"), F.col("p").alias("parent")), "up")
        found = found.select("k", "up", "n", "size", "parent").mapInArrow(keyed, "k long, e long, n long, size long, parent double")
        rows = written(found, "lm-symbols")
        sent.destroy()
        dropped(contexts)
        collected(spark)
    dropped(rows)
    shared.destroy()


def _most_frequent(values: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the rows with the largest ``n``, found without sorting; of those on the boundary a share by key."""
    level = F.floor(8 * F.log2("n"))
    left, found = most, values.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    for x in found:
        if x["count"] > left:
            return values.where((level > x["level"]) | ((level == x["level"]) & (F.pmod("k", F.lit(4096)) < 4096 * left // x["count"])))
        left -= x["count"]
    return values


def _each(docs: DataFrame) -> DataFrame:
    """``rid, k, tf``: the different words of ``rid, light`` and how often each is there."""

    def run(batches):
        for batch in in_slices(batches, 256):
            of, words = pa.compute.list_parent_indices(batch.column(1)).to_numpy(), batch.column(1).flatten().to_numpy()
            if not len(words):
                continue
            order = np.lexsort((words, of))
            of, words = of[order], words[order]
            first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (of[1:] != of[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[of[first]]), pa.array(words[first]), pa.array(np.diff(np.append(first, len(words))))], ["rid", "k", "tf"])

    return docs.select("rid", "light").mapInArrow(released(run), "rid long, k long, tf long")


def fit(texts: DataFrame) -> tuple[Tree, DataFrame, DataFrame]:
    """The tree, the table of word counts and the encoded documents of ``doc_id, held_out, learn, text``."""
    spark = texts.sparkSession
    counts = written(word_counts(texts.where("learn")), "lm-words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    with shuffles_let_go(spark):
        often = counts.where(F.col("n") >= LEAST_ENTRY).orderBy(F.desc("n"), "k").limit(SHIPPED_WORDS).toArrow()
    heavy, n = often.column(0).to_numpy(), often.column(1).to_numpy()
    order = np.argsort(heavy)
    tree = Tree(heavy[order], n[order], total, distinct, texts.where("learn").count())
    tree.least = int(n.min()) if len(n) else 0
    del often
    give_back()
    docs = encoded(texts, tree.heavy)
    if total:
        _grow(tree, docs.where("learn").select("ids", "light"), counts)
    if tree.tables:
        collected(spark)
        with shuffles_let_go(spark):
            rows = _most_frequent(tree.all_values(), SHIPPED).select("k", "v").toArrow()
        keys, values = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
        del rows
        order = np.argsort(keys)
        tree.keys = keys[order]
        del keys
        tree.values = values[order]
        del values, order
        collected(spark)
    tree.counts = np.zeros(0, np.int64)  # scoring needs the root only
    return tree, counts, docs


def scores(docs: DataFrame, learn: F.Column, held_out: F.Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``doc_id, text``.

    The model learns from the rows where ``learn`` is true. Null, empty and blank texts are
    their end alone; very long texts are scored whole; repeated rows each count and are
    each scored; null ids are allowed; other columns are left out; an empty table gives
    no rows, and with nothing to learn from every token has probability one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col("text").cast("string").alias("text"))
    tree, counts, coded = fit(texts)
    shared, bitmaps = docs.sparkSession.sparkContext.broadcast(tree), list(zip(tree.nodes, tree.entries, strict=True))
    names = ["doc_id", "held_out", "n_tokens", "heavy_known", "heavy_base", "heavy_score"]
    kind = pa.struct(list(zip(names, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)))

    def run(batches):
        """A row for each document, whose ``k`` only deals it out, and one for each value that is to be joined."""
        tree = shared.value
        for batch in in_slices(batches, 256):
            ids, _ = _flat(batch.column(3))
            words, offsets = _words(batch, tree.heavy, 3)
            known = ids >= 0
            base = np.where(known, np.log10(tree.root[np.where(known, ids, 0)]), 0.0) if len(tree.root) else np.zeros(len(ids))
            gain, places, keys = tree.gains(words, offsets, bitmaps)
            per = lambda x: np.add.reduceat(x, offsets[:-1])  # noqa: B023, E731
            own = pa.StructArray.from_arrays([*batch.columns[1:3], *map(pa.array, (np.diff(offsets), per(known.astype(np.int64)), per(base), per(base + gain / math.log(10))))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mix(batch.column(0).to_numpy().view(np.uint64)).view(np.int64)), own], ["rid", "k", "doc"])
            if len(keys):
                rid = batch.column(0).to_numpy()[np.searchsorted(offsets, places, "right") - 1]
                yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(keys.view(np.int64)), pa.nulls(len(keys), kind)], ["rid", "k", "doc"])

    light = _each(coded)
    c = F.coalesce(F.col("n"), F.lit(0))
    value = F.log10((c + ALPHA) / F.lit(float(tree.total + ALPHA * (tree.distinct + 1))))
    light = light.join(counts, "k", "left").groupBy("rid").agg(F.sum(F.col("tf") * value).alias("light_base"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("light_known"))
    light = written(light.withColumnRenamed("rid", "light_rid"), "lm-light")
    scored = None
    for part in range(_PARTS):
        rows = coded.where(F.pmod(F.xxhash64("rid"), F.lit(_PARTS)) == part).select("rid", "doc_id", "held_out", "ids", "light")
        rows = rows.mapInArrow(released(run), "rid long, k long, doc struct<doc_id: long, held_out: boolean, n_tokens: long, heavy_known: long, heavy_base: double, heavy_score: double>")
        if tree.tables:
            rows = rows.join(tree.all_values().select("k", "v"), "k", "left").groupBy("rid").agg(*[F.max(f"doc.{x}").alias(x) for x in names], (F.sum(F.when(F.col("doc").isNull(), F.col("v"))) / math.log(10)).alias("deep"))
        else:
            rows = rows.select("rid", "doc.*", F.lit(0.0).alias("deep"))
        rows = written(rows, "lm-scored")
        scored = rows if scored is None else scored.unionByName(rows)
    for x in (shared, *tree.nodes, *tree.entries):
        x.destroy()
    dropped(coded, counts, *[t for pair in tree.tables for t in pair])
    out = scored.join(light, F.col("rid") == F.col("light_rid"), "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("heavy_known") + zero("light_known")).cast("long").alias("n_known"), F.lit(int(tree.total)).cast("long").alias("train_tokens"), (F.col("heavy_base") + zero("light_base")).alias("base_score"), (F.col("heavy_score") + zero("light_base") + zero("deep")).alias("score"))
