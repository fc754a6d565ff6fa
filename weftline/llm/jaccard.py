"""Exact similarity join of shingle sets, size-aware: subsets for light sets, inverted lists for heavy ones.

Two sets link when ``100 |A n B| >= percent |A u B|``. A set of ``n`` shingles then
shares at least ``o(n) = ceil(percent n / 100)`` with any partner, so in a global order of
shingles the first ``n - o(n) + l`` of each hold the first ``l`` common ones.

* Light sets (``n`` up to a boundary) emit every ``l``-subset (``l = 2``) of that prefix:
  two light partners share one subset, and a subset is far rarer than a shingle.
* Heavy sets, and light sets large enough to have a heavy partner, are entered in the
  inverted lists of their ``l = 1`` prefix, and lists are scanned for pairs.

The boundary is the largest size whose subsets cost no more than the entries its lists
would be scanned for.

Texts are read once for their sets. Of each set the shingles of least fingerprint are
kept: all below a threshold that is the same everywhere (a share ``sampled`` of all
shingles, more than a partner may lack), and never fewer than the prefix. Below the
threshold the exact number of texts of every shingle is counted in Spark, which does two
things without losing a link. A set that has more shingles of its own there than it may
differ from a partner in has no partner and goes no further. And the order of shingles is
by that number, so prefixes hold the rarest shingles and a passage that many texts share
enters few lists. Shingles over the threshold come after all others.

Equal word sequences are one class. In a list, all sets are first compared with one
pivot, chosen by a hash in each list; sets found linked fall into components. The same is
done with further pivots, and only then are pairs of different components compared, so a
group of near copies costs about its size and no link between different components is
lost. List entries carry their place in the order, which bounds what two
sets can share from there on, the shingles shortly before it, by which a pair is taken
where it first meets, and a sketch: the parity of a set's shingles in cells. Two
sets differ in at least as many shingles as their parities in cells, which discards most
pairs within the join and, with more cells, before whole sets are fetched. Every other
candidate is decided on whole sets.

Classes are told apart by 128 bits of the words; shingles are 64-bit fingerprints.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, as_bytes, components, dropped, in_slices, mix, own_name, released, shingle_set, written

SUBSET = 2
PARITY, MOST_PARITY = 1024, 1 << 17
#: Words of 64 cells in the sketch of a list entry.
SKETCH = 4
#: How many shingles before its own an entry carries.
BEFORE = 8
#: What an entry costs (it is shuffled, written, joined and grouped some times) in comparisons within a list.
ENTRY_COST = 64
#: Turns in which lists are compared with pivots, and how many pivots a group of sets has in each.
PIVOTS = 2
PIVOTS_OF_GROUP = 16
#: Rows up to which a table of candidate documents is sent to all executors (16 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


def needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix(n: int, percent: int, subset: int) -> int:
    return min(n, n - needed(n, percent) + subset)


def sampled(percent: int) -> int:
    """The threshold below which shingles are counted: half as many again as a partner may lack, as a signed 64-bit number."""
    share = min(1.0, 1.5 * (100 - percent) / 100)
    return min(int(share * 2**64) - 2**63, 2**63 - 1)


def class_of(words: list[bytes]) -> tuple[int, int]:
    """128 bits that tell word sequences apart, as two signed numbers."""
    both = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(both[:8], "big", signed=True), int.from_bytes(both[8:], "big", signed=True)


def parity(shingles: np.ndarray, cells: int = 0) -> bytes:
    """For each of some cells, whether it has an odd number of shingles: at least twice as many cells as shingles, from ``PARITY`` to ``MOST_PARITY``."""
    if not cells:
        cells = PARITY
        while cells < min(2 * len(shingles), MOST_PARITY):
            cells *= 2
    return np.packbits(np.bincount((shingles >> np.uint64(20)).astype(np.int64) % cells, minlength=cells) & 1).tobytes()


def cells_apart(a: bytes, b: bytes) -> int:
    """In how many cells two parities differ; the longer one is folded to the length of the other."""
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "big"), 8 * len(a)
    while size > 8 * len(b):
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return (x ^ int.from_bytes(b, "big")).bit_count()


def facts(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """``rid, doc_id, t1, t2, n, low, cells, sketch`` of each document: its class, the size of its set, the least shingles and two parities.

    ``low`` is sorted by fingerprint as a signed number; an empty set has ``n`` 0.
    """
    below = sampled(percent)

    def run(batches):
        hasher = WordHasher()
        for batch in in_slices(batches, 256):
            rows = []
            for text in as_bytes(batch.column(1)):
                words = text.lower().split()
                s = np.sort(shingle_set(hasher(words), size).view(np.int64))
                least = int(np.searchsorted(s, below))
                u = s.view(np.uint64)
                rows.append((*class_of(words), len(s), s[: max(least, prefix(len(s), percent, SUBSET))], parity(u), np.frombuffer(parity(u, 64 * SKETCH), ">i8").astype(np.int64)))
            t1, t2, n, low, cells, sketch = zip(*rows, strict=True) if rows else [()] * 6
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in a])]), pa.int32()), pa.array(np.concatenate(a) if a else np.zeros(0, np.int64))) for a in (low, sketch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(n, pa.int64()), lists[0], pa.array(cells, pa.binary()), lists[1]], ["doc_id", "t1", "t2", "n", "low", "cells", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), "doc_id long, t1 long, t2 long, n long, low array<long>, cells binary, sketch array<long>")
    # numbered as it is written, so the numbers stay
    return written(rows.withColumn("rid", F.monotonically_increasing_id()), "jaccard-facts")


def boundary(percent: int, list_length: float) -> int:
    """The largest light size: its subsets cost at most the list entries that its prefix would be compared with.

    An entry costs ``ENTRY_COST`` comparisons.
    """
    best, n = 1, 2
    while n <= 2 * best + 100:
        if ENTRY_COST * math.comb(prefix(n, percent, SUBSET), SUBSET) <= prefix(n, percent, 1) * (ENTRY_COST + list_length):
            best = n
        n += 1
    return best


def possible_sets(own: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The classes that may have a partner (``cid, t1, t2, n, id``, one row each), and ``h, df`` of shingles that several texts share below the threshold."""
    below = sampled(percent)
    parts = own.select("t1", F.explode("low").alias("h")).where(F.col("h") < below)
    # a shingle of one class only counts for that class; any other keeps its number of texts
    seen = parts.groupBy("h").agg(F.min("t1").alias("low"), F.max("t1").alias("high"), F.count("*").alias("df"))
    alone = F.col("low") == F.col("high")
    seen = seen.select((~alone).alias("shared"), F.when(alone, F.col("low")).otherwise(F.col("h")).alias("key"), F.when(alone, 1).otherwise(F.col("df")).cast("long").alias("x"))
    seen = written(seen.groupBy("shared", "key").agg(F.sum("x").alias("x")), "jaccard-seen")
    classes = own.where("n > 0").groupBy("t1", "t2").agg(F.min("rid").alias("cid"), F.min("n").alias("n"), F.count("*").alias("copies"), F.min_by("doc_id", "rid").alias("id"))
    # of two classes with the same first half both stay: their own shingles can't be told apart above
    twice = F.count("*").over(_by("t1")) > 1
    classes = classes.withColumn("twice", twice)
    alone = seen.where("not shared").select(F.col("key").alias("t"), F.col("x").alias("alone"))
    # copies repeat a class's shingles, but each shingle counts once as it is one class
    kept = classes.join(alone, F.col("t1") == F.col("t"), "left").where(f"twice or coalesce(alone, 0) <= n - ceil({percent} * n / 100.0)")
    return written(kept.select("cid", "t1", "t2", "n", "id"), "jaccard-classes"), seen.where("shared").select(F.col("key").alias("h"), F.col("x").alias("df"))


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


def ordered(own: DataFrame, classes: DataFrame, df: DataFrame, percent: int) -> DataFrame:
    """``cid, n, alone, shared, over, sketch``: how many counted shingles of a set are its own, the shared ones rarest first, and those over the threshold."""
    below = sampled(percent)
    side = classes.select("cid")
    side = F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side
    sets = own.join(side, own.rid == F.col("cid")).select("cid", "n", "low", "sketch")
    sets = written(sets.select("cid", "n", F.filter("low", lambda h: h < below).alias("under"), F.filter("low", lambda h: h >= below).alias("over"), "sketch"), "jaccard-sets")
    parts = sets.select("cid", F.explode("under").alias("h"))
    found = parts.join(df, "h").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("shared"))
    rows = sets.join(found.withColumnRenamed("cid", "of"), F.col("cid") == F.col("of"), "left")
    shared = F.coalesce(F.transform("shared", lambda x: x["h"]), F.array().cast("array<long>"))
    out = rows.select("cid", "n", (F.size("under") - F.size(shared)).alias("alone"), shared.alias("shared"), F.coalesce(F.transform("shared", lambda x: x["df"]), F.array().cast("array<long>")).alias("df"), "over", "sketch")
    out = written(out.where(f"alone <= n - ceil({percent} * n / 100.0)"), "jaccard-ordered")
    dropped(sets)
    return out


def _before(order: np.ndarray, last: np.ndarray, skipped: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``BEFORE`` shingles before each place ``last`` of an order (without the one at ``skipped``), flat, and how many they are."""
    back = last[:, None] - 1 - np.arange(BEFORE)
    good = back >= 0 if skipped is None else (back >= 0) & (back != skipped[:, None])
    return order[back[good]], good.sum(axis=1)


def entries(sets: DataFrame, light: int, percent: int) -> DataFrame:
    """``key, cid, n, pos, before, s0, ...``: the list entries and subsets of each set; keys of subsets and of lists never mix.

    ``before``: shingles that come shortly before those of the key in the set's order.
    """
    heavy_partner = needed(light + 1, percent)  # smaller sets have no heavy partner
    names = ["key", "cid", "n", "pos", "before", "sketch"]

    def run(batches):
        for batch in in_slices(batches, 512):
            cids, ns, alone, sketch = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(5)
            out = [[], [], [], [], [], [], []]
            for at, (cid, n, own, shared, over) in enumerate(zip(cids, ns, alone, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                order = np.array(shared + over, np.int64)
                found = []
                if n <= light:
                    p = order[: max(0, prefix(n, percent, SUBSET) - own)]
                    mixed = mix(p.view(np.uint64))
                    i, j = np.triu_indices(len(p), 1)
                    # all that two sets share besides the first of the two stands from the second on
                    found.append((mix(mixed[i] * np.uint64(0x9E3779B97F4A7C15) + mixed[j]).view(np.int64), j - 1 + own, *_before(p, j, i)))
                if n >= heavy_partner:
                    p = order[: max(0, prefix(n, percent, 1) - own)]
                    found.append((p, np.arange(len(p)) + own, *_before(p, np.arange(len(p)))))
                for k, pos, before, sizes in found:
                    for col, x in zip(out, (k, np.full(len(k), cid), np.full(len(k), n), pos, before, sizes, np.full(len(k), at)), strict=True):
                        col.append(x)
            if out[0]:
                key, cid, n, pos, before, sizes, at = map(np.concatenate, out)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(before, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cid, pa.int64()), pa.array(n, pa.int32()), pa.array(pos, pa.int32()), lists, sketch.take(pa.array(at, pa.int64()))], names)

    rows = sets.select("cid", "n", "alone", "shared", "over", "sketch").mapInArrow(released(run), "key long, cid long, n int, pos int, before array<long>, sketch array<long>")
    return rows.select("key", "cid", "n", "pos", "before", *[F.get("sketch", k).alias(f"s{k}") for k in range(SKETCH)])


def near(a: str, b: str, percent: int) -> str:
    """What two list entries of one key must meet to be the first place where linked sets meet: sizes, what is left from there on, parities."""
    left = f"least({a}.n - {a}.pos, {b}.n - {b}.pos)"
    apart = " + ".join(f"bit_count({a}.s{k} ^ {b}.s{k})" for k in range(SKETCH))
    return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {100 + percent} * {left} >= {percent} * ({a}.n + {b}.n) and {100 + percent} * ({apart}) <= {100 - percent} * ({a}.n + {b}.n)"


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct()


def _linked(pairs: DataFrame, docs: DataFrame, own: DataFrame, classes: DataFrame, percent: int, size: int) -> DataFrame:
    """Of candidate pairs ``a, b`` (classes) those that link, decided on whole sets."""
    pairs = written(pairs, "jaccard-candidates")
    wanted = written(classes.join(_members(pairs), F.col("cid") == F.col("w"), "left_semi"), "jaccard-wanted")
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    cells = written(own.select("rid", "n", "cells").join(side(wanted.select("cid")), F.col("rid") == F.col("cid")).select("cid", "n", "cells"), "jaccard-cells")
    left, right = (cells.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("cells").alias(f"c{x}")) for x in "ab")

    def possible(batches):
        for batch in in_slices(batches, 1024):
            na, ca, nb, cb = (batch.column(k).to_pylist() for k in range(2, 6))
            keep = [(100 + percent) * cells_apart(x, y) <= (100 - percent) * (n + m) for n, x, m, y in zip(na, ca, nb, cb, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kept = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "ca", "nb", "cb").mapInArrow(released(possible), "a long, b long")
    kept = written(kept, "jaccard-pairs")
    dropped(pairs, cells)
    pairs, before = kept, wanted
    wanted = written(wanted.join(_members(pairs), F.col("cid") == F.col("w"), "left_semi"), "jaccard-wanted")
    dropped(before)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    side = wanted.select(F.col("id").alias("wanted_id")).distinct()
    chosen = texts.join(F.broadcast(side) if few else side, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")

    def run(batches):
        hasher = WordHasher()
        for batch in in_slices(batches, 128):
            words = [t.lower().split() for t in as_bytes(batch.column(0))]
            t1, t2 = zip(*map(class_of, words), strict=True) if words else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array([shingle_set(hasher(w), size).view(np.int64) for w in words], pa.list_(pa.int64()))], ["u1", "u2", "s"])

    sets = chosen.select("text").mapInArrow(released(run), "u1 long, u2 long, s array<long>")
    sets = sets.join(F.broadcast(wanted) if few else wanted, (F.col("u1") == F.col("t1")) & (F.col("u2") == F.col("t2"))).select("cid", "s").dropDuplicates(["cid"])
    sets = written(sets, "jaccard-sets")
    full = pairs.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    found = written(full.withColumn("same", same).where(f"100 * same >= {percent} * (size(sa) + size(sb) - same)").select("a", "b"), "jaccard-links")
    dropped(pairs, wanted, sets)
    return found


def join(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``doc_id, text``.

    Words are cut at ASCII white space and lower-cased in A-Z; a shorter text is one
    shingle; null, empty or blank texts have none and stay alone. ``component_id`` is
    the smallest ``doc_id`` reachable by links. Repeated rows, equal ids and null ids
    are all kept; a null id never becomes a component's id unless all are null. Other
    columns are left out, whatever their names; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    own = facts(docs, percent, size)
    classes, df = possible_sets(own, percent)
    sets = ordered(own, classes, df, percent)
    # mean length of the list that an entry is in: what scanning costs against subsets
    entered = F.slice("df", 1, F.greatest(F.expr(f"cast(n - ceil({percent} * n / 100.0) + 1 - alone as int)"), F.lit(0)))
    length = sets.select(F.explode(entered).alias("x")).agg(F.avg("x")).first()[0] or 0.0
    entry = F.struct("cid", "n", "pos", "before", *[f"s{k}" for k in range(SKETCH)]).alias("x")
    live = written(entries(sets, boundary(percent, length), percent).select("key", entry, F.col("cid").alias("c")), "jaccard-entries")
    dropped(sets)

    def open_lists(live, *more):
        """Entries of the lists that hold several components, with what is summed of each list; written, as a join of two plain exchanges can split a skewed key."""
        ends = live.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), *more).where("low < high").drop("low", "high")
        ends = written(ends.withColumnRenamed("key", "k"), "jaccard-keys")
        out = written(live.join(ends, F.col("key") == F.col("k")).drop("k"), "jaccard-lists")
        dropped(ends)
        return out

    def as_pairs(rows):
        return rows.select(F.struct(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).alias("p")).distinct().select("p.a", "p.b")

    linked = named = None
    for turn in range(PIVOTS):
        # a few pivots for all lists of a group, not one more for each list
        by = F.xxhash64("x.cid", F.pmod("key", F.lit(PIVOTS_OF_GROUP)), F.lit(turn))
        last, live = live, open_lists(live, F.min_by("x", by).alias("y"))
        dropped(last)
        links = _linked(as_pairs(live.where(f"x.cid <> y.cid and {near('x', 'y', percent)}")), docs, own, classes, percent, size)
        # a component found before is a star, so links never have to be looked at again
        linked = links if named is None else links.unionByName(named.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        named = written(components(linked), "jaccard-groups")
        last, live = live, written(live.join(named, F.col("x.cid") == F.col("node"), "left").select("key", "x", F.coalesce("component", "x.cid").alias("c")), "jaccard-placed")
        dropped(last, links)
    rest = open_lists(live)
    left, right = (rest.select(F.col("key").alias(f"k{y}"), F.col("x").alias(y), F.col("c").alias(f"c{y}")) for y in "xy")
    # two sets meet at the first place they share; of later ones most have the one before it in sight
    more = left.join(right, F.expr(f"kx = ky and cx < cy and {near('x', 'y', percent)} and not arrays_overlap(x.before, y.before)"))
    links = _linked(as_pairs(more), docs, own, classes, percent, size)
    dropped(live, rest)
    linked = links.unionByName(named.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
    named = written(components(linked), "jaccard-groups")

    firsts = own.where("n > 0").groupBy("t1", "t2").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("first"))
    firsts = written(firsts.join(named, F.col("cid") == F.col("node"), "left").select("t1", "t2", "first", F.coalesce("component", "cid").alias("c")), "jaccard-firsts")
    smallest = firsts.groupBy("c").agg(F.min("first").alias("component_id"))
    smallest = written(smallest, "jaccard-smallest")
    placed = written(firsts.join(smallest, "c").select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), "component_id"), "jaccard-placed")
    rows = own.select("doc_id", "t1", "t2", F.col("n").alias("n_shingles"))
    out = rows.join(placed, (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """One row of each group of ``join``: the one with the smallest ``doc_id``, all columns kept, whatever their names.

    Rows with null, empty or blank text stay, each alone; rows that repeat the
    smallest ``doc_id`` of a group all stay, as one document; rows with a null id stay;
    an empty table gives no rows.
    """
    found = written(join(docs, percent, size).where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("c")), "jaccard-kept")
    gone = found.where("doc_id <> c").select(F.col("doc_id").alias(own_name(docs, "gone")))
    side = F.broadcast(gone) if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else gone
    return docs.join(side, docs["doc_id"] == side[side.columns[0]], "left_anti")
