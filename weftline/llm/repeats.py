"""Removal of long repeated passages by recompression.

A text is a string of word names. A round replaces, everywhere alike, runs and pairs of
neighbouring symbols by one symbol: the first round names maximal runs of equal words,
and each later round names pairs whose left symbol is of one class and right symbol of
the other. Names and classes are fingerprints of what a symbol spells, so all documents
use one dictionary and a round needs no exchange of names between executors. A run of
more than ``RUN`` words is one symbol that later rounds leave alone, as its end may lie
far away.

Whether two neighbours are joined depends on those two symbols only, so equal windows of
``W`` words get the same symbols but for a margin of ``RUN * 2^rounds`` words at either
end. Of the symbols that start inside the margins, the one of least name represents the
window (its first inner word, if one long run covers them all). With the words within
the margin around it, it makes a key that all occurrences of the window share:

1. keys that texts of more than one kind share reveal possible repeats;
2. for those alone the windows themselves are compared across documents, by 128 bits of
   their words (two fingerprints).

Equal texts are one class, of which only the smallest id is compared. All counts are
summed before a shuffle and joined back by key, so a passage shared by a third of all
documents is split like any skewed key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, as_bytes, dropped, in_slices, mix, released, written

WINDOW = 50
#: Rows of ids up to which a side is sent to all executors (16 bytes each).
BROADCAST_ROWS = 500_000
#: Windows that leave a worker at once.
BATCH_ROWS = 100_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Makes other names of the same words, for the second fingerprint of a window.
_OTHER = np.uint64(0xA0761D6478BD642F)


RUN = 4


def longest_run(window: int) -> int:
    """The longest run that takes part in pairs; short windows have room for pairs of words only."""
    return RUN if window >= 3 * RUN else 2


def rounds_for(window: int) -> int:
    """The most rounds for which a symbol surely starts between the margins of a window without long runs."""
    if window < 6:
        raise ValueError("windows of at least 6 words")
    r = 0
    while 3 * longest_run(window) << (r + 1) <= window:
        r += 1
    return r


def recompress(names: np.ndarray, rounds: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after the run step and ``rounds`` pair steps: their names and the words where they start."""
    if len(names) < 2:
        return names, np.arange(len(names))
    start = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    size = np.diff(np.concatenate([start, [len(names)]]))
    alone = size > run
    names = np.where(size == 1, names[start], mix(names[start] + np.minimum(size, run + 1).astype(np.uint64)))
    for t in range(rounds):
        right = (mix(names ^ np.uint64(t + 1)) >> np.uint64(63)).astype(bool)
        at = np.flatnonzero(~right[:-1] & right[1:] & ~alone[:-1] & ~alone[1:])
        keep = np.ones(len(names), bool)
        keep[at + 1] = False
        joined = mix(names[at] * _BASE + mix(names[at + 1]))
        names = names.copy()
        names[at] = joined
        names, start, alone = names[keep], start[keep], alone[keep]
    return names, start


class Spans:
    """Fingerprints of word spans of one text after another."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def of(self, names: np.ndarray) -> np.ndarray:
        n = len(names)
        if len(self.power) <= n:
            size = 2 * n + 2
            grow = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]))
            self.power, self.inverse = grow(_BASE), grow(_INVERSE)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(names * self.power[:n], dtype=np.uint64)])

    def span(self, sums: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
        return mix((sums[start + length] - sums[start]) * self.inverse[start])


class Parser:
    def __init__(self, window: int):
        self.window, self.rounds, self.run = window, rounds_for(window), longest_run(window)
        self.margin = self.run << self.rounds
        self.hasher, self.spans = WordHasher(), Spans()

    def parse(self, words: list[bytes]):
        """Word names, and for each window the word at which its representative starts."""
        names = mix(self.hasher(words))
        symbols, start = recompress(names, self.rounds, self.run)
        value = np.full(len(names), np.uint64(2**64 - 1))
        value[start] = symbols
        inner = self.window - 2 * self.margin
        seen = np.lib.stride_tricks.sliding_window_view(value[self.margin : len(names) - self.margin], inner)
        chosen = seen.argmin(axis=1) + np.arange(len(seen)) + self.margin
        return names, value, chosen


def text_class(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _class_number(sha: str) -> int:
    return int.from_bytes(bytes.fromhex(sha[:16]), "big", signed=True)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns.values()], list(columns))


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (with ``texts`` also ``kept``, null where nothing was removed) for each row of ``doc_id, text``.

    Words that a window of ``window`` words covers are removed if the same words also
    start in a document with a smaller id; windows are judged on the input. Words are
    cut at ASCII white space and kept unchanged. Null, empty and short texts lose
    nothing; a null id is never smaller or larger; rows that share an id do not remove
    each other; every input row gives a row; other columns are left out; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    i64, i32, text_kind = pa.int64(), pa.int32(), pa.string()

    def keys(batches):
        p = Parser(window)
        for batch in in_slices(batches, 64):
            ids = batch.column(0).to_pylist()
            doc, cls, key, pos = [], [], [], []
            f_words, f_sha = [], []
            for d, text in zip(ids, as_bytes(batch.column(1)), strict=True):
                words = text.split()
                sha = text_class(words)
                f_words.append(len(words))
                f_sha.append(sha)
                if d is None or len(words) < window:
                    continue
                names, value, chosen = p.parse(words)
                at = np.unique(chosen)
                around = p.spans.span(p.spans.of(names), at - p.margin, 2 * p.margin + 1)
                key.append(mix(around ^ value[at]))
                pos.append(at)
                doc.append(np.full(len(at), d))
                cls.append(np.full(len(at), _class_number(sha)))
            n = len(ids)
            yield _batch({"kind": ([0] * n, i32), "doc_id": (ids, i64), "cls": (list(map(_class_number, f_sha)), i64), "key": ([None] * n, i64), "pos": (f_words, i32), "sha": (f_sha, text_kind)})
            if key:
                key, n = np.concatenate(key).view(np.int64), sum(map(len, key))
                yield _batch({"kind": (np.ones(n, np.int32), i32), "doc_id": (np.concatenate(doc), i64), "cls": (np.concatenate(cls), i64), "key": (key, i64), "pos": (np.concatenate(pos), i32), "sha": (pa.nulls(n, text_kind), text_kind)})

    both = own.mapInArrow(released(keys), "kind int, doc_id long, cls long, key long, pos int, sha string")
    both = written(both, "repeats-symbols")
    facts = both.where("kind = 0").select("doc_id", "cls", F.col("pos").cast("long").alias("n_words"), "sha")
    symbols = both.where("kind = 1").select("doc_id", "cls", "key", "pos")
    classes = facts.where("doc_id is not null").groupBy(F.col("sha").alias("of")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("of", "first")
    classes = written(classes, "repeats-classes")  # here and below: a join of two plain exchanges can split a skewed key
    both_facts = written(facts.join(classes, facts.sha == F.col("of"), "left").select("doc_id", "cls", "n_words", "sha", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy")), "repeats-facts")
    facts = both_facts
    dropped(classes)

    shared = symbols.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("key")
    shared = written(shared, "repeats-shared")
    places = symbols.join(shared, "key", "left_semi").select("doc_id", "cls", "pos")
    places = places.groupBy("doc_id", "cls").agg(F.collect_set("pos").alias("places"))
    first = facts.where("not copy and doc_id is not null").select("doc_id", "cls").distinct()
    places = written(places.join(first, ["doc_id", "cls"], "left_semi").select(F.col("doc_id").alias("id"), F.col("cls").alias("of"), "places"), "repeats-places")
    dropped(both, shared)
    ids = places.select("id").distinct()
    side = F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids
    texts_of = own.join(side, F.col("doc_id") == F.col("id"), "left_semi").join(places, F.col("doc_id") == F.col("id")).select("doc_id", "of", "text", "places")

    def only_own(batches):
        """Rows whose text is of the class that the places are for; one of each (rows may share an id)."""
        for batch in in_slices(batches, 256):
            keep = [_class_number(text_class(t.split())) == c for t, c in zip(as_bytes(batch.column(2)), batch.column(1).to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    texts_of = written(texts_of.mapInArrow(released(only_own), "doc_id long, of long, text string, places array<int>"), "repeats-texts")
    dropped(places)

    def windows(batches):
        p = Parser(window)
        held, rows = [], 0

        def flush():
            h, g, doc, cls, at = (np.concatenate(x) for x in zip(*held, strict=True))
            return _batch({"h": (h.view(np.int64), i64), "g": (g.view(np.int64), i64), "doc_id": (doc, i64), "cls": (cls, i64), "at": (at, i32)})

        for batch in in_slices(batches, 16):
            for d, c, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                names, _, chosen = p.parse(text.split())
                good = np.zeros(len(names), bool)
                good[places] = True
                s = np.flatnonzero(good[chosen])
                held.append((p.spans.span(p.spans.of(names), s, window), p.spans.span(p.spans.of(mix(names ^ _OTHER)), s, window), np.full(len(s), d), np.full(len(s), c), s))
                rows += len(s)
                if rows >= BATCH_ROWS:
                    yield flush()
                    held, rows = [], 0
        if held:
            yield flush()

    found = texts_of.mapInArrow(released(windows), "h long, g long, doc_id long, cls long, at int")
    least = found.groupBy(F.col("h").alias("of"), F.col("g").alias("with")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("of", "with", "low")
    least = written(least, "repeats-least")
    covered = found.join(least, (found.h == F.col("of")) & (found.g == F.col("with")) & (F.col("doc_id") > F.col("low")), "left_semi")
    covered = written(covered.groupBy("doc_id", "cls").agg(F.collect_set("at").alias("at")).select(F.col("doc_id").alias("id"), F.col("cls").alias("c"), "at"), "repeats-covered")
    dropped(least)

    def cut(batches):
        for batch in in_slices(batches, 64):
            removed, shas, kept_texts = [], [], []
            for text, at in zip(as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, np.array(at) + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode(errors="replace") if texts else None)
            yield _batch({"r_id": (batch.column(0), i64), "r_cls": (batch.column(1), i64), "removed": (removed, i64), "r_sha": (shas, text_kind), "r_kept": (kept_texts, text_kind)})

    done = texts_of.join(covered, (texts_of.doc_id == F.col("id")) & (texts_of.of == F.col("c"))).select("doc_id", "of", "text", "at")
    done = done.mapInArrow(released(cut), "r_id long, r_cls long, removed long, r_sha string, r_kept string").dropDuplicates(["r_id", "r_cls"])
    out = facts.join(done, (facts.doc_id == F.col("r_id")) & (facts.cls == F.col("r_cls")), "left")
    whole = F.col("copy") & (F.col("n_words") >= window)
    columns = [
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("r_sha", "sha")).alias("kept_sha256"),
    ]
    if texts:
        columns.append(F.when(whole, "").otherwise(F.col("r_kept")).alias("kept"))
    return out.select(*columns)
