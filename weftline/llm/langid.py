"""Language identification by words first, backing off to shorter and shorter character n-grams.

A word that was seen in training scores its log frequency in each language. An unseen
word scores the mean log frequency of its character n-grams (with a mark at either
end) of the longest order of which at least half are known, and nothing if there is none.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, in_slices, own_name, released, written

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """``train_rows`` bounds the distinct labelled texts that a model is fitted on; nothing else is cut."""

    train_rows: int = 20_000
    longest: int = 4
    least_count: int = 2
    smoothing: float = 0.5


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    word = f"^{word}$"
    return [word[i : i + n] for i in range(len(word) - n + 1)]


class Model:
    """Per-language log frequencies of words and n-grams: one row of ``logs`` each."""

    def __init__(self, langs: list[str], words: dict[str, int], grams: dict[str, int], logs: np.ndarray, longest: int):
        self.langs, self.words, self.grams, self.logs, self.longest = langs, words, grams, logs, longest

    def vector(self, word: str):
        if (known := self.words.get(word)) is not None:
            return self.logs[known]
        for n in range(self.longest, 0, -1):
            parts = grams_of(word, n)
            found = [x for g in parts if (x := self.grams.get(g)) is not None]
            if found and 2 * len(found) >= len(parts):
                return self.logs[found].mean(axis=0)
        return None


class Scorer:
    """Scores texts; remembers up to ``limit`` words."""

    def __init__(self, model: Model, limit: int = 100_000):
        self.m, self.limit = model, limit
        self.table = np.zeros((limit + 2, max(1, len(model.langs))), np.float32)
        self.reset()

    def reset(self):
        self.used = 1  # row 0: no evidence
        scorer = self

        class Seen(dict):
            def __missing__(self, word):
                v = scorer.m.vector(word) if word[0].isalpha() or any(c.isalpha() for c in word) else None
                at = 0 if v is None else scorer.used
                if at:
                    scorer.table[at] = v
                    scorer.used += 1
                self[word] = at
                return at

        self.seen = Seen()

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.m.langs or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        total = np.zeros(len(self.m.langs))
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            if self.used + len(part) > self.limit or len(self.seen) > 2 * self.limit:
                self.reset()
            rows = np.fromiter(map(self.seen.__getitem__, part), np.int64, len(part))
            total += self.table[rows].sum(axis=0, dtype=np.float64)
        best = int(np.argmax(total))
        return self.m.langs[best], float(1 / np.exp(total - total[best]).sum())


def share(part: float) -> int:
    """The signed 64-bit number below which this part of all hashes lies."""
    return min(int(min(1.0, part) * 2**64) - 2**63, 2**63 - 1)


def quotas(sizes: dict[str, int], rows: int) -> dict[str, int]:
    """What each language gets of ``rows``: all it has if that is no more than an equal share, the others share the rest alike."""
    out, left, order = {}, rows, sorted(sizes, key=lambda x: (sizes[x], x))
    for k, lang in enumerate(order):
        out[lang] = min(sizes[lang], left // (len(order) - k))
        left -= out[lang]
    return out


def sample(labelled: DataFrame, train_rows: int) -> DataFrame:
    """Distinct ``text, lang`` rows, about ``train_rows`` at most, chosen by a hash of the text, so alike on every cluster.

    Each language gets its quota of distinct texts, so copies weigh once and a rare
    language keeps its rows. Null texts and languages are left out.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.select("text", "lang", F.xxhash64("text").alias("h"))
    sizes = {r[0]: r[1] for r in rows.select("lang", "h").distinct().groupBy("lang").count().collect()}
    quota = quotas(sizes, train_rows)
    chosen = F.lit(False)
    for lang, n in sorted(quota.items()):
        chosen = F.when(F.col("lang") == lang, F.lit(True) if n == sizes[lang] else F.col("h") < share(n / sizes[lang])).otherwise(chosen)
    return rows.where(chosen).dropDuplicates(["lang", "h"]).select("text", "lang")


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """A model of a :func:`sample` of ``text, lang`` rows.

    All words and n-grams of the sample with ``least_count`` occurrences (letters: all)
    come to the driver; the sample bounds them. Without labelled rows the model has no
    languages and every document is undecided. Columns of other names don't matter.
    """
    rows = sample(labelled, settings.train_rows)
    longest = settings.longest

    def summed(pairs):
        """Partial sums of ``(key, count)`` pairs as batches; keys are tuples of a language and a string or a kind and a string."""
        counts: Counter = Counter()

        def batch_of():
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["lang", "kind", "gram", "n"])
            counts.clear()
            return out

        for key, c in pairs:
            counts[key] += c
            if len(counts) > 400_000:
                yield batch_of()
        if counts:
            yield batch_of()

    def words(batches):
        def pairs():
            for batch in in_slices(batches, 64):
                for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for word, c in Counter(words_of(text)).items():
                        yield (lang, 0, word), c

        return summed(pairs())

    def grams(batches):
        def pairs():
            for batch in in_slices(batches, 4096):
                for lang, word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    for k in range(1, longest + 1):
                        for g in grams_of(word, k):
                            yield (lang, k, g), c

        return summed(pairs())

    shape = "lang string, kind int, gram string, n long"
    by_word = written(rows.mapInArrow(released(words), shape).groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")), "langid-words")
    by_gram = by_word.select("lang", "gram", "n").mapInArrow(released(grams), shape).groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    langs = sorted(r[0] for r in by_word.select("lang").distinct().collect())
    if not langs:
        return Model([], {}, {}, np.zeros((0, 0), np.float32), longest)
    sums = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{k}") for k, x in enumerate(langs)]
    table = by_word.unionByName(by_gram).groupBy("kind", "gram").agg(F.sum("n").alias("all"), *sums)
    kept = written(table.where((F.col("all") >= settings.least_count) | (F.col("kind") == 1)), "langid")
    totals = {r[0]: np.array(r[1:], float) for r in kept.groupBy("kind").agg(*[F.sum(f"n{k}") for k in range(len(langs))]).collect()}
    top = kept.toArrow()
    dropped(by_word, kept)
    kind, counts = top.column("kind").to_numpy(), np.stack([top.column(f"n{k}").to_numpy() for k in range(len(langs))], axis=1).astype(float)
    logs, strings = np.zeros(counts.shape, np.float32), top.column("gram").to_pylist()
    for k in np.unique(kind):
        own = kind == k
        logs[own] = np.log((counts[own] + settings.smoothing) / (totals[k] + settings.smoothing * (own.sum() + 1)))
    words = {w: i for i, (w, k) in enumerate(zip(strings, kind.tolist(), strict=True)) if k == 0}
    grams = {w: i for i, (w, k) in enumerate(zip(strings, kind.tolist(), strict=True)) if k > 0}
    return Model(langs, words, grams, logs, longest)


def predict(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all, if not given) and ``lang_pred, score``: the language and its posterior (0 to 1).

    ``und`` with score 0 for null, empty or letterless texts, or a model without
    languages. Whole texts are read; equal texts get equal results; ties go to the
    language that is first in the alphabet. Columns ``lang_pred`` and ``score`` of
    ``docs`` are replaced; repeated rows each give a row; an empty table gives none. A
    map without a shuffle; the model is bounded by its sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score")]
    schema = T.StructType([*docs.select(*carry).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    rows = docs.select(*carry, docs[text].cast("string").alias(own_name(docs, "whole")))

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in in_slices(batches, 256):
            found = [scorer(t) for t in batch.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*carry, "lang_pred", "score"])

    return rows.mapInArrow(released(run), schema)


def recognised(docs: DataFrame, model: Model, least_score: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is not ``und`` and scores ``least_score`` or more; all columns as they are, whatever their names.

    Null, empty and letterless texts go; rows that repeat stay or go together; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in in_slices(batches, 256):
            found = [scorer(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
