import zlib

import numpy as np
from weftline.llm import langid
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"))
    model = langid.fit(docs.where("not held_out"))
    rows = langid.predict(docs.where("held_out"), model).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def model(langs, rows, grams=()):
    """A model with a row of log frequencies for each of ``rows`` (words) and ``grams``."""
    words = {w: i for i, w in enumerate(rows)}
    parts = {g: len(words) + i for i, g in enumerate(grams)}
    return langid.Model(langs, words, parts, np.array([*dict(rows).values(), *dict(grams).values()], np.float32).reshape(-1, len(langs)), 3)


def test_backoff():
    m = model(["a", "b"], {"foo": (0.0, -9.0)}, {"^ba": (-9.0, 0.0), "bar": (-9.0, -2.0), "zz": (-5.0, -1.0), "z": (-1.0, -3.0)})
    assert list(m.vector("foo")) == [0.0, -9.0]
    assert list(m.vector("bar")) == [-9.0, -1.0]  # two of three trigrams
    assert list(m.vector("zzz")) == [-5.0, -1.0]  # two of four pairs
    assert m.vector("z") is None  # one of three letters, the marks being two
    assert m.vector("qqq") is None


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "12 34 ²!", "x"), (4, "foo " * 200_000, "x"), (5, "qqq", "x"), (5, "qqq", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    m = model(["a", "b"], {"foo": (0.0, -9.0)})
    out = langid.predict(df, m).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert len(out) == 6 and got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4] == ("a", 1.0)
    assert got[5] == ("a", 0.5)  # a tie goes to the first language
    assert langid.predict(df.limit(0), m).count() == 0


def test_nothing_to_learn(spark):
    m = langid.fit(spark.createDataFrame([("x", None)], "text string, lang string"))
    assert langid.predict(spark.createDataFrame([("abc",)], "text string"), m).first().lang_pred == "und"


def test_sample_is_not_halved():
    assert langid.Settings().train_rows == 20_000


def test_quotas():
    assert langid.quotas({"a": 10, "b": 10**11, "c": 3 * 10**11}, 1000) == {"a": 10, "b": 495, "c": 495}
    # a share of a very large table is never nothing
    assert langid.share(20_000 / 1e13) > -(2**63) and langid.share(1.0) == 2**63 - 1


def test_copies_and_rare_languages(spark):
    rows = [("same text of many copies", "en")] * 500 + [(f"some text number w{k}", "en") for k in range(300)] + [("rare words here", "xx")]
    got = langid.sample(spark.createDataFrame(rows, "text string, lang string").repartition(4), 100).collect()
    assert sum(r.lang == "xx" for r in got) == 1
    assert len({r.text for r in got}) == len(got) and 50 <= len(got) <= 160


def test_recognised_keeps_columns_as_they_are(spark):
    rows = [(1, "foo foo", -7.0, "u", 5), (2, "qqq", 1.0, "v", 6), (3, None, 2.0, "w", 7), (4, "", 3.0, "x", 8), (1, "foo foo", -7.0, "u", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, lang_pred string, held_out int")
    m = model(["a", "b"], {"foo": (0.0, -9.0)})
    assert sorted(map(tuple, langid.recognised(df, m, 0.6).collect())) == [rows[0], rows[0]]
    assert langid.recognised(df, m, 0.6).columns == df.columns


def brute(train, texts, settings):
    """Posteriors by plain counting, without any table that the operator keeps."""
    import math
    import re
    from collections import Counter, defaultdict

    split = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    grams = lambda w, n: [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    langs = sorted({lang for _, lang in train})
    counts = defaultdict(Counter)  # (kind, string) -> language -> count
    for text, lang in set(train):
        for w in split(text):
            counts[0, w][lang] += 1
            for n in range(1, settings.longest + 1):
                for g in grams(w, n):
                    counts[n, g][lang] += 1
    kept = {k: c for k, c in counts.items() if sum(c.values()) >= settings.least_count or k[0] == 1}
    size, total = Counter(k for k, _ in kept), defaultdict(Counter)
    for (k, _), c in kept.items():
        total[k].update(c)

    def logs(k, x):
        return [math.log((kept[k, x][v] + settings.smoothing) / (total[k][v] + settings.smoothing * (size[k] + 1))) for v in langs]

    def word(w):
        if (0, w) in kept:
            return logs(0, w)
        for n in range(settings.longest, 0, -1):
            found = [logs(n, g) for g in grams(w, n) if (n, g) in kept]
            if found and 2 * len(found) >= len(grams(w, n)):
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * len(langs)

    out = []
    for t in texts:
        sums = [sum(x) for x in zip(*map(word, split(t)), strict=True)]
        top = max(sums)
        out.append((langs[sums.index(top)], 1 / sum(math.exp(x - top) for x in sums)))
    return out


def test_against_brute_force(spark):
    import random

    rng = random.Random(6)
    parts = {"a": ["ba", "bo", "lu", "ma"], "b": ["ski", "tra", "ou", "ma"], "c": ["ren", "fi", "lu", "ou"]}
    make = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 8)))
    train = [(make(lang), lang) for lang in "abc" for _ in range(40)]
    train += train[:30]  # copies weigh once
    texts = [make(rng.choice("abc")) + " " + make(rng.choice("abc")) for _ in range(60)]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    got = langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, (lang, score) in zip(got, brute(train, texts, langid.Settings()), strict=True):
        assert abs(r.score - score) < 1e-3 and (r.lang_pred == lang or score < 0.51)
