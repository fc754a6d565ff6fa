import collections
import math
import zlib

import numpy as np
from weftline.llm import suffix_tree
from pyspark.sql import functions as F


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 10 == 0


def base(rows):
    """Brute-force base scores, token counts and known tokens by position in ``rows``."""
    words = [(t or "").encode().lower().split() + [None] for _, t in rows]
    learn = [i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    c = collections.Counter(w for ws, good in zip(words, learn, strict=True) if good for w in ws)
    n, v = sum(c.values()), len(c)
    return [(len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for ws in words]


def test_base_and_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i: x for (i, _), x in zip(rows, base(rows), strict=True)}
    out = suffix_tree.scores(docs, ~held_out(), held_out()).collect()
    assert len(out) == len(rows)
    for r in out:
        n, known, train, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
        assert abs(r.base_score - score) < 1e-6 * max(1, abs(score))
    unseen = [r for r in out if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_distributions_sum_to_one(spark):
    text = " ".join(["a b c", "a b d", "x b e", "f g"] * 60)
    df = spark.createDataFrame([(i, text) for i in range(1, 9)], "doc_id long, text string")
    tree, _, _ = suffix_tree.fit(df.select("doc_id", F.lit(False).alias("held_out"), F.lit(True).alias("learn"), "text"))
    assert len(tree.keys1) and len(tree.keys2)
    w, light = np.arange(len(tree.heavy)), 1 - tree.root.sum()
    for b1 in range(len(w)):
        for b2 in [*range(len(w)), -1]:  # contexts that are no nodes give the distribution of a shorter one
            full = lambda x: np.full(len(w), x)
            total = np.exp(tree.score(w, full(b1), full(b2))).sum() + light * np.exp(tree.score(np.array([-1]), np.array([b1]), np.array([b2])))[0]
            assert abs(total - 1) < 1e-9


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (4, "A b"), (None, "zzz"), (5, "w " * 200_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    out = suffix_tree.scores(df, ~held_out(), held_out()).collect()
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in out)
    assert got == sorted((str(i), n, k, round(s, 4)) for (i, _), (n, k, _, s) in zip(rows, base(rows), strict=True))
    assert suffix_tree.scores(df.limit(0), ~held_out(), held_out()).count() == 0
    alone = suffix_tree.scores(df.where("doc_id = 4"), F.lit(False), F.lit(True)).first()
    assert (alone.train_tokens, alone.base_score, alone.score) == (0, 0.0, 0.0)


def brute(rows):
    """Scores by a tree of plain dictionaries without any bound on words, contexts, entries or depth."""
    words = [["<s>", *(t or "").encode().lower().split(), None] for _, t in rows]
    learn = [w for (i, _), w in zip(rows, words, strict=True) if i is not None and zlib.crc32(str(i).encode()) % 10 != 0]
    c = collections.Counter(x for w in learn for x in w[1:])
    n, v = sum(c.values()), len(c)
    nodes = {(): None}

    def p(context, x):
        if not context:
            return (c[x] + 0.1) / (n + 0.1 * (v + 1))
        entries, left = nodes[context]
        return entries[x] if x in entries else left * p(context[1:], x)

    depth, grown = 0, True
    while grown:
        depth, grown = depth + 1, {}
        found = collections.defaultdict(collections.Counter)
        for w in learn:
            for i in range(depth, len(w)):
                if w[i - depth + 1 : i] == [] or tuple(w[i - depth + 1 : i]) in nodes:
                    found[tuple(w[i - depth : i])][w[i]] += 1
        for context, after in found.items():
            size, kept = sum(after.values()), {x: k for x, k in after.items() if k >= 2}
            if size < 8 or not kept:
                continue
            left = max(1e-12, 1 - sum(k - 0.5 for k in kept.values()) / size)
            parent = {x: p(context[1:], x) for x in kept}
            new = {x: (k - 0.5) / size + left * parent[x] for x, k in kept.items()}
            gain = sum(k * math.log(new[x] / parent[x]) for x, k in kept.items()) + (size - sum(kept.values())) * math.log(left)
            if gain >= 6 + len(kept):
                grown[context] = new, left
        nodes |= grown
    out = []
    for w in words:
        total = 0.0
        for i in range(1, len(w)):
            d = 0
            while d < i and tuple(w[i - d - 1 : i]) in nodes:
                d += 1
            total += math.log10(p(tuple(w[i - d : i]), w[i]))
        out.append(total)
    return out, max(map(len, nodes))


def test_whole_tree(spark, monkeypatch):
    """Depth follows the text, and a small part sent to executors changes no score."""
    rng = np.random.default_rng(5)

    def chain():
        x = [1, -1, 1]
        for _ in range(40):
            x.append(1 if rng.random() < 1 / (1 + math.exp(-1.6 * x[-1] - 1.4 * x[-2] - 1.2 * x[-3])) else -1)
        return " ".join(f"w{rng.integers(300)}" if rng.random() < 0.05 else f"s{k}" for k in x)

    rows = [(i, chain()) for i in range(1, 260)] + [(None, "s1 s1 s1 s1 s-1"), (None, "s-1 new s1 s1 w3")]
    want, depth = brute(rows)
    assert depth > 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for shipped in (suffix_tree.SHIPPED, 20):
        monkeypatch.setattr(suffix_tree, "SHIPPED", shipped)
        monkeypatch.setattr(suffix_tree, "SHIPPED_WORDS", shipped)
        got = sorted((r.doc_id or 0, r.score) for r in suffix_tree.scores(df, ~held_out(), held_out()).collect())
        assert np.allclose([x for _, x in got], [x for _, x in sorted((i or 0, x) for (i, _), x in zip(rows, want, strict=True))], rtol=1e-9)


def test_seen_often_is_kept_in_a_large_corpus(spark):
    """A pair seen twelve times among 26 million tokens is in a node: a share of all tokens would leave it out."""
    filler = "x y " * 100_000
    rows = [(i, filler) for i in range(1, 131)] + [(1000 + i, f"q{i} rare pair z{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.lit(False).alias("held_out"), F.lit(True).alias("learn"), "text")
    tree, _, _ = suffix_tree.fit(df)
    rare, pair = (int(np.searchsorted(tree.heavy, suffix_tree.tokens(w, suffix_tree.WordHasher())[0])) for w in (b"rare", b"pair"))
    assert tree.score(np.array([pair]), np.array([rare]), np.array([-1]))[0] > math.log(0.9)
