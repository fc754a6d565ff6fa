import random

import pytest
from weftline.llm import jaccard


def brute(rows, percent, size):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                up[find(a)] = find(b)
    out = []
    for k, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((d, len(sets[k]), min(ids) if ids else None))
    return sorted(out, key=str)


def texts(n=350):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 4, 6, 9, 12, 20, 35, 70, 150]))] for _ in range(30)]
    out = []
    for k in range(n):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            at, how = rng.randrange(len(b)), rng.random()
            if how < 0.4:
                b[at] = rng.choice(words)
            elif how < 0.7:
                b.insert(at, rng.choice(words))
            elif len(b) > 1:
                del b[at]
        out.append((k * 7 % 1000 + 5 * k, " ".join(b)))
    return out


@pytest.mark.parametrize(("percent", "size", "light"), [(85, 4, None), (80, 5, 0), (85, 4, 60)])
def test_against_brute_force(spark, monkeypatch, percent, size, light):
    if light is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda *a: light)
    rows = [*texts(), (1, None), (2, ""), (3, " \t"), (None, "w1 w2 w3 w4 w5"), (4, "A b"), (4, "a B"), (4, "c")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    assert sorted(map(tuple, jaccard.join(df, percent, size).collect()), key=str) == brute(rows, percent, size)


def test_deduplicate_keeps_one_of_each_group(spark):
    long = " ".join(f"v{k}" for k in range(5000))
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, long), (6, long + " end"), (7, "other text of some more words")]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in jaccard.deduplicate(df).collect()) == [1, 3, 4, 5, 7]
    assert jaccard.join(df.limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    words = [f"c{k}" for k in range(300)]
    rows = [(k, " ".join([*words[: k % 290], f"u{k}", *words[k % 290 :]])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in jaccard.join(df, 85, 4).collect()} == {0}
