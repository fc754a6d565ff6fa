import hashlib
import random

import numpy as np
import pytest
from weftline.llm import repeats


def brute(rows, window):
    first, out = {}, []
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in texts:
        for k in range(len(w) - window + 1) if d is not None else ():
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, d), d)
    for d, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[k : k + window])] < d:
                gone[k : k + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "words"), [(50, 40), (6, 8), (13, 3), (50, 2)])
def test_against_brute_force(spark, window, words):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(words)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(window - 2, 3 * window))] for _ in range(10)]
    passages += [["a"] * (window + 5), ["a", "b"] * window, ["a"] * (window // 2) + ["b"] * (window - window // 4)]
    rows = []
    for _ in range(200):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages)[rng.randint(0, 3) :] if rng.random() < 0.4 else [rng.choice(vocabulary) for _ in range(rng.randint(0, window))]
        rows.append((rng.randint(0, 300), " ".join(w)))
    rows += [(5, None), (None, " ".join(passages[0] * 2)), (7, ""), (900, rows[0][1]), (900, rows[1][1]), (901, rows[0][1]), (901, rows[0][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    assert sorted(map(tuple, repeats.remove_repeats(df, window).collect()), key=str) == brute(rows, window)


def test_empty_and_long(spark):
    schema = "doc_id long, text string"
    assert repeats.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"x{k % 977}" for k in range(60_000))
    out = {r.doc_id: r.n_removed for r in repeats.remove_repeats(spark.createDataFrame([(1, long), (2, "y " + long)], schema)).collect()}
    assert out == {1: 0, 2: 60_000}


def test_inner_symbols_do_not_depend_on_what_is_around():
    rng = np.random.default_rng(8)
    inner = rng.integers(0, 5, 80).astype(np.uint64)
    r, run = repeats.rounds_for(50), repeats.longest_run(50)
    margin = run << r
    found = []
    for seed in (1, 2):
        around = np.random.default_rng(seed).integers(0, 5, 60).astype(np.uint64)
        names, start = repeats.recompress(repeats.mix(np.concatenate([around[:30], inner, around[30:]])), r, run)
        found.append([(int(s) - 30, int(n)) for s, n in zip(start, names, strict=True) if margin <= s - 30 < 80 - margin])
    assert found[0] == found[1] and found[0]


def test_maximal_runs_are_one_symbol():
    a, b, c = (repeats.mix(np.uint64(k)) for k in (1, 2, 3))
    names, start = repeats.recompress(np.array([a, a, a, b, c, c, c, c, c, c, c, a]), 0)
    assert list(start) == [0, 3, 4, 11]
    # a longer run has the same name, as its end may be out of sight, and no round joins it
    more, _ = repeats.recompress(np.array([a, a, a, b] + [c] * 30 + [a]), 0)
    assert list(more) == list(names)
    _, start = repeats.recompress(np.array([b] + [c] * 30 + [a]), 3)
    assert list(start) == [0, 1, 31]


def test_passages_of_one_word(spark):
    """Long runs have no symbol inside, and are found all the same."""
    rows = [(1, "x y " + "a " * 120 + "z"), (2, "p " + "a " * 90 + "q r"), (3, "a " * 49 + "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, repeats.remove_repeats(df).collect()), key=str) == brute(rows, 50)
