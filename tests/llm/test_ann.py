from collections import defaultdict

import numpy as np
from weftline.llm import ann


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    n = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        s = x @ x[at] / (n * n[at])
        s[at] = -9
        out[q] = [(int(ids[o]), float(s[o])) for o in np.lexsort((ids, -s))[:k]]
    return out


def test_recall_and_scores(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = defaultdict(dict)
    for r in ann.search(v, v.where("vec_id % 50 = 0")).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    rows = [(r.vec_id, r.embedding) for r in v.collect()]
    want = brute(rows, list(got), 5)
    assert all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({x for x, _ in g.values()} & {x for x, _ in want[q]}) for q, g in got.items())
    assert hits >= 0.9 * 5 * len(got)
    exact = brute(rows, list(got), len(rows) - 1)
    for q, g in got.items():
        found, of = [g[k] for k in range(1, 6)], dict(exact[q])
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and all(abs(of[i] - s) < 1e-12 for i, s in found)


def test_edges(spark):
    same = [(i, [1.0, 0.0]) for i in range(300)]
    odd = [(1000, None), (1001, [0.0, 0.0]), (1002, [float("nan"), 1.0]), (1003, [1.0]), (1004, [1.0, None]), (1050, [0.0, 1.0]), (1050, [0.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in same + odd], "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 50 = 0 or vec_id is null")).orderBy("rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[250] == [0, 1, 2, 3, 4]
    assert got[1050] == [0, 1, 2, 3, 4] and 1000 not in got and None not in got
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 1, 1050)")
    assert ann.search(few, few.where("vec_id = 0")).count() == 2
