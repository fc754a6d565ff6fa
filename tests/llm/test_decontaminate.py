import random

from weftline.llm import decontaminate as d


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def items():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeot") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    return [(k, " ".join(rng.choice(words) for _ in range(rng.choice([6, 20, 45])))) for k in range(12)]


def test_against_brute_force():
    own, rng = items(), random.Random(1)
    index = d.Index(own)
    for _ in range(120):
        i, text = rng.choice(own)
        letters = list(text)
        for _ in range(rng.randint(0, len(text) // 10)):
            k, how = rng.randrange(len(letters)), rng.random()
            if how < 0.33:
                letters[k] = rng.choice("abc")
            elif how < 0.66:
                letters.insert(k, "z")
            else:
                del letters[k]
        doc = "lorem ipsum " * rng.randint(0, 9) + "".join(letters) + " dolor" * rng.randint(0, 9)
        least = edits(d.normal(text), d.normal(doc))
        found = [m for m in index.matches(doc) if m[0] == i]
        most = int(index.k[i])
        assert (least <= most) == bool(found)
        if found:
            _, start, end, n, _ = found[0]
            assert n == least and edits(d.normal(text), d.normal(doc)[start:end]) == least


def test_characters_and_short_items():
    """One character is one edit, whatever its bytes; items too short for the bound are aligned all the same."""
    own = [(1, "äöü ßéè ñçå œæø ðþý"), (2, "abcdefghijklmnopq"), (3, "xy zw")]
    index = d.Index(own)
    assert list(index.k) == [1, 1, 0]
    assert [m[0] for m in index.matches("… äöü ßéè nçå œæø ðþý …")] == [1]
    assert [m[0] for m in index.matches("… äöu ßéè nçå œæø ðþý …")] == []
    assert [(m[0], m[3]) for m in index.matches("zz abcdefgh-jklmnopq zz")] == [(2, 1)]
    assert [(m[0], m[1], m[2]) for m in index.matches("q xy zw")] == [(3, 2, 7)]
    loose = d.Index([(1, "abcdefgh")], 0.25)
    assert loose.whole == [0] and [m[3] for m in loose.matches("12 abXdeYgh 34")] == [2] and not loose.matches("12 aXXdeYgh 34")


def test_table_and_blocks(spark):
    own = items()
    bench = spark.createDataFrame([(i, t, "x") for i, t in own] + [(99, None, "x"), (98, "", "x"), (97, "tiny", "x"), (0, own[0][1], "x")], "item_id long, text string, doc_id string")
    rows = [(1, own[3][1].upper()), (1, own[3][1].upper()), (2, None), (3, ""), (4, "clean words only"), (None, "x  " + own[5][1].replace(" ", "\n")), (5, "long " * 100_000 + own[0][1]), (6, "a tiny word")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    want = sorted([("1", 3), ("1", 3), ("None", 5), ("5", 0), ("6", 97)])
    for size in (1 << 23, 300):
        got = sorted((str(r.doc_id), r.item_id) for r in d.matches(docs, bench, block_bytes=size).collect())
        assert got == want
        assert sorted(str(r.doc_id) for r in d.clean(docs, bench, block_bytes=size).collect()) == ["2", "3", "4"]
    assert d.matches(docs.limit(0), bench).count() == 0 and d.matches(docs, bench.limit(0)).count() == 0


def test_planted_items_are_found(spark):
    path = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in d.matches(docs, bench).collect()}
    texts = [(r.item_id, r.text) for r in bench.collect()]
    assert {(r.doc_id, i) for r in docs.collect() if r.text for i, t in texts if t in r.text} <= found
