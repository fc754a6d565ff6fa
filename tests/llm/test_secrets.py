import hashlib
import random
import re

from weftline.llm import secrets
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    t = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    names = ("assign", "access", "hex")
    joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return tuple(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(joined.encode()).hexdigest(), joined


def test_against_brute_force(spark):
    rng = random.Random(2)
    parts = ["password", "TOKEN", "=", ":", " ", "  ", '"', "'", "AKIA", "ABCDEF0123456789", "abcdef0123", "0123456789abcdef", "secret=", "api_key", "apikey: ", "é", "𝒳", "x", "\n", "abcdef", "Zq9_-kK3", "https://"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60))), f"s{i % 5}") for i in range(300)]
    rows += [(1000, None, None), (1001, "", None), (1002, "token=abc" * 9000 + " password: hunter22", "s1"), (1003, rows[5][1], "s9"), (1003, rows[5][1], "s9")]
    texts = {i: t for i, t, _ in rows}
    out = secrets.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, kind string").repartition(3)).collect()
    assert len(out) == len(rows)
    for r in out:
        counts, sha, joined = brute(texts[r.doc_id])
        assert ((r.n_assign, r.n_access, r.n_hex), r.base_sha256) == (counts, sha)
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_copied_examples_are_not_live(spark):
    shared, own = "token = 'aB3dE5fG7hJ9kL1m'", "token = 'zY8xW6vU4tS2rQ0p'"
    rows = [(k, f"see {shared} here", f"s{k}") for k in range(6)] + [(100, own, "s1"), (101, own, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_live, r.n_example) for r in secrets.scan(df).collect()}
    assert got[0] == (0, 1) and got[100] == (1, 0)
    texts = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert texts[0] == rows[0][1] and texts[100] == "token = '<SECRET>'"


def test_added_spans(spark):
    df = spark.createDataFrame([(1, "key Ab3dE5fG7hJ9kL1mNoPqRs7t end", "s")], "doc_id long, text string, source string")
    assert secrets.scan(df).first().spans == "owned:4:28"


def test_redaction_by_place_and_clashing_names(spark):
    rows = [
        (1, "the hunter says password: hunter, token='ab12cd' é𝒳 secret=abcdefg", "s", "h", 1),
        (2, None, "s", "h", 2),
        (3, "", None, None, 3),
        (1, "the hunter says password: hunter, token='ab12cd' é𝒳 secret=abcdefg", "s", "h", 1),
        (None, "key Ab3dE5fG7hJ9kL1mNoPqRs7t end", "s", "h", 4),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, held string, n_chars long")
    df = df.withColumn("held_id", F.lit(1)).withColumn("held_hash", F.lit(2)).withColumn("kind", F.lit("k"))
    out = secrets.redact(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text, r.n_chars, r.held) for r in out.collect()), key=str)
    cut = "the hunter says password: <SECRET>, token='<SECRET>' é𝒳 secret=<SECRET>"
    assert got == sorted([(1, cut, len(cut), "h")] * 2 + [(2, None, 2, "h"), (3, "", 3, None), (None, "key <SECRET> end", 16, "h")], key=str)
    assert secrets.redact(df.limit(0)).count() == 0
