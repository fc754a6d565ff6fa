"""The first four stages against plain Python, over whole texts of a small table."""

import re

import corpus_pipeline
import numpy as np
import test_jaccard
import test_langid
import test_secrets
from weftline.llm import decontaminate, langid, secrets

PATH = "/root/testdata/sf0.001"


def language(rows):
    texts = [r["text"] for r in rows if r["text"] and any(c.isalpha() for c in r["text"])]
    found = dict(zip(texts, test_langid.brute([(r["text"], r["lang"]) for r in rows if r["text"] is not None and r["lang"] is not None], texts, langid.Settings()), strict=True))
    return [r for r in rows if r["text"] in found and found[r["text"]][1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE]


def near_copies(rows):
    groups = {d: c for d, n, c in test_jaccard.brute([(r["doc_id"], r["text"]) for r in rows], 80, 5) if n}
    return [r for r in rows if groups.get(r["doc_id"], r["doc_id"]) == r["doc_id"]]


def edits(item, text):
    """Least edits of an item against any part of a text."""
    row, ramp = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


def uncontaminated(rows, items):
    out = []
    for r in rows:
        t = decontaminate.normal(r["text"])
        numbers = decontaminate.codes_of(t)
        if not any(i in t or (int(0.06 * len(i)) and edits(decontaminate.codes_of(i), numbers) <= int(0.06 * len(i))) for i in items):
            out.append(r)
    return out


def spans(text):
    """``start, end, kind`` of values: assignments, access keys, hexadecimal runs and mixed tokens that touch none of these."""
    found = [(m.start(2), m.end(2), 0, m.start(), m.end()) for m in test_secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), k, m.start(), m.end()) for k, p in ((1, "AKIA[A-Z0-9]{16,}"), (2, "[0-9a-f]{24,}")) for m in re.finditer(p, text)]
    for m in re.finditer("[A-Za-z0-9_-]{24,}", text):
        if all(re.search(p, m[0]) for p in ("[a-z]", "[A-Z]", "[0-9]")) and not any(a < m.end() and b > m.start() for *_, a, b in found if _[2] < 3):
            found.append((m.start(), m.end(), 3, m.start(), m.end()))
    return [x[:3] for x in found]


def redacted(rows):
    owners, out = {}, []
    for r in rows:
        for a, b, _ in spans(r["text"]):
            owners.setdefault(r["text"][a:b], set()).add(r["source"])
    for r in rows:
        text, at, parts = r["text"], 0, []
        for a, b, kind in sorted(spans(text)):
            v = text[a:b]
            looks = len(set(v)) >= 8 and re.search("[0-9]", v) and re.search("[A-Za-z]", v)
            if len(owners[v]) > secrets.MAX_OWNERS or not (kind < 2 or looks):
                continue
            if a >= at:
                parts += [text[at:a], secrets.REDACTED]
            at = max(at, b)
        out.append((r["doc_id"], "".join(parts) + text[at:]))
    return out


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").where("length(text) < 1500 or text is null")
    rows = [r.asDict() for r in docs.collect()]
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect() if r.text]
    for (_, stage), plain in zip(corpus_pipeline.STAGES[:3], (language, near_copies, lambda x: uncontaminated(x, items)), strict=True):
        docs, rows = spark.createDataFrame(stage(spark, docs, PATH).collect(), docs.schema), plain(rows)
        assert sorted(r.doc_id for r in docs.collect()) == sorted(r["doc_id"] for r in rows)
    got = corpus_pipeline.STAGES[3][1](spark, docs, PATH).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(redacted(rows))
    assert all(r.n_chars == len(r.text) for r in got)
