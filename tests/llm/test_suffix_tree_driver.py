"""What the driver keeps of the tree."""

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import functions as F
from weftline.llm import suffix_tree


def test_driver_keeps_no_bitmaps(spark):
    texts = spark.createDataFrame([(i, "a b c d e f g h") for i in range(40)], "doc_id long, text string")
    tree, _, _ = suffix_tree.fit(texts.select("doc_id", F.lit(False).alias("held_out"), F.lit(True).alias("learn"), "text"))
    assert tree.nodes and len(tree.nodes) == len(tree.entries) == len(tree.tables)
    assert all(isinstance(x, Broadcast) for x in (*tree.nodes, *tree.entries))
    assert not tree.__getstate__()["nodes"] and not tree.__getstate__()["entries"]


def test_bitmap_reaches_the_driver_in_pieces(spark, monkeypatch):
    """The driver is sent a bounded number of byte strings; it was sent a row for each 64 bits."""
    keys = suffix_tree.mix(np.arange(50_000, dtype=np.uint64))
    table = spark.createDataFrame(pa.table({"k": keys.view(np.int64)}))
    sizes, to_arrow = [], type(table).toArrow
    monkeypatch.setattr(type(table), "toArrow", lambda self: (sizes.append((x := to_arrow(self)).num_rows), x)[1])
    bits = suffix_tree.Bits(table)
    assert sizes and max(sizes) <= 256
    assert bits.has(keys).all() and bits.has(suffix_tree.mix(np.arange(50_000, 100_000, dtype=np.uint64))).mean() < 0.1
    assert not suffix_tree.Bits(table.limit(0)).has(keys).any()


def test_lookup_by_first_bits():
    keys = np.sort(suffix_tree.mix(np.arange(1000, dtype=np.uint64)))
    close = np.arange(5, dtype=np.uint64)  # all in one bucket
    for held in (keys, keys[:1], keys[:0], close, np.append(keys, np.uint64(2**64 - 1))):
        of = np.concatenate([held, keys + np.uint64(1), [np.uint64(0), np.uint64(2**64 - 1)]])
        assert (suffix_tree.Index(held).find(of) == [np.flatnonzero(held == x)[0] if (held == x).any() else -1 for x in of]).all()


def test_rows_to_be_joined_are_not_stored(spark, monkeypatch):
    """Only a row for each document is written; a row for each place that met a value that is not sent was, too."""
    texts = spark.createDataFrame([(i, "a b c d e f g h") for i in range(60)] + [(None, "a b x"), (None, None)], "doc_id long, text string")
    stored, write = {}, suffix_tree.written

    def counted(df, name):
        out = write(df, name)
        stored[name] = stored.get(name, 0) + (out.count() if name == "lm-scored" else 0)
        return out

    monkeypatch.setattr(suffix_tree, "written", counted)
    monkeypatch.setattr(suffix_tree, "SHIPPED", 2)
    out = suffix_tree.scores(texts, F.col("doc_id").isNotNull(), F.lit(False)).collect()
    assert len(out) == stored["lm-scored"] == 62
    assert sorted(r.n_tokens for r in out) == [1, 4, *[9] * 60] and len({r.score for r in out}) == 3
