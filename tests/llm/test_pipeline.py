import corpus_pipeline
from weftline.llm.common import fresh_path


def test_stages(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = fresh_path(spark, "stage")
        stage(spark, docs, path).write.parquet(out)
        docs = spark.read.parquet(out)
        kept.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.6 * kept[0]
    assert {"rate", "domain"} <= set(docs.columns)


def test_components(spark):
    from weftline.llm.common import components

    links = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (None, 4)] + [(100 + k, 101 + k) for k in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in (1, 2, 3, 9)} == {1} and got[5] == got[6] == 5
    assert {got[100 + k] for k in range(61)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages_keep_clashing_columns(spark):
    """Columns that have the names of inner ones come through every stage as they were; null, empty and repeated rows crash none."""
    from pyspark.sql import functions as F

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(120)
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (None, "the cat and the dog", "en", None, 19)], docs.schema)
    docs = docs.unionByName(docs.limit(5)).unionByName(extra)
    names = ["gone", "held", "held_id", "held_hash", "m_id", "m_hash", "score", "lang_pred", "domain", "rate", "cid", "rid", "t1", "n", "key", "x"]
    docs = docs.withColumns({n: F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        else:
            assert set(out.columns) - set(docs.columns) == {"domain_", "rate_"}
        path_out = fresh_path(spark, "stage")
        out.write.parquet(path_out)
        out = spark.read.parquet(path_out)
        wrong = F.lit(False)
        for n in names:
            wrong |= F.col(n) != F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
        assert out.where(wrong).count() == 0 and out.count() > 0, name
        assert stage(spark, docs.limit(0), path).count() == 0, name
        docs = out
