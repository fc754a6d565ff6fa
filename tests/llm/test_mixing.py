import numpy as np
from weftline.llm import mixing
from pyspark.sql import functions as F


def members_of(spark, p, n):
    rows = [(i, i, 0, int(n[i]), *map(float, p[i])) for i in range(len(n))]
    return spark.createDataFrame(rows, "rid long, doc_id long, text_hash long, n_tokens long, p_high double, p_low double, p_toxic double")


def some_posteriors(seed, alpha):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet(alpha, 400).round(3)
    p[:, 0] = (1 - p[:, 1] - p[:, 2]).round(3)
    return p, rng.integers(0, 900, 400)


def test_feasible_targets_are_met(spark):
    p, n = some_posteriors(3, [0.3, 0.3, 0.3])
    cells, report = mixing.fit_rates(members_of(spark, p, n), {"high": 0.5, "low": 0.3, "toxic": 0.2})
    assert report["settled"] and report["residual"] <= mixing.TOLERANCE
    assert cells.where("r < 0").count() == 0


def test_fit_is_least_squares(spark):
    """Where a target can't be met, the squared miss is no larger than plain projected gradients leave after ten times as many rounds."""
    p, n = some_posteriors(4, [3.0, 1.0, 0.4])
    goal = np.array([0.04, 0.06, 0.9])
    cells, report = mixing.fit_rates(members_of(spark, p, n), dict(zip(mixing.DOMAINS, goal.tolist(), strict=True)))
    a = (n[:, None] * p) / n.sum()
    r, size = np.ones(400), np.linalg.norm((n[:, None] * p).T @ p / n.sum(), 2)
    for _ in range(10 * mixing.ROUNDS):
        r = np.maximum(0, r - p @ (a.T @ r - goal) / size)
    got = np.array([report["share"][d] for d in mixing.DOMAINS])
    assert ((got - goal) ** 2).sum() <= ((a.T @ r - goal) ** 2).sum() + 1e-9
    assert abs(report["residual"] - max(abs(got - goal))) < 1e-12 and cells.where("r < 0").count() == 0


def test_a_target_of_zero_shuts_a_domain_out(spark):
    p, n = some_posteriors(6, [4.0, 1.0, 0.6])
    cells, report = mixing.fit_rates(members_of(spark, p, n), {"high": 0.8, "low": 0.2, "toxic": 0.0})
    rates = {(r.p_high, r.p_low, r.p_toxic): r.r for r in cells.collect()}
    chief = {k: k.index(max(k)) for k in rates}
    assert all(rates[k] == 0 for k in rates if chief[k] == 2)
    assert sum(rates[k] == 0 for k in rates if chief[k] != 2) <= 0.02 * len(rates)
    assert report["settled"] and report["residual"] <= mixing.TOLERANCE


def test_held_out_accuracy(spark):
    """Learned from four fifths of the labels, judged on the others; posteriors differ from document to document."""
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    truth = labels.where(held).select("doc_id", mixing.domain_of().alias("truth")).where("truth is not null")
    model, prior = mixing.fit_classifier(mixing.labelled(docs, labels.where(~held)))
    found = mixing.posteriors(docs.join(F.broadcast(truth.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text"), model, prior).join(truth, "doc_id")
    best = F.greatest("p_high", "p_low", "p_toxic")
    guess = F.when(F.col("p_high") == best, "high").when(F.col("p_low") == best, "low").otherwise("toxic")
    seen = {(r.truth, r.guess): r.n for r in found.groupBy("truth", guess.alias("guess")).agg(F.count("*").alias("n")).collect()}
    of = lambda d: sum(n for (t, _), n in seen.items() if t == d)
    assert seen[("high", "high")] >= 0.9 * of("high") and seen[("low", "low")] >= 0.8 * of("low") and seen[("toxic", "toxic")] >= 0.75 * of("toxic")
    assert found.select("p_high", "p_low", "p_toxic").distinct().count() >= 0.05 * found.count()


def test_toxic_documents_go_and_clean_ones_stay(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    out = mixing.mix(docs, labels).join(labels.select("doc_id", mixing.domain_of().alias("truth")), "doc_id")
    seen = {(r.truth, r.gone): r.n for r in out.groupBy("truth", (F.col("rate") == 0).alias("gone")).agg(F.count("*").alias("n")).collect()}
    assert seen.get(("toxic", True), 0) >= 0.6 * sum(n for (d, _), n in seen.items() if d == "toxic")
    assert seen.get(("high", True), 0) <= 0.03 * sum(n for (d, _), n in seen.items() if d == "high")
    assert out.first().residual <= mixing.TOLERANCE


def test_a_share_of_very_many_labels_is_not_nothing():
    assert int(mixing.TRAIN_ROWS / 1e13 * 2**64) - 2**63 > -(2**63)


def test_edges(spark):
    rows = [(1, "good words here"), (1, "good words here"), (2, None), (3, ""), (None, "other"), (4, "w " * 100_000)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, rate double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, labels).collect()
    assert len(out) == 6 and all(r.rate >= 0 for r in out)
    assert {r.doc_id: r.n_tokens for r in out} == {1: 3, 2: 0, 3: 0, None: 1, 4: 100_000}
    assert mixing.mix(docs.limit(0), labels).count() == 0 and mixing.mix(docs, labels.limit(0)).count() == 6
