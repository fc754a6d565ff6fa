"""Mixing sources to target weights by soft membership, in DataFrame operations only.

A Bayes classifier over telling words, word stems and marks of shape, learned from the
table of labels, gives every document a posterior over domains. Nonnegative document rates
are then fitted by projected-gradient least squares (with momentum), so that the expected
tokens of each domain (rate x tokens x posterior, summed) come as near to the target
weights as rates can bring them.

A gradient step depends on a document's posteriors only. Posteriors have three decimals,
so documents of equal posteriors have equal rates and are one cell of the fit with their
tokens summed; the table of cells has a bounded number of rows, however many documents
there are. Each round sums one number per domain over it; nothing per document is
collected. The fit ends when targets are met or it moves no more, after ``ROUNDS`` rounds
at the latest; what it misses then is returned. A target of 0 shuts out the documents that
are chiefly of that domain.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, own_name, written

# The domains, as the labels define them, and their default target weights.
DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.8, "low": 0.2, "toxic": 0.0}

#: Labelled rows that the classifier is fitted on at most.
TRAIN_ROWS = 20_000
#: A word or stem is kept if, at the lower end of a Wilson interval, this share of its labelled
#: documents (at least so many) is of one domain that is not the rule anyway. Words
#: that only tell languages apart tell nothing about a domain and are not kept.
LEAST_SHARE = 0.6
LEAST_DOCUMENTS = 6
Z = 1.96
STEM = 5
#: What parts words: blanks and common signs.
BETWEEN = r"""[\x20\x09-\x0D.,;:!?"'()|#*$%&]+"""
SMOOTHING = 0.5
#: Marks of shape depend on one another, so each weighs this much.
MARK_WEIGHT = 0.5
#: The fit ends when targets are met, or when totals move by less than this share of all tokens in some rounds together.
#: Where targets can't be met, the nearest totals are neared ever more slowly by rates ever
#: larger on ever fewer documents, so rounds are bounded; what is then missed is returned.
SETTLED = 1e-7
ROUNDS = 120
#: Rounds that are replayed from the last written rates.
REPLAYED = 40
#: Targets are met when every domain's tokens are within this share of all tokens.
TOLERANCE = 1e-3


def domain_of() -> F.Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


def _let(value, body) -> F.Column:
    """``body(value)`` with ``value`` computed once for each row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _marks(text, n, distinct):
    """Marks of a text's shape in steps: signs, distinct words, word length, size, bars, distinct lines and words in a line."""
    step = lambda name, value: F.concat(F.lit(f"\t{name}"), F.floor(value).cast("string"))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    size = F.char_length(text)
    signs, bars = F.char_length(F.regexp_replace(text, r"[\p{L}\s.,]+", "")), size - F.char_length(F.replace(text, F.lit("|"), F.lit("")))
    lines = F.split(text, "\n")
    return F.array(
        step("signs", 50 * per(signs, size)),
        step("distinct", 10 * per(distinct, n)),
        step("length", per(size, n)),
        step("size", F.log2(n + F.lit(1.0))),
        step("bars", 50 * per(bars, n)),
        step("lines", 10 * per(F.size(F.array_distinct(lines)), F.size(lines))),
        step("line", F.log2(F.lit(1.0) + per(n, F.size(lines)))),
    )


def featured(docs: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """Adds ``x``: ``n_tokens``, the words between blanks and common signs, ``features``, the distinct words and their first ``STEM`` letters, and ``marks``.

    With ``kept`` only those features are given; they are looked up in a hash set before anything is made distinct.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(F.lower(text), BETWEEN), "")
    head = lambda w: F.substring(w, 1, STEM)

    def with_words(ws):
        plain = F.array_distinct(ws)
        if kept is None:
            found = F.array_union(plain, F.transform(plain, head))
        else:
            stems = [k for k in kept if len(k) <= STEM]
            whole = F.filter(plain, lambda w: w.isin(kept))
            found = F.array_union(whole, F.filter(F.transform(plain, head), lambda w: w.isin(stems))) if stems else whole
        return _let(plain, lambda p: F.struct(F.size(ws).cast("long").alias("n_tokens"), found.alias("features"), _marks(text, F.size(ws), F.size(p)).alias("marks")))

    return docs.withColumn("x", _let(words, with_words))


def labelled(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, domain`` of at most about ``train_rows`` labelled documents, chosen by a hash of the id.

    Labels with a null id or no domain are left out. The chosen ids are bounded and sent
    to all executors, so the texts are not shuffled.
    """
    rows = labels.select("doc_id", domain_of().alias("domain")).where("doc_id is not null and domain is not null").dropDuplicates(["doc_id"])
    n = rows.count()
    if n > train_rows:
        rows = rows.where(F.xxhash64("doc_id") < min(int(train_rows / n * 2**64) - 2**63, 2**63 - 1))
    return docs.select("doc_id", "text").join(F.broadcast(rows.limit(2 * train_rows)), "doc_id")


def fit_classifier(rows: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """``feature, w_<domain>`` rows and the log priors, out of ``text, domain`` rows; a domain without labels gets weight zero and a very low prior."""
    found = written(featured(rows).select("domain", "x.features", "x.marks"), "mixing-labelled")
    sizes = {r[0]: r[1] for r in found.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    parts = found.select("domain", F.lit(False).alias("mark"), F.explode("features").alias("feature")).unionByName(found.select("domain", F.lit(True).alias("mark"), F.explode("marks").alias("feature")))
    counts = parts.groupBy("mark", "feature").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in DOMAINS], F.count("*").alias("n"))
    telling, weights = [], []
    for d in DOMAINS:
        prior = sizes.get(d, 0) / max(1, total)
        share, n, zz = F.col(d) / F.col("n"), F.col("n"), Z * Z
        lower = (share + zz / (2 * n) - Z * F.sqrt(share * (1 - share) / n + zz / (4 * n * n))) / (1 + zz / n)
        telling.append(F.when(F.lit(0 < prior < LEAST_SHARE), lower).otherwise(0.0))
        # marks are common, so they start from the prior; a word or stem is kept for what it tells
        mark = F.log((F.col(d) + 4 * prior) / (F.col("n") + 4)) - math.log(prior) if prior else F.lit(0.0)
        word = F.log((F.col(d) + SMOOTHING) / (F.col("n") + len(DOMAINS) * SMOOTHING)) - math.log(prior) if prior else F.lit(0.0)
        weights.append(F.when(F.col("mark"), MARK_WEIGHT * mark).otherwise(word).alias(f"w_{d}"))
    scored = counts.select("mark", "feature", F.greatest(*telling).alias("told"), "n", *weights).where(F.col("mark") | ((F.col("told") >= LEAST_SHARE) & (F.col("n") >= LEAST_DOCUMENTS)))
    model = written(scored.select("mark", "feature", *[f"w_{d}" for d in DOMAINS]), "mixing-model")
    dropped(found)
    return model, {d: math.log((sizes.get(d, 0) + SMOOTHING) / (total + len(DOMAINS) * SMOOTHING)) for d in DOMAINS}


def posteriors(docs: DataFrame, model: DataFrame, prior: dict[str, float]) -> DataFrame:
    """``rid, doc_id, text_hash, n_tokens, p_<domain>`` of every document, as a written table without texts.

    The words of the model (bounded by its sample) are looked up within each document,
    so only what is found is joined with its weights.
    """
    kept = sorted(r[0] for r in model.where("not mark").select("feature").collect())
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid"))  # below the explode, so once per document
    rows = featured(rows, kept).select("rid", "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.col("x.n_tokens"), F.explode(F.concat("x.features", "x.marks")).alias("feature"))
    sums = rows.join(F.broadcast(model.drop("mark")), "feature", "left").groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("n_tokens").alias("n_tokens"), *[F.sum(F.coalesce(f"w_{d}", F.lit(0.0))).alias(f"s_{d}") for d in DOMAINS])
    logits = {d: F.round(F.col(f"s_{d}") + prior[d], 6) for d in DOMAINS}
    top = F.greatest(*logits.values())
    powers = [F.exp(x - top) for x in logits.values()]
    p = [F.round(x / sum(powers[1:], powers[0]), 3) for x in powers]
    p[0] = F.round(1.0 - sum(p[2:], p[1]), 3)
    return written(sums.select("rid", "doc_id", "text_hash", "n_tokens", *[x.alias(f"p_{d}") for d, x in zip(DOMAINS, p, strict=True)]), "mixing-members")


def memberships(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """:func:`posteriors` of ``docs`` by a classifier of its own labelled rows."""
    docs = docs.select("doc_id", "text")
    return posteriors(docs, *fit_classifier(labelled(docs, labels, train_rows)))


def _largest(m: list[list[float]]) -> float:
    """The largest eigenvalue of a symmetric matrix of nonnegative numbers, from above."""
    v = [1.0] * len(m)
    for _ in range(200):
        w = [sum(a * x for a, x in zip(row, v, strict=True)) for row in m]
        size = max(w) or 1.0
        v = [x / size for x in w]
    return 1.0001 * size


def _replayed(steps: list[tuple[float, list[float]]], posteriors: list[str]):
    """``r, q`` (the rates now and a round ago) after further rounds of momentum and gradient, each cut off at zero."""
    start = F.struct(F.col("r").alias("r"), F.col("q").alias("q"))
    if not steps:
        return start
    taken = F.array(*[F.array(F.lit(float(b)), *[F.lit(float(x)) for x in g]) for b, g in steps])

    def step(s, x):
        ahead = s["r"] + F.get(x, 0) * (s["r"] - s["q"])
        return F.struct(F.greatest(F.lit(0.0), ahead - sum((F.col(y) * F.get(x, k + 1) for k, y in enumerate(posteriors)), F.lit(0.0))).alias("r"), s["r"].alias("q"))

    return F.aggregate(taken, start, step)


def chief_domain() -> F.Column:
    """The domain of largest posterior, ties in the order of ``DOMAINS``."""
    best = F.greatest(*[F.col(f"p_{d}") for d in DOMAINS])
    domain = F.lit(None).cast("string")
    for d in reversed(DOMAINS):
        domain = F.when(F.col(f"p_{d}") == best, d).otherwise(domain)
    return domain


def fit_rates(members: DataFrame, targets: dict[str, float], rounds: int = ROUNDS) -> tuple[DataFrame, dict]:
    """``p_<domain>, r`` of each cell, and ``share, residual, rounds, settled`` of the fit.

    A target of 0 shuts a domain out: documents that are chiefly of it have the rate 0, and
    the others, each of which is a little of it, are fitted to the targets of the other
    domains. ``share`` is each domain's part of all tokens at the end, ``residual`` the
    largest distance from a target that is not 0: within ``TOLERANCE`` where targets can be
    met (and ``settled``), else about what the nearest rates leave.
    """
    p = [f"p_{d}" for d in DOMAINS]
    wanted = [d for d in DOMAINS if targets.get(d, 0.0) > 0] or list(DOMAINS)
    q = [f"p_{d}" for d in wanted]
    start = F.when(chief_domain().isin(*wanted), 1.0).otherwise(0.0)
    every = written(members.groupBy(*p).agg(F.sum("n_tokens").alias("n")).withColumn("r", start), "mixing-cells")
    # a round is a sum over few rows: not more tasks than they fill
    few = 1 + every.count() // 50_000
    cells = written(every.where("r > 0").select(*p, "n", "r", F.col("r").alias("q")).coalesce(few), "mixing-cells")
    total = every.agg(F.sum("n")).first()[0] or 0
    weight = sum(targets.get(d, 0.0) for d in wanted) or 1.0
    goal = [targets.get(d, 0.0) / weight for d in wanted]
    report = {"share": dict.fromkeys(DOMAINS, 0.0), "residual": max(goal), "rounds": 0, "settled": True}
    products = cells.agg(*[F.sum(F.col("n") * F.col(a) * F.col(b)) for a in q for b in q]).first()
    if not total or not any(products):
        return every.select(*p, "r"), report
    k = len(wanted)
    length = 1.0 / _largest([[(x or 0) / total for x in products[k * i : k * i + k]] for i in range(k)])
    steps: list[tuple[float, list[float]]] = []
    pace, before, quiet, settled = 1.0, None, 0, False

    def sums(momentum):
        s = F.col("s")
        ahead = s["r"] + momentum * (s["r"] - s["q"])
        row = cells.withColumn("s", _replayed(steps, q)).agg(*[F.sum(F.col("n") * F.col(x) * ahead) for x in q], *[F.sum(F.col("n") * F.col(x) * s["r"]) for x in q]).first()
        return [x / total for x in row[:k]], [x / total for x in row[k:]]

    done = 0
    for done in range(1, rounds + 1):
        following = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        momentum = round((pace - 1) / following, 9)
        ahead, now = sums(momentum)
        if before is not None:
            quiet = quiet + 1 if max(abs(a - b) for a, b in zip(now, before, strict=True)) <= SETTLED else 0
            worse = sum((a - g) ** 2 for a, g in zip(now, goal, strict=True)) > sum((b - g) ** 2 for b, g in zip(before, goal, strict=True))
            if worse:  # momentum has gone too far: begin it anew
                following, momentum = 1.0, 0.0
                ahead = now
        if quiet >= 4 or max(abs(a - g) for a, g in zip(now, goal, strict=True)) <= TOLERANCE / 10:
            settled = True
            break
        steps.append((momentum, [round(length * (a - g), 12) for a, g in zip(ahead, goal, strict=True)]))
        pace, before = following, now
        if len(steps) == REPLAYED:
            last, cells = cells, written(cells.withColumn("s", _replayed(steps, q)).select(*p, "n", F.col("s.r").alias("r"), F.col("s.q").alias("q")).coalesce(few), "mixing-cells")
            dropped(last)
            steps = []
    fitted = cells.withColumn("s", _replayed(steps, q)).select(*p, "n", F.col("s.r").alias("r"))
    out = written(fitted.unionByName(every.where("r = 0").select(*p, "n", "r")).coalesce(few), "mixing-cells")
    dropped(cells, every)
    shares = [(x or 0) / total for x in out.agg(*[F.sum(F.col("n") * F.col(x) * F.col("r")) for x in p]).first()]
    report["share"] = dict(zip(DOMAINS, shares, strict=True))
    report |= {"residual": max(abs(report["share"][d] - g) for d, g in zip(wanted, goal, strict=True)), "rounds": done, "settled": settled}
    return out.select(*p, "r"), report


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, n_tokens, p_<domain>, domain, rate, expected_tokens, residual`` for each row of ``doc_id, text``.

    ``residual`` is the same on every row: how far, as a part of all tokens, the fit's
    totals are at most from the targets that are not 0. Null, empty and blank texts have no tokens and a
    rate that moves no total; repeated rows each have their own; without labels all domains
    are equally likely; an empty table gives no rows; other columns are left out. Posteriors
    have three places, rates six.
    """
    return rated(memberships(docs, labels, train_rows), targets).drop("rid", "text_hash")


def rated(members: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Members with their fitted rates, looked up by cell (bounded, so sent to all executors)."""
    cells, report = fit_rates(members, TARGETS if targets is None else targets)
    p = [f"p_{d}" for d in DOMAINS]
    rate = F.round("r", 6)
    out = members.join(F.broadcast(cells), p)
    return out.select("rid", "doc_id", "text_hash", "n_tokens", *p, chief_domain().alias("domain"), rate.alias("rate"), F.round(rate * F.col("n_tokens"), 3).alias("expected_tokens"), F.lit(round(report["residual"], 9)).alias("residual"))


def sampled_at(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with ``domain`` and ``rate``, without the rows whose rate is zero.

    Where ``docs`` has columns of those names, the new ones are lengthened by ``_``. Null
    and empty texts are judged by what an empty text looks like; null ids take part;
    repeated rows are treated alike; an empty table gives no rows.
    """
    names = {k: own_name(docs, k) for k in ("domain", "rate", "m_id", "m_hash")}
    found = rated(memberships(docs, labels), targets).where("rate > 0").groupBy(F.col("doc_id").alias(names["m_id"]), F.col("text_hash").alias(names["m_hash"])).agg(F.first("domain").alias(names["domain"]), F.first("rate").alias(names["rate"]))
    found = written(found, "mixing-rates")
    on = docs["doc_id"].eqNullSafe(found[names["m_id"]]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found[names["m_hash"]])
    return docs.join(found, on).drop(names["m_id"], names["m_hash"])
