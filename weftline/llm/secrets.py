"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found per kind by regular expressions: ``split`` gives the gaps between the
matches and ``regexp_extract_all`` the matches, and running sums of their lengths give
places in code points. The values are hashed and counted over the corpus by distinct
repositories and owners. A value that more than ``MAX_OWNERS`` owners hold is a copied
example; one that belongs to few is live if it stands in an assignment, has a provider's
prefix or looks random. Besides the base kinds,
long mixed tokens count as secrets of kind ``owned`` where they are live and touch no base span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import own_name, written

# The base kinds in their order, then the kind that the method adds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "owned": r"[A-Za-z0-9_-]{24,}",
}
KINDS = list(PATTERNS)
BASE = KINDS[:3]
ASSIGN_LEAST = 6

MAX_OWNERS = 2
#: A live value has at least so many different characters.
LIVE_DISTINCT = 8
#: Rows up to which live values per document are sent to all executors.
BROADCAST_ROWS = 100_000
REDACTED = "<SECRET>"


def candidates(docs: DataFrame, repository: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` without text (``rid, doc_id, text_hash, repository, owner``), and one row per candidate.

    A candidate has ``rid, kind (index), start, stop, value`` and where it was found.
    Running sums go over one kind in one document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.col(repository).cast("string").alias("repository"),
        F.col(owner).cast("string").alias("owner"),
        *[F.when(F.regexp_like(text, F.lit(p)), F.arrays_zip(F.transform(F.split(text, p, -1), F.char_length).alias("gap"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("hit"))).alias(k) for k, p in PATTERNS.items()],
    )
    found = written(found, "secrets-found")
    parts = None
    for index, k in enumerate(KINDS):
        rows = found.where(F.col(k).isNotNull()).select("rid", "doc_id", "text_hash", "repository", "owner", F.lit(index).alias("kind"), F.posexplode(k).alias("i", "x"))
        parts = rows if parts is None else parts.unionByName(rows)
    size = F.char_length(F.col("x.hit"))
    before = W.partitionBy("rid", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = parts.where("x.hit is not null").withColumn("stop", F.sum(F.col("x.gap") + size).over(before))
    value = F.when(F.col("kind") == 0, F.regexp_extract(F.col("x.hit"), ASSIGN, 2)).otherwise(F.col("x.hit"))
    rows = rows.select("rid", "doc_id", "text_hash", "repository", "owner", "kind", (F.col("stop") - size).cast("long").alias("start"), F.col("stop").cast("long"), value.alias("value"))
    rows = rows.where((F.col("kind") > 0) | (F.char_length("value") >= ASSIGN_LEAST))
    mixed = F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[0-9]")
    return found.select("rid", "doc_id", "text_hash"), rows.where((F.col("kind") < len(BASE)) | mixed)


def ownership(rows: DataFrame) -> DataFrame:
    """``hash, n_owners, n_repositories, n_places`` of each value: repositories and owners are made distinct one after the other, with partial sums at each step. A null owner or repository is one more."""
    by_repo = rows.groupBy("hash", "owner", "repository").agg(F.count("*").alias("places"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("places").alias("places"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("places").alias("n_places"))


def judged(docs: DataFrame, repository: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS) -> tuple[DataFrame, DataFrame]:
    """The documents of :func:`candidates`, and its candidates with ``hash``, ownership counts and ``live``; overlapping or unowned ``owned`` rows are left out."""
    own, rows = candidates(docs, repository, owner)
    rows = rows.withColumn("hash", F.sha2("value", 256))
    base = F.col("kind") < len(BASE)
    doc = W.partitionBy("rid").orderBy("start", "kind")
    ended = F.max(F.when(base, F.col("stop"))).over(doc.rowsBetween(W.unboundedPreceding, -1))
    begins = F.min(F.when(base, F.col("start"))).over(doc.rowsBetween(1, W.unboundedFollowing))
    touches = F.coalesce(ended > F.col("start"), F.lit(False)) | F.coalesce(begins < F.col("stop"), F.lit(False))
    rows = rows.withColumn("touches", touches).where(base | ~F.col("touches")).drop("touches")
    rows = written(rows, "secrets-candidates")
    counted = rows.join(written(ownership(rows), "secrets-owned"), "hash")  # two plain exchanges: a skewed key can be split
    random = (F.size(F.array_distinct(F.split("value", ""))) >= LIVE_DISTINCT) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    # what stands in an assignment or has a provider's prefix is a secret by its place; anything else must look random
    live = (F.col("n_owners") <= max_owners) & (F.col("kind").isin(0, 1) | random)
    counted = counted.withColumn("live", live)
    return own, counted.where(base | F.col("live"))


def _joined(spans) -> F.Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])))


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example`` for each row of ``docs``.

    Base spans stay whatever their ownership; ``n_live`` and ``n_example`` count spans
    that look live and those that too many owners hold. Null, empty or clean texts give
    no spans; repeated rows each give a row; null owners count as one owner; an empty
    table gives no rows; other columns are left out.
    """
    own, rows = judged(docs, repository, owner, max_owners)
    span = F.struct("start", "kind", "stop")
    base = F.col("kind") < len(BASE)
    each = rows.groupBy("rid").agg(
        *[F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.collect_list(F.when(base, span)).alias("base"),
        F.collect_list(span).alias("all"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(F.col("n_owners") > max_owners, 1)).alias("n_example"),
    )
    each = each.select("rid", *[f"n_{k}" for k in BASE], _joined(F.col("base")).alias("base"), _joined(F.col("all")).alias("spans"), "n_live", "n_example")
    out = own.join(each, "rid", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *[none(f"n_{k}") for k in BASE], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), none("n_live"), none("n_example"))


def redact(docs: DataFrame, repository: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """``docs`` with every live value replaced by ``<SECRET>`` where it was found, and ``n_chars`` counted anew there.

    All rows and columns stay, whatever their names; examples that many owners hold stay
    as they are. Null and empty texts hold nothing; rows that repeat are changed alike;
    an empty table gives no rows.
    """
    _, rows = judged(docs, repository, owner, max_owners)
    names = {k: own_name(docs, k) for k in ("held", "held_id", "held_hash")}
    value = F.struct((F.col("stop") - F.char_length("value")).cast("int").alias("a"), F.col("stop").cast("int").alias("b"))
    held = rows.where("live").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(value)).alias(names["held"]))
    held = written(held.withColumnsRenamed({"doc_id": names["held_id"], "text_hash": names["held_hash"]}), "secrets-held")
    side = F.broadcast(held) if held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else held
    out = docs.join(side, docs["doc_id"].eqNullSafe(side[names["held_id"]]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == side[names["held_hash"]]), "left")
    values, whole = side[names["held"]], docs["text"]

    def cut(state, x):
        """Text up to the value and its mark; a value that begins within one before it only lengthens that one."""
        more = F.concat(state["out"], F.substr(whole, state["at"] + 1, x["a"] - state["at"]), F.lit(REDACTED))
        return F.when(x["a"] >= state["at"], F.struct(x["b"].alias("at"), more.alias("out"))).otherwise(F.struct(F.greatest(state["at"], x["b"]).alias("at"), state["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.when(values.isNotNull(), F.aggregate(values, start, cut, lambda state: F.concat(state["out"], F.substr(whole, state["at"] + 1)))).otherwise(whole)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(text.alias(c))
        elif c == "n_chars":
            columns.append(F.when(values.isNotNull(), F.char_length(text)).otherwise(docs[c]).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(docs[f"`{c}`"])
    return out.select(*columns)
