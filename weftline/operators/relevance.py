"""Relevance of associations to a context, and the first story search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lists import token_overlap
from .graph import EXPRESSES

# The association vocabulary (type, phrase, inverse phrase), as the data uses it.
VOCABULARY = [
    (3, "contains", "belongs to or is part of"),
    (3, "generalizes", "is a special case of"),
    (2, "may originate from", "may be the source or origin of"),
    (2, "may be provided by", "may provide"),
    (2, "is maintained by", "maintains"),
    (2, "depends on", "partly determines"),
    (2, "may be caused by", "can cause"),
    (2, "may use", "may be used by"),
    (4, "is called", "is a name for"),
    (4, "expresses an attribute", "is an attribute of"),
    (4, "promises", "is promised by"),
    (4, "has an instance or particular case", "is a particular case of"),
    (4, "has value or state", "is the state or value of"),
    (4, "has argument or parameter", "is a parameter or argument of"),
    (4, "has the role of", "is a role fulfilled by"),
    (4, "has the outcome", "is the outcome of"),
    (4, "has function", "is the function of"),
    (4, "has constraint", "constrains"),
    (4, "has interpretation", "is interpreted from"),
    (1, "seen concurrently with", "seen concurrently with"),
    (1, "also known as", "also known as"),
    (1, "is approximately", "is approximately"),
    (1, "may be related to", "may be related to"),
]
# What counts for a search in all contexts, and the mark of a negated phrase.
ANY_BONUS = 80
NEGATED = "NOT"


def vocabulary(spark) -> DataFrame:
    return spark.createDataFrame(VOCABULARY, "atype int, fwd string, bwd string")


def with_vocabulary(tuples: DataFrame) -> DataFrame:
    """Adds type and inverse phrase to ``src, fwd, dst``; phrases that are not in the vocabulary stay without."""
    return tuples.join(F.broadcast(vocabulary(tuples.sparkSession)), "fwd", "left")


def common_prefix(x: Column, y: Column) -> Column:
    shorter = F.least(F.char_length(x), F.char_length(y))
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda k: (k <= shorter) & (F.left(x, k) == F.left(y, k))))


def prefix_overlap(intended: Column, actual: Column) -> Column:
    """Common prefixes of over three letters of all pairs of tokens, as a share of the whole actual text; it can exceed 100."""
    tokens = lambda c: F.filter(F.split(c, "[ ,]+"), lambda t: t != "")
    scores = F.flatten(F.transform(tokens(intended), lambda x: F.transform(tokens(actual), lambda y: common_prefix(x, y))))
    total = F.aggregate(scores, F.lit(0), lambda a, s: a + F.when(s > 3, s).otherwise(0))
    return F.when(F.char_length(actual) > 0, F.floor(100 * total / F.char_length(actual))).otherwise(0).cast("long")


def relevance(concept: Column, phrase: Column, following: Column, context: Column, wanted: Column) -> Column:
    """How a next concept bears on the searched concept and context; a negated phrase never does."""
    score = F.when(wanted == "any", ANY_BONUS).otherwise(0) + token_overlap(concept, following) + token_overlap(wanted, following) + token_overlap(wanted, context)
    return F.when(phrase.startswith(NEGATED), 0).otherwise(score).cast("long")


def split_context(wanted: Column) -> Column:
    """``positive, negative`` of ``X but not Y``; a null context is ``any``."""
    cut = F.split(F.coalesce(wanted, F.lit("any")), " *but not *", 2)
    return F.struct(cut[0].alias("positive"), F.coalesce(F.get(cut, 1), F.lit("")).alias("negative"))


def signed_relevance(positive: Column, negative: Column, following: Column, context: Column) -> Column:
    """Mean over all wanted and unwanted contexts (arrays) of what they share, unwanted ones counting against; null without any."""
    plus = F.aggregate(positive, F.lit(0).cast("long"), lambda a, p: a + prefix_overlap(p, following) + prefix_overlap(p, context))
    minus = F.aggregate(negative, F.lit(0).cast("long"), lambda a, p: a + prefix_overlap(p, context))
    n = F.size(positive) + F.size(negative)
    return F.when(n > 0, F.floor((plus - minus) / n + 0.5)).cast("long")


def by_relevance(edges: DataFrame, score: str = "relevance", least: int = 0) -> DataFrame:
    """Adds ``place`` of an edge among those of its vertex and type, most relevant first; irrelevant ones go."""
    w = W.partitionBy("src", "atype").orderBy(F.desc(score), "dst")
    return edges.where(F.col(score) >= least).withColumn("place", F.row_number().over(w))


def ranked(stories: DataFrame, score: str = "score") -> DataFrame:
    """Stories, the best first, ties by path."""
    return stories.orderBy(F.desc(score), "path")


def concepts_like(vertices: DataFrame, part: str, name: str = "name") -> DataFrame:
    """Where a search has no subject: the concepts whose name holds the context."""
    return vertices.where(F.contains(F.col(name), F.lit(part)))


#: Order in which types are followed: from a start, and further on.
FIRST, LATER = (2, 1, 3, 4), (4, 2, 1, 3)


def expansion_place(atype: Column, later: bool = False) -> Column:
    """Place of an association type in the order of expansion; context edges are never followed."""
    order = LATER if later else FIRST
    out = F.lit(None).cast("int")
    for k, t in enumerate(order):
        out = F.when(F.abs(atype) == t, k).otherwise(out)
    return out


def reached(edges: DataFrame, starts: DataFrame, depth: int, atype: int | None = None, save=None) -> DataFrame:
    """``name, level, parent`` of every vertex by its shortest way from ``starts.name``, along one type (either way) or any but contexts.

    Breadth first: each level is a join of the last one's vertices and an anti-join with
    those seen before; among several parents the least name is kept. ``save`` writes a level
    (and gives it back), so that a deep search does not plan all levels again.
    """
    usable = edges.where((F.abs("atype") <= EXPRESSES) if atype is None else (F.abs("atype") == abs(atype))).select("src", "dst")
    save = save or (lambda x: x)
    level = save(starts.select(F.col("name"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent")).distinct())
    seen = level
    for k in range(1, depth + 1):
        step = level.select(F.col("name").alias("src")).join(usable, "src").groupBy(F.col("dst").alias("name")).agg(F.min("src").alias("parent"))
        level = save(step.join(seen.select("name"), "name", "left_anti").select("name", F.lit(k).alias("level"), "parent"))
        seen = seen.unionByName(level)
    return seen


def grown_context(path: Column, context: Column, most: int = 16) -> Column:
    """The state of mind after a path: the context's words and those of the concepts on the way, each once, in order, the last ``most``."""
    words = F.array_distinct(F.flatten(F.transform(F.concat(F.array(context), path), lambda x: F.split(x, "[ ,]+"))))
    return F.slice(words, F.greatest(F.size(words) - most, F.lit(0)) + 1, F.lit(most))
