"""Association graph: tuples, vertices, weighted edges and path search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The types of associations in tuple files; a negative type is the inverse. The phrases
# of the tuples made below are fixed as well.
NEAR, FOLLOWS, CONTAINS, EXPRESSES, CONTEXT = 1, 2, 3, 4, 5
TUPLE = ["src", "atype", "fwd", "dst", "bwd", "context"]


def sanitised(tuples: DataFrame) -> DataFrame:
    """Commas become spaces, edges to self go, and a context of one letter or none is ``any``."""
    clean = lambda c: F.regexp_replace(F.col(c), ",", " ").alias(c)
    out = tuples.select(clean("src"), "atype", clean("fwd"), clean("dst"), clean("bwd"), F.when(F.char_length("context") > 1, F.regexp_replace("context", ",", " ")).otherwise("any").alias("context"))
    return out.where("src <> dst")


def inverse(tuples: DataFrame) -> DataFrame:
    return tuples.select(F.col("dst").alias("src"), (-F.col("atype")).alias("atype"), F.col("bwd").alias("fwd"), F.col("src").alias("dst"), F.col("fwd").alias("bwd"), "context")


def vertices(tuples: DataFrame) -> DataFrame:
    """``id, name``; the id is the MD5 of the name."""
    names = tuples.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    return names.select(F.md5("name").alias("id"), "name")


def context_tuples(tuples: DataFrame) -> DataFrame:
    """Both ends of a tuple belong to its context, and ``any`` contains the context."""
    rows = F.array(
        *[F.struct(F.col(a).alias("src"), F.lit(CONTEXT).alias("atype"), F.lit("appears in the context of").alias("fwd"), F.col("context").alias("dst"), F.lit("mentions").alias("bwd"), F.lit("any").alias("context")) for a in ("src", "dst")],
        F.struct(F.lit("any").alias("src"), F.lit(CONTAINS).alias("atype"), F.lit("contains").alias("fwd"), F.col("context").alias("dst"), F.lit("is contained in").alias("bwd"), F.lit("any").alias("context")),
    )
    return tuples.select(F.inline(rows)).where("src <> dst").distinct()


def through_contexts(tuples: DataFrame) -> DataFrame:
    """``src, context, dst``: concepts that meet in a context other than ``any``, by two joins on the context."""
    hubs = context_tuples(tuples).where((F.col("atype") == CONTEXT) & (F.col("dst") != "any")).select(F.col("src").alias("name"), F.col("dst").alias("context"))
    return hubs.select(F.col("name").alias("src"), "context").join(hubs.select(F.col("name").alias("dst"), "context"), "context").where("src <> dst")


def edges(tuples: DataFrame, order: str | None = None) -> DataFrame:
    """Edges in both directions with a weight that grows with sightings: ``1 - 0.3 * 0.4 ** (n - 1)``, after the first ``0.7``.

    Sightings are summed before the shuffle; the context is the first seen (by ``order``, else the least).
    """
    seq = F.col(order) if order else F.lit(0)
    own = tuples.withColumn("_seq", seq)
    both = own.select(*TUPLE, "_seq").unionByName(_reversed(own))
    return both.groupBy("src", "atype", "dst", "fwd").agg(F.count("*").alias("n"), F.min(F.struct("_seq", "context"))["context"].alias("icontext")).withColumn("weight", F.round(1 - 0.3 * F.pow(F.lit(0.4), F.col("n") - 1), 6))


def _reversed(own: DataFrame) -> DataFrame:
    return own.select(F.col("dst").alias("src"), (-F.col("atype")).alias("atype"), F.col("bwd").alias("fwd"), F.col("src").alias("dst"), F.col("fwd").alias("bwd"), "context", "_seq")


def role_tuples(compound: Column, role: Column, attributes: Column) -> Column:
    """A hub's role and one attribute edge for each comma item, as an array of tuples."""
    one = lambda dst, fwd, bwd: F.struct(compound.alias("src"), F.lit(EXPRESSES).alias("atype"), F.lit(fwd).alias("fwd"), dst.alias("dst"), F.lit(bwd).alias("bwd"), F.lit("any").alias("context"))
    return F.concat(F.array(one(role, "has the role of", "is a role fulfilled by")), F.transform(F.split(attributes, ","), lambda a: one(a, "has attribute", "is an attribute of")))


def context_words(compound: Column) -> Column:
    return F.transform(F.filter(F.split(compound, " +"), lambda w: w != ""), lambda w: F.struct(compound.alias("src"), F.lit(CONTAINS).alias("atype"), w.alias("dst")))


def best_children(edges_: DataFrame, most: int) -> DataFrame:
    """At most ``most`` edges of a vertex and type, by weight, ties by name."""
    w = W.partitionBy("src", "atype").orderBy(F.desc("weight"), "dst", "fwd")
    return edges_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def stories(edges_: DataFrame, starts: DataFrame, depth: int, types: tuple[int, ...] | None = None, most: int | None = 12, save=None) -> DataFrame:
    """``path, types, hops`` of all walks from ``starts.name`` that visit no vertex twice and never turn straight back.

    One join per level on the last vertex. Context edges are not followed. ``most``
    keeps that many children of each vertex and type (none: all, exponential in depth).
    ``save`` writes a level and gives it back, so that deep levels are not planned anew.
    """
    usable = edges_.where(F.abs("atype") <= EXPRESSES)
    if types:
        usable = usable.where(F.abs("atype").isin(*[abs(t) for t in types]))
    if most:
        usable = best_children(usable, most)
    step = usable.select(F.col("src").alias("_src"), F.col("atype").alias("_type"), F.col("dst").alias("_dst")).distinct()
    save = save or (lambda x: x)
    level = save(starts.select(F.array("name").alias("path"), F.array().cast("array<int>").alias("types")))
    found = level.limit(0)
    for _ in range(depth):
        last, before = F.element_at("path", -1), F.try_element_at("types", F.lit(-1))
        level = level.join(step, last == F.col("_src")).where(~F.array_contains("path", F.col("_dst")) & (before.isNull() | (F.col("_type") != -before)))
        level = save(level.select(F.concat("path", F.array("_dst")).alias("path"), F.concat("types", F.array(F.col("_type").cast("int"))).alias("types")))
        found = found.unionByName(level)
    return found.withColumn("hops", F.size("types").cast("long"))


def _tuple(src, atype: int, fwd: str, dst, bwd: str, context=None) -> Column:
    return F.struct(src.alias("src"), F.lit(atype).alias("atype"), F.lit(fwd).alias("fwd"), dst.alias("dst"), F.lit(bwd).alias("bwd"), (context if context is not None else F.lit("any")).alias("context"))


def event_clue(who: Column, what: Column, when: Column, where: Column, how: Column, why: Column) -> Column:
    """An event as a hub of its six aspects: the hub expresses each aspect, and contains their values."""
    parts = {"who": who, "what": what, "when": when, "where": where, "how": how, "why": why}
    hub = F.concat_ws(" ", *parts.values())
    roles = [_tuple(value, EXPRESSES, "has the role of", F.lit(name), "is a role fulfilled by", why) for name, value in parts.items()]
    held = [_tuple(hub, EXPRESSES, "has attribute", value, "is an attribute of", why) for value in parts.values()]
    return F.array(*held, *roles)


def whereabouts(address: Column, host: Column, domain: Column, ip: Column) -> Column:
    """Where something is: the host is in its domain, and host, address and IP name one another."""
    return F.array(
        _tuple(domain, CONTAINS, "contains", host, "is in"),
        _tuple(address, CONTAINS, "contains", host, "is in"),
        _tuple(host, NEAR, "also known as", ip, "also known as"),
        _tuple(host, EXPRESSES, "has the role of", F.lit("host"), "is a role fulfilled by"),
    )


def service(name: Column, port: Column, client: Column, server: Column) -> Column:
    """A service is a name on a port, with a server that gives and a client that uses it."""
    hub = F.concat(name, F.lit(" on port "), port.cast("string"))
    return F.array(
        _tuple(hub, EXPRESSES, "has attribute", name, "is an attribute of"),
        _tuple(server, EXPRESSES, "gives", hub, "is given by"),
        _tuple(client, FOLLOWS, "depends on", hub, "is used by"),
    )
