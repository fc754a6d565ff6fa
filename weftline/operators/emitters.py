"""Tuples that describe times, axioms, policies, programs and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import CONTAINS, EXPRESSES, FOLLOWS, NEAR, _tuple

# The first concepts about causes.
AXIOM_CONTEXTS = ["service relationship", "system diagnostics", "lifecycle state change", "software exception", "promise keeping", "host location identification"]
CAUSES = [
    ("client measurement anomaly", "client software exception"),
    ("client measurement anomaly", "server software exception"),
    ("server measurement anomaly", "server software exception"),
    ("measurement anomaly", "software exception"),
    ("resource contention", "resource limit"),
    ("increasing queue length", "resource contention"),
    ("system performance slow", "increasing queue length"),
    ("system performance latency", "resource contention"),
    ("system performance latency", "increasing queue length"),
    ("system performance latency", "server unavailability"),
    ("server unavailability", "software crash"),
    ("server unavailability", "system performance slow"),
]
RELATED = [("system performance slow", "system performance latency")]


def axioms(spark) -> DataFrame:
    rows = [(c, CONTAINS, "contains", w, "belongs to or is part of", "any") for c in AXIOM_CONTEXTS for w in c.split()]
    rows += [(a, FOLLOWS, "may be caused by", b, "can cause", "system diagnostics") for a, b in CAUSES]
    rows += [(a, NEAR, "may be related to", b, "may be related to", "system diagnostics") for a, b in RELATED]
    return spark.createDataFrame(rows, "src string, atype int, fwd string, dst string, bwd string, context string")


PARTS_OF_TIME = ("shift", "weekday", "day", "month", "year", "hour", "minutes", "quarter")


def time_parts(ts: Column, prefix: str = "") -> dict[str, Column]:
    """The eight attributes of a point of time by name."""
    low = (F.floor(F.minute(ts) / 5) * 5).cast("int")
    shift = F.element_at(F.array(*map(F.lit, ("Night", "Morning", "Afternoon", "Evening"))), (F.floor(F.hour(ts) / 6) + 1).cast("int"))
    parts = {
        "shift": shift,
        "weekday": F.date_format(ts, "EEEE"),
        "day": F.format_string("Day%d", F.dayofmonth(ts)),
        "month": F.date_format(ts, "MMMM"),
        "year": F.format_string("Yr%04d", F.year(ts)),
        "hour": F.format_string("Hr%02d", F.hour(ts)),
        "minutes": F.format_string("Min%02d_%02d", low, (low + 5) % 60),
        "quarter": F.format_string("Q%d", (F.floor(F.minute(ts) / 15) + 1).cast("int")),
    }
    return {k: F.concat(F.lit(prefix), v) for k, v in parts.items()}


def time_hub(ts: Column, prefix: str = "") -> Column:
    p = time_parts(ts, prefix)
    return F.concat(F.lit("on "), F.concat_ws(" ", *[p[k] for k in PARTS_OF_TIME[:5]]), F.lit(" at "), F.concat_ws(" ", *[p[k] for k in PARTS_OF_TIME[5:]]))


def time_tuples(ts: Column, prefix: str = "", role: str = "when") -> Column:
    """A point of time as a hub of its eight attributes, each with its own role."""
    parts, hub = time_parts(ts, prefix), time_hub(ts, prefix)
    context = F.lit("GMT clock time" if prefix else "local clock time")
    own = [_tuple(hub, EXPRESSES, "has the role of", F.lit(role), "is a role fulfilled by", context)]
    own += [_tuple(hub, EXPRESSES, "expresses an attribute", parts[k], "is an attribute of", context) for k in PARTS_OF_TIME]
    roles = {"shift": "time of day", "weekday": "weekday", "day": "day of month", "month": "month", "year": "year", "hour": "hour", "minutes": "minutes past the hour"}
    own += [_tuple(parts[k], EXPRESSES, "has the role of", F.lit(v), "is a role fulfilled by", F.lit("clock time")) for k, v in roles.items()]
    return F.array(*own)


def policy_tuples(namespace: Column, bundle: Column, kind: Column, promiser: Column, constraint: Column) -> Column:
    """A policy row: a namespace holds bundles, a bundle kinds of promises, a kind its promises, and those have constraints."""
    full = F.concat_ws(":", namespace, bundle)
    promise = F.concat(F.lit("promise "), promiser)
    ctx = F.lit("policy")
    return F.array(
        _tuple(F.concat(F.lit("namespace "), namespace), CONTAINS, "contains", F.concat(F.lit("bundle "), full), "belongs to or is part of", ctx),
        _tuple(F.concat(F.lit("bundle "), full), CONTAINS, "contains", promise, "belongs to or is part of", ctx),
        _tuple(promise, EXPRESSES, "has the role of", F.concat(kind, F.lit(" promise")), "is a role fulfilled by", ctx),
        _tuple(promise, EXPRESSES, "has constraint", constraint, "constrains", ctx),
    )


def dependency_tuples(program: Column, libraries: Column) -> Column:
    """A program depends on each of its libraries."""
    return F.transform(libraries, lambda x: _tuple(program, FOLLOWS, "depends on", x, "partly determines", F.lit("binary dependencies")))


def pod_parts(name: Column) -> Column:
    """``deployment, replica_set, pod`` of a pod's name: the last part is the pod, the one before the replica set if it has a digit."""
    parts = F.split(name, "-")
    last = F.element_at(parts, -1)
    before = F.try_element_at(parts, F.lit(-2))
    is_set = (F.size(parts) > 2) & F.coalesce(before.rlike("[0-9]"), F.lit(False)) & (last != "master")
    cut = F.when(is_set, 2).otherwise(1)
    return F.struct(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - cut, F.lit(0))), "-").alias("deployment"), F.when(is_set, before).alias("replica_set"), last.alias("pod"))


def pod_tuples(namespace: Column, name: Column, node: Column, image: Column) -> Column:
    """A pod's place: its namespace holds the deployment, which depends on its pod; the pod is on a node and runs an image."""
    p = pod_parts(name)
    ctx = F.lit("kubernetes cluster")
    deployment, pod = F.concat(F.lit("kubernetes deployment "), p["deployment"]), F.concat(F.lit("kubernetes pod "), p["pod"])
    return F.array(
        _tuple(F.concat(F.lit("kubernetes namespace "), namespace), CONTAINS, "contains", deployment, "belongs to or is part of", ctx),
        _tuple(deployment, FOLLOWS, "depends on", pod, "partly determines", ctx),
        _tuple(F.concat(F.lit("host "), node), CONTAINS, "contains", pod, "belongs to or is part of", ctx),
        _tuple(pod, FOLLOWS, "depends on", F.concat(F.lit("container image "), image), "partly determines", ctx),
    )


def service_tuples(name: Column, address: Column, ports: Column) -> Column:
    ctx = F.lit("kubernetes cluster")
    hub = F.concat(F.lit("kubernetes service "), name)
    return F.concat(F.array(_tuple(hub, EXPRESSES, "is called", name, "is a name for", ctx), _tuple(hub, EXPRESSES, "expresses an attribute", address, "is an attribute of", ctx)), F.transform(ports, lambda x: _tuple(hub, EXPRESSES, "expresses an attribute", F.concat(F.lit("ip port "), x), "is an attribute of", ctx)))
