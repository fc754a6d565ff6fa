"""What several operators share: words, fingerprints, shared folders, components."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at the same bytes.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only where that is unset (local runs, tests) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not base:
        known = jsc.getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send the library to the executors once per application, so that they need not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_weftline_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="weftline-"), "weftline_package.zip")  # code only; Spark hands it out
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"{root.name}/{path.relative_to(root)}")
    sc.addPyFile(target)
    sc._weftline_shipped = True


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_let_go(spark: SparkSession):
    """Within, Spark removes the shuffle files of an action as soon as it has ended."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_let_go(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what :func:`written` has written, once nothing reads it any more."""
    for t in tables:
        if path := getattr(t, "_written_at", None):
            place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def doc_number(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string"))


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Values of a string column as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def own_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it (Spark's names ignore case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def released(run):
    """``run`` for ``mapInArrow``; at its end memory that Python has freed goes back to the system, as workers are used again."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has its own way
        pass


def collected(spark: SparkSession) -> None:
    """The driver, its Python and its JVM, gives back what nothing refers to any more; else heaps grow to their limits, whatever is alive.

    The JVM's own C heap keeps what compiled plans and buffers have freed, unless it is told to trim it (from Java 17 on).
    """
    give_back()
    spark._jvm.System.gc()
    management = spark._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    with contextlib.suppress(Py4JError):  # a JVM of another kind has no such command
        management.invoke(spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None)


def in_slices(batches, rows: int = 256):
    """Arrow batches cut small, so that Python holds few whole texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class _Seen(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class WordHasher:
    """64-bit fingerprints of words; remembers up to ``limit`` words and then starts anew."""

    def __init__(self, limit: int = 300_000):
        self.seen, self.limit = _Seen(), limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.seen) > self.limit:
            self.seen.clear()
        return np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct fingerprints of ``size``-word shingles; a shorter text is one shingle, an empty one has none."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    acc = np.full(n - size + 1, (0x9E3779B97F4A7C15 * size) & (2**64 - 1), np.uint64)
    for k in range(size):
        acc = mix(acc ^ hashes[k : n - size + 1 + k]) + np.uint64(k)
    return np.unique(acc)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of an undirected edge table.

    Alternating large-star and small-star steps; each round is written to the shared
    folder. A round only aggregates (with partial sums) and joins on the node; the minima
    are dealt anew before the join, as Spark splits a skewed key (a node with very many
    links) only between two plain exchanges. Self links and nulls are ignored.
    """
    e = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).repartition("m")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).repartition("m")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", F.col("m").alias("w")), F.struct(F.col("u").alias("v"), F.col("m").alias("w")))).alias("x"))
        last, e = e, written(small.select(F.col("x.v").alias("u"), F.col("x.w").alias("v")).where("u <> v").distinct(), "edges")
        dropped(last)
    else:
        raise RuntimeError("components: no fixed point")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
