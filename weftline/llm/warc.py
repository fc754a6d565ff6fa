"""WARC archives by way of a chunk table.

A payload is cut into chunks. Every chunk is one row ``(record, chunk number, bytes,
running digest)`` and one WARC record: the first is ``response``, later ones are
``continuation`` records (WARC segmentation). The rows stream from one step to the next, a
chunk at a time, so beside its input cell no step holds a whole oversized record. The
running SHA-1 of a chunk covers the payload up to its end; the reader continues the digest
chunk by chunk and compares at each one. What finds equal payloads are digests alone.

Archives are written and read by Spark's own text source, so they can lie in any store
that Spark reaches and a lost executor's task is simply run again. Records are parted
by ``CRLF CRLF WARC/1.1 CRLF``; a chunk ends early where a payload itself holds that
sequence or most of it, so a boundary never lies within a record. A gzip file is one task's, in
order, which is what lets the reader keep one digest state per open record.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, in_slices, released, written

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
BOUNDARY = END + VERSION
CHUNK_BYTES = 1 << 20
#: WARC-Date of records made here; the same input gives the same bytes.
DATE = "2024-01-01T00:00:00Z"

READ_SCHEMA = "record_id string, record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string, n_chunks int, intact boolean"
CHUNK_SCHEMA = "chunk_no int, chunk binary, running_digest string, last boolean"
#: Copied payloads up to which their digests are sent to all executors; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


def base32_sha1(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def cut(payload, size: int = CHUNK_BYTES):
    """Chunks of at most ``size`` bytes. An empty payload is one empty chunk.

    None begins with the version or holds it after an ``END``, even without its line
    end, as the bytes before and after a chunk could complete the boundary.
    """
    at, view, mark = 0, memoryview(payload), VERSION.rstrip()
    n = len(view)
    while True:
        end = min(n, at + size)
        begin = bytes(view[at : end + len(mark)])
        inside = -len(END) if begin.startswith(mark) else begin.find(END + mark, 0, end - at)
        if inside != -1:
            end = min(end, at + inside + len(END) + 4)
        yield view[at:end]
        at = end
        if at >= n:
            return


def chunk_table(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The columns of ``records`` but ``payload``, and ``chunk_no, chunk, running_digest, last``: a row for each chunk.

    One payload is read at a time and its chunks leave one by one. A null payload is one
    empty chunk; rows that repeat each have their own chunks; an empty table has none.
    """
    kept = [c for c in records.columns if c != "payload"]
    schema = T.StructType([*records.select(*kept).schema.fields, *T.StructType.fromDDL(CHUNK_SCHEMA).fields])

    def run(batches):
        for batch in batches:
            payloads = batch.column(len(kept))
            for i in range(batch.num_rows):
                payload = payloads[i].as_buffer() or b""
                digest, chunks, k = hashlib.sha1(), cut(payload, chunk_bytes), 0
                chunk, own = next(chunks), [batch.column(j).slice(i, 1) for j in range(len(kept))]
                while chunk is not None:
                    after = next(chunks, None)
                    digest.update(chunk)
                    cells = [pa.array([k], pa.int32()), pa.array([bytes(chunk)], pa.binary()), pa.array([base32_sha1(digest)]), pa.array([after is None])]
                    yield pa.RecordBatch.from_arrays([*own, *cells], schema.names)
                    chunk, k = after, k + 1

    return records.select(*kept, F.col("payload").cast("binary")).mapInArrow(released(in_larger(run)), schema)


def in_larger(run, rows: int = 256, size: int = 4 << 20):
    """``run`` with small batches put together: at most so many rows, or a few chunks."""

    def wrapped(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.nbytes
            if len(held) >= rows or n >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return wrapped


def deduplicated(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``digest, record_type, refers_to``: of equal payloads of ``min_bytes`` or more, the largest ``page_id`` is the response.

    The digest groups are summed before they are shuffled, and the join back is on the
    digest, where Spark splits a payload that very many records share. Rows that repeat
    the largest ``page_id`` are responses too; a null ``page_id`` is below all others.
    """
    own = records.withColumn("digest", F.sha1(F.coalesce(F.col("payload"), F.lit(b""))))
    size = F.coalesce(F.octet_length("payload"), F.lit(0))  # only digests are joined
    first = own.where(size >= min_bytes).groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("best"), F.count("*").alias("copies")).where("copies > 1")
    first = written(first, "warc-copied")  # a join of two plain exchanges can split a skewed key
    side = F.broadcast(first) if first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else first
    joined = own.join(side, (F.col("digest") == F.col("of")) & (size >= min_bytes), "left")
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return joined.select(*own.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("best")).alias("refers_to"))


def _record(rid, uri, kind, refers, full, size, k, chunk, running, last):
    """The bytes of one WARC record, without the version line and the closing CRLF CRLF."""
    head = f"WARC-Date: {DATE}\r\n" + (f"WARC-Target-URI: {uri}\r\n" if uri else "")
    if kind == "revisit":
        return f"WARC-Type: revisit\r\nWARC-Record-ID: <{rid}>\r\n{head}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <{refers}>\r\nWARC-Payload-Digest: sha1:{full}\r\nX-Payload-Length: {size}\r\nContent-Length: 0".encode() + END
    only = k == 0 and last
    seg = "" if only else f"WARC-Segment-Number: {k + 1}\r\n" + (f"WARC-Segment-Origin-ID: <{rid}>\r\n" if k else "") + (f"WARC-Segment-Total-Length: {size}\r\n" if last else "")
    own = f"{rid}" if not k else f"{rid}:segment:{k + 1}"
    return f"WARC-Type: {'continuation' if k else 'response'}\r\nWARC-Record-ID: <{own}>\r\n{head}{seg}WARC-Payload-Digest: sha1:{full}\r\nX-Running-Digest: sha1:{running}\r\nContent-Type: application/octet-stream\r\nContent-Length: {len(chunk)}".encode() + END + chunk


def write_archives(records: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write ``record_id, target_uri, record_type, refers_id, digest (hex SHA-1), payload_bytes, payload`` as ``*.txt.gz`` WARC files under ``path``.

    The rows go through :func:`chunk_table`, and each chunk becomes a record where it is.
    Line breaks in ids and addresses become spaces, so that a value never breaks a header.
    """

    def run(batches):
        # a file begins with the version line; each later record gets it after the separator
        for batch in batches:
            out = []
            for rid, uri, kind, refers, full, size, k, chunk, running, last in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                full = base64.b32encode(bytes.fromhex(full)).decode()
                out.append(VERSION + _record(rid, uri, kind, refers, full, size, k, chunk, running, last))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    clean = lambda c: F.regexp_replace(F.col(c).cast("string"), r"[\r\n]+", " ").alias(c)
    rows = records.select(clean("record_id"), clean("target_uri"), "record_type", clean("refers_id"), "digest", F.col("payload_bytes").cast("long"), F.when(F.col("record_type") == "response", F.col("payload")).cast("binary").alias("payload"))
    chunks = chunk_table(rows, chunk_bytes)
    chunks.mapInArrow(released(run), "value binary").select(F.col("value").cast("string")).write.text(path, compression="gzip", lineSep=END.decode())


def _header(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(END)
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        k, sep, v = line.partition(":")
        if sep:
            fields[k.strip().lower()] = v.strip()
    return fields, body


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each response or revisit record under ``path``, checked chunk by chunk.

    ``intact``: every segment followed its predecessor, every running digest and length
    agreed, and the digest of the whole equals the one in the header. A record whose
    last segments are missing comes out with ``intact`` false.
    """

    def run(batches):
        open_, out = None, []

        def close(r):
            found = base32_sha1(r["sha"]) if r["type"] != "revisit" else r["want"]
            ok = r["ok"] and found == r["want"] and (r["total"] is None or r["total"] == r["n"])
            return (r["id"], r["type"], r["refers"], r["uri"], r["n"], found, r["k"], ok)

        def batch_of(rows):
            kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int32(), pa.bool_()]
            names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in in_slices(batches, 64):
            for block in batch.column(0).to_pylist():
                if not block:
                    continue
                f, body = _header(block.removeprefix(VERSION))
                kind, size = f.get("warc-type"), int(f.get("content-length", "0"))
                body, short = body[:size], len(body) < size
                strip = lambda x: f.get(x, "").strip("<>") or None  # noqa: E731, B023
                if kind != "continuation" and open_:
                    out.append(close(open_))
                    open_ = None
                if kind == "revisit":
                    out.append(close({"id": strip("warc-record-id"), "type": kind, "refers": strip("warc-refers-to"), "uri": f.get("warc-target-uri"), "n": int(f.get("x-payload-length", "0")), "want": f.get("warc-payload-digest", "").removeprefix("sha1:"), "k": 0, "ok": True, "total": None}))
                elif kind in ("response", "continuation"):
                    if kind == "response":
                        open_ = {"id": strip("warc-record-id"), "type": kind, "refers": None, "uri": f.get("warc-target-uri"), "n": 0, "want": f.get("warc-payload-digest", "").removeprefix("sha1:"), "k": 0, "ok": True, "total": None, "sha": hashlib.sha1()}
                    elif not open_ or strip("warc-segment-origin-id") != open_["id"] or int(f.get("warc-segment-number", "0")) != open_["k"] + 1:
                        if open_:
                            open_["ok"] = False
                        continue
                    open_["sha"].update(body)
                    open_["n"] += len(body)
                    open_["k"] += 1
                    if "warc-segment-total-length" in f:
                        open_["total"] = int(f["warc-segment-total-length"])
                    elif "warc-segment-number" in f:
                        open_["total"] = -1
                    open_["ok"] &= not short and f.get("x-running-digest", "").removeprefix("sha1:") in ("", base32_sha1(open_["sha"]))
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        if open_:
            out.append(close(open_))
        if out:
            yield batch_of(out)

    text = spark.read.schema("value string").text(path, lineSep=BOUNDARY.decode())
    return text.select(F.col("value").cast("binary")).mapInArrow(released(run), READ_SCHEMA)


PAGE_URN = "urn:page:"


def archive_round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, min_bytes: int = 0) -> DataFrame:
    """Write a WARC record for each row of ``page_id, url, html``, read the archives back, one row per record.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, url, n_chunks, intact``.
    Null html is an empty payload, a null url leaves the address out, and a null
    ``page_id`` comes back as null; an empty table gives no rows; other columns are
    left out; repeated rows each keep their record. A revisit's payload facts are read from its header.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = deduplicated(own, min_bytes)
    urn = lambda c: F.concat(F.lit(PAGE_URN), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    write_archives(rows.select(urn("page_id").alias("record_id"), "target_uri", "record_type", urn("refers_to").alias("refers_id"), "digest", F.octet_length("payload").alias("payload_bytes"), "payload"), path, chunk_bytes)
    back = read_archives(spark, path)
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(PAGE_URN) + 1}) as long)")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), F.col("target_uri").alias("url"), "n_chunks", "intact")
