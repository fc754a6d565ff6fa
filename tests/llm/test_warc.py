import base64
import hashlib

from weftline.llm import warc

SCHEMA = "page_id long, url string, html string, record_id string"
ROWS = [
    (1, "u1", "a" * 50, "x"),
    (2, "u2", "a" * 50, "x"),
    (2, "u2", "a" * 50, "x"),
    (3, None, None, "x"),
    (4, "u\r\nWARC/1.1", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n", "x"),
    (5, "u5", "", None),
    (None, "u6", "\r\n\r\n" * 9, "x"),
    (7, "é", "é" * 40_000, "x"),
    (8, "u", "WARC/1.1\r\nWARC/1.1\r\n", "x"),
    (9, "u", "a\r\n\r\nWARC/1.1", "x"),
]


def sha(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for size in (7, 1 << 20):
        out = warc.archive_round_trip(df, chunk_bytes=size).collect()
        assert len(out) == len(ROWS) and all(r.intact for r in out)
        want = sorted((str(p), len((h or "").encode()), sha((h or "").encode())) for p, _, h, _ in ROWS)
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in out) == want
        kinds = {r.page_id: (r.record_type, r.refers_to) for r in out}
        assert kinds[1] == ("revisit", 2) and kinds[2] == ("response", None)
        assert kinds[3] == ("revisit", 5) and kinds[5] == ("response", None)


def test_long_records_are_cut(spark):
    df = spark.createDataFrame(ROWS[7:8], SCHEMA)
    assert warc.archive_round_trip(df, chunk_bytes=1000).first().n_chunks == 80


def test_chunk_table_carries_running_digests(spark):
    payload = bytes(range(256)) * 40
    rows = warc.chunk_table(spark.createDataFrame([("r", payload), ("n", None)], "record_id string, payload binary"), 1000).collect()
    own = sorted((r for r in rows if r.record_id == "r"), key=lambda r: r.chunk_no)
    assert b"".join(bytes(r.chunk) for r in own) == payload
    at = 0
    for r in own:
        at += len(r.chunk)
        assert r.running_digest == sha(payload[:at])
    assert [len(r.chunk) for r in rows if r.record_id == "n"] == [0]


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_damage_is_seen(spark):
    path = warc.fresh_path(spark, "damaged")
    block = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:" + sha(b"abc").encode() + b"\r\nContent-Length: 3\r\n\r\nabX"
    spark.createDataFrame([(block.decode(),)], "value string").write.text(path, lineSep="\r\n\r\n")
    assert [r.intact for r in warc.read_archives(spark, path).collect()] == [False]


def test_archives_are_made_of_the_chunk_table(spark, monkeypatch):
    """Without chunk rows nothing is written."""
    seen = []
    real = warc.chunk_table
    monkeypatch.setattr(warc, "chunk_table", lambda records, size=warc.CHUNK_BYTES: seen.append(size) or real(records, size))
    out = warc.archive_round_trip(spark.createDataFrame(ROWS, SCHEMA), chunk_bytes=100)
    assert seen == [100] and out.count() == len(ROWS)
