"""Keyed streams against their batch twins."""

import pytest
from pyspark.sql import functions as F
from weftline.operators import anomaly, statistics
from weftline.streaming import model, state

ROWS = [("in", "a", 0), ("in", "a", 60), ("in", "b", 30), ("out", "a", 5), ("in", "a", 300), ("in", "a", 4000), ("in", "b", 90)]


@pytest.fixture(autouse=True)
def _ends(spark):
    """With timeouts pending, empty batches would go on for ever."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def run(spark, tmp_path, schema, rows, build, mode="update"):
    """Feeds rows, two at a time, and gives all that came out."""
    (tmp_path / "in").mkdir()
    for k in range(0, len(rows), 2):
        spark.createDataFrame(rows[k : k + 2], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(str(tmp_path / "in")))
    name = "out_" + "".join(x for x in tmp_path.name if x.isalnum())
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(60)
        return [tuple(r) for r in spark.table(name).collect()]
    finally:
        query.stop()


def test_last_seen(spark, tmp_path):
    schema = "direction string, host string, ts long"
    out = run(spark, tmp_path, schema, ROWS, state.last_seen)
    last = {(d, h): (t, n, round(a, 6)) for d, h, t, n, a in sorted(out, key=lambda x: x[3])}
    want = statistics.last_seen(spark.createDataFrame(ROWS, schema), "direction", "host", "ts").collect()
    assert last == {(r.direction, r.host): (r.last, r.n, round(r.average, 6)) for r in want}
    registry = spark.createDataFrame([(*k, *v) for k, v in last.items()], "direction string, host string, last long, n long, average double")
    assert {(r.direction, r.host) for r in state.seen_within(registry, 4000, 3950).collect()} == {("in", "a"), ("in", "b")}


def test_rates(spark, tmp_path):
    schema = "name string, ts long, value long"
    rows = [("a", 0, 10), ("a", 10, 110), ("a", 20, 5), ("b", 3, 1), ("b", 3, 1)]
    out = sorted(run(spark, tmp_path, schema, rows, state.rates))
    want = statistics.rates(spark.createDataFrame(rows, schema), "name", "ts", "value").select("name", "ts", "rate").collect()
    assert out == sorted(map(tuple, want))


def test_rate_limit(spark, tmp_path):
    schema = "item string, ts long"
    rows = [("x", t) for t in (0, 59, 61, 119, 120, 300)] + [("y", 10)]
    out = sorted(run(spark, tmp_path, schema, rows, lambda s: state.admitted(s, 1)))
    assert out == sorted(map(tuple, statistics.admitted(spark.createDataFrame(rows, schema), ["item"], "ts", 1).collect()))
    assert ("x", 59) not in out and ("x", 61) in out


@pytest.mark.parametrize("policy", ["reset", "preserve"])
def test_persistent_classes(spark, tmp_path, policy):
    schema = "name string, ts long"
    rows = [("a", t) for t in (0, 5, 9, 12)]
    out = run(spark, tmp_path, schema, rows, lambda s: state.persistent(s, 10, policy))
    spans = statistics.persistent(spark.createDataFrame(rows, schema), ["name"], "ts", 10, policy)
    assert max(out) == ("a", spans.agg(F.max("until")).first()[0])


def test_changes_of_state_lists(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    found = []
    stream = spark.readStream.schema("name string").json(str(source))
    writer = state.on_change(stream, anomaly.state_changes, str(tmp_path / "states"), lambda df, n: found.append({(r.name, r.change) for r in df.collect()}), checkpointLocation=str(tmp_path / "c"))
    query = writer.start()
    try:
        for names in ("ab", "bc"):
            spark.createDataFrame([(x,) for x in names], "name string").coalesce(1).write.mode("append").json(str(source))
            query.processAllAvailable()
    finally:
        query.stop()
    assert found == [{("a", "+"), ("b", "+")}, {("a", "-"), ("b", "="), ("c", "+")}]


def test_bucket_counts_and_tail(spark, tmp_path):
    schema = "ts timestamp, name string"
    rows = [("2024-01-01 00:00:10", "a"), ("2024-01-01 00:01:00", "a"), ("2024-01-01 00:07:00", "b")]
    later = [("2024-01-01 01:00:00", "z")]
    out = run(spark, tmp_path, schema, [(F_time(t), n) for t, n in rows + later + later], lambda s: model.bucket_counts(s, "1 minute").select(F.date_format("window.start", "HH:mm").alias("at"), "name", "n"), "append")
    assert sorted(out) == [("00:00", "a", 2), ("00:05", "b", 1)]
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "one").write_text("x\ny\n")
    got = []
    query = model.tail_lines(spark, str(folder)).writeStream.option("checkpointLocation", str(tmp_path / "t")).foreachBatch(lambda df, n: got.extend(r.value for r in df.collect())).start()
    try:
        query.processAllAvailable()
        (folder / "two").write_text("z\n")
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(got) == ["x", "y", "z"]


def F_time(text):
    import datetime

    return datetime.datetime.fromisoformat(text)


def test_watched_tuples(spark, tmp_path):
    folder = tmp_path / "tuples"
    folder.mkdir()
    (folder / "a").write_text("(x,3,contains,y,is in,any)\nnoise\n")
    got = []
    query = state.watched_tuples(spark, str(folder), clean=False).writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, n: got.extend(tuple(r) for r in df.collect())).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert got == [("x", 3, "contains", "y", "is in", "any")]
