"""Files, catalogues, YAML and choice: what no query on the standard tables shows."""

import json

import pytest
from pyspark.sql import functions as F
from weftline.functions import chance, classes, tables, times
from weftline.operators import logs, statistics
from weftline.sources import catalogue, listings, yaml

c = F.col


def test_yaml():
    text = """# a comment
name: web   # trailing
ports:
- 80
- {host: 1.5, kind: 'a, b'}
nested:
  - - x
    - "y: z"
  - key: true
    other: ~
note: |
  one
    two
folded: >-
  a
  b
empty: {}
list: [1, [2, "three"]]
"""
    assert yaml.load(text) == {
        "name": "web", "ports": [80, {"host": 1.5, "kind": "a, b"}], "nested": [["x", "y: z"], {"key": True, "other": None}],
        "note": "one\n  two\n", "folded": "a b", "empty": {}, "list": [1, [2, "three"]],
    }
    assert yaml.load("") is None and yaml.load("- a\n- b: c") == ["a", {"b": "c"}] and yaml.load("word") == "word"
    for bad in ("a: [1, 2", "a: 1\n   b: 2", "{a 1}"):
        with pytest.raises(ValueError):
            yaml.load(bad)


def test_yaml_column(spark):
    df = spark.createDataFrame([("a: 1",), (None,), ("a: [",)], "x string")
    assert [r[0] for r in df.select(yaml.parsed(c("x"))).collect()] == ['{"a":1}', None, None]


def test_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("first é line\nsecond")
    (tmp_path / "two.log").write_text("x")
    facts = tables.file_facts(spark, str(tmp_path))
    assert {(r.name, r.size) for r in facts.collect()} == {("one.txt", 20), ("two.log", 1)}
    assert [r.name for r in tables.file_facts(spark, str(tmp_path), "*.txt").collect()] == ["one.txt"]
    assert [r.name for r in tables.list_files(spark, str(tmp_path), r"t.*\.log").collect()] == ["two.log"]
    assert tables.read_file(spark, str(tmp_path / "one.txt"), 7).first().text == "first "  # the character is not cut in two
    assert tables.file_digest(spark, str(tmp_path / "two.log"), "md5").first().digest == "9dd4e461268c8034f5c8564e155c67a6"
    small = tables.file_select(facts, "text.!large", {"text": c("name").endswith(".txt"), "large": c("size") > 100})
    assert [r.name for r in small.collect()] == ["one.txt"]


def test_history_and_graph_files(spark, tmp_path):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05' AS ts, 1.5D AS value")
    for _ in range(2):
        listings.append_history(df, str(tmp_path / "h"))
    assert [r.value for r in spark.read.text(str(tmp_path / "h")).collect()] == ["Tue Jan 2 03:04:05 2024,1704164645,1.5000"] * 2
    series = spark.createDataFrame([(3, "cpu", 1.0, 2.0, 4.0)], "slot int, observable string, q double, expect double, var double")
    listings.write_graphs(series, str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g/E-sigma")).first().value == "3 2.0000 2.0000"


def test_tables_converge(spark):
    catalogue.drop(spark, "weft_notes")
    try:
        catalogue.create(spark, "weft_notes", ["id,int", "note,text"])
        catalogue.create(spark, "weft_notes", ["id,int", "note,text", "size,real"])
        assert spark.table("weft_notes").dtypes == [("id", "int"), ("note", "string"), ("size", "double")]
        assert "weft_notes" in {r.name for r in catalogue.tables(spark).collect()}
    finally:
        catalogue.drop(spark, "weft_notes")
    states = {r.name: r.state for r in catalogue.compared(spark.createDataFrame([(1, "x", 2)], "a int, b string, c int"), ["a,int", "b,real", "d,text,9"]).collect()}
    assert states == {"a": "same", "b": "differs", "c": "extra", "d": "missing"}
    assert catalogue.empty(spark, ["a,int", "b,text"]).columns == ["a", "b"]


def test_choice(spark):
    rows = spark.range(4000).select(chance.weighted({"a": 1, "b": 3}, chance.draw(c("id"))).alias("w"), chance.random_int(9, 3).alias("n"), chance.splay_class(c("id"), "daily").alias("s"))
    share = rows.where("w = 'a'").count() / 4000
    assert 0.2 < share < 0.3
    assert {r.n for r in rows.select("n").distinct().collect()} == set(range(3, 9))
    assert rows.where(~c("s").rlike(r"^Min\d\d_\d\d\.Hr\d\d$")).count() == 0
    for bad in ({}, {"a": 0}, {"a": -1, "b": 3}):
        with pytest.raises(ValueError):
            chance.weighted(bad, F.lit(0.5))
    arrived = spark.sql("SELECT explode(sequence(timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:55:00', interval 5 minutes)) AS ts")
    assert arrived.where(chance.splay_arrived(F.lit("host"), c("ts"))).count() == 1


def test_now(spark):
    import time

    assert abs(spark.range(1).select(times.now()).first()[0] - time.time()) < 60


def test_class_state_and_tags(spark):
    df = spark.createDataFrame([("s", "b", "1"), ("s", "a", "2")], "scope string, name string, value string")
    assert json.loads(classes.state(df, "scope", "name", "value").first().state) == {"a": "2", "b": "1"}


def test_changed_objects(spark):
    df = spark.createDataFrame([("k", 1, "x"), ("k", 2, "x"), ("k", 3, "y")], "key string, at int, text string")
    assert [r.changed for r in logs.changed(df, ["key"], "at", "text").orderBy("at").collect()] == [True, False, True]


def test_preserved_classes(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 5, 9, 12, 30)], "name string, ts long")
    assert sorted(map(tuple, statistics.persistent(df, ["name"], "ts", 10, "preserve").collect())) == [("a", 0, 10), ("a", 12, 22), ("a", 30, 40)]
    assert sorted(map(tuple, statistics.persistent(df, ["name"], "ts", 10).collect())) == [("a", 0, 22), ("a", 30, 40)]
