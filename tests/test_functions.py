"""Values that are known from the outside: folds, arithmetic, time slots, weights."""

import pytest
from pyspark.sql import functions as F
from weftline.functions import arithmetic, lists, text, times
from weftline.operators import graph, guards, lines, statistics
from weftline.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def strings(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


@pytest.mark.parametrize(
    ("xs", "mean", "variance", "lex", "real"),
    [
        (["b", "c", "a"], 0.00, 0.00, ("a", "c"), ("a", "c")),
        (["100", "9", "10"], 39.67, 2730.33, ("10", "9"), ("9", "100")),
        (["a", "1", "b"], 0.33, 0.33, ("1", "b"), ("a", "1")),
        (["1.11", "-2.22", "-3.33"], -1.48, 5.34, ("-2.22", "1.11"), ("-3.33", "1.11")),
        (["-10", "0", "200"], 63.33, 14033.33, ("-10", "200"), ("-10", "200")),
    ],
)
def test_folds(spark, xs, mean, variance, lex, real):
    a = strings(*xs)
    assert round(value(spark, lists.mean(a)), 2) == mean
    assert round(value(spark, lists.variance(a)), 2) == variance
    assert (value(spark, lists.least(a)), value(spark, lists.greatest(a))) == lex
    assert (value(spark, lists.least(a, "real")), value(spark, lists.greatest(a, "real"))) == real


def test_empty_lists(spark):
    e = strings()
    assert value(spark, F.size(e)) == 0
    assert value(spark, lists.mean(e)) is None
    assert value(spark, lists.total(e)) == 0.0 and value(spark, lists.product(e)) == 1.0
    assert value(spark, lists.every(e, ".*")) is False and value(spark, lists.none(e, ".*")) is True
    assert value(spark, lists.total(strings("1", "x"))) is None


@pytest.mark.parametrize(
    ("expr", "want"),
    [("200 + 100", "300.000000"), ("2 - (3 - 1)", "0.000000"), ("", "0.000000"), ("3 / 0", "inf"), ("3^3", "27.000000"), ("(-1)^2", "1.000000"), ("20 % 3", "2.000000"), ("sqrt(0.2)", "0.447214"), ("step(-10)", "0.000000"), ("-3.4 -3.4", "-6.800000"), ("10 == 11", "0.000000"), ("100k", "100000.000000"), ("(200m - 100k) / (2t + 2t)", "0.000050"), ("+ 200", ""), ("- - -", "")],
)
def test_arithmetic(spark, expr, want):
    assert value(spark, arithmetic.evaluated_text(expr)) == want


@pytest.mark.parametrize(("epoch", "slot", "key"), [(1325462400, 0, "Mon:Hr00:Min00_05"), (1325462640, 0, "Mon:Hr00:Min00_05"), (1325462700, 1, "Mon:Hr00:Min05_10"), (1325808000, 1152, None), (1326067020, 2015, None)])
def test_slots(spark, epoch, slot, key):
    ts = F.timestamp_seconds(F.lit(epoch))
    assert value(spark, times.slot(ts)) == slot
    if key:
        assert value(spark, times.time_key(ts)) == key
    if epoch == 1326067020:
        assert value(spark, times.slot_start(ts)) == 1326066900


def test_edge_weights(spark):
    rows = [("a", 3, "f", f"b{n}", "g", "any") for n in (1, 2, 3, 4) for _ in range(n)]
    e = graph.edges(spark.createDataFrame(rows, "src string, atype int, fwd string, dst string, bwd string, context string"))
    got = {r.dst: r.weight for r in e.where("atype = 3").collect()}
    assert got == {"b1": 0.7, "b2": 0.88, "b3": 0.952, "b4": 0.9808}


def test_sort_modes(spark):
    assert value(spark, lists.sort(strings("10", "x", "9"), "int")) == ["x", "9", "10"]
    assert value(spark, lists.sort(strings("10.0.0.2", "9.1.1.1"), "IP")) == ["9.1.1.1", "10.0.0.2"]
    assert value(spark, lists.sort(strings("ff:00", "0a:01"), "MAC")) == ["0a:01", "ff:00"]


def test_guards_bind_and_first(spark):
    names = {"a": F.lit(True), "b": F.lit(False), "c": F.lit(False)}
    assert value(spark, guards.compile_guard("a|b.c", names.__getitem__)) is True
    assert value(spark, guards.compile_guard("(a|b).c", names.__getitem__)) is False
    with pytest.raises(ValueError):
        guards.compile_guard("a.(b", names.__getitem__)


def test_malformed_tuples_do_not_stop_a_file(spark):
    df = spark.createDataFrame([("(a,3,contains,b,is in,any)",), ("(broken",), ("# note",), ("(c,-2,x,d,y,k)",)], "value string")
    assert [r.src for r in files.parse_tuples(df).collect()] == ["a", "c"]
    assert files.malformed_tuples(df).count() == 1


def test_csv_round_trip(spark, tmp_path):
    rows = [('a "q"', "x,y"), ("line\nbreak", "z")]
    files.write_csv(spark.createDataFrame(rows, "a string, b string"), str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c")).collect())) == sorted(rows)


def test_region_and_insert(spark):
    a = strings("x", "start", "1", "end", "y")
    assert value(spark, lines.region(a, "start", "end")) == ["1"]
    assert value(spark, lines.region(a, "none", "end")) == []
    assert value(spark, lines.region(a, "start", "never")) == ["1", "end", "y"]
    assert value(spark, lines.insert_line(a, "1", "start")) == ["x", "start", "1", "end", "y"]


def test_full_match(spark):
    assert value(spark, text.full_match(F.lit("ab"), "a|ab")) is True
    assert value(spark, text.full_match(F.lit("ab"), "a")) is False


def test_first_value_of_a_fold(spark):
    s = value(spark, statistics.ewma(F.array(F.lit(5.0)), 0.3))
    assert (s.expect, s.var) == (5.0, 0.0)


def test_nested_text():
    from weftline.operators.nesting import leaves

    found, closed = leaves('<a>x y<b>"p q", r</b></a> (1 [2] 3)')
    assert closed and [v for _, _, v in found] == [["x", "y"], ['"p q"', "r"], ["1"], ["2"], ["3"]]
    assert [d for _, d, _ in found] == [["a"], ["a", "b"], ["("], ["(", "["], ["("]]
    assert leaves("a } b")[0] == [([1], [], ["a", "}", "b"])] and not leaves("{ a")[1]


def test_templates():
    from weftline.functions.templates import render

    data = {"x": "<&>", "l": [1, 2], "o": {"k": "v"}, "f": False, "e": []}
    assert render("{{x}} {{{x}}} {{&x}}", data) == "&lt;&amp;&gt; <&> <&>"
    assert render("{{#l}}[{{.}}]{{/l}}{{^e}}none{{/e}}{{#f}}no{{/f}}{{! note }}", data) == "[1][2]none"
    assert render("{{$o}}|{{#o}}{{k}}{{/o}}|{{o.k}}", data) == '{"k":"v"}|v|v'
    assert render("{{=<% %>=}}<% x %>{{x}}", {"x": 1}) == "1{{x}}"
    with pytest.raises(ValueError):
        render("{{#a}}", {})
