"""XML edits, captured listings and report addresses."""

import json

import pytest
from weftline.plans import reports
from weftline.sources import captures, xml

DOC = '<a><b k="1">x</b><b>y</b></a>'


def test_xml_edits():
    assert xml.apply_edit(DOC, "set_text", "b", value="z") == '<a><b k="1">z</b><b>z</b></a>'
    assert xml.apply_edit(DOC, "set_attribute", "b", "k", "2") == '<a><b k="2">x</b><b k="2">y</b></a>'
    assert xml.apply_edit(DOC, "delete_attribute", "b", "k") == "<a><b>x</b><b>y</b></a>"
    assert xml.apply_edit(DOC, "delete", "b") == "<a />"
    once = xml.apply_edit("<a />", "insert", ".", value="<c>1</c>")
    assert once == "<a><c>1</c></a>" and xml.apply_edit(once, "insert", ".", value="<c>1</c>") == once
    assert xml.apply_edit("<a", "delete", "b") is None and xml.apply_edit(None, "delete", "b") is None


def test_xml_columns(spark):
    df = spark.createDataFrame([(DOC,), (None,)], "d string")
    got = df.select(xml.texts(df.d, "a/b").alias("t"), xml.edited(df.d, "set_text", "b", value="q").alias("e")).collect()
    assert got[0].t == ["x", "y"] and got[0].e == '<a><b k="1">q</b><b>q</b></a>' and got[1].e is None


def test_process_table(spark):
    header = "USER       PID %CPU COMMAND"
    lines = [header, "root         1  0.0 /sbin/init splash", "me       12345 99.1 python x.py"]
    rows = captures.process_table(spark.createDataFrame([(x,) for x in lines], "value string"), header)
    assert [tuple(r) for r in rows.collect()] == [("root", "1", "0.0", "/sbin/init splash"), ("me", "12345", "99.1", "python x.py")]
    assert captures.selected(rows, "python.*", {"pid": (2, 99999)}).count() == 1


def test_sockets(spark):
    lines = ["tcp 0 0 10.0.0.1:80 10.0.0.9:5555 ESTABLISHED", "tcp 0 0 10.0.0.1:4444 10.0.0.9:22 ESTABLISHED", "tcp 0 0 0.0.0.0:22 0.0.0.0:* LISTEN"]
    got = captures.socket_counts(spark.createDataFrame([(x,) for x in lines], "value string"), {80: "www", 22: "ssh"})
    assert sorted(map(tuple, got.collect())) == [("ssh", "out", 1), ("www", "in", 1)]


def test_dispatch(spark):
    obs = spark.createDataFrame([("load", 3, "k3", 1.0, 2.0, 0.5), ("load", 1, "k1", 1.0, 2.0, 0.5), ("idle", 1, "k1", 0.0, 0.0, 0.0)], "observable string, timeslot int, timekey string, q double, expect double, var double")
    compliance = spark.createDataFrame([("default:main:copy", 1.0, 1.0, 0.0)], "handle string, q double, expect double, var double")
    tables = {"observations": obs, "compliance": compliance}
    assert [r.observable for r in reports.dispatch("/report/monitor", tables).collect()] == ["load"]
    assert [x["timeslot"] for x in json.loads(reports.dispatch("/report/monitor/load", tables).first().timeseries)] == [1, 3]
    r = reports.dispatch("/report/agent/copy", tables).first()
    assert (r.namespacepath, r.handle) == ("default:main", "copy")
    with pytest.raises(ValueError):
        reports.dispatch("/nothing", tables)
