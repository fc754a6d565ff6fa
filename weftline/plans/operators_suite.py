"""Each operator over standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lists, templates, times
from ..operators import anomaly, graph, guards, lines, logs, nesting, relational, statistics
from ..sources import captures, files, xml
from . import reports
from .registry import query, text_of

c = F.col
SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"


def seconds():
    return times.epoch(c("ts"))


# --- filters and predicates ---


@query("P1_guard", "SELECT event_id FROM events WHERE (event_type = 'click' OR NOT (value > 20)) AND hour(ts) < 12")
def _(t):
    e = t("events")
    known = {"click": c("event_type") == "click", "big": c("value") > 20, "early": F.hour("ts") < 12}
    return e.where(guards.compile_guard("(click|!big).early", known.__getitem__)).select("event_id")


@query("P2_combine", "SELECT event_id, CAST((event_type = 'click') <> (value > 20) AS BIGINT) AS odd FROM events")
def _(t):
    return t("events").select("event_id", guards.exactly_odd(c("event_type") == "click", c("value") > 20).cast("long").alias("odd"))


@query("P3_bucket", "SELECT p_partkey, CAST(('0x' || substr(md5(p_name), 1, 8)) AS BIGINT) % 7 AS bucket FROM part")
def _(t):
    return t("part").select("p_partkey", guards.bucket_of(c("p_name"), 7).alias("bucket"))


@query("P7_select", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND regexp_matches(p_name, 'ring') AND p_retailprice BETWEEN 900 AND 1500")
def _(t):
    known = {"size": c("p_size").between(5, 20), "name": c("p_name").rlike("ring"), "price": c("p_retailprice").between(900, 1500)}
    return t("part").where(guards.compile_guard("size.name.price", known.__getitem__)).select("p_partkey")


@query("P8_range", "SELECT p_partkey FROM part WHERE p_size BETWEEN 3 AND 9")
def _(t):
    return t("part").where(c("p_size").between(3, 9)).select("p_partkey")


@query("P10_prune", "SELECT p_partkey FROM part WHERE NOT (contains(p_name, 'red') OR contains(p_name, 'ring'))")
def _(t):
    words = F.array(F.lit("red"), F.lit("ring"))
    return t("part").where(~F.exists(words, lambda k: F.contains(c("p_name"), k))).select("p_partkey")


@query("P11_junk", "SELECT p_partkey, CAST(regexp_full_match(p_name, '[0-9A-Fa-f_ ]*') OR length(p_name) <= 12 AS BIGINT) AS junk FROM part")
def _(t):
    return t("part").select("p_partkey", logs.junk(c("p_name")).cast("long").alias("junk"))


@query("P12_noise_gate", "SELECT event_type FROM events GROUP BY event_type HAVING avg(value) >= 4 * sqrt(var_pop(value) / 16)")
def _(t):
    g = t("events").groupBy("event_type").agg(F.avg("value").alias("e"), (F.var_pop("value") / 16).alias("v"))
    return g.where(anomaly.significant(c("e"), c("v"))).select("event_type")


# --- joins ---


@query("J1_lookup", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    return relational.lookup(t("customer"), t("nation"), "c_nationkey", "n_nationkey").select("c_custkey", "n_name")


@query("J5_cross_product", "SELECT r_name, w FROM region, (SELECT unnest(['a', 'b', 'c']) AS w)")
def _(t):
    return relational.crossed(t("region"), list("abc"), "w").select("r_name", "w")


@query("J6_membership", "SELECT DISTINCT user_id, 'gone' AS what FROM events a WHERE ts < TIMESTAMP '2024-01-10' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND b.ts >= TIMESTAMP '2024-01-25')")
def _(t):
    e = t("events")
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    late = e.where((c("event_type") == "error") & (c("ts") >= day("2024-01-25 00:00:00")))
    return relational.vanished(e.where(c("ts") < day("2024-01-10 00:00:00")), late, "user_id").withColumn("what", F.lit("gone"))


@query("J7_zero_fill", "SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-28' GROUP BY 1) b ON a.user_id = b.user_id")
def _(t):
    e = t("events")
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    return relational.zero_filled(e.where(c("ts") < day("2024-01-03 00:00:00")), e.where(c("ts") >= day("2024-01-28 00:00:00")), "user_id")


@query("J10_aged", "SELECT user_id FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00'")
def _(t):
    return relational.aged(t("events"), "user_id", "ts", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


# --- aggregation and windows ---


@query("A1_bag_count", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return relational.bag_count(t("events"), "event_type")


_KEY = "strftime(ts, '%a') || printf(':Hr%02d:Min%02d_%02d', hour(ts), CAST(floor(minute(ts) / 5) * 5 AS INT), (CAST(floor(minute(ts) / 5) * 5 AS INT) + 5) % 60)"


@query("A2_bucket_sum", f"SELECT {_KEY} AS timekey, regexp_replace(event_type, '[^A-Za-z0-9_]', '_', 'g') AS name, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    return relational.bucket_sum(t("events"), times.time_key(c("ts")), c("event_type"), "value").withColumn("total", F.round("total", 4))


def _fold(p, keys, rows):
    """A fold over ordered values in SQL, as a recursive query over row numbers."""
    return f"""WITH RECURSIVE s AS ({rows}), f AS (
        SELECT {keys}, rn, value AS expect, CAST(0 AS DOUBLE) AS var FROM s WHERE rn = 1
        UNION ALL SELECT {', '.join('s.' + k.strip() for k in keys.split(','))}, s.rn, {p} * s.value + {1 - p} * f.expect, {p} * (s.value - f.expect) * (s.value - f.expect) + {1 - p} * f.var
        FROM f JOIN s ON {' AND '.join(f's.{k.strip()} = f.{k.strip()}' for k in keys.split(','))} AND s.rn = f.rn + 1),
        m AS (SELECT {keys}, max(rn) AS n FROM s GROUP BY {keys})"""


@query("A4_ewma", _fold(0.4, "user_id", "SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events") + " SELECT f.user_id, round(expect, 4) AS expect, round(var, 3) AS var FROM f JOIN m ON f.user_id = m.user_id AND f.rn = m.n")
def _(t):
    return statistics.recent(t("events"), ["user_id"], ["ts", "event_id"], "value", statistics.horizon(1 - 0.4, 2)).withColumn("s", statistics.ewma(c("q"), 0.4)).select("user_id", F.round("s.expect", 4).alias("expect"), F.round("s.var", 3).alias("var"))


@query("A6_weekly_model", _fold(0.7, "timekey, observable", f"SELECT {_KEY} AS timekey, event_type AS observable, value, row_number() OVER (PARTITION BY {_KEY}, event_type ORDER BY ts) AS rn FROM events") + " SELECT f.timekey, f.observable, m.n, round(expect, 4) AS expect, round(var, 3) AS var FROM f JOIN m ON f.timekey = m.timekey AND f.observable = m.observable AND f.rn = m.n")
def _(t):
    samples = t("events").select(times.time_key(c("ts")).alias("timekey"), c("event_type").alias("observable"), "ts", "value")
    return statistics.weekly_model(samples).withColumn("expect", F.round("expect", 4)).withColumn("var", F.round("var", 3))


@query("A7_differences", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 6) AS dq FROM events")
def _(t):
    return statistics.differences(t("events"), "event_type", ["ts", "event_id"], "value", F.date_trunc("day", c("ts"))).select("event_id", F.round("dq", 6).alias("dq"))


_ROWS = "s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), m AS (SELECT user_id, max(rn) AS n FROM s GROUP BY 1)"


@query("A8_log_ewma", f"WITH RECURSIVE {_ROWS}, f AS (SELECT user_id, rn, round(0.45 * value, 2) AS av, round(0.45 * (value - round(0.45 * value, 2)) * (value - round(0.45 * value, 2)), 2) AS var FROM s WHERE rn = 1 UNION ALL SELECT s.user_id, s.rn, round(0.55 * f.av + 0.45 * s.value, 2), round(0.55 * f.var + 0.45 * (s.value - round(0.55 * f.av + 0.45 * s.value, 2)) * (s.value - round(0.55 * f.av + 0.45 * s.value, 2)), 2) FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1) SELECT f.user_id, round(av, 1) AS av, round(var / 100) AS var FROM f JOIN m ON f.user_id = m.user_id AND f.rn = m.n")
def _(t):
    folded = statistics.log_ewma(t("events"), ["user_id"], ["ts", "event_id"], "value")
    return folded.select("user_id", statistics.half_up(c("av"), 1).alias("av"), F.round(c("var") / 100).alias("var"))


@query("A5_two_regime", f"WITH RECURSIVE {_ROWS}, f AS (SELECT user_id, rn, 0.7 * greatest(value, 0) AS av FROM s WHERE rn = 1 UNION ALL SELECT s.user_id, s.rn, CASE WHEN s.rn <= 2 THEN 0.7 ELSE 0.3 END * greatest(s.value, 0) + CASE WHEN s.rn <= 2 THEN 0.3 ELSE 0.7 END * f.av FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1) SELECT f.user_id, round(av, 4) AS av FROM f JOIN m ON f.user_id = m.user_id AND f.rn = m.n")
def _(t):
    e = t("events").select("user_id", "ts", "event_id", "value")
    folded = statistics.recent(e, ["user_id"], ["ts", "event_id"], "value", statistics.horizon(0.7)).join(e.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")
    return folded.select("user_id", F.round(statistics.two_regime_ewma(c("q"), 2, seen=c("n") - F.size("q")), 4).alias("av"))


@query("A12_entropy", "WITH n AS (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY 1, 2), s AS (SELECT user_id, sum(k) AS n, count(*) AS m FROM n GROUP BY 1), e AS (SELECT n.user_id, CASE WHEN max(m) < 2 THEN 0 ELSE sum(-(k / s.n) * ln(k / s.n)) / ln(max(m)) END AS h FROM n JOIN s ON n.user_id = s.user_id GROUP BY 1) SELECT user_id, round(h, 6) AS entropy, CASE WHEN h < 0.2 THEN 'low' WHEN h > 0.9 THEN 'high' ELSE 'medium' END AS class FROM e")
def _(t):
    return statistics.entropy(t("events"), "user_id", "event_type").withColumn("entropy", F.round("entropy", 6))


@query("A13_envelope", "SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def _(t):
    return relational.envelope(t("events"), "event_type", "value")


_HIST = "WITH m AS (SELECT event_type, avg(value) AS e, var_pop(value) AS v FROM events GROUP BY 1), h AS (SELECT x.event_type, dayname(ts) AS day, CAST(least(greatest(floor(64 * (0.5 + (value - e) / (1 + sqrt(v)) / 10)), 0), 63) AS BIGINT) AS grain, count(*) AS count FROM events x JOIN m ON x.event_type = m.event_type GROUP BY 1, 2, 3)"


def _hist(t):
    e = t("events")
    m = e.groupBy("event_type").agg(F.avg("value").alias("e"), F.var_pop("value").alias("v"))
    return statistics.histogram(e.join(m, "event_type").withColumn("day", F.date_format("ts", "EEEE")), "event_type", "day", "value", "e", "v")


@query("A14_histogram", _HIST + " SELECT * FROM h")
def _(t):
    return _hist(t)


@query("A15_smoothing", _HIST + " SELECT event_type, day, grain, round(avg(count) OVER (PARTITION BY event_type, day ORDER BY grain ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM h")
def _(t):
    return statistics.smoothed(_hist(t), "event_type", "day").select("event_type", "day", "grain", F.round("smooth", 6).alias("smooth"))


@query("A16_normalised", _HIST + " SELECT event_type, day, grain, round(1000 * count / max(count) OVER (PARTITION BY event_type), 6) AS level FROM h")
def _(t):
    return statistics.normalised(_hist(t), "event_type").select("event_type", "day", "grain", F.round("level", 6).alias("level"))


@query("A17_rates", f"WITH s AS (SELECT event_id, user_id, {SECONDS} AS s, event_id * 1000 % 9973 AS v FROM events), l AS (SELECT *, lag(v) OVER w AS pv, lag(s) OVER w AS ps FROM s WINDOW w AS (PARTITION BY user_id ORDER BY s, v)) SELECT event_id, round(CASE WHEN ps IS NULL OR s = ps THEN -1 WHEN v < pv THEN (2147483647 - pv + v) / (s - ps) ELSE (v - pv) / (s - ps) END, 1) AS rate FROM l")
def _(t):
    e = t("events").select("event_id", "user_id", seconds().alias("s"), (c("event_id") * 1000 % 9973).alias("v"))
    return statistics.rates(e, "user_id", "s", "v").select("event_id", F.round("rate", 1).alias("rate"))


@query("A18_compliance", "SELECT user_id, round(avg(CASE WHEN event_type IN ('click', 'view') THEN 1.0 ELSE 0.0 END), 6) AS kept, max(CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END) AS worst FROM events GROUP BY 1")
def _(t):
    rank = F.when(c("event_type") == "error", 2).when(c("event_type") == "signup", 1).otherwise(0)
    return relational.compliance(t("events"), "user_id", c("event_type").isin("click", "view"), rank).withColumn("kept", F.round("kept", 6))


@query("A19_measurement", "SELECT p_type, sum(CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS BIGINT)) AS total, count(*) AS matches FROM part WHERE regexp_matches(p_name, '^red') GROUP BY 1")
def _(t):
    return relational.measurement(t("part"), "p_type", "p_name", "^red", "p_brand", "#(\\d+)")


@query("A20_log_summary", f"SELECT count(*) AS lines, max({SECONDS}) - min({SECONDS}) AS duration, count(DISTINCT {SECONDS} // 300) AS buckets FROM events")
def _(t):
    return relational.log_summary(t("events"), seconds())


@query("A21_score", "SELECT user_id, CAST(round(avg(value)) AS BIGINT) AS score FROM events GROUP BY 1")
def _(t):
    return relational.mean_score(t("events"), "user_id", "value")


@query("A22_best_text", "SELECT user_id, CASE WHEN count(DISTINCT event_type) > 1 THEN 'both ' ELSE '' END || string_agg(DISTINCT event_type, ' and ' ORDER BY event_type) AS best FROM events GROUP BY 1")
def _(t):
    return relational.best_text(t("events"), "user_id", "event_type")


@query("A24_group_counts", "SELECT count(*) FILTER (user_id <= 1) AS system, count(*) FILTER (user_id > 1) AS others, count(DISTINCT user_id) AS users FROM events")
def _(t):
    return relational.group_counts(t("events"), c("user_id") <= 1, "user_id")


@query("A25_growth", "SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS growth FROM orders")
def _(t):
    return relational.growth(t("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", F.round("growth", 2).alias("growth"))


@query("W2_last_change", f"WITH d AS (SELECT event_id, user_id, {SECONDS} AS s, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, ts FROM events) SELECT event_id, last_value(CASE WHEN p IS NULL OR p <> event_type THEN s END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS changed FROM d")
def _(t):
    return relational.last_change(t("events"), ["user_id"], ["ts", "event_id"], "event_type", seconds()).select("event_id", "changed")


@query("W3_leap", "WITH s AS (SELECT event_id, value, sum(value) OVER w AS t, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) SELECT event_id, round(CASE WHEN n < 10 OR 11 * t < 0.001 THEN 0 ELSE sqrt((t - 10 * value) * (t - 10 * value) / (11 * t)) END, 4) AS chi FROM s")
def _(t):
    return statistics.leap_scores(t("events"), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("chi", 4).alias("chi"))


@query("W4_gaps", f"WITH g AS (SELECT event_id, {SECONDS} - lag({SECONDS}) OVER (PARTITION BY user_id ORDER BY {SECONDS}, event_id) AS gap FROM events) SELECT event_id, gap FROM g WHERE gap > 86400")
def _(t):
    e = t("events").select("event_id", "user_id", seconds().alias("s"))
    return relational.growth(e, ["user_id"], ["s", "event_id"], "s", "gap").where("gap > 86400").select("event_id", "gap")


@query("W6_relocation", "WITH g AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT event_id FROM g WHERE p <> event_type")
def _(t):
    return relational.relocations(t("events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id")


@query("W7_buckets", "WITH k AS (SELECT user_id, ts, strftime(ts, '%Y-%m-%d') AS k FROM events), n AS (SELECT *, CASE WHEN k <> lag(k) OVER w THEN 1 ELSE 0 END AS f FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, k)), b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, k ROWS UNBOUNDED PRECEDING) AS bucket FROM n) SELECT user_id, CAST(bucket AS BIGINT) AS bucket, any_value(k) AS timekey, count(*) AS lines FROM b GROUP BY 1, 2")
def _(t):
    e = t("events").withColumn("k", F.date_format("ts", "yyyy-MM-dd"))
    return logs.buckets(e, ["user_id"], "ts", "k").select("user_id", "bucket", "timekey", "lines")


@query("W8_moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM events")
def _(t):
    return relational.moving_average(t("events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("smooth", 6).alias("smooth"))


@query("W10_nth_line", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 3")
def _(t):
    return relational.nth_row(t("events"), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id")


# --- order, sets ---


@query("O6_order", "SELECT event_type, row_number() OVER (ORDER BY n DESC, event_type) AS place FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def _(t):
    return relational.places(t("events"), "event_type")


@query("O4_ip_sort", "SELECT c_nationkey, array_to_string(list('10.' || (c_custkey % 300) || '.0.1' ORDER BY c_custkey % 300, c_custkey), ',') AS ips FROM customer GROUP BY 1")
def _(t):
    ip = F.concat(F.lit("10."), (c("c_custkey") % 300).cast("string"), F.lit(".0.1"))
    return t("customer").groupBy("c_nationkey").agg(text_of(lists.sort(F.collect_list(ip), "IP")).alias("ips"))


@query("O9_beam", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 7")
def _(t):
    return relational.beam(t("orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 7).select("o_custkey", "o_orderkey")


@query("O11_limit", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(t):
    return relational.first_rows(t("orders"), [F.desc("o_totalprice"), "o_orderkey"], 100).select("o_orderkey")


@query("U1_set_difference", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(t):
    return t("customer").select(c("c_nationkey").alias("k")).subtract(t("supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("U2_unique", "SELECT DISTINCT p_brand FROM part")
def _(t):
    return t("part").select("p_brand").distinct()


@query("U3_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t("customer").select(c("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("U4_concatenation", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def _(t):
    return t("customer").select(c("c_name").alias("name")).union(t("supplier").select("s_name"))


@query("U5_subset", "SELECT user_id, CAST(count(DISTINCT event_type) FILTER (event_type IN ('click', 'view')) = 2 AS BIGINT) AS has_both FROM events GROUP BY 1")
def _(t):
    kinds = F.collect_set("event_type")
    return t("events").groupBy("user_id").agg(lists.subset(F.array(F.lit("click"), F.lit("view")), kinds).cast("long").alias("has_both"))


@query("U6_state_changes", "WITH a AS (SELECT DISTINCT event_type || user_id AS name FROM events WHERE ts < TIMESTAMP '2024-01-03'), b AS (SELECT DISTINCT event_type || user_id AS name FROM events WHERE ts >= TIMESTAMP '2024-01-28') SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN '+' WHEN b.name IS NULL THEN '-' ELSE '=' END AS change, 'performance' AS syndrome FROM a FULL JOIN b ON a.name = b.name")
def _(t):
    e = t("events").withColumn("name", F.concat("event_type", c("user_id").cast("string")))
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    return anomaly.state_changes(e.where(c("ts") < day("2024-01-03 00:00:00")), e.where(c("ts") >= day("2024-01-28 00:00:00")))


# --- graph ---

_TUPLES = "SELECT n_name AS src, -3 AS atype, 'is in' AS fwd, r_name AS dst, 'contains' AS bwd, 'any' AS context FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_mktsegment, 1, 'buys in', n_name, 'sells to', 'x' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey"


def tuples(t):
    a = t("nation").join(t("region"), c("n_regionkey") == c("r_regionkey")).select(c("n_name").alias("src"), F.lit(-3).alias("atype"), F.lit("is in").alias("fwd"), c("r_name").alias("dst"), F.lit("contains").alias("bwd"), F.lit("any").alias("context"))
    b = t("customer").join(t("nation"), c("c_nationkey") == c("n_nationkey")).select(c("c_mktsegment").alias("src"), F.lit(1).alias("atype"), F.lit("buys in").alias("fwd"), c("n_name").alias("dst"), F.lit("sells to").alias("bwd"), F.concat(F.lit("x"), "c_mktsegment").alias("context"))
    return graph.sanitised(a.unionByName(b))


@query("S2_tuple_lines", f"SELECT '(' || concat_ws(',', src, atype, fwd, dst, bwd, context) || ')' AS line FROM ({_TUPLES})")
def _(t):
    return tuples(t).select(files.tuple_line().alias("line"))


@query("S1_tuple_scan", f"SELECT src, atype, dst, context FROM ({_TUPLES})")
def _(t):
    return files.parse_tuples(tuples(t).select(files.tuple_line().alias("value"))).select("src", "atype", "dst", "context")


@query("S3_cypher", f"SELECT DISTINCT 'MERGE (a:Concept {{name:''' || src || '''}}) MERGE (b:Concept {{name:''' || dst || '''}}) MERGE (a)-[:' || upper(replace(fwd, ' ', '_')) || ']->(b)' AS statement FROM ({_TUPLES})")
def _(t):
    return tuples(t).select(files.cypher(c("src"), c("dst"), c("fwd")).alias("statement")).distinct()


@query("S4_upsert_weight", f"SELECT src, dst, round(0.3 + 0.7 * (count(*) - 1), 6) AS w FROM ({_TUPLES}) GROUP BY 1, 2")
def _(t):
    return tuples(t).groupBy("src", "dst").agg(F.round(0.3 + 0.7 * (F.count("*") - 1), 6).alias("w"))


@query("S6_posted_tuple", "SELECT p_partkey, '(' || p_name || ',3)' AS line FROM part")
def _(t):
    return t("part").select("p_partkey", files.posted_tuple(F.concat(F.lit("%28"), F.replace("p_name", F.lit(" "), F.lit("+")), F.lit("%2C3%29"))).alias("line"))


@query("S9_store_latest", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(t):
    return files.latest(t("events"), ["user_id"], "ts", "event_id").select("user_id", "event_id")


@query("S12_csv_line", "SELECT p_partkey, '\"' || p_name || ',\"\"' || p_brand || '\"\"\",' || p_type AS line FROM part")
def _(t):
    return t("part").select("p_partkey", files.csv_line(F.concat("p_name", F.lit(',"'), "p_brand", F.lit('"')), c("p_type")).alias("line"))


@query("F102_string_array", "SELECT p_partkey, p_brand || ',' || p_type AS fields FROM part")
def _(t):
    text = F.concat(F.lit("# head\nk;"), "p_brand", F.lit(";"), "p_type", F.lit("\nz;1\n"))
    return t("part").select("p_partkey", text_of(files.string_array(text, "(?m)^#.*$", ";")["k"]).alias("fields"))


@query("F104_string_list", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), ',') AS items FROM part")
def _(t):
    return t("part").select("p_partkey", text_of(files.string_list(F.concat("p_name", F.lit(" #x")), "#.*", " ", 9)).alias("items"))


@query("G1_vertices", f"SELECT md5(name) AS id, name FROM (SELECT src AS name FROM ({_TUPLES}) UNION SELECT dst FROM ({_TUPLES}))")
def _(t):
    return graph.vertices(tuples(t))


_EDGES = f"SELECT src, atype, dst, fwd, count(*) AS n, min(context) AS icontext, round(1 - 0.3 * pow(0.4, count(*) - 1), 6) AS weight FROM (SELECT src, atype, fwd, dst, context FROM ({_TUPLES}) UNION ALL SELECT dst, -atype, bwd, src, context FROM ({_TUPLES})) GROUP BY 1, 2, 3, 4"


@query("G2_edges", _EDGES)
def _(t):
    return graph.edges(tuples(t))


@query("G3_contexts", f"SELECT DISTINCT e AS src, 5 AS atype, context AS dst FROM (SELECT src AS e, context FROM ({_TUPLES}) UNION ALL SELECT dst, context FROM ({_TUPLES})) WHERE e <> context UNION SELECT DISTINCT 'any', 3, context FROM ({_TUPLES}) WHERE context <> 'any'")
def _(t):
    return graph.context_tuples(tuples(t)).select("src", "atype", "dst")


@query("G6_roles", "SELECT p_partkey, unnest([p_type, p_brand, 'sold']) AS dst FROM part")
def _(t):
    return t("part").select("p_partkey", F.explode(graph.role_tuples(c("p_name"), c("p_type"), F.concat("p_brand", F.lit(",sold"))))).select("p_partkey", "col.dst")


@query("G7_context_words", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS dst FROM part")
def _(t):
    return t("part").select("p_partkey", F.explode(graph.context_words(c("p_name")))).select("p_partkey", "col.dst")


@query("J2_one_hop", f"WITH e AS ({_EDGES}) SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst")
def _(t):
    e = graph.edges(tuples(t)).select("src", "dst")
    return e.join(e.select(c("src").alias("mid"), c("dst").alias("end")), c("dst") == c("mid")).where("src <> end").select("src", c("end").alias("dst")).distinct()


@query("G14_stories", f"""WITH RECURSIVE e AS (SELECT DISTINCT src, atype, dst FROM ({_EDGES})), p AS (
    SELECT [r_name] AS path, CAST(NULL AS BIGINT) AS last, 0 AS hops FROM region
    UNION ALL SELECT list_append(path, e.dst), e.atype, hops + 1 FROM p JOIN e ON path[-1] = e.src WHERE hops < 3 AND NOT list_contains(path, e.dst) AND (last IS NULL OR e.atype <> -last))
    SELECT array_to_string(path, ' > ') AS path, CAST(hops AS BIGINT) AS hops FROM p WHERE hops > 0""")
def _(t):
    starts = t("region").select(c("r_name").alias("name"))
    return graph.stories(graph.edges(tuples(t)), starts, 3).select(F.array_join("path", " > ").alias("path"), "hops")



# --- text edits and logs ---

_TEXT = "p_name || chr(10) || p_type || chr(10) || p_brand"


def part_lines():
    return F.array("p_name", "p_type", "p_brand")


@query("E1_delete_lines", "SELECT p_partkey, array_to_string(list_filter([p_name, p_type, p_brand], lambda x: NOT starts_with(x, 'Brand#1')), '|') AS out FROM part")
def _(t):
    return t("part").select("p_partkey", F.array_join(lines.delete_lines(part_lines(), "Brand#1", "startwith"), "|").alias("out"))


@query("E2_insert_line", "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN concat_ws('|', p_name, p_type, 'new', p_brand) ELSE concat_ws('|', p_name, p_type, p_brand) END AS out FROM part")
def _(t):
    return t("part").select("p_partkey", F.array_join(lines.insert_line(part_lines(), "new", "ECONOMY"), "|").alias("out"))


@query("E3_replace", "SELECT p_partkey, array_to_string(list_transform([p_name, p_type, p_brand], lambda x: regexp_replace(x, '#(\\d)', ':\\1', 'g')), '|') AS out FROM part")
def _(t):
    return t("part").select("p_partkey", F.array_join(lines.replace_all(part_lines(), "#(\\d)", ":$1"), "|").alias("out"))


@query("E4_edit_field", "SELECT p_partkey, 'a:' || p_size || ':X' AS out FROM part")
def _(t):
    return t("part").select("p_partkey", lines.edit_field(F.concat(F.lit("a:"), c("p_size").cast("string"), F.lit(":c")), ":", 3, "X").alias("out"))


@query("E5_region", "SELECT p_partkey, CASE WHEN regexp_full_match(p_name, 'red.*') THEN p_type ELSE '' END AS out FROM part")
def _(t):
    return t("part").select("p_partkey", F.array_join(lines.region(part_lines(), "red.*", "Brand.*"), "|").alias("out"))


_LOG = "strftime(ts, '%Y-%m-%d %H:%M:%S') || '. host 10.0.0.' || (user_id % 200) || ' GET /' || event_type || '/x' || user_id || ' \"took ' || value || ' ms\"'"


def log_line():
    return F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(". host 10.0.0."), (c("user_id") % 200).cast("string"), F.lit(" GET /"), "event_type", F.lit("/x"), c("user_id").cast("string"), F.lit(' "took '), c("event_type"), F.lit(' ms"'))


@query("L2_line_time", f"SELECT event_id, {SECONDS} AS s FROM events")
def _(t):
    return t("events").select("event_id", times.epoch(logs.line_time(log_line())).alias("s"))


@query("L3_addresses", "SELECT event_id, '10.0.0.' || (user_id % 200) AS ip FROM events")
def _(t):
    return t("events").select("event_id", logs.ipv4(log_line()).alias("ip"))


@query("L4_uris", "SELECT event_id, '/' || event_type || '/x' || user_id AS uri FROM events")
def _(t):
    return t("events").select("event_id", F.explode(logs.uris(log_line())).alias("uri"))


@query("L6_messages", "SELECT event_id, 'took ' || event_type || ' ms' AS quoted, '. host ... GET ' || event_type || 'x took ' || event_type || ' ms' AS message FROM events")
def _(t):
    return t("events").select("event_id", F.get(logs.fragments(log_line()), 0).alias("quoted"), F.regexp_replace(logs.message(log_line()), "^[:. ]*host", ". host").alias("message"))


@query("L7_counter_key", "SELECT p_partkey, CASE WHEN length(k) >= 12 THEN k END AS key FROM (SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' ' || p_brand, '[,0-9]', '', 'g'), '[^A-Za-z0-9]', '_', 'g') AS k FROM part)")
def _(t):
    return t("part").select("p_partkey", logs.counter_key(F.concat("p_name", F.lit(" "), "p_brand")).alias("key"))


@query("L13_items", "SELECT p_partkey, array_to_string(list_concat(string_split(p_name, ' '), ['\"a b\"', p_type]), '|') AS items FROM part")
def _(t):
    return t("part").select("p_partkey", F.array_join(logs.items(F.concat("p_name", F.lit(', "a b"; '), "p_type")), "|").alias("items"))



@query("N2_situation", "WITH m AS (SELECT event_type, round(avg(value), 6) AS e, round(stddev_pop(value), 6) AS s FROM events GROUP BY 1), d AS (SELECT event_id, x.event_type, value - e AS d, sqrt((value - e) * (value - e) / (1 + s * s)) AS dev FROM events x JOIN m ON x.event_type = m.event_type) SELECT event_id, event_type || CASE WHEN d > 0 THEN '_high' WHEN d < 0 THEN '_low' ELSE '_normal' END || CASE WHEN dev > 3 * sqrt(2) THEN '_anomaly' WHEN dev <= sqrt(2) THEN '_normal' ELSE '' END AS class FROM d")
def _(t):
    e = t("events")
    m = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("e"), F.round(F.stddev_pop("value"), 6).alias("s"))
    return e.join(m, "event_type").select("event_id", anomaly.situation(c("event_type"), c("value"), c("e"), c("s")).alias("class"))


@query("N5_process_class", "WITH m AS (SELECT event_type, avg(value) AS e, var_pop(value) AS v FROM events GROUP BY 1) SELECT event_id, CASE WHEN value > e + 3 * greatest(0.1, sqrt(v)) THEN x.event_type || '_high_anomaly' WHEN value < e - 3 * greatest(0.1, sqrt(v)) THEN x.event_type || '_low_anomaly' END AS class FROM events x JOIN m ON x.event_type = m.event_type")
def _(t):
    e = t("events")
    m = e.groupBy("event_type").agg(F.avg("value").alias("e"), F.var_pop("value").alias("v"))
    return e.join(m, "event_type").select("event_id", anomaly.process_class(c("event_type"), c("value"), c("e"), c("v")).alias("class"))


# --- reports and convergent rows ---


@query("R1_measurements", "SELECT event_type FROM events GROUP BY 1 HAVING avg(value) <> 0")
def _(t):
    return relational.measures(t("events"), "event_type", "value")


@query("R2_weekly_series", f"SELECT CAST(floor((({SECONDS} - 345600) % 604800) / 300) AS BIGINT) AS slot, count(*) AS n, round(avg(value), 6) AS q FROM events WHERE event_type = 'click' GROUP BY 1")
def _(t):
    return relational.weekly_points(t("events").where("event_type = 'click'"), times.slot(c("ts")), "value").withColumn("q", F.round("q", 6))


@query("R6_dense_slots", f"SELECT s AS slot, coalesce(n, 0) AS n FROM (SELECT unnest(range(2016)) AS s) LEFT JOIN (SELECT CAST(floor((({SECONDS} - 345600) % 604800) / 300) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1) ON s = k")
def _(t):
    return relational.dense_slots(relational.bag_count(t("events").select(times.slot(c("ts")).alias("slot")), "slot"))


@query("D2_converge", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'update' ELSE 'keep' END AS action FROM customer UNION ALL SELECT -s_suppkey - 1, 'NEW', 'insert' FROM supplier")
def _(t):
    cust, new = t("customer"), F.lit("NEW").alias("c_mktsegment")
    wanted = cust.where("c_custkey % 3 = 0").select("c_custkey", new).unionByName(t("supplier").select((-c("s_suppkey") - 1).alias("c_custkey"), new))
    return files.converge(cust.select("c_custkey", "c_mktsegment"), wanted, ["c_custkey"], "c_mktsegment")


@query("G10_event_clue", "SELECT event_id, unnest(['u' || user_id, event_type, 'd' || day(ts), 'web', 'http', 'log']) AS dst FROM events")
def _(t):
    parts = (F.concat(F.lit("u"), c("user_id").cast("string")), c("event_type"), F.concat(F.lit("d"), F.dayofmonth("ts").cast("string")), F.lit("web"), F.lit("http"), F.lit("log"))
    return t("events").select("event_id", F.explode(graph.event_clue(*parts)).alias("x")).where("x.fwd = 'has attribute'").select("event_id", "x.dst")


@query("G9_whereabouts", "SELECT c_custkey, n_name AS src, c_name AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    rows = t("customer").join(t("nation"), c("c_nationkey") == c("n_nationkey"))
    return rows.select("c_custkey", F.explode(graph.whereabouts(c("c_mktsegment"), c("c_name"), c("n_name"), F.lit("10.0.0.1"))).alias("x")).where("x.src = n_name").select("c_custkey", "x.src", "x.dst")


@query("G11_service", "SELECT s_suppkey, s_name || ' on port ' || s_nationkey AS dst FROM supplier")
def _(t):
    return t("supplier").select("s_suppkey", F.explode(graph.service(c("s_name"), c("s_nationkey"), F.lit("a"), F.lit("b"))).alias("x")).where("x.fwd = 'gives'").select("s_suppkey", "x.dst")


@query("L11_segments", "SELECT CAST(p_partkey AS VARCHAR) AS doc, unnest(['a', p_brand, p_type, 'z']) AS item, unnest(['1', '2,1', '2,2,1', '3']) AS coords FROM part")
def _(t):
    text = F.concat(F.lit("a {"), "p_brand", F.lit(" ["), "p_type", F.lit("]} z"))
    rows = nesting.segments(t("part").select("p_partkey", text.alias("text")), "p_partkey", "text")
    return rows.select("doc", F.array_join("vals", " ").alias("item"), text_of(c("coords")).alias("coords"))


@query("S24_template", "SELECT event_id, 'k=' || json_extract_string(props, '$.k') || '!' AS out FROM events")
def _(t):
    return t("events").select("event_id", templates.rendered("k={{k}}{{#none}}x{{/none}}{{^none}}!{{/none}}", c("props")).alias("out"))


@query("R5_ranges", "SELECT event_type, printf('%.2f .. %.2f', min(value), max(value)) AS range FROM events GROUP BY 1")
def _(t):
    return relational.ranges(t("events"), "event_type", "value")


@query("R3_last_event", "SELECT event_type, max(event_id) FILTER (ts = m) AS event_id FROM (SELECT *, max(ts) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1")
def _(t):
    return t("events").groupBy("event_type").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


@query("A9_process_ewma", _fold(0.7, "user_id", "SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events") + " SELECT f.user_id, round(expect, 4) AS av, round(var, 3) AS var FROM f JOIN m ON f.user_id = m.user_id AND f.rn = m.n")
def _(t):
    return statistics.recent(t("events"), ["user_id"], ["ts", "event_id"], "value", statistics.horizon(1 - 0.7, 2)).withColumn("s", statistics.ewma(c("q"), 0.7)).select("user_id", F.round("s.expect", 4).alias("av"), F.round("s.var", 3).alias("var"))


@query("S8_unexpired", f"SELECT user_id FROM events GROUP BY 1 HAVING max({SECONDS}) >= 1706659200 - 691200 * 0.02")
def _(t):
    last = t("events").groupBy("user_id").agg(F.max(seconds()).alias("s"))
    return files.unexpired(last, "s", F.lit(1706659200), int(691200 * 0.02)).select("user_id")


@query("R4_promises", "SELECT p_partkey, 'default:' || p_type AS namespacepath, p_brand AS handle FROM part WHERE regexp_matches('default:' || p_type || ':' || p_brand, 'Brand#1')")
def _(t):
    compliance = t("part").select("p_partkey", F.concat(F.lit("default:"), "p_type", F.lit(":"), "p_brand").alias("handle"), F.lit(1.0).alias("q"), F.lit(1.0).alias("expect"), F.lit(0.0).alias("var"))
    return reports.promises(compliance, "Brand#1", "p_partkey").select("p_partkey", "namespacepath", "handle")


@query("S18_process_table", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS pid, p_name AS command FROM part")
def _(t):
    lines_ = t("part").select("p_partkey", F.format_string("%-8s%9d %s", F.lit("root"), c("p_partkey"), c("p_name")).alias("value"))
    return captures.process_table(lines_, "USER          PID COMMAND", keep=("p_partkey",)).select("p_partkey", "pid", "command")
