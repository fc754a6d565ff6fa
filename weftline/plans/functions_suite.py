"""Each function of the library over a standard table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arithmetic, lists, text, times
from ..operators import relational
from .registry import columns, query, text_of

c = F.col

PART_SQL = "SELECT *, list_concat(string_split(p_name, ' '), [p_type, p_brand]) AS l, list_concat(string_split(p_name, ' '), ['red', 'ring', 'red']) AS m FROM part"


def part_base(df):
    return df.withColumn("l", F.concat(F.split("p_name", " "), F.array("p_type", "p_brand"))).withColumn("m", F.concat(F.split("p_name", " "), F.array(F.lit("red"), F.lit("ring"), F.lit("red"))))


def part(name, **outputs):
    columns(name, "part", part_base, PART_SQL, "p_partkey", **outputs)


plain = lambda df: df


def event(name, **outputs):
    columns(name, "events", plain, "SELECT * FROM events", "event_id", **outputs)


joined = lambda s: f"array_to_string({s}, ',')"

part("F7_canonify", out=(lambda: text.canonify(c("p_name")), "regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g')"))
part("F8_canonifyuniquely", out=(lambda: text.canonify_uniquely(c("p_brand")), "regexp_replace(p_brand, '[^A-Za-z0-9_]', '_', 'g') || '_' || sha1(p_brand)"))
part("F9_concat", out=(lambda: F.concat("p_name", "p_brand", "p_type"), "p_name || p_brand || p_type"))
part("F18_dirname", out=(lambda: text.dirname(F.concat(F.lit("/a/"), "p_type", F.lit("/"), "p_name")), "'/a/' || p_type"))
part("F20_escape", out=(lambda: text.escape(F.concat("p_brand", F.lit(".*(x)[y]"))), "p_brand || '\\.\\*\\(x\\)\\[y\\]'"))
part("F17_difference", out=(lambda: text_of(lists.difference(c("l"), F.split("p_name", " "))), joined("list_filter([p_type, p_brand], lambda x: NOT list_contains(string_split(p_name, ' '), x))")))
part("F54_intersection", out=(lambda: text_of(lists.intersection(F.split("p_name", " "), F.array(F.lit("red"), F.lit("ring")))), joined("list_filter(string_split(p_name, ' '), lambda x: x IN ('red', 'ring'))")))
part("F22_every", out=(lambda: lists.every(c("l"), "[A-Za-z0-9# ]+").cast("long"), "CAST(len(list_filter(l, lambda x: NOT regexp_full_match(x, '[A-Za-z0-9# ]+'))) = 0 AS BIGINT)"))
part("F121_some", out=(lambda: lists.some(c("l"), "r.*").cast("long"), "CAST(len(list_filter(l, lambda x: regexp_full_match(x, 'r.*'))) > 0 AS BIGINT)"))
part("F76_none", out=(lambda: lists.none(c("l"), "r.*").cast("long"), "CAST(len(list_filter(l, lambda x: regexp_full_match(x, 'r.*'))) = 0 AS BIGINT)"))
part("F42_grep", out=(lambda: text_of(lists.grep(c("l"), "[a-z]+")), joined("list_filter(l, lambda x: regexp_full_match(x, '[a-z]+'))")))
part("F30_filter", out=(lambda: text_of(lists.filtered(c("l"), "[a-z]+", invert=True, most=1)), joined("list_slice(list_filter(l, lambda x: NOT regexp_full_match(x, '[a-z]+')), 1, 1)")))
part("F25_expandrange", out=(lambda: text_of(lists.expandrange("host", F.lit(1), (c("p_size") % 5).cast("int"), 1, "x")), joined("list_transform(CASE WHEN p_size % 5 >= 1 THEN range(1, p_size % 5 + 1) ELSE [1, 0] END, lambda i: 'host' || i || 'x')")))
part("F32_format", out=(lambda: F.format_string("%s-%05d|%x", c("p_brand"), c("p_size"), c("p_size")), "printf('%s-%05d|%x', p_brand, p_size, p_size)"))
part("F44_hash", md5=(lambda: text.digest(c("p_name"), "md5"), "md5(p_name)"), sha1=(lambda: text.digest(c("p_name"), "sha1"), "sha1(p_name)"), sha256=(lambda: text.digest(c("p_name"), "sha256"), "sha256(p_name)"))
part("F45_hashmatch", out=(lambda: (text.digest(c("p_type"), "md5") == F.md5(F.lit("ECONOMY"))).cast("long"), "CAST(md5(p_type) = md5('ECONOMY') AS BIGINT)"))
part("F53_ifelse", out=(lambda: F.when(c("p_size") > 40, "large").when(c("p_size") > 10, "middle").otherwise("small"), "CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 10 THEN 'middle' ELSE 'small' END"))
part("F56_irange", lo=(lambda: F.least(c("p_size"), F.lit(20)).cast("long"), "CAST(least(p_size, 20) AS BIGINT)"), hi=(lambda: F.greatest(c("p_size"), F.lit(20)).cast("long"), "CAST(greatest(p_size, 20) AS BIGINT)"))
part("F59_isgreaterthan", num=(lambda: text.is_greater_than(c("p_size").cast("string"), F.lit("9")).cast("long"), "CAST(p_size > 9 AS BIGINT)"), txt=(lambda: text.is_greater_than(c("p_name"), F.lit("9")).cast("long"), "CAST(p_name > '9' AS BIGINT)"))
part("F60_islessthan", num=(lambda: text.is_less_than(c("p_size").cast("string"), F.lit("10")).cast("long"), "CAST(p_size < 10 AS BIGINT)"), txt=(lambda: text.is_less_than(c("p_name"), F.lit("m")).cast("long"), "CAST(p_name < 'm' AS BIGINT)"))
part("F65_join", out=(lambda: lists.joined(c("l"), "+"), "array_to_string(l, '+')"))
part("F66_lastnode", out=(lambda: text.lastnode(c("p_name"), " "), "list_extract(string_split(p_name, ' '), -1)"))
part("F74_maplist", out=(lambda: text_of(F.transform("l", lambda x: text.template("<$(this)>", {"this": x}))), joined("list_transform(l, lambda x: '<' || x || '>')")))
part("F79_nth", out=(lambda: lists.nth(c("l"), 1), "list_extract(l, 2)"))
part("F108_regcmp", out=(lambda: text.full_match(c("p_name"), "(red|small) .*").cast("long"), "CAST(regexp_full_match(p_name, '(red|small) .*') AS BIGINT)"))
part("F109_regextract", out=(lambda: text.regextract(c("p_brand"), "(.*)#(.*)", 2)[2], "regexp_extract(p_brand, '(.*)#(.*)', 2)"))
part("F112_reglist", out=(lambda: lists.some(c("l"), "Brand#1.*").cast("long"), "CAST(len(list_filter(l, lambda x: regexp_full_match(x, 'Brand#1.*'))) > 0 AS BIGINT)"))
part("F118_reverse", out=(lambda: text_of(F.reverse("l")), joined("list_reverse(l)")))
part("F122_sort", out=(lambda: text_of(lists.sort(c("l"))), joined("list_sort(l)")))
part("F124_splitstring", out=(lambda: text_of(text.splitstring(c("p_name"), " ", 1)), "string_split(p_name, ' ')[1]"))
part("F126_strcmp", out=(lambda: (c("p_type") == "ECONOMY").cast("long"), "CAST(p_type = 'ECONOMY' AS BIGINT)"))
part("F128_sublist", head=(lambda: text_of(lists.sublist(c("l"), "head", 2)), joined("list_slice(l, 1, 2)")), tail=(lambda: text_of(lists.sublist(c("l"), "tail", 2)), joined("list_slice(l, len(l) - 1, len(l))")))
part("F131_unique", out=(lambda: F.size(lists.unique(c("m"))).cast("long"), "CAST(len(list_distinct(m)) AS BIGINT)"))
part("F136_string_downcase", out=(lambda: F.lower("p_brand"), "lower(p_brand)"))
part("F141_string_upcase", out=(lambda: F.upper("p_name"), "upper(p_name)"))
part("F137_string_head", out=(lambda: text.string_head(c("p_name"), 3), "left(p_name, 3)"))
part("F140_string_tail", out=(lambda: text.string_tail(c("p_name"), 3), "right(p_name, 3)"))
part("F138_string_reverse", out=(lambda: F.reverse("p_name"), "reverse(p_name)"))
part("F139_string_length", out=(lambda: text.string_length(c("p_name")), "CAST(strlen(p_name) AS BIGINT)"))
part("F142_length", out=(lambda: F.size("m").cast("long"), "CAST(len(m) AS BIGINT)"))
part("F21_eval", a=(lambda: F.round(arithmetic.evaluate("(2 + $(s)) ^ 2 / 4k - sqrt($(s))", {"s": c("p_size")}), 6), "round(pow(2 + p_size, 2) / 4000 - sqrt(p_size), 6)"), b=(lambda: arithmetic.evaluated_text("200 % 3 + step(-1) + 2"), "'4.000000'"))
part("P5_regex", whole=(lambda: text.full_match(c("p_name"), "red").cast("long"), "CAST(regexp_full_match(p_name, 'red') AS BIGINT)"), partial=(lambda: c("p_name").rlike("red").cast("long"), "CAST(regexp_matches(p_name, 'red') AS BIGINT)"))
part("P13_template", out=(lambda: text.template("$(b)/$(t)[$(x)]", {"b": c("p_brand"), "t": c("p_type")}), "p_brand || '/' || p_type || '[$(x)]'"))
part("F40_getvalues", out=(lambda: text_of(F.array_distinct(F.map_values(F.create_map(F.lit("a"), "p_type", F.lit("b"), "p_type", F.lit("c"), "p_brand")))), "p_type || ',' || p_brand"))
part("F73_maparray", out=(lambda: text_of(F.transform(F.map_entries(F.create_map(F.lit("b"), "p_brand", F.lit("t"), "p_type")), lambda e: text.template("$(k)=$(v)", {"k": e["key"], "v": e["value"]}))), "'b=' || p_brand || ',t=' || p_type"))
part("F75_mergedata", out=(lambda: lists.merge_maps(F.create_map(F.lit("a"), "p_type", F.lit("b"), "p_type"), F.create_map(F.lit("b"), "p_brand"))["b"], "p_brand"))
part("F107_regarray", out=(lambda: lists.some(F.map_values(F.create_map(F.lit("a"), "p_type", F.lit("b"), "p_brand")), "E.*").cast("long"), "CAST(p_type LIKE 'E%' OR p_brand LIKE 'E%' AS BIGINT)"))
part("F4_and_or_not", conj=(lambda: ((c("p_size") > 9) & (c("p_type") == "ECONOMY")).cast("long"), "CAST(p_size > 9 AND p_type = 'ECONOMY' AS BIGINT)"), disj=(lambda: ((c("p_size") > 9) | (c("p_type") == "ECONOMY")).cast("long"), "CAST(p_size > 9 OR p_type = 'ECONOMY' AS BIGINT)"), neg=(lambda: (~(c("p_size") > 9)).cast("long"), "CAST(NOT p_size > 9 AS BIGINT)"))
part("F55_iprange", out=(lambda: text.in_ip_range(F.concat(F.lit("10.0."), c("p_size").cast("string"), F.lit(".7")), "10.0.16.0/20").cast("long"), "CAST(p_size BETWEEN 16 AND 31 AS BIGINT)"))
part("F49_hostrange", out=(lambda: F.regexp_extract("p_brand", "#(\\d+)$", 1).cast("int").between(5, 15).cast("long"), "CAST(CAST(regexp_extract(p_brand, '#(\\d+)$', 1) AS INT) BETWEEN 5 AND 15 AS BIGINT)"))
part("E9_version_compare", out=(lambda: text.compare_versions(F.concat(F.lit("1."), c("p_size").cast("string")), F.lit("1.9")).cast("long"), "CAST(sign(p_size - 9) AS BIGINT)"))

event("F2_accumulated", out=(lambda: times.accumulated(c("user_id") % 3, F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.lit(5)), "CAST(5 + 240 + 10800 + 172800 + 2592000 + 31536000 * (user_id % 3) AS BIGINT)"))
event("F67_laterthan", out=(lambda: (c("ts") > F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).cast("long"), "CAST(ts > TIMESTAMP '2024-01-15 00:00:00' AS BIGINT)"))
event("F127_strftime", out=(lambda: times.strftime("%Y-%m-%dT%H:%M:%S %a", c("ts")), "strftime(ts, '%Y-%m-%dT%H:%M:%S %a')"))
event("F80_on", out=(lambda: times.epoch(F.make_timestamp(F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.lit(0), F.lit(0), F.lit(0))).cast("long"), "CAST(epoch(date_trunc('day', ts)) AS BIGINT)"))
event("F85_parsejson", out=(lambda: F.get_json_object("props", "$.k").cast("long"), "CAST(json_extract_string(props, '$.k') AS BIGINT)"))
event("F125_storejson", out=(lambda: F.to_json(F.struct(c("user_id").alias("u"), c("event_type").alias("t"))), "'{\"u\":' || user_id || ',\"t\":\"' || event_type || '\"}'"))
_low = "CAST(floor(minute(ts) / 5) * 5 AS INT)"
event("T_timekey", tkey=(lambda: times.time_key(c("ts")), f"strftime(ts, '%a') || printf(':Hr%02d:Min%02d_%02d', hour(ts), {_low}, ({_low} + 5) % 60)"), slot=(lambda: times.slot(c("ts")), "CAST(floor(((CAST(floor(epoch(ts)) AS BIGINT) - 345600) % 604800) / 300) AS BIGINT)"), shift=(lambda: times.shift_slot(c("ts")), "CAST(floor(((CAST(floor(epoch(ts)) AS BIGINT) - 345600) % 604800) / 21600) AS BIGINT)"), start=(lambda: times.slot_start(c("ts")), "CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 300"))
event("T_timeclasses", out=(lambda: text_of(times.time_classes(c("ts"))), f"concat_ws(',', 'Lcycle_' || year(ts) % 3, 'Yr' || year(ts), monthname(ts), dayname(ts), 'Day' || day(ts), (['Night', 'Morning', 'Afternoon', 'Evening'])[CAST(floor(hour(ts) / 6) AS INT) + 1], printf('Hr%02d', hour(ts)), 'Hr' || hour(ts), 'Q' || CAST(floor(minute(ts) / 15) + 1 AS INT), printf('Hr%02d_Q%d', hour(ts), CAST(floor(minute(ts) / 15) + 1 AS INT)), printf('Min%02d', minute(ts)), printf('Min%02d_%02d', {_low}, ({_low} + 5) % 60))"))

_NUMBERS = "SELECT l_orderkey, list(CAST(l_partkey % 97 AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey) AS v FROM lineitem GROUP BY l_orderkey"


def _numbers(df):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    return df.groupBy("l_orderkey").agg(F.transform(rows, lambda x: (x["l_partkey"] % 97).cast("string")).alias("v"))


def numbers(name, **outputs):
    columns(name, "lineitem", _numbers, _NUMBERS, "l_orderkey", **outputs)


_d = "list_transform(v, lambda x: CAST(x AS DOUBLE))"
numbers("F129_sum", out=(lambda: lists.total(c("v")), f"list_sum({_d})"))
numbers("F93_product", out=(lambda: F.round(F.log10(lists.product(c("v")) + 1), 6), f"round(log10(list_product({_d}) + 1), 6)"))
numbers("F144_mean", out=(lambda: F.round(lists.mean(c("v")), 6), f"round(list_avg({_d}), 6)"))
numbers("F146_variance", out=(lambda: F.round(lists.variance(c("v")), 4), f"CASE WHEN len(v) = 1 THEN 0 ELSE round(list_var_samp({_d}), 4) END"))
numbers("F143_max", lex=(lambda: lists.greatest(c("v")), "list_max(v)"), num=(lambda: lists.greatest(c("v"), "int"), f"CAST(CAST(list_max({_d}) AS INT) AS VARCHAR)"))
numbers("F145_min", lex=(lambda: lists.least(c("v")), "list_min(v)"), num=(lambda: lists.least(c("v"), "real"), f"CAST(CAST(list_min({_d}) AS INT) AS VARCHAR)"))
numbers("O3_sort_numbers", out=(lambda: text_of(lists.sort(c("v"), "int")), joined("list_transform(list_sort(list_transform(v, lambda x: CAST(x AS INT))), lambda x: CAST(x AS VARCHAR))")))
numbers("U8_ring_buffer", out=(lambda: text_of(lists.ring(c("v"), 3)), joined("list_slice(v, greatest(len(v) - 2, 1), len(v))")))


@query("F82_packagesmatching", "SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, 's.*') AND regexp_full_match(p_brand, 'Brand#1.*') AND regexp_full_match(p_type, '.*')")
def _(t):
    return t("part").where(text.full_match(c("p_name"), "s.*") & text.full_match(c("p_brand"), "Brand#1.*") & text.full_match(c("p_type"), ".*")).select("p_partkey", "p_name")


@query("F14_countmatching", "SELECT count(*) AS n FROM part WHERE regexp_full_match(p_name, 'red.*')")
def _(t):
    return relational.count_matching(t("part"), "p_name", "red.*")


@query("F111_regline", "SELECT bool_or(regexp_full_match(p_name, 'red widget')) AS found FROM part")
def _(t):
    return relational.any_matches(t("part"), "p_name", "red widget")


@query("F50_hostsseen", "SELECT user_id FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-30 12:00:00'")
def _(t):
    return relational.seen_since(t("events"), "user_id", "ts", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


@query("F90_peers", "WITH g AS (SELECT n_name, (row_number() OVER (ORDER BY n_nationkey) - 1) // 4 AS g FROM nation) SELECT n_name, (SELECT count(*) - 1 FROM g h WHERE h.g = g.g) AS n_peers, (SELECT min(n_name) FROM g h WHERE h.g = g.g) AS least FROM g")
def _(t):
    return relational.peer_groups(t("nation"), "n_name", F.floor(c("n_nationkey") / 4))


@query("F91_peerleader", "SELECT n_name, first_value(n_name) OVER (PARTITION BY n_nationkey // 4 ORDER BY n_nationkey) AS leader FROM nation")
def _(t):
    return relational.peer_leader(t("nation"), "n_name", F.floor(c("n_nationkey") / 4), "n_nationkey")


@query("F92_peerleaders", "SELECT n_name FROM nation WHERE n_nationkey % 4 = 0")
def _(t):
    return t("nation").where(c("n_nationkey") % 4 == 0).select("n_name")
