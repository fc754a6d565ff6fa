"""Readers, class catalogues, choice, relevance, emitters, log objects and spans over standard tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chance, classes, lists, modules, tables, text, times
from ..operators import anomaly, emitters, graph, logs, nesting, promises, relevance, statistics
from ..sources import captures, catalogue, files, listings, xml, yaml
from .functions_suite import event, joined, part
from .operators_suite import _EDGES, _TUPLES, SECONDS, seconds, tuples
from . import reports
from .registry import QUERIES, SQL, query, text_of

c = F.col

# --- class and variable catalogues ---

_CANON = "regexp_replace(p_brand, '[^A-Za-z0-9_]', '_', 'g')"
part("F11_classify", out=(lambda: classes.classify(c("p_brand"), F.array(*[F.lit(f"Brand_{k}") for k in range(1, 12)])).cast("long"), f"CAST({_CANON} IN ({', '.join(f'\'Brand_{k}\'' for k in range(1, 12))}) AS BIGINT)"))
part("F12_classmatch", out=(lambda: classes.matches_any(c("l"), "r.*g").cast("long"), "CAST(len(list_filter(l, lambda x: regexp_full_match(x, 'r.*g'))) > 0 AS BIGINT)"))
part("F13_classesmatching", out=(lambda: text_of(classes.matching(c("m"), "r.*")), joined("list_sort(list_distinct(list_filter(m, lambda x: regexp_full_match(x, 'r.*'))))")))
part("F64_isvariable", out=(lambda: classes.is_defined(c("l"), F.lit("ring")).cast("long"), "CAST(list_contains(l, 'ring') AS BIGINT)"))


def _names(t):
    return t("part").select("p_partkey", c("p_name").alias("name"), F.array("p_type", "p_brand").alias("tags"))


@query("F134_variablesmatching", "SELECT p_partkey, p_name AS name FROM part WHERE regexp_full_match(p_name, 's.*') AND (regexp_full_match(p_type, 'Brand#1.*') OR regexp_full_match(p_brand, 'Brand#1.*')) AND (regexp_full_match(p_type, 'E.*') OR regexp_full_match(p_brand, 'E.*'))")
def _(t):
    return classes.named(_names(t), "s.*", "Brand#1.*", "E.*").select("p_partkey", "name")


@query("F5_bundlesmatching", "SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '.*ring')")
def _(t):
    return classes.named(_names(t), ".*ring").select("p_partkey")


for _name, _of in (("F33_getclassmetatags", "red ring"), ("F41_getvariablemetatags", "small widget")):
    query(_name, f"SELECT DISTINCT unnest([p_type, p_brand]) AS tag FROM part WHERE p_name = '{_of}'")(lambda t, of=_of: classes.tags_of(_names(t), of).distinct())

for _name, _scope, _key, _value in (("F6_bundlestate", "n_regionkey", "n_name", "n_nationkey"), ("F16_datastate", "n_regionkey", "n_nationkey", "n_name")):
    query(_name, f"SELECT {_scope}, '{{' || string_agg('\"' || {_key} || '\":\"' || {_value} || '\"', ',' ORDER BY CAST({_key} AS VARCHAR)) || '}}' AS state FROM nation GROUP BY 1")(lambda t, s=_scope, k=_key, v=_value: classes.state(t("nation"), s, k, v))

# --- arrays out of lines ---

_LINES = lambda: F.concat(F.lit("# head\nk;"), c("p_size").cast("string"), F.lit(";"), c("p_retailprice").cast("string"), F.lit(";"), "p_brand", F.lit("\n\nz;1;2\nk2;x\n"))
_COMMENT = "(?m)^#.*$"
_PRICE = "CAST(p_retailprice AS VARCHAR)"


def _sum(values):
    return F.round(F.aggregate(F.filter(values, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x), 4)


part("F84_parseintarray", out=(lambda: text_of(tables.by_first_field(_LINES(), _COMMENT, ";", "int")["k"]), "CAST(p_size AS VARCHAR)"), n=(lambda: F.size(tables.by_first_field(_LINES(), _COMMENT, ";", "int")).cast("long"), "CAST(p_size * 0 + 3 AS BIGINT)"))
part("F86_parserealarray", out=(lambda: _sum(tables.by_first_field(_LINES(), _COMMENT, ";", "real")["k"]), "round(p_size + p_retailprice, 4)"))
part("F87_parsestringarray", out=(lambda: text_of(tables.by_first_field(_LINES(), _COMMENT, ";")["k"]), f"p_size || ',' || {_PRICE} || ',' || p_brand"))
part("F88_parsestringarrayidx", out=(lambda: text_of(tables.by_line(_LINES(), _COMMENT, ";")[F.lit(0).cast("long")]), f"'k,' || p_size || ',' || {_PRICE} || ',' || p_brand"))
part("F97_readintarray", out=(lambda: _sum(tables.by_first_field(F.concat("p_name", F.lit(":"), c("p_partkey").cast("string"), F.lit(":7:x")), "#.*", ":", "int")[c("p_name")].cast("array<double>")), "CAST(p_partkey + 7 AS DOUBLE)"))
part("F98_readintlist", out=(lambda: _sum(tables.typed_list(F.concat(c("p_size").cast("string"), F.lit(", 3,"), c("p_partkey").cast("string")), "#.*", ",", "int", 9).cast("array<double>")), "CAST(p_size + 3 + p_partkey AS DOUBLE)"))
part("F100_readrealarray", out=(lambda: _sum(tables.by_first_field(F.concat("p_name", F.lit(":"), c("p_retailprice").cast("string"), F.lit(":0.5")), "#.*", ":", "real")[c("p_name")]), "round(p_retailprice + 0.5, 4)"))
part("F101_readreallist", out=(lambda: _sum(tables.typed_list(F.concat(c("p_retailprice").cast("string"), F.lit(" 0.25 x # 9")), "#.*", " ", "real", 9)), "round(p_retailprice + 0.25, 4)"))
part("F103_readstringarrayidx", out=(lambda: text_of(tables.by_line(F.array_join(F.array("p_type", "p_name", "p_brand"), "\n"), "#.*", " ")[F.lit(1).cast("long")]), "replace(p_name, ' ', ',')"))
part("F147_data_readstringarray", out=(lambda: F.to_json(tables.by_first_field(F.array_join(F.array("p_name", "p_type"), "\n"), "#.*", " ")), "'{\"' || string_split(p_name, ' ')[1] || '\":[\"' || string_split(p_name, ' ')[2] || '\"],\"' || p_type || '\":[]}'"))
part("F148_data_readstringarrayidx", out=(lambda: F.to_json(tables.nested(F.array_join(F.array("p_name", "p_type"), "\n"), "#.*", " ")), "'[[\"' || replace(p_name, ' ', '\",\"') || '\"],[\"' || p_type || '\"]]'"))
part("F35_getfields", out=(lambda: text_of(tables.fields(F.array_join(F.array("p_name", "p_type", "p_brand"), "\n"), "B.*#.*", "#")["fields"]), "replace(p_brand, '#', ',')"), n=(lambda: tables.fields(F.array_join(F.array("p_name", "p_type", "p_brand"), "\n"), ".*[RE].*", "#")["n"], "CAST(len(list_filter([p_name, p_type, p_brand], lambda x: regexp_matches(x, '[RE]'))) AS BIGINT)"))
part("F15_countlinesmatching", out=(lambda: tables.count_lines(F.array_join(F.array("p_name", "p_type", "p_brand"), "\n"), ".*r.*"), "CAST(len(list_filter([p_name, p_type, p_brand], lambda x: contains(x, 'r'))) AS BIGINT)"))
part("F96_readfile", out=(lambda: tables.first_bytes(c("p_name"), 7), "left(p_name, 7)"))
part("F95_readcsv", out=(lambda: F.to_json(F.from_csv(files.csv_line(F.concat("p_name", F.lit(',"x"')), c("p_type")), F.lit("a string, b string"), {"quote": '"', "escape": '"'})), "'{\"a\":\"' || p_name || ',\\\"x\\\"\",\"b\":\"' || p_type || '\"}'"))
part("S13_csv_writer", out=(lambda: files.csv_line(c("p_name"), F.concat("p_brand", F.lit("\n")), F.lit("")), "p_name || ',\"' || p_brand || chr(10) || '\",'"))
part("S14_json", compact=(lambda: F.to_json(F.from_json(F.concat(F.lit('{ "a" : "'), "p_name", F.lit('",\n "b" : [ 1, '), c("p_size").cast("string"), F.lit(" ] }")), "a string, b array<long>")), "'{\"a\":\"' || p_name || '\",\"b\":[1,' || p_size || ']}'"))
part("F99_readjson", out=(lambda: F.get_json_object(F.concat(F.lit('{"x":{"n":'), c("p_size").cast("string"), F.lit("}}")), "$.x.n").cast("long"), "CAST(p_size AS BIGINT)"))
_YAML = lambda: F.concat(F.lit("name: "), "p_name", F.lit("   # what it is\nsizes:\n  - "), c("p_size").cast("string"), F.lit("\n  - {brand: '"), "p_brand", F.lit("'}\n"))
_YAML_SQL = "'{\"name\":\"' || p_name || '\",\"sizes\":[' || p_size || ',{\"brand\":\"' || p_brand || '\"}]}'"
for _name in ("F89_parseyaml", "S15_yaml"):
    part(_name, out=(lambda: yaml.parsed(_YAML()), _YAML_SQL))
part("F105_readyaml", out=(lambda: F.get_json_object(yaml.parsed(_YAML()), "$.sizes[0]").cast("long"), "CAST(p_size AS BIGINT)"))

# --- choice, ranges, times ---

_DRAW = "(CAST(('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0)"
part("F94_randomint", out=(lambda: chance.random_int(25, 5, chance.draw(c("p_partkey"))), f"CAST(floor(5 + {_DRAW} * 20) AS BIGINT)"))
part("P4_dist", out=(lambda: chance.weighted({"a": 3, "b": 0, "c": 5, "d": 2}, chance.draw(c("p_partkey"))), f"CASE WHEN {_DRAW} * 10 < 3 THEN 'a' WHEN {_DRAW} * 10 < 8 THEN 'c' ELSE 'd' END"))
part("F120_shuffle", out=(lambda: text_of(chance.shuffled(c("l"), c("p_partkey"))), joined("list_transform(list_sort(list_transform(l, lambda x, i: md5(concat_ws(':', p_partkey, i - 1, x)) || x)), lambda y: y[33:])")))
_SLOT = f"CAST(floor({_DRAW} * 12) AS INT)"
part("F123_splayclass", out=(lambda: chance.splay_class(c("p_partkey")), f"printf('Min%02d_%02d', {_SLOT} * 5, ({_SLOT} * 5 + 5) % 60)"))
part("F117_rrange", out=(lambda: lists.in_range(c("p_retailprice"), lists.rrange(F.lit(1000), c("p_size") * 40.0)).cast("long"), "CAST(p_retailprice BETWEEN least(1000, p_size * 40.0) AND greatest(1000, p_size * 40.0) AS BIGINT)"))
part("F130_translatepath", posix=(lambda: text.translate_path(F.concat(F.lit("/a/"), "p_name")), "'/a/' || p_name"), other=(lambda: text.translate_path(F.concat(F.lit("a/"), "p_type"), "\\"), "'a\\' || p_type"))
part("F77_not", out=(lambda: (~lists.some(c("l"), "red")).cast("long"), "CAST(NOT list_contains(l, 'red') AS BIGINT)"))
part("F81_or", out=(lambda: ((c("p_size") > 40) | lists.some(c("l"), "ring") | (c("p_type") == "PROMO")).cast("long"), "CAST(p_size > 40 OR list_contains(l, 'ring') OR p_type = 'PROMO' AS BIGINT)"))
event("F3_ago", out=(lambda: times.ago(c("ts"), months=1, days=2, hours=3), "CAST(floor(epoch(ts - INTERVAL 1 MONTH - INTERVAL 2 DAY - INTERVAL 3 HOUR)) AS BIGINT)"))
part("E8_strings", n=(lambda: text.count_tokens(F.concat("p_name", F.lit(" "), "p_type"), "[ ]+"), "CAST(len(string_split(p_name || ' ' || p_type, ' ')) AS BIGINT)"), second=(lambda: text.token(c("p_name"), " ", 1), "string_split(p_name, ' ')[2]"), replaced=(lambda: F.replace("p_name", F.lit("in"), F.lit("IN")), "replace(p_name, 'in', 'IN')"))
part("E7_quoting", canon=(lambda: text.canonify(F.concat(F.lit(" a-b "), "p_brand")), "'_a_b_' || regexp_replace(p_brand, '#', '_')"), escaped=(lambda: text.escape(c("p_brand")), "p_brand"), trimmed=(lambda: F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))), "p_name"))


@query("F83_packageupdatesmatching", "SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, 'r.*') AND regexp_full_match(CAST(p_size AS VARCHAR), '1.') AND regexp_full_match(p_type, 'S.*')")
def _(t):
    known = t("part").select("p_partkey", "p_name", c("p_size").cast("string").alias("version"), c("p_type").alias("arch"))
    return known.where(text.full_match(c("p_name"), "r.*") & text.full_match(c("version"), "1.") & text.full_match(c("arch"), "S.*")).select("p_partkey", "p_name")


# --- lists and containers ---

part("O1_stable_sort", out=(lambda: text_of(lists.sort(F.array(F.concat(c("p_size").cast("string"), F.lit(" x")), F.lit("7"), c("p_size").cast("string")), "int")), "p_size || ' x,' || CASE WHEN p_size >= 7 THEN '7,' || p_size ELSE p_size || ',7' END"))
part("O2_lexical_sort", out=(lambda: text_of(lists.sort(c("l"))), joined("list_sort(l)")))
part("O5_mac_sort", out=(lambda: text_of(lists.sort(F.array(F.concat(F.lit("00:0a:"), F.lower(F.lpad(F.hex("p_size"), 2, "0"))), F.lit("00:0a:10"), F.lit("ff:00:00")), "MAC")), "CASE WHEN p_size <= 16 THEN '00:0a:' || printf('%02x', p_size) || ',00:0a:10' ELSE '00:0a:10,00:0a:' || printf('%02x', p_size) END || ',ff:00:00'"))
part("O12_sublist", head=(lambda: text_of(lists.sublist(c("l"), "head", 2)), joined("list_slice(l, 1, 2)")), tail=(lambda: text_of(lists.sublist(c("l"), "tail", 3)), joined("list_slice(l, len(l) - 2, len(l))")), nth=(lambda: lists.nth(c("l"), 1), "l[2]"))
part("O13_container_sort", out=(lambda: F.to_json(lists.sorted_by(F.array(F.struct(c("p_size").alias("n"), F.lit("a").alias("v")), F.struct(F.lit(20).alias("n"), F.lit("b").alias("v"))), "n")), "CASE WHEN p_size <= 20 THEN '[{\"n\":' || p_size || ',\"v\":\"a\"},{\"n\":20,\"v\":\"b\"}]' ELSE '[{\"n\":20,\"v\":\"b\"},{\"n\":' || p_size || ',\"v\":\"a\"}]' END"))
part("U7_containers", added=(lambda: text_of(lists.set_add(c("l"), F.lit("red"))), joined("CASE WHEN list_contains(l, 'red') THEN l ELSE list_append(l, 'red') END")), removed=(lambda: text_of(lists.set_remove(c("l"), F.lit("ring"))), joined("list_filter(l, lambda x: x <> 'ring')")), same=(lambda: lists.set_equal(c("l"), F.reverse("l")).cast("long"), "CAST(len(l) > 0 AS BIGINT)"), map_json=(lambda: F.to_json(lists.map_remove(F.create_map(F.lit("a"), "p_type", F.lit("b"), "p_brand"), F.lit("a"))), "'{\"b\":\"' || p_brand || '\"}'"))
part("A3_folds", total=(lambda: lists.total(F.array(c("p_size").cast("string"), F.lit("2"))), "CAST(p_size + 2 AS DOUBLE)"), mean=(lambda: F.round(lists.mean(F.array(c("p_size").cast("string"), F.lit("x"))), 6), "round(p_size / 2.0, 6)"), var=(lambda: F.round(lists.variance(F.array(c("p_size").cast("string"), F.lit("2"))), 6), "round((p_size - 2) * (p_size - 2) / 2.0, 6)"))

# --- relevance and search ---


def _cp(x, y):
    return f"len(list_filter(range(1, least(len({x}), len({y})) + 1), lambda k: left({x}, k) = left({y}, k)))"


def _tokens(x):
    return f"list_filter(regexp_split_to_array({x}, '[ ,]+'), lambda t: t <> '')"


def _pairs(x, y, score):
    return f"list_sum(flatten(list_transform({_tokens(x)}, lambda a: list_transform({_tokens(y)}, lambda b: {score}))))"


def _v1(x, y):
    """Overlap over the sum of lengths, in SQL."""
    s, n = _cp("a", "b"), f"CASE WHEN {_cp('a', 'b')} > 3 THEN greatest(len(a), len(b)) ELSE len(a) END"
    return f"CAST(coalesce(floor(100 * {_pairs(x, y, f'CASE WHEN {s} > 3 THEN {s} ELSE 0 END')} / nullif({_pairs(x, y, n)}, 0)), 0) AS BIGINT)"


def _v2(x, y):
    s = _cp("a", "b")
    return f"CAST(CASE WHEN len({y}) > 0 THEN floor(100 * coalesce({_pairs(x, y, f'CASE WHEN {s} > 3 THEN {s} ELSE 0 END')}, 0) / len({y})) ELSE 0 END AS BIGINT)"


_PHRASE = "CASE WHEN p_size > 25 THEN 'NOT for ' ELSE 'used for ' END || p_type"
part("G17_overlap", overlap=(lambda: lists.token_overlap(c("p_name"), F.lit("small ring of widgets")), _v1("p_name", "'small ring of widgets'")))
part("J9_token_pairs", overlap=(lambda: lists.token_overlap(c("p_name"), F.concat("p_type", F.lit(" widgets rings"))), _v1("p_name", "(p_type || ' widgets rings')")))
part("G18_prefix_overlap", overlap=(lambda: relevance.prefix_overlap(F.concat("p_name", F.lit(" widget")), F.lit("widgets, small")), _v2("(p_name || ' widget')", "'widgets, small'")))
part("G19_relevance", score=(lambda: relevance.relevance(c("p_name"), F.concat(F.when(c("p_size") > 25, "NOT for ").otherwise("used for "), "p_type"), F.lit("small widget"), F.lit("ring of red things"), F.when(c("p_size") % 2 == 0, "any").otherwise("ring widget")), f"CAST(CASE WHEN p_size > 25 THEN 0 ELSE CASE WHEN p_size % 2 = 0 THEN 80 ELSE 0 END + {_v1('p_name', "'small widget'")} + {_v1("(CASE WHEN p_size % 2 = 0 THEN 'any' ELSE 'ring widget' END)", "'small widget'")} + {_v1("(CASE WHEN p_size % 2 = 0 THEN 'any' ELSE 'ring widget' END)", "'ring of red things'")} END AS BIGINT)"))
part("G20_signed_relevance", score=(lambda: relevance.signed_relevance(F.array("p_name"), F.array(F.lit("ring")), F.lit("small widgets"), F.concat("p_name", F.lit(" ring"))), f"CAST(floor(({_v2('p_name', "'small widgets'")} + {_v2('p_name', "(p_name || ' ring')")} - {_v2("'ring'", "(p_name || ' ring')")}) / 2.0 + 0.5) AS BIGINT)"))
part("G21_but_not", pos=(lambda: relevance.split_context(F.concat("p_name", F.lit(" but not "), "p_type"))["positive"], "p_name"), neg=(lambda: relevance.split_context(F.when(c("p_size") > 9, F.concat("p_name", F.lit(" but not "), "p_type")).otherwise(c("p_name")))["negative"], "CASE WHEN p_size > 9 THEN p_type ELSE '' END"))
part("G22_state_of_mind", mind=(lambda: text_of(relevance.grown_context(F.array("p_name", "p_type"), F.lit("any ring"))), joined("list_filter(list_concat(['any', 'ring'], string_split(p_name, ' '), [p_type]), lambda x, i: i = list_position(list_concat(['any', 'ring'], string_split(p_name, ' '), [p_type]), x))")))
part("P9_relevant", out=(lambda: F.when(lists.token_overlap(c("p_name"), F.lit("small ring")) >= 0, F.when(F.concat(F.when(c("p_size") > 25, "NOT ").otherwise(""), "p_name").startswith("NOT"), 0).otherwise(1)).cast("long"), "CAST(CASE WHEN p_size > 25 THEN 0 ELSE 1 END AS BIGINT)"))


@query("G23_concepts_like", f"SELECT DISTINCT name FROM (SELECT src AS name FROM ({_TUPLES}) UNION SELECT dst FROM ({_TUPLES})) WHERE contains(name, 'A')")
def _(t):
    return relevance.concepts_like(graph.vertices(tuples(t)), "A").select("name")


_E = f"e AS (SELECT DISTINCT src, atype, dst FROM ({_EDGES}))"


@query("J3_reach", f"WITH RECURSIVE {_E}, r AS (SELECT 'ASIA' AS name, 0 AS level UNION SELECT e.dst, level + 1 FROM r JOIN e ON e.src = r.name WHERE level < 3) SELECT name, min(level) AS level FROM r GROUP BY 1")
def _(t):
    starts = t("region").where("r_name = 'ASIA'").select(c("r_name").alias("name"))
    return relevance.reached(graph.edges(tuples(t)), starts, 3).select("name", "level")


@query("G13_story_search", f"WITH RECURSIVE {_E}, r AS (SELECT 'ASIA' AS name, 0 AS level UNION SELECT e.dst, level + 1 FROM r JOIN e ON e.src = r.name AND abs(e.atype) = 3 WHERE level < 2), m AS (SELECT name, min(level) AS level FROM r GROUP BY 1) SELECT m.name, m.level, (SELECT min(e.src) FROM e JOIN m p ON p.name = e.src AND p.level = m.level - 1 WHERE e.dst = m.name AND abs(e.atype) = 3) AS parent FROM m")
def _(t):
    starts = t("region").where("r_name = 'ASIA'").select(c("r_name").alias("name"))
    return relevance.reached(graph.edges(tuples(t)), starts, 2, atype=graph.CONTAINS)


@query("G15_no_turning_back", f"WITH {_E} SELECT a.src, a.dst AS mid, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE b.atype <> -a.atype AND b.dst <> a.src AND b.dst <> a.dst AND a.src <> a.dst AND a.src = 'ASIA'")
def _(t):
    starts = t("region").where("r_name = 'ASIA'").select(c("r_name").alias("name"))
    return graph.stories(graph.edges(tuples(t)), starts, 2, most=None).where("hops = 2").select(c("path")[0].alias("src"), c("path")[1].alias("mid"), c("path")[2].alias("dst"))


@query("G16_expansion_order", f"SELECT DISTINCT src, atype, dst, CASE abs(atype) WHEN 2 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 END AS place FROM ({_EDGES})")
def _(t):
    return graph.edges(tuples(t)).select("src", "atype", "dst", relevance.expansion_place(c("atype")).alias("place")).where("place is not null").distinct()


@query("O8_edge_rank", f"SELECT src, dst, place FROM (SELECT src, dst, row_number() OVER (PARTITION BY src, atype ORDER BY n DESC, dst) AS place FROM ({_EDGES})) WHERE place <= 3")
def _(t):
    return relevance.by_relevance(graph.edges(tuples(t)), "n").where("place <= 3").select("src", "dst", "place")


@query("O7_story_rank", "SELECT p_name AS path, max(p_size) AS score FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(t):
    return relevance.ranked(t("part").groupBy(c("p_name").alias("path")).agg(F.max("p_size").alias("score"))).limit(20)


@query("J4_context_hubs", f"WITH h AS (SELECT DISTINCT e AS name, context FROM (SELECT src AS e, context FROM ({_TUPLES}) UNION ALL SELECT dst, context FROM ({_TUPLES})) WHERE e <> context AND context <> 'any') SELECT a.context, a.name AS src, b.name AS dst FROM h a JOIN h b ON a.context = b.context WHERE a.name <> b.name")
def _(t):
    return graph.through_contexts(tuples(t)).select("context", "src", "dst")


_VOCABULARY = ", ".join(f"({a}, '{f}', '{b}')" for a, f, b in relevance.VOCABULARY)


@query("G5_vocabulary", f"SELECT p_partkey, v.atype, v.bwd FROM part LEFT JOIN (VALUES {_VOCABULARY}) v(atype, fwd, bwd) ON v.fwd = CASE WHEN p_size > 25 THEN 'depends on' WHEN p_size > 12 THEN 'contains' ELSE 'sees' END")
def _(t):
    phrase = F.when(c("p_size") > 25, "depends on").when(c("p_size") > 12, "contains").otherwise("sees")
    return relevance.with_vocabulary(t("part").select("p_partkey", phrase.alias("fwd"))).select("p_partkey", "atype", "bwd")


@query("G4_aliases", f"SELECT src, dst, count(*) AS phrases, sum(n) AS sightings, max(weight) AS weight FROM ({_EDGES}) GROUP BY 1, 2")
def _(t):
    return graph.edges(tuples(t)).groupBy("src", "dst").agg(F.count("*").alias("phrases"), F.sum("n").alias("sightings"), F.max("weight").alias("weight"))


@query("A11_edge_weight", f"SELECT src, atype, dst, round(CASE WHEN n = 1 THEN 0.7 WHEN n = 2 THEN 0.88 ELSE 1 - 0.3 * pow(0.4, n - 1) END, 6) AS weight FROM ({_EDGES})")
def _(t):
    return graph.edges(tuples(t)).select("src", "atype", "dst", "weight")


# --- emitters ---

_LOW = "CAST(floor(minute(ts) / 5) * 5 AS INT)"
_HUB = f"'on ' || (['Night', 'Morning', 'Afternoon', 'Evening'])[CAST(floor(hour(ts) / 6) AS INT) + 1] || ' ' || dayname(ts) || ' Day' || day(ts) || ' ' || monthname(ts) || ' Yr' || year(ts) || ' at ' || printf('Hr%02d', hour(ts)) || ' ' || printf('Min%02d_%02d', {_LOW}, ({_LOW} + 5) % 60) || ' Q' || CAST(floor(minute(ts) / 15) + 1 AS INT)"
event("G8_time_hub", hub=(lambda: emitters.time_hub(c("ts")), _HUB), n=(lambda: F.size(emitters.time_tuples(c("ts"))).cast("long"), "CAST(event_id * 0 + 16 AS BIGINT)"))
_CAUSES = ", ".join(f"('{a}', '{b}')" for a, b in emitters.CAUSES)


@query("G12_axioms", f"SELECT a AS src, b AS dst FROM (VALUES {_CAUSES}) v(a, b)")
def _(t):
    return emitters.axioms(t("region").sparkSession).where("fwd = 'may be caused by'").select("src", "dst")


@query("G24_policy", "SELECT p_partkey, 'bundle default:' || p_type AS src, 'promise ' || p_name AS dst FROM part UNION ALL SELECT p_partkey, 'promise ' || p_name, p_brand FROM part")
def _(t):
    rows = t("part").select("p_partkey", F.explode(emitters.policy_tuples(F.lit("default"), c("p_type"), F.lit("files"), c("p_name"), c("p_brand"))).alias("x"))
    return rows.where("x.fwd = 'has constraint' OR x.src LIKE 'bundle%'").select("p_partkey", "x.src", "x.dst")


@query("G25_dependencies", "SELECT p_partkey, p_brand AS src, unnest(string_split(p_name, ' ')) AS dst FROM part")
def _(t):
    return t("part").select("p_partkey", F.explode(emitters.dependency_tuples(c("p_brand"), F.split("p_name", " "))).alias("x")).select("p_partkey", "x.src", "x.dst")


@query("J11_depends_on", "SELECT a.n_name AS promise, b.n_name AS needs FROM nation a JOIN nation b ON b.n_name = 'NATION_' || (a.n_nationkey + 1)")
def _(t):
    n = t("nation").select(c("n_name").alias("handle"), F.concat(F.lit("NATION_"), (c("n_nationkey") + 1).cast("string")).alias("depends_on"))
    return n.select(c("handle").alias("promise"), "depends_on").join(n.select(c("handle").alias("needs")), c("depends_on") == c("needs")).select("promise", "needs")


_POD = "replace(p_name, ' ', '-') || '-' || (p_size + 100) || 'f-x' || p_partkey"


@query("G26_pods", f"SELECT p_partkey, 'kubernetes deployment ' || replace(p_name, ' ', '-') AS src, 'kubernetes pod x' || p_partkey AS dst FROM part")
def _(t):
    pod = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), (c("p_size") + 100).cast("string"), F.lit("f-x"), c("p_partkey").cast("string"))
    rows = t("part").select("p_partkey", F.explode(emitters.pod_tuples(F.lit("web"), pod, F.lit("node1"), c("p_brand"))).alias("x"))
    return rows.where("x.fwd = 'depends on' AND x.src LIKE 'kubernetes deployment%'").select("p_partkey", "x.src", "x.dst")


# --- logs ---

part("L1_file_context", namespace=(lambda: logs.file_context(F.concat(F.lit("/var/log/"), F.when(c("p_size") > 25, "default-").otherwise("kube-system-"), "p_type", F.lit("-x.log")))["namespace"], "CASE WHEN p_size > 25 THEN 'default' ELSE 'kube-system' END"), pod=(lambda: logs.file_context(F.concat(F.lit("/var/log/"), F.when(c("p_size") > 25, "default-").otherwise("kube-system-"), "p_type", F.lit("-x.log")))["pod"], "p_type || '-x'"))


def _stamped():
    ts = c("ts")
    forms = [
        F.concat(F.lit("I"), F.date_format(ts, "MMdd HH:mm:ss"), F.lit(". started")),
        F.concat(F.lit("t="), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000 lvl=info")),
        F.concat(F.lit('time="'), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z" level=info')),
        F.concat(F.lit("x ["), F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000] GET")),
        F.concat(F.date_format(ts, "yyyy/MM/dd HH:mm:ss"), F.lit(". x")),
        F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(".123 x")),
        F.concat(F.lit("a t="), times.epoch(ts).cast("string"), F.lit(" b")),
    ]
    return F.element_at(F.array(*forms), (c("event_id") % 7 + 1).cast("int"))


event("L2_stamp_forms", s=(lambda: times.epoch(logs.line_time(_stamped(), F.year("ts"))), SECONDS))
event("L10_message_concept", concept=(lambda: logs.message_concept(c("event_type"), F.when(c("user_id") % 2 == 0, F.concat(F.lit("10.0.0."), c("user_id").cast("string"))).otherwise(""), F.lit(""), F.when(c("user_id") % 3 == 0, F.lit("/a/b")).otherwise("")), "CASE WHEN user_id % 2 = 0 OR user_id % 3 = 0 THEN 'message event `' || event_type || ''' concerning: ' || concat_ws(',', CASE WHEN user_id % 2 = 0 THEN '10.0.0.' || user_id END, CASE WHEN user_id % 3 = 0 THEN '/a/b' END) || ',' || event_type END"))


@query("L5_stitched", "SELECT event_id AS first, '{\"u\": ' || user_id || ', \"p\": {' || chr(10) || '\"k\": 1}' || chr(10) || '}' AS text FROM events")
def _(t):
    e = t("events")
    parts = F.array(F.concat(F.lit('INFO got {"u": '), c("user_id").cast("string"), F.lit(', "p": {')), F.lit('"k": 1}'), F.lit("}"), F.lit("done"))
    lines = e.select("event_id", F.posexplode(parts).alias("i", "line")).select("event_id", (c("event_id") * 4 + c("i")).alias("at"), "line")
    return logs.stitched(lines, ["event_id"], "at", "line").select((c("first") / 4).cast("long").alias("first"), "text")


@query("L9_anomaly_tuples", "SELECT user_id, count(*) AS members FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def _(t):
    names = t("events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("names"))
    rows = names.select("user_id", F.explode(logs.anomaly_event(c("names"), F.lit("now"), F.lit("ns"), F.lit("pod"))).alias("x"))
    return rows.where("x.src LIKE 'anomaly cluster%'").groupBy("user_id").agg(F.count("*").alias("members"))


_M = "m AS (SELECT event_type, avg(value) AS e, var_pop(value) AS v FROM events GROUP BY 1), g AS (SELECT *, " + SECONDS + " - lag(" + SECONDS + ") OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events)"


@query("L8_log_class", f"WITH {_M} SELECT event_id, CASE WHEN value > e + 3 * sqrt(v) THEN 'high_' || g.event_type WHEN value < e - 3 * sqrt(v) THEN 'low_' || g.event_type WHEN gap IS NULL OR gap > 86400 THEN 'rare_' || g.event_type END AS class FROM g JOIN m ON g.event_type = m.event_type")
def _(t):
    e = t("events")
    m = e.groupBy("event_type").agg(F.avg("value").alias("e"), F.var_pop("value").alias("v"))
    before = F.lag(seconds()).over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return e.withColumn("gap", seconds() - before).join(m, "event_type").select("event_id", anomaly.log_class(c("event_type"), c("value"), c("e"), c("v"), c("gap")).alias("class"))


@query("L12_coordinates", "SELECT CAST(p_partkey AS VARCHAR) AS doc, 4 AS leaves, 2 AS span, true AS closed FROM part")
def _(t):
    body = F.concat(F.lit("a {"), "p_brand", F.lit(" ["), "p_type", F.lit("]} z"))
    rows = nesting.segments(t("part").select("p_partkey", body.alias("text")), "p_partkey", "text")
    return rows.groupBy("doc").agg(F.count("*").alias("leaves"), (F.max(F.size("coords")) - F.min(F.size("coords"))).alias("span"), F.bool_and("closed").alias("closed"))


@query("W12_depth", "SELECT CAST(p_partkey AS VARCHAR) AS doc, unnest([p_type, 'x', p_brand]) AS item, unnest([1, 2, 0]) AS depth FROM part")
def _(t):
    body = F.concat(F.lit("("), "p_type", F.lit(" <t>x</t>)"), "p_brand")
    rows = nesting.segments(t("part").select("p_partkey", body.alias("text")), "p_partkey", "text")
    return rows.select("doc", F.array_join("vals", " ").alias("item"), F.size("delims").alias("depth"))


# --- anomalies and spans ---

_ES = "m AS (SELECT event_type, round(avg(value), 6) AS e, round(var_pop(value), 6) AS v FROM events GROUP BY 1)"


def _with_stats(t):
    e = t("events")
    return e.join(e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("e"), F.round(F.var_pop("value"), 6).alias("v")), "event_type")


@query("N1_reject", f"WITH {_ES}, x AS (SELECT event_id, x.event_type, CASE WHEN event_id % 50 = 0 THEN 5e6 WHEN event_id % 49 = 0 THEN 2e6 ELSE value END AS q, e, v, (CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0) AS d FROM events x JOIN m ON x.event_type = m.event_type) SELECT event_id, round(CASE WHEN e = 0 THEN q WHEN q > 4e6 THEN 0 WHEN q > 1e6 THEN e WHEN abs(q - e) < 6 THEN q WHEN abs(q - e) > 4 * sqrt(v / 100) AND d >= 0.7 THEN e + CASE WHEN q > e THEN 2 ELSE -2 END * sqrt(v / 100) ELSE q END, 4) AS learned FROM x")
def _(t):
    q = F.when(c("event_id") % 50 == 0, 5e6).when(c("event_id") % 49 == 0, 2e6).otherwise(c("value"))
    return _with_stats(t).select("event_id", F.round(anomaly.reject(q, c("e"), c("v") / 100, chance.draw(c("event_id"))), 4).alias("learned"))


@query("N3_published", f"WITH {_ES} SELECT event_id, printf('%.2f', value) AS value, printf('%.2f', e) AS average, printf('%.2f', sqrt(v)) AS deviation FROM events x JOIN m ON x.event_type = m.event_type WHERE event_id % 7 = 3")
def _(t):
    shown = anomaly.published(c("event_type"), c("value"), c("e"), F.sqrt("v"))
    rows = _with_stats(t).where("event_id % 7 = 3").select("event_id", "event_type", shown.alias("m"))
    get = lambda p: F.element_at("m", F.concat(F.lit(p), "event_type"))
    return rows.select("event_id", get("value_").alias("value"), get("av_").alias("average"), get("dev_").alias("deviation"))


@query("N4_spikes", "WITH s AS (SELECT event_id, event_type, value, sum(value) OVER w AS t, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) SELECT event_id, CASE WHEN n = 10 AND 11 * t >= 0.001 AND (t - 10 * value) * (t - 10 * value) / (11 * t) > 64 THEN 'spike_' || event_type || CASE WHEN value > 20 THEN '_high' ELSE '_low' END END AS class FROM s")
def _(t):
    e = statistics.leap_scores(t("events"), "user_id", ["ts", "event_id"], "value")
    return e.select("event_id", anomaly.spike(c("event_type"), c("chi"), 8.0, c("value"), F.lit(20.0)).alias("class"))


@query("N6_entropy_class", "SELECT event_id, CASE WHEN value / 50 < 0.2 THEN 'low' WHEN value / 50 > 0.9 THEN 'high' ELSE 'medium' END AS class FROM events")
def _(t):
    return t("events").select("event_id", anomaly.entropy_class(c("value") / 50).alias("class"))


@query("N7_syndromes", "WITH a AS (SELECT DISTINCT user_id, CASE WHEN event_type = 'click' THEN 'JOB_' ELSE '' END || event_type AS name, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 1 ELSE 2 END AS half FROM events), s AS (SELECT user_id, name, count(*) AS halves FROM a GROUP BY 1, 2) SELECT user_id, count(*) FILTER (halves = 1) AS dimension, count(*) FILTER (halves = 2) AS background, coalesce(bool_or(halves = 1 AND name LIKE 'JOB%'), false) AND coalesce(bool_or(halves = 1 AND name NOT LIKE 'JOB%'), false) AS hypothesis FROM s GROUP BY 1")
def _(t):
    name = F.concat(F.when(c("event_type") == "click", "JOB_").otherwise(""), "event_type")
    e = t("events").select("user_id", name.alias("name"), (c("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("first")).distinct()
    keyed = e.select(F.concat("name", F.lit("|"), c("user_id").cast("string")).alias("name"), "first")
    changes = anomaly.state_changes(keyed.where("first"), keyed.where("not first"))
    changes = changes.withColumn("user_id", F.element_at(F.split("name", r"\|"), 2).cast("long"))
    return anomaly.syndromes(changes, "user_id")


@query("A23_cluster_name", "WITH n AS (SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS l FROM events GROUP BY 1), k AS (SELECT user_id, list_filter(flatten(list_transform(range(1, 63), lambda i: list_transform(l, lambda m: substr(m, i, 1)))), lambda x: x <> '' AND x <> '_') AS k FROM n) SELECT user_id, left(array_to_string(list_filter(k, lambda x, i: i = 1 OR x <> k[i - 1]), ''), 63) AS name FROM k")
def _(t):
    return t("events").groupBy("user_id").agg(anomaly.cluster_name(F.array_sort(F.collect_set("event_type"))).alias("name"))


def _learner():
    keep = lambda x: f"greatest({x}, 0)"
    return f"""WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), f AS (
        SELECT user_id, rn, {keep('0.5 * value')} AS av, {keep('0.25 * value')} AS var, '' AS class FROM s WHERE rn = 1
        UNION ALL SELECT s.user_id, s.rn, {keep('0.5 * s.value + 0.5 * f.av')}, {keep('0.5 * (s.value - f.av) * (s.value - f.av) + 0.5 * (CASE WHEN f.var = 0 THEN 0.5 ELSE f.var END)')}, CASE WHEN s.value > f.av + 3 * greatest(sqrt(CASE WHEN f.var = 0 THEN 0.5 ELSE f.var END), 0.1) THEN 'high_anomaly' WHEN s.value < f.av - 3 * greatest(sqrt(CASE WHEN f.var = 0 THEN 0.5 ELSE f.var END), 0.1) THEN 'low_anomaly' ELSE '' END
        FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1), m AS (SELECT user_id, max(rn) AS n FROM s GROUP BY 1)
        SELECT f.user_id, round(av, 4) AS av, round(var, 3) AS var, class FROM f JOIN m ON f.user_id = m.user_id AND f.rn = m.n"""


@query("A10_learner", _learner())
def _(t):
    rows = statistics.recent(t("events"), ["user_id"], ["ts", "event_id"], "value", statistics.horizon(0.5, 2)).withColumn("s", anomaly.learned_fold(c("q")))
    return rows.select("user_id", F.round("s.av", 4).alias("av"), F.round("s.var", 3).alias("var"), "s.class")


@query("W1_difference", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS dq FROM events")
def _(t):
    return statistics.differences(t("events"), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("dq", 6).alias("dq"))


@query("W5_clock_jumps", f"WITH g AS (SELECT event_id, {SECONDS} + CASE WHEN event_id % 11 = 0 THEN -9000000 ELSE 0 END AS s, user_id FROM events), l AS (SELECT event_id, s, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM g) SELECT event_id, CASE WHEN s < p THEN 'clock_jumped_backwards_event' ELSE 'clock_jumped_forwards_event' END AS jump FROM l WHERE s < p OR s > p + 86400")
def _(t):
    s = seconds() + F.when(c("event_id") % 11 == 0, -9000000).otherwise(0)
    e = t("events").select("event_id", "user_id", s.alias("s")).withColumn("p", F.lag("s").over(W.partitionBy("user_id").orderBy("event_id")))
    return e.select("event_id", anomaly.clock_jump(c("s"), c("p"), 43200).alias("jump")).where("jump is not null")


@query("J8_previous_state", "WITH d AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n, lag(n) OVER (PARTITION BY user_id ORDER BY day) AS before FROM d")
def _(t):
    d = t("events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return d.withColumn("before", F.lag("n").over(W.partitionBy("user_id").orderBy("day")))


@query("W11_line_groups", "SELECT user_id, event_id, first_value(event_id) OVER (PARTITION BY user_id, (rn - 1) // 3 ORDER BY rn) AS leader FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)")
def _(t):
    e = t("events").select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("rn"))
    return e.select("user_id", "event_id", F.first("event_id").over(W.partitionBy("user_id", F.floor((c("rn") - 1) / 3)).orderBy("rn")).alias("leader"))


def _ranked(extra=""):
    return f"s AS (SELECT user_id, event_type, {SECONDS} AS s, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {SECONDS}) AS rn FROM events)"


def _span_rows(t):
    return t("events").select("user_id", "event_type", seconds().alias("s"))


@query("T6_last_seen", f"WITH RECURSIVE {_ranked()}, f AS (SELECT user_id, event_type, s, rn, CAST(0 AS DOUBLE) AS a FROM s WHERE rn = 1 UNION ALL SELECT s.user_id, s.event_type, s.s, s.rn, 0.4 * (s.s - f.s) + 0.6 * f.a FROM f JOIN s ON s.user_id = f.user_id AND s.event_type = f.event_type AND s.rn = f.rn + 1), m AS (SELECT user_id, event_type, max(rn) AS n FROM s GROUP BY 1, 2) SELECT f.user_id, f.event_type, f.s AS last, m.n, round(a, 3) AS average FROM f JOIN m ON f.user_id = m.user_id AND f.event_type = m.event_type AND f.rn = m.n")
def _(t):
    return statistics.last_seen(_span_rows(t), "event_type", "user_id", "s").withColumn("average", F.round("average", 3))


@query("T8_rates", f"WITH s AS (SELECT event_id, user_id, {SECONDS} AS s, event_id * 37 % 5003 AS v FROM events), l AS (SELECT *, lag(v) OVER w AS pv, lag(s) OVER w AS ps FROM s WINDOW w AS (PARTITION BY user_id ORDER BY s, v)) SELECT event_id, round(CASE WHEN ps IS NULL OR s = ps THEN -1 WHEN v < pv THEN (4294967295 - pv + v) / (s - ps) ELSE (v - pv) / (s - ps) END, 1) AS rate FROM l")
def _(t):
    e = t("events").select("event_id", "user_id", seconds().alias("s"), (c("event_id") * 37 % 5003).alias("v"))
    return statistics.rates(e, "user_id", "s", "v", wrap=4294967295).select("event_id", F.round("rate", 1).alias("rate"))


@query("T9_rate_limit", f"WITH RECURSIVE {_ranked()}, f AS (SELECT user_id, event_type, s, rn, s AS last, true AS taken FROM s WHERE rn = 1 UNION ALL SELECT s.user_id, s.event_type, s.s, s.rn, CASE WHEN (s.s - f.last) // 60 >= 600 THEN s.s ELSE f.last END, (s.s - f.last) // 60 >= 600 FROM f JOIN s ON s.user_id = f.user_id AND s.event_type = f.event_type AND s.rn = f.rn + 1) SELECT user_id, event_type, s FROM f WHERE taken")
def _(t):
    return statistics.admitted(_span_rows(t), ["user_id", "event_type"], "s", 600)


@query("N8_persistent_classes", f"WITH e AS (SELECT user_id, event_type, {SECONDS} AS s FROM events), g AS (SELECT *, CASE WHEN lag(s) OVER w IS NULL OR s >= lag(s) OVER w + 86400 THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY s)), k AS (SELECT *, sum(n) OVER (PARTITION BY user_id, event_type ORDER BY s RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, event_type, min(s) AS begin, max(s) + 86400 AS until FROM k GROUP BY user_id, event_type, k")
def _(t):
    return statistics.persistent(_span_rows(t), ["user_id", "event_type"], "s", 86400)


@query("T2_periodic_slots", f"SELECT CAST(floor((({SECONDS} - 345600) % 604800) / 300) AS BIGINT) AS slot, count(*) AS n, count(DISTINCT {SECONDS} // 604800) AS weeks FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy(times.slot(c("ts")).alias("slot")).agg(F.count("*").alias("n"), F.countDistinct(F.floor(seconds() / 604800)).alias("weeks"))


# --- captured files, catalogues, protocol ---

part("X2_protocol", kind=(lambda: modules.parse_line(F.concat(F.element_at(F.array(*map(F.lit, "+-=@%^x")), (c("p_size") % 7 + 1).cast("int")), "p_type", F.lit("="), "p_name"))["kind"], "(['class', 'cancel', 'variable', 'list', 'data', 'context', NULL])[p_size % 7 + 1]"), value=(lambda: modules.parse_line(F.concat(F.lit("="), "p_type", F.lit("="), "p_name"))["value"], "p_name"), items=(lambda: text_of(modules.list_items(F.concat(F.lit('{ "'), "p_name", F.lit("\", '"), "p_type", F.lit("' }")))), "p_name || ',' || p_type"))
part("S20_probes", load=(lambda: modules.load_average(F.concat(c("p_size").cast("string"), F.lit(".25 0.1 0.2 1/2 3"))), "p_size + 0.25"), memory=(lambda: modules.memory(F.concat(F.lit("MemTotal:   9 kB\nMemFree:    "), c("p_partkey").cast("string"), F.lit(" kB\n")), "MemFree"), "CAST(p_partkey AS BIGINT)"), cpu=(lambda: F.round(modules.cpu_busy(F.concat(F.lit("cpu  "), c("p_size").cast("string"), F.lit(" 2 3 50 1\ncpu0 1 1 1 1"))), 6), "round(1 - 50 / (p_size + 56.0), 6)"), reads=(lambda: modules.disk_traffic(F.concat(F.lit("   8  0 sda "), c("p_size").cast("string"), F.lit(" 1 2 3 44 5\n")), "sda")["reads"], "CAST(p_size AS BIGINT)"))
part("S21_graph_lines", q=(lambda: listings.graph_lines(c("p_partkey"), c("p_retailprice"), c("p_size"), c("p_size") * c("p_size"))["q"], "p_partkey || ' ' || printf('%.4f', p_retailprice)"), sigma=(lambda: listings.graph_lines(c("p_partkey"), c("p_retailprice"), c("p_size"), c("p_size") * c("p_size"))["E-sigma"], "p_partkey || ' ' || printf('%.4f', CAST(p_size AS DOUBLE)) || ' ' || printf('%.4f', CAST(p_size AS DOUBLE))"))
event("S22_history_line", line=(lambda: listings.history_line(c("ts"), c("value")), f"strftime(ts, '%a %b %-d %H:%M:%S %Y') || ',' || {SECONDS} || ',' || printf('%.4f', value)"))


@query("S23_pod_listing", "SELECT p_partkey, replace(p_name, ' ', '-') AS name, '1/1' AS ready, p_type AS status FROM part")
def _(t):
    lines = t("part").select("p_partkey", F.explode(F.array(F.lit("NAME      READY   STATUS"), F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("   1/1     "), "p_type"))).alias("value"))
    return listings.listed(lines, ["name", "ready", "status"], keep=("p_partkey",)).select("p_partkey", "name", "ready", "status")


@query("W9_sections", "SELECT p_partkey, unnest(['Containers', 'Containers', 'Volumes', '']) AS section, unnest(['Image', 'Port', 'Type', 'Node']) AS name, unnest([p_brand, CAST(p_size AS VARCHAR), p_type, p_name]) AS value FROM part")
def _(t):
    lines = F.array(F.lit("Containers:"), F.concat(F.lit("  Image:   "), "p_brand"), F.concat(F.lit("  Port: "), c("p_size").cast("string")), F.lit("Volumes:"), F.concat(F.lit("  Type:  "), "p_type"), F.concat(F.lit("Node:   "), "p_name"))
    rows = t("part").select("p_partkey", F.posexplode(lines).alias("at", "value"))
    return listings.sections(rows, ["p_partkey"], "at").select("p_partkey", "section", "name", "value")


@query("S19_sockets", "SELECT 'www' AS service, 'in' AS direction, count(*) FILTER (p_size % 2 = 0) AS n FROM part UNION ALL SELECT 'ssh', 'out', count(*) FILTER (p_size % 2 = 1) FROM part")
def _(t):
    line = F.concat(F.lit("tcp 0 0 10.0.0.1:"), F.when(c("p_size") % 2 == 0, "80").otherwise("5000"), F.lit(" 10.0.0.2:"), F.when(c("p_size") % 2 == 0, "6000").otherwise("22"), F.lit(" ESTABLISHED"))
    return captures.socket_counts(t("part").select(line.alias("value")), {80: "www", 22: "ssh"})


@query("S11_columns", "SELECT CAST(row_number() OVER (ORDER BY ordinal_position) - 1 AS BIGINT) AS place, column_name AS name FROM information_schema.columns WHERE table_name = 'part'")
def _(t):
    return catalogue.columns(t("part")).select("place", "name")


@query("D3_definitions", "SELECT column_name AS name, CASE column_name WHEN 'p_size' THEN 'same' WHEN 'p_name' THEN 'differs' ELSE 'extra' END AS state FROM information_schema.columns WHERE table_name = 'part' UNION ALL SELECT 'p_weight', 'missing'")
def _(t):
    return catalogue.compared(t("part"), ["p_size,int", "p_name,int,20", "p_weight,real"])


@query("D1_converged", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, CAST(NULL AS DOUBLE) AS p_weight FROM part")
def _(t):
    return catalogue.converged(t("part"), ["p_size,text", "p_weight,real"]).select("p_partkey", "p_size", "p_weight")


@query("R8_handles", "SELECT DISTINCT p_type || ':' || p_brand AS handle FROM part")
def _(t):
    return t("part").select(F.concat("p_type", F.lit(":"), "p_brand").alias("handle")).distinct()


@query("E6_xml", "SELECT p_partkey, '<p a=\"' || p_type || '\"><n>' || p_name || '</n><s>' || p_size || '</s></p>' AS out FROM part")
def _(t):
    doc = F.concat(F.lit('<p a="'), "p_type", F.lit('"><n>'), "p_name", F.lit("</n><x>"), "p_brand", F.lit("</x></p>"))
    with_size = F.concat(F.regexp_replace(xml.edited(doc, "delete", ".//x"), "</p>$", ""), F.lit("<s>"), c("p_size").cast("string"), F.lit("</s></p>"))
    return t("part").select("p_partkey", xml.edited(with_size, "delete", ".//none").alias("out"))


@query("S16_xml_read", "SELECT p_partkey, p_name AS name, p_type || ',' || p_brand AS tags FROM part")
def _(t):
    doc = F.concat(F.lit("<p><n>"), "p_name", F.lit("</n><t>"), "p_type", F.lit("</t><t>"), "p_brand", F.lit("</t></p>"))
    return t("part").select("p_partkey", F.get(xml.texts(doc, "/p/n"), 0).alias("name"), text_of(xml.texts(doc, "/p/t")).alias("tags"))


part("F135_string_split", n=(lambda: F.size(text.string_split(F.concat("p_name", F.lit(" "), "p_type"), " ", 2)).cast("long"), "least(len(string_split(p_name || ' ' || p_type, ' ')), 2)"), rest=(lambda: F.get(text.string_split(F.concat("p_name", F.lit(" "), "p_type"), " ", 2), 1), "substr(p_name || ' ' || p_type, strpos(p_name, ' ') + 1)"))
part("F37_getindices", out=(lambda: text_of(F.map_keys(F.create_map("p_type", F.lit(1), "p_brand", F.lit(2)))), "p_type || ',' || p_brand"))


# --- growing files, measurements, bundles, addresses, files ---

_GROWN = lambda: F.concat("p_name", F.lit("\n"), "p_brand", F.lit("\n"), F.left("p_type", F.lit(3)))
_AT = "CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN length(p_name) + 1 ELSE 999 END"
_OFFSET = lambda: F.when(c("p_size") % 3 == 0, 0).when(c("p_size") % 3 == 1, F.octet_length("p_name") + 1).otherwise(999)
part("S17_measurement_lines", lines=(lambda: F.array_join(tables.new_lines(_GROWN(), _OFFSET())["lines"], "|"), "CASE WHEN p_size % 3 = 1 THEN p_brand ELSE p_name || '|' || p_brand END"), reset=(lambda: tables.new_lines(_GROWN(), _OFFSET())["reset"].cast("long"), "CAST(p_size % 3 = 2 AS BIGINT)"))
part("T7_tail", at=(lambda: tables.new_lines(_GROWN(), _OFFSET())["offset"], "CAST(length(p_name) + length(p_brand) + 2 AS BIGINT)"), again=(lambda: F.size(tables.new_lines(_GROWN(), tables.new_lines(_GROWN(), _OFFSET())["offset"])["lines"]).cast("long"), "CAST(p_size * 0 AS BIGINT)"))


@query("X4_measurements", "SELECT p_type, sum(CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS DOUBLE)) FILTER (p_brand LIKE '%1%') AS ones, max(CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS DOUBLE)) AS largest, arg_max(CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS DOUBLE), p_partkey) AS last FROM part GROUP BY 1")
def _(t):
    wanted = [promises.Measurement("ones", "1", r"#(\d+)"), promises.Measurement("largest", "#", r"#(\d+)", "max"), promises.Measurement("last", "#", r"#(\d+)", "last", "p_partkey")]
    return promises.measured(t("part"), "p_brand", wanted, "p_type")


@query("X3_bundle", "SELECT p_partkey, p_size * 3 AS size FROM part WHERE p_size > 20 AND p_type = 'PROMO'")
def _(t):
    def larger(table, least):
        return table.where(c("p_size") > least)

    def of_kind(table, kind):
        return table.where(c("p_type") == kind)

    def scaled(table, factor=2):
        return table.select("p_partkey", (c("p_size") * factor).alias("size"))

    return promises.bundle(larger, of_kind, scaled)(t("part"), least=20, kind="PROMO", factor=3)


@query("R7_dispatch", "SELECT p_partkey, 'default:' || p_type AS namespacepath, p_brand AS handle FROM part WHERE regexp_matches('default:' || p_type || ':' || p_brand, 'Brand#2')")
def _(t):
    known = t("part").select(F.concat(F.lit("default:"), "p_type", F.lit(":"), "p_brand").alias("handle"), c("p_partkey").alias("q"), F.lit(1.0).alias("expect"), F.lit(0.0).alias("var"))
    return reports.dispatch("/report/agent/Brand%232", {"compliance": known}).select(c("q").alias("p_partkey"), "namespacepath", "handle")


@query("P6_file_select", "SELECT p_partkey FROM part WHERE (p_name LIKE '%ring' OR p_size > 40) AND NOT p_retailprice > 950")
def _(t):
    tests = {"leaf_name": c("p_name").endswith("ring"), "size": c("p_size") > 40, "mtime": c("p_retailprice") > 950}
    return tables.file_select(t("part"), "(leaf_name|size).!mtime", tests).select("p_partkey")


# The tables that a folder of them has.
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES["F31_findfiles"] = lambda spark, sf_dir: tables.find_files(spark, f"{sf_dir}/*.parquet").select("name")
SQL["F31_findfiles"] = f"SELECT name FROM (VALUES {', '.join(f'(\'{x}.parquet\')' for x in _TABLES)}) v(name)"
QUERIES["F71_lsdir"] = lambda spark, sf_dir: tables.list_files(spark, sf_dir, r"[n-s].*\.parquet").select("name")
SQL["F71_lsdir"] = f"SELECT name FROM (VALUES {', '.join(f'(\'{x}.parquet\')' for x in _TABLES)}) v(name) WHERE regexp_full_match(name, '[n-s].*\\.parquet')"
