"""Queries of the remaining text forms, arrays and numbers over documents, pages, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import forms as X
from ..functions import markup
from ..functions import numbers as N
from ..functions import phrases as P
from ..functions import text as T
from .queries import query

#: A small table of simplified and traditional forms; a whole table is a parameter.
SCRIPT = {"门": "門", "国": "國", "学": "學", "语": "語", "东": "東"}
HAN_NAMES = "translate(p_name, 'abegl', '门国学语东')"


@query("str_f09_full_marks", r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(n, '([一-鿿]),', '\1，', 'g'), '([一-鿿])!', '\1！', 'g'), '([一-鿿])\.$', '\1。', 'g') AS name FROM (SELECT p_partkey, translate(p_name, 'abegl', '门国学语东') || ',x' || CASE p_partkey % 3 WHEN 0 THEN '国,' WHEN 1 THEN '学!' ELSE '语.' END AS n FROM part)")
def _(t):
    tail = F.when(F.col("p_partkey") % 3 == 0, "国,").when(F.col("p_partkey") % 3 == 1, "学!").otherwise("语.")
    return t("part").select("p_partkey", X.full_marks(F.concat(F.translate("p_name", "abegl", "门国学语东"), F.lit(",x"), tail)).alias("name"))


@query("str_f10_clean_title", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN '\"' || p_name || '\" \"' || p_type || '\"' ELSE p_name END AS title FROM part")
def _(t):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit(' "'), "p_name", F.lit('" '))).when(k == 1, F.concat(F.lit('"'), "p_name", F.lit('" "'), "p_type", F.lit('"'))).otherwise(F.concat("p_name", F.lit("，, 。")))
    return t("part").select("p_partkey", X.clean_title(raw).alias("title"))


@query("str_f13_marked", rf'''SELECT p_partkey, regexp_replace({HAN_NAMES}, '([一-鿿]+)', '<span lang="zh">\1</span>', 'g') AS name FROM part''')
def _(t):
    return t("part").select("p_partkey", X.mark_han(F.translate("p_name", "abegl", "门国学语东")).alias("name"))


@query("str_f14_converted", "SELECT p_partkey, translate(p_name, 'abegl', '門國學語東') AS name FROM part")
def _(t):
    return t("part").select("p_partkey", X.converted(F.translate("p_name", "abegl", "门国学语东"), SCRIPT).alias("name"))


@query("str_f14_phrases", "SELECT doc_id, replace(replace(replace(replace(text, 'the', '[1]'), 'th', '[2]'), 'er', '[3]'), 'e', '[4]') AS text FROM documents")
def _(t):
    # Of the phrases that begin at a place the longest is taken: `the` before `th`, `er` before `e`.
    return t("documents").select("doc_id", P.converted(F.col("text"), {"e": "[4]", "th": "[2]", "er": "[3]", "the": "[1]"}).alias("text"))


@query("snk_04_two_scripts", "WITH n AS (SELECT p_partkey, translate(p_name, 'abegl', '门国学语东') AS n, lower(p_type) AS y FROM part), o AS (SELECT *, translate(array_to_string(regexp_extract_all(n, '[一-鿿]+'), ' '), '门国学语东', '門國學語東') AS other FROM n) SELECT p_partkey, substr(n || ' ' || y, 1, 12) || CASE WHEN other <> '' THEN ' ' || other ELSE '' END AS hay FROM o")
def _(t):
    name = F.translate("p_name", "abegl", "门国学语东")
    return t("part").select("p_partkey", P.search_row([name], [F.col("p_type")], SCRIPT, longest=12).alias("hay"))


@query("str_f15_both_scripts", f"SELECT p_partkey, n || ' ' || array_to_string(list_transform(regexp_extract_all(n, '[一-鿿]+'), lambda x: translate(x, '门国学语东', '門國學語東')), ' ') AS name FROM (SELECT p_partkey, {HAN_NAMES} AS n FROM part) WHERE regexp_matches(n, '[一-鿿]')")
def _(t):
    n = F.translate("p_name", "abegl", "门国学语东")
    return t("part").select("p_partkey", n.alias("n")).where(F.col("n").rlike("[一-鿿]")).select("p_partkey", X.both_scripts(F.col("n"), SCRIPT).alias("name"))


@query("str_f18_retarget", r"SELECT page_id, CASE WHEN regexp_matches(path, '^/(en|tw)/') THEN regexp_replace(path, '^/(en|tw)/', '/xx/') WHEN starts_with(path, '/api/') THEN path ELSE '/xx' || path END AS path FROM (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS path FROM pages)")
def _(t):
    return t("pages").select("page_id", X.retargeted(F.regexp_replace("url", "^https?://[^/]*", ""), "xx", trees=("en", "tw"), kept=("/api/",)).alias("path"))


@query("str_f19_alternates", "SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN 'https://' || substr(url, 8) ELSE 'http://' || substr(url, 9) END AS other, regexp_extract(url, '^(https?://[^/]+)', 1) || '/' || 'page-' || page_id AS guess FROM pages")
def _(t):
    alt = F.when(F.startswith("url", F.lit("http://")), F.concat(F.lit("https://"), F.substring("url", 8, 10_000))).otherwise(F.concat(F.lit("http://"), F.substring("url", 9, 10_000)))
    root = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    return t("pages").select("page_id", alt.alias("other"), F.concat(root, F.lit("/"), T.slug(F.concat(F.lit("Page "), F.col("page_id")))).alias("guess"))


@query("str_f20_host", "SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM pages")
def _(t):
    return t("pages").select("page_id", T.url_host(F.col("url")).alias("host"))


@query("str_f25_english_source", "SELECT l_orderkey, sum(CASE WHEN l_partkey % 5 = 0 THEN 2 ELSE 0 END) < 5 AS english FROM lineitem GROUP BY 1")
def _(t):
    quote = F.when(F.col("l_partkey") % 5 == 0, F.lit("国x语")).otherwise(F.lit("plain"))
    quotes = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(quote).alias("quotes"))
    return quotes.select("l_orderkey", X.english_source(F.col("quotes")).alias("english"))


@query("str_f27_runs")
def _(t):
    rows = t("pages").select("page_id", F.posexplode(markup.visible_runs(F.col("html"), skip=(*markup.UNREAD, "nav"), spoken="de")).alias("pos", "r"))
    return rows.select("page_id", "pos", "r.where", "r.text")


@query("str_f27_visible", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(head|nav|footer)\b.*?</(head|nav|footer)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n\f\v]+', ' ', 'g')) AS text FROM pages")
def _(t):
    return t("pages").select("page_id", X.visible(F.col("html"), skip=("head", "nav", "footer")).alias("text"))


@query("str_f29_cause", "SELECT event_id, 'failed ' || event_type AS cause FROM events")
def _(t):
    return t("events").select("event_id", X.cause(F.concat(F.lit(" failed "), "event_type", F.lit("（"), F.col("value").cast("string"), F.lit("）"))).alias("cause"))


@query("str_f31_magnitudes", r"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'sold ' || n || ' million (' || CAST(n * 100 AS VARCHAR) || '万)' ELSE 'sold ' || n || ' billion (' || CAST(n * 10 AS VARCHAR) || '亿)' END AS text FROM (SELECT o_orderkey, o_custkey % 90 + 1 AS n FROM orders)")
def _(t):
    scale = F.when(F.col("o_orderkey") % 2 == 0, "million").otherwise("billion")
    return t("orders").select("o_orderkey", X.magnitudes(F.concat(F.lit("sold "), F.col("o_custkey") % 90 + 1, F.lit(" "), scale)).alias("text"))


@query("str_f32_brief", "SELECT l_orderkey, '# ' || l_orderkey || chr(10) || string_agg('- [' || l_linenumber || '] ' || l_returnflag || ' ' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity) AS brief FROM lineitem GROUP BY 1")
def _(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_quantity"))).alias("p"))
    line = F.transform("p", lambda x: F.concat(F.lit("- ["), x["l_linenumber"], F.lit("] "), x["l_returnflag"], F.lit(" "), x["l_partkey"]))
    return rows.select("l_orderkey", F.concat(F.lit("# "), "l_orderkey", F.lit("\n"), F.array_join(line, "\n")).alias("brief"))


@query("num_02_renderings", r"SELECT p_partkey, list_contains(f, CAST(n AS VARCHAR)) AS digits, true AS comma, n >= 100 AS scaled FROM (SELECT p_partkey, p_partkey + 1 AS n, [CAST(p_partkey + 1 AS VARCHAR)] AS f FROM part)")
def _(t):
    n = F.col("p_partkey") + 1
    f = N.rendered(n.cast("double"))
    return t("part").select("p_partkey", F.array_contains(f, n.cast("string")).alias("digits"), F.array_contains(f, F.format_number(n, 0)).alias("comma"), F.exists(f, lambda x: F.endswith(x, F.lit(" thousand"))).alias("scaled"))


@query("arr_01_normalised", "SELECT l_orderkey, string_agg(l_linenumber * 10 || ':' || l_returnflag, '|' ORDER BY l_linenumber, l_partkey, l_quantity) AS points, CAST(least(6, count(DISTINCT l_partkey)) AS INTEGER) AS tags FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY 1")
def _(t):
    # Points come as JSON with rows that are no objects, rows without anything and times as clocks.
    k = F.col("l_linenumber") % 3
    row = F.when(k == 0, F.element_at(F.array(F.lit("7"), F.lit('{"t": "", "h": " "}'), F.lit("null")), (F.col("l_linenumber") / 3).cast("int") % 3 + 1)).otherwise(F.concat(F.lit('{"t": "0:'), F.lpad((F.col("l_linenumber") * 10 % 60).cast("string"), 2, "0"), F.lit('", "h": " '), "l_returnflag", F.lit('  "}')))
    row = F.when((k != 0) & (F.col("l_linenumber") >= 6), F.regexp_replace(row, '"0:', '"1:')).otherwise(row)
    body = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", row.alias("j")))).alias("r"), F.array_sort(F.collect_set(F.when(k != 0, F.col("l_partkey").cast("string")))).alias("tags"))
    rows = body.select("l_orderkey", X.normal_rows(F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["j"]), ","), F.lit("]")), ("t", "h")).alias("p"), F.size(F.slice("tags", 1, 6)).alias("tags"))
    line = F.transform("p", lambda x: F.concat_ws(":", X.parse_time(x["t"]).cast("string"), x["h"]))
    return rows.where(F.size("p") > 0).select("l_orderkey", F.array_join(line, "|").alias("points"), "tags")


@query("arr_02_leaves", "SELECT event_type AS a, CAST(user_id % 3 AS VARCHAR) AS b, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    # Nested maps of counts, flattened to leaves and built up again on the way.
    flat = t("events").groupBy("event_type", (F.col("user_id") % 3).cast("string").alias("b")).agg(F.count("*").alias("n"))
    nest = flat.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    return nest.select(F.col("event_type").alias("a"), F.explode("m").alias("b", "n"))


@query("arr_04_unwrapped", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def _(t):
    inner = F.col("props")
    envelope = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(inner.alias("result")))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"response": {"text": '), F.to_json(F.struct(inner.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(inner.alias("x")))) - 6), F.lit("}}"))).otherwise(inner)
    return t("events").select("event_id", F.get_json_object(X.unwrapped(envelope), "$.k").cast("long").alias("k"))


@query("arr_05_chapters", "WITH c AS (SELECT conv_id, CAST(turn * 61 AS INTEGER) AS t, min(substr(role, 1, 120)) AS label FROM conversations WHERE turn * 61 <= 200 + 60 GROUP BY 1, 2), n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM c) SELECT conv_id, t, label FROM n WHERE n >= 3")
def _(t):
    line = F.format_string("%02d:%02d %s", F.floor(F.col("turn") * 61 / 60), F.col("turn") * 61 % 60, "role")
    notes = t("conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(line), lambda a, b: F.when(a > b, -1).otherwise(1)), "\n").alias("notes"))
    return X.chapters(notes.withColumn("secs", F.lit(200)), "conv_id", "notes", "secs")


@query("arr_06_shapes", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'heartbeat' WHEN 1 THEN 'note' WHEN 2 THEN 'map' ELSE 'other' END AS shape FROM events")
def _(t):
    body = F.element_at(F.array(F.lit('{"at": "x", "line": "local", "exit": 0}'), F.lit('{"note": "n", "at": "x"}'), F.lit('{"a": 1, "b": 2}'), F.lit('[1]')), (F.col("event_id") % 4 + 1).cast("int"))
    return t("events").select("event_id", X.shape_of(body).alias("shape"))
