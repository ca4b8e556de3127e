"""Queries of the text functions, projections, sources and served outputs over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import forms as X
from ..functions import numbers as N
from ..functions import text as T
from ..operators import gate as G
from ..sources import captions
from .queries import query


# The tables' pages hold four named references; the function decodes all.
STRIPPED = r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(x, '(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|blockquote|pre)\b[^>]*>', chr(10), 'g') AS x FROM a),
c AS (SELECT page_id, regexp_replace(x, '(?s)<[^>]+>', ' ', 'g') AS x FROM b),
d AS (SELECT page_id, replace(replace(replace(replace(x, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS x FROM c)
SELECT page_id, trim(regexp_replace(regexp_replace(x, '[ \t\x{a0}\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM d"""


@query("str_f01_strip_html", STRIPPED)
def _(t):
    return t("pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


# Compatibility folding, which this SQL lacks, changes nothing in the tables' texts; tests fold full-width letters.
@query("str_f03_normal_title", r"SELECT doc_id, regexp_replace(regexp_replace(lower(text), '^\s*#?\d+\s*[-.:|]\s*', ''), '[^0-9a-z一-鿿]', '', 'g') AS title FROM documents")
def _(t):
    return t("documents").select("doc_id", X.normal_title(F.col("text")).alias("title"))


@query("str_f06_slug", "SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g') AS slug FROM part")
def _(t):
    return t("part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@query("str_f08_comparable", r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[’‘`]', chr(39), 'g'), '[^\p{L}\p{N}'']+', ' ', 'g')) AS text FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", X.comparable(F.col("text")).alias("text"))


@query("str_f11_plain_marks", "SELECT doc_id, translate(text, '，。！？：；（）、', ',.!?:;(),') AS text FROM documents")
def _(t):
    return t("documents").select("doc_id", X.plain_marks(F.col("text")).alias("text"))


@query("str_f12_clip", r"SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN regexp_matches(substr(text, 200, 2), '^[0-9A-Za-z_]{2}$') AND contains(substr(text, 1, 200), ' ') THEN regexp_replace(substr(text, 1, 200), '\s+[0-9A-Za-z_]+$', '') ELSE substr(text, 1, 200) END AS text FROM documents")
def _(t):
    return t("documents").select("doc_id", X.clip(F.col("text"), 200).alias("text"))


@query("str_f12_clip_sentence", r"SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN regexp_matches(substr(text, 1, 200), '[.!?。！？]') THEN regexp_extract(substr(text, 1, 200), '(?s)^(.*[.!?。！？])', 1) ELSE substr(text, 1, 200) END AS text FROM documents")
def _(t):
    return t("documents").select("doc_id", X.clip_sentence(F.col("text"), 200).alias("text"))


@query("str_f16_contexts", "WITH p AS (SELECT conv_id, turn, ' ' || text || ' ' AS s FROM conversations), i AS (SELECT *, unnest(range(2, length(s))) AS i FROM p) SELECT DISTINCT conv_id, turn, substr(s, i - 1, 3) AS context FROM i WHERE substr(s, i, 1) IN ('x', 'q')")
def _(t):
    return t("conversations").select("conv_id", "turn", F.explode(X.contexts(F.col("text"), "xq")).alias("context"))


@query("str_f21_tokens", "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '([a-z0-9]{2,})', 1))) AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", F.size(T.distinct_tokens(F.col("text"))).cast("long").alias("n"))


@query("str_f22_grams", r"SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '(\d+|[a-z]{3,})', 1))) AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", F.size(X.grams(F.col("text"))).cast("long").alias("n"))


@query("str_f24_text_lang", "SELECT doc_id, CASE WHEN h = 0 AND w = 0 THEN lang WHEN h > w THEN 'zh' WHEN lang = 'zh' THEN 'en' ELSE lang END AS lang FROM (SELECT *, len(regexp_extract_all(text, '[一-鿿]')) AS h, len(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)")
def _(t):
    return t("documents").select("doc_id", X.text_lang(F.col("text"), F.col("lang")).alias("lang"))


@query("str_f26_untranslated", "SELECT doc_id, len(regexp_extract_all(text, '[一-鿿]')) > greatest(8, 0.04 * length(text)) AS untranslated FROM documents")
def _(t):
    return t("documents").select("doc_id", X.untranslated(F.col("text")).alias("untranslated"))


@query("str_f28_video_id", "SELECT page_id, nullif(regexp_extract(html, '(?:v=|youtu\\.be/|/embed/|/live/|/shorts/)([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)', 1), '') AS vid FROM pages")
def _(t):
    return t("pages").select("page_id", X.video_id(F.col("html")).alias("vid"))


@query("str_f30_counted", "SELECT o_custkey, CAST(count(*) AS VARCHAR) || CASE WHEN count(*) = 1 THEN ' order' ELSE ' orders' END AS label FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", X.counted(F.col("n"), "order", "orders").alias("label"))


@query("num_01_grounded")
def _(t):
    # The length that the table gives must be spoken in the text.
    return t("documents").select("doc_id", N.number_in(F.col("n_chars").cast("string"), F.col("text")).alias("grounded"))


@query("dt_01_duration", "SELECT o_orderkey, nullif(CAST(trunc(o_totalprice / 10) AS INTEGER), 0) AS seconds FROM orders")
def _(t):
    return t("orders").select("o_orderkey", T.parse_clock(T.clock(F.col("o_totalprice") / 10)).alias("seconds"))


@query("dt_02_parse_time", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) * 60 + 5 AS s FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", X.parse_time(F.format_string("%dm5s", F.col("l_quantity").cast("int"))).alias("s"))


@query("dt_04_feed_date", "SELECT event_id, date_trunc('second', ts) AS at_second FROM events")
def _(t):
    # Events are written as feeds write dates, then read.
    written = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return t("events").select("event_id", X.parse_date(written).cast("timestamp_ntz").alias("at_second"))


@query("dt_06_event_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS day FROM orders")
def _(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    upload = F.when(F.col("o_orderkey") % 2 == 0, day).otherwise("")
    return t("orders").select("o_orderkey", T.event_date(F.substring(day, 1, 7), upload).alias("day"))


@query("dt_07_hours_since", "SELECT event_id, round((epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / 3600, 6) AS hours FROM events")
def _(t):
    return t("events").select("event_id", F.round(X.hours_since(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp")), 6).alias("hours"))


@query("dt_08_day_floor", "SELECT event_id, CAST(floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / 86400) AS BIGINT) AS days FROM events")
def _(t):
    return t("events").select("event_id", F.floor(X.hours_since(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp")) / 24).alias("days"))


@query("arr_03_json_salvage", "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events")
def _(t):
    reply = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("It is "), "props", F.lit(" then")))
    return t("events").select("event_id", F.get_json_object(X.json_salvage(reply), "$.k").cast("int").alias("k"))


@query("arr_07_rules_id", "SELECT substr(sha1('min_words=1200;min_score=7'), 1, 10) AS rules, count(*) AS n FROM documents")
def _(t):
    rules = F.substring(F.sha1(F.lit("min_words=1200;min_score=7").cast("binary")), 1, 10)
    return t("documents").agg(F.count("*").alias("n")).withColumn("rules", rules)


@query("prj_01_overlay", "WITH o AS (SELECT conv_id, list(turn ORDER BY turn) AS a, list(turn * 10 ORDER BY turn) FILTER (role = 'user') AS b FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN b IS NULL THEN array_to_string(a, ',') ELSE array_to_string(b[1:least(len(a), len(b))], ',') END AS shown FROM o")
def _(t):
    # A conversation is one row in the result whatever its length: its turns' numbers, not its texts, are gathered.
    g = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("a"), F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.col("turn") * 10))).alias("b"))
    return g.select("conv_id", F.array_join(X.overlay(F.col("a"), F.when(F.size("b") > 0, F.col("b"))).cast("array<string>"), ",").alias("shown"))


@query("prj_02_names", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE c_mktsegment END, ''), c_name) AS name FROM customer")
def _(t):
    local = F.when(F.col("c_nationkey") % 2 == 0, "").otherwise(F.col("c_mktsegment"))
    return t("customer").select("c_custkey", F.coalesce(F.nullif(local, F.lit("")), "c_name").alias("name"))


@query("prj_05_seek_link", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '/watch?v=' || o_orderkey || '&t=' || o_custkey WHEN 'O' THEN '/audio/' || o_orderkey || '#t=' || o_custkey ELSE '/e/' || o_orderkey END AS href FROM orders")
def _(t):
    k, s, status = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    href = F.when(status == "F", F.concat(F.lit("/watch?v="), k, F.lit("&t="), s)).when(status == "O", F.concat(F.lit("/audio/"), k, F.lit("#t="), s)).otherwise(F.concat(F.lit("/e/"), k))
    return t("orders").select("o_orderkey", href.alias("href"))


OWNERSHIP = """WITH p AS (SELECT d.doc_id, lower(d.text) AS hay, lower(substr(e.text, 1, 40)) AS low FROM documents d LEFT JOIN documents e ON e.doc_id = d.doc_id + 1),
w AS (SELECT doc_id, hay, list_distinct(regexp_extract_all(low, '([a-z]{4,})', 1)) AS latin, list_distinct(list_filter([substr(low, i, 3) FOR i IN range(1, length(low) - 1)], lambda g: regexp_matches(g, '^[一-鿿]{3}$'))) AS tri FROM p)
SELECT doc_id, CASE WHEN len(latin) > 0 OR len(tri) > 0 THEN len(list_filter(latin, lambda x: contains(hay, x))) >= 1 OR len(list_filter(tri, lambda x: contains(hay, x))) >= 2 END AS own FROM w"""


@query("join_28_ownership", OWNERSHIP)
def _(t):
    # Each text is held against the beginning of the next document, as a title that may be another item's.
    d = t("documents").select("doc_id", "text")
    titles = d.select((F.col("doc_id") - 1).alias("doc_id"), F.substring("text", 1, 40).alias("title"))
    return d.join(titles, "doc_id", "left").select("doc_id", X.belongs_to(F.col("text"), F.col("title")).alias("own"))


@query("join_29_title_in_body", "SELECT conv_id, turn, len(list_filter(['that', 'thing', 'which', 'there', 'where'], lambda w: contains(lower(text), w))) >= 3 AS own FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", X.title_in_body(F.col("text"), F.lit("that thing which there where")).alias("own"))


@query("flt_17_leaks", r"SELECT doc_id, regexp_matches(text, '(?i)as an assistant') OR regexp_matches(text, '(?is)(?:token|secret).{0,40}(?:error|denied)|(?:error|denied).{0,40}(?:token|secret)') AS leaked FROM documents")
def _(t):
    return t("documents").select("doc_id", X.leaked(F.col("text"), "as an assistant", "token|secret", "error|denied").alias("leaked"))


@query("flt_20_urlish", r"SELECT page_id, regexp_matches(url, '^(https?://|//|/|\.\.?/)\S*$') AS urlish, contains(url, '/shorts/') AS short FROM pages")
def _(t):
    return t("pages").select("page_id", X.urlish(F.col("url")).alias("urlish"), X.is_short(F.col("url")).alias("short"))


@query("flt_21_fits_whole", "SELECT doc_id, length(text) // 4 BETWEEN 1 AND 2000 AS fits FROM documents")
def _(t):
    return t("documents").select("doc_id", X.tokens_estimate(F.col("text")).between(1, 2000).alias("fits"))


@query("snk_03_api_index", "SELECT doc_id, lang, source, n_chars, substr(text, 1, 80) AS dek, (SELECT max(doc_id) FROM documents) AS generated FROM documents")
def _(t):
    last = t("documents").agg(F.max("doc_id").alias("generated"))  # one row
    return t("documents").select("doc_id", "lang", "source", "n_chars", F.substring("text", 1, 80).alias("dek")).join(F.broadcast(last), F.lit(True))


@query("snk_04_search_row", "SELECT doc_id, substr(lower(concat_ws(' ', source, lang, text)), 1, 5000) AS hay FROM documents")
def _(t):
    return t("documents").select("doc_id", F.substring(F.lower(F.concat_ws(" ", "source", "lang", "text")), 1, 5000).alias("hay"))


@query("snk_06_sitemap", "SELECT DISTINCT '/source/' || source AS loc FROM documents UNION ALL SELECT '/e/' || doc_id FROM documents UNION ALL SELECT '/c/' || conv_id FROM conversations WHERE turn = 0")
def _(t):
    d = t("documents")
    loc = lambda family, c: F.concat(F.lit(f"/{family}/"), F.col(c).cast("string")).alias("loc")
    return d.select(loc("source", "source")).distinct().unionByName(d.select(loc("e", "doc_id"))).unionByName(t("conversations").where("turn = 0").select(loc("c", "conv_id")))


@query("snk_11_article_body", "SELECT conv_id, string_agg('[' || (turn * 37) // 60 || ':' || lpad(CAST(turn * 37 % 60 AS VARCHAR), 2, '0') || '] ' || role || '。' || substr(text, 1, 40), chr(10) ORDER BY turn, text) AS body FROM conversations GROUP BY 1")
def _(t):
    line = F.concat(F.lit("["), T.clock(F.col("turn") * 37), F.lit("] "), "role", F.lit("。"), F.substring("text", 1, 40))
    return t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", line.alias("line")))), lambda r: r["line"]), "\n").alias("body"))


@query("snk_12_usage_retained", "WITH u AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT * FROM u WHERE day > (SELECT max(day) FROM u) - 10")
def _(t):
    u = t("events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    last = t("events").agg(F.max(F.to_date("ts")).alias("last"))  # one row
    return u.join(F.broadcast(last), F.lit(True)).where(F.col("day") > F.date_sub("last", 10)).drop("last")


CUES = r"""WITH c AS (SELECT conv_id || '-' || turn AS id, turn, regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '<[^>]*>', '', 'g'), '&[a-z#0-9]+;|>>', ' ', 'g') AS x FROM conversations)
SELECT id, 0 AS pos, CAST(turn // 6 % 60 * 60 + turn % 6 * 10 AS INTEGER) AS t, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM c WHERE trim(x) <> ''"""


@query("src_09_cues", CUES)
def _(t):
    # Turns are written as cues ten seconds apart, then parsed.
    cue = F.format_string("00:%02d:%02d.000 --> 00:59:59.000\n%s", F.floor(F.col("turn") / 6) % 60, F.col("turn") % 6 * 10, F.regexp_replace("text", r"\s+", " "))
    return captions.cues(t("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), cue.alias("body")))


SPEAKERS = r"""WITH c AS (SELECT conv_id, role, CAST(turn % 60 * 60 AS INTEGER) AS t, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, ltrim(regexp_replace(text, '\s+', ' ', 'g')) AS text, length(role || ' [00:00:00]: ' || regexp_replace(text, '\s+', ' ', 'g')) AS n FROM conversations),
s AS (SELECT conv_id FROM c GROUP BY 1 HAVING count(*) FILTER (text <> '') >= 3 AND 2 * sum(n) FILTER (text <> '') >= sum(n) + count(*) - 1)
SELECT conv_id, pos, t, role AS spk, text FROM c SEMI JOIN s USING (conv_id) WHERE text <> ''"""


@query("src_12_speaker_lines", SPEAKERS)
def _(t):
    line = F.format_string("%s [00:%02d:00]: %s", "role", F.col("turn") % 60, F.regexp_replace("text", r"\s+", " "))
    notes = t("conversations").groupBy("conv_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda r: r["l"])).alias("body"))
    return captions.speaker_lines(notes, "conv_id", "body", 3)


@query("src_11_untimed", "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), r AS (SELECT *, sum(length(line)) OVER w AS run, sum(length(line)) OVER (PARTITION BY doc_id) AS total FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN total > 0 THEN CAST((3600 * (run - length(line))) // total AS BIGINT) END AS t FROM r")
def _(t):
    return captions.untimed(t("documents").select("doc_id", "text", F.lit(3600).alias("span")), "doc_id", "text", "span").select("doc_id", "pos", "t")


@query("flt_18_gate")
def _(t):
    # A conversation is a transcript; its turns are the points, its longest turn and its first are quoted.
    c = t("conversations").select("conv_id", F.struct(F.col("turn").cast("int").alias("turn"), (F.col("turn") * 60).cast("int").alias("t"), F.col("role").alias("h"), F.col("text").alias("body")).alias("p"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("turns"))
    point = lambda p: F.struct(p["t"].alias("t"), p["h"].alias("h"), p["body"].alias("body"))
    d = g.select(
        "conv_id",
        F.concat(F.lit("对话 "), F.col("conv_id").cast("string"), F.lit(" 的摘要")).alias("title"),
        F.element_at("turns", 1)["body"].alias("dek"),
        F.transform("turns", point).alias("points"),
        F.transform("turns", lambda p: F.struct(p["t"].alias("t"), p["body"].alias("raw"))).alias("quotes"),
        F.transform("turns", lambda p: F.struct(p["h"].alias("k"), p["turn"].cast("string").alias("v"), p["t"].alias("t"))).alias("facts"),
        F.transform("turns", lambda p: F.struct(p["t"].alias("t"), p["body"].alias("text"))).alias("segments"),
        (F.size("turns") * 60).alias("duration"),
        F.lit(True).alias("timed"),
    )
    return G.check(d).select("conv_id", "publish", F.size("points").alias("points"), "verified_quotes", "grounded_facts", F.array_join("problems", "; ").alias("problems"))
