"""Queries of the sources and sinks: feeds, JSON and captions are written from the tables' rows, then read as what they are."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import relational as R
from ..operators import site
from ..sinks import pages, snapshots, tables
from ..sources import feeds, revisions, scans, transcripts
from .queries import query

CUT = "CASE WHEN event_id % 7 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END"


def cut(t):
    return t("events").select("event_id", "user_id", F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, F.length("props") - 1)).otherwise(F.col("props")).alias("doc"))


@query("src_01_scan", f"SELECT event_id, user_id, CAST(props->>'k' AS BIGINT) AS k FROM events WHERE json_valid({CUT})")
def _(t):
    return scans.readable(cut(t), "doc", "k long")


@query("src_25_invalid", f"SELECT event_id, {CUT} AS doc FROM events WHERE NOT json_valid({CUT})")
def _(t):
    return scans.unreadable(cut(t), "doc", "k long").select("event_id", "doc")


@query("src_20_ledger", "SELECT c_custkey, 0 AS tries FROM customer")
def _(t):
    c = t("customer")
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("tries", T.IntegerType())])
    none = scans.ledger(c.sparkSession, "file:///no-such-folder/ledger.json", schema)
    return c.select("c_custkey").join(none, "c_custkey", "left").select("c_custkey", F.coalesce("tries", F.lit(0)).alias("tries"))


@query("src_21_translations", "SELECT source AS slug, max_by(lang, doc_id) AS lang, max_by(n_chars, doc_id) AS n_chars FROM documents WHERE source IS NOT NULL GROUP BY 1")
def _(t):
    return scans.keyed(t("documents").select(F.col("source").alias("slug"), "doc_id", "lang", "n_chars"), "slug", "doc_id")


def feed(t, item: str, wrap):
    """A feed of the rows of each part brand: (source, xml), items in the order of their keys."""
    p = t("part")
    rows = p.groupBy(F.col("p_brand").alias("source")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.expr(item).alias("x")))), lambda r: r["x"]), "").alias("items"))
    return rows.select("source", wrap(F.col("items")).alias("xml"))


RSS_ITEM = """concat('<item><title>', p_name, '</title>', if(p_partkey % 3 = 0, concat('<guid>g', p_partkey, '</guid>'), ''), if(p_partkey % 2 = 0, concat('<link>http://l/', p_partkey, '</link>'), ''),
  '<enclosure url="http://e/', p_partkey, '" type="', if(p_partkey % 5 = 0, 'image/png', 'audio/mpeg'), '"/>', if(p_partkey % 10 = 0, '<media:content url="http://m/x"/>', ''),
  if(p_size > 25, concat('<itunes:image href="http://a/', p_size, '"/>'), ''), if(p_size % 2 = 0, concat('<content:encoded><![CDATA[c ', p_type, ']]></content:encoded>'), ''), '<description>d ', p_type, '</description></item>')"""


def rss_of(items):
    return F.concat(F.lit('<?xml version="1.0"?>\n<rss><channel><itunes:image href="http://channel"/>\x07'), items, F.lit("</channel></rss>"))


@query("src_02_rss", "SELECT p_brand AS source, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS pos, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN 'g' || p_partkey WHEN p_partkey % 2 = 0 THEN 'http://l/' || p_partkey ELSE p_name END AS guid, CASE WHEN p_partkey % 5 <> 0 THEN 'http://e/' || p_partkey WHEN p_partkey % 10 = 0 THEN 'http://m/x' END AS audio, CASE WHEN p_size > 25 THEN 'http://a/' || p_size ELSE 'http://channel' END AS art, CASE WHEN p_size % 2 = 0 THEN 'c ' ELSE 'd ' END || p_type AS notes FROM part")
def _(t):
    return feeds.rss(feed(t, RSS_ITEM, rss_of), "source", "xml")


ATOM_ITEM = "concat('<entry><title>', p_name, '</title>', if(p_partkey % 3 = 0, concat('<id>i', p_partkey, '</id>'), ''), '<link href=\"http://v/', if(p_partkey % 4 = 0, 'shorts/', ''), p_partkey, '\"/><summary>s ', p_type, '</summary></entry>')"


def atom_of(items):
    return F.concat(F.lit('<feed xmlns="a">'), items, F.lit("</feed>"))


ATOM_SQL = "SELECT p_brand AS source, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS pos, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN 'i' || p_partkey ELSE 'http://v/' || p_partkey END AS guid, p_partkey, 's ' || p_type AS notes FROM part"


@query("src_03_atom", f"SELECT source, pos, title, guid, notes FROM ({ATOM_SQL}) WHERE p_partkey % 4 <> 0")
def _(t):
    return feeds.atom(feed(t, ATOM_ITEM, atom_of), "source", "xml").drop("audio", "art")


@query("src_04_dispatch", "SELECT p_brand AS source, count(*) AS n FROM part WHERE p_brand < 'Brand#2' OR (p_brand < 'Brand#4' AND p_partkey % 4 <> 0) GROUP BY 1")
def _(t):
    source = F.col("source")
    both = feed(t, RSS_ITEM, rss_of).where(source < "Brand#2").union(feed(t, ATOM_ITEM, atom_of).where((source >= "Brand#2") & (source < "Brand#4"))).union(feed(t, RSS_ITEM, lambda x: F.concat(F.lit("<html>"), x)).where(source >= "Brand#4"))
    return feeds.items(both, "source", "xml").groupBy("source").agg(F.count("*").alias("n"))


@query("src_05_fetch", "WITH p AS (SELECT user_id, CASE WHEN event_id % 9 <> 0 THEN ts END AS ts, event_id FROM events WHERE value > 300), f AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM p)) SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS INTEGER) AS place FROM (SELECT * FROM p UNION ALL SELECT * FROM f)")
def _(t):
    primary = t("events").where("value > 300").select("user_id", F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("ts"), "event_id")
    return feeds.listing(primary, t("events").where("event_type = 'view'").select("user_id", "ts", "event_id"), "user_id", "ts")


@query("src_10_json_captions", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, turn * 7 AS t, role AS text, CASE WHEN conv_id % 4 = 1 THEN 's' || turn END AS speaker FROM conversations")
def _(t):
    # Four shapes by conversation: a known container, a container deep in other objects, a bare array, a container below another that holds no array.
    shapes = [("start", "text", '{"segments": [', "]}"), ("startTime", "body", '{"meta": {"n": 1}, "page": {"inner": [{"cues": [', "]}]}}"), ("offset", "content", "[", "]"), ("begin", "utterance", '{"results": {"transcript": [', "]}}")]
    which = lambda make: F.coalesce(*[F.when(F.col("conv_id") % 4 == i, make(*s)) for i, s in enumerate(shapes)])
    spoken = F.when(F.col("conv_id") % 4 == 1, F.concat(F.lit("s"), "turn"))
    cue = which(lambda at, x, *_: F.to_json(F.struct((F.col("turn") * 7 + 0.5).alias(at), F.concat(F.lit(" "), "role").alias(x), spoken.alias("speaker"))))
    rows = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("j")))), lambda r: r["j"]), ",").alias("j"))
    body = which(lambda _, __, head, tail: F.concat(F.lit(head), "j", F.lit(tail)))
    return transcripts.json_captions(rows.select("conv_id", body.alias("body")), "conv_id", "body")


def _blocks(tag: str, order: int) -> str:
    return f"SELECT page_id, '{tag}' AS tag, {order} AS o, unnest(regexp_extract_all(html, '(?s)<{tag}\\b[^>]*>(.*?)</{tag}>', 1)) AS b FROM pages"


@query("src_13_page_body", f"WITH b AS ({' UNION ALL '.join(_blocks(x, i) for i, x in enumerate(('article', 'main', 'section', 'nav')))}), w AS (SELECT page_id, tag, o, b, CAST(len(regexp_extract_all(regexp_replace(b, '<[^>]*>', ' ', 'g'), '[A-Za-z0-9'']+')) AS BIGINT) AS words FROM b) SELECT page_id, tag, words FROM w WHERE words >= 50 AND words >= 0.1 * length(b) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY words DESC, o) = 1")
def _(t):
    return transcripts.page_body(t("pages"), "page_id", "html")


@query("src_13_page_transcripts")
def _(t):
    # A page's title is its item's, its host the show; the length of two in three is known.
    p = t("pages").select("page_id", "html", X.url_host(F.col("url")).alias("host"), F.nullif(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), F.lit("")).alias("title"), (F.col("page_id") % 3 * 60).alias("seconds"))
    return transcripts.page_transcripts(p, "page_id", "html", "title", "seconds", "host", per_minute=(20, 400), least=60, markup_least=300)


@query("src_14_official_link", "SELECT l_orderkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_shipmode_ WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END, l_partkey * 100000 + l_linenumber * 1000 + l_quantity) = 1".replace("l_shipmode_", "l_returnflag"))
def _(t):
    links = t("lineitem").withColumn("order", F.col("l_partkey") * 100000 + F.col("l_linenumber") * 1000 + F.col("l_quantity"))
    return transcripts.official(links, "l_orderkey", "l_returnflag", "l_linestatus", "order", kinds=("R", "A"), wanted="O").select("l_orderkey", "l_partkey")


WORDS = "len(regexp_extract_all(text, '[A-Za-z0-9'']+'))"


@query("src_15_notes", f"SELECT doc_id, CASE WHEN doc_id % 5 * 60 > 0 THEN {WORDS} >= 90.0 * (doc_id % 5 * 60) / 60 ELSE {WORDS} >= 300 END AS dense FROM documents")
def _(t):
    return t("documents").select("doc_id", transcripts.dense(transcripts.words(F.col("text")), F.col("doc_id") % 5 * 60, per_minute=90, least=300).alias("dense"))


@query("src_17_tiers", "WITH x AS (SELECT o_orderkey AS k, 0 AS r, 'feed' AS tier, CAST(floor(o_totalprice) AS BIGINT) AS words FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 1, 'notes', o_custkey * 300 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 2, 'page', 200000 FROM orders WHERE o_orderkey % 2 = 0), y AS (SELECT *, min(CASE WHEN words >= 150000 THEN r END) OVER (PARTITION BY k) AS best FROM x) SELECT k, max(CASE WHEN r = best THEN tier END) AS tier, max(CASE WHEN r = best THEN words END) AS words, string_agg(tier || ':' || CASE WHEN words >= 150000 THEN 'ok' ELSE 'no' END, ',' ORDER BY r) FILTER (best IS NULL OR r <= best) AS attempts FROM y GROUP BY k")
def _(t):
    o = t("orders").withColumnRenamed("o_orderkey", "k")
    tiers = [("feed", o.where("o_orderstatus = 'F'").select("k", F.floor("o_totalprice").cast("long").alias("words"))), ("notes", o.where("k % 3 = 0").select("k", (F.col("o_custkey") * 300).alias("words"))), ("page", o.where("k % 2 = 0").select("k", F.lit(200000).cast("long").alias("words")))]
    return transcripts.acquire(tiers, "k", "words", F.col("words") >= 150000)


@query("src_18_pools", "SELECT name, min(pool) AS pool FROM (SELECT p_name AS name, 'a' AS pool FROM part WHERE p_size < 10 UNION ALL SELECT p_name || ' live', 'b' FROM part WHERE p_size > 40 UNION ALL SELECT p_name, 'b' FROM part WHERE p_size > 40) GROUP BY 1")
def _(t):
    lists = t("part").groupBy("p_size").agg(F.to_json(F.collect_list(F.struct(F.col("p_name").alias("name")))).alias("j"))
    pool = lists.where("p_size < 10").select(F.lit("a").alias("pool"), "j").union(lists.where("p_size > 40").select(F.lit("b"), "j"))
    names = pool.select("pool", F.explode(F.from_json("j", "array<struct<name:string>>")).alias("x")).select("pool", "x.name")
    live = names.where("pool = 'b'").select("pool", F.concat("name", F.lit(" live")).alias("name"))
    return names.unionByName(live).groupBy("name").agg(F.min("pool").alias("pool"))


@query("src_19_embedded_array", "SELECT c_nationkey AS person, c_custkey AS yt, c_name AS ch FROM customer")
def _(t):
    page = F.concat(F.lit("<script>var a = 1; const VIDEOS = "), F.to_json(F.collect_list(F.struct(F.col("c_custkey").alias("yt"), F.col("c_name").alias("ch"), F.lit("x").alias("note")))), F.lit("; go();</script>"))
    x = t("customer").groupBy(F.col("c_nationkey").alias("person")).agg(page.alias("html"))
    return x.select("person", F.explode(scans.array_in(F.col("html"), "VIDEOS", "yt:long,ch:string")).alias("v")).select("person", "v.*")


@query("src_22_blocks", "WITH l AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '# ' WHEN 1 THEN '> ' WHEN 2 THEN '- ' ELSE '' END || role || ' #' || conv_id || ' #' || turn AS line FROM conversations) SELECT conv_id, turn, CASE WHEN starts_with(line, '# ') THEN 'heading' WHEN starts_with(line, '> ') THEN 'quote' WHEN starts_with(line, '- ') THEN 'item' ELSE 'text' END AS kind, array_to_string(regexp_extract_all(line, '#(\\d+)', 1), ',') AS cites FROM l")
def _(t):
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("# ", "> ", "- ", "")]), (F.col("turn") % 4 + 1).cast("int"))
    line = F.concat(prefix, F.col("role"), F.lit(" #"), F.col("conv_id"), F.lit(" #"), F.col("turn"))
    body = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    rows = body.select("conv_id", F.explode("lines").alias("l")).select("conv_id", "l.turn", "l.line")
    kind = F.when(F.startswith("line", F.lit("# ")), "heading").when(F.startswith("line", F.lit("> ")), "quote").when(F.startswith("line", F.lit("- ")), "item").otherwise("text")
    return rows.select("conv_id", "turn", kind.alias("kind"), F.array_join(F.regexp_extract_all("line", F.lit(r"#(\d+)"), 1), ",").alias("cites"))


@query("src_24_revisions", "WITH o AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40), u AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40) SELECT p_partkey AS k, o.k IS NOT NULL AS ours, u.k IS NOT NULL AS theirs FROM part LEFT JOIN o ON o.k = p_partkey LEFT JOIN u ON u.k = p_partkey WHERE o.k IS NULL OR u.k IS NULL")
def _(t):
    tree = lambda flag, name: t("lineitem").where((F.col("l_returnflag") == flag) & (F.col("l_quantity") > 40)).select(F.col("l_partkey").alias("k")).distinct().withColumn(name, F.lit(True))
    j = t("part").select(F.col("p_partkey").alias("k")).join(tree("A", "ours"), "k", "left").join(tree("R", "theirs"), "k", "left")
    return j.select("k", F.coalesce("ours", F.lit(False)).alias("ours"), F.coalesce("theirs", F.lit(False)).alias("theirs")).where("not (ours and theirs)")


LINES = "WITH c AS (SELECT c_custkey // 100 AS b, c_custkey, c_nationkey, c_mktsegment FROM customer), f AS (SELECT (b // 100) || '/' || b || '.txt' AS path, b, string_agg(c_custkey || '|' || c_nationkey || chr(10), '' ORDER BY c_custkey) AS one, string_agg(c_custkey || '|' || c_mktsegment || chr(10), '' ORDER BY c_custkey) AS two FROM c GROUP BY b), v AS (SELECT path, CASE WHEN b % 5 <> 0 THEN one END AS old, CASE WHEN b % 7 <> 0 THEN CASE WHEN b % 3 = 0 THEN two ELSE one END END AS new FROM f)"


def blob_of(column: str) -> str:
    return f"CASE WHEN {column} IS NOT NULL THEN sha1('blob ' || strlen({column}) || chr(0) || {column}) END"


@query("src_24_git_changes", f"{LINES} SELECT path, {blob_of('old')} AS before, {blob_of('new')} AS after, new AS content FROM v WHERE old IS DISTINCT FROM new")
def _(t):
    # Two commits of a repository, a file for each hundred customers: some files are new in the second, some gone, some differ.
    c = t("customer").withColumn("b", F.floor(F.col("c_custkey") / 100))
    lines = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", F.concat("c_custkey", F.lit("|"), x, F.lit("\n")).alias("l")))), lambda r: r["l"]), "")
    files = c.groupBy("b").agg(lines("c_nationkey").alias("one"), lines("c_mktsegment").alias("two")).withColumn("path", F.concat(F.floor(F.col("b") / 100), F.lit("/"), "b", F.lit(".txt")))
    as_file = lambda x: F.encode(x, "utf-8").alias("body")
    spark = c.sparkSession
    repo = tables.shared_folder(spark)
    old = snapshots.committed(files.where("b % 5 <> 0").select("path", as_file(F.col("one"))), repo, "before")
    new = snapshots.committed(files.where("b % 7 <> 0").select("path", as_file(F.when(F.col("b") % 3 == 0, F.col("two")).otherwise(F.col("one")))), repo, "after", (old,))
    rows = revisions.with_bodies(revisions.changes(spark, repo, old, new), repo, "after")
    return rows.select("path", "before", "after", F.decode("body", "utf-8").alias("content"))


@query("snk_02_new_records", "SELECT min(doc_id) AS doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def _(t):
    # An item that is on disk is never written again; of new ones with one name, the first.
    new = t("documents").select("doc_id", "source").join(t("labels").select("doc_id"), "doc_id", "left_anti")
    return new.groupBy("source").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@query("snk_05_feed_out", "WITH o AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 60), p AS (SELECT l_orderkey, string_agg('<li>' || l_partkey || '</li>', '' ORDER BY l_linenumber, l_partkey, l_quantity) AS points FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) <= 8) GROUP BY 1) SELECT o_orderkey, '<item><guid>' || o_orderkey || '</guid><title>' || o_orderpriority || '</title><description>' || coalesce(points, '') || '</description></item>' AS item FROM o LEFT JOIN p ON l_orderkey = o_orderkey")
def _(t):
    newest = t("orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(60)
    order = ["l_linenumber", "l_partkey", "l_quantity"]
    # 60 items are a bounded broadcast; their points are cut to eight each.
    points = t("lineitem").join(F.broadcast(newest.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_list(F.struct(*order))), 1, 8).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(F.lit("<li>"), x["l_partkey"], F.lit("</li>"))), "")
    j = newest.join(points, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", F.concat(F.lit("<item><guid>"), "o_orderkey", F.lit("</guid><title>"), "o_orderpriority", F.lit("</title><description>"), F.coalesce(text, F.lit("")), F.lit("</description></item>")).alias("item"))


@query("snk_07_full_text", "SELECT c_mktsegment AS cat, count(*) AS n, string_agg(c_name, chr(10) ORDER BY c_acctbal DESC, c_custkey) AS body FROM customer WHERE c_nationkey = 7 GROUP BY 1")
def _(t):
    rows = t("customer").where("c_nationkey = 7").groupBy(F.col("c_mktsegment").alias("cat")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("c_acctbal")).alias("b"), "c_custkey", "c_name"))).alias("x"))
    return rows.select("cat", "n", F.array_join(F.transform("x", lambda r: r["c_name"]), "\n").alias("body"))


@query("snk_08_source_pages", "SELECT user_id, count(*) AS n, max(ts) AS latest, count(DISTINCT event_type) AS kinds, max_by(event_id, ts) AS newest FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("latest"), F.count_distinct("event_type").alias("kinds"), F.max_by("event_id", "ts").alias("newest"))


ESCAPED = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
SITE = f"""WITH i AS (SELECT 'p' || p_partkey AS slug, {ESCAPED.format("p_name || ' <' || p_size || '>'")} AS title, p_brand AS dek, p_partkey % 7 AS source, 'c' || p_size % 6 AS category, p_size AS day, p_partkey AS k FROM part),
m AS (SELECT s_suppkey AS source, {ESCAPED.format("'A & ' || s_name")} AS name FROM supplier WHERE s_suppkey < 5),
g AS (SELECT 'source' AS family, 's/' || source AS path, CAST(source AS VARCHAR) AS gk, * FROM i UNION ALL SELECT 'category', 'c/' || category, category, * FROM i),
l AS (SELECT *, '<li><a href="/e/' || slug || '.html">' || title || '</a></li>' AS li, row_number() OVER (PARTITION BY path ORDER BY day DESC, k) AS rn FROM g),
p AS (SELECT family, path, coalesce(CASE WHEN family = 'source' THEN max(name) END, gk) AS t, '<p>' || count(*) || ' / ' || max(day) || '</p><ol>' || string_agg(li, '' ORDER BY rn) FILTER (rn <= 24) || '</ol>' AS body FROM l LEFT JOIN m ON m.source = l.source GROUP BY family, path, gk
UNION ALL SELECT 'episode', 'e/' || slug, title, '<p>' || dek || '</p><p><a href="/s/' || i.source || '.html">' || coalesce(name, CAST(i.source AS VARCHAR)) || '</a></p>' FROM i LEFT JOIN m ON m.source = i.source
UNION ALL SELECT 'home', 'index', 'Parts', '<ol>' || string_agg('<li><a href="/e/' || slug || '.html">' || title || '</a></li>', '' ORDER BY day DESC, k) || '</ol>' FROM (SELECT * FROM i ORDER BY day DESC, k LIMIT 24)
UNION ALL SELECT 'alias', 'e/old' || k, slug, '<meta http-equiv="refresh" content="0; url=/e/' || slug || '.html">' FROM i WHERE k % 10 = 0
UNION ALL SELECT '404', '404', '404', '') SELECT family, path || '.html' AS path, '<!doctype html><title>' || t || '</title><h1>' || t || '</h1>' || body AS html FROM p"""


@query("snk_08_site", SITE)
def _(t):
    p, slug = t("part"), F.concat(F.lit("p"), "p_partkey")
    items = p.select(slug.alias("slug"), F.concat("p_name", F.lit(" <"), "p_size", F.lit(">")).alias("title"), F.col("p_brand").alias("dek"), (F.col("p_partkey") % 7).alias("source"), F.concat(F.lit("c"), F.col("p_size") % 6).alias("category"), F.col("p_size").alias("day"), "p_partkey")
    names = t("supplier").where("s_suppkey < 5").select(F.col("s_suppkey").alias("source"), F.concat(F.lit("A & "), "s_name").alias("name"))
    # Old names of one in ten, and one that is an item's own by now.
    aliases = p.where("p_partkey % 10 = 0").select(F.concat(F.lit("old"), "p_partkey").alias("old"), slug.alias("slug")).union(p.where("p_partkey % 10 = 1").select(slug, slug))
    return site.site(items, names, aliases, [F.col("day").desc(), F.col("p_partkey")], title="Parts")


@query("snk_09_page_files", "SELECT o_custkey, o_orderkey, CAST((rn - 1 - 4) // 3 + 1 AS INTEGER) AS page FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn > 4")
def _(t):
    # A list of its own for each customer: four rows are inlined, the rest go to files of three.
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    x = t("orders").withColumn("rn", F.row_number().over(w)).where("rn > 4")
    return x.select("o_custkey", "o_orderkey", (F.floor((F.col("rn") - 5) / 3) + 1).cast("int").alias("page"))


@query("snk_10_vanished", "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def _(t):
    return t("lineitem").select(F.col("l_partkey").alias("k")).distinct().join(t("part").where("p_size > 5").select(F.col("p_partkey").alias("k")), "k", "left_anti")


LISTED = "WITH r AS (SELECT p_brand AS b, p_partkey AS k, p_name, (row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) - 1) // 24 + 1 AS page, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS n FROM part WHERE p_size > 5)"


@query("snk_10_published", f"{LISTED} SELECT replace(b, '#', '-') || '/page-' || page || '.html' AS path, '<ol>' || string_agg('<li id=' || k || '>' || p_name || '</li>', '' ORDER BY n) || '</ol>' AS html FROM r GROUP BY b, page")
def _(t):
    # Lists of each brand, 24 rows a file. All parts are published, then those over size 5: what files the second has no rows for are gone.
    w = Window.partitionBy("p_brand").orderBy(F.col("p_size").desc(), "p_partkey")
    item = F.concat(F.lit("<li id="), "p_partkey", F.lit(">"), "p_name", F.lit("</li>"))

    def listed(parts):
        x = parts.select("p_brand", F.row_number().over(w).alias("n"), item.alias("i"))
        rows = x.groupBy(F.concat(F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/page-"), F.floor((F.col("n") - 1) / 24) + 1, F.lit(".html")).alias("path")).agg(F.array_sort(F.collect_list(F.struct("n", "i"))).alias("x"))
        return rows.select("path", F.concat(F.lit("<ol>"), F.array_join(F.transform("x", lambda r: r["i"]), ""), F.lit("</ol>")).alias("html"))

    root = tables.shared_folder(t("part").sparkSession)
    for parts in (t("part"), t("part").where("p_size > 5")):
        pages.publish(listed(parts), root)
    return pages.published(t("part").sparkSession, root)


@query("snk_13_trace", "WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) SELECT user_id, event_id FROM r WHERE n <= 40 AND ts >= TIMESTAMP '2024-01-20'")
def _(t):
    kept = R.newest_per(t("events").select("user_id", "event_id", "ts"), "user_id", [F.col("ts").desc(), F.col("event_id")], 40)
    return kept.where("ts >= TIMESTAMP '2024-01-20'").select("user_id", "event_id")


@query("snk_14_heartbeat", "SELECT event_type AS line, max(ts) AS beat, max_by(event_id, ts) AS run, max_by(value > 400, ts) AS failed FROM events GROUP BY 1")
def _(t):
    return t("events").withColumn("failed", F.col("value") > 400).groupBy(F.col("event_type").alias("line")).agg(F.max("ts").alias("beat"), F.max_by("event_id", "ts").alias("run"), F.max_by("failed", "ts").alias("failed"))


@query("snk_15_submissions", "WITH u AS (SELECT regexp_replace(url, '[?#].*$', '') AS u, min(page_id) AS first FROM pages GROUP BY 1) SELECT pre || regexp_replace(u, '^https?://', '') AS url, o * 1000000000 + first AS place FROM u, (VALUES (0, ''), (1, 'en/'), (2, 'tw/')) v(o, pre)")
def _(t):
    u = t("pages").groupBy(F.regexp_replace("url", "[?#].*$", "").alias("u")).agg(F.min("page_id").alias("first"))
    trees = F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(p).alias("pre")) for i, p in enumerate(("", "en/", "tw/"))]))
    x = u.select("u", "first", trees.alias("t"))
    return x.select(F.concat("t.pre", F.regexp_replace("u", "^https?://", "")).alias("url"), (F.col("t.o") * F.lit(1000000000).cast("long") + F.col("first")).alias("place"))


@query("snk_16_covers", "SELECT p.page_id, CASE WHEN b.k IS NULL THEN 'new' WHEN b.file IS NULL THEN 'failed' ELSE 'cached' END AS state FROM pages p LEFT JOIN (SELECT page_id AS k, CASE WHEN page_id % 4 = 0 THEN 'f' || page_id END AS file FROM pages WHERE page_id % 2 = 0) b ON b.k = p.page_id")
def _(t):
    manifest = t("pages").where("page_id % 2 = 0").select("page_id", F.lit(True).alias("tried"), F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("f"), "page_id")).alias("file"))
    return t("pages").select("page_id").join(manifest, "page_id", "left").select("page_id", F.when(F.col("tried").isNull(), "new").when(F.col("file").isNull(), "failed").otherwise("cached").alias("state"))


@query("snk_18_append", "SELECT o_orderkey AS id, 'old' AS kind FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    o = t("orders").withColumnRenamed("o_orderkey", "id")
    old = o.where("o_orderstatus = 'F'").select("id")
    new = o.where("o_orderstatus = 'P'").select("id").join(old, "id", "left_anti")
    return old.withColumn("kind", F.lit("old")).unionByName(new.withColumn("kind", F.lit("new")))
