"""Queries of joins, filters, orders and sets of the archive that served lists and reviews are made of."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import forms as X
from ..functions import text as T
from ..operators import containment as C
from ..operators import evidence as E
from ..operators import relational as R
from .queries import query


@query("flt_07_wrong_language", "SELECT d.doc_id, coalesce(l.was <> d.lang, false) OR coalesce(l.toxic = 1, false) AS void FROM documents d LEFT JOIN (SELECT doc_id, toxic, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE 'fr' END AS was FROM labels) l ON l.doc_id = d.doc_id")
def _(t):
    verdicts = t("labels").select("doc_id", "toxic", F.when(F.col("doc_id") % 3 == 0, "en").otherwise("fr").alias("was"))
    j = t("documents").select("doc_id", "lang").join(verdicts, "doc_id", "left")
    no = F.lit(False)
    return j.select("doc_id", (F.coalesce(F.col("was") != F.col("lang"), no) | F.coalesce(F.col("toxic") == 1, no)).alias("void"))


LEADS = "SELECT o_orderkey AS id, o_custkey AS person, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice / 100 AS BIGINT) AS secs, o_orderstatus = 'F' AS official, substr(o_orderpriority, 1, 1) AS kind FROM orders"


@query("flt_09_leads", f"WITH l AS (SELECT * FROM ({LEADS}) WHERE kind IN ('1', '2', '3', '4') AND secs >= CASE WHEN official THEN 900 ELSE 1200 END) SELECT id, official FROM l a WHERE official OR NOT EXISTS (SELECT 1 FROM l b WHERE b.official AND b.person = a.person AND abs(datediff('day', a.day, b.day)) <= 30 AND abs(a.secs - b.secs) <= 0.05 * greatest(a.secs, b.secs))")
def _(t):
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person"), F.to_date("o_orderdate").alias("day"), F.round(F.col("o_totalprice") / 100).cast("long").alias("secs"), (F.col("o_orderstatus") == "F").alias("official"), F.substring("o_orderpriority", 1, 1).alias("kind"))
    leads = o.where(F.col("kind").isin(*"1234") & (F.col("secs") >= F.when(F.col("official"), 900).otherwise(1200)))
    talks = leads.where("official").select(F.col("person").alias("p"), F.col("day").alias("d"), F.col("secs").alias("s"))
    same = (F.col("person") == F.col("p")) & (F.abs(F.datediff("day", "d")) <= 30) & (F.abs(F.col("secs") - F.col("s")) <= 0.05 * F.greatest("secs", "s"))
    again = leads.where("not official").join(talks, same, "left_anti")
    return leads.where("official").unionByName(again).select("id", "official")


@query("flt_19_shorts", "SELECT page_id, regexp_matches(url, '(?i)/(fr|shorts)/') AS short FROM pages")
def _(t):
    return t("pages").select("page_id", X.is_short(F.regexp_replace("url", "/fr/", "/shorts/")).alias("short"))


@query("flt_22_evaluate", "WITH m AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, median(value) AS med, max(ts) AS latest FROM events GROUP BY 1) SELECT user_id, CASE WHEN n < 20 THEN 'too few' WHEN latest < TIMESTAMP '2024-01-29' THEN 'stale' WHEN bad * 4 > n THEN 'unreadable' WHEN med < 30 THEN 'below bar' WHEN bad * 6 > n THEN 'trial' ELSE 'accept' END AS verdict FROM m")
def _(t):
    m = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"), F.median("value").alias("med"), F.max("ts").alias("latest"))
    case = F.when(F.col("n") < 20, "too few").when(F.col("latest") < F.lit("2024-01-29").cast("timestamp"), "stale").when(F.col("bad") * 4 > F.col("n"), "unreadable").when(F.col("med") < 30, "below bar").when(F.col("bad") * 6 > F.col("n"), "trial")
    return m.select("user_id", F.coalesce(case, F.lit("accept")).alias("verdict"))


@query("flt_23_shortlist", "SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, 'red|old') AND p_size >= 3 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) * 7 % 11 DESC, p_partkey) <= 5")
def _(t):
    # The scorer is a column like any other: here a number of the name.
    x = t("part").where(~F.col("p_name").rlike("red|old") & (F.col("p_size") >= 3)).withColumn("score", F.length("p_name") * 7 % 11)
    return R.newest_per(x, "p_brand", [F.col("score").desc(), F.col("p_partkey")], 5).select("p_partkey", "p_name")


@query("flt_28_tabs", "SELECT doc_id, CASE WHEN contains(lower(text), 'the') AND contains(lower(text), 'of') THEN 'search' WHEN doc_id >= 900 THEN 'new' WHEN source IN ('src1', 'src2') THEN 'core' END AS tab FROM documents WHERE (contains(lower(text), 'the') AND contains(lower(text), 'of')) OR doc_id >= 900 OR source IN ('src1', 'src2')")
def _(t):
    hit = F.forall(F.split(F.lit("the of"), " "), lambda w: F.contains(F.lower("text"), w))
    tab = F.when(hit, "search").when(F.col("doc_id") >= 900, "new").when(F.col("source").isin("src1", "src2"), "core")
    return t("documents").select("doc_id", tab.alias("tab")).where("tab is not null")


@query("flt_29_valid_fix", "SELECT p_partkey, length(c) = 3 AND length(x) = 3 AND substr(c, 1, 1) = substr(x, 1, 1) AND substr(c, 3, 1) = substr(x, 3, 1) AND substr(c, 2, 1) <> substr(x, 2, 1) AND contains('aeiou', substr(x, 2, 1)) AND contains('aeiou', substr(c, 2, 1)) AS valid FROM (SELECT p_partkey, substr(p_name, 1, 3) AS c, CASE p_partkey % 4 WHEN 0 THEN substr(p_name, 1, 1) || 'o' || substr(p_name, 3, 1) WHEN 1 THEN substr(p_name, 1, 3) WHEN 2 THEN 'xo' || substr(p_name, 3, 1) ELSE substr(p_name, 1, 4) END AS x FROM part)")
def _(t):
    n = F.col("p_name")
    at = lambda i: F.substring(n, i, 1)
    k = F.col("p_partkey") % 4
    to = F.when(k == 0, F.concat(at(1), F.lit("o"), at(3))).when(k == 1, F.substring(n, 1, 3)).when(k == 2, F.concat(F.lit("xo"), at(3))).otherwise(F.substring(n, 1, 4))
    return t("part").select("p_partkey", X.valid_fix(F.substring(n, 1, 3), to, "aeiou").alias("valid"))


SLOT = "SELECT user_id, max(ts) AS beat, count(*) FILTER (event_type = 'error') AS tries, max_by(event_type, ts) AS last FROM events GROUP BY 1"


@query("flt_30_run_now", f"SELECT user_id, CASE WHEN last = 'view' THEN 'busy' WHEN beat >= TIMESTAMP '2024-01-30 18:00:00' THEN 'done' WHEN tries >= 14 THEN 'given up' ELSE 'run' END AS decision FROM ({SLOT})")
def _(t):
    s = t("events").groupBy("user_id").agg(F.max("ts").alias("beat"), F.count_if(F.col("event_type") == "error").alias("tries"), F.max_by("event_type", "ts").alias("last"))
    case = F.when(F.col("last") == "view", "busy").when(F.col("beat") >= F.lit("2024-01-30 18:00:00").cast("timestamp"), "done").when(F.col("tries") >= 14, "given up").otherwise("run")
    return s.select("user_id", case.alias("decision"))


@query("flt_31_rubric", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN true ELSE source = 'src5' END AS other_rule FROM documents")
def _(t):
    rubric = F.when(F.col("doc_id") % 4 == 0, "people")
    return t("documents").select("doc_id", (F.coalesce(rubric == "people", F.lit(False)) | (F.col("source") == "src5")).alias("other_rule"))


@query("prj_03_detail", "SELECT o_orderkey, o_orderpriority AS title, string_agg(l_linenumber || ' ' || l_partkey, '; ' ORDER BY l_linenumber, l_partkey, l_quantity) AS points, count(l_partkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def _(t):
    points = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("p"))
    j = t("orders").join(points, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    line = F.array_join(F.transform("p", lambda x: F.concat_ws(" ", x["l_linenumber"], x["l_partkey"])), "; ")
    return j.select("o_orderkey", F.col("o_orderpriority").alias("title"), line.alias("points"), F.coalesce(F.size("p"), F.lit(0)).cast("long").alias("n"))


@query("prj_04_card", "SELECT p_partkey, array_to_string(list_filter(list_distinct_ordered, lambda x: NOT list_contains(string_split(p_name, ' '), x)), ' ') AS hidden FROM (SELECT p_partkey, p_name, list_filter(string_split(p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) || ' ' || lower(p_type), ' '), lambda x, i: list_position(string_split(p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) || ' ' || lower(p_type), ' '), x) = i) AS list_distinct_ordered FROM part)")
def _(t):
    every = F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand"), F.lower("p_type")), " ")
    return t("part").select("p_partkey", F.array_join(F.array_except(F.array_distinct(every), F.split("p_name", " ")), " ").alias("hidden"))


@query("prj_06_channels", "SELECT p_partkey, coalesce('Brand#' || n_nationkey, 'ch-' || replace(p_name, ' ', '-')) AS channel, n_nationkey IS NULL AS residential FROM part LEFT JOIN nation ON lower(p_brand) = lower('BRAND#' || n_nationkey)")
def _(t):
    known = t("nation").select(F.lower(F.concat(F.lit("BRAND#"), "n_nationkey")).alias("_name"), F.concat(F.lit("Brand#"), "n_nationkey").alias("_id"))
    j = t("part").join(known, F.lower("p_brand") == F.col("_name"), "left")
    return j.select("p_partkey", F.coalesce("_id", F.concat(F.lit("ch-"), T.slug(F.col("p_name")))).alias("channel"), F.col("_id").isNull().alias("residential"))


@query("prj_07_share", "SELECT c_custkey, c_name || ' (' || n_name || '): ' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS share FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(t):
    j = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.select("c_custkey", F.concat("c_name", F.lit(" ("), "n_name", F.lit("): "), F.floor("c_acctbal").cast("string")).alias("share"))


@query("join_09_title_match", "WITH a AS (SELECT p_partkey, p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS title, CASE WHEN p_partkey % 3 > 0 THEN p_size * 60 END AS secs FROM part WHERE p_partkey < 400), b AS (SELECT p_partkey AS match, p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS title, CASE WHEN p_partkey % 5 > 0 THEN p_size * 60 END AS secs FROM part WHERE p_partkey >= 400), x AS (SELECT DISTINCT p_partkey, secs, unnest(string_split_regex(title, '[^0-9a-z]+')) AS w FROM a), y AS (SELECT DISTINCT match, secs, unnest(string_split_regex(title, '[^0-9a-z]+')) AS w FROM b), n AS (SELECT p_partkey, count(*) AS n FROM x WHERE length(w) > 1 GROUP BY 1), j AS (SELECT x.p_partkey, match, any_value(x.secs) AS s, any_value(y.secs) AS r, count(*) AS c FROM x JOIN y ON x.w = y.w AND length(x.w) > 1 GROUP BY 1, 2) SELECT j.p_partkey, min(match) AS match FROM j JOIN n USING (p_partkey) WHERE c >= greatest(3, CAST(floor(0.6 * n) AS BIGINT)) AND (s IS NULL OR coalesce(abs(s - r) <= 0.1 * s, false)) GROUP BY 1")
def _(t):
    p = t("part").select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand")).alias("title"), "p_size")
    a = p.where("p_partkey < 400").withColumn("secs", F.when(F.col("p_partkey") % 3 > 0, F.col("p_size") * 60))
    b = p.where("p_partkey >= 400").withColumn("secs", F.when(F.col("p_partkey") % 5 > 0, F.col("p_size") * 60)).withColumnRenamed("p_partkey", "order")
    return E.title_match(a, b, "p_partkey", "title", "secs", "order")


#: A test item whose sentences are quoted with elisions between them, and the form in which quotes and texts are compared.
QUOTE_SQL = "lower(regexp_replace({}, '[^0-9A-Za-z\\x80-\\x{{10FFFF}}]+', ' ', 'g'))"


@query("join_12_quotes", f"WITH q AS (SELECT item_id, list_filter(list_transform(string_split_regex(replace(text, '. ', ' … '), '…+|\\.{{3,}}|\\[\\.{{3}}\\]'), lambda r: trim({QUOTE_SQL.format('r')})), lambda r: length(r) >= 12) AS runs FROM benchmark), d AS (SELECT doc_id, {QUOTE_SQL.format('text')} AS hay FROM documents) SELECT doc_id, item_id FROM d JOIN q ON len(runs) > 0 AND len(list_filter(runs, lambda r: NOT contains(hay, r))) = 0")
def _(t):
    normal = lambda c: F.trim(F.lower(F.regexp_replace(c, r"[^0-9A-Za-z\x80-\x{10FFFF}]+", " ")))
    quotes = t("benchmark").select("item_id", F.replace("text", F.lit(". "), F.lit(" … ")).alias("quote"))
    return C.quoted(t("documents").select("doc_id", "text"), quotes, "doc_id", "text", "item_id", "quote", normal)


@query("join_13_listing", "WITH w AS (SELECT doc_id, source, text, lower(substr(text, 1, 24)) AS title FROM documents WHERE text IS NOT NULL), m AS (SELECT a.doc_id, count(DISTINCT b.title) AS mentions FROM w a JOIN w b ON a.source = b.source AND a.doc_id <> b.doc_id AND length(b.title) >= 18 AND contains(lower(a.text), b.title) GROUP BY 1) SELECT w.doc_id, coalesce(mentions, 0) AS mentions, CAST(length(text) AS INTEGER) AS chars, coalesce(mentions, 0) >= 3 AND length(text) < 5000 * coalesce(mentions, 0) AS listing FROM w LEFT JOIN m USING (doc_id)")
def _(t):
    d = t("documents").where("text is not null").select("doc_id", "source", "text", F.substring("text", 1, 24).alias("title"))
    return E.is_listing(C.mentions(d, d, "source", "doc_id", "text", "title"))


SEGS = "SELECT conv_id AS k, turn * 10 AS sec, g FROM (SELECT conv_id, turn, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 3))) AS g FROM conversations)"
CLAIMS = "SELECT DISTINCT conv_id AS k, turn AS claim, g FROM (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 3)) AS g FROM conversations WHERE turn % 3 = 1)"
ANCHORS = f"WITH s AS ({SEGS}), c AS ({CLAIMS}), w AS (SELECT k, unnest(range(0, 2000, 22)) AS m FROM (SELECT DISTINCT k FROM s)), h AS (SELECT c.k, c.claim, w.m, count(DISTINCT c.g) AS hits FROM c JOIN s ON s.k = c.k AND s.g = c.g JOIN w ON w.k = c.k AND abs(s.sec - w.m) <= 45 GROUP BY 1, 2, 3) SELECT k, claim, m, hits FROM h QUALIFY row_number() OVER (PARTITION BY k, claim ORDER BY hits DESC, m) = 1"


def spoken(t):
    grams = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) >= 3)
    c = t("conversations").withColumnsRenamed({"conv_id": "k", "turn": "claim"})
    words = c.select("k", "claim", F.explode(F.array_distinct(grams)).alias("g"))
    return words.select("k", (F.col("claim") * 10).alias("at"), "g"), words.where("claim % 3 = 1")


@query("join_14_best_anchor", ANCHORS)
def _(t):
    segments, claims = spoken(t)
    return E.best_anchor(segments, claims, "k", "claim", "at", "g")


@query("join_15_evidence", f"WITH a AS ({ANCHORS}), cl AS (SELECT conv_id AS k, turn AS claim, turn * 10 - turn % 7 * 20 AS cited FROM conversations WHERE turn % 3 = 1), s2 AS (SELECT conv_id AS k, turn * 10 AS sec, role AS text FROM conversations), hr AS (SELECT cl.k, cl.claim, count(DISTINCT c.g) AS here FROM cl JOIN ({CLAIMS}) c ON c.k = cl.k AND c.claim = cl.claim JOIN ({SEGS}) s ON s.k = c.k AND s.g = c.g AND abs(s.sec - cited) <= 45 GROUP BY 1, 2), pl AS (SELECT k, claim, cited AS place FROM cl UNION SELECT cl.k, cl.claim, m FROM cl JOIN a USING (k, claim) LEFT JOIN hr USING (k, claim) WHERE hits >= greatest(3, 2 * coalesce(here, 0)) AND abs(m - cited) > 45), r AS (SELECT DISTINCT pl.k, claim, sec, text FROM pl JOIN s2 ON s2.k = pl.k AND abs(sec - place) <= 45) SELECT k, claim, string_agg('[' || sec || '] ' || text, chr(10) ORDER BY sec, text) AS evidence FROM r GROUP BY 1, 2")
def _(t):
    segments, grams = spoken(t)
    c = t("conversations").withColumnsRenamed({"conv_id": "k", "turn": "claim"})
    claims = c.where("claim % 3 = 1").select("k", "claim", (F.col("claim") * 10 - F.col("claim") % 7 * 20).alias("cited"))
    at = claims.join(grams, ["k", "claim"]).withColumn("b", F.explode(F.array(*[F.floor(F.col("cited") / 45) + d for d in (-1, 0, 1)])))
    here = at.join(segments.withColumn("b", F.floor(F.col("at") / 45)), ["k", "g", "b"]).where("abs(at - cited) <= 45").groupBy("k", "claim").agg(F.count_distinct("g").alias("here"))
    return E.evidence(c.select("k", (F.col("claim") * 10).alias("at"), F.col("role").alias("text")), claims, E.best_anchor(segments, grams, "k", "claim", "at", "g"), here, "k", "claim", "at", "text")


@query("join_24_same_show", "SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), ['red', 'blue', 'ring'])) > 0 OR len(list_intersect(string_split(p_name, ' '), ['small', 'bolt'])) / len(list_distinct(string_split(p_name, ' ') || ['small', 'bolt'])) >= 0.5 AS same FROM part")
def _(t):
    w = F.split("p_name", " ")
    both = [F.array(*[F.lit(x) for x in y]) for y in (("red", "blue", "ring"), ("small", "bolt"))]
    close = F.size(F.array_intersect(w, both[1])) / F.size(F.array_union(w, both[1])) >= 0.5
    return t("part").select("p_partkey", (F.arrays_overlap(w, both[0]) | close).alias("same"))


@query("join_25_citations", "WITH live AS (SELECT p_name AS title, min('item-' || p_partkey) AS slug FROM part WHERE p_size < 45 GROUP BY 1), led AS (SELECT p_partkey, p_name AS title, slug FROM part LEFT JOIN live ON title = p_name WHERE p_size > 10) SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, title FROM lineitem LEFT JOIN led ON p_partkey = l_partkey WHERE slug IS NULL")
def _(t):
    titles = t("part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"))
    live = t("part").where("p_size < 45").select(F.col("p_name").alias("title"), F.concat(F.lit("item-"), "p_partkey").alias("slug"))
    cited = C.citations(t("lineitem"), titles, live, "l_partkey", "title", "slug", by=["l_orderkey", "l_linenumber"])
    return C.unresolved(cited, "slug").select("l_orderkey", "l_linenumber", "l_partkey", "title")



@query("agg_13_labels", "SELECT source, label, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(text, '\\S*[à-ü]\\S*')) AS label FROM documents) GROUP BY 1, 2 HAVING count(*) >= 3")
def _(t):
    # Labels that aren't plain Latin, by source.
    x = t("documents").select("source", F.explode(F.regexp_extract_all("text", F.lit(r"[^\t\n\f\r ]*[à-ü][^\t\n\f\r ]*"), 0)).alias("label"))
    return x.groupBy("source", "label").agg(F.count("*").alias("n")).where("n >= 3")


@query("agg_27_leaks", "SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '>([^<>]{3,40})<', 1)) AS piece FROM pages) WHERE regexp_matches(piece, '^[A-Z]') GROUP BY 1 HAVING count(*) >= 2")
def _(t):
    x = t("pages").select(F.explode(F.regexp_extract_all("html", F.lit(">([^<>]{3,40})<"), 1)).alias("piece"))
    return x.where(F.col("piece").rlike("^[A-Z]")).groupBy("piece").agg(F.count("*").alias("n")).where("n >= 2")


@query("agg_28_contexts", "WITH c AS (SELECT p_name, i, substr(' ' || p_name || ' ', i, 3) AS ctx FROM (SELECT p_name, unnest(range(1, length(p_name) + 1)) AS i FROM (SELECT DISTINCT p_name FROM part)) WHERE contains('aeiou', substr(p_name, i, 1))), e AS (SELECT DISTINCT ctx, p_name FROM c QUALIFY dense_rank() OVER (PARTITION BY ctx ORDER BY p_name) <= 2) SELECT c.ctx, count(*) AS n, (SELECT string_agg(p_name, '|' ORDER BY p_name) FROM e WHERE e.ctx = c.ctx) AS examples FROM c GROUP BY c.ctx")
def _(t):
    names = t("part").select("p_name").distinct()
    chars = names.select("p_name", F.explode(F.sequence(F.lit(1), F.length("p_name"))).alias("i")).where(F.contains(F.lit("aeiou"), F.col("p_name").substr(F.col("i"), F.lit(1))))
    c = chars.select("p_name", F.concat(F.lit(" "), "p_name", F.lit(" ")).substr(F.col("i"), F.lit(3)).alias("ctx"))
    # Distinct examples are numbered before they are gathered, so a context never holds more than two.
    first = R.newest_per(c.distinct(), "ctx", [F.col("p_name")], 2).groupBy("ctx").agg(F.array_join(F.array_sort(F.collect_list("p_name")), "|").alias("examples"))
    return c.groupBy("ctx").agg(F.count("*").alias("n")).join(first, "ctx")


@query("win_01_rank", "SELECT user_id, CAST(row_number() OVER (ORDER BY n DESC, latest DESC, user_id) AS INTEGER) AS rank FROM (SELECT user_id, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1)")
def _(t):
    s = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))
    order = [F.col("n").desc(), F.col("latest").desc(), F.col("user_id")]
    return R.placed(s, order, [(F.col("n"), True), (F.to_date("latest"), True)], "rank").select("user_id", F.col("rank").cast("int").alias("rank"))


@query("win_17_failures", "WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' OR event_type = 'view' AS bad FROM events), i AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM e) SELECT user_id, max_by(s, (ts, event_id)) AS streak, max(s) AS longest FROM (SELECT user_id, ts, event_id, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id) AS BIGINT) AS s FROM i) GROUP BY 1")
def _(t):
    s = R.streaks(t("events").select("user_id", "event_id", "ts", "event_type"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type").isin("error", "view"))
    return s.groupBy("user_id").agg(F.max_by("streak", F.struct("ts", "event_id")).cast("long").alias("streak"), F.max("streak").cast("long").alias("longest"))


@query("win_20_rank_ties", "WITH r AS (SELECT p_partkey, p_brand, p_size, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS g FROM part) SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, g) AS INTEGER) AS place FROM r QUALIFY place <= 5")
def _(t):
    # The tie-break is the global rank's own order, so nothing need be ranked globally.
    return R.newest_per(t("part"), "p_brand", [F.col("p_size").desc(), F.col("p_retailprice").desc(), F.col("p_partkey")], 5, "place").select("p_brand", "p_partkey", "place")


@query("stf_06_hallucinations", "WITH n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn FROM n WHERE NOT (n <= 5 AND (length(text) < 120 OR regexp_matches(lower(text), '^(thank|the|subscribe)')))")
def _(t):
    x = t("conversations").withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    junk = (F.length("text") < 120) | F.lower("text").rlike("^(thank|the|subscribe)")
    return x.where(~((F.col("n") <= 5) & junk)).select("conv_id", "turn")


@query("srt_02_stable", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY floor(value / 50) DESC, ts, event_id) AS INTEGER) AS place FROM events")
def _(t):
    w = Window.partitionBy("user_id").orderBy(F.floor(F.col("value") / 50).desc(), "ts", "event_id")  # arrival keeps the sort stable
    return t("events").select("user_id", "event_id", F.row_number().over(w).alias("place"))


@query("srt_05_official_first", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderstatus") != "F", F.col("o_orderdate").desc(), "o_orderkey")
    return t("orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"))


@query("srt_06_unverified_first", "SELECT source, d.doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY l.doc_id IS NOT NULL, d.doc_id) AS INTEGER) AS place FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(t):
    j = t("documents").select("source", "doc_id").join(t("labels").select("doc_id", F.lit(True).alias("_known")), "doc_id", "left")
    w = Window.partitionBy("source").orderBy(F.col("_known").isNotNull(), "doc_id")
    return j.select("source", "doc_id", F.row_number().over(w).alias("place"))


@query("srt_07_log", "SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id) AS INTEGER) AS place FROM events")
def _(t):
    w = Window.partitionBy("event_type", F.to_date("ts")).orderBy(F.col("ts").desc(), "event_id")
    return t("events").select("event_type", "event_id", F.row_number().over(w).alias("place"))


@query("srt_08_clamped", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= greatest(1, least(o_custkey % 60 - 5, 50))")
def _(t):
    x = t("orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")))
    return x.where(F.col("n") <= F.greatest(F.lit(1), F.least(F.col("o_custkey") % 60 - 5, F.lit(50)))).select("o_custkey", "o_orderkey")


@query("set_07_paths", "SELECT DISTINCT path FROM (SELECT 'p/' || p_brand || '/' || p_size AS path FROM part UNION ALL SELECT 'i/' || p_brand || '/' || p_partkey FROM part) WHERE path GLOB 'p/Brand#1*/[0-4]*' OR path GLOB 'i/Brand#2?/1*'")
def _(t):
    # A pattern with wild cards becomes one regular expression.
    p = t("part")
    paths = p.select(F.concat_ws("/", F.lit("p"), "p_brand", "p_size").alias("path")).union(p.select(F.concat_ws("/", F.lit("i"), "p_brand", "p_partkey")))
    return paths.where(F.col("path").rlike("|".join(X.glob(g) for g in ("p/Brand#1*/[0-4]*", "i/Brand#2?/1*")))).distinct()
