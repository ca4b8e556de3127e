"""Queries of the remaining aggregations, windows, sorts, sets and folds. The day of judgement is fixed; nothing reads the clock."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rankings as K
from ..operators import relational as R
from ..operators import selection as SEL
from ..operators import stateful as S
from .queries import newest, query


@query("agg_05_candidate_cadence", "WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders), g AS (SELECT o_custkey, datediff('day', lead(day) OVER w, day) AS gap, row_number() OVER w AS rn FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY day DESC)), l AS (SELECT o_custkey, list_sort(list(gap)) AS gaps FROM g WHERE rn < 10 AND gap IS NOT NULL GROUP BY 1) SELECT o_custkey, CAST(gaps[len(gaps) // 2 + 1] AS INTEGER) AS cadence, CAST(gaps[len(gaps)] AS INTEGER) AS max_gap FROM l")
def _(t):
    return R.upper_median_gap(t("orders").select("o_custkey", F.to_date("o_orderdate").alias("day")), "o_custkey", "day", 10)


@query("agg_07_overrun", "SELECT l_orderkey, CAST(max(l_quantity) AS BIGINT) - 40 AS excess, max(l_quantity) > 45 AS severe FROM lineitem GROUP BY 1 HAVING max(l_quantity) > 40")
def _(t):
    ends = t("lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("end")).where("end > 40")
    return ends.select("l_orderkey", (F.col("end").cast("long") - 40).alias("excess"), (F.col("end") > 45).alias("severe"))


@query("agg_09_week_usage", "SELECT event_type, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS used FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-23' AND CAST(ts AS DATE) <= DATE '2024-01-30' GROUP BY 1 ORDER BY used DESC, event_type LIMIT 3")
def _(t):
    week = t("events").where(F.to_date("ts").between("2024-01-24", "2024-01-30"))
    return week.groupBy("event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("used")).orderBy(F.col("used").desc(), "event_type").limit(3)


@query("agg_10_shows", "SELECT source, count(*) AS n, max(doc_id) AS latest, any_value(lang) FILTER (lang IS NOT NULL) IS NOT NULL AS has_lang FROM documents GROUP BY 1 ORDER BY n DESC, source")
def _(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("latest"), F.bool_or(F.col("lang").isNotNull()).alias("has_lang")).orderBy(F.col("n").desc(), "source")


@query("agg_11_point_spread", "SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS times, datediff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) AS span FROM events GROUP BY 1")
def _(t):
    day = F.to_date("ts")
    return t("events").groupBy("user_id").agg(F.count_distinct(day).alias("times"), F.datediff(F.max(day), F.min(day)).cast("long").alias("span"))


@query("agg_12_speaker_leads", "SELECT word, n FROM (SELECT word, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE length(word) >= 4 GROUP BY 1 HAVING count(*) >= 3) ORDER BY n DESC, first")
def _(t):
    w = t("part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")).where("length(word) >= 4")
    g = w.groupBy("word").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n >= 3")
    return g.orderBy(F.col("n").desc(), "first").select("word", "n")


@query("agg_14_claim_share", "WITH e AS (SELECT event_id, event_type = 'purchase' AS claim, row_number() OVER (ORDER BY ts DESC, event_id) AS rn FROM events) SELECT round(avg(claim::INT), 6) AS overall, round(avg(claim::INT) FILTER (rn <= 30), 6) AS latest FROM e")
def _(t):
    claim = (F.col("event_type") == "purchase").cast("double")
    latest = t("events").orderBy(*newest()).limit(30).agg(F.round(F.avg(claim), 6).alias("latest"))
    # Both sides are one row.
    return t("events").agg(F.round(F.avg(claim), 6).alias("overall")).join(F.broadcast(latest), F.lit(True))


@query("agg_22_last_touch", "SELECT k, max(at_day) AS at_day FROM (SELECT user_id AS k, CAST(ts AS DATE) AS at_day FROM events UNION ALL SELECT o_custkey, CAST(o_orderdate AS DATE) FROM orders) GROUP BY 1")
def _(t):
    e = t("events").select(F.col("user_id").alias("k"), F.to_date("ts").alias("at_day"))
    return e.unionByName(t("orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("at_day"))).groupBy("k").agg(F.max("at_day").alias("at_day"))


@query("agg_23_catchup_rounds", "SELECT count(DISTINCT user_id) AS rounds, count(*) FILTER (event_type = 'purchase') AS published, CASE WHEN count(DISTINCT user_id) >= 4 AND count(*) FILTER (event_type = 'purchase') = 0 THEN 'fail' ELSE 'ok' END AS level FROM events WHERE ts >= TIMESTAMP '2024-01-28'")
def _(t):
    g = t("events").where(F.to_date("ts") >= "2024-01-28").agg(F.count_distinct("user_id").alias("rounds"), F.count_if(F.col("event_type") == "purchase").alias("published"))
    return g.withColumn("level", F.when((F.col("rounds") >= 4) & (F.col("published") == 0), "fail").otherwise("ok"))


@query("agg_24_last_runs", "WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) SELECT user_id, event_type AS outcome, count(*) AS n FROM r WHERE rn <= 4 GROUP BY 1, 2")
def _(t):
    last = R.newest_per(t("events").select("user_id", "event_type", "ts", "event_id"), "user_id", newest(), 4)
    return last.groupBy("user_id", F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"))


@query("agg_25_single_origin", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1 AND min(o_orderstatus) = 'F'")
def _(t):
    # Equality of sets without collecting them: the least and the greatest member agree.
    g = t("orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("a"), F.max("o_orderstatus").alias("z"))
    return g.where("a = 'F' AND z = 'F'").select("o_custkey")


@query("agg_26_local_only", "SELECT c_custkey, n, local, n > 0 AND n = local AS routed FROM (SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS local FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def _(t):
    j = t("customer").select("c_custkey").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    g = j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("local"))
    return g.withColumn("routed", (F.col("n") > 0) & (F.col("n") == F.col("local")))


@query("agg_29_outcomes", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def _(t):
    return t("labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("agg_30_hot_ids", "SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 24")
def _(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id").limit(24).select("user_id")


@query("agg_33_failing_sources", "SELECT count(*) FILTER (bad >= 3) AS failing, count(*) AS n FROM (SELECT user_id, count(*) FILTER (event_type = 'error' AND ts >= TIMESTAMP '2024-01-25') AS bad FROM events GROUP BY 1)")
def _(t):
    bad = t("events").groupBy("user_id").agg(F.count_if((F.col("event_type") == "error") & (F.to_date("ts") >= "2024-01-25")).alias("bad"))
    return bad.agg(F.count_if(F.col("bad") >= 3).alias("failing"), F.count("*").alias("n"))


@query("agg_34_late_hot", "WITH h AS (SELECT user_id, count(*) AS n, max(ts) FILTER (event_type = 'purchase') AS done, max(ts) AS latest FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 24) SELECT user_id, coalesce(datediff('day', CAST(done AS DATE), CAST(latest AS DATE)) > 3, true) AS late FROM h")
def _(t):
    h = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("event_type") == "purchase", F.to_date("ts"))).alias("done"), F.max(F.to_date("ts")).alias("latest"))
    return h.orderBy(F.col("n").desc(), "user_id").limit(24).select("user_id", F.coalesce(F.datediff("latest", "done") > 3, F.lit(True)).alias("late"))


@query("agg_35_unverified", "SELECT count(*) FILTER (NOT (quality = 1)) AS unverified FROM labels")
def _(t):
    return t("labels").agg(F.count_if(F.col("quality") != 1).alias("unverified"))


@query("agg_36_new_window", "SELECT greatest(12, count(*) FILTER (ts >= TIMESTAMP '2024-01-23')) AS new_window, least(greatest(12, count(*) FILTER (ts >= TIMESTAMP '2024-01-23')), count(*)) AS inline FROM events")
def _(t):
    week = F.greatest(F.lit(12).cast("long"), F.count_if(F.to_date("ts") >= "2024-01-23"))
    return t("events").agg(week.alias("new_window"), F.least(week, F.count("*")).alias("inline"))


@query("agg_37_core_count", "SELECT count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def _(t):
    return t("events").join(t("customer").where("c_nationkey < 5"), F.col("user_id") == F.col("c_custkey"), "left_semi").agg(F.count("*").alias("n"))


@query("agg_38_untried_reasons", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN c_acctbal < 0 THEN 'broken' WHEN c_nationkey > 20 THEN 'far' ELSE 'quiet' END AS reason FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) GROUP BY 1")
def _(t):
    untried = t("customer").join(t("orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return untried.groupBy(F.when(F.col("c_acctbal") < 0, "broken").when(F.col("c_nationkey") > 20, "far").otherwise("quiet").alias("reason")).agg(F.count("*").alias("n"))


@query("agg_39_person_counts", "SELECT user_id, count(*) AS n, count(*) FILTER (value > 100) AS strong FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1")
def _(t):
    return t("events").where("event_type IN ('view', 'purchase')").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("strong"))


@query("win_03_first_n", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 25")
def _(t):
    return R.newest_per(t("events").select("user_id", "event_id", "ts"), "user_id", newest(), 25).select("user_id", "event_id")


@query("win_07_first_label", "WITH x AS (SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS t, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, t, first FROM x QUALIFY count(*) OVER (PARTITION BY l_orderkey) >= 3")
def _(t):
    # The least position of each time is an aggregate; only the count needs a window.
    x = t("lineitem").groupBy("l_orderkey", F.col("l_quantity").cast("int").alias("t")).agg(F.min("l_linenumber").alias("first"))
    return x.withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey"))).where("n >= 3").select("l_orderkey", "t", "first")


@query("win_09_gap", "SELECT event_id, datediff('day', CAST(lag(ts) OVER w AS DATE), CAST(ts AS DATE)) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", F.datediff(F.to_date("ts"), F.to_date(F.lag("ts").over(w))).cast("long").alias("gap"))


@query("win_11_retention", "WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events) SELECT user_id, day FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) <= 10")
def _(t):
    d = t("events").select("user_id", F.to_date("ts").alias("day")).distinct()
    return R.newest_per(d, "user_id", [F.col("day").desc()], 10).select("user_id", "day")


@query("win_13_spread_sample", "SELECT doc_id, f, substr(text, CAST(floor(length(text) * f / 100) AS INTEGER) + 1, 40) AS piece FROM documents, (SELECT unnest([4, 12, 20, 28, 36, 44, 52, 60, 68, 76, 84, 92]) AS f)")
def _(t):
    n, at = F.length("text"), F.array(*[F.lit(f) for f in range(4, 96, 8)])
    return t("documents").select("doc_id", "text", n.alias("n"), F.explode(at).alias("f")).select("doc_id", "f", F.substring(F.col("text"), (F.floor(F.col("n") * F.col("f") / 100) + 1).cast("int"), F.lit(40)).alias("piece"))


@query("win_15_fair_cap", "WITH p AS (SELECT l_orderkey AS k, CAST(l_quantity AS BIGINT) AS q FROM lineitem), r AS (SELECT *, sum(q) OVER (PARTITION BY k ORDER BY q ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY k ORDER BY q) AS rn, count(*) OVER (PARTITION BY k) AS n FROM p) SELECT k, greatest(10, coalesce(min((80 - (run - q)) // (n - rn + 1)) FILTER (q * (n - rn + 1) > 80 - (run - q)), max(q))) AS cap FROM r GROUP BY 1")
def _(t):
    return R.fair_cap(t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("long").alias("q")), "k", "q", 80, 10)


@query("win_18_regrouped", "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i FROM lineitem) SELECT l_orderkey, CAST(i // 3 AS BIGINT) AS block, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY i) AS parts FROM r GROUP BY 1, 2")
def _(t):
    x = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return R.regroup(x, "l_orderkey", ["l_linenumber", "l_partkey", "l_quantity"], "l_partkey", 3).withColumnRenamed("text", "parts")


@query("win_19_newest_cut", "WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, CAST(max(o_orderkey) AS BIGINT) AS top, count(*) AS n FROM r WHERE rn <= 5 GROUP BY 1")
def _(t):
    x = R.newest_per(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey")], 5)
    return x.groupBy("o_custkey").agg(F.max("o_orderkey").alias("top"), F.count("*").alias("n"))


@query("srt_03_newest_null_last", "SELECT c_custkey, max(o_orderdate) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY latest DESC NULLS LAST, c_custkey LIMIT 100")
def _(t):
    j = t("customer").select("c_custkey").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("c_custkey").agg(F.max("o_orderdate").alias("latest")).orderBy(F.desc_nulls_last("latest"), "c_custkey").limit(100)


@query("srt_04_registry_order", "SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC, s_name) AS place FROM supplier")
def _(t):
    order = [F.col("s_nationkey"), F.col("s_acctbal").desc(), F.col("s_name")]
    return R.placed(t("supplier"), order, [(F.col("s_nationkey"), False), (F.floor("s_acctbal"), True)], "place").select("s_suppkey", "place")


@query("srt_10_latest_in_category", "SELECT event_id FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id LIMIT 50")
def _(t):
    return t("events").where("event_type = 'view'").orderBy(*newest()).limit(max(1, min(99, 50))).select("event_id")


@query("set_03_ledger_on_disk", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(t):
    return t("documents").select("doc_id").intersect(t("labels").select("doc_id"))


@query("set_06_pools", "SELECT s_name AS name, s_acctbal AS bal, NULL AS kind FROM supplier UNION ALL SELECT p_name, NULL, p_type FROM part")
def _(t):
    a = t("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return a.unionByName(t("part").select(F.col("p_name").alias("name"), F.col("p_type").alias("kind")), allowMissingColumns=True)


@query("set_08_tree_difference", "SELECT k, 'left' AS side FROM (SELECT l_partkey AS k FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size < 40) UNION ALL SELECT k, 'right' FROM (SELECT p_partkey AS k FROM part WHERE p_size < 40 EXCEPT SELECT l_partkey FROM lineitem)")
def _(t):
    a, b = t("lineitem").select(F.col("l_partkey").alias("k")), t("part").where("p_size < 40").select(F.col("p_partkey").alias("k"))
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


BLOCKS = """WITH RECURSIVE e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
b AS (SELECT user_id, 0 AS block, min(s) AS start FROM e GROUP BY 1
 UNION ALL SELECT b.user_id, b.block + 1, min(e.s) FROM b JOIN e ON e.user_id = b.user_id AND e.s >= b.start + 86400 GROUP BY b.user_id, b.block)
SELECT b.user_id, CAST(b.block AS BIGINT) AS block, b.start, CAST(sum(e.n) AS BIGINT) AS n FROM e ASOF JOIN b ON e.user_id = b.user_id AND e.s >= b.start GROUP BY 1, 2, 3"""


@query("stf_03_blocks", BLOCKS)
def _(t):
    e = t("events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return S.blocks(e, "user_id", "s", 86400)


# Each turn's rows by place; then a walk over (turn, place) with what has been taken: a turn ends at its quota or its last row.
SPREAD = """WITH RECURSIVE c AS (SELECT event_id, user_id, event_type, CAST(trunc(value * 100) AS BIGINT) AS score, user_id % 10 = 0 AS starved, user_id % 7 = 0 AS followed, CASE WHEN user_id % 4 > 0 THEN user_id % 13 END AS touched,
  event_id % 5 AS lost, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1 AS newest, user_id % 21 = 0 AS pinned FROM events),
f AS (SELECT * FROM (VALUES (2, 'error'), (3, 'purchase'), (4, 'signup')) v(turn, cat)),
a AS MATERIALIZED (SELECT 0 AS turn, row_number() OVER (ORDER BY touched NULLS FIRST, score DESC, event_id) AS place, event_id, user_id, event_type FROM c WHERE starved
  UNION ALL SELECT 1, row_number() OVER (ORDER BY lost DESC, newest DESC, pinned DESC, score DESC, event_id), event_id, user_id, event_type FROM c WHERE followed
  UNION ALL SELECT f.turn, row_number() OVER (PARTITION BY f.turn ORDER BY score DESC, event_id), event_id, user_id, event_type FROM c JOIN f ON f.cat = c.event_type
  UNION ALL SELECT 5, row_number() OVER (ORDER BY score DESC, event_id), event_id, user_id, event_type FROM c),
q AS (SELECT * FROM (VALUES (0, 20), (1, 6), (2, 2), (3, 2), (4, 2), (5, 40)) v(turn, quota)),
s(turn, place, n, items, sources, got) AS (SELECT 0, CAST(1 AS BIGINT), 0, []::BIGINT[], []::BIGINT[], CAST(NULL AS BIGINT)
  UNION ALL SELECT CASE WHEN over THEN turn + 1 ELSE turn END, CASE WHEN over THEN 1 ELSE place + 1 END, CASE WHEN over THEN 0 WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok THEN list_append(items, event_id) ELSE items END, CASE WHEN ok THEN list_append(sources, user_id) ELSE sources END, CASE WHEN ok THEN event_id END
  FROM (SELECT s.*, a.event_id, CAST(a.user_id AS BIGINT) AS user_id, a.event_id IS NULL OR s.n >= q.quota AS over, a.event_id IS NOT NULL AND s.n < q.quota AND NOT list_contains(items, a.event_id) AND len(list_filter(sources, lambda x: x = a.user_id)) < 2 AS ok
        FROM s JOIN q ON q.turn = s.turn LEFT JOIN a ON a.turn = s.turn AND a.place = s.place WHERE len(s.items) < 40))
SELECT c.event_id, c.user_id, c.event_type, ['starved', 'followed', 'floor error', 'floor purchase', 'floor signup', 'rank'][s.turn + 1] AS turn, CAST(len(s.items) AS INTEGER) AS place FROM s JOIN c ON c.event_id = s.got"""


@query("stf_04_spread", SPREAD)
def _(t):
    e = t("events")
    newest = e.groupBy("user_id").agg(F.min_by("event_id", F.struct(-F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id"))).alias("newest"))
    c = e.join(newest, "user_id").withColumn("score", (F.col("value") * 100).cast("long"))
    u = F.col("user_id")
    before = SEL.turns(40, starved=u % 10 == 0, touched=F.when(u % 4 > 0, u % 13), followed=u % 7 == 0, lost=F.col("event_id") % 5, newest=F.col("event_id") == F.col("newest"), pinned=u % 21 == 0)
    before[1] = replace(before[1], quota=6)  # so that the later turns have something to do at every size
    return SEL.choose(c, "event_id", "user_id", "event_type", [(F.col("score"), True), (F.col("event_id"), False)], before, limit=40, floors=["error", "purchase", "signup"])


CHUNKS = """WITH RECURSIVE r AS (SELECT doc_id, text, 0 AS pos, 0 AS a, 0 AS b FROM documents WHERE text <> ''
 UNION ALL SELECT doc_id, text, pos + 1, b, CASE WHEN b + 4000 < length(text) AND contains(substr(text, b + 2001, 2000), chr(10)) THEN b + 3999 - length(string_split(substr(text, b + 2001, 2000), chr(10))[-1]) ELSE b + 4000 END
 FROM r WHERE b < length(text))
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, substr(text, a + 1, b - a) AS piece FROM r WHERE pos > 0"""


@query("stf_05_chunks", CHUNKS)
def _(t):
    return S.chunks(t("documents").select("doc_id", "text"), "doc_id", "text", 4000, "\n")


SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS until, count(*) AS n FROM s GROUP BY user_id, i"""


@query("str_08_sessions", SESSIONS)
def _(t):
    e = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy(F.session_window("ts", "2 hours").alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("until"), "n")


@query("flt_01_rules", "WITH i AS (SELECT doc_id, source, text, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 365 AS INTEGER)) AS pub, CASE WHEN doc_id % 3 > 0 THEN n_chars END AS secs FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pub DESC, doc_id) AS rn FROM i) SELECT doc_id, source FROM f WHERE rn <= 60 AND pub >= TIMESTAMP '2024-12-01' AND NOT contains(lower(coalesce(text, '')), 'thation') AND NOT contains(lower(coalesce(text, '')), 'chung') AND (coalesce(secs, 0) = 0 OR secs >= 480) AND coalesce(secs, 0) <= 6000")
def _(t):
    d = t("documents").select("doc_id", "source", "text", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).cast("timestamp").alias("at"), F.when(F.col("doc_id") % 3 > 0, F.col("n_chars")).alias("secs"))
    found = K.candidates(d, "source", [F.col("at").desc(), F.col("doc_id")], title="text", published="at", seconds="secs", now=F.lit("2024-12-31").cast("timestamp"), days=30, skip=("Thation", "chung"), minutes=100)
    return found.select("doc_id", "source")


@query("agg_02_pinned_first", "WITH h AS (SELECT user_id, count(*) AS n, count(*) FILTER (CAST(ts AS DATE) >= DATE '2024-01-23') AS recent, max(ts) AS ts FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL GROUP BY 1), k AS (SELECT c_custkey, c_custkey % 97 = 0 AS pinned, n, recent, CAST(ts AS DATE) AS latest, ts FROM customer JOIN h ON user_id = c_custkey WHERE c_custkey % 97 = 0 OR CAST(ts AS DATE) >= DATE '2023-12-01'), p AS (SELECT *, CAST(row_number() OVER (ORDER BY pinned DESC, n DESC, latest DESC, ts DESC, c_custkey) AS INTEGER) AS place FROM k) SELECT c_custkey, pinned, n, recent, latest, place FROM p WHERE pinned OR place <= 24")
def _(t):
    registry = t("customer").select("c_custkey", (F.col("c_custkey") % 97 == 0).alias("pin"))
    return K.hot_sources(t("events"), registry, "user_id", "ts", "c_custkey", "pin", today=F.lit("2024-01-30").cast("date"))
