"""Queries of the ledger rules: attempts are a customer's events, sources are customers, verdicts are labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ledgers as L
from .queries import query

ATTEMPTS = "SELECT user_id, count(*) FILTER (event_type = 'error') % 5 AS hard, count(*) FILTER (event_type = 'view') % 10 AS soft, max(CAST(ts AS DATE)) FILTER (event_type = 'error') AS day, CASE user_id % 4 WHEN 0 THEN 'throttled' WHEN 1 THEN 'too-long' WHEN 2 THEN 'no-text' END AS why FROM events GROUP BY user_id"


def day():
    """The day of judgement."""
    return F.lit("2024-01-31").cast("date")


def attempts(t):
    kind = F.col("event_type")
    why = F.when(F.col("user_id") % 4 == 0, "throttled").when(F.col("user_id") % 4 == 1, "too-long").when(F.col("user_id") % 4 == 2, "no-text")
    a = t("events").groupBy("user_id").agg((F.count_if(kind == "error") % 5).alias("hard"), (F.count_if(kind == "view") % 10).alias("soft"), F.max(F.when(kind == "error", F.to_date("ts"))).alias("day"))
    return a.withColumn("why", why)


@query("flt_02_scope", "SELECT c_custkey FROM customer WHERE (c_custkey IN (1, 5, 9) OR c_mktsegment = 'BUILDING') AND c_nationkey < 5")
def _(t):
    return t("customer").where((F.col("c_custkey").isin(1, 5, 9) | (F.col("c_mktsegment") == "BUILDING")) & (F.col("c_nationkey") < 5)).select("c_custkey")


@query("flt_03_unfinished", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR l.toxic = 1")
def _(t):
    ledger = t("labels").select("doc_id", F.lit(True).alias("_done"), (F.col("toxic") == 1).alias("_stale"))
    return t("documents").select("doc_id").join(ledger, "doc_id", "left").where("_done IS NULL OR _stale").select("doc_id")


@query("flt_04_core_block", "SELECT c_custkey, c_mktsegment = 'HOUSEHOLD' OR (c_nationkey > 3 AND coalesce(c_acctbal <= 300, false)) AS blocked FROM customer")
def _(t):
    kind = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "advertising").otherwise("talk")
    return t("customer").select("c_custkey", L.core_blocked(kind, F.col("c_nationkey") <= 3, F.col("c_acctbal"), 300).alias("blocked"))


@query("flt_05_retry_budget", f"SELECT user_id, hard >= 3 OR (soft >= 8 AND NOT coalesce(datediff('day', day, DATE '2024-01-31') >= 7, true)) AS exhausted FROM ({ATTEMPTS})")
def _(t):
    return attempts(t).select("user_id", L.exhausted(F.col("hard"), F.col("soft"), F.col("day"), day()).alias("exhausted"))


@query("flt_06_weaker_tiers", "SELECT o_orderkey, CASE WHEN had IS NULL THEN true ELSE had < 3 END AS void FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_returnflag) AS had FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(t):
    had = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("had"))
    now = F.array(*[F.lit(x) for x in "ANR"])
    j = t("orders").select("o_orderkey").join(had, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", L.weaker_tiers(F.col("had"), now, "A").alias("void"))


@query("flt_08_retry", f"SELECT user_id, NOT (coalesce(why = 'too-long', false) OR hard >= 3 OR soft >= 8 OR (NOT coalesce(why = 'throttled', false) AND hard + soft >= 3)) AND coalesce(datediff('day', day, DATE '2024-01-31') >= CASE WHEN why = 'throttled' THEN 2 ELSE 7 END, true) AS again FROM ({ATTEMPTS})")
def _(t):
    return attempts(t).select("user_id", L.retry_allowed(F.col("why"), F.col("hard"), F.col("soft"), F.col("day"), day()).alias("again"))


@query("flt_10_prerequisites", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'no feed' WHEN s_nationkey > 20 THEN 'language' WHEN s_acctbal < 1000 THEN 'too few' END AS why FROM supplier")
def _(t):
    b = F.col("s_acctbal")
    return t("supplier").select("s_suppkey", L.first_reason([(b < 0, "no feed"), (F.col("s_nationkey") > 20, "language"), (b < 1000, "too few")]).alias("why"))


@query("flt_11_generated_marks", r"SELECT doc_id, regexp_matches(text, '(?i)(all rights reserved|licen[cs]e|\bapi_key\b)') AS marked FROM documents")
def _(t):
    return t("documents").select("doc_id", F.col("text").rlike(r"(?i)(all rights reserved|licen[cs]e|\bapi_key\b)").alias("marked"))


@query("flt_12_expected_block", "SELECT event_id, event_type = 'error' AND CAST(props->>'k' AS INTEGER) IN (1, 3, 29) AND user_id % 3 = 0 AS expected FROM events")
def _(t):
    code = F.get_json_object("props", "$.k").cast("int")
    return t("events").select("event_id", ((F.col("event_type") == "error") & code.isin(1, 3, 29) & (F.col("user_id") % 3 == 0)).alias("expected"))


@query("flt_14_red", f"SELECT user_id, CASE WHEN why = 'too-long' THEN 'too-long' WHEN soft >= 2 THEN 'lost' WHEN datediff('day', day, DATE '2024-01-31') > 3 THEN 'late' END AS red FROM ({ATTEMPTS})")
def _(t):
    checks = [(F.col("why") == "too-long", "too-long"), (F.col("soft") >= 2, "lost"), (L.age_days(F.col("day"), day()) > 3, "late")]
    return attempts(t).select("user_id", L.first_reason(checks).alias("red"))


@query("flt_15_dead", f"SELECT user_id, why FROM ({ATTEMPTS}) WHERE hard >= 3 AND user_id IN (SELECT c_custkey FROM customer) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = user_id AND why = 'no-text')")
def _(t):
    ledger = attempts(t).select("user_id", F.col("hard").alias("n"), "why")
    accepted = t("supplier").select(F.col("s_suppkey").alias("user_id"), F.lit("no-text").alias("why"))
    return L.dead(ledger, t("customer").select(F.col("c_custkey").alias("user_id")), accepted, "user_id").select("user_id", "why")


@query("flt_24_cooldown", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' AND l_returnflag = 'R') AND p_name NOT IN (SELECT p_name FROM part WHERE p_size = 3)")
def _(t):
    recent = t("lineitem").where("l_shipdate >= TIMESTAMP '1998-06-01' AND l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    names = t("part").where("p_size = 3").select("p_name").distinct()
    return t("part").join(recent, "p_partkey", "left_anti").join(names, "p_name", "left_anti").select("p_partkey")


@query("flt_25_throttled_now", f"SELECT user_id, coalesce(why = 'throttled', false) AND coalesce(day >= DATE '2024-01-29', false) AS throttled FROM ({ATTEMPTS})")
def _(t):
    yes = F.coalesce(F.col("why") == "throttled", F.lit(False)) & F.coalesce(F.col("day") >= F.lit("2024-01-29").cast("date"), F.lit(False))
    return attempts(t).select("user_id", yes.alias("throttled"))


@query("flt_26_replacement", "SELECT p_partkey, p_size <= 30 AND coalesce(p_size < nullif(p_partkey % 50, 0), true) AS better FROM part")
def _(t):
    return t("part").select("p_partkey", L.replacement_is_better(F.nullif(F.col("p_partkey") % 50, F.lit(0)), F.col("p_size"), 30).alias("better"))


@query("rul_03_demote", "SELECT c_custkey, CASE WHEN base < 3 THEN base + 1 END AS tier FROM (SELECT c_custkey, CAST(c_nationkey % 3 + 1 AS INTEGER) AS base FROM customer WHERE c_acctbal < 0)")
def _(t):
    return t("customer").where("c_acctbal < 0").select("c_custkey", L.demoted((F.col("c_nationkey") % 3 + 1).cast("int")).alias("tier"))


@query("rul_04_restore", "SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-04-01') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000)")
def _(t):
    o = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    alive = o.where("o_orderdate >= TIMESTAMP '2001-04-01'").select("c_custkey")
    judged = o.where("o_orderstatus = 'P' AND o_totalprice > 400000").select("c_custkey")
    return t("customer").where("c_acctbal >= 0").select("c_custkey").join(alive, "c_custkey", "left_semi").join(judged, "c_custkey", "left_anti")


@query("rul_07_outcome", "SELECT doc_id, CASE WHEN rn > 1 THEN 'duplicate' WHEN toxic = 1 THEN 'off-brief' WHEN n_chars < 200 THEN 'no-transcript' WHEN n_chars > 50000 THEN 'too-long' WHEN quality IS NULL THEN 'review-unavailable' WHEN quality = 0 THEN 'below-bar' ELSE 'published' END AS outcome FROM (SELECT d.doc_id, d.n_chars, l.quality, l.toxic, row_number() OVER (PARTITION BY sha1(d.text) ORDER BY d.doc_id) AS rn FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")
def _(t):
    d = t("documents").select("doc_id", "n_chars", F.sha1(F.col("text").cast("binary")).alias("fp"))
    first = d.groupBy("fp").agg(F.min("doc_id").alias("first"))
    j = d.join(first, "fp").join(t("labels"), "doc_id", "left")
    checks = [(F.col("doc_id") != F.col("first"), "duplicate"), (F.col("toxic") == 1, "off-brief"), (F.col("n_chars") < 200, "no-transcript"), (F.col("n_chars") > 50000, "too-long"), (F.col("quality").isNull(), "review-unavailable"), (F.col("quality") == 0, "below-bar")]
    return j.select("doc_id", F.coalesce(L.first_reason(checks), F.lit("published")).alias("outcome"))


@query("rul_08_aligned", "SELECT p_partkey, CASE WHEN s_suppkey IS NOT NULL THEN abs(p_retailprice - s_acctbal) <= 90 END AS aligned FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def _(t):
    j = t("part").join(t("supplier"), F.col("s_suppkey") == F.col("p_partkey"), "left")
    return j.select("p_partkey", L.aligned(F.col("p_retailprice"), F.col("s_acctbal")).alias("aligned"))


@query("join_04_unregistered", "SELECT l_suppkey, min(l_orderkey) AS first FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) GROUP BY 1")
def _(t):
    known = t("supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return t("lineitem").select("l_suppkey", "l_orderkey").join(known, "l_suppkey", "left_anti").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("first"))


@query("join_05_vanished", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_custkey, o_orderpriority) NOT IN (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O') AND (o_custkey, o_orderpriority) NOT IN (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P')")
def _(t):
    of = lambda s: t("orders").where(F.col("o_orderstatus") == s).select("o_orderkey", "o_custkey", "o_orderpriority")
    return L.vanished(of("F"), of("O"), of("P"), ["o_custkey", "o_orderpriority"]).select("o_orderkey")


SIDES = {"b": "o_orderstatus = 'F'", "o": "o_orderstatus <> 'O'", "t": "o_orderstatus <> 'P'"}


@query("join_18_content_merge", "WITH s AS (SELECT o_custkey AS k, max(o_orderkey) FILTER (o_orderstatus = 'F') AS b, max(o_orderkey) FILTER (o_orderstatus <> 'O') AS o, max(o_orderkey) FILTER (o_orderstatus <> 'P') AS t FROM orders GROUP BY 1) SELECT k, CASE WHEN o IS NOT DISTINCT FROM t THEN 'equal' WHEN o IS NOT DISTINCT FROM b THEN 'theirs' WHEN t IS NOT DISTINCT FROM b THEN 'ours' ELSE 'conflict' END AS action FROM s")
def _(t):
    b, o, th = (t("orders").where(SIDES[s]).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v")) for s in "bot")
    return L.content_merge(b, o, th, "k", "v")


@query("join_22_fallback_key", "SELECT o_orderkey, coalesce(s.s_name, c.c_name) AS name FROM orders LEFT JOIN supplier s ON s_suppkey = o_custkey LEFT JOIN customer c ON c_custkey = o_custkey")
def _(t):
    o = t("orders").select("o_orderkey", "o_custkey")
    j = o.join(t("supplier"), F.col("s_suppkey") == F.col("o_custkey"), "left").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("o_orderkey", F.coalesce("s_name", "c_name").alias("name"))


@query("join_23_carry_forward", "SELECT c_custkey, coalesce(nullif(c_acctbal, 0), s_acctbal) AS measured, coalesce(s_nationkey, c_nationkey) AS tier FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def _(t):
    j = t("customer").join(t("supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left")
    return j.select("c_custkey", F.coalesce(F.nullif("c_acctbal", F.lit(0.0)), F.col("s_acctbal")).alias("measured"), F.coalesce("s_nationkey", "c_nationkey").alias("tier"))


@query("join_27_rejoined_labels", "WITH x AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS part, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part), k(part, shown) AS (VALUES ('red', 'rouge'), ('blue', 'bleu'), ('bolt', 'boulon'), ('ring', 'anneau')) SELECT p_partkey, CASE WHEN bool_and(shown IS NOT NULL) THEN string_agg(shown, '/' ORDER BY i) ELSE '' END AS label FROM x LEFT JOIN k USING (part) GROUP BY 1")
def _(t):
    p = t("part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("/")).alias("label"))
    known = p.sparkSession.createDataFrame([("red", "rouge"), ("blue", "bleu"), ("bolt", "boulon"), ("ring", "anneau")], "name string, shown string")
    return L.rejoin_labels(p, known, "p_partkey", "label", "name", "shown")


@query("join_30_already_have", "SELECT event_id FROM events WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 300)")
def _(t):
    have = t("events").where("event_type = 'purchase' AND value > 300").select("user_id")
    return t("events").where("event_type = 'click'").select("event_id", "user_id").join(have, "user_id", "left_semi").select("event_id")


@query("join_31_no_producer", "SELECT c_custkey FROM customer WHERE c_nationkey >= 20 AND (SELECT max(ts) FROM events WHERE event_type = 'signup') < TIMESTAMP '2024-02-02'")
def _(t):
    # The heartbeat is one row whatever the input's size.
    beat = t("events").where("event_type = 'signup'").agg(F.max("ts").alias("at")).where("at < TIMESTAMP_NTZ '2024-02-02 00:00:00'")
    return t("customer").where("c_nationkey >= 20").select("c_custkey").join(F.broadcast(beat), F.lit(True)).select("c_custkey")


@query("agg_20_overrides", "WITH e AS (SELECT *, max(event_id) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS cleared FROM events) SELECT user_id, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props FROM e WHERE event_type <> 'error' AND (cleared IS NULL OR event_id > cleared) GROUP BY 1")
def _(t):
    return L.since_cleared(t("events"), "user_id", "event_id", "event_type", "error", "value", "props")


@query("agg_17_class_wide_kept", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) >= 3 AND NOT bool_or(c_acctbal > 9900) AND bool_or(c_acctbal > 9500)")
def _(t):
    return L.class_wide(t("customer"), "c_nationkey", F.col("c_acctbal") > 9900, F.col("c_acctbal") > 9500)


@query("stf_07_follow_up", "WITH b AS (SELECT user_id AS k, min(CAST(ts AS DATE)) AS f, count(*) % 4 AS tries, count(*) FILTER (event_type = 'error') % 3 AS lost FROM events WHERE event_type <> 'view' AND ts >= TIMESTAMP '2024-01-20' GROUP BY 1), s AS (SELECT user_id AS k, min(CAST(ts AS DATE)) AS seen FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-30' GROUP BY 1), j AS (SELECT coalesce(b.k, s.k) AS user_id, coalesce(f, seen) AS first_seen, coalesce(tries, 0) + CASE WHEN seen IS NULL THEN 0 ELSE 1 END AS tries, coalesce(lost, 0) + CASE WHEN seen IS NULL THEN 1 ELSE 0 END AS lost FROM b FULL JOIN s ON b.k = s.k) SELECT user_id, first_seen, CAST(tries AS BIGINT) AS tries, CAST(lost AS BIGINT) AS lost, CAST(datediff('day', first_seen, DATE '2024-01-31') AS INTEGER) AS age, CASE WHEN lost >= 2 THEN 'lost' WHEN datediff('day', first_seen, DATE '2024-01-31') > 3 THEN 'late' END AS red FROM j WHERE datediff('day', first_seen, DATE '2024-01-31') <= 14")
def _(t):
    e = t("events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    before = e.where("event_type <> 'view' AND day >= '2024-01-20'").groupBy("user_id").agg(F.min("day").alias("first_seen"), (F.count("*") % 4).alias("tries"), (F.count_if(F.col("event_type") == "error") % 3).alias("lost"))
    now = e.where("event_type = 'view' AND day >= '2024-01-30'").groupBy("user_id").agg(F.min("day").alias("at"))
    return L.follow_up(before, now, "user_id", day())


@query("aux_03_soft_skip", f"SELECT coalesce(a.user_id, s.k) AS user_id, CAST(coalesce(hard, 0) AS BIGINT) AS n, CAST(coalesce(soft, 0) + coalesce(more, 0) AS BIGINT) AS soft FROM ({ATTEMPTS}) a FULL JOIN (SELECT o_custkey AS k, count(*) AS more FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) s ON a.user_id = s.k")
def _(t):
    ledger = attempts(t).select("user_id", F.col("hard").alias("n"), "soft")
    return L.soft_skip(ledger, t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id")), "user_id")


@query("aux_17_added_at", "SELECT user_id, max(ts) AS added FROM events WHERE event_type = 'signup' GROUP BY 1")
def _(t):
    return t("events").where("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("added"))


@query("aux_31_queue", "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) QUALIFY place <= 40")
def _(t):
    left = t("documents").select("doc_id", "n_chars").join(t("labels").where("quality = 1"), "doc_id", "left_anti").join(t("labels").where("toxic = 1"), "doc_id", "left_anti")
    order = [F.col("n_chars").desc(), F.col("doc_id")]
    return left.orderBy(*order).limit(40).select("doc_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))
