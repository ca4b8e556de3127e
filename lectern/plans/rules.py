"""Queries of states, rules, scorers and helpers: ledgers are rows of events, orders and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as C
from ..functions import text as T
from ..operators import containment
from ..operators import ledgers as L
from ..operators import relational as R
from ..operators import scorers
from ..operators import states as S
from ..sinks import batches, tables
from .queries import query

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


@query("str_01_lookback", "SELECT event_id FROM events WHERE ts >= DATE '2024-01-01' + CAST(event_id % 40 AS INTEGER) - INTERVAL 7 DAY")
def _(t):
    arrived = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("event_id") % 40).cast("int")).cast("timestamp_ntz")
    return S.within_lookback(t("events").withColumn("arrived", arrived), "ts", "arrived", 7).select("event_id")


@query("str_02_claims", "WITH e AS (SELECT event_id // 20 AS fp, event_id, user_id % 3 AS owner, CASE WHEN event_type IN ('error', 'view') THEN 'release' ELSE 'claim' END AS kind FROM events), r AS (SELECT fp, list({'o': owner, 'k': kind} ORDER BY event_id) AS l FROM e GROUP BY 1), x AS (SELECT fp, list_reduce(list_prepend(CAST(-1 AS BIGINT), list_transform(l, lambda z: CASE WHEN z.k = 'claim' THEN z.o ELSE -10 - z.o END)), lambda h, z: CASE WHEN h = -1 AND z >= 0 THEN z WHEN z <= -10 AND h = -10 - z THEN -1 ELSE h END) AS owner FROM r) SELECT fp, owner FROM x WHERE owner >= 0")
def _(t):
    e = t("events").select(F.floor(F.col("event_id") / 20).alias("fp"), "event_id", (F.col("user_id") % 3).alias("owner"), F.when(F.col("event_type").isin("error", "view"), "release").otherwise("claim").alias("kind"))
    return S.claims(e, "fp", "owner", "kind", ["event_id"])


@query("str_03_soft", "WITH e AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 DAY THEN 1 ELSE 0 END AS g FROM events WHERE event_type = 'error'), i AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM e) SELECT user_id, count(*) AS soft, max(ts) AS last FROM i QUALIFY true GROUP BY user_id, i HAVING i = (SELECT max(i) FROM i j WHERE j.user_id = i.user_id)".replace(" QUALIFY true", ""))
def _(t):
    return S.soft_counts(t("events").where("event_type = 'error'").select("user_id", "ts"), "user_id", "ts", 2)


@query("str_04_followed", f"WITH r AS (SELECT user_id, max(CASE WHEN event_type <> 'error' AND value > 60 THEN ts END) AS last_seen, min(ts) AS first FROM events GROUP BY 1), c AS (SELECT r.*, CAST((SELECT count(*) FROM events e WHERE e.user_id = r.user_id AND (last_seen IS NULL OR e.ts > last_seen)) AS INTEGER) AS lost FROM r) SELECT user_id, CASE WHEN {NOW} > coalesce(last_seen, first) + INTERVAL 14 DAY THEN 'dropped' WHEN {NOW} > coalesce(last_seen, first) + INTERVAL 72 HOUR OR lost >= 5 THEN 'red' ELSE 'ok' END AS state, lost, last_seen FROM c")
def _(t):
    rounds = t("events").select("user_id", "ts", ((F.col("event_type") != "error") & (F.col("value") > 60)).alias("seen"))
    return S.followed(rounds, "user_id", "ts", "seen", now(), lost=5)


@query("str_05_liveness", f"SELECT event_type, CASE WHEN age > h * 3600 THEN 'dead' WHEN age > 0.75 * h * 3600 THEN 'warning' ELSE 'ok' END AS state FROM (SELECT event_type, epoch({NOW}) - floor(epoch(max(ts))) AS age, CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 0 ELSE 30 END AS h FROM events GROUP BY 1)")
def _(t):
    return S.liveness(t("events"), "event_type", "ts", now(), {"view": 1, "error": 0})


@query("str_06_circuit", "SELECT event_id, coalesce(ts >= last_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 600 MINUTE, true) AS open FROM events")
def _(t):
    return S.admitted(t("events").withColumn("bad", F.col("event_type") == "error"), "user_id", "ts", "bad", 600).select("event_id", "open")


@query("str_09_upsert", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(t):
    o = t("orders").select("o_custkey", "o_orderkey")
    old, new = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")
    late = new.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    base = old.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    newer = late.join(base.withColumnRenamed("o_orderkey", "_b"), "o_custkey", "left").where("_b is null or o_orderkey > _b").drop("_b")
    once = S.upserted(base, newer, "o_custkey", "o_orderkey")
    return S.upserted(once, newer, "o_custkey", "o_orderkey")  # a second run changes nothing


@query("str_09_replayed", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, count(*) AS orders FROM orders GROUP BY 1")
def _(t):
    # Three batches, the first and the last of which come again with other rows: what has been published once stays.
    o = t("orders").select("o_custkey", "o_orderkey")
    ledger = batches.Ledger(o.sparkSession, tables.shared_folder(o.sparkSession))
    for i, batch in ((0, 0), (1, 1), (0, 0), (2, 2), (1, 2)):
        ledger.write(o.where(F.col("o_orderkey") % 3 == i), batch)
    last = ledger.latest("o_custkey", lambda: F.col("o_orderkey"))
    return last.join(ledger.rows().groupBy("o_custkey").agg(F.count("*").alias("orders")), "o_custkey")


@query("str_10_cooldown", f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 80 AND ts > {NOW} - INTERVAL 10 DAY)")
def _(t):
    rejected = t("events").where("event_type = 'error' AND value > 80").select(F.col("user_id").alias("c_custkey"), "ts")
    return S.cooled(t("customer").select("c_custkey"), rejected, "c_custkey", "ts", now(), 10)


RUNS = """WITH e AS (SELECT event_id, user_id % 7 AS job, ts, date_trunc('hour', ts) - to_hours((CAST(hour(ts) AS INTEGER) + 18) % 12) AS slot, event_id % 3 > 0 AS tick, [0, 1, 75][CAST(event_id % 9 // 3 AS INTEGER) + 1] AS code, event_id % 10 = 0 AS busy FROM events WHERE ts IS NOT NULL),
b AS (SELECT *, last_value(CASE WHEN NOT tick THEN code END IGNORE NULLS) OVER (PARTITION BY job, slot ORDER BY ts, tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS beat FROM e),
k AS (SELECT *, tick AND NOT busy AND coalesce(beat, 1) <> 0 AS free, coalesce(beat, 1) = 75 AS down FROM b),
n AS (SELECT *, coalesce(sum(CAST(free AS INTEGER)) OVER (PARTITION BY job, slot ORDER BY ts, tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT event_id, free AND (down OR before < 3) AS run, CAST(sum(CASE WHEN free AND (down OR before < 3) THEN 1 ELSE 0 END) OVER (PARTITION BY job, slot ORDER BY ts, tick, event_id) AS INTEGER) AS tries FROM n WHERE tick"""


@query("str_12_runs", RUNS)
def _(t):
    e = t("events").where("ts is not null")
    code = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(75)), (F.floor(F.col("event_id") % 9 / 3) + 1).cast("int"))
    rows = e.select((F.col("user_id") % 7).alias("job"), F.struct("ts", (F.col("event_id") % 3 > 0).alias("t"), "event_id").alias("at"), S.slot_of(F.col("ts").cast("timestamp"), (6, 18)).alias("slot"), (F.col("event_id") % 3 > 0).alias("tick"), code.alias("code"), (F.col("event_id") % 10 == 0).alias("busy"))
    return S.slot_runs(rows, "job", "at", "slot", "tick", "code", "busy").select("at.event_id", "run", "tries")


@query("str_12_slots", "SELECT event_id, CASE WHEN hour(ts) >= 18 THEN date_trunc('day', ts) + INTERVAL 18 HOUR WHEN hour(ts) >= 6 THEN date_trunc('day', ts) + INTERVAL 6 HOUR ELSE date_trunc('day', ts) - INTERVAL 6 HOUR END AS slot FROM events")
def _(t):
    return t("events").select("event_id", S.slot_of(F.col("ts").cast("timestamp"), (6, 18)).cast("timestamp_ntz").alias("slot"))


JUDGED = "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS err, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (value >= 70) AS ok, count(*) FILTER (event_type = 'purchase' AND value >= 40) AS drafted, count(*) FILTER (event_type = 'purchase') AS tries, max(ts) AS latest, min(ts) AS first FROM events GROUP BY 1"


@query("rul_01_all_branches", f"SELECT user_id, CASE WHEN latest < TIMESTAMP '2024-01-27' THEN 'feed-dead' WHEN views * 3 > n THEN 'route' WHEN err * 4 > n THEN 'cloud-only' WHEN err >= 20 THEN 'no-transcript' WHEN datediff('day', CAST(latest AS DATE), DATE '2024-01-31') > greatest(2, 1.5 * (user_id % 3)) THEN 'stale' WHEN n < 4 THEN NULL WHEN ok = 0 THEN 'never passed' WHEN n >= 6 AND ok * 4 < n THEN 'low pass rate' WHEN tries >= 4 AND drafted * 100 < 34 * tries THEN 'weak drafts' END AS action FROM ({JUDGED})")
def _(t):
    kind, v = F.col("event_type"), F.col("value")
    m = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(kind == "error").alias("err"), F.count_if(kind == "view").alias("views"), F.count_if(v >= 70).alias("ok"), F.count_if((kind == "purchase") & (v >= 40)).alias("drafted"), F.count_if(kind == "purchase").alias("tries"), F.max("ts").alias("latest"))
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("latest"))
    return m.select("user_id", L.judged(feed_dead=F.col("latest") < F.lit("2024-01-27").cast("timestamp_ntz"), audio_only=F.col("views") * 3 > F.col("n"), cloud_only=F.col("err") * 4 > F.col("n"), untold=F.col("err") >= 20, stale=age > F.greatest(F.lit(2), 1.5 * (F.col("user_id") % 3)), n=F.col("n"), passed=F.col("ok"), tries=F.col("tries"), drafted=F.col("drafted")).alias("action"))


@query("rul_02_exempt", "SELECT c_custkey, CASE WHEN c_nationkey < 3 AND action IN ('remove', 'demote') THEN NULL ELSE action END AS action FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 0 THEN 'remove' WHEN c_acctbal < 1000 THEN 'demote' WHEN c_acctbal > 9000 THEN 'route' END AS action FROM customer)")
def _(t):
    b = F.col("c_acctbal")
    c = t("customer").withColumn("action", F.when(b < 0, "remove").when(b < 1000, "demote").when(b > 9000, "route"))
    held = (F.col("c_nationkey") < 3) & F.col("action").isin("remove", "demote")
    return c.select("c_custkey", F.when(~F.coalesce(held, F.lit(False)), F.col("action")).alias("action"))


@query("rul_05_accepted", "SELECT c_custkey FROM customer WHERE c_acctbal < -900 AND (SELECT count(*) FROM customer WHERE c_acctbal < -900) = (SELECT count(*) FROM customer WHERE c_acctbal < -900 AND c_nationkey >= 0)")
def _(t):
    proposals = t("customer").where("c_acctbal < -900").select("c_custkey")
    accepted = t("customer").where("c_acctbal < -900 AND c_nationkey >= 0").select("c_custkey")
    return L.all_or_nothing(proposals, accepted, "c_custkey")


@query("rul_06_reconciled", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.quality = 0 THEN 'done' WHEN l.doc_id IS NOT NULL THEN 'done' WHEN d.doc_id % 5 = 0 THEN 'fail' ELSE 'open' END AS state FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(t):
    files = t("labels").select("doc_id", F.lit("done").alias("_file"))
    ledger = t("documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "fail").otherwise("open").alias("_said"))
    return ledger.join(files, "doc_id", "left").select("doc_id", F.coalesce("_file", "_said").alias("state"))


@query("udf_01_reasked", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(props->>'k' AS BIGINT) END AS k, CAST(least(event_id % 4, 2) + 1 AS INTEGER) AS asked FROM events")
def _(t):
    # The answerer of the test gives JSON at its (event_id % 4)-th try, and is asked three times at most.
    return C.completed(t("events").select("event_id", "props"), "event_id", "props", C.answers_late, 2)


@query("udf_02_triage", "SELECT doc_id, CAST(length(text) % 11 AS DOUBLE) AS score, CASE WHEN length(text) % 11 >= 7 THEN 'core' ELSE 'other' END AS kind, 'r1' AS rubric FROM documents")
def _(t):
    return C.scored(t("documents").select("doc_id", "text"), "doc_id", "text", C.by_length, "r1")


COUNTED = "WITH d AS (SELECT doc_id, source, length(text) AS n, length(text) - length(replace(text, ' ', '')) AS spaces FROM documents), s AS (SELECT *, n IS NOT NULL AND n % 7 NOT IN (3, 5) AS ok, greatest(0, least(10, spaces % 13 - 1))::DOUBLE AS s, CASE WHEN n IS NULL THEN 'no prompt' WHEN n % 7 = 3 THEN 'ConnectionError: gone' WHEN n % 7 = 5 THEN 'no JSON object' END AS error FROM d)"


@query("udf_02_asked", f"{COUNTED} SELECT doc_id, CASE WHEN ok THEN s END AS score, CASE WHEN ok THEN n || ' long' END AS why, CASE WHEN ok THEN CASE WHEN spaces % 2 = 1 THEN 'core' ELSE 'other' END END AS kind, CASE WHEN ok THEN source END AS basis, CASE WHEN ok THEN 'r1' END AS rubric, error FROM s")
def _(t):
    return scorers.triaged(t("documents").select("doc_id", "text", "source"), "doc_id", "text", "source", C.counting, "r1")


@query("udf_03_asked", f"{COUNTED} SELECT doc_id, CASE WHEN ok AND spaces % 3 = 0 THEN 'core' WHEN ok AND spaces % 3 = 1 THEN 'other' ELSE source END AS cat FROM s")
def _(t):
    return scorers.categorised(t("documents").select("doc_id", "text", "source"), "doc_id", "text", "source", ("core", "other"), C.counting)


@query("udf_04_digested", "SELECT doc_id, CASE WHEN n > 2000 THEN ceil(n / 1000.0)::BIGINT END AS pieces, n AS chars FROM (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL)")
def _(t):
    got = scorers.digested(t("documents").select("doc_id", "text"), "doc_id", "text", C.adding, chars=2000, piece=1000, anchor="\x00")
    alone = F.get(F.from_json(scorers.said("notes"), "array<string>"), 0)
    return got.select("doc_id", scorers.said("n").cast("long").alias("pieces"), F.coalesce(scorers.said("sum"), alone).cast("long").alias("chars"))


@query("udf_05_asked", "WITH q AS (SELECT DISTINCT l_orderkey, l_partkey, 'part ' || l_partkey AS quote FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM q) SELECT l_orderkey, l_partkey, quote, CASE WHEN n > 1 AND contains(quote, '77') THEN '77' END AS garbled FROM n")
def _(t):
    # Dealt by order once, for the distinct rows and for the prompts.
    parts = t("lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    quotes = parts.withColumn("quote", F.concat(F.lit("part "), "l_partkey"))
    return scorers.ungarbled(quotes, "l_orderkey", "l_partkey", "quote", C.suspecting)


@query("udf_06_asked", f"{COUNTED} SELECT doc_id, CASE WHEN ok THEN s END AS score, CASE WHEN ok THEN (n % 10)::DOUBLE END AS density, CASE WHEN ok THEN (spaces % 10)::DOUBLE END AS faithful, CASE WHEN ok THEN 'fine' END AS verdict, error FROM s")
def _(t):
    got = scorers.reviewed(t("documents").select("doc_id", "text"), "doc_id", "text", C.counting, "r1")
    return got.select("doc_id", "score", "density", "faithful", "verdict", "error")


@query("udf_03_category", "SELECT doc_id, CASE length(text) % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE source END AS cat FROM documents")
def _(t):
    # A category that is none of the known ones falls back to the source's.
    said = F.element_at(F.array(*[F.lit(x) for x in ("a", "b", "??", "none")]), (F.length("text") % 4 + 1).cast("int"))
    return t("documents").select("doc_id", F.coalesce(F.when(said.isin(*"abcdef"), said), F.col("source")).alias("cat"))


@query("udf_04_map_reduce", "SELECT doc_id, CAST(ceil(length(text) / 500.0) AS BIGINT) AS parts, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE length(text) > 0")
def _(t):
    from ..operators import stateful

    pieces = stateful.chunks(t("documents").select("doc_id", "text"), "doc_id", "text", 500, anchor="\x00")
    return pieces.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum(F.length("piece")).alias("chars"))


@query("udf_05_garbled", "SELECT conv_id, turn FROM conversations WHERE NOT (turn % 3 = 0 AND contains(text, substr(text, 3, 8)) AND length(text) > 20)")
def _(t):
    # What a scorer reports must occur in the quote, else the quote stays; so does it where the scorer fails.
    report = F.when(F.col("turn") % 3 == 0, F.substring("text", 3, 8)).when(F.col("turn") % 3 == 1, F.lit("not there at all"))
    bad = F.coalesce(F.contains("text", report) & (F.length("text") > 20), F.lit(False))
    return t("conversations").where(~bad).select("conv_id", "turn")


@query("udf_06_review", "SELECT doc_id, (d1 + d2 + d3 + d4 + d5) / 5.0::DOUBLE AS score, d1, d5 FROM (SELECT doc_id, CAST(length(text) % 10 AS DOUBLE) AS d1, CAST(length(text) // 10 % 10 AS DOUBLE) AS d2, CAST(doc_id % 10 AS DOUBLE) AS d3, CAST(doc_id // 10 % 10 AS DOUBLE) AS d4, CAST(length(source) AS DOUBLE) AS d5 FROM documents)")
def _(t):
    n, k = F.length("text"), F.col("doc_id")
    dims = [n % 10, F.floor(n / 10) % 10, k % 10, F.floor(k / 10) % 10, F.length("source")]
    d = t("documents").select("doc_id", *[x.cast("double").alias(f"d{i + 1}") for i, x in enumerate(dims)])
    return d.select("doc_id", ((F.col("d1") + F.col("d2") + F.col("d3") + F.col("d4") + F.col("d5")) / 5.0).alias("score"), "d1", "d5")


@query("udf_07_glyphs", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'fix' WHEN 1 THEN 'ok' ELSE 'pending' END AS state FROM part")
def _(t):
    from ..functions import forms as X

    n, k = F.col("p_name"), F.col("p_partkey") % 5
    ctx = F.concat(F.lit("x"), F.lit("a"), F.substring(n, 1, 1))
    answer = F.when(k == 0, F.concat(F.lit("x"), F.lit("e"), F.substring(n, 1, 1))).when(k == 1, ctx).when(k == 2, F.lit("?")).when(k == 3, F.concat(F.lit("y"), F.lit("e"), F.substring(n, 1, 1)))
    state = F.when(answer == ctx, "ok").when(X.valid_fix(ctx, answer, "aeiou"), "fix").otherwise("pending")
    return t("part").select("p_partkey", state.alias("state"))


@query("udf_08_translated", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE upper(p_name) END AS name FROM part")
def _(t):
    from ..functions import forms as X

    # An answer that is still in the source's script does not pass.
    said = F.when(F.col("p_partkey") % 3 == 0, F.lit("未翻译的名字还在这里呢吧")).otherwise(F.upper("p_name"))
    return t("part").select("p_partkey", F.when(~X.untranslated(said), said).alias("name"))


@query("udf_10_rewritten", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'rewritten' ELSE o_orderpriority END AS title FROM orders")
def _(t):
    o = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("title"))
    new = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("rewritten").alias("title"))
    return o.join(new.withColumnRenamed("title", "_new"), "o_orderkey", "left").select("o_orderkey", F.coalesce("_new", "title").alias("title"))


@query("aux_01_coverage", "SELECT c_custkey, CASE WHEN c_acctbal < -500 THEN 'fail' WHEN n IS NULL AND c_nationkey < 5 THEN 'fail' WHEN latest < TIMESTAMP '1998-08-01' THEN 'note' ELSE 'ok' END AS result FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS latest FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    probes = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))
    j = t("customer").join(probes, "c_custkey", "left")
    checks = [(F.col("c_acctbal") < -500, "fail"), (F.col("n").isNull() & (F.col("c_nationkey") < 5), "fail"), (F.col("latest") < F.lit("1998-08-01").cast("timestamp"), "note")]
    return j.select("c_custkey", F.coalesce(L.first_reason(checks), F.lit("ok")).alias("result"))


@query("aux_02_follow_verdicts", f"SELECT user_id, CASE WHEN latest IS NULL OR latest < {NOW} - INTERVAL 30 HOUR THEN 'bad' WHEN lost >= 15 THEN 'note' ELSE 'ok' END AS verdict FROM (SELECT user_id, max(ts) AS latest, count(*) FILTER (event_type = 'error') AS lost FROM events GROUP BY 1)")
def _(t):
    r = t("events").groupBy("user_id").agg(F.max("ts").alias("latest"), F.count_if(F.col("event_type") == "error").alias("lost"))
    old = F.col("latest").isNull() | (F.col("latest") < now() - F.expr("INTERVAL 30 HOURS"))
    return r.select("user_id", F.when(old, "bad").when(F.col("lost") >= 15, "note").otherwise("ok").alias("verdict"))


@query("aux_04_released", "SELECT o_orderkey AS fp, o_custkey AS owner FROM orders WHERE NOT (o_orderkey % 4 = 0 AND o_custkey % 2 = 0)")
def _(t):
    held = t("orders").select(F.col("o_orderkey").alias("fp"), F.col("o_custkey").alias("owner"))
    # Releases come from the owner, or from another key, which may not release.
    released = held.where("fp % 4 = 0").select("fp", F.when(F.col("owner") % 2 == 0, F.col("owner")).otherwise(F.col("owner") + 1).alias("owner"))
    return held.join(released, ["fp", "owner"], "left_anti")


@query("aux_05_word_cap", "SELECT c_custkey, CASE WHEN c_nationkey < 3 AND c_acctbal <= 0 THEN 0 WHEN c_nationkey < 3 THEN 60000 ELSE 30000 END AS cap FROM customer")
def _(t):
    follow = F.col("c_nationkey") < 3
    return t("customer").select("c_custkey", F.when(follow & (F.col("c_acctbal") <= 0), 0).when(follow, 60000).otherwise(30000).alias("cap"))


@query("aux_06_in_language", "SELECT page_id, CASE WHEN regexp_matches(url, '/en/\\d+') THEN TRY_CAST(regexp_extract(url, '/en/(\\d+)', 1) AS BIGINT) IN (SELECT doc_id FROM documents WHERE lang = 'en') WHEN regexp_matches(url, '/(fr|de)/') THEN false ELSE true END AS here FROM pages")
def _(t):
    key = F.regexp_extract("url", r"/en/(\d+)", 1).try_cast("long")
    known = t("documents").where("lang = 'en'").select(F.col("doc_id").alias("_k"), F.lit(True).alias("_yes")).distinct()
    p = t("pages").withColumn("_key", key).join(known, F.col("_key") == F.col("_k"), "left")
    return p.select("page_id", F.when(F.col("_key").isNotNull(), F.coalesce("_yes", F.lit(False))).when(F.col("url").rlike("/(fr|de)/"), F.lit(False)).otherwise(F.lit(True)).alias("here"))


@query("aux_07_cover", "SELECT p.page_id, coalesce(m.file, CASE WHEN starts_with(h, 'blog.') THEN u || '?w=300' WHEN starts_with(h, 'm.') THEN u || '/small' ELSE u END) AS cover FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS u, regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages) p LEFT JOIN (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS k, 'c' || min(page_id) AS file FROM pages WHERE page_id % 3 = 0 GROUP BY 1) m ON m.k = p.u")
def _(t):
    norm = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    manifest = t("pages").where("page_id % 3 = 0").groupBy(norm.alias("u")).agg(F.concat(F.lit("c"), F.min("page_id")).alias("file"))
    p = t("pages").select("page_id", norm.alias("u"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("h")).join(manifest, "u", "left")
    rewrite = F.when(F.startswith("h", F.lit("blog.")), F.concat("u", F.lit("?w=300"))).when(F.startswith("h", F.lit("m.")), F.concat("u", F.lit("/small"))).otherwise(F.col("u"))
    return p.select("page_id", F.coalesce("file", rewrite).alias("cover"))


@query("aux_08_failure_kind", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\brate|too many') THEN 'ratelimit' WHEN regexp_matches(text, '(?i)\\bthe\\b.*\\bof\\b') THEN 'upcoming' WHEN regexp_matches(text, '(?i)(^| )les?( |$)') THEN 'nocaptions' ELSE 'other' END AS kind FROM documents")
def _(t):
    x = F.col("text")
    return t("documents").select("doc_id", F.when(x.rlike(r"(?i)\brate|too many"), "ratelimit").when(x.rlike(r"(?i)\bthe\b.*\bof\b"), "upcoming").when(x.rlike("(?i)(^| )les?( |$)"), "nocaptions").otherwise("other").alias("kind"))


@query("aux_09_siblings", "WITH f AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents) SELECT d.doc_id, count(f.doc_id) AS siblings, max(f.doc_id) AS newest FROM documents d LEFT JOIN f ON f.source = d.source AND n <= 25 AND f.doc_id <> d.doc_id GROUP BY 1")
def _(t):
    first = R.newest_per(t("documents").select("doc_id", "source"), "source", [F.col("doc_id").desc()], 25).select("source", F.col("doc_id").alias("_s"))
    j = t("documents").select("doc_id", "source").join(first, "source", "left").withColumn("_s", F.when(F.col("_s") != F.col("doc_id"), F.col("_s")))
    return j.groupBy("doc_id").agg(F.count("_s").alias("siblings"), F.max("_s").alias("newest"))


@query("aux_10_once_per_video", "SELECT l_partkey, min(l_orderkey) AS first, count(*) AS uses FROM lineitem GROUP BY 1")
def _(t):
    # The sample of a video is taken for the first that asks; all others read it.
    return t("lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("first"), F.count("*").alias("uses"))


@query("aux_11_allowed", "SELECT DISTINCT p_name AS ctx FROM part WHERE p_size < 5 UNION SELECT DISTINCT p_name FROM part WHERE p_type = 'SMALL'")
def _(t):
    p = t("part").withColumnRenamed("p_name", "ctx")
    return p.where("p_size < 5").select("ctx").union(p.where("p_type = 'SMALL'").select("ctx")).distinct()


@query("aux_12_script_index", "SELECT p_partkey, translate(lower(p_name || ' ' || p_type), 'ab', '門國') AS hay FROM part")
def _(t):
    from ..functions import forms as X

    hay = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    return t("part").select("p_partkey", X.converted(F.translate(hay, "ab", "门国"), {"门": "門", "国": "國"}).alias("hay"))


@query("aux_13_channel", "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size % 25 END AS id, 'nation_' || p_size AS said FROM part), n AS (SELECT n_nationkey, lower(n_name) AS name FROM nation) SELECT p_partkey, coalesce(min(id), min(n_nationkey)) AS channel FROM p LEFT JOIN n ON contains(said, name) OR contains(name, said) GROUP BY 1 HAVING channel IS NOT NULL")
def _(t):
    # By id where it is known, else by name: of two names, either may hold the other.
    p = t("part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") % 25).alias("id"), F.concat(F.lit("nation_"), "p_size").alias("said"))
    n = t("nation").select("n_nationkey", F.lower("n_name").alias("name"))
    named = containment.same_names(p, n, "p_partkey", "said", "n_nationkey", "name").groupBy("p_partkey").agg(F.min("n_nationkey").alias("found"))
    return p.join(named, "p_partkey", "left").select("p_partkey", F.coalesce("id", "found").alias("channel")).where("channel is not null")


@query("aux_14_known_keys", "SELECT lower(c_name) AS k, c_custkey AS id FROM customer UNION SELECT 'feed/' || c_nationkey || '/' || c_custkey, c_custkey FROM customer UNION SELECT 'ch' || c_custkey, c_custkey FROM customer WHERE c_acctbal > 0")
def _(t):
    c = t("customer").withColumnRenamed("c_custkey", "id")
    names = c.select(F.lower("c_name").alias("k"), "id")
    return names.union(c.select(F.concat_ws("/", F.lit("feed"), "c_nationkey", "id"), "id")).union(c.where("c_acctbal > 0").select(F.concat(F.lit("ch"), "id"), "id")).distinct()


@query("aux_15_sampled", "SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'feed' WHEN o_orderstatus = 'F' THEN 'notes' END AS tier, CAST(floor(o_totalprice) AS BIGINT) AS words FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3")
def _(t):
    x = R.newest_per(t("orders"), "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey")], 3)
    return x.select("o_custkey", "o_orderkey", F.when(F.col("o_totalprice") > 300000, "feed").when(F.col("o_orderstatus") == "F", "notes").alias("tier"), F.floor("o_totalprice").cast("long").alias("words"))


@query("aux_16_probe", "SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'feed' WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 'catalogue' WHEN s_suppkey % 2 = 0 THEN 'channel' END AS found FROM supplier")
def _(t):
    catalogue = t("nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(True).alias("_c"))
    j = t("supplier").join(catalogue, "s_nationkey", "left")
    return j.select("s_suppkey", F.when(F.col("s_acctbal") > 5000, "feed").when(F.col("_c"), "catalogue").when(F.col("s_suppkey") % 2 == 0, "channel").alias("found"))


@query("aux_18_broken", "SELECT user_id, class FROM (SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') > 18 THEN 'broken' WHEN max(ts) < TIMESTAMP '2024-01-30' THEN 'untried' ELSE 'fine' END AS class FROM events GROUP BY 1) WHERE class IN ('broken', 'untried')")
def _(t):
    c = t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("err"), F.max("ts").alias("latest"))
    kind = F.when(F.col("err") > 18, "broken").when(F.col("latest") < F.lit("2024-01-30").cast("timestamp_ntz"), "untried").otherwise("fine")
    return c.select("user_id", kind.alias("class")).where("class in ('broken', 'untried')")


@query("aux_19_reopened", "SELECT doc_id FROM labels WHERE toxic = 1 AND coalesce(CASE WHEN doc_id % 3 > 0 THEN 'r' || doc_id % 3 END <> 'r2', true)")
def _(t):
    rubric = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("r"), F.col("doc_id") % 3))
    return t("labels").where((F.col("toxic") == 1) & F.coalesce(rubric != "r2", F.lit(True))).select("doc_id")


@query("aux_20_restore_reason", "SELECT o_custkey, CASE max_by(o_orderstatus, o_orderkey) WHEN 'F' THEN 'feed back' WHEN 'O' THEN 'open again' ELSE 'restored' END AS why FROM orders GROUP BY 1")
def _(t):
    last = R.last_event(t("orders"), "o_custkey", "o_orderkey", "o_orderstatus")
    return last.select("o_custkey", F.when(F.col("o_orderstatus") == "F", "feed back").when(F.col("o_orderstatus") == "O", "open again").otherwise("restored").alias("why"))


@query("aux_21_failures", "SELECT d.source, CAST(count(*) FILTER (l.quality = 0) + 1 AS BIGINT) AS tries FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1 HAVING count(*) FILTER (l.toxic = 1) < 3")
def _(t):
    j = t("documents").select("doc_id", "source").join(t("labels"), "doc_id", "left").groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("n"), F.count_if(F.col("toxic") == 1).alias("cleared"))
    return j.where("cleared < 3").select("source", (F.col("n") + 1).alias("tries"))


@query("aux_22_feed_language", "SELECT page_id, coalesce(nullif(regexp_extract(html, '<html[^>]*\\blang=\"([a-z]{2})', 1), ''), 'old') AS lang FROM pages")
def _(t):
    return t("pages").select("page_id", F.coalesce(F.nullif(F.regexp_extract("html", r'<html[^>]*\blang="([a-z]{2})', 1), F.lit("")), F.lit("old")).alias("lang"))


@query("aux_23_healed", "SELECT c_custkey, CASE WHEN o.k IS NOT NULL THEN 'new-' || o.k ELSE c_name END AS feed FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o.o_custkey = c_custkey")
def _(t):
    healed = t("orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.concat(F.lit("new-"), F.max("o_orderkey")).alias("_new"))
    return t("customer").join(healed, "c_custkey", "left").select("c_custkey", F.coalesce("_new", "c_name").alias("feed"))


@query("aux_24_navigation", "SELECT c_mktsegment AS cat, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000 GROUP BY 1 HAVING n > 0")
def _(t):
    o = t("orders").where("o_totalprice > 450000")
    return t("customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_mktsegment").alias("cat")).agg(F.count("o_orderkey").alias("n")).where("n > 0")


@query("aux_25_missed", f"SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AND o_orderdate < TIMESTAMP '1998-08-01'")
def _(t):
    run = t("lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").where(F.col("o_orderdate") < F.lit("1998-08-01").cast("timestamp")).join(run, "o_orderkey", "left_anti").select("o_orderkey")


@query("aux_26_blob", "SELECT doc_id, sha1('blob ' || octet_length(encode(text)) || chr(0) || text) AS blob FROM documents WHERE text IS NOT NULL")
def _(t):
    return t("documents").where("text is not null").select("doc_id", T.blob_hash(F.col("text")).alias("blob"))


@query("aux_28_quiet", "SELECT event_id, coalesce(lag(event_type) OVER w = event_type AND lag(CAST(ts AS DATE)) OVER w = CAST(ts AS DATE), false) AS quiet FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    same = (F.lag("event_type").over(w) == F.col("event_type")) & (F.lag(F.to_date("ts")).over(w) == F.to_date("ts"))
    return t("events").select("event_id", F.coalesce(same, F.lit(False)).alias("quiet"))


@query("aux_29_unresolved", "SELECT DISTINCT p_type || '.' || p_name AS key FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_brand = 'Brand#1')")
def _(t):
    have = t("part").where("p_brand = 'Brand#1'").select("p_name").distinct()
    return t("part").join(have, "p_name", "left_anti").select(F.concat_ws(".", "p_type", "p_name").alias("key")).distinct()


@query("aux_30_single", "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) THEN 'have it' WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'blocked' ELSE 'add' END AS what FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01'")
def _(t):
    have = t("lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("_h")).distinct()
    bad = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("_b"))
    j = t("orders").where(F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp")).join(have, "o_orderkey", "left").join(bad, "o_custkey", "left")
    return j.select("o_orderkey", F.when(F.col("_h"), "have it").when(F.col("_b"), "blocked").otherwise("add").alias("what"))


@query("aux_32_accepted", "SELECT p_partkey, upper(p_name) AS answer FROM part WHERE p_partkey % 4 IN (0, 1) AND p_size < 40")
def _(t):
    asked = t("part").where("p_size < 40").select("p_partkey")
    k = F.col("p_partkey") % 4
    answers = t("part").select("p_partkey", F.when(k < 2, F.upper("p_name")).when(k == 2, F.lit(" ")).otherwise(F.concat("p_name", F.lit("国"))).alias("answer"))
    return answers.join(asked, "p_partkey", "left_semi").where((F.trim("answer") != "") & ~F.col("answer").rlike("[一-鿿]"))
