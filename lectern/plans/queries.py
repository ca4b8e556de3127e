"""The archive engine's queries over the driver's tables, and their DuckDB SQL.

Items are rows of events (source user_id, published ts, kind event_type, score value), the registry is customer, tags and texts come from documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evidence as E
from ..operators import relational as R
from ..operators import stateful as S
from ..streaming import stateful as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def newest() -> list:
    return [F.col("ts").desc(), F.col("event_id")]


@query("win_04_newest_per_source", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def _(t):
    return R.newest_per(t("events").select("user_id", "event_id", "ts"), "user_id", newest()).drop("rn")


@query("flt_01_candidates", "SELECT event_id, user_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 25 AND event_type <> 'error' AND value >= 100 AND ts >= TIMESTAMP '2024-01-10'")
def _(t):
    first = R.newest_per(t("events").select("event_id", "user_id", "ts", "value", "event_type"), "user_id", newest(), 25)
    return first.where("event_type <> 'error' AND value >= 100 AND ts >= TIMESTAMP '2024-01-10'").select("event_id", "user_id", "ts", "value")


@query("agg_03_performance", "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, round(median(value), 4) AS median, round(avg(CASE WHEN value >= 70 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS pass_rate FROM events GROUP BY user_id")
def _(t):
    return R.performance(t("events"), "user_id", "event_type", "value", 70)


@query("agg_01_counts_by_category", "SELECT c_mktsegment AS cat, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    return t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_mktsegment").alias("cat")).agg(F.count("o_orderkey").alias("n"))


@query("agg_02_hot_sources", "WITH h AS (SELECT user_id, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS week, max(ts) AS latest FROM events GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY n DESC, latest DESC, user_id) AS INTEGER) AS place FROM h QUALIFY place <= 24")
def _(t):
    h = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= F.lit("2024-01-24").cast("timestamp")).alias("week"), F.max("ts").alias("latest"))
    order = [F.col("n").desc(), F.col("latest").desc(), F.col("user_id")]
    return h.orderBy(*order).limit(24).withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query("agg_04_cadence", "WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT user_id, datediff('day', lead(day) OVER w, day) AS gap, row_number() OVER w AS rn FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day DESC)) SELECT user_id, CAST(list_sort(list(gap))[count(*) // 2 + 1] AS INTEGER) AS cadence, CAST(max(gap) AS INTEGER) AS max_gap FROM g WHERE rn < 12 AND gap IS NOT NULL GROUP BY user_id")
def _(t):
    return R.upper_median_gap(t("events").select("user_id", F.to_date("ts").alias("day")), "user_id", "day")


@query("agg_06_duplicates", "SELECT p_name AS fp, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return t("part").groupBy(F.col("p_name").alias("fp")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n > 1")


@query("agg_08_usage", "SELECT o_orderpriority AS role, o_orderstatus AS model, count(*) AS calls, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def _(t):
    return R.usage(t("orders").select(F.col("o_orderpriority").alias("role"), F.col("o_orderstatus").alias("model"), "o_custkey"), "role", "model", "o_custkey")


@query("agg_15_top_reason", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1")
def _(t):
    return R.top_reason(t("events"), "user_id", "event_type", "event_id").select("user_id", "event_type", "n")


@query("agg_16_source_class", "SELECT c_custkey, CASE WHEN c_acctbal < -500 THEN 'broken' WHEN c_acctbal < 0 THEN 'unreachable' WHEN n IS NULL THEN 'untried' WHEN open = n THEN 'never done' WHEN late < TIMESTAMP '2000-01-01' THEN 'stale' WHEN open * 2 > n THEN 'failing' WHEN n >= 15 THEN 'busy' ELSE 'ok' END AS class FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS open, max(o_orderdate) AS late FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    o = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.max("o_orderdate").alias("late"))
    j = t("customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    c = F.when(F.col("c_acctbal") < -500, "broken").when(F.col("c_acctbal") < 0, "unreachable").when(F.col("n").isNull(), "untried").when(F.col("open") == F.col("n"), "never done")
    c = c.when(F.col("late") < F.lit("2000-01-01").cast("timestamp"), "stale").when(F.col("open") * 2 > F.col("n"), "failing").when(F.col("n") >= 15, "busy").otherwise("ok")
    return j.select("c_custkey", c.alias("class"))


@query("agg_18_last_event", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def _(t):
    return R.last_event(t("events"), "user_id", "event_id", "event_type")


@query("agg_19_catchup", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON user_id = c_custkey WHERE coalesce(n, 0) < 60")
def _(t):
    n = t("events").groupBy("user_id").agg(F.count("*").alias("n"))
    return t("customer").join(n, F.col("user_id") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n")).where("n < 60")


@query("agg_21_inverted_index", "SELECT token, count(*) AS df, min(p_partkey) AS first FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part) GROUP BY 1")
def _(t):
    x = t("part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("token"))
    return x.groupBy("token").agg(F.count("*").alias("df"), F.min("p_partkey").alias("first"))


@query("agg_17_class_wide_failure", "SELECT o_orderpriority AS host, count(*) AS n, bool_or(o_orderstatus = 'F') AS some_ok FROM orders GROUP BY 1 HAVING count(*) >= 3")
def _(t):
    return t("orders").groupBy(F.col("o_orderpriority").alias("host")).agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderstatus") == "F").alias("some_ok")).where("n >= 3")


@query("agg_31_content_age", "SELECT max(ts) AS latest, datediff('day', CAST(max(ts) AS DATE), DATE '2024-03-01') AS age FROM events")
def _(t):
    return t("events").agg(F.max("ts").alias("latest")).select("latest", F.datediff(F.lit("2024-03-01").cast("date"), F.to_date("latest")).cast("long").alias("age"))


@query("agg_32_table_counts", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'nation', count(*) FROM nation")
def _(t):
    c = [t(x).agg(F.count("*").alias("n")).select(F.lit(x).alias("name"), "n") for x in ("customer", "orders", "nation")]
    return c[0].unionByName(c[1]).unionByName(c[2])


@query("join_01_registry", "SELECT event_id, c_name, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def _(t):
    return t("events").join(t("customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name", "c_mktsegment")


@query("join_02_overlay", "SELECT c_custkey, coalesce(s_name, c_name) AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def _(t):
    return t("customer").join(t("supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("s_name", "c_name").alias("name"))


@query("join_03_translated_only", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(t):
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left_semi")


@query("join_26_parity", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang <> 'en'")
def _(t):
    return t("documents").where("lang <> 'en'").select("doc_id", "source").join(t("labels"), "doc_id", "left_anti")


@query("join_07_band", "SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_totalprice > 0 AND b.o_totalprice > 0 AND abs(a.o_totalprice - b.o_totalprice) <= 0.03::DOUBLE * greatest(a.o_totalprice, b.o_totalprice)")
def _(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return R.band_join(o, o, "o_custkey", "o_totalprice", 0.03).where("a.o_orderkey < b.o_orderkey").select(F.col("a.o_orderkey").alias("x"), F.col("b.o_orderkey").alias("y"))


@query("join_06_duration_tolerance", "SELECT a.p_partkey AS x, b.p_partkey AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= least(90, greatest(40, CAST(trunc(a.p_retailprice * 0.01::DOUBLE) AS INTEGER)))")
def _(t):
    # The tolerance is 90 at most.
    p = t("part").select("p_partkey", "p_brand", "p_retailprice")
    return R.close_pairs(p, "p_brand", "p_retailprice", "p_partkey", 90, lambda x, y: F.abs(x - y) <= X.seek_tolerance(x))


@query("join_10_window", "SELECT a.event_id AS citation, b.event_id AS segment FROM events a JOIN events b ON a.user_id = b.user_id AND abs(epoch(a.ts) - epoch(b.ts)) <= 45 WHERE a.event_type = 'purchase' AND b.event_type = 'view'")
def _(t):
    e = t("events").select("event_id", "user_id", "event_type", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) / 1000000D").alias("s"))
    return R.within(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id", "s", 45).select(F.col("a.event_id").alias("citation"), F.col("b.event_id").alias("segment"))


@query("join_11_as_of", "SELECT a.event_id, b.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def _(t):
    e = t("events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return R.as_of(left, e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_view")), "user_id", "ts", "last_view").select("event_id", "last_view")


@query("join_16_merge", "SELECT coalesce(a.k, b.k) AS k, coalesce(b.latest, a.latest) AS latest, greatest(coalesce(a.n, b.n), coalesce(b.n, a.n)) AS n FROM (SELECT o_custkey AS k, max(o_orderkey) AS latest, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, max(o_orderkey) AS latest, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k")
def _(t):
    side = lambda s: t("orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("latest"), F.count("*").alias("n"))
    return R.full_merge(side("F"), side("O"), "k", ["latest"], ["n"])


@query("join_17_three_way", "WITH s AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') AS b, count(*) FILTER (o_orderstatus <> 'O') AS o, count(*) FILTER (o_orderstatus <> 'P') AS t FROM orders GROUP BY 1) SELECT k, CASE WHEN o = 0 THEN b ELSE o END + CASE WHEN t = 0 THEN b ELSE t END - b AS n FROM s")
def _(t):
    o = t("orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    side = lambda c: o.where(c).groupBy("k").agg(F.count("*").alias("n"))
    return R.three_way(side("o_orderstatus = 'F'"), side("o_orderstatus <> 'O'"), side("o_orderstatus <> 'P'"), "k", "n")


@query("join_19_latest_wins", "SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS o_totalprice, max_by(o_orderpriority, o_orderkey) FILTER (o_orderpriority <> '5-LOW') AS o_orderpriority FROM orders GROUP BY 1")
def _(t):
    # The latest row wins; a value it lacks comes from the latest that has one.
    o = t("orders").withColumn("o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    return o.groupBy("o_custkey").agg(F.max_by("o_totalprice", "o_orderkey").alias("o_totalprice"), F.max_by("o_orderpriority", F.when(F.col("o_orderpriority").isNotNull(), F.col("o_orderkey"))).alias("o_orderpriority"))


@query("join_20_related", "WITH x AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS tag FROM lineitem), d AS (SELECT tag, count(*) AS df FROM x GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60), w AS (SELECT k, tag, 1 / ln(df + 1.5::DOUBLE) AS w FROM x JOIN d USING (tag)), p AS (SELECT a.k AS k, b.k AS peer, sum(a.w) AS s FROM w a JOIN w b ON a.tag = b.tag AND a.k <> b.k GROUP BY 1, 2), q AS (SELECT p.k, peer, round(s + CASE WHEN oa.o_custkey = ob.o_custkey THEN 0.15::DOUBLE ELSE 0 END, 6) AS score, ob.o_orderdate AS day FROM p JOIN orders oa ON oa.o_orderkey = p.k JOIN orders ob ON ob.o_orderkey = peer) SELECT k, peer, score, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, day DESC, peer) AS INTEGER) AS rank FROM q QUALIFY rank <= 5")
def _(t):
    x = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("tag")).distinct()
    items = t("orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderdate")
    return R.related(x, "k", "tag", items, "o_custkey", [F.col("o_orderdate").desc()])


@query("join_21_members", "SELECT DISTINCT user_id FROM (SELECT user_id FROM events WHERE value > 480 UNION ALL SELECT user_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 15)")
def _(t):
    e = t("events")
    return e.where("value > 480").select("user_id").union(e.where("event_type = 'error'").groupBy("user_id").count().where("count >= 15").select("user_id")).distinct()


@query("join_08_name_match", "WITH p AS (SELECT DISTINCT p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS name FROM part), x AS (SELECT DISTINCT name, unnest(string_split(name, ' ')) AS w FROM p), n AS (SELECT name, count(*) AS n FROM x GROUP BY 1) SELECT a.name AS x, b.name AS y, count(*) / (any_value(na.n) + any_value(nb.n) - count(*))::DOUBLE AS jaccard FROM x a JOIN x b ON a.w = b.w AND a.name < b.name JOIN n na ON na.name = a.name JOIN n nb ON nb.name = b.name GROUP BY 1, 2 HAVING jaccard >= 0.5 AND count(*) FILTER (a.w NOT IN ('economy', 'small', 'large', 'red')) > 0")
def _(t):
    # Pairs of different names; rows with one name are that name's class.
    p = t("part").select(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand")).alias("name")).distinct()
    return R.similar_names(p.withColumn("ws", F.split("name", " ")), "name", "ws", stop=("economy", "small", "large", "red"))


@query("win_02_neighbours", "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"))


@query("win_06_first_claim", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1 THEN 'original' ELSE 'duplicate' END AS outcome FROM events")
def _(t):
    e = t("events").withColumn("fp", F.concat_ws("|", "user_id", F.to_date("ts")))
    return R.first_claim(e, "fp", [F.col("ts"), F.col("event_id")]).select("event_id", "outcome")


@query("win_05_running_offset", "SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM lineitem")
def _(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity").rowsBetween(Window.unboundedPreceding, -1)
    return t("lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.sum(F.col("l_quantity").cast("long")).over(w), F.lit(0)).cast("long").alias("before"))


@query("win_10_pages", "SELECT p_partkey, CAST(floor((rn - 1 - 24) / 24) + 1 AS INTEGER) AS page FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rn FROM part) WHERE rn > 24")
def _(t):
    return R.pages(t("part").select("p_partkey", "p_size"), [F.col("p_size").desc(), F.col("p_partkey")], [(F.col("p_size"), True), (F.shiftright("p_partkey", 14), False)], 24, 24).select("p_partkey", "page")


@query("win_12_even_sample", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE i % greatest(1, n // 24) = 0")
def _(t):
    return R.even_sample(t("events").select("event_id", "user_id", "ts"), "user_id", [F.col("ts"), F.col("event_id")], 24).select("event_id")


@query("win_14_budget_prefix", "SELECT l_orderkey, l_linenumber, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING) AS used FROM lineitem) WHERE used <= 100")
def _(t):
    x = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    return R.fill_up(x, "l_orderkey", [F.col("l_linenumber"), F.col("l_partkey"), F.col("q")], "q", 100).select("l_orderkey", "l_linenumber", "used")


@query("win_16_streaks", "WITH i AS (SELECT event_id, user_id, ts, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events) SELECT event_id, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i")
def _(t):
    return R.streaks(t("events").select("event_id", "user_id", "ts", "event_type"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "error").select("event_id", F.col("streak").cast("long").alias("streak"))


@query("win_08_round_robin", "WITH l AS (SELECT l_suppkey AS person, l_partkey AS item, min(l_orderkey) AS o FROM lineitem GROUP BY 1, 2), a AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY o, item) AS p FROM l), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY item ORDER BY p, person) = 1) SELECT item, person, CAST(row_number() OVER (PARTITION BY person ORDER BY p) AS INTEGER) AS turn FROM b")
def _(t):
    queues = t("lineitem").groupBy(F.col("l_suppkey").alias("person"), F.col("l_partkey").alias("item")).agg(F.min("l_orderkey").alias("o"))
    return E.round_robin(queues, "person", "item", "o").select("item", "person", "turn")


ANCHORS = """WITH RECURSIVE e AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS t FROM events WHERE ts IS NOT NULL),
a AS (SELECT user_id, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT a.user_id, min(e.t) FROM a JOIN e ON e.user_id = a.user_id AND e.t >= a.t + 86400 GROUP BY a.user_id, a.t)
SELECT user_id, CAST(t AS INTEGER) AS t FROM a"""


@query("stf_02_anchors", ANCHORS)
def _(t):
    e = t("events").select("user_id", (F.unix_timestamp("ts") - 1704067200).cast("int").alias("t"))
    return e.groupBy("user_id").agg(F.array_sort(F.collect_set("t")).alias("times")).select("user_id", F.explode(S.anchors(F.col("times"), 86400)).alias("t"))


ROLLING = r"""WITH RECURSIVE s AS (SELECT conv_id AS id, turn AS pos, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT id, pos, i, w AS fresh, w[-40:] AS tail FROM s WHERE i = 1
 UNION ALL SELECT id, pos, i, w[k + 1:], (list_concat(tail, w[k + 1:]))[-40:]
 FROM (SELECT s.*, r.tail, coalesce(list_max(list_filter(range(1, least(len(s.w), len(r.tail)) + 1), lambda n: r.tail[-n:] = s.w[1:n])), 0) AS k FROM r JOIN s ON s.id = r.id AND s.i = r.i + 1))
SELECT id, pos, array_to_string(fresh, ' ') AS text FROM r WHERE len(fresh) > 0"""


@query("stf_01_rolling_captions", ROLLING)
def _(t):
    return S.dedupe_rolling(t("conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), "text"))


@query("srt_01_score", "WITH n AS (SELECT user_id, count(*) % 8 AS n FROM events GROUP BY 1) SELECT event_id, CAST(CASE user_id % 3 WHEN 0 THEN 100 WHEN 1 THEN 55 ELSE 25 END - 4 * least(10, datediff('day', CAST(ts AS DATE), DATE '2024-01-31')) + CASE WHEN event_type = 'purchase' THEN 30 ELSE 0 END + CASE WHEN event_id % 50 * 1000 > 20000 THEN 22 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 8 ELSE 0 END - CASE WHEN value < 15 THEN 12 ELSE 0 END - CASE WHEN value > 240 THEN 6 ELSE 0 END + greatest(0, 60 - 12 * n) AS BIGINT) AS score FROM events JOIN n USING (user_id)")
def _(t):
    from ..operators import ledgers as L

    e = t("events")
    e = e.join(e.groupBy("user_id").agg((F.count("*") % 8).alias("n")), "user_id")
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    return e.select("event_id", L.candidate_score(tier=F.col("user_id") % 3 + 1, age=age, official=F.col("event_type") == "purchase", notes=F.col("event_id") % 50 * 1000, chapters=F.col("event_id") % 3 == 0, minutes=F.col("value"), published=F.col("n")).alias("score"))


@query("srt_09_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 60")
def _(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(60)


@query("set_01_union_right_wins", "SELECT k, arg_max(v, side) AS v FROM (SELECT n_nationkey AS k, n_name AS v, 0 AS side FROM nation UNION ALL SELECT r_regionkey, r_name, 1 FROM region) GROUP BY 1")
def _(t):
    a = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"), F.lit(0).alias("side"))
    b = t("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v"), F.lit(1).alias("side"))
    return R.last_event(a.unionByName(b), "k", "side", "v")


@query("set_02_intersection", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def _(t):
    return t("customer").select(F.col("c_custkey").alias("k")).intersect(t("orders").select("o_custkey"))


@query("set_04_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("set_05_ordered_distinct", "SELECT user_id, event_type FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY f) <= 3")
def _(t):
    d = t("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return R.newest_per(d, "user_id", [F.col("f")], 3).select("user_id", "event_type")


@query("str_07_tumbling", "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return ST.tumbling(t("events"), "ts", "7 days", "event_type")


@query("str_f02_squeeze", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def _(t):
    return t("documents").select("doc_id", X.squeeze(F.col("text")).alias("text"))


@query("str_f04_fingerprint", r"SELECT p_partkey, substr(sha1(regexp_replace(regexp_replace(lower(p_name), '^\s*#?\d+\s*[-.:|]\s*', ''), '[^0-9a-z一-鿿]', '', 'g') || '|' || CAST(p_size // 120 AS VARCHAR)), 1, 16) AS fp FROM part")
def _(t):
    return t("part").select("p_partkey", X.fingerprint(F.col("p_name"), F.col("p_size")).alias("fp"))


@query("str_f05_stable_id", "SELECT c_custkey, c_mktsegment || '-' || substr(sha1(c_name), 1, 10) AS id FROM customer")
def _(t):
    return t("customer").select("c_custkey", X.stable_id(F.col("c_mktsegment"), F.col("c_name")).alias("id"))


@query("str_f07_redact", r"SELECT doc_id, regexp_replace(text, '(?i)\b(token|secret|password|api_key)(\s*[=:]\s*)\"?[A-Za-z0-9_\-]{8,}\"?', '\1\2***', 'g') AS text FROM documents")
def _(t):
    return t("documents").select("doc_id", X.redact(F.col("text")).alias("text"))


@query("str_f17_url_normal", "SELECT page_id, regexp_replace(split_part(url, '?', 1), '^[a-z]+://', '') AS u, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages")
def _(t):
    return t("pages").select("page_id", X.url_normal(F.col("url")).alias("u"), X.url_host(F.col("url")).alias("host"))


@query("str_f23_words", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9'']+')) AS INTEGER) AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", X.word_count(F.col("text")).alias("n"))


@query("str_f33_escape", """SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS text FROM documents""")
def _(t):
    return t("documents").select("doc_id", X.escape_html(F.col("text")).alias("text"))


@query("dt_03_clock", "SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS c FROM (SELECT o_orderkey, CAST(trunc(o_totalprice / 10) AS INTEGER) AS s FROM orders)")
def _(t):
    return t("orders").select("o_orderkey", X.clock(F.col("o_totalprice") / 10).alias("c"))


@query("dt_05_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def _(t):
    return t("events").select("event_id", X.iso(F.col("ts")).alias("iso"))


@query("flt_13_followed", "SELECT c_custkey FROM customer WHERE c_custkey % 50 = 0 OR c_nationkey = 1 OR c_custkey IN (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 24)")
def _(t):
    top = t("events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id").limit(24).select(F.col("user_id").alias("c_custkey"))
    c = t("customer")
    return c.where("c_custkey % 50 = 0 OR c_nationkey = 1").select("c_custkey").union(c.select("c_custkey").join(top, "c_custkey", "left_semi")).distinct()


@query("flt_16_gates", "SELECT d.doc_id, coalesce(quality >= 1, true) AS triage, coalesce(quality >= 1, false) AS review FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    j = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return j.select("doc_id", X.gate_passes(F.col("quality"), 1, True).alias("triage"), X.gate_passes(F.col("quality"), 1, False).alias("review"))


@query("flt_27_search", "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'the') AND contains(lower(concat_ws(' ', source, lang, text)), 'src1') AND contains(lower(source), '1') AND lang = 'en' ORDER BY doc_id LIMIT 50")
def _(t):
    # Terms over the whole haystack, a part of the show's name, a category, and at most 50 hits however many are asked for.
    hay = F.lower(F.concat_ws(" ", "source", "lang", "text"))
    hits = t("documents").where(F.forall(F.split(F.lit("the src1"), r"\s+"), lambda w: F.contains(hay, w)) & F.contains(F.lower("source"), F.lit("1")) & (F.col("lang") == "en"))
    return hits.select("doc_id").orderBy("doc_id").limit(max(1, min(80, 50)))


@query("rul_01_judge", "SELECT user_id, CASE WHEN n < 4 THEN NULL WHEN err * 4 > n THEN 'demote' WHEN latest < TIMESTAMP '2024-01-25' THEN 'stale' WHEN ok * 4 < n THEN 'remove' END AS action FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS err, count(*) FILTER (value >= 70) AS ok, max(ts) AS latest FROM events GROUP BY 1)")
def _(t):
    m = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("err"), F.count_if(F.col("value") >= 70).alias("ok"), F.max("ts").alias("latest"))
    action = F.when(F.col("n") < 4, None).when(F.col("err") * 4 > F.col("n"), "demote").when(F.col("latest") < F.lit("2024-01-25").cast("timestamp"), "stale").when(F.col("ok") * 4 < F.col("n"), "remove")
    return m.select("user_id", action.alias("action"))
