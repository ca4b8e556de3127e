"""The training-data queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, conversations, decontam, html, knn, langid, licenses, mixing, neardup, quality, sharding, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    rows = warc.read_chunks(index, with_data=False, only_last=True)
    return rows.select(F.col("record_id").alias("page_id"), F.col("total_bytes").alias("payload_bytes"), F.col("running_sha1").alias("payload_digest"), "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS head FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> head THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM r
"""


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", F.concat_ws(",", "licenses").alias("licenses"), F.size("matches").cast("long").alias("n_matches"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("containment"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return knn.top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=["doc_id"]).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs), keep=["doc_id"])
    return found.select("doc_id", quality.held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), decontam.items_digest().alias("items_sha256"), "contaminated")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
b2 AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b2)),
ks AS (SELECT DISTINCT k FROM win),
p AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks),
h AS (SELECT p.rid, p.i, p.k, win.item_id FROM (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM p) p JOIN win USING (k, g)),
hw AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM h) GROUP BY rid),
hi AS (SELECT rid, count(DISTINCT item_id) AS n, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n, 0) AS BIGINT) AS n_items,
       coalesce(hi.s, sha256('')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.by_position(mixing.mix(docs, keep=["doc_id"]).drop("positions"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS n FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][n % 3 + 1] AS w, 2.0::DOUBLE * source_size AS top, [-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE][n % 3 + 1] AS a FROM n),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY top / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, a, CASE WHEN level * w >= top THEN top ELSE max(CASE WHEN level * w < top THEN level END) OVER () * w END AS target FROM l),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.a,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0::DOUBLE AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE least(2, greatest(0, CAST(ceil((target - middle) / source_size) AS BIGINT))) END AS takes, least(1.0::DOUBLE, middle / target) AS x FROM o)
SELECT doc_id, size, source_size, target, CAST(takes * size AS BIGINT) AS taken,
       CASE WHEN takes > 0 THEN CAST(floor((CASE WHEN a = 0 THEN x ELSE 2 * x / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * x)) END) * 1e6::DOUBLE) AS BIGINT) END AS position
FROM k
"""

def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: In SQL the edits stay strings: states 0 (nothing), 1 (system), 2 (user) and 3 (assistant), insertion by insertion and turn by turn.
OP11_SQL = r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT * EXCLUDE (k), xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS UBIGINT))),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384::UBIGINT * (y & 1)))), 4294967295::UBIGINT) % 20 AS k FROM o),
m AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE k <> 0),
e AS (SELECT *, right(rtrim(text, E' 	
'), 1) AS last_char, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
t AS MATERIALIZED (SELECT *, CASE WHEN last_char = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT contains('.!?', last_char) THEN 'truncated' END AS fault FROM e),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (2, 2, 6, 'II'), (3, 3, 0, ''), (3, 2, 3, 'I'), (3, 3, 6, 'II')) v(s, s2, ic, ie)),
mv AS (SELECT * FROM (VALUES (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (2, 3, 'K', 'a'), (3, 2, 'K', 'u'), (0, 2, 'R', ''), (1, 2, 'R', ''), (2, 3, 'R', ''), (3, 2, 'R', ''), (0, 0, 'D', ''), (1, 1, 'D', ''), (2, 2, 'D', ''), (3, 3, 'D', '')) v(s2, s3, e, r)),
name AS (SELECT * FROM (VALUES (0, '', []::VARCHAR[]), (1, 'I', ['user:']), (2, 'I', ['assistant:']), (3, 'I', ['user:']), (0, 'II', ['user:', 'assistant:']), (1, 'II', ['user:', 'assistant:']), (2, 'II', ['assistant:', 'user:']), (3, 'II', ['user:', 'assistant:']), (1, '', []), (2, '', []), (3, '', []), (0, 'I', ['user:'])) v(s, ie, rows)),
path(conv_id, i, s, best) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, {'c': CAST(0 AS BIGINT), 'a': '', 'r': []::VARCHAR[]} FROM n
  UNION ALL
  SELECT p.conv_id, t.i, mv.s3, min({'c': CAST(p.best.c + ins.ic + CASE mv.e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN t.fault = 'truncated' AND mv.e <> 'D' THEN 3 ELSE 0 END AS BIGINT), 'a': p.best.a || ins.ie || mv.e,
      'r': list_concat(list_concat(p.best.r, name.rows), CASE mv.e WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [t.role || ':' || t.text] ELSE [CASE mv.s3 WHEN 3 THEN 'assistant:' ELSE 'user:' END || t.text] END)})
  FROM path p JOIN t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1 JOIN ins ON ins.s = p.s JOIN name ON name.s = p.s AND name.ie = ins.ie JOIN mv ON mv.s2 = ins.s2
  WHERE mv.e = 'D' OR (coalesce(t.fault, '') NOT IN ('blank', 'duplicate') AND (mv.e = 'R' OR mv.r = left(t.role, 1)))
  GROUP BY p.conv_id, t.i, mv.s3),
z AS (SELECT p.conv_id, min({'c': p.best.c + ins.ic, 'a': p.best.a || ins.ie, 'r': list_concat(p.best.r, name.rows)}) AS b
      FROM path p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.n = p.i JOIN ins ON ins.s = p.s AND ins.s2 IN (0, 3) JOIN name ON name.s = p.s AND name.ie = ins.ie GROUP BY p.conv_id)
SELECT c.conv_id, CAST(coalesce(n.gaps, 0) AS BIGINT) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
       coalesce(z.b.c, 0) AS cost, coalesce(z.b.a, '') AS audit, sha256(coalesce(array_to_string(z.b.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _lloyd_sql(rounds: int) -> str:
    far = "list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT v.rid, any_value(v.vec_id) AS vec_id, any_value(v.e) AS e, min({{'d': CAST({far} AS BIGINT), 'c': c.c}}) AS m FROM v, c{i} c GROUP BY v.rid)")
        if i < rounds:
            steps.append(f"u{i} AS (SELECT m.c AS c, unnest(e) AS x, unnest(range(1, 65)) AS p FROM a{i})")
            steps.append(f"f{i} AS (SELECT c, list(q ORDER BY p) AS e FROM (SELECT c, p, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q FROM u{i} GROUP BY c, p) GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(f.e, c.e) AS e FROM c{i} c LEFT JOIN f{i} f ON f.c = c.c)")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS e FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS INTEGER) AS c, e FROM v QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) <= 16),
{", ".join(steps)}
SELECT a.vec_id, c.c AS cluster, a.m.d AS distance, CAST(sum(a.m.d) OVER (PARTITION BY c.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.m.c = c.c
"""


OP12_SQL = _lloyd_sql(3)

def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_licenses": op2_licenses,
    "op3_top_k": op3_top_k,
    "op4_quality": op4_quality,
    "op5_main_text": op5_main_text,
    "op6_language": op6_language,
    "op7_decontaminate": op7_decontaminate,
    "op8_shard": op8_shard,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_mix": op10_mix,
    "op11_conversations": op11_conversations,
    "op12_centroids": op12_centroids,
    "op13_simhash": op13_simhash,
}
ORACLES = {"op1_warc": OP1_SQL, "op3_top_k": OP3_SQL, "op7_decontaminate": OP7_SQL, "op10_mix": OP10_SQL, "op11_conversations": OP11_SQL, "op12_centroids": OP12_SQL}
