"""Queries of the served interface and of tables that are replaced."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import states
from ..serving import search, tools
from ..sinks import tables
from .queries import query


def index(t):
    """Documents as items: the source is the show, the language the category, the number a day."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    return t("documents").select(
        F.col("doc_id").alias("slug"), F.substring("text", 1, 40).alias("title"), F.substring("text", 41, 200).alias("dek"), F.concat(F.lit("The "), "source").alias("show"), F.col("source").alias("show_id"),
        F.col("lang").alias("cat"), F.floor(F.col("n_chars") / 900).alias("minutes"), F.array("lang", "source").alias("tags"), day.alias("published"),
    )


INDEX = "WITH i AS (SELECT doc_id AS slug, substr(text, 1, 40) AS title, substr(text, 41, 200) AS dek, 'The ' || source AS show_name, source AS show_id, lang AS cat, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS published FROM documents) "
HAY = "lower(concat_ws(' ', coalesce(title, ''), coalesce(dek, ''), coalesce(show_name, ''), concat_ws(' ', cat, show_id)))"


@query("snk_17_search", INDEX + f"SELECT slug, show_name, published FROM i WHERE contains({HAY}, 'the') AND contains({HAY}, 'en') AND contains(lower(show_name || ' ' || show_id), 'src1') ORDER BY published DESC, slug LIMIT 50")
def _(t):
    return tools.newest_first(tools.found(index(t), "The EN", "SRC1")).limit(tools.clamp(500)).select("slug", F.col("show").alias("show_name"), "published")


WHOLE_ROWS = "WITH i AS (SELECT doc_id, source, lang, lower(concat_ws(' ', source, lang, text)) AS hay FROM documents) "
SEARCH_ROWS = "WITH i AS (SELECT doc_id, source, lang, doc_id >= 900 AS fresh, substr(lower(concat_ws(' ', source, lang, text)), 1, 5000) AS hay FROM documents) "


def whole():
    """What a kept document is searched in: source, language and the whole text."""
    return F.lower(F.concat_ws(" ", "show", "cat", "text"))


def kept_documents(t, hay=whole):
    """Documents in a kept index, in two batches; some of the first come again in the second, which replaces them."""
    d = t("documents").select("doc_id", F.col("source").alias("show"), F.col("source").alias("show_id"), F.col("lang").alias("cat"), "text")
    index = search.SearchIndex(d.sparkSession, tables.shared_folder(d.sparkSession), "doc_id", hay, buckets=32, parts=16)
    older = d.where("doc_id % 3 < 2").withColumn("text", F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("older thation words "), "text")).otherwise(F.col("text")))
    index.add(older)
    index.add(d.where("doc_id % 3 > 0"))
    return index


@query("flt_27_kept_search", WHOLE_ROWS + "SELECT doc_id FROM i WHERE contains(hay, 'thation') AND contains(hay, 'erthe') AND contains(lower(source), '1') AND lang = 'en'")
def _(t):
    return kept_documents(t).search("Thation erthe", "1", "en").select("doc_id")


@query("flt_28_kept_tabs", SEARCH_ROWS + "SELECT doc_id, 'new' AS tab FROM i WHERE contains(hay, 'thation') UNION ALL SELECT doc_id, 'core' FROM i WHERE contains(hay, 'thation') AND source = 'src1' UNION ALL SELECT doc_id, 'none' FROM i WHERE fresh")
def _(t):
    # Its SQL searches the first 5000 characters.
    index = kept_documents(t, lambda: F.substring(whole(), 1, 5000))
    hits, items = index.search("thation"), index.items()
    show = lambda q, tab, name: search.browse(hits, items, q, tab, new=F.col("doc_id") >= 900, core=F.col("show") == "src1").select("doc_id", F.lit(name).alias("tab"))
    return show("thation", "new", "new").unionByName(show("thation", "core", "core")).unionByName(show("", "new", "none"))


@query("snk_17_shows", INDEX + "SELECT show_id AS id, min(show_name) AS show_name, count(*) AS episodes, max(published) AS latest FROM i WHERE show_id IS NOT NULL GROUP BY 1")
def _(t):
    return tools.shows(index(t)).withColumnRenamed("show", "show_name")


@query("src_23_kept_index", INDEX + "SELECT cat, count(*) AS n FROM i GROUP BY 1")
def _(t):
    kept = tools.Kept(lambda: index(t).select("slug", "cat"))
    return kept.get().groupBy("cat").agg(F.count("*").alias("n"))


@query("snk_01_replaced", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def _(t):
    # The second version is made from the first, in whose place it comes.
    o = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = tables.shared_folder(o.sparkSession)
    first = tables.replace(o, path)
    return tables.replace(first.where("o_orderstatus <> 'F'").drop("o_orderstatus"), path)


@query("aux_27_reconciled", "WITH b AS (SELECT p_partkey AS k, p_name AS v FROM part WHERE p_size <= 45), n AS (SELECT p_partkey AS k, CASE WHEN p_size = 20 THEN NULL ELSE p_name END AS v FROM part WHERE p_size > 5) SELECT coalesce(b.k, n.k) AS k, CASE WHEN n.k IS NULL THEN 'restore' WHEN coalesce(b.k, n.k) % 3 = 0 AND b.k IS NULL THEN 'remove' WHEN coalesce(b.k, n.k) % 3 = 0 THEN 'reset' ELSE 'stage' END AS action FROM b FULL JOIN n ON b.k = n.k WHERE n.k IS NULL OR b.k IS NULL OR b.v IS DISTINCT FROM n.v")
def _(t):
    p = t("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v"), "p_size")
    now = p.where("p_size > 5").withColumn("v", F.when(F.col("p_size") != 20, F.col("v")))
    return states.reconciled(p.where("p_size <= 45"), now, "k", "v", F.col("k") % 3 == 0)


@query("udf_09_leads", r"WITH l AS (SELECT trim(substr(trim(regexp_replace(substr(text, 1, 30), '\s+', ' ', 'g')), 1, 60)) AS name, trim(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 40)) AS why FROM documents WHERE text IS NOT NULL) SELECT name, min(why) AS why FROM l WHERE name <> '' AND name NOT IN (SELECT trim(regexp_replace(substr(text, 1, 30), '\s+', ' ', 'g')) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) GROUP BY 1")
def _(t):
    # A document stands for a reply that names its beginning; those of even number are known already.
    start = F.substring("text", 1, 30)
    d = t("documents").where("text is not null")
    replies = d.select(F.to_json(F.struct(F.array(F.struct(start.alias("name"), F.col("text").alias("why"))).alias("leads"))).alias("reply"))
    known = d.where("doc_id % 2 = 0").select(F.trim(F.regexp_replace(start, r"\s+", " ")).alias("name"))
    return states.leads(replies, "reply", known, "name")
