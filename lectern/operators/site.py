"""SNK-08: the families of a site's pages as rows of (family, path, html), for `sinks.pages.publish`. Plain markup: headings, lists and links; texts are escaped."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape_html
from .relational import newest_per

HEAD = 24  # fixed value: items on a list page


def text(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return escape_html(F.coalesce(x.cast("string"), F.lit("")))


def link(folder: str, key: Column, said: Column) -> Column:
    return F.concat(F.lit(f'<a href="/{folder}/'), key, F.lit('.html">'), said, F.lit("</a>"))


def page(family: str, path: Column, title: Column, *body: Column) -> list[Column]:
    """(family, path, html) of a page."""
    html = F.concat(F.lit("<!doctype html><title>"), title, F.lit("</title><h1>"), title, F.lit("</h1>"), *body)
    return [F.lit(family).alias("family"), path.alias("path"), html.alias("html")]


def _listed(rows: Column) -> Column:
    """The links of collected (_rn, slug, title), in order."""
    return F.concat(F.lit("<ol>"), F.array_join(F.transform(F.array_sort(rows), lambda r: F.concat(F.lit("<li>"), link("e", r["slug"], text(r["title"])), F.lit("</li>"))), ""), F.lit("</ol>"))


def items_pages(items: DataFrame, names: DataFrame) -> DataFrame:
    """A page for each item: its title, dek, and the source by its name, or its key where it has none."""
    x = items.join(names, "source", "left")
    source = F.when(F.col("source").isNotNull(), F.concat(F.lit("<p>"), link("s", F.col("source").cast("string"), text(F.coalesce("name", F.col("source").cast("string")))), F.lit("</p>")))
    return x.select(*page("episode", F.concat(F.lit("e/"), "slug", F.lit(".html")), text("title"), F.lit("<p>"), text("dek"), F.lit("</p>"), F.coalesce(source, F.lit(""))))


def group_pages(items: DataFrame, by: str, folder: str, family: str, order: Sequence[Column], said: DataFrame | None = None, head: int = HEAD) -> DataFrame:
    """A page for each value of by that isn't null: the number of its items, the last day, and links to its first head items by order.

    Items are counted, and cut to each group's first, before they are shuffled. said is (by, name), names to show.
    """
    own = items.where(F.col(by).isNotNull())
    first = newest_per(own, by, order, head, "_rn").groupBy(by).agg(F.collect_list(F.struct("_rn", "slug", "title")).alias("_x"))
    x = own.groupBy(by).agg(F.count("*").alias("_n"), F.max("day").alias("_day")).join(first, by)
    x = x.join(said, by, "left") if said is not None else x.withColumn("name", F.lit(None).cast("string"))
    title = text(F.coalesce("name", F.col(by).cast("string")))
    return x.select(*page(family, F.concat(F.lit(f"{folder}/"), F.col(by).cast("string"), F.lit(".html")), title, F.lit("<p>"), F.col("_n").cast("string"), F.lit(" / "), text("_day"), F.lit("</p>"), _listed(F.col("_x"))))


def home_page(items: DataFrame, order: Sequence[Column], title: str, head: int = HEAD) -> DataFrame:
    """The first head items by order, in one page, which is there without items too. Only they are numbered in one task."""
    top = items.orderBy(*order).limit(head).withColumn("_rn", F.row_number().over(Window.orderBy(*order)))
    return top.agg(F.collect_list(F.struct("_rn", "slug", "title")).alias("_x")).select(*page("home", F.lit("index.html"), F.lit(title), _listed(F.col("_x"))))


def alias_pages(aliases: DataFrame, items: DataFrame) -> DataFrame:
    """A page under each old slug that no item has any more, which leads to the item it has become; aliases is (old, slug)."""
    live = items.select("slug").distinct()
    gone = aliases.groupBy("old").agg(F.min("slug").alias("slug")).join(live, "slug", "left_semi").join(live.withColumnRenamed("slug", "old"), "old", "left_anti")
    to = F.concat(F.lit('<meta http-equiv="refresh" content="0; url=/e/'), "slug", F.lit('.html">'))
    return gone.select(*page("alias", F.concat(F.lit("e/"), "old", F.lit(".html")), text("slug"), to))


def site(items: DataFrame, names: DataFrame, aliases: DataFrame, order: Sequence[Column], *, title: str) -> DataFrame:
    """(family, path, html) of all pages: home, an item's, a source's, a category's, an old name's, and the one for what isn't there.

    items is (slug, title, dek, source, category, day), names (source, name) with a source once, order total. Items without a slug have no page; slugs, sources and
    categories are used in paths as they are.
    """
    own = items.where(F.col("slug").isNotNull())
    none = own.sparkSession.range(1).select(*page("404", F.lit("404.html"), F.lit("404")))
    families = [home_page(own, order, title), items_pages(own, names), group_pages(own, "source", "s", "source", order, names), group_pages(own, "category", "c", "category", order), alias_pages(aliases, own), none]
    return functools.reduce(DataFrame.unionByName, families)
