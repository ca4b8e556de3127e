"""Syndication feeds as rows, by expressions on the feed's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cleaned(xml: Column) -> Column:
    """SRC-04: control characters, which no XML parser takes, are dropped."""
    return F.regexp_replace(xml, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")


def root_of(xml: Column) -> Column:
    """SRC-04: `rss` or `atom` by the first element, null for anything else."""
    name = F.lower(F.regexp_extract(xml, r"^\s*(?:<\?[^>]*\?>|<!--[\s\S]*?-->|\s)*<([A-Za-z:]+)", 1))
    return F.when(name.isin("rss", "rdf:rdf"), "rss").when(name == "feed", "atom")


def element(part: Column, name: str) -> Column:
    """Text of the first element of that name; null if it is absent or blank."""
    body = F.regexp_extract(part, rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", 1)
    return F.nullif(F.trim(F.regexp_replace(body, r"^\s*<!\[CDATA\[|\]\]>\s*$", "")), F.lit(""))


def attribute(part: Column, name: str, attr: str) -> Column:
    """An attribute of the first element of that name; null if it is absent or empty."""
    return F.nullif(F.regexp_extract(part, rf'(?s)<{name}\b[^>]*?\s{attr}="([^"]*)"', 1), F.lit(""))


def parts(feeds: DataFrame, key: str, xml: str, name: str) -> DataFrame:
    found = F.regexp_extract_all(cleaned(F.col(xml)), F.lit(rf"(?s)<{name}\b[^>]*>(.*?)</{name}>"), 1)
    return feeds.withColumn("_art", attribute(F.col(xml), "itunes:image", "href")).select(key, "_art", F.posexplode(found).alias("pos", "part"))


def rss(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """SRC-02: (key, pos, title, guid, audio, art, notes): guid falls back to link, then title; audio is the enclosure unless it is an image or a text, then media
    content; art the item's, else the channel's; notes the content, description or summary.
    """
    x, part = parts(feeds, key, xml, "item"), F.col("part")
    kind = F.coalesce(attribute(part, "enclosure", "type"), F.lit(""))
    audio = F.when(~kind.rlike("^(image|text)/"), attribute(part, "enclosure", "url"))
    return x.select(
        key, "pos", element(part, "title").alias("title"), F.coalesce(element(part, "guid"), element(part, "link"), element(part, "title")).alias("guid"),
        F.coalesce(audio, attribute(part, "media:content", "url")).alias("audio"), F.coalesce(attribute(part, "itunes:image", "href"), F.col("_art")).alias("art"),
        F.coalesce(element(part, "content:encoded"), element(part, "description"), element(part, "itunes:summary")).alias("notes"),
    )


def atom(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """SRC-03: the same row shape from entries, without those whose link is a short-form one; audio is null."""
    x, part = parts(feeds, key, xml, "entry"), F.col("part")
    link = attribute(part, "link", "href")
    rows = x.select(
        key, "pos", element(part, "title").alias("title"), F.coalesce(element(part, "id"), link, element(part, "title")).alias("guid"), F.lit(None).cast("string").alias("audio"),
        F.col("_art").alias("art"), F.coalesce(element(part, "content"), element(part, "summary")).alias("notes"), link.alias("_link"),
    )
    return rows.where(~F.coalesce(F.contains("_link", F.lit("/shorts/")), F.lit(False))).drop("_link")


def items(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """SRC-04: items of feeds of either kind; what is neither has none."""
    kind = root_of(cleaned(F.col(xml)))
    return rss(feeds.where(kind == "rss"), key, xml).unionByName(atom(feeds.where(kind == "atom"), key, xml))


def listing(primary: DataFrame, fallback: DataFrame, key: str, at: str) -> DataFrame:
    """SRC-05: the rows of each source's primary listing, or of its fallback where there are none, numbered newest first, undated last."""
    from pyspark.sql import Window

    rest = fallback.join(primary.select(key).distinct(), key, "left_anti")
    rows = primary.unionByName(rest)
    order = [F.col(at).desc_nulls_last(), *[F.col(c) for c in rows.columns if c not in (key, at)]]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
