"""Timed text and feeds as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUE = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,]\d{3}\s*-->"


def cues(files: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """SRC-09: cues of WebVTT and SRT texts as (key, pos, t, text): settings, markup, references and speaker marks are dropped."""
    blocks = files.select(key, F.posexplode(F.split(F.regexp_replace(body, "\r", ""), r"\n\s*\n")).alias("pos", "block"))
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract("block", CUE, i), F.lit("")).cast("int"), F.lit(0))
    text = F.regexp_replace(F.regexp_replace(F.regexp_extract("block", r"-->[^\n]*\n([\s\S]*)", 1), "<[^>]*>", ""), r"&[a-z#0-9]+;|>>", " ")
    return blocks.where(F.col("block").rlike(CUE)).select(key, "pos", (part(1) * 3600 + part(2) * 60 + part(3)).alias("t"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text")).where("text != ''")


def speaker_lines(files: DataFrame, key: str = "id", body: str = "body", least: int = 5, share: float = 0.5) -> DataFrame:
    """SRC-12: lines `Name [hh:mm:ss]: text`, if there are at least least of them and they hold share of the text."""
    lines = files.select(key, F.length(body).alias("all"), F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    pattern = r"^\s*([^\[\]:]{1,60}?)\s*\[(?:(\d+):)?(\d{1,2}):(\d{2})\]\s*:?\s*(.+)$"
    x = lines.where(F.col("line").rlike(pattern))
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract("line", pattern, i), F.lit("")).cast("int"), F.lit(0))
    x = x.select(key, "all", "pos", F.regexp_extract("line", pattern, 1).alias("spk"), (part(2) * 3600 + part(3) * 60 + part(4)).alias("t"), F.regexp_extract("line", pattern, 5).alias("text"), F.length("line").alias("n"))
    good = x.groupBy(key).agg(F.count("*").alias("c"), F.sum("n").alias("held"), F.max("all").alias("all")).where((F.col("c") >= least) & (F.col("held") >= share * F.col("all")))
    return x.join(good.select(key), key, "left_semi").select(key, "pos", "t", "spk", "text")


def untimed(texts: DataFrame, key: str, body: str, span: str) -> DataFrame:
    """SRC-11: lines of an untimed text with times interpolated by the characters before them; as (key, pos, t, text). A text's lengths are summed where
    it lies (Arrow), once over its lines, so nothing is shuffled; t is null where a text has no characters.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, text, seconds in zip(b[key], b[body], b[span], strict=True):
                lines = [] if text is None else text.split("\n")
                starts = np.cumsum([0, *map(len, lines)], dtype=np.int64)
                t = [int(seconds) * int(s) // int(starts[-1]) if starts[-1] else None for s in starts[:-1]]
                yield pd.DataFrame({key: k, "pos": np.arange(len(lines), dtype=np.int32), "t": pd.array(t, "Int64"), "text": lines})

    rows = texts.select(key, body, F.col(span).cast("long").alias(span))
    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, pos int, t long, text string")
