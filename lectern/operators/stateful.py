"""Folds over ordered rows that no window frame expresses."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def anchors(times: Column, every: int = 60) -> Column:
    """STF-02: of ascending times, those at least every seconds after the last one kept."""
    start = F.array().cast("array<int>")
    return F.aggregate(times, start, lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) >= every), F.array_append(kept, t)).otherwise(kept))


def overlap(said: Sequence[str], new: Sequence[str]) -> int:
    """How many words at the end of said are the beginning of new, at most all of new; one pass over each, by the borders of new's beginnings."""
    border = [0] * len(new)
    for i in range(1, len(new)):
        n = border[i - 1]
        while n and new[n] != new[i]:
            n = border[n - 1]
        border[i] = n + (new[n] == new[i])
    n = 0
    for w in said if new else ():
        while n and (n == len(new) or new[n] != w):
            n = border[n - 1]
        n += new[n] == w
    return n


def dedupe_rolling(segments: DataFrame, key: str = "id", pos: str = "pos", text: str = "text", keep: int = 40) -> DataFrame:
    """STF-01: from each caption goes the longest beginning that ends the last keep words emitted; emptied captions go.

    Recordings lie sorted in their tasks and are streamed through; a task holds a batch and keep words, however long a recording is.
    """

    def fold(frames):
        at, said = None, deque(maxlen=keep)
        for frame in frames:
            out = []
            for k, line in zip(frame[key], frame[text], strict=True):
                if k != at:
                    at, said = k, deque(maxlen=keep)
                words = (line or "").split()
                words = words[overlap(said, words) :]
                said.extend(words)
                out.append(" ".join(words))
            frame = frame.assign(**{text: out})
            yield frame[frame[text] != ""]

    return segments.repartition(key).sortWithinPartitions(key, pos).mapInPandas(fold, segments.schema)


def blocks(rows: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """STF-03: rows in blocks that begin at the first row width or more after the block's first; as (key, block, start, n).

    Rows are counted by (key, at) before the fold, so a group holds a recording's distinct seconds, however many rows it has. Rows without a time have no block.
    """

    def fold(k: tuple, times: pd.DataFrame) -> pd.DataFrame:
        times = times.sort_values(at)
        out: list[list] = []
        for s, n in zip(times[at], times["_n"], strict=True):
            if not out or s - out[-1][0] >= width:
                out.append([s, 0])
            out[-1][1] += n
        return pd.DataFrame([(k[0], i, s, n) for i, (s, n) in enumerate(out)], columns=[key, "block", "start", "n"])

    kind = rows.schema[key].dataType.simpleString()
    times = rows.where(F.col(at).isNotNull()).groupBy(key, at).agg(F.count("*").alias("_n"))
    return times.groupBy(key).applyInPandas(fold, f"{key} {kind}, block long, start long, n long")


def chunks(texts: DataFrame, key: str, text: str, size: int, anchor: str = "\n[") -> DataFrame:
    """STF-05: pieces of at most size characters, cut before the last anchor in the second half of the window, else hard; joined they are the text. Null and empty texts have no piece."""

    @F.udf(T.ArrayType(T.StringType()), useArrow=False)
    def cut(s: str | None) -> list[str]:
        out, at = [], 0
        while s and at < len(s):
            end = at + size
            if end < len(s) and (found := s.rfind(anchor, at + size // 2, end)) > at:
                end = found
            out.append(s[at:end])
            at = end
        return out

    # Texts come in batches of 100, not the 10,000 of Arrow, which a task would hold at once.
    return texts.select(key, F.posexplode(cut(text)).alias("pos", "piece"))
