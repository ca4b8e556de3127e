"""FLT-18: what of a digest its transcript bears out, and whether the rest may be published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import forms as X
from ..functions import numbers as N
from ..functions import text as T

# The gate's thresholds.
GRACE, UNKNOWN, BODY, QUOTE, POINTS, QUOTES, TIMES, LONG, SPAN, TITLE, DEK, TERMS = 180, 1_000_000_000, 60, 24, 5, 2, 4, 600, 0.2, 6, 20, 6
LEAK = r"\b(the transcript (was|is) (empty|truncated|missing)|as an ai (language )?model|i (could not|cannot) access)\b"


def spoken_at(quote: Column, segments: Column) -> Column:
    """JOIN-11: the time of the last of segments that begins at or before the quote's place in their joined text; null if it isn't there. Quote and texts are in normal form."""
    joined = F.array_join(F.transform(segments, lambda s: s["text"]), " ")
    place = F.position(F.trim(F.split_part(quote, F.lit("…"), F.lit(1))), joined)  # 0 if absent
    start = F.struct(F.lit(1).alias("at"), F.lit(None).cast("int").alias("t"))
    step = lambda acc, s: F.struct((acc["at"] + F.length(s["text"]) + 1).alias("at"), F.when(acc["at"] <= place, s["t"]).otherwise(acc["t"]).alias("t"))
    return F.when(place > 0, F.aggregate(segments, start, step, lambda acc: acc["t"]))


def check(digests: DataFrame) -> DataFrame:
    """digests with pruned points, quotes and facts, the counts verified_quotes and grounded_facts, problems, publish and approx_timestamps.

    Columns: title, dek; points of (t, h, body), quotes of (t, raw), facts of (k, v, t), segments of (t, text), duration (null: unknown) and timed.
    A null or empty array has nothing to keep; null texts count as empty. Every column is a function of its row, so there is no shuffle.
    """
    empty = lambda c: F.coalesce(c, F.array().cast(digests.schema[c].dataType))
    d = digests.withColumns({c: empty(c) for c in ("points", "quotes", "facts", "segments")})
    limit = F.coalesce(F.col("duration") + GRACE, F.lit(UNKNOWN))
    d = d.withColumns({
        "_limit": limit,
        "_text": F.array_join(F.transform("segments", lambda s: F.coalesce(s["text"], F.lit(""))), " "),
        "_blob": F.concat_ws(" ", F.col("title"), F.col("dek"), F.array_join(F.transform("points", lambda p: p["body"]), " ")),
        "_had": F.struct(*[F.size(c).alias(c) for c in ("points", "quotes", "facts")]),
    })
    d = d.withColumns({"_hay": T.squeeze(F.lower(F.regexp_replace("_text", r"[^\p{L}\p{N}]+", " "))), "_true": N.numbers_in(F.transform("facts", lambda f: f["v"]), F.col("_text"))})
    normal = lambda c: T.squeeze(F.lower(F.regexp_replace(F.regexp_replace(c, r"\.\.\.", "…"), r"[^\p{L}\p{N}…]+", " ")))
    segs = F.transform("segments", lambda s: F.struct(s["t"].cast("int").alias("t"), normal(F.coalesce(s["text"], F.lit(""))).alias("text")))
    valid = lambda t: F.coalesce((t >= 0) & (t <= F.col("_limit")), F.lit(False))
    d = d.withColumn("_segs", segs)
    kept_time = lambda q: F.when(valid(q["t"]), q["t"]).otherwise(spoken_at(normal(q["raw"]), F.col("_segs")))
    quotes = F.transform("quotes", lambda q: F.struct(kept_time(q).alias("t"), q["raw"].alias("raw")))
    d = d.withColumns({
        "points": F.filter("points", lambda p: valid(p["t"]) & F.coalesce(F.length(p["body"]) >= BODY, F.lit(False))),
        "quotes": F.filter(quotes, lambda q: F.coalesce((F.length(q["raw"]) >= QUOTE) & T.quote_in(normal(q["raw"]), F.col("_hay")), F.lit(False)) & q["t"].isNotNull()),
        "facts": F.transform(
            F.filter(F.arrays_zip(F.col("facts").alias("f"), F.col("_true").alias("ok")), lambda z: z["ok"] & F.coalesce((z["f"]["k"] != "") & (z["f"]["v"] != ""), F.lit(False))),
            lambda z: F.struct(z["f"]["k"].alias("k"), z["f"]["v"].alias("v"), F.when(valid(z["f"]["t"]), z["f"]["t"]).alias("t")),
        ),
    })
    times = F.transform("points", lambda p: p["t"])
    distinct, span = F.size(F.array_distinct(times)), F.array_max(times) - F.array_min(times)
    loose = F.col("timed") & (F.size("points") >= POINTS) & (distinct < TIMES)
    narrow = F.col("timed") & ~loose & (F.col("duration") > LONG) & (span < SPAN * F.col("duration"))
    said = lambda c, text: F.when(F.coalesce(c, F.lit(False)), F.lit(text))
    lost = lambda c: said(F.size(c) < F.col(f"_had.{c}"), f"{c} pruned")
    fatal = F.array_compact(F.array(
        said(F.col("_blob").rlike(f"(?i){LEAK}"), "leakage"),
        said(F.size("points") < POINTS, "too few points"),
        said(F.size("quotes") < QUOTES, "too few quotes"),
        said(loose, "not anchored"),
        said(narrow, "one passage"),
        said(F.coalesce(F.length("title"), F.lit(0)) < TITLE, "title too short"),
        said(F.coalesce(F.length("dek"), F.lit(0)) < DEK, "dek too short"),
        said(~F.col("title").rlike(r"[^\x00-\x7F]"), "title not translated"),
    ))
    d = d.withColumns({"_fatal": fatal, "verified_quotes": F.size("quotes"), "grounded_facts": F.size("facts"), "approx_timestamps": ~F.col("timed")})
    pruned = F.array_compact(F.array(*[lost(c) for c in ("points", "quotes", "facts")]))
    d = d.withColumns({"problems": F.concat("_fatal", pruned), "publish": F.size("_fatal") == 0})
    return d.drop("_limit", "_text", "_blob", "_had", "_hay", "_true", "_segs", "_fatal")
