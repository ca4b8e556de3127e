"""UDF-01 to 08, 10: scorers outside the engine as a table function over a partition's rows: asked in batches, asked again, errors kept as rows.

A backend is a callable that is shipped to the tasks: it takes prompts and the number of the try, from 0, and returns a text, an exception or null for
each prompt; it may raise, answer late or answer junk. What the rules make of replies is DataFrame work, and no reply passes unchecked.
"""

from __future__ import annotations

import json
import queue
import re
import threading
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import forms
from ..functions.text import squeeze
from ..sinks.tables import kept_aside
from . import stateful

Backend = Callable[[list[str], int], Sequence["str | Exception | None"]]

SIZE, RETRIES, SECONDS = 16, 2, 120.0
DIMENSIONS = ("density", "faithful", "selection", "concrete", "chinese")  # fixed values: names of a review's scores


def json_object(reply: str) -> dict | None:
    """The JSON object that a reply is, has in a fence or has between its outermost braces."""
    for pattern in (r"(.*)", r"```(?:json)?\s*(.*?)```", r"(\{.*\})"):
        try:
            if (x := re.search(pattern, reply, re.S)) and isinstance(found := json.loads(x[1]), dict):
                return found
        except ValueError:
            continue
    return None


def _called(backend: Backend, prompts: list[str], attempt: int, seconds: float) -> Sequence[str | Exception | None]:
    """What a backend says, or for each prompt why it doesn't; one that is late is left to itself."""
    said: queue.Queue = queue.Queue()

    def run() -> None:
        try:
            answers = list(backend(prompts, attempt))
            if len(answers) != len(prompts):
                raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
            said.put(answers)
        except Exception as e:  # noqa: BLE001 - a backend may fail in any way
            said.put([e] * len(prompts))

    threading.Thread(target=run, daemon=True).start()
    try:
        return said.get(timeout=seconds)
    except queue.Empty:
        return [TimeoutError(f"no answer in {seconds:g} s")] * len(prompts)


def replies(backend: Backend, prompts: list[str], retries: int = RETRIES, seconds: float = SECONDS) -> list[tuple[dict | None, int, str | None]]:
    """(object, times asked, error) for each prompt; those without an object are asked again together, at most retries times."""
    out: list[tuple[dict | None, int, str | None]] = [(None, 0, None)] * len(prompts)
    open_ = list(range(len(prompts)))
    for attempt in range(retries + 1):
        if not open_:
            break
        for i, said in zip(open_, _called(backend, [prompts[i] for i in open_], attempt, seconds), strict=True):
            if isinstance(said, str):
                found = json_object(said)
                out[i] = (found, attempt + 1, None if found is not None else "no JSON object")
            else:
                out[i] = (None, attempt + 1, f"{type(said).__name__}: {said}"[:200] if said is not None else "no answer")
        open_ = [i for i in open_ if out[i][0] is None]
    return out


def asked(rows: DataFrame, key: str, prompt: str, backend: Backend, *, size: int = SIZE, retries: int = RETRIES, seconds: float = SECONDS) -> DataFrame:
    """UDF-01: (key, reply, asked, error) for each row: the reply is a JSON object's text, or null with the last error. Null prompts aren't asked and have an error.

    A table function reads each partition's rows in turn and holds size of them; nothing is shuffled. A lost task asks its rows again.
    """
    schema = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("reply", T.StringType()), T.StructField("asked", T.IntegerType()), T.StructField("error", T.StringType())])

    @F.udtf(returnType=schema)
    class Asked:
        def __init__(self) -> None:
            self.held: list[tuple] = []

        def eval(self, row: Row) -> Iterator[tuple]:
            if row[1] is None:
                yield row[0], None, 0, "no prompt"
                return
            self.held.append((row[0], row[1]))
            if len(self.held) >= size:
                yield from self.terminate()

        def terminate(self) -> Iterator[tuple]:
            held, self.held = self.held, []
            for (k, _), (found, n, error) in zip(held, replies(backend, [p for _, p in held], retries, seconds), strict=True):
                yield k, None if found is None else json.dumps(found, ensure_ascii=False), n, error

    return Asked(rows.select(F.col(key).alias("key"), F.col(prompt).cast("string").alias("prompt")).asTable()).withColumnRenamed("key", key)


def answered(rows: DataFrame, prompt: str, backend: Backend, *, size: int = SIZE, retries: int = RETRIES, seconds: float = SECONDS) -> DataFrame:
    """UDF-01: rows with what `asked` says of each beside them, for short prompts: they come as Arrow batches, of which only the prompts become Python's.

    So what a reply is checked against needs no join afterwards.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("asked", T.IntegerType()), T.StructField("error", T.StringType())])

    @F.arrow_udtf(returnType=schema)
    class Answered:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            prompts = batch.column(prompt).to_pylist()
            out: list[tuple[str | None, int, str | None]] = [(None, 0, "no prompt")] * len(prompts)
            some = [i for i, p in enumerate(prompts) if p is not None]
            for held in (some[j : j + size] for j in range(0, len(some), size)):
                for i, (found, n, error) in zip(held, replies(backend, [prompts[i] for i in held], retries, seconds), strict=True):
                    out[i] = (None if found is None else json.dumps(found, ensure_ascii=False), n, error)
            new = [pa.array([x[j] for x in out], kind) for j, kind in enumerate((pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return Answered(rows.asTable())


def said(field: str) -> Column:
    """A field of a reply as text; null if it has none."""
    return F.get_json_object("reply", f"$.{field}")


def short(field: str, n: int) -> Column:
    """A field's words, cut to n characters; empty if it has none."""
    return F.substring(squeeze(F.coalesce(said(field), F.lit(""))), 1, n)


def mark() -> Column:
    """The score of a reply, between 0 and 10; null if it isn't a number."""
    x = said("score").try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(10.0), x)))


def triaged(rows: DataFrame, key: str, prompt: str, basis: str, backend: Backend, rubric: str, **how) -> DataFrame:
    """UDF-02: (key, score, why, kind, basis, rubric, error); all but the error is null where there is no score, and such rows pass."""
    x = rows.select(key, basis).join(asked(rows, key, prompt, backend, **how), key, "left").withColumn("score", mark())
    parts = {"why": short("why", 60), "kind": short("kind", 12), "basis": F.col(basis), "rubric": F.lit(rubric)}
    return x.select(key, "score", *[F.when(F.col("score").isNotNull(), c).alias(n) for n, c in parts.items()], "error")


def categorised(rows: DataFrame, key: str, prompt: str, fallback: str, known: Sequence[str], backend: Backend, **how) -> DataFrame:
    """UDF-03: (key, cat): the reply's category if it is a known one, else the fallback."""
    cat = F.trim(said("cat"))
    return rows.select(key, fallback).join(asked(rows, key, prompt, backend, **how), key, "left").select(key, F.coalesce(F.when(cat.isin(*known), cat), F.col(fallback)).alias("cat"))


def digested(rows: DataFrame, key: str, text: str, backend: Backend, *, chars: int, piece: int, most: int = 120_000, anchor: str = "\n[", **how) -> DataFrame:
    """UDF-04: (key, reply, error): the reply to a text of at most chars characters, or to the notes on its pieces.

    Pieces (STF-05) are asked for notes, quotes and facts; those that fail are passed over, and a text with no notes at all is an error. The lists, in the order of
    pieces, are one JSON prompt, cut to most characters: that much is what one reply can take in.
    """
    long = rows.where(F.length(text) > chars)
    pieces = stateful.chunks(long.select(key, text), key, text, piece, anchor=anchor).withColumn("_id", F.struct(key, "pos"))
    lists = {n: F.from_json(said(n), "array<string>") for n in ("notes", "quotes", "facts")}
    got = asked(pieces, "_id", "piece", backend, **how).select(F.col(f"_id.{key}").alias(key), F.col("_id.pos").alias("pos"), *[F.coalesce(c, F.array().cast("array<string>")).alias(n) for n, c in lists.items()])
    held = got.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *lists))).alias("x"))
    joined = held.select(key, *[F.flatten(F.col("x")[n]).alias(n) for n in lists])
    notes = F.when(F.size("notes") > 0, F.substring(F.to_json(F.struct(*lists)), 1, most))
    prompts = rows.where(F.length(text) <= chars).select(key, F.col(text).alias("_p")).unionByName(joined.select(key, notes.alias("_p")))
    answers = asked(prompts, key, "_p", backend, **how)
    return answers.select(key, "reply", F.when(F.col("error") == "no prompt", "no notes").otherwise(F.col("error")).alias("error"))


def ungarbled(quotes: DataFrame, item: str, pos: str, quote: str, backend: Backend, **how) -> DataFrame:
    """UDF-05: (item, pos, quote, garbled) of all quotes: the string in a quote that its reply reports; null for a quote that stays.

    An item's quotes, a digest's few, are one prompt of numbered lines; items with a single one aren't asked. A report counts only if its string occurs in the quote.
    They stay together from the prompt to the check of its reply: one shuffle by item, and none if the quotes are so dealt.
    """
    held = quotes.select(item, F.struct(F.col(pos).alias("pos"), squeeze(F.coalesce(quote, F.lit(""))).alias("w"), F.col(quote).alias("quote")).alias("q"))
    lines = F.transform(F.filter(F.array_sort("_q"), lambda q: q["w"] != ""), lambda q: F.concat(q["pos"].cast("string"), F.lit(". "), q["w"]))
    text = F.array_join(lines, "\n")
    sheets = held.groupBy(item).agg(F.collect_list("q").alias("_q")).withColumn("_p", F.when((F.size("_q") > 1) & F.col(item).isNotNull(), F.nullif(text, F.lit(""))))
    bad = F.from_json(said("bad"), "array<struct<i:string,s:string>>")
    reported = F.transform(bad, lambda b: F.struct(b["i"].try_cast(quotes.schema[pos].dataType).alias("i"), squeeze(b["s"]).alias("s")))
    true = F.filter("_b", lambda b: (b["s"] != "") & F.exists("_q", lambda q: (q["pos"] == b["i"]) & F.contains(q["quote"], b["s"])))
    checked = answered(sheets, "_p", backend, **how).withColumn("_b", reported).select(item, F.explode("_q").alias("q"), true.alias("_b"))
    own = F.array_min(F.transform(F.filter("_b", lambda b: b["i"] == F.col("q.pos")), lambda b: b["s"]))
    return checked.select(item, F.col("q.pos").alias(pos), F.col("q.quote").alias(quote), own.alias("garbled"))


def reviewed(rows: DataFrame, key: str, prompt: str, backend: Backend, rubric: str, **how) -> DataFrame:
    """UDF-06: (key, score, the five dimensions, verdict, why, worst, rubric, error); all but the error is null where there is no score."""
    x = asked(rows, key, prompt, backend, **how).withColumn("score", mark())
    parts = {d: said(f"dims.{d}").try_cast("double") for d in DIMENSIONS} | {"verdict": short("verdict", 8), "why": short("why", 90), "worst": short("worst", 120), "rubric": F.lit(rubric)}
    return x.select(key, "score", *[F.when(F.col("score").isNotNull(), c).alias(n) for n, c in parts.items()], "error")


def glyphs(rows: DataFrame, key: str, context: str, first: Backend, second: Backend, same: str, **how) -> DataFrame:
    """UDF-07: (key, state, fix): ok or a valid fix by the first reply, ok where the second says that the context is no word, else pending.

    The second is asked about what the first left open, whose states are written aside first. same holds the glyphs that may stand for each other (`valid_fix`).
    """
    a = rows.select(key, context).join(asked(rows, key, context, first, **how), key)
    settled = F.coalesce(said("unsure") != "true", F.lit(True))
    fits = F.coalesce(forms.valid_fix(F.col(context), said("fix"), same), F.lit(False))
    state = F.when(settled & (said("ok") == "true"), "ok").when(settled & (said("ok") == "false") & fits, "fix")
    a = kept_aside(a.select(key, context, state.alias("state"), F.when(state == "fix", said("fix")).alias("fix")))
    b = asked(a.where("state is null"), key, context, second, **how).where(said("garbled") == "true").select(key, F.lit("ok").alias("_again"))
    return a.join(b, key, "left").select(key, F.coalesce("state", "_again", F.lit("pending")).alias("state"), "fix")


def translated(rows: DataFrame, key: str, text: str, backend: Backend, **how) -> DataFrame:
    """UDF-08, 10: (key, text): the reply's text, null where there is none or it is still in the source's script; merge it into a table by `rewritten`."""
    new = F.nullif(squeeze(said("text")), F.lit(""))
    return asked(rows, key, text, backend, **how).select(key, F.when(~forms.untranslated(new), new).alias("text"))


def rewritten(table: DataFrame, key: str, column: str, answers: DataFrame, text: str = "text") -> DataFrame:
    """UDF-10: table with column replaced where answers (key, text), one for a key, have a text."""
    new = answers.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_new"))
    return table.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).select(*table.columns)
