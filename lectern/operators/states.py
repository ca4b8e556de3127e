"""Ledgers and claims as folds over ordered events: batch forms, which define what the streaming forms keep as state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_lookback(items: DataFrame, at: str, arrived: str, days: int) -> DataFrame:
    """STR-01: an item older on arrival than the lookback is never seen."""
    return items.where(F.col(at) >= F.col(arrived) - F.expr(f"INTERVAL {days} DAYS"))


def claims(events: DataFrame, fingerprint: str, owner: str, kind: str, order: Sequence[str]) -> DataFrame:
    """STR-02, AUX-04: (fingerprint, owner) of the claims that stand: the first claim after the last release by an owner that held it; other releases do nothing.

    A claim is an event of kind `claim`, a release one of kind `release`. Owners follow each other by gaps and islands: a release ends
    an island if it comes from the owner that began it.
    """
    seen = F.array_sort(F.collect_list(F.struct(*order, owner, kind)))
    empty = F.lit(None).cast(events.schema[owner].dataType)
    step = lambda held, e: F.when(held.isNull() & (e[kind] == "claim"), e[owner]).when((e[kind] == "release") & (held == e[owner]), empty).otherwise(held)
    return events.groupBy(fingerprint).agg(F.aggregate(seen, empty, step).alias(owner)).where(F.col(owner).isNotNull())


def soft_counts(events: DataFrame, key: str, at: str, days: int = 7) -> DataFrame:
    """STR-03: (key, soft, last): soft failures since the last gap of more than days; the counter starts again after one."""
    w = Window.partitionBy(key).orderBy(at)
    gap = F.coalesce(F.col(at) > F.lag(at).over(w) + F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    island = events.withColumn("_g", gap.cast("int")).withColumn("_i", F.sum("_g").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    runs = island.groupBy(key, "_i").agg(F.count("*").alias("soft"), F.max(at).alias("last"))
    return runs.groupBy(key).agg(F.max_by("soft", "_i").alias("soft"), F.max_by("last", "_i").alias("last"))


def followed(rounds: DataFrame, key: str, at: str, seen: str, now: Column, *, hours: int = 72, lost: int = 2, keep: int = 14) -> DataFrame:
    """STR-04: (key, state, lost, last_seen): a source is red when its last lost rounds found nothing or it has not been seen for hours, and dropped keep days after that."""
    r = rounds.groupBy(key).agg(F.max(F.when(F.col(seen), F.col(at))).alias("last_seen"), F.min(at).alias("_first"), F.collect_list(F.struct(at, F.col(seen).alias("s"))).alias("_r"))
    since = F.size(F.filter("_r", lambda x: F.col("last_seen").isNull() | (x[at] > F.col("last_seen"))))
    r = r.withColumns({"lost": since, "_from": F.coalesce("last_seen", "_first")})
    late = now > F.col("_from") + F.expr(f"INTERVAL {hours} HOURS")
    gone = now > F.col("_from") + F.expr(f"INTERVAL {keep} DAYS")
    return r.select(key, F.when(gone, "dropped").when(late | (F.col("lost") >= lost), "red").otherwise("ok").alias("state"), "lost", "last_seen")


def liveness(beats: DataFrame, line: str, at: str, now: Column, hours: dict[str, int], default: int = 30) -> DataFrame:
    """STR-05: (line, state): dead beyond the line's hours since its last beat, a warning from three quarters of them."""
    limit = F.coalesce(*[F.when(F.col(line) == k, F.lit(v)) for k, v in hours.items()], F.lit(default)) * 3600
    age = F.unix_timestamp(now) - F.unix_timestamp(F.max(at))
    b = beats.groupBy(line).agg(age.alias("_age"))
    return b.select(line, F.when(F.col("_age") > limit, "dead").when(F.col("_age") > 0.75 * limit, "warning").otherwise("ok").alias("state"))


def admitted(requests: DataFrame, by: str, at: str, throttled: str, minutes: int = 30) -> DataFrame:
    """STR-06: requests with open, whether the circuit is closed for them: no throttled request in the minutes before."""
    w = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(throttled), F.col(at)), ignorenulls=True).over(w)
    return requests.withColumn("open", F.coalesce(F.col(at) >= last + F.expr(f"INTERVAL {minutes} MINUTES"), F.lit(True)))


def upserted(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """STR-09: old with new's rows by key, the last of each; applying it twice changes nothing."""
    other = [c for c in old.columns if c != key]
    tagged = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    last = F.struct("_n", F.col(at), *[c for c in other if c != at])
    return tagged.groupBy(key).agg(F.max(last).alias("_l")).select(key, *[F.col(f"_l.{c}").alias(c) for c in other])


def cooled(candidates: DataFrame, rejected: DataFrame, key: str, at: str, now: Column, days: int = 30) -> DataFrame:
    """STR-10: candidates that were not rejected in the last days."""
    recent = rejected.where(F.col(at) > now - F.expr(f"INTERVAL {days} DAYS")).select(key).distinct()
    return candidates.join(recent, key, "left_anti")


def slot_of(at: Column, hours: Sequence[int]) -> Column:
    """STR-12: the latest of a day's slots (hours, ascending) at or before a time, else the last of the day before."""
    day = F.date_trunc("day", at)
    case = F.timestamp_add("HOUR", F.lit(hours[-1] - 24), day)
    for h in hours:
        case = F.when(F.hour(at) >= h, F.timestamp_add("HOUR", F.lit(h), day)).otherwise(case)
    return case


def reconciled(base: DataFrame, now: DataFrame, key: str, value: str, generated: Column) -> DataFrame:
    """AUX-27: what to do with each key that differs from base: what is gone is restored, what is generated (a condition on key) is reset or, if new, removed, the rest is staged.

    As (key, action); values are compared with nulls equal, and a key that is the same on both sides, or null, has no row.
    """
    a = base.where(F.col(key).isNotNull()).select(key, F.col(value).alias("_a"), F.lit(True).alias("_had"))
    b = now.where(F.col(key).isNotNull()).select(key, F.col(value).alias("_b"), F.lit(True).alias("_has"))
    same = F.col("_had").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))
    action = F.when(F.col("_has").isNull(), "restore").when(same, None).when(generated & F.col("_had").isNull(), "remove").when(generated, "reset").otherwise("stage")
    return a.join(b, key, "full").select(key, action.alias("action")).where("action is not null")


def leads(replies: DataFrame, reply: str, existing: DataFrame, name: str, *, most: int = 12, longest: int = 60, why: int = 40) -> DataFrame:
    """UDF-09: (name, why) of the first most leads in each reply `{"leads": [{"name", "why"}]}`, squeezed and clipped; without names that exist, each once.

    A reply that is no JSON, or holds no such array, gives none. Of a name's reasons the least is kept.
    """
    squeezed = lambda c, n: F.trim(F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), 1, n))
    held = F.from_json(reply, "leads array<struct<name: string, why: string>>")["leads"]
    x = replies.select(F.explode(F.slice(held, 1, most)).alias("l")).select(squeezed(F.col("l.name"), longest).alias("name"), squeezed(F.col("l.why"), why).alias("why"))
    known = existing.select(F.col(name).alias("name"))
    return x.where("name != ''").groupBy("name").agg(F.min("why").alias("why")).join(known, "name", "left_anti")


def slot_runs(events: DataFrame, job: str, at: str, slot: str, tick: str, code: str, busy: str, *, most: int = 3, down: Sequence[int] = (75,)) -> DataFrame:
    """STR-12: (job, at, run, tries) of every tick: whether it starts a run of its slot, and how often the slot has been tried by then.

    Other events are heartbeats with an exit code. A slot whose last heartbeat says 0 is done. One that says the model is down is tried again without
    end; otherwise a slot is tried most times. Busy ticks start nothing. Counts of ticks before decide, no loop: a try that the limit counts runs
    while earlier ones, of both kinds, are under most, and as their number only grows, all of the limited ones before it have run.
    """
    w = Window.partitionBy(job, slot).orderBy(at, tick)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    beat = F.last(F.when(~F.col(tick), F.struct(F.col(code).alias("c"))), ignorenulls=True).over(before)["c"]
    x = events.withColumn("_code", beat)
    free = F.col(tick) & ~F.coalesce(F.col(busy), F.lit(False)) & F.coalesce(F.col("_code") != 0, F.lit(True))
    again = F.coalesce(F.col("_code").isin(*down), F.lit(False))
    x = x.withColumns({"_down": (free & again).cast("int"), "_try": (free & ~again).cast("int")})
    tried = F.coalesce(F.sum(F.col("_down") + F.col("_try")).over(before), F.lit(0))
    x = x.withColumn("run", (F.col("_down") == 1) | ((F.col("_try") == 1) & (tried < most)))
    x = x.withColumn("tries", F.sum(F.col("run").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return x.where(F.col(tick)).select(job, at, "run", "tries")
