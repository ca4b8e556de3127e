"""Rules over ledgers of attempts, sources and verdicts. The day or time of judgement is always a parameter, never the clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def age_days(at: Column, now: Column) -> Column:
    """Whole days from at to now; null if at is."""
    return F.datediff(now, at)


def exhausted(hard: Column, soft: Column, at: Column, now: Column, reset: int = 7) -> Column:
    """FLT-05: three hard failures, or eight soft ones of which the last is under reset days old; an unknown day counts as old."""
    old = F.coalesce(age_days(at, now) >= reset, F.lit(True))
    return (hard >= 3) | ((soft >= 8) & ~old)


def retry_allowed(why: Column, hard: Column, soft: Column, at: Column, now: Column) -> Column:
    """FLT-08: whether a failed lead may be tried again; throttled ones wait 2 days, others 7; an unknown day doesn't wait."""
    throttled = F.coalesce(why == "throttled", F.lit(False))
    never = F.coalesce(why == "too-long", F.lit(False)) | (hard >= 3) | (soft >= 8) | (~throttled & (hard + soft >= 3))
    wait = F.when(throttled, 2).otherwise(7)
    return ~never & F.coalesce(age_days(at, now) >= wait, F.lit(True))


def weaker_tiers(had: Column, now: Column, audio: str) -> Column:
    """FLT-06: a verdict is void if its tiers are a proper subset of today's, or unrecorded while the audio tier is there."""
    subset = (F.size(F.array_except(had, now)) == 0) & (F.size(had) < F.size(now))
    return F.coalesce(subset, F.array_contains(now, audio))


def core_blocked(kind: Column, pinned: Column, score: Column, least: float = 3) -> Column:
    """FLT-04: advertising, or an unpinned source's score of least or below; an unknown score blocks nothing."""
    return F.coalesce(kind == "advertising", F.lit(False)) | (~pinned & F.coalesce(score <= least, F.lit(False)))


def first_reason(checks: Sequence[tuple[Column, str]]) -> Column:
    """FLT-10, FLT-14, FLT-22, AGG-16: the reason of the first check that holds, else null."""
    return F.coalesce(*[F.when(failed, F.lit(reason)) for failed, reason in checks])


def dead(ledger: DataFrame, registry: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """FLT-15: registered keys with three hard failures whose reason nobody has accepted; an acceptance of another reason doesn't count."""
    gone = ledger.where("n >= 3").join(registry.select(key).distinct(), key, "left_semi")
    return gone.join(accepted.select(key, "why"), [key, "why"], "left_anti")


def replacement_is_better(age_now: Column, age_new: Column, abandoned: int = 180) -> Column:
    """FLT-26: the new feed is alive and newer than the present one; an unknown present age loses."""
    return F.coalesce(age_new <= abandoned, F.lit(False)) & F.coalesce(age_new < age_now, F.lit(True))


def demoted(tier_base: Column, lowest: int = 3) -> Column:
    """RUL-03: one level below the base tier, so that a repeated verdict changes nothing; null (remove) below the lowest."""
    return F.when(tier_base < lowest, tier_base + 1)


def aligned(ours: Column, theirs: Column, tolerance: float = 90) -> Column:
    """RUL-08: whether two lengths agree; null, never false, where one is unknown."""
    return F.when(ours.isNotNull() & theirs.isNotNull(), F.abs(ours - theirs) <= tolerance)


def soft_skip(ledger: DataFrame, skips: DataFrame, key: str) -> DataFrame:
    """AUX-03: each skip adds one to soft, hard failures stay, and unseen keys are added."""
    more = skips.groupBy(key).agg(F.count("*").alias("_more"))
    n = lambda c: F.coalesce(c, F.lit(0))
    return ledger.join(more, key, "full").select(key, n("n").cast("long").alias("n"), (n("soft") + n("_more")).cast("long").alias("soft"))


def content_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """JOIN-18: what a three-way merge of contents does with each key; absence is a content of its own."""
    tag = lambda df, n: df.select(key, F.col(value).alias(n))
    j = tag(base, "b").join(tag(ours, "o"), key, "full").join(tag(theirs, "t"), key, "full")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    return j.select(key, F.when(o.eqNullSafe(t), "equal").when(o.eqNullSafe(b), "theirs").when(t.eqNullSafe(b), "ours").otherwise("conflict").alias("action"))


def vanished(before: DataFrame, after: DataFrame, retired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOIN-05: rows of before that are neither in after nor retired; null keys equal each other."""
    out = before
    for i, known in enumerate((after, retired)):
        a, b = out.alias(f"a{i}"), known.select(*keys).alias(f"b{i}")
        on = [F.col(f"a{i}.{k}").eqNullSafe(F.col(f"b{i}.{k}")) for k in keys]
        out = a.join(b, on, "left_anti")
    return out


def rejoin_labels(labels: DataFrame, known: DataFrame, key: str, label: str, name: str, shown: str) -> DataFrame:
    """JOIN-27: parts of `A/B` or `A、B` replaced by their known names in order; empty if one part is unknown."""
    parts = labels.select(key, F.posexplode(F.split(label, "[/、]")).alias("_pos", "_part")).withColumn("_part", F.trim("_part"))
    j = parts.join(known.select(F.col(name).alias("_part"), F.col(shown).alias("_shown")), "_part", "left")
    found = j.groupBy(key).agg(F.bool_and(F.col("_shown").isNotNull()).alias("_all"), F.array_sort(F.collect_list(F.struct("_pos", "_shown"))).alias("_parts"))
    return found.select(key, F.when(F.col("_all"), F.concat_ws("/", F.transform("_parts", lambda p: p["_shown"]))).otherwise("").alias(label))


def since_cleared(rows: DataFrame, key: str, pos: str, kind: str, cleared: str, *fields: str) -> DataFrame:
    """AGG-20: an ordered fold of overrides: of the rows after a key's last clearing, the last value that isn't null of each field."""
    last = rows.groupBy(key).agg(F.max(F.when(F.col(kind) == cleared, F.col(pos))).alias("_cleared"))
    live = rows.join(last, key).where((F.col(kind) != cleared) & (F.col("_cleared").isNull() | (F.col(pos) > F.col("_cleared"))))
    return live.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(pos))).alias(f) for f in fields])


def class_wide(probes: DataFrame, by: str, ok: Column, ok_before: Column, least: int = 3) -> DataFrame:
    """AGG-17: groups of which every probe failed while one was well before: the prober's own fault, so their state is kept."""
    g = probes.groupBy(by).agg(F.count("*").alias("n"), F.bool_or(ok).alias("_ok"), F.bool_or(ok_before).alias("_before"))
    return g.where((F.col("n") >= least) & ~F.col("_ok") & F.col("_before")).select(by, "n")


def follow_up(before: DataFrame, now: DataFrame, key: str, today: Column, *, keep: int = 14, late: int = 3) -> DataFrame:
    """STF-07: the ledger of wanted items: still seen rows count a try, unseen ones a loss and go after keep days; `red` names what is late or lost twice."""
    j = before.join(now.select(key, F.col("at").alias("_seen")), key, "full")
    first = F.coalesce("first_seen", "_seen")
    out = j.select(
        key,
        first.alias("first_seen"),
        (F.coalesce("tries", F.lit(0)) + F.when(F.col("_seen").isNotNull(), 1).otherwise(0)).cast("long").alias("tries"),
        (F.coalesce("lost", F.lit(0)) + F.when(F.col("_seen").isNull(), 1).otherwise(0)).cast("long").alias("lost"),
        F.datediff(today, first).alias("age"),
    ).where(F.col("age") <= keep)
    return out.withColumn("red", first_reason([(F.col("lost") >= 2, "lost"), (F.col("age") > late, "late")]))


def judged(*, feed_dead: Column, audio_only: Column, cloud_only: Column, untold: Column, stale: Column, n: Column, passed: Column, tries: Column, drafted: Column) -> Column:
    """RUL-01: the first of eight findings on a source that holds; with fewer than four items none on their quality does."""
    checks = [(feed_dead, "feed-dead"), (audio_only, "route"), (cloud_only, "cloud-only"), (untold, "no-transcript"), (stale, "stale"), (n < 4, None)]
    checks += [(passed == 0, "never passed"), ((n >= 6) & (passed * 4 < n), "low pass rate"), ((tries >= 4) & (drafted * 100 < 34 * tries), "weak drafts")]
    case = F.when(checks[0][0], F.lit(checks[0][1]))
    for when, what in checks[1:]:
        case = case.when(when, F.lit(what).cast("string"))
    return case


def all_or_nothing(proposals: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """RUL-05: the accepted proposals, if every one that is accepted was proposed; else none."""
    stray = accepted.join(proposals, key, "left_anti").limit(1).count()
    return accepted.join(proposals, key, "left_semi").where(F.lit(not stray))


def candidate_score(*, tier: Column, age: Column, official: Column, notes: Column, chapters: Column, minutes: Column, published: Column) -> Column:
    """SRT-01: what a candidate is worth: its source's tier, less its age up to ten days, and what speaks for or against it."""
    base = F.when(tier == 1, 100).when(tier == 2, 55).otherwise(25)
    plus = lambda cond, n: F.when(cond, n).otherwise(0)
    extra = plus(official, 30) + plus(notes > 20_000, 22) + plus(chapters, 8) + plus(minutes < 15, -12) + plus(minutes > 240, -6)
    return (base - 4 * F.least(F.lit(10), age) + extra + F.greatest(F.lit(0), 60 - 12 * published)).cast("long")
