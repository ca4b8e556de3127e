"""Claims, circuit breakers, cooldowns and slots as keyed state of a stream, by transformWithState. The batch forms in operators/states.py define the results.

State lives in RocksDB below the stream's checkpoint, so a query that is stopped or lost goes on from its last batch; `use_rocksdb` sets the provider
that this needs. Rows of one batch are taken in the order of their own column, so files may hold them in any.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

MINUTE, DAY = 60_000, 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rows(frames: Iterator[pd.DataFrame], *order: str) -> Iterator[tuple]:
    """A batch's rows of one key, in order; a key's share of a batch is in memory, never its history."""
    held = list(frames)
    if held:
        yield from pd.concat(held).sort_values(list(order), kind="stable").itertuples(index=False)


def _millis(t: pd.Timestamp) -> int:
    return int(t.timestamp() * 1000)


class Claims(StatefulProcessor):
    """STR-02: who holds a fingerprint. The first claim is granted, others are duplicates of it; only the holder can release it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.holder = handle.getValueState("holder", "who string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.holder.get()[0] if self.holder.exists() else None
        before, out = held, []
        for r in _rows(rows, "n"):
            if r.what == "claim":
                granted = held is None or held == r.who
                held = r.who if held is None else held
                out.append((key[0], r.n, r.who, "granted" if granted else "duplicate", held))
            elif held is not None and held == r.who:
                held = None
                out.append((key[0], r.n, r.who, "released", None))
        if held is None:
            self.holder.clear()
        elif held != before:
            self.holder.update((held,))
        yield pd.DataFrame(out, columns=["fingerprint", "n", "who", "outcome", "holder"])

    def close(self) -> None:
        pass


def claims(events: DataFrame, fingerprint: str, owner: str, kind: str, order: str) -> DataFrame:
    """(fingerprint, n, who, outcome, holder) of every claim, and of every release that counts."""
    rows = events.select(F.col(fingerprint).alias("fingerprint"), F.col(order).cast("long").alias("n"), F.col(owner).cast("string").alias("who"), F.col(kind).alias("what"))
    out = f"fingerprint {rows.schema['fingerprint'].dataType.simpleString()}, n long, who string, outcome string, holder string"
    return rows.groupBy("fingerprint").transformWithStateInPandas(Claims(), out, "Append", "None")


class Circuit(StatefulProcessor):
    """STR-06: requests of a line pass unless one was throttled less than `minutes` before; a timer tells when the line opens again, by time alone."""

    def __init__(self, minutes: int):
        self.span = minutes * MINUTE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else None
        before, out = until, []
        for r in _rows(rows, "at"):
            at = _millis(r.at)
            out.append((key[0], r.at, bool(until is None or at >= until), "request"))
            if r.throttled:
                until = max(until or 0, at + self.span)
        if until is not None and until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.until.update((until,))
            self.handle.registerTimer(max(until, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["line", "at", "open", "what"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else None
        if until is not None and expiredTimerInfo.getExpiryTimeInMs() >= until:
            self.until.clear()
            yield pd.DataFrame({"line": [key[0]], "at": [pd.Timestamp(until, unit="ms")], "open": [True], "what": ["reopened"]})

    def close(self) -> None:
        pass


def circuit(requests: DataFrame, line: str, at: str, throttled: str, *, minutes: int = 30, late: str = "1 minute") -> DataFrame:
    """(line, at, open, what): each request and whether the circuit lets it pass, and each reopening."""
    rows = requests.select(F.col(line).alias("line"), F.col(at).cast("timestamp").alias("at"), F.col(throttled).alias("throttled")).withWatermark("at", late)
    out = f"line {rows.schema['line'].dataType.simpleString()}, at timestamp, open boolean, what string"
    return rows.groupBy("line").transformWithStateInPandas(Circuit(minutes), out, "Append", "EventTime")


class Cooldown(StatefulProcessor):
    """STR-10: candidates that were passed over are left out for a time. The reasons are a list whose entries the state store drops when it has passed."""

    def __init__(self, millis: int):
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reasons = handle.getListState("reasons", "reason string", self.millis)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = [r[0] for r in self.reasons.get()] if self.reasons.exists() else []
        out = []
        for r in _rows(rows, "n"):
            if r.reason is not None:
                self.reasons.appendValue((r.reason,))
                known.append(r.reason)
            else:
                out.append((key[0], r.n, not known, known[-1] if known else None))
        yield pd.DataFrame(out, columns=["candidate", "n", "eligible", "reason"])

    def close(self) -> None:
        pass


def cooled(events: DataFrame, candidate: str, reason: str, order: str, *, days: float = 30) -> DataFrame:
    """(candidate, n, eligible, reason) of every candidate that comes; an event with a reason passes it over. Time is that of processing, as the rule's is."""
    rows = events.select(F.lower(candidate).alias("candidate"), F.col(order).cast("long").alias("n"), F.col(reason).alias("reason"))
    return rows.groupBy("candidate").transformWithStateInPandas(Cooldown(int(days * DAY)), "candidate string, n long, eligible boolean, reason string", "Append", "ProcessingTime")


class Slots(StatefulProcessor):
    """STR-12: whether a tick starts a job's run, by the latest slot, what its last heartbeat says, and how often the slot has been tried."""

    def __init__(self, most: int, down: tuple[int, ...]):
        self.most, self.down = most, down

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("slot", "slot long, tries int, code int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        slot, tries, code = self.state.get() if self.state.exists() else (None, 0, None)
        out = []
        for r in _rows(rows, "at", "tick"):
            if slot is None or _millis(r.slot) > slot:
                slot, tries, code = _millis(r.slot), 0, None
            if not r.tick:
                code = None if pd.isna(r.code) else int(r.code)
                continue
            run = not r.busy and code != 0 and (code in self.down or tries < self.most)
            tries += run
            out.append((key[0], r.at, bool(run), tries))
        self.state.update((slot, tries, code))
        yield pd.DataFrame(out, columns=["job", "at", "run", "tries"])

    def close(self) -> None:
        pass


def slots(events: DataFrame, job: str, at: str, slot: str, tick: str, code: str, busy: str, *, most: int = 3, down: tuple[int, ...] = (75,)) -> DataFrame:
    """(job, at, run, tries) of every tick; other events are heartbeats with an exit code. slot is the latest slot at the event's time (states.slot_of)."""
    rows = events.select(F.col(job).alias("job"), F.col(at).cast("timestamp").alias("at"), F.col(slot).cast("timestamp").alias("slot"), F.col(tick).alias("tick"), F.col(code).cast("int").alias("code"), F.coalesce(busy, F.lit(False)).alias("busy"))
    out = f"job {rows.schema['job'].dataType.simpleString()}, at timestamp, run boolean, tries int"
    return rows.groupBy("job").transformWithStateInPandas(Slots(most, down), out, "Append", "None")
