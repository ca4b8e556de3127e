"""Ledgers as state of a stream: counters that expire and follow-ups with timers. The batch forms in operators/states.py define the results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR = 3_600_000


def _millis(t: pd.Timestamp) -> int:
    return int(t.timestamp() * 1000)


def soft_counts(events: DataFrame, key: str, at: str, *, days: int = 7, late: str = "1 day") -> DataFrame:
    """STR-03: (key, soft, last, expired) for each batch a key is in: soft failures since its last gap of more than days.

    The state of a key is its counter and the last failure; it goes when the watermark passes that by days, which emits a row with soft 0.
    """

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            soft, last = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "soft": [0], "last": [pd.Timestamp(last, unit="ms")], "expired": [True]})
            return
        soft, last = state.get if state.exists else (0, None)
        for t in sorted(_millis(x) for b in batches for x in b[at]):
            soft, last = (1 if last is None or t > last + days * 24 * HOUR else soft + 1), max(t, last or 0)
        state.update((soft, last))
        state.setTimeoutTimestamp(max(last + days * 24 * HOUR, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "soft": [soft], "last": [pd.Timestamp(last, unit="ms")], "expired": [False]})

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, F.col(at).cast("timestamp").alias(at)).withWatermark(at, late)
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, soft long, last timestamp, expired boolean", "soft long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def followed(rounds: DataFrame, key: str, at: str, seen: str, *, hours: int = 72, lost: int = 2, keep: int = 14, late: str = "1 hour") -> DataFrame:
    """STR-04: (key, state, lost) whenever a source's state is told: ok, red after lost rounds without it or hours since it was seen, dropped keep days after that.

    A timer stands at the next of these two times, so a source turns red, and goes, without any further round.
    """

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, since, told = state.get if state.exists else (0, None, "")
        if not state.hasTimedOut:
            for t, s in sorted((_millis(x), bool(y)) for b in batches for x, y in zip(b[at], b[seen], strict=True)):
                since = t if s or since is None else since
                n = 0 if s else n + 1
        clock = state.getCurrentWatermarkMs()
        if clock > since + keep * 24 * HOUR:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "state": ["dropped"], "lost": [n]})
            return
        now = "red" if n >= lost or clock > since + hours * HOUR else "ok"
        state.update((n, since, now))
        due = since + hours * HOUR
        state.setTimeoutTimestamp(max(clock + 1, due if clock <= due else since + keep * 24 * HOUR))
        if now != told:
            yield pd.DataFrame({key: [k[0]], "state": [now], "lost": [n]})

    kind = rounds.schema[key].dataType.simpleString()
    rows = rounds.select(key, F.col(at).cast("timestamp").alias(at), seen).withWatermark(at, late)
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, state string, lost long", "lost long, since long, told string", "append", GroupStateTimeout.EventTimeTimeout)
