"""Clocks of what is on, with timers: told once when it has been on too long, carried over a restart from a saved table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docsieve.operators.pace import REMEMBER_MS, carried_ms, is_resumable

OUT = "key string, song string, stale_at timestamp"
STATE = "song string, ran_ms long, started_ms long, told boolean, last_ms long"


def _ms(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


class _Clock(StatefulProcessor):
    """One key's clock: (song, ms it ran before, since when it runs or null when it stands still, told, last event)."""

    def __init__(self, after_ms: int) -> None:
        self.after_ms = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", STATE)

    def due(self, clock: tuple) -> int | None:
        song, ran, started, told, _ = clock
        return None if song is None or started is None or told else started + max(0, self.after_ms - ran)

    def keep(self, clock: tuple) -> None:
        """Saves a clock with the timers for when it is due, and for when the key is forgotten."""
        self.clock.update(clock)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = self.due(clock)
        self.handle.registerTimer(clock[4] + REMEMBER_MS if due is None else due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        clock = self.clock.get() if self.clock.exists() else (None, 0, None, False, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "kind", "song"]).itertuples():
            at, due = _ms(r.at), self.due(clock)
            if due is not None and due <= at:
                out.append((key[0], clock[0], pd.Timestamp(due, unit="ms")))
                clock = (*clock[:3], True, clock[4])
            song, ran, started, told, _ = clock
            if r.kind == "on" and r.song != song:
                clock = (r.song, 0, at, False, at)
            elif r.kind == "pause" and started is not None:
                clock = (song, ran + at - started, None, told, at)
            elif r.kind == "resume" and song is not None and started is None:
                clock = (song, ran, at, told, at)
            elif r.kind == "end":
                clock = (None, 0, None, False, at)
            else:
                clock = (song, ran, started, told, at)
        self.keep(clock)
        if out:
            yield pd.DataFrame(out, columns=["key", "song", "stale_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if not self.clock.exists():
            return
        clock = self.clock.get()
        due = self.due(clock)
        if due is None:
            self.clock.clear()
        else:
            # the timer that fired is gone by itself; the next one forgets the key
            self.clock.update((*clock[:3], True, clock[4]))
            self.handle.registerTimer(max(due, clock[4]) + REMEMBER_MS)
            yield pd.DataFrame({"key": [key[0]], "song": [clock[0]], "stale_at": [pd.Timestamp(due, unit="ms")]})

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: ANN001, N802, N803
        r = initialState.iloc[0]
        self.keep((r["song"], int(r["on_ms"]), None if r["paused"] else int(r["now_ms"]), False, int(r["now_ms"])))

    def close(self) -> None:
        pass


def saved_clocks(saved: DataFrame, now_ms: int, after_s: int) -> DataFrame:
    """(key, song, on_ms, paused, now_ms) of saved sessions that go on: those of this stream, on for as long as `carried_ms` says.

    saved has key, song, played_ms, paused and saved_ms, one row a key; of several the last saved is taken, of equals the greatest.
    """
    now = F.lit(now_ms).cast("long")
    once = saved.where(F.col("key").isNotNull() & F.col("song").isNotNull()).groupBy("key").agg(F.max(F.struct("saved_ms", "song", "played_ms", "paused")).alias("s"))
    on = carried_ms(F.col("s.played_ms"), F.col("s.paused"), F.col("s.saved_ms"), now, after_s * 1000)
    return once.where(is_resumable(F.col("s.saved_ms"), now)).select("key", "s.song", on.alias("on_ms"), F.coalesce("s.paused", F.lit(False)).alias("paused"), now.alias("now_ms"))


def stale_songs(events: DataFrame, after_s: int = 600, delay: str = "1 minute", carried: DataFrame | None = None) -> DataFrame:
    """(key, song, stale_at): what has been on for after_s seconds, pauses left out, told once, when an event or the watermark passes that time.

    events: key string, at timestamp, kind (on, pause, resume, end) and song string. The same song again keeps its clock. What
    comes out hangs on event times alone, not on how events fall into triggers, as long as they come in order between
    triggers; rows with a null key, time or kind are left out. A key without events for six hours is forgotten. carried (of saved_clocks) is where
    clocks start. Needs a state store that has timers (RocksDB).
    """
    held = events.where("key is not null and at is not null and kind is not null").select("key", "at", "kind", "song").withWatermark("at", delay)
    first = None if carried is None else carried.groupBy("key")
    return held.groupBy("key").transformWithStateInPandas(_Clock(after_s * 1000), OUT, "Append", "EventTime", first)
