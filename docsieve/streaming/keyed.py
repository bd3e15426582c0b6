"""The state machines on streams: constant state per key, in order of arrival within a trigger's event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def anchored_plays(events: DataFrame, gap_s: int = 600) -> DataFrame:
    """(key, plays, last_at) after each trigger: an event within gap_s of the last counted one is ignored and does not
    move it. events has key string and at timestamp."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, n = state.get if state.exists else (None, 0)
        times = sorted(t.value // 1000 for b in batches for t in b["at"])
        for t in times:
            if anchor is None or t - anchor >= gap_s * 1_000_000:
                anchor, n = t, n + 1
        state.update((anchor, n))
        yield pd.DataFrame({"key": [key[0]], "plays": [n], "last_at": [pd.Timestamp(anchor, unit="us")]})

    return events.groupBy("key").applyInPandasWithState(update, "key string, plays long, last_at timestamp", "anchor long, n long", "update", GroupStateTimeout.NoTimeout)


def busy_spells(readings: DataFrame, high: float = 0.7, low: float = 0.5, calm: int = 6) -> DataFrame:
    """(key, at, busy) at every change: busy from `high` on, until `calm` readings in a row are below `low`."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        busy, quiet = state.get if state.exists else (False, 0)
        out = []
        for at, value in sorted((r.at, r.value) for b in batches for r in b.itertuples()):
            quiet = quiet + 1 if busy and value < low else 0
            now = True if value >= high else False if quiet >= calm else busy
            if now != busy:
                out.append((key[0], at, now))
            busy, quiet = now, quiet if now else 0
        state.update((busy, quiet))
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "busy"])

    return readings.groupBy("key").applyInPandasWithState(update, "key string, at timestamp, busy boolean", "busy boolean, quiet int", "append", GroupStateTimeout.NoTimeout)


def stale_keys(events: DataFrame, after_s: int = 300, delay: str = "1 minute") -> DataFrame:
    """(key, since): keys without an event for after_s seconds of event time, told once each time."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "since": [pd.Timestamp(last, unit="us")]})
            return
        last = max([t.value // 1000 for b in batches for t in b["at"]] + ([state.get[0]] if state.exists else []))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + after_s * 1000, state.getCurrentWatermarkMs() + 1))

    marked = events.withWatermark("at", delay)
    return marked.groupBy("key").applyInPandasWithState(update, "key string, since timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def first_shown(events: DataFrame, columns: list[str], delay: str = "6 hours") -> DataFrame:
    """The first event of each combination of columns within the delay."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(columns)


def counts_by_window(events: DataFrame, kind: str, width: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    w = F.window("at", width, slide) if slide else F.window("at", width)
    return events.withWatermark("at", delay).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def store_batches(out: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Writes every micro-batch under its own number, so that a repeated one overwrites itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return out.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
