"""Schedules of what is shown: how long an entry takes to read, what a late comer still sees, entries that come later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds left below which an entry is not shown again.
LEAST_LEFT = 2.0


def reading_seconds(words: Column, least: Column) -> Column:
    """Two seconds and a third of one for every word, `least` at least."""
    return F.greatest(least, 2 + words / F.lit(3.0))


def catch_up(entries: DataFrame, group: str, spot: str, elapsed: float) -> DataFrame:
    """entries (group, spot, delay, reading, ...) with wait and stay, as seen by one who joins `elapsed` seconds late.

    Entries still to come wait for the rest of their delay. Of those begun, one is shown for what is left of its time
    if that is two seconds at least and no later one has taken its spot.
    """
    begun = F.col("delay") <= elapsed
    last = F.max(F.when(begun, F.col("delay"))).over(Window.partitionBy(group, spot))
    left = F.col("delay") + F.col("reading") - elapsed
    held = entries.withColumn("_last", last).where(~begun | ((left >= LEAST_LEFT) & (F.col("_last") <= F.col("delay"))))
    wait, stay = F.when(begun, 0.0).otherwise(F.col("delay") - elapsed), F.when(begun, left).otherwise(F.col("reading"))
    return held.withColumn("wait", wait).withColumn("stay", stay).drop("_last")


def with_later(record: DataFrame, later: DataFrame, group: str, order: str, elapsed: float, interval: float) -> DataFrame:
    """record (group, order, delay) and the rows of later (group, order), each `interval` after the one before.

    The first of them comes `interval` after the record's last, and no sooner than a second from now.
    """
    last = record.groupBy(group).agg(F.max("delay").alias("_last"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    first = F.greatest(F.lit(elapsed + 1), F.coalesce(F.col("_last") + interval, F.lit(0.0)))
    added = later.withColumn("_k", nth).join(last, group, "left").select(group, order, (first + interval * F.col("_k")).alias("delay"))
    return record.select(group, order, "delay").unionByName(added)
