"""Pace of preparing: a key's latest times and its totals per day, both bounded; and clocks that go on after a restart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Latest times and days that are kept; how long past its time something still counts as the same play.
KEEP, DAYS = 50, 14
CARRY_PAST_MS = 20 * 60 * 1000
REMEMBER_MS = 6 * 60 * 60 * 1000


def latest(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The n last rows of each key in this order. Each task keeps n rows of a key before the exchange (a group limit), so that a
    hot key sends n rows a task; rows equal in the whole order are dealt with in any order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def prepared_pace(entries: DataFrame, key: str, order: list[str], ms: str, active: str, day: str, keep: int = KEEP, days: int = DAYS) -> DataFrame:
    """(key, recent, by_day): a key's last `keep` times above zero in order, and the active time of its last `days` days, by day.

    Times that are null or not above zero count in neither; a key without any has no row, and one with times of one kind
    only has an empty array of the other. Rows with a null day or key take no part in days or at all. Totals are summed before the exchange;
    a day once out of the last ones never comes back, as later ones stay, so totals of all days cut once equal those cut as rows come.
    """
    held = entries.where(F.col(key).isNotNull())
    last = latest(held.where(F.col(ms) > 0).select(key, *order, ms), key, [*order, ms], keep)
    recent = last.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, ms))), lambda r: r[ms]).alias("recent"), F.lit(None).cast("array<struct<day:string,ms:bigint>>").alias("by_day"))
    totals = held.where((F.col(active) > 0) & F.col(day).isNotNull()).groupBy(key, F.col(day).alias("day")).agg(F.sum(active).cast("long").alias("ms"))
    kept = latest(totals, key, ["day"], days)
    by_day = kept.groupBy(key).agg(F.lit(None).cast(recent.schema["recent"].dataType).alias("recent"), F.transform(F.sort_array(F.collect_list(F.struct("day", "ms"))), lambda d: F.struct(d["day"].cast("string").alias("day"), d["ms"].alias("ms"))).alias("by_day"))
    both = recent.unionByName(by_day).groupBy(key).agg(F.max("recent").alias("recent"), F.max("by_day").alias("by_day"))
    return both.select(key, F.coalesce("recent", F.array().cast(recent.schema["recent"].dataType)).alias("recent"), F.coalesce("by_day", F.array().cast(by_day.schema["by_day"].dataType)).alias("by_day"))


def carried_ms(played: Column, paused: Column, saved_at: Column, now: Column, limit_ms: int) -> Column:
    """How long something has been on after a restart, in ms: what was saved, and the time since unless it was paused; 0 to start afresh.

    It starts afresh without a saved time, from a save that is null or ahead of now, and once it is 20 minutes past its limit.
    """
    on = played + (now - saved_at)
    going = F.when((saved_at <= now) & (on < limit_ms + CARRY_PAST_MS), on)
    return F.when(played.isNull() | (played < 0), F.lit(0)).when(F.coalesce(paused, F.lit(False)), played).otherwise(F.coalesce(going, F.lit(0))).cast("long")


def is_resumable(saved_at: Column, now: Column) -> Column:
    """Whether a saved session is of this stream: not from ahead, and less than six hours old."""
    return F.coalesce((saved_at <= now) & (now - saved_at < REMEMBER_MS), F.lit(False))
