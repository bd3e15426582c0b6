"""Registered queries on the pace of preparing and on clocks carried over restarts, over whole event tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.operators import pace as P
from docsieve.plans.queries import query, table

_MS = "case when event_type <> 'error' then cast(floor(value * 100) as bigint) else event_id % 3 - 1 end"


@query(f"""
with e as (select user_id, ts, event_id, {_MS} ms, event_id % 7 - 1 active, event_id // 300 "day" from events where user_id is not null),
r as (select user_id, ts, event_id, ms from e where ms > 0 qualify row_number() over (partition by user_id order by ts desc, event_id desc, ms desc) <= 50),
t as (select user_id, "day", sum(active) ms from e where active > 0 and "day" is not null group by all),
d as (select * from t qualify row_number() over (partition by user_id order by "day" desc) <= 14),
a as (select user_id, count(*) n_recent, string_agg(ms, ',' order by ts, event_id, ms) recent from r group by user_id),
b as (select user_id, string_agg("day" || ':' || cast(ms as bigint), ',' order by "day") by_day from d group by user_id)
select user_id, coalesce(n_recent, 0) n_recent, coalesce(recent, '') recent, coalesce(by_day, '') by_day from a full join b using (user_id)""")
def prepared_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest 50 times and totals of the last 14 spans of events."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.expr(_MS).alias("ms"), (F.col("event_id") % 7 - 1).alias("active"), F.expr("event_id div 300").alias("day"))
    out = P.prepared_pace(e, "user_id", ["ts", "event_id"], "ms", "active", "day")
    days = F.sort_array(F.transform("by_day", lambda d: F.struct(d.day.cast("long").alias("day"), d.ms.alias("ms"))))
    return out.select("user_id", F.size("recent").cast("long").alias("n_recent"), F.array_join("recent", ",").alias("recent"), F.array_join(F.transform(days, lambda d: F.concat_ws(":", d.day, d.ms)), ",").alias("by_day"))


_PLAYED = "case when event_id % 11 = 0 then null else event_id * 977 % 900000 - 5000 end"
_SAVED = "case when event_id % 13 = 0 then null else event_id * 331 % 30000000 end"


@query(f"""
with e as (select event_id, {_PLAYED} p, case event_id % 3 when 0 then true when 1 then false end z, {_SAVED} s, 25000000 now from events)
select event_id, case when p is null or p < 0 then 0 when z then p when s <= now and p + now - s < 600000 + 1200000 then p + now - s else 0 end on_ms, coalesce(s <= now and now - s < 21600000, false) resumable from e""")
def carried_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long what was on at a save has been on after a restart, and whether its session goes on, of every event's."""
    paused = F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False)
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_PLAYED).alias("p"), paused.alias("z"), F.expr(_SAVED).alias("s"))
    now = F.lit(25_000_000)
    return e.select("event_id", P.carried_ms(F.col("p"), F.col("z"), F.col("s"), now, 600_000).alias("on_ms"), P.is_resumable(F.col("s"), now).alias("resumable"))
