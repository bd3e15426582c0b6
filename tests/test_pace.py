"""Pace against plain Python; clocks of a stopped and restarted stream against those of an unbroken one."""

import datetime as dt
import random

from pyspark.sql import functions as F

from docsieve.operators import pace as P
from docsieve.streaming import sessions as S

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_pace_equals_plain_python(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 0, -4, 5, 7, 90]), rng.choice([None, 0, 3, 8]), rng.choice([f"2024-01-{d:02}" for d in range(1, 31)] + [None])) for i in range(900)] + [("c", 900, 4, None, None), ("d", 901, None, 0, "2024-01-01")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, ms long, active long, day string")
    out = P.prepared_pace(df, "k", ["i"], "ms", "active", "day")
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
    want = {}
    for k, _, ms, active, day in sorted(rows, key=lambda r: r[1]):
        if k is None:
            continue
        recent, days = want.setdefault(k, ([], {}))
        if ms and ms > 0:
            recent.append(ms)
            del recent[:-50]
        if active and active > 0 and day:
            days[day] = days.get(day, 0) + active
            for d in sorted(days)[:-14]:
                del days[d]
    got = {r.k: (r.recent, {d.day: d.ms for d in r.by_day}) for r in out.collect()}
    assert got == {k: v for k, v in want.items() if v != ([], {})} and set(got) == {"a", "b", "c"}
    assert P.prepared_pace(df.limit(0), "k", ["i"], "ms", "active", "day").count() == 0


def test_carried(spark):
    rows = [(5, False, 100), (5, True, 100), (5, None, 2000), (None, False, 100), (-1, False, 100), (5, False, None), (5, True, None), (0, False, 1000)]
    df = spark.createDataFrame(rows, "p long, z boolean, s long")
    on = P.carried_ms(F.col("p"), F.col("z"), F.col("s"), F.lit(1000), 10)
    assert [r[0] for r in df.select(on).collect()] == [905, 5, 0, 0, 0, 0, 5, 0]
    late = P.carried_ms(F.lit(5), F.lit(False), F.lit(0), F.lit(1_200_005), 10)
    assert df.select(late).first()[0] == 0
    assert [r[0] for r in df.select(P.is_resumable(F.col("s"), F.lit(1000))).collect()] == [True, True, False, True, True, False, False, True]


def stream(spark, folder, out, batches, carried=None, stop_after=None):
    """Runs batches of events, one file a trigger, through a stream that ends and starts again after each of stop_after."""
    schema, got = "key string, at timestamp, kind string, song string", []
    source, checkpoint = f"{folder}/{out}-in", f"{folder}/{out}-check"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if (i + 1) in (stop_after or []) or i + 1 == len(batches):
            events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            S.stale_songs(events, 600, "1 minute", carried).writeStream.foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sorted(got)


def plain(rows, last, clocks):
    """The same by hand: clocks of (song, ms on, running since) to which sorted events are applied."""
    out, state = [], {k: [s, on, since, False] for k, (s, on, since) in clocks.items()}
    for key, at, kind, song in [*sorted(rows, key=lambda r: (r[1], r[0])), *[(k, last, "", None) for k in {r[0] for r in rows} | set(clocks)]]:
        c, t = state.setdefault(key, [None, 0, None, False]), (at - T0).total_seconds()
        if c[0] and c[2] is not None and not c[3] and c[2] + max(0, 600 - c[1]) <= t:
            out.append((key, c[0], (T0 + dt.timedelta(seconds=c[2] + max(0, 600 - c[1]))).replace(tzinfo=None)))
            c[3] = True
        if kind == "on" and song != c[0]:
            c[:] = [song, 0, t, False]
        elif kind == "pause" and c[2] is not None:
            c[1:3] = [c[1] + t - c[2], None]
        elif kind == "resume" and c[0] and c[2] is None:
            c[2] = t
        elif kind == "end":
            c[:] = [None, 0, None, False]
    return sorted(out)


def test_restarted_stream_equals_unbroken_one(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(8)
    rows = [(rng.choice("abc"), T0 + dt.timedelta(seconds=60 + 40 * i), rng.choice(["on", "on", "pause", "resume", "end", "resume"]), rng.choice(["x", "x", "y"])) for i in range(160)]
    rows.append(("z", T0 + dt.timedelta(hours=3), "on", "last"))
    batches = [rows[i : i + 40] for i in range(0, 160, 40)] + [rows[160:]]
    ms = int(T0.timestamp() * 1000)
    saved = [("a", "x", 400_000, False, ms - 60_000), ("a", "old", 1, False, ms - 90_000), ("q", "w", 500_000, True, ms - 60_000), ("p", "v", 100_000, False, ms - 7 * 3600_000), ("r", "u", 560_000, False, ms - 10_000)]
    carried = S.saved_clocks(spark.createDataFrame(saved, "key string, song string, played_ms long, paused boolean, saved_ms long"), ms, 600)
    unbroken = stream(spark, tmp_path, "one", batches, carried)
    assert unbroken == stream(spark, tmp_path, "two", batches, carried, stop_after=[1, 2, 4])
    # the watermark after the last event is a minute behind it
    want = plain(rows, T0 + dt.timedelta(hours=3, seconds=-60), {"a": ("x", 460, 0), "q": ("w", 500, None), "r": ("u", 570, 0)})
    assert unbroken == want and len(want) > 5
