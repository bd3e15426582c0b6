"""Stores: append logs with retention, versioned results, upserts from micro-batches. Spark's committers write all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def compact_log(spark: SparkSession, schema: str, path: str, out: str, time: str, n: int = 500) -> None:
    """The newest n records of a log, to another folder."""
    spark.read.schema(schema).json(path).where(F.col(time).isNotNull()).orderBy(F.desc(time)).limit(n).write.mode("overwrite").json(out)


def current(store: DataFrame, rules: str, now: str, days: int = 30) -> DataFrame:
    """Results of this version of the rules, at most 30 days old and not from more than a minute ahead."""
    at, limit = F.to_timestamp(F.lit(now)), F.make_dt_interval(F.lit(days))
    return store.where((F.col("rules") == rules) & (F.col("at") >= at - limit) & (F.col("at") <= at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1))))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key; of a key twice in new, one row stays."""
    once = new.dropDuplicates([key])
    return old.join(once.select(key), key, "left_anti").unionByName(once)
