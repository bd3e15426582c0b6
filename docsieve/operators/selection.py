"""Relational patterns: identity joins by priority, merges, block lists, coverage, rotation, retention, extracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiered_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[tuple[str, str]]) -> DataFrame:
    """(left_id, right_id, tier): the match of the first pair of key columns that has one, the smallest right id of it."""
    parts = []
    for tier, (a, b) in enumerate(keys):
        one = left.select(left_id, F.col(a).alias("k")).where("k is not null")
        two = right.where(F.col(b).isNotNull()).groupBy(F.col(b).alias("k")).agg(F.min(right_id).alias(right_id))
        parts.append(one.join(two, "k").select(left_id, F.struct(F.lit(tier).alias("tier"), F.col(right_id).alias("id")).alias("m")))
    best = reduce(DataFrame.unionByName, parts).groupBy(left_id).agg(F.min("m").alias("m"))
    return left.select(left_id).join(best, left_id, "left").select(left_id, F.col("m.id").alias(right_id), F.col("m.tier").alias("tier"))


def merge_counts(listed: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Full outer merge of (key, n): counts add up; listed tells whether the key is on the list."""
    a, b = listed.select(key, F.col("n").alias("a")), history.select(key, F.col("n").alias("b"))
    out = a.join(b, key, "full_outer")
    return out.select(key, (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("requests"), F.col("a").isNotNull().alias("listed"))


def unblocked(rows: DataFrame, blocked: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(blocked.select(*on).distinct(), on, "left_anti")


def newest(rows: DataFrame, by: list[Column], n: int) -> DataFrame:
    """The n first rows by `by` (a total order): a top-n, without a window over all rows."""
    return rows.orderBy(*by).limit(n)


def newest_per(rows: DataFrame, keys: list[str], by: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("_r") <= n).drop("_r")


def least_recent(pool: DataFrame, used: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """Per group the n items used longest ago, never used ones first, then by pos."""
    last = used.groupBy(group, item).agg(F.max("turn").alias("turn"))
    order = Window.partitionBy(group).orderBy(F.col("turn").asc_nulls_first(), "pos")
    return pool.join(last, [group, item], "left").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select(group, item, "place")


def within_budget(rows: DataFrame, group: str, order: list[str], size: Column, budget: int) -> DataFrame:
    """Rows of each group in order up to the first that would go beyond the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") <= budget).drop("_sum")


def preferred(claims: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """Preferred rows of a key where it has some, else the normal ones; deprecated rows never."""
    order = F.when(F.col(rank) == "preferred", 0).when(F.col(rank) == "normal", 1)
    held = claims.withColumn("_o", order).where("_o is not null")
    return held.withColumn("_m", F.min("_o").over(Window.partitionBy(*keys))).where("_o = _m").drop("_o", "_m")


def sole(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of keys with exactly one distinct value."""
    return rows.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_b")).where(F.col(value) == F.col("_b")).drop("_b")


def as_of(asked: DataFrame, events: DataFrame, key: str, at: str, ts: str, value: str) -> DataFrame:
    """The newest event of the key not after the asked time, by one pass over both sides in order of time."""
    both = asked.select(key, F.col(at).alias("_t"), F.lit(1).alias("_q"), F.lit(None).cast(events.schema[value].dataType).alias("_v"), F.struct(*asked.columns).alias("_row"))
    theirs = events.select(key, F.col(ts).alias("_t"), F.lit(0).alias("_q"), F.col(value).alias("_v"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(key).orderBy("_t", "_q", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return both.union(theirs).withColumn("found", F.last("_v", True).over(w)).where("_q = 1").select("_row.*", "found")


def search(names: DataFrame, name: str, key: str, query: str, n: int) -> DataFrame:
    """Names that have all words of the query: those that begin with it first, then those that contain it, then others."""
    words = query.lower().split()
    low = F.lower(F.col(name))
    rank = F.when(F.startswith(low, F.lit(query.lower())), 0).when(F.contains(low, F.lit(query.lower())), 1).otherwise(2)
    return names.where(reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in words])).select(key, name, rank.alias("rank")).orderBy("rank", key).limit(n)


def match_decision(scores: DataFrame, key: str) -> DataFrame:
    """Per key, from candidates (points, negative, cand): sure, data or none by the best and its margin over the next.

    Sure: a margin of 3 at least, and 6 points or no negative part; data: 3 points; an only candidate has any margin.
    """
    order = Window.partitionBy(key).orderBy(F.desc("points"), "cand")
    held = scores.withColumn("r", F.row_number().over(order)).withColumn("next", F.lead("points").over(order)).where("r = 1")
    wide = F.col("next").isNull() | (F.col("points") - F.col("next") >= 3)
    verdict = F.when(wide & ((F.col("points") >= 6) | ~F.col("negative")), "sure").when(F.col("points") >= 3, "data").otherwise("none")
    return held.select(key, "cand", "points", verdict.alias("decision"))


def rank_with_caps(rows: DataFrame, group: str, limit: int = 4, floor: int = 2, other_most: int = 1, off_most: int = 2) -> DataFrame:
    """Rows (pos, score, other, off, risk, lead) of each group, ranked.

    Only the first `other` row and the first two `off` rows that are not `other` survive, by pos. Rows of some risk are
    held back; the least risky return until `floor` rows are there (risk counts half more off the lead). Then by
    refill, other, off, score, lead and pos, up to the limit.
    """
    w = Window.partitionBy(group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    nth_other = F.sum(F.col("other").cast("int")).over(w)
    held = rows.withColumn("_no", nth_other).where(~F.col("other") | (F.col("_no") <= other_most))
    held = held.withColumn("_nf", F.sum((F.col("off") & ~F.col("other")).cast("int")).over(w)).where(~F.col("off") | F.col("other") | (F.col("_nf") <= off_most))
    risk = F.col("risk") + F.when(F.col("lead"), 0.0).otherwise(0.5)
    safe = F.sum((F.col("risk") == 0).cast("int")).over(Window.partitionBy(group))
    back = F.row_number().over(Window.partitionBy(group, F.col("risk") == 0).orderBy(risk, "pos"))
    held = held.withColumn("_safe", safe).withColumn("_back", back).where((F.col("risk") == 0) | (F.col("_back") <= F.lit(floor) - F.col("_safe")))
    order = Window.partitionBy(group).orderBy((F.col("risk") > 0).cast("int"), F.col("other").cast("int"), F.col("off").cast("int"), F.desc("score"), F.col("lead").cast("int").desc(), "pos")
    return held.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select(group, "pos", "place")


def repeated_sides(titles: DataFrame, group: str, title: str) -> DataFrame:
    """Habit of "a - b" titles per group: 'left' or 'right' for the side whose values recur three times as often.

    It takes 8 such titles at least and a quarter of all; a side's weight is the sum of counts of values that recur.
    """
    cut = F.regexp_extract(title, r"^(.+?) - (.+)$", 1), F.regexp_extract(title, r"^(.+?) - (.+)$", 2)
    held = titles.select(group, cut[0].alias("l"), cut[1].alias("r"))
    total = held.groupBy(group).agg(F.count("*").alias("n"), F.sum((F.col("l") != "").cast("int")).alias("dashed"))

    def weight(side: str) -> DataFrame:
        again = held.where("l <> ''").groupBy(group, side).agg(F.count("*").alias("c")).where("c > 1")
        return again.groupBy(group).agg(F.sum("c").alias(f"w{side}"))

    out = total.join(weight("l"), group, "left").join(weight("r"), group, "left").fillna(0, ["wl", "wr"])
    side = F.when((F.col("wl") > 0) & (F.col("wl") >= 3 * F.col("wr")), "left").when((F.col("wr") > 0) & (F.col("wr") >= 3 * F.col("wl")), "right")
    return out.where("dashed >= 8 and 4 * dashed >= n").select(group, "n", "dashed", side.alias("artist_side"))
