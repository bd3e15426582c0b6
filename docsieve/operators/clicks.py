"""Which statement a report of an error means: one of the play that is on, or of an earlier play of the same song."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def song_key(title: str, artist: str, song_id: str, video_id: str) -> Column:
    """One key for a play's song: all four values, nulls apart from any value; null without a title."""
    return F.when(F.col(title).isNotNull(), F.to_json(F.struct(F.col(title).alias("t"), F.col(artist).alias("a"), F.col(song_id).alias("s"), F.col(video_id).alias("v"))))


def report_targets(reports: DataFrame, statements: DataFrame, channel: str) -> DataFrame:
    """(channel, report, song, text, playing) of the reports that mean a statement.

    reports: channel, report, text, song (a key or null), live. statements: channel, play (0 is the one that is on, then the
    latest first), song, text. A live report of the song that is on, or of none, means that play's statement of the same text.
    Else the latest earlier play of the report's song counts, and only it. Repeated statements count once, repeated
    reports each. Null channels meet nothing. Both joins are on (channel, text) or (channel, song), so a channel with a
    third of all reports is dealt over its texts and songs.
    """
    on = statements.where("play = 0").select(channel, F.col("song").alias("_s"), "text").distinct()
    earlier = statements.where("play > 0 and song is not null")
    last = earlier.groupBy(channel, "song").agg(F.min("play").alias("play"))
    past = earlier.join(last, [channel, "song", "play"]).select(channel, "song", "text").distinct().withColumn("_past", F.lit(True))
    now = reports.join(on, [channel, "text"], "left")
    meant = F.coalesce(F.col("live") & F.col("_s").isNotNull() & (F.col("song").isNull() | (F.col("song") == F.col("_s"))), F.lit(False))
    now = now.withColumn("playing", meant).join(past, [channel, "song", "text"], "left")
    return now.where("playing or _past").select(channel, "report", F.when(F.col("playing"), F.col("_s")).otherwise(F.col("song")).alias("song"), "text", "playing")
