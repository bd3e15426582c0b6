"""Recordings against what was asked for: joins on title and credit, first years, order of title and artist.

recordings has title, artist, released (date), official, reissue (booleans) and score; asked has id, title and artist.
Keys are joined as they are, so both sides should be normalised the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The least score of a search hit that counts, for a performer's recording and for a track of a larger work.
PERFORMER_SCORE, TRACK_SCORE = 90, 85


def matching(recordings: DataFrame, asked: DataFrame, least: int = PERFORMER_SCORE) -> DataFrame:
    """asked with its recordings of the same title and artist from that score on."""
    return asked.join(recordings.where(F.col("score") >= least), ["title", "artist"])


def first_years(recordings: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, year): the year of the first official release that is no reissue; asked has died, a year or null.

    There is none after the artist's death, and none if the artist has any recording of the title, whatever its score,
    from a year before: then the earliest one found is a later one.
    """
    year = F.year("released")
    good = matching(recordings, asked).where("official and not reissue and released is not null")
    first = good.groupBy("id", "died").agg(F.min(year).alias("year")).where("died is null or year <= died").select("id", "year")
    any_score = asked.select("id", "title", "artist").join(recordings.where("released is not null"), ["title", "artist"])
    earlier = any_score.groupBy("id").agg(F.min(year).alias("earliest"))
    return first.join(earlier, "id").where("earliest >= year").select("id", "year")


def first_albums(recordings: DataFrame, asked: DataFrame, years: DataFrame) -> DataFrame:
    """(id, album): the first official release under another title, unless it came out more than a year after the song.

    recordings has album too. Without a known year no album is too late.
    """
    held = matching(recordings, asked).where("official and not reissue and album is not null and album <> title and released is not null")
    first = held.groupBy("id").agg(F.min(F.struct("released", "album")).alias("m"))
    return first.join(years, "id", "left").where("year is null or year(m.released) <= year + 1").select("id", F.col("m.album").alias("album"))


def song_lines(asked: DataFrame, years: DataFrame, albums: DataFrame, most: int = 160) -> DataFrame:
    """(id, lines): what is known of a song in one line, or in two where one would be longer than `most`."""
    rows = asked.select("id", "title").join(years, "id", "left").join(albums, "id", "left").where("year is not null or album is not null")
    q = F.concat(F.lit('"'), "title", F.lit('"'))
    year = F.concat(q, F.lit(" came out in "), F.col("year").cast("string"), F.lit("."))
    album = F.concat(q, F.lit(" is on the album "), "album", F.lit("."))
    both = F.concat(q, F.lit(" came out in "), F.col("year").cast("string"), F.lit(" and is on the album "), "album", F.lit("."))
    lines = F.when(F.col("year").isNull(), F.array(album)).when(F.col("album").isNull(), F.array(year)).when(F.length(both) <= most, F.array(both)).otherwise(F.array(year, album))
    return rows.select("id", lines.alias("lines"))


def order_votes(recordings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, vote) for pairs (id, left, right): "keep" if only right by left is known, "swap" if only left by right is."""
    known = recordings.select("title", "artist").distinct()
    keep = pairs.join(known.select(F.col("artist").alias("left"), F.col("title").alias("right")), ["left", "right"]).select("id", F.lit(1).alias("keep"))
    swap = pairs.join(known.select(F.col("title").alias("left"), F.col("artist").alias("right")), ["left", "right"]).select("id", F.lit(1).alias("swap"))
    held = pairs.select("id").join(keep.distinct(), "id", "left").join(swap.distinct(), "id", "left")
    vote = F.when(F.col("keep").isNotNull() & F.col("swap").isNull(), "keep").when(F.col("swap").isNotNull() & F.col("keep").isNull(), "swap")
    return held.select("id", vote.alias("vote"))


def track_candidates(recordings: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """(id, place, recording): the n earliest recordings of the title on a release that names the work, no remix.

    recordings has recording, title, released, release, remix and score; asked has id, title and work.
    """
    from docsieve.operators.selection import newest_per

    held = asked.join(recordings.where((F.col("score") >= TRACK_SCORE) & ~F.col("remix")), "title")
    held = held.where(F.contains(F.lower("release"), F.lower("work")))
    ranked = newest_per(held.select("id", "recording", "released"), ["id"], [F.col("released").asc_nulls_last(), F.col("recording")], n)
    return ranked.select("id", "recording")
