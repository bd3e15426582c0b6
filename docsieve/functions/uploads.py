"""Upload titles: title and artist from free text and a channel's name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in brackets or after a bar that tell of the recording's form, not of the work (fixed values: common ones, some of
#: which the reproduced rules are specified with too).
LABELS = "official|video|clip|lyrics|subtitles|teaser|premiere|1080p|4k|uhd|stereo mix"
NOT_MUSIC = ("podcast", "trailer", "tutorial", "interview", "gameplay", "asmr", "unboxing", "vlog")


def without_labels(title: Column) -> Column:
    bare = F.regexp_replace(title, rf"(?iu)\s*[(\[][^()\[\]]*\b(?:{LABELS})\b[^()\[\]]*[)\]]", "")
    return F.trim(F.regexp_replace(bare, rf"(?iu)\s*[|｜].*\b(?:{LABELS})\b.*$", ""))


def channel_artist(channel: Column) -> Column:
    """struct<artist, official>: generated channels end in " - Topic", others in VEVO, or say that they are official."""
    topic, vevo = F.regexp_extract(channel, r"^(.+) - Topic$", 1), F.regexp_extract(channel, r"(?i)^(.+?)\s*vevo$", 1)
    named = F.regexp_extract(channel, r"(?i)^(.+?)\s+official(?:\s+channel)?$", 1)
    found = F.coalesce(*[F.when(x != "", x) for x in (topic, vevo, named)])
    spaced = F.regexp_replace(found, r"(?<=\p{Ll})(?=\p{Lu})", " ")
    return F.struct(F.coalesce(spaced, channel).alias("artist"), found.isNotNull().alias("official"))


def upload_parts(title: Column, channel: Column) -> Column:
    """struct<artist, title, confident>: "a - b", else a quoted title, else the whole with the channel as artist.

    A dash is read as artist first, unless the channel's artist is what stands after it.
    """
    bare = without_labels(title)
    a, b = (F.trim(F.regexp_extract(bare, r"^(.+?)\s+[-–—]\s+(.+)$", i)) for i in (1, 2))
    who = channel_artist(channel)
    swapped = (F.lower(b) == F.lower(who["artist"])) & (F.lower(a) != F.lower(who["artist"]))
    quoted = F.regexp_extract(bare, '^(.*?)["“]([^"”]+)["”]', 2)
    before = F.trim(F.regexp_extract(bare, '^(.*?)["“]([^"”]+)["”]', 1))
    part = lambda artist, name, sure: F.struct(artist.alias("artist"), name.alias("title"), sure.alias("confident"))
    return (
        F.when((a != "") & swapped, part(b, a, F.lit(True)))
        .when(a != "", part(a, b, F.lower(a) == F.lower(who["artist"])))
        .when((quoted != "") & (before != ""), part(before, quoted, F.lit(False)))
        .otherwise(part(who["artist"], bare, who["official"]))
    )


def is_not_music(title: Column) -> Column:
    words = F.split(F.lower(title), r"[^\p{L}\p{N}]+")
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in NOT_MUSIC]))
