"""What a caption leaves unnamed, hardware that a source names, cited lines and reports without secrets.

Null texts give null (false where the result is a truth value); nothing here needs Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.functions.wording import quoted

#: Patterns that the rules are specified with.
CHART_CLAIM = r"\b(?:reached|hit|peaked at|debuted at|climbed to|rose to) (?:number|No\.?|#)\s?(?:one|\d+)\b|\btop new entry\b|\bnew entry\b"
REGIONS = (
    "Japan", "North America", "Europe", "United States", "US", "United Kingdom", "UK", "Australia", "Canada", "Germany", "France", "Italy",
    "Spain", "South Korea", "China", "Taiwan", "Brazil", "Mexico", "Ireland", "New Zealand", "Sweden", "Norway", "Netherlands", "Asia",
)
CHART_NAMED = r"\b(?:charts?|Hot 100|Billboard|Oricon|Top 40|Top 100|Global 200|Official|ARIA|RPM|Cash Box|Gaon|Tracklist|countdown)\b|\b(?:" + "|".join(REGIONS) + r")\b"
THIS_CHART = r"\b(?:this|that|the same) (chart|list|ranking|countdown|poll)\b"
GROUP = r"^(?:The|This|That) (duo|pair|trio|quartet|quintet|couple|band|group|orchestra|ensemble)\b"
GROUP_NAMED = GROUP + r"(?:\s*[\"“'‘]|\s+\p{Lu})"
ANY_GROUP = "band|group|duo|pair|trio|quartet|quintet|orchestra|ensemble|choir|unit"
TIME_UNIT = "(?:days?|weeks?|months?|years?|decades?|nights?|shows?|dates?|tracks?|songs?|singles?|albums?)"
LOOSE_SPAN = rf"\b(?:these|those)\s+(?:[\p{{L}}\d-]+\s+)?{TIME_UNIT}\b|\bthe (?:next|following) (?:two|three|four|five|six|seven|eight|nine|ten|\d+)(?:\s+{TIME_UNIT})?\b"
SAME_THING = r"\b[Tt]he same (?:arrangement|recording|version|melody|tune|lyrics|session|lineup|line-up|band|musicians)\b"
EVENT = r"\b[Tt]he (incident|controversy|dispute|scandal|accident|affair|lawsuit|ordeal)\b"
EVENT_NAMED = EVENT + r"(?:\s+[\"“\p{Lu}]|\s+(?:of|over|with|about|between)\b)"
TOTAL = r"\b(?:total|worldwide|global|overall|combined) sales\b"
RECORDING = r"^The (?:\d{4}|original|first|later|studio|live) (?:recording|version|performance|rendition)\b"
HEDGE = (
    r"\b(?:may|might|could) have\b|\b(?:possibly|arguably|reportedly|allegedly|apparently|supposedly|purportedly|reputedly|rumou?red|probably|perhaps|presumably|unconfirmed|disputed)\b"
    r"|\b(?:is|are|was|were) (?:said|believed|thought|reported|rumou?red|claimed) to\b|\bit is (?:said|believed|thought|claimed)\b|\b(?:legend|tradition) has it\b"
    r"|\b(?:is|are|was|were) credited with\b|\bin part\b|\b(?:partly|partially)\b"
)
#: Names of the same hardware; names that are ordinary words too; endings that make another machine of it.
SAME_HARDWARE = (
    ("nes", "nintendo entertainment system", "famicom"),
    ("snes", "super nintendo", "super famicom", "super nintendo entertainment system"),
    ("n64", "nintendo 64"),
    ("ps1", "psone", "playstation"),
    ("ps2", "playstation 2"),
    ("ps3", "playstation 3"),
    ("ps4", "playstation 4"),
    ("ps5", "playstation 5"),
    ("mega drive", "genesis", "sega genesis"),
    ("game boy", "gameboy"),
    ("c64", "commodore 64"),
    ("pc engine", "turbografx-16", "turbografx"),
)
ORDINARY = ("switch", "saturn", "genesis", "vita")
SIBLING = r"[\s-]+(?:U|[2-5]|360|One|Series|Advance|Colou?r|Portable|Vita|Pocket|DSi?|XL|Lite)"
QUOTED = r"[\"“][^\"”]*[\"”]"


def met(text: Column, pattern: str) -> Column:
    """The first place that fits a pattern in any case, or null."""
    return F.nullif(F.regexp_extract(text, "(?iu)" + pattern, 0), F.lit(""))


def unnamed_chart(caption: Column) -> Column:
    """A rank without the chart or place that it is of, or null."""
    return F.when(~caption.rlike("(?iu)" + CHART_NAMED), met(caption, CHART_CLAIM))


def unnamed_reference(caption: Column, sentences: Column) -> Column:
    """"this chart" with no chart named beside it, or a group told by its kind alone that no sentence calls so; else null."""
    kind = F.regexp_extract(caption, "(?iu)" + THIS_CHART, 1)
    once = F.size(F.filter(F.split(F.lower(caption), r"[^\p{L}\p{N}]+"), lambda w: w == F.lower(kind))) == 1
    group = F.lower(F.regexp_extract(caption, GROUP, 1))
    kinds = F.when(group.isin("band", "group"), ANY_GROUP).otherwise(group)
    is_one = F.concat(F.lit(r"(?iu)\b(?:is|are|was|were)\s+(?:an?|the)\b[^.]{0,80}?\b(?:"), kinds, F.lit(r")s?\b"))
    called = F.exists(F.coalesce(sentences, F.array().cast("array<string>")), lambda s: F.regexp_like(s, is_one))
    bare = (group != "") & ~caption.rlike(GROUP_NAMED) & ~F.coalesce(called, F.lit(False))
    return F.coalesce(F.when((kind != "") & once, F.lower(met(caption, THIS_CHART))), F.when(bare, F.concat(F.lit("the "), group)))


def left_behind(caption: Column, titles: Column) -> Column:
    """What a caption leaves in the sentences around it: a span, "the same" thing, an event, a recording or a total; else null.

    Titles (an array) that the caption has as words, or any quote, name the recording or the total.
    """
    words = F.concat(F.lit(" "), F.array_join(F.split(F.lower(caption), r"[^\p{L}\p{N}]+"), " "), F.lit(" "))
    plain = lambda t: F.concat(F.lit(" "), F.array_join(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), " "), F.lit(" "))
    titled = F.exists(F.coalesce(titles, F.array().cast("array<string>")), lambda t: (F.trim(t) != "") & F.contains(words, plain(t)))
    named = F.coalesce(titled, F.lit(False)) | caption.rlike("[\"“]")
    same = F.nullif(F.regexp_extract(caption, SAME_THING + "(?! as\\b)", 0), F.lit(""))
    event = F.regexp_extract(caption, EVENT + r"(?!\s+[\"“\p{Lu}])(?!\s+(?:of|over|with|about|between)\b)", 1)
    rest = F.regexp_replace(caption, "(?iu)" + RECORDING, "")
    return F.coalesce(
        met(caption, LOOSE_SPAN),
        same,
        F.when(event != "", F.concat(F.lit("the "), event)),
        F.when(~named & ~rest.rlike(r"\p{Lu}"), met(caption, RECORDING)),
        F.when(~named, met(caption, TOTAL)),
    )


def hedge_of(text: Column) -> Column:
    """The first word of doubt outside quotes, or null."""
    return met(F.regexp_replace(text, QUOTED, ""), HEDGE)


def is_sure(caption: Column) -> Column:
    """Whether a caption states without doubt and cites nobody."""
    return ~caption.rlike(rf"(?iu){HEDGE}|\baccording to\b")


def doubts(text: Column) -> Column:
    return F.regexp_replace(text, QUOTED, "").rlike("(?iu)" + HEDGE)


def dropped_hedge(caption: Column, retold: Column) -> Column:
    """The doubt that every retold sentence (an array) has and the caption, which cites nobody, has not; else null."""
    return F.when(is_sure(caption) & (F.size(retold) > 0) & F.forall(retold, doubts), hedge_of(F.get(retold, F.lit(0))))


def platform_supported(platform: Column, source: Column) -> Column:
    """Whether a source names a machine, by this or another of its names, and not only a sibling ("Wii U" for "Wii"). Null gives false."""
    p = F.lower(F.trim(platform))
    others = F.create_map(*[F.lit(x) for group in SAME_HARDWARE for name in group for x in (name, "|".join(o for o in group if o != name))])
    end = rf"(?![\p{{L}}\p{{N}}])(?!(?iu:{SIBLING})(?![\p{{L}}\p{{N}}]))"
    direct = F.when(p.isin(*ORDINARY), F.concat(F.lit(r"(?u)(^|[^\p{L}\p{N}])"), quoted(F.initcap(p)), F.lit(end))).otherwise(F.concat(F.lit(r"(?iu)(^|[^\p{L}\p{N}])"), quoted(p), F.lit(end)))
    by_other = F.concat(F.lit(r"(?iu)(^|[^\p{L}\p{N}])(?:"), F.try_element_at(others, p), F.lit(")" + end))
    return F.coalesce((p != "") & F.regexp_like(source, direct), F.lit(False)) | F.coalesce(F.regexp_like(source, by_other), F.lit(False))


def citation(line: Column) -> Column:
    """(at, text): the number that a line cites, 0 without one, and its caption."""
    bare = F.regexp_replace(line, r"^\s*(?:[-*•]\s*)?(?:\d{1,2}\.\s+(?=\[?\d{1,3}\]?\s*\|))?", "")
    boxed, plain = r"^\[(\d{1,3})\]\s*[|:.)-]?\s*(.*)$", r"^(\d{1,3})\s*[|｜:)\]-]\s*(.*)$"
    how = F.when(bare.rlike(boxed), F.struct(F.regexp_extract(bare, boxed, 1).cast("int").alias("at"), F.trim(F.regexp_extract(bare, boxed, 2)).alias("text")))
    how = how.when(bare.rlike(plain), F.struct(F.regexp_extract(bare, plain, 1).cast("int").alias("at"), F.trim(F.regexp_extract(bare, plain, 2)).alias("text")))
    return how.otherwise(F.struct(F.lit(0).alias("at"), F.trim(line).alias("text")))


def redacted(text: Column, secrets: Column) -> Column:
    """A report without the secrets (an array) that it holds, credentials of headers and account names in paths."""
    used = F.filter(F.coalesce(secrets, F.array().cast("array<string>")), lambda s: s != "")
    out = F.aggregate(used, text, lambda t, s: F.replace(t, s, F.lit("[removed]")))
    out = F.regexp_replace(out, r"(?i)(Authorization:\s*\w+\s+)\S+", "$1[removed]")
    return F.regexp_replace(out, r"""(?i)([/\\](?:Users|home)[/\\])[^/\\\s"']+""", "$1[removed]")


def same_request(title_a: Column, artist_a: Column, title_b: Column, artist_b: Column) -> Column:
    """Same title and artist, a missing artist like an empty one; false without titles."""
    return F.coalesce((title_a == title_b) & (F.coalesce(artist_a, F.lit("")) == F.coalesce(artist_b, F.lit(""))), F.lit(False))
