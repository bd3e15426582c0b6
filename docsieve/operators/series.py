"""Articles on several works cut to one of them: a series' article to one game's sections, a soundtrack's to one part.

All rest on the tree of headings in nested intervals: a subtree, the sections around a heading and the lines outside of
some sections are comparisons of numbers or running maxima in order of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions.text import full_sentences
from docsieve.functions.titles import normal_title, padded
from docsieve.operators.sections import heading_tree, within_any

#: Names of tracks too common to look for, words after a name that make it another entry of a series, a
#: whole series' music, headings left out, and kinds of sections that are no names of parts.
GENERIC_TRACK = r"^(opening|ending|theme|main theme|title|title theme|title screen|credits|intro|menu|boss|battle|overworld|prologue|epilogue|finale|stage \d+|level \d+|act \d+|\d+ ?[ap]m)$"
ANOTHER_ENTRY = r"\d+\w*|i{2,3}|iv|vi{0,3}|ix|x|series|franchise|games|video|media|universe|saga|collection|trilogy"
SERIES_MUSIC = r"\b(?:music|soundtracks?|scores?|songs) (?:of|for|from) (?:(?:\p{Lu}[\p{L}\p{N}'’:&.-]*|\d+|the|video|game|media|and|of) ){0,8}(?:series|franchise)\b"
SKIP_HEADING = r"(?i)^(references|notes|footnotes|citations|sources|external links|see also|further reading|bibliography)$"
GENERIC_SECTION = (
    r"(?i)^(?:background|development|composition|production|recording|releases?|reception|critical|commercial|legacy|references|notes|external|see also|track listings?|personnel|credits|charts?|certifications?|awards?|accolades"
    r"|overview|history|music|soundtracks?|albums?|singles|eps|other|musicology|instrumentation|motifs?|themes?|style|influences?|bibliography|further|sales|live|concerts?|creation|concept|writing|lyrics|cast|plot|synopsis"
    r"|gameplay|setting|story|characters|marketing|reviews?|impact|cover|versions?|remix(?:es)?|formats?|editions?|arrangements?)\b"
)
MUSIC_PAGE = r"(?i)\b(soundtracks?|music|score)\b"


def names_this(words: Column, game: Column, others: Column) -> Column:
    """Whether normal words name the game, not a sequel or its series, nor one of `others`, which begin with its name."""
    rest = F.transform(others, lambda o: F.substring(o, F.length(game) + 2, F.length(o)))
    longer = F.when(F.size(others) > 0, F.concat(F.lit("(?!(?:"), F.array_join(rest, "|"), F.lit(") )"))).otherwise("")
    return (game != "") & F.rlike(padded(words), F.concat(F.lit(" "), game, F.lit(f" (?!(?:{ANOTHER_ENTRY}) )"), longer))


def names_track(words: Column, track: Column) -> Column:
    return (F.length(track) >= 5) & ~track.rlike(GENERIC_TRACK) & F.contains(padded(words), padded(track))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _lines(pages: DataFrame, key: str, text: str) -> DataFrame:
    return pages.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("opens", F.startswith("line", F.lit("==")))


def series_scope(pages: DataFrame, key: str, text: str, game: str, track: str) -> DataFrame:
    """(key, scope, kept): a series' text cut to one game, and the number of sentences kept.

    Of the sections headed by the game, and those below, all sentences stay, of others and of the lead those that name the
    game or the track. Sections keep their order and become one level. With fewer than two sentences the lead is taken whole.
    Sentences have 25 characters and an end mark at least. Null texts, games and tracks count as empty; a key names one page.
    """
    held = pages.select(key, F.coalesce(text, F.lit("")).alias("_text"), normal_title(F.coalesce(game, F.lit(""))).alias("_game"), normal_title(F.coalesce(track, F.lit(""))).alias("_track"))
    tree = heading_tree(held, key, "_text").withColumn("_name", normal_title(F.col("heading"))).join(held.select(key, "_game"), key)
    own = F.when(F.col("_name") == F.col("_game"), F.col("from"))
    tree = tree.withColumn("ours", within_any(tree, key, "from", own, F.col("to")))
    others = tree.where(F.startswith("_name", F.concat("_game", F.lit(" ")))).groupBy(key).agg(F.collect_set("_name").alias("_others"))
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heads = tree.select(key, F.col("from").alias("pos"), F.struct(F.col("from").alias("at"), "heading", "ours").alias("head"))
    under = F.last(F.when(F.col("opens"), F.coalesce("head", F.struct(F.col("pos").alias("at"), F.lit(None).cast("string").alias("heading"), F.lit(False).alias("ours")))), True)
    rows = _lines(held, key, "_text").join(heads, [key, "pos"], "left").withColumn("under", under.over(order)).where("not opens")
    rows = rows.select(key, "pos", "under", F.posexplode(full_sentences(F.col("line"))).alias("k", "s")).where((F.length("s") >= 25) & F.col("s").rlike(r"""[.!?]["”)]?$"""))
    rows = rows.where(F.col("under").isNull() | ~F.coalesce(F.col("under.heading"), F.lit("references")).rlike(SKIP_HEADING))
    rows = rows.join(held.select(key, "_game", "_track").join(others, key, "left"), key).withColumn("_w", normal_title(F.col("s")))
    named = names_this(F.col("_w"), F.col("_game"), F.coalesce("_others", F.array().cast("array<string>"))) | names_track(F.col("_w"), F.col("_track"))
    rows = rows.where(named | F.coalesce("under.ours", F.lit(False)))
    parts = rows.groupBy(key, "under").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "k", "s"))), lambda x: x["s"]), " ").alias("body"), F.count("*").alias("n"))
    block = F.when(F.col("under").isNull(), F.col("body")).otherwise(F.concat(F.lit("== "), F.col("under.heading"), F.lit(" ==\n"), F.col("body")))
    made = parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("under.at", F.lit(-1)).alias("at"), block.alias("b")))), lambda x: x["b"]), "\n\n").alias("cut"), F.sum("n").alias("kept"))
    kept = F.coalesce("kept", F.lit(0))
    lead = _stripped(F.get(F.split("_text", r"\n(?===)"), F.lit(0)))
    return held.join(made, key, "left").select(key, F.when(kept < 2, lead).otherwise(F.col("cut")).alias("scope"), kept.alias("kept"))


def series_wide(pages: DataFrame, key: str, page: str, text: str, game: str) -> DataFrame:
    """(key, wide): whether an article is on a whole series' music: by its title, its first sentence or three headings of games with years."""
    title = F.coalesce(page, F.lit(""))
    music, plain = r"(?i)^Music of (?:the )?(.+?)(?: series)?$", r"(?i)^(.+?) (?:series|franchise)$"
    named = F.when(title.rlike(music), F.regexp_extract(title, music, 1)).when(title.rlike(plain), F.regexp_extract(title, plain, 1)).otherwise("")
    body = F.coalesce(text, F.lit(""))
    dated = F.regexp_extract_all(body, F.lit(r"(?m)^==+\s*(.+?)\s*\(\d{4}\)\s*==+\s*$"), F.lit(1))
    held = pages.select(key, title.alias("_page"), named.alias("_named"), normal_title(F.coalesce(game, F.lit(""))).alias("_game"), F.get(F.split(body, r"(?<=[.!?])\s+"), F.lit(0)).alias("_first"), dated.alias("_dated"))
    games = held.select(key, F.explode("_dated").alias("h")).select(key, normal_title(F.col("h")).alias("h")).groupBy(key).agg(F.count_distinct("h").alias("_games"))
    held = held.withColumn("_name", normal_title(F.col("_named"))).join(games, key, "left")
    has = F.col("_named") != ""
    wide = F.when(F.col("_game") == "", False).when(has & (F.col("_name") != F.col("_game")), True).when(~has & ~F.col("_page").rlike(MUSIC_PAGE), False)
    return held.select(key, wide.otherwise(F.col("_first").rlike(SERIES_MUSIC) | (F.coalesce("_games", F.lit(0)) >= 3)).alias("wide"))


def soundtrack_part(pages: DataFrame, key: str, text: str, track: str) -> DataFrame:
    """(key, heading, part, others): the part of a soundtrack that a track names, its lead and lines, and the other parts.

    The named part is the longest heading within the track's name (the first of equals), with at least two others that
    are neither in it nor around it. A track "Name: Title" of a soundtrack in three parts or more, whose name the text never has, gets
    an empty heading and what lies outside of all parts. All else has no row. A heading in quotes is a track, no other part.
    """
    held = pages.select(key, F.coalesce(text, F.lit("")).alias("_text"), F.coalesce(track, F.lit("")).alias("_track"))
    quotes = r"""^["“](.*)["”]$"""
    tree = heading_tree(held, key, "_text").select(key, "level", "from", "to", F.col("heading").rlike(quotes).alias("quoted"), F.regexp_replace("heading", quotes, "$1").alias("heading"))
    parts = tree.where(~F.col("heading").rlike(GENERIC_SECTION) & (F.size(F.split("heading", r"\s+")) <= 5)).withColumn("_name", normal_title(F.col("heading")))
    parts = parts.join(held.select(key, padded(normal_title(F.col("_track"))).alias("_wanted")), key)
    fits = (F.length("_name") >= 4) & F.contains("_wanted", padded(F.col("_name")))
    place = F.struct(-F.length("heading"), "from")
    best = parts.where(fits).groupBy(key).agg(F.min_by(F.struct("heading", "from", "to"), place).alias("m"))
    beside = (F.col("to") <= F.col("m.from")) | (F.col("from") >= F.col("m.to"))
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("from", "heading"))), lambda x: x["heading"])).alias("others")
    other = parts.where("not quoted").join(best, key).where(beside).groupBy(key).agg(F.first("m").alias("m"), listed, F.count("*").alias("n")).where("n >= 2")
    lines = F.split("_text", "\n")
    lead = F.array_join(F.slice(lines, 1, F.coalesce(F.array_min(F.transform(lines, lambda x, i: F.when(F.startswith(x, F.lit("==")), i))), F.lit(0))), "\n")
    section = F.array_join(F.slice(lines, F.col("m.from") + 1, F.col("m.to") - F.col("m.from")), "\n")
    matched = held.join(other, key).select(key, "m.heading", F.concat(_stripped(lead), F.lit("\n\n"), section).alias("part"), "others")
    prefix = F.regexp_extract("_track", r"^([^:]{3,}):\s*\S", 1)
    named = parts.where("not quoted").groupBy(key).agg(listed, F.count_if(F.col("level") == 2).alias("n")).where("n >= 3")
    open_ = held.join(best, key, "left_anti").join(named, key).where((prefix != "") & lead.rlike(r"(?i)\b(soundtracks?|score)\b"))
    open_ = open_.where(~F.contains(padded(normal_title(F.regexp_replace("_text", "\n", " "))), padded(normal_title(prefix))))
    rows = _lines(open_, key, "_text").join(parts.where("not quoted").select(key, F.col("from").alias("pos"), "to"), [key, "pos"], "left")
    rows = rows.withColumn("gone", within_any(rows, key, "pos", F.col("to"), F.col("to"))).where("not gone")
    rest = rows.groupBy(key).agg(_stripped(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")).alias("part"))
    unknown = open_.join(rest, key, "left").select(key, F.lit("").alias("heading"), F.coalesce("part", F.lit("")).alias("part"), "others")
    return matched.union(unknown)
