"""Sentences of an article that are about another work than the one asked for, by the italic titles of its wikitext.

The article's plain text and its wikitext hold the same sentences in slightly different words. Sentences of both are
aligned by their rarest tokens within the page, so that each plain sentence learns which italic titles it has; what a
title is to the work asked for is settled once a title, and one scan in order of the text carries on from sentence to sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from docsieve.functions.relevance import qualifier_of
from docsieve.functions.text import content_tokens, full_sentences
from docsieve.functions.titles import normal_title, padded
from docsieve.functions.wikitext import marked, unmarked
from docsieve.operators.sections import HEADING, heading_tree
from docsieve.operators.state import scan
from docsieve.sources.shared import written

#: Words of titles that relate no two works, words of albums of a work's own music and of those that are not,
#: words and headings of editions, and how sentences open that go on about an edition, the article's work or the one before.
GENERIC_WORDS = tuple("music game games video series soundtrack soundtracks original edition version theme album songs song live best greatest hits collection volume part chapter story world legend super".split())
MUSIC_ALBUM = r"(?i)\b(?:soundtracks?|OST|OSV|original sound|sound version|music|arranged|arrange|piano|orchestral|orchestra|symphonic|remix(?:es)?|album|tracks|collections?|grand finale|concert|melodies)\b"
NOT_MUSIC_ALBUM = r"(?i)\b(?:drama|radio)\b"
EDITION_WORD = r"(?i)\b(?:remake|remaster(?:ed)?|reboot|re-?release|reimagining|sequel|prequel|spin-?off|port|follow-?up|successor)\b"
EDITION_AFTER = r"(?:remastered|remaster|remake|hd|dx|deluxe|definitive|royal|zero|plus|reloaded|redux)\b"
EDITION_HEADING = r"(?i)\b(?:sequels?|prequels?|remakes?|remasters?|reboots?|spin-?offs?|successors?)\b"
EDITION_LED = r"^(?:In \d{4}, )?(?:The|A|An|This|Its|Their) (?:\d{4} |later |enhanced |HD |high-definition |3D |Western |English )?(?:remake|remaster|remastered version|reboot|re-?release|sequel|prequel|spin-?off|port|follow-?up|reimagining)\b"
LEANS_BACK = r"""^["“]?(?:It|Its|They|Their|This|These|The (?:game|remake|remaster|sequel|prequel|port|reboot|film|album|soundtrack|version|release|title))\b"""
SUBJECT_LED = r"""^["“]?(?:It|Its|The game|This game)\b|^[^.;]{0,80}?,\s+(?:it|the game) (?:is|was|became|remains)\b"""
OF_SERIES = r"['’]?s?\s+(?:video game\s+)?(?:series|franchise|saga|games|titles|fans|fangames?|community|universe|characters?|mascot)\b"
EDITION_TAIL = r"(?i)\s+(?:CD|HD|DX|Remastered|Remaster|Deluxe|Definitive Edition|Complete Edition)$"
VERSIONS = r"^(.*?)\b((?:[\p{L}\p{N}'’-]+,\s+)*[\p{L}\p{N}'’-]+,?\s+(?:and|&)\s+[\p{L}\p{N}'’-]+)$"
MARKED_BREAK = r"""(?<=[.!?]["”]?\x02?)\s+(?=["“\x01]?\p{Lu})"""
ITALIC = r"\x01(\x04?)([^\x02]*)\x02"
ONE_LINK = r"^\[\[([^\]\x03]+)(?:\x03([^\]]+))?\]\]$"


def work_of_page(page: Column) -> Column:
    """"Some Game" of "Music of Some Game", "Some Game (soundtrack)" and "Some Game series"."""
    bare = F.regexp_replace(page, r"\s*\([^)]*\)\s*$", "")
    bare = F.regexp_replace(bare, r"(?i)^(?:the )?(?:music|soundtracks?|scores?) (?:of|from|for) (?:the )?", "")
    return F.trim(F.regexp_replace(bare, r"(?i)\s+(?:series|franchise)$", ""))


def _key_of(title: Column) -> Column:
    return F.regexp_replace(normal_title(title), "^the ", "")


def _distinctive(words: Column) -> Column:
    return F.filter(F.split(words, " "), lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC_WORDS))


def italic_sentences(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, para, k, text, works): sentences of a wikitext with their italic titles: title, target of a single link, subject.

    The subject is the article's own title, in bold italics. Headings and empty lines have no rows; null markup has none.
    """
    lines = pages.select(key, F.posexplode(F.split(marked(F.col(markup)), "\n")).alias("para", "line"))
    lines = lines.where(~F.col("line").rlike(r"^\s*=+[^=]+=+\s*$") & F.col("line").rlike(r"\S"))
    raws = lines.select(key, "para", F.posexplode(F.split("line", MARKED_BREAK)).alias("k", "raw"))
    found = F.zip_with(
        F.regexp_extract_all("raw", F.lit(ITALIC), F.lit(2)),
        F.regexp_extract_all("raw", F.lit(ITALIC), F.lit(1)),
        lambda t, s: F.struct(F.trim(unmarked(t)).alias("title"), F.trim(F.regexp_replace(F.regexp_extract(F.trim(t), ONE_LINK, 1), "#.*$", "")).alias("target"), (s != "").alias("subject")),
    )
    text = F.trim(F.regexp_replace(F.regexp_replace(unmarked(F.col("raw")), r"^[*#:;]+\s*", ""), r"\s+", " "))
    return raws.select(key, "para", "k", text.alias("text"), F.filter(found, lambda w: w["title"] != "").alias("works")).where("text <> ''")


def requested_names(pages: DataFrame, key: str, game: str, page: str, sentences: DataFrame) -> DataFrame:
    """(key, names): normal names of the work asked for: the game, the page's work, the bold italic titles of the first paragraph
    that has one, their subtitles of two words or more, and the names of paired versions ("Some Red and Blue")."""
    subjects = sentences.select(key, "para", F.explode(F.filter("works", lambda w: w["subject"])["title"]).alias("title"))
    first = subjects.groupBy(key).agg(F.min("para").alias("para"))
    subjects = subjects.join(first.hint("merge"), [key, "para"]).select(key, "title")
    asked = F.coalesce(game, F.lit(""))
    titles = pages.select(key, F.explode(F.array(asked, F.regexp_replace(asked, EDITION_TAIL, ""), work_of_page(F.coalesce(page, F.lit(""))))).alias("title")).union(subjects)
    subtitle = F.regexp_extract("title", r":\s*(.+)$", 1)
    subtitle = F.when(F.size(F.split(F.trim(subtitle), r"\s+")) >= 2, subtitle).otherwise("")
    stem, listed = F.regexp_extract(F.trim("title"), VERSIONS, 1), F.regexp_extract(F.trim("title"), VERSIONS, 2)
    items = F.when(listed != "", F.split(listed, r",?\s+(?:and|&)\s+|,\s+")).otherwise(F.array().cast("array<string>"))
    pairs = F.flatten(F.transform(items, lambda a, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda b: F.concat(a, F.lit(" and "), b))))
    names = titles.select(key, F.explode(F.concat(F.array("title", subtitle), items, F.transform(items, lambda i: F.concat(stem, i)), pairs)).alias("name"))
    names = names.select(key, _key_of(F.col("name")).alias("name")).where(F.length("name") >= 3)
    return names.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("names"))


def _judged_works(sentences: DataFrame, about: DataFrame, key: str) -> DataFrame:
    """(key, para, k, i, title, name, target, full, requested, related): every italic title, its normal form, and what it is to the work asked for."""
    rows = sentences.select(key, "para", "k", F.posexplode("works").alias("i", "w")).select(key, "para", "k", "i", "w.title", "w.target")
    rows = rows.select("*", _key_of(F.col("title")).alias("name"), normal_title(F.col("title")).alias("_full"), _key_of(F.col("target")).alias("_to"), _key_of(work_of_page(F.col("target"))).alias("_of"), F.lower(qualifier_of(F.col("target"))).alias("_q"))
    rows = rows.join(about.hint("merge"), key).withColumn("related", F.arrays_overlap(_distinctive(F.col("_full")), F.col("own")))
    known = lambda c: F.array_contains("names", c)
    games = rows.where(~known(F.col("name")) & ~F.col("title").rlike(MUSIC_ALBUM) & F.col("related")).groupBy(key).agg(F.collect_set("name").alias("games"))
    rows = rows.join(games.hint("merge"), key, "left")
    inside = lambda n: F.contains(padded(F.col("name")), padded(n))
    album = F.exists("names", lambda n: F.contains(n, F.lit(" ")) & inside(n)) & F.col("title").rlike(MUSIC_ALBUM) & ~F.col("title").rlike(NOT_MUSIC_ALBUM)
    album = album & ~F.exists(F.coalesce("games", F.array().cast("array<string>")), inside)
    linked = known(F.col("_to")) | (known(F.col("_of")) & ((F.col("_q") == "") | (F.col("_q") == F.col("qualifier"))))
    return rows.select(key, "para", "k", "i", "title", "name", "target", F.col("_full").alias("full"), (F.when(F.col("target") != "", linked).otherwise(known(F.col("name"))) | album).alias("requested"), "related")


def best_places(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(line, k, para, at): of (is plain, line or paragraph, k, tokens in order between blanks) of a page, wikitext first, for each plain sentence
    the first wikitext sentence with the largest share of common tokens, of half the larger set at least. Sets meet by the rarest
    tokens of the plain one, of which one has to be common. Held are the page's own sets, each once."""
    sets, index, known = {}, {}, {}
    for plain, line, k, tokens in rows:
        if not plain:
            if tokens not in sets:
                sets[tokens] = (line, k, frozenset(tokens.split(" ")))
                for w in sets[tokens][2]:
                    index.setdefault(w, []).append(tokens)
            continue
        if tokens not in known:
            own = frozenset(tokens.split(" "))
            probes = sorted(own, key=lambda w: (len(index.get(w, ())), w))[: len(own) - -(-len(own) // 2) + 1]
            met = (sets[u] for u in {u for w in probes for u in index.get(w, ())})
            shares = ((-len(own & u) / max(len(own), len(u)), para, at) for para, at, u in met)
            known[tokens] = min((x for x in shares if x[0] <= -0.5), default=None)
        if known[tokens]:
            yield line, k, *known[tokens][1:]


def _aligned(plain: DataFrame, wiki: DataFrame, key: str) -> DataFrame:
    """(key, line, k, para, at): plain sentences of four tokens at least with their places in the wikitext (best_places). Each sentence's tokens are
    shuffled once, and neither candidates nor postings are."""
    tokens = lambda c: F.array_sort(content_tokens(F.col(c)))
    ours = plain.select(key, F.lit(True).alias("plain"), F.col("line").alias("a"), "k", tokens("sentence").alias("t")).where(F.size("t") >= 4)
    theirs = wiki.select(key, F.lit(False).alias("plain"), F.col("para").alias("a"), "k", tokens("text").alias("t")).where(F.size("t") > 0)
    events = theirs.union(ours).where(F.col(key).isNotNull()).withColumn("t", F.array_join("t", " "))
    return scan(events, [key], ["plain", "a", "k", "t"], "line int, k int, para int, at int", best_places)


def named_plainly(words: str, names: list[str], longer: list[str], exempt: str) -> tuple[bool, bool]:
    """Whether normal words name the work outside of longer titles: once at least as itself, and once as an edition of it."""
    text = f" {words} "
    for title in sorted(filter(None, longer), key=len, reverse=True):
        text = text.replace(f" {title} ", " \x05 ")
    clean = edition = False
    for name in names:
        if " " not in name and len(name) < 8:
            continue
        for m in re.finditer(f"(?= {re.escape(name)} )", text):
            before = " ".join(text[max(0, m.start() - 40) : m.start()].split(" ")[-4:])
            after = " ".join(text[m.start() + len(name) + 2 :].split(" ")[:2])
            if name != exempt and (re.search(EDITION_WORD, before) or re.match(EDITION_AFTER, after)):
                edition = True
            else:
                clean = True
    return clean, edition


@F.pandas_udf(StructType([StructField("clean", BooleanType()), StructField("edition", BooleanType())]))
def _named_plainly(words: pd.Series, names: pd.Series, longer: pd.Series, exempt: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([named_plainly(*x) for x in zip(words, names, longer, exempt, strict=True)], columns=["clean", "edition"])


def _carried(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Drops sentences in order of a line; what leans on a dropped one goes with it."""
    for _, sentences in groupby(rows, key=lambda r: r[0]):
        carry = False
        for line, k, sentence, in_other, others, clean, edition, subject_led, edition_led, leans, any_work in sentences:
            names_it = clean or (subject_led and not carry and not edition)
            goes = in_other or (others and not names_it) or (edition_led is not None and not names_it and (edition_led or edition)) or (carry and not names_it and leans and not any_work)
            if goes:
                yield line, k, sentence
            carry = goes


def other_work_sentences(pages: DataFrame, key: str, full: str, markup: str, game: str, page: str) -> DataFrame:
    """(key, line, k, sentence): sentences of the plain text `full` that are about another work than `game`.

    They stand under a heading of another work or of editions, name a related work in italics and not the one asked for, are
    about an edition, or go on about such a sentence before them in their line. A key names one page; null texts are empty,
    and pages without italic sentences or names drop nothing. Repeated sentences are judged at each place. No table that grows with the
    pages is broadcast, though some are small as files: all joins are merged, and the driver holds none of them.
    """
    text = F.coalesce(F.col(full), F.lit(""))
    wiki = written(italic_sentences(pages, key, markup), "wiki-sentences")
    names = requested_names(pages, key, game, page, wiki)
    asked = F.coalesce(game, F.lit(""))
    about = pages.select(key, F.lower(qualifier_of(F.coalesce(page, F.lit("")))).alias("qualifier"), _key_of(asked).alias("_g"), _key_of(work_of_page(F.coalesce(page, F.lit("")))).alias("_p"), asked.rlike(EDITION_WORD).alias("asks_edition"))
    about = about.join(names.hint("merge"), key).join(wiki.select(key).distinct().hint("merge"), key, "left_semi")
    about = about.select(key, "qualifier", "asks_edition", "names", F.array_distinct(F.flatten(F.transform("names", _distinctive))).alias("own"), F.when(F.col("_g") != F.col("_p"), F.col("_g")).otherwise("").alias("exempt"))
    about = written(about, "about")
    works = written(_judged_works(wiki, about.select(key, "qualifier", "names", "own"), key), "works")
    titles = works.where("not requested and related").groupBy(key).agg(F.collect_set("name").alias("other_titles"))
    heads = heading_tree(pages.select(key, text.alias("_t")), key, "_t").join(about.hint("merge"), key).join(titles.hint("merge"), key, "left").withColumn("_h", _key_of(F.col("heading")))
    other = (F.array_contains(F.coalesce("other_titles", F.array().cast("array<string>")), F.col("_h")) & ~F.array_contains("names", F.col("_h"))) | (~F.col("asks_edition") & F.col("heading").rlike(EDITION_HEADING))
    gone = heads.where(other).groupBy(key).agg(F.collect_list(F.struct("from", "to")).alias("gone"))
    lines = pages.select(key, text.alias("_t")).join(gone.hint("merge"), key, "left").select(key, "gone", F.posexplode(F.split("_t", "\n")).alias("line", "s")).where(~F.col("s").rlike(HEADING))
    within = F.exists("gone", lambda g: (F.col("line") >= g["from"]) & (F.col("line") < g["to"]))
    plain = lines.select(key, "line", F.coalesce(within, F.lit(False)).alias("in_other"), F.posexplode(full_sentences(F.col("s"))).alias("k", "sentence"))
    plain = written(plain, "sentences")
    held = works.groupBy(key, "para", F.col("k").alias("at")).agg(F.array_sort(F.collect_list(F.struct("i", "title", "name", "target", "full", "requested", "related"))).alias("works"))
    found = _aligned(plain, wiki, key).join(held.hint("merge"), [key, "para", "at"]).select(key, "line", "k", "works")
    rows = plain.join(found.hint("merge"), [key, "line", "k"], "left").join(about.hint("merge"), key).withColumn("works", F.coalesce("works", F.array().cast("array<struct<i:int,title:string,name:string,target:string,full:string,requested:boolean,related:boolean>>")))
    sentence = F.col("sentence")
    one_word = lambda w: ~F.contains(w["name"], F.lit(" ")) & F.exists("names", lambda n: F.startswith(n, F.concat(w["name"], F.lit(" "))))
    of_series = lambda w: F.rlike(sentence, F.concat(F.lit(r"(?i)\Q"), F.regexp_replace(w["title"], r"\\E", ""), F.lit(r"\E" + OF_SERIES)))
    series = lambda w: F.lower(w["target"]).rlike(r"\b(?:series|franchise)\b") | one_word(w) | of_series(w)
    others = F.exists("works", lambda w: ~w["requested"] & w["related"] & ~series(w))
    rows = rows.withColumn("_w", normal_title(sentence)).withColumn("_names", F.concat("names", F.filter("works", lambda w: w["requested"])["name"]))
    rows = rows.withColumn("longer", F.filter("works", lambda w: ~w["requested"])["full"])
    rows = rows.withColumn("_n", _named_plainly("_w", "_names", "longer", "exempt"))
    rows = rows.select(
        key, "line", "k", "sentence", "in_other", others.alias("others"), "_n.clean", "_n.edition", sentence.rlike(SUBJECT_LED).alias("subject_led"),
        F.when(~F.col("asks_edition"), sentence.rlike(EDITION_LED)).alias("edition_led"), sentence.rlike(LEANS_BACK).alias("leans"), (F.size("works") > 0).alias("any_work"),
    )
    return scan(rows, [key], [c for c in rows.columns if c != key], "line int, k int, sentence string", _carried)
