"""Many phrases found in one pass of a text, names masked; phrases about who someone is, apart from music and names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HITS = "array<struct<at:int,phrase:string,written:string,mark:string,before:string,after:string>>"
#: Words of music after which, or before which, a phrase tells of the music; words that open a sentence in capitals and name nobody.
MUSIC = (
    "music", "musical", "musics", "song", "songs", "hymn", "hymns", "hymnal", "hymnody", "chant", "chants",
    "chanting", "rock", "pop", "metal", "rap", "punk", "folk", "gospel", "jazz", "choir", "choirs", "choral",
    "liturgy", "liturgical", "worship", "mass", "album", "albums", "record", "records", "label", "chart", "charts",
    "festival", "festivals", "radio", "flute", "flutes", "drum", "drums", "drumming", "instrument", "instruments",
    "dance", "dances", "style", "styles", "scale", "scales", "mode", "modes", "melody", "melodies", "rhythm",
    "rhythms", "singing", "throat", "harp", "harps", "repertoire", "canticle", "canticles", "psalm", "psalms",
)
MUSIC_BEFORE = ("music", "musical")
NOT_A_NAME = (
    "the", "a", "an", "in", "as", "his", "her", "their", "its", "for", "on", "at", "by", "with", "from", "of", "and", "but", "to", "both", "many", "some", "most", "other", "this", "that", "while", "after", "before",
)
DEMONYM = r"(?i)^(?=.{4}).*(?:an|ish|ese|i)$"
QUOTES = "[\"“”'‘’«»]"
SELF_REFLEXIVE = (
    r"(?i)\b(?:describe[sd]?|describing|call(?:s|ed|ing)?|consider(?:s|ed|ing)?|refer(?:s|red|ring)? to|define[sd]?|defining|sees?|saw|regard(?:s|ed)?|label(?:s|ed|led)?|identif(?:y|ies|ied|ying))"
    r"\s+(?:himself|herself|themselves|themself|itself)\b"
)
IDENTIFIES_AS = r"(?i)\b([\p{L}'’]+)\s+identif(?:y|ies|ied|ying)\s+as\b"
PASSIVE = ("was", "were", "been", "being", "be", "is", "are")


def _lower(text: str) -> str:
    """Lower case, letter by letter, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def phrase_hits(text: Column, phrases: list[str], names: Column | None = None) -> Column:
    """Every place of every phrase as whole words in any case, in order of places and phrases: what one regex per phrase would find.

    An automaton of all phrases reads each text once, however many they are; it is built once per worker and its size is that of the list, a
    parameter. Runs of blanks are read as one (places are in that text). names (an array) stand masked, longest first,
    so that nothing in a name is found; those below two characters are not. With a place come the phrase as written, the character and the
    word before it and the word after it. Null texts and those without phrases have empty arrays; empty phrases find nothing.
    """
    wanted = sorted({re.sub(r"\s+", " ", _lower(p)).strip() for p in phrases} - {""})
    held: list = []

    def automaton():  # noqa: ANN202
        import ahocorasick

        if not held:
            found = ahocorasick.Automaton()
            for p in wanted:
                found.add_word(p, p)
            if wanted:
                found.make_automaton()
            held.append(found)
        return held[0]

    def places(t: str | None, masks: list[str] | None) -> list[tuple]:
        if not t or not wanted:
            return []
        t = re.sub(r"\s+", " ", t)
        for m in sorted({m.strip() for m in (masks if masks is not None else []) if m and len(m.strip()) > 1}, key=lambda m: (-len(m), m)):
            t = re.sub(rf"(?<![^\W_]){re.escape(m)}(?![^\W_])", lambda x: "x" * len(x[0]), t, flags=re.IGNORECASE)
        low, out, ends = _lower(t), [], {}
        for last, p in automaton().iter(low):
            a, b = last + 1 - len(p), last + 1
            if (a and t[a - 1].isalnum()) or (b < len(t) and t[b].isalnum()) or a < ends.get(p, 0):
                continue
            ends[p] = b
            before = re.search(r"[\w'’.-]*$", t[max(0, a - 80) : a].rstrip())[0]
            out.append((a, p, t[a:b], t[a - 1 : a], before, re.match(r"\s*([\w'’-]*)", t[b : b + 80])[1]))
        return sorted(out)

    @F.pandas_udf(HITS)
    def run(texts: pd.Series, masks: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("at", "phrase", "written", "mark", "before", "after"), p, strict=True)) for p in places(t, m)] for t, m in zip(texts, masks, strict=True)], dtype=object)

    return run(text, F.array().cast("array<string>") if names is None else names)


def of_people(hits: Column) -> Column:
    """Phrases of hits (of `phrase_hits`) that tell of people: not quoted, not of music ("folk song"), and no part of a name, that is beside another capital."""

    def capital(w: Column) -> Column:
        return w.rlike(r"^\p{Lu}")

    def exempt(h: Column) -> Column:
        of_music = h["mark"].rlike(QUOTES) | F.lower(h["after"]).isin(*MUSIC) | F.lower(h["before"]).isin(*MUSIC_BEFORE)
        named = capital(h["written"]) & (h["written"] != F.upper(h["written"]))
        ahead = capital(h["after"]) & ~h["after"].rlike(DEMONYM) & (h["after"] != F.upper(h["after"]))
        behind = capital(h["before"]) & ~h["before"].rlike(r"[.!?]$") & ~h["before"].rlike(DEMONYM) & ~F.lower(h["before"]).isin(*NOT_A_NAME)
        return of_music | (named & (ahead | behind))

    return F.transform(F.filter(hits, lambda h: ~exempt(h)), lambda h: h["phrase"])


def self_describes(text: Column) -> Column:
    """Whether someone tells of themselves ("calls herself", "she identifies as"), not others of them ("was identified as"). Null gives false."""
    who = F.lower(F.regexp_extract(text, IDENTIFIES_AS, 1))
    return F.coalesce(text.rlike(SELF_REFLEXIVE) | ((who != "") & ~who.isin(*PASSIVE)), F.lit(False))


def self_described(caption: Column, terms: Column, own: Column) -> Column:
    """Whether a caption only says what someone says of themselves: it has terms (an array), describes so, and each stands in own, the terms of the self-describing sentences of its source."""
    return self_describes(caption) & (F.size(terms) > 0) & (F.size(F.array_except(terms, own)) == 0)
