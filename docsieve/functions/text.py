"""Column functions over text: tokens, sentences, keys, similarity of token sets, word-list screens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that carry no content (fixed values, whole).
STOPWORDS = ("the", "and", "of", "a", "an", "in", "on", "for", "to")
#: Labelled word lists in the order in which they are tried (fixed values of this project's own choosing).
STANDARD = (
    ("abuse", ("idiot", "moron", "scum", "trash", "loser")),
    ("contempt", ("stupid", "pathetic", "worthless", "disgusting", "clown")),
    ("secret", ("password", "token")),
    ("notice", ("licensed", "released")),
)

#: What SQL takes off at the ends of a text: blanks of all widths, no tabs.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
SENTENCE_BREAK = r"""(?<=[.!?]["”]?)\s+(?=["“]?\p{Lu})|\n+"""


def ascii_edges(pattern: str) -> str:
    """A pattern whose word ends are those of SQL and of JavaScript, between ASCII word signs and all others: "An" ends in "Ané". Java's count all letters."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; an empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def every_word(text: Column) -> Column:
    """The words of words_of, with an empty one where text begins or ends between words: for what is held against sets of words only."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def content_tokens(text: Column) -> Column:
    """The set of words longer than two characters that are no stopwords."""
    kept = F.filter(words_of(text), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))
    return F.array_distinct(kept)


def sentences_of(text: Column) -> Column:
    """Sentences: parts between line breaks and full stops followed by a blank, trimmed, none empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n|\. "), lambda s: F.trim(s, F.lit(BLANKS))), lambda s: s != "")


def full_sentences(text: Column) -> Column:
    """Sentences: parts between line breaks and between an end mark and a blank before a capital, trimmed, none empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_BREAK), lambda s: F.trim(s, F.lit(BLANKS))), lambda s: s != "")


def too_similar(both: Column, a: Column, b: Column) -> Column:
    """Near-duplicate sets by sizes: Jaccard at least 1/2, or 7/10 of the smaller one; empty sets are similar to none."""
    return (F.least(a, b) > 0) & ((2 * both >= a + b - both) | (10 * both >= 7 * F.least(a, b)))


def share(caption: Column, sentence: Column) -> Column:
    """Share of a caption's tokens that a sentence has; 0 for a caption without tokens."""
    return F.when(F.size(caption) > 0, F.size(F.array_intersect(caption, sentence)) / F.size(caption)).otherwise(0.0)


def first_reason(text: Column, standard: tuple[tuple[str, tuple[str, ...]], ...] = STANDARD) -> Column:
    """Label of the first list that has a word of the text, or null."""
    words = words_of(text)
    return F.coalesce(*[F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in ws])), label) for label, ws in standard])


def identity_key(list_id: Column, video_id: Column, artist: Column, title: Column) -> Column:
    """List id, else video id, else the lower-cased names."""
    names = F.concat_ws(":::", F.lower(F.trim(artist)), F.lower(F.trim(title)))
    return F.coalesce(F.concat(F.lit("list:"), list_id.cast("string")), F.concat(F.lit("video:"), video_id), names)


def close_name(a: Column, b: Column, percent: int = 15) -> Column:
    """Edit distance, blanks apart, of at most the greater of 1 and a share of the longer name."""
    x, y = F.replace(F.lower(a), F.lit(" "), F.lit("")), F.replace(F.lower(b), F.lit(" "), F.lit(""))
    most = F.greatest(F.lit(1), F.floor(F.greatest(F.length(x), F.length(y)) * percent / 100)).cast("int")
    return F.levenshtein(x, y) <= most


def clean_request(text: Column, most: int = 200) -> Column:
    """Control characters to blanks, white space collapsed and trimmed, cut to 200 characters."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f]", " "), r" {2,}", " ")), F.lit(most))


def without_markers(text: Column) -> Column:
    """Leading bullets and numbers, and quotes around the whole, taken off."""
    bare = F.regexp_replace(F.trim(text), r"^(?:[-*•]+|\d+[.)])\s+", "")
    return F.regexp_replace(bare, '^"(.*)"$', "$1")


class _Bases(dict):
    """What is left of a character without its combining marks: marks never change places with what is none, so one by one is as good."""

    def __missing__(self, code: int) -> str:
        self[code] = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        return self[code]


@F.pandas_udf(StringType())
def fold_case(text: pd.Series) -> pd.Series:
    """Lower case without combining marks (Spark has no Unicode normalisation of its own)."""
    bases = _Bases()

    def fold(x: str | None) -> str | None:
        return x if x is None else x.lower() if x.isascii() else x.translate(bases).lower()

    return text.map(fold)


class _PlainBases(dict):
    """What SQL leaves of a character without accents, in lower case: marks of all kinds go, and what is left is composed."""

    def __missing__(self, code: int) -> str:
        self[code] = unicodedata.normalize("NFC", "".join(c.lower() for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c)[0] != "M"))
        return self[code]


@F.pandas_udf(StringType())
def plain_case(text: pd.Series) -> pd.Series:
    """fold_case with the marks and capitals of SQL, for which a sigma at the end of a word is no other one."""
    bases = _PlainBases()
    return text.map(lambda x: x if x is None else x.lower() if x.isascii() else x.translate(bases))


def luminance(red: Column, green: Column, blue: Column) -> Column:
    """Relative luminance of an sRGB colour with components 0 to 255."""
    line = lambda c: F.when(c / 255 <= 0.03928, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * line(red) + 0.7152 * line(green) + 0.0722 * line(blue)


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def plain_date(date: Column, precision: Column) -> Column:
    """An ISO date by its precision: 9 year, 10 month, 11 day; null if it is no date."""
    day = F.try_to_timestamp(F.regexp_replace(F.left(F.regexp_replace(date, "^[+]", ""), F.lit(10)), "-00", "-01"), F.lit("yyyy-MM-dd"))
    return F.when(precision == 9, F.date_format(day, "yyyy")).when(precision == 10, F.date_format(day, "MMMM yyyy")).when(precision == 11, F.date_format(day, "d MMMM yyyy"))
