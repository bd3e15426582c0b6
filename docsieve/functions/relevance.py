"""Whether a page's title fits the title that was asked for: a tree of rules over their words; built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.functions.text import words_of
from docsieve.functions.titles import digits_for_roman, initials_clash

#: Words of titles without weight, of qualifiers that tell of music or of a performer, of other media, of companies and
#: of editions (fixed values: in part those that the reproduced rules are specified with, shortened, in part added; not an
#: independent list).
LIGHT = ("a", "an", "and", "in", "of", "on", "the", "to")
MUSIC_NOTES = ("album", "opera", "single", "song", "soundtrack", "suite", "symphony")
PERFORMER_NOTES = ("band", "choir", "duo", "musician", "orchestra", "singer")
OTHER_MEDIA = ("book", "comic", "film", "magazine", "novel", "tour")
COMPANY_WORDS = ("company", "corporation", "inc", "limited", "records", "studios")
EDITION_NOTES = ("anniversary", "complete", "deluxe", "remake", "remastered", "special")


def among(words: Column, values: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(v) for v in values]))


def qualifier_of(title: Column) -> Column:
    """What stands in brackets at the end of a title; empty if nothing does."""
    return F.regexp_extract(title, r"\(([^()]*)\)\s*$", 1)


def without_qualifier(title: Column) -> Column:
    return F.regexp_replace(title, r"\s*\([^()]*\)\s*$", "")


def weighty(title: Column) -> Column:
    """Words with weight, numbers as digits; all words if none has weight."""
    words = words_of(title)
    kept = F.filter(words, lambda w: ~w.isin(*LIGHT))
    return digits_for_roman(F.when(F.size(kept) > 0, kept).otherwise(words))


def numbers_in(words: Column) -> Column:
    return F.filter(words, lambda w: w.rlike("^[0-9]+$"))


def missing_edition(asked: Column, title: Column) -> Column:
    """The first edition word of the title asked for, its first word apart, that the page's title lacks; else null."""
    rest = F.filter(words_of(asked), lambda w, i: (i > 0) & w.isin(*EDITION_NOTES))
    return F.get(F.filter(rest, lambda w: ~F.array_contains(words_of(title), w)), F.lit(0))


def is_like_a_name(text: Column) -> Column:
    """Two or three capitalised words and nothing else."""
    return text.rlike(r"^\p{Lu}[\p{Ll}'-]+( \p{Lu}[\p{Ll}'-]+){1,2}$") & ~among(words_of(text), LIGHT)


def names_another(title: Column, asked: Column) -> Column:
    """Whether the qualifier, words for a kind of work apart, has no word of what was asked for."""
    named = F.filter(words_of(qualifier_of(title)), lambda w: ~w.isin(*MUSIC_NOTES))
    return (F.size(named) > 0) & (F.size(words_of(asked)) > 0) & ~F.arrays_overlap(named, words_of(asked))


def title_fits(asked: Column, title: Column, artist: Column) -> Column:
    """The first rule of the tree that decides; `artist` tells whether a performer was asked for."""
    bare, note = without_qualifier(title), qualifier_of(title)
    want, got = words_of(asked), words_of(bare)
    a, b = weighty(asked), weighty(bare)
    want_line, got_line = F.array_join(want, " "), F.array_join(got, " ")
    a_line, b_line = F.array_join(a, " "), F.array_join(b, " ")
    numbers, theirs = numbers_in(a), numbers_in(b)
    same_number = F.arrays_overlap(numbers, theirs)
    # A number that stands in both, in Roman figures in one and in digits in the other.
    styles = F.exists(F.array_intersect(numbers, theirs), lambda n: F.array_contains(want, n) != F.array_contains(got, n))
    note_words = words_of(note)
    good_note = among(note_words, MUSIC_NOTES) | (artist & among(note_words, PERFORMER_NOTES)) | (note.rlike(r"^\p{Lu}") & ~among(note_words, PERFORMER_NOTES))
    extends = F.startswith(b_line, F.concat(a_line, F.lit(" ")))
    follows = F.substr(got_line, F.length(want_line) + 1)
    bad_end = F.startswith(follows, F.lit(" s ")) | F.startswith(follows, F.lit(" and ")) | among(got, COMPANY_WORDS) & ~among(want, COMPANY_WORDS)
    shortens = F.startswith(a_line, F.concat(b_line, F.lit(" ")))
    head = F.array_join(weighty(F.get(F.split(asked, r":| - "), F.lit(0))), " ")
    at_break = (head == b_line) | F.coalesce(F.get(b, F.size(b) - 1).rlike("^[0-9]+$"), F.lit(False))
    held = F.size(F.filter(a, lambda w: F.array_contains(b, w)))
    rules: list[tuple[Column, Column]] = [
        ((F.size(want) == 0) | (F.size(got) == 0), F.lit(False)),
        (initials_clash(want, got), F.lit(False)),
        (F.startswith(want_line, F.lit("the ")) & ~F.startswith(got_line, F.lit("the ")), F.lit(False)),
        ((note != "") & ~good_note, F.lit(False)),
        ((F.size(numbers) > 0) & ~same_number, F.lit(False)),
        (styles, F.lit(False)),
        (extends, ~bad_end & ~(among(got, OTHER_MEDIA) & ~among(want, OTHER_MEDIA))),
        (shortens, at_break & (F.size(F.array_except(numbers, theirs)) == 0)),
        (F.size(got) > F.size(want) + 1, F.lit(False)),
        (a_line == b_line, F.lit(True)),
        ((b_line == F.concat(a_line, F.lit("s"))) & (F.size(a) >= 2), F.lit(True)),
        (F.size(a) >= 3, 100 * held >= 85 * F.size(a)),
    ]
    start = F.when(rules[0][0], rules[0][1])
    tree = reduce(lambda chain, rule: chain.when(*rule), rules[1:], start)
    return tree.otherwise((held == F.size(a)) & (F.size(F.array_except(b, a)) == 0))
