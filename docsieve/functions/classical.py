"""Titles of classical pieces read apart, and the names that a credit may be written with.

Null titles give nulls; a title without numbers, key and movement gives empty lists, null and its own name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.functions import titles as N
from docsieve.functions.requests import is_nobody
from docsieve.functions.text import fold_case

#: Catalogues as they are written in lists and as they are spelled here.
CATALOG = r"(?<![\p{L}#♯♭-])(op(?:us)?\.?|bwv|kv?\.?|d\.?|hob\.?|rv|hwv|s\.?|woo|l\.?|b\.?)\s*((?:[ivx]+[a-z]?:)?\d+[a-z]?(?:\s*/\s*\d+[a-z]?)?)(?![\p{L}\d])"
CATALOG_NAMES = {"op": "Op.", "opus": "Op.", "bwv": "BWV", "k": "K.", "kv": "K.", "d": "D.", "hob": "Hob.", "rv": "RV", "hwv": "HWV", "s": "S.", "woo": "WoO", "l": "L.", "b": "B."}
#: Numbers of pieces, keys with and without a mode, movements, ordinals and roman numbers.
NUMBERED = r"(?:\b(?:no|nr|nos)\.?\s*|(?<![A-Ga-g])#\s*)(\d+)\b"
KEY_MODE = r"(?:\bin\s+)?(?<!\p{L})([A-Ga-g])(?:\s*-?\s*(flat|sharp)|\s*([♭♯#]|b(?=\s)))?\s+(major|minor)\b"
KEY_IN = r"\bin\s+([A-G])(?:\s*-?\s*(flat|sharp)|([♭♯#]|b\b))?(?![\p{L}\d])"
MOVEMENTS = (
    r"\s*[(\[]?\b(\d)(?:st|nd|rd|th)\s+(?:movement|mvt\.?|mov\.?)[)\]]?",
    r"\s*[(\[]?\b(?:movement|mvt\.?|mov\.?)\s+(\d|[ivx]{1,4})\b[)\]]?",
    r"\s*[(\[]?\b(first|second|third|fourth|fifth|sixth)\s+movement[)\]]?",
    r"\s*[(\[]?\bvar(?:iation|\.)\s*(\d+)[)\]]?",
)
#: A numbered and named movement at the end; its case counts.
NAMED_MOVEMENT = r"(?:\s*[:,–—-]\s*|\s+)\b([IV]{1,3})\.\s+(\p{Lu}[\p{L} ]*?)\s*$"
COUNTED = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8}
FORMS = (
    r"\b(?:sonata|sonatina|nocturne|pr[eé]lude|[eé]tude|etude|waltz|valse|symphony|concerto|suite|fugue|toccata|mazurka|polonaise|ballade|impromptu|rhapsod(?:y|ie)|gymnop[eé]die|arabesque|minuet|menuet|serenade|scherzo|rondo|bagatelle|partita"
    r"|invention|sinfonia|overture|requiem|cantata|aria|liebestraum|barcarolle|berceuse|fantasia|fantaisie|intermezzo|capriccio|caprice|divertimento|canon|chaconne|passacaglia|gavotte|sarabande|gigue|allemande|courante|lied|lieder|r[eê]verie"
    r"|humoresque|moment musical)s?\b"
)


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _without_first(text: Column, pattern: str) -> Column:
    """The text with a blank for the first place that fits; a flag in front of the pattern holds for all of it."""
    return F.regexp_replace(text, "^(.*?)" + pattern, "$1 ") if not pattern.startswith("(?i") else F.regexp_replace(text, "(?iu)^(.*?)" + pattern[5:], "$1 ")


def _stripped(text: Column) -> Column:
    """Without blanks and separators at both ends, then without quotes around the whole."""
    bare = F.regexp_replace(text, r"^[\s,:;–—-]+|[\s,:;–—-]+$", "")
    return F.trim(F.regexp_replace(bare, r'^["“”](.*)["“”]$', "$1"))


def _spelled(text: Column, pattern: str, mode: bool) -> Column:
    """A key as "E-flat major"."""
    part = lambda i: F.regexp_extract(text, pattern, i)
    turn = F.when(part(2) != "", F.lower(part(2))).when(part(3).isin("#", "♯"), "sharp").when(part(3) != "", "flat")
    name = F.concat(F.upper(part(1)), F.coalesce(F.concat(F.lit("-"), turn), F.lit("")))
    return F.concat(name, F.lit(" "), F.lower(part(4))) if mode else name


def _held(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value found once however often it is used: conditions over expressions over conditions would find it anew in each place."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _without_movement(padded: Column) -> Column:
    """(movement, movement_name, rest) of a title between blanks: the first of the movements that it has, else a numbered and named one at its end."""
    flagged = ["(?iu)" + m for m in MOVEMENTS]
    number = lambda m: F.lower(F.regexp_extract(padded, m, 1))
    counted = lambda x: F.coalesce(F.try_element_at(_map(COUNTED), x), x.try_cast("int"))
    state = lambda at, name, rest: F.struct(at.cast("int").alias("movement"), name.cast("string").alias("movement_name"), rest.alias("rest"))
    named = state(counted(number(NAMED_MOVEMENT)), F.regexp_extract(padded, NAMED_MOVEMENT, 2), _without_first(padded, NAMED_MOVEMENT))
    out = F.when(padded.rlike(NAMED_MOVEMENT), named).otherwise(state(F.lit(None), F.lit(None), padded))
    for m in reversed(flagged):
        out = F.when(padded.rlike(m), state(counted(number(m)), F.lit(None), _without_first(padded, m))).otherwise(out)
    return out


def _catalogs(text: Column) -> Column:
    kinds, codes = (F.regexp_extract_all(text, F.lit("(?iu)" + CATALOG), F.lit(i)) for i in (1, 2))
    spelled = lambda k, c: F.concat_ws(" ", F.try_element_at(_map(CATALOG_NAMES), F.regexp_replace(F.lower(k), r"\.$", "")), F.regexp_replace(c, r"\s+", ""))
    return F.zip_with(kinds, codes, spelled)


def _keyed(plain: Column) -> Column:
    """(key, left): the key of a title, and the title without it."""
    with_mode = "(?iu)" + KEY_MODE
    state = lambda key, left: F.struct(key.alias("key"), F.trim(left).alias("left"))
    moded = state(_spelled(plain, with_mode, True), _without_first(plain, with_mode))
    without = state(_spelled(plain, KEY_IN, False), _without_first(plain, KEY_IN))
    return F.when(plain.rlike(with_mode), moded).when(plain.rlike(KEY_IN), without).otherwise(state(F.lit(None).cast("string"), plain))


def _bracketed(left: Column) -> Column:
    """(name, alias): a title without its last bracket, and what that holds unless it is a note on the version."""
    bracket = r"^(.*?)\s*[(\[]([^)\]]+)[)\]]\s*$"

    def parted(held: Column) -> Column:
        def named(inner: Column) -> Column:
            alias = F.when((inner != "") & ~N.is_version_note(held), inner)
            head = F.when((held != "") & (alias.isNotNull() | ~inner.rlike(r"[\p{L}\p{N}]")), F.regexp_extract(left, bracket, 1)).otherwise(left)
            tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(head, r"\s*[(\[]\s*[)\]]\s*", " "), r"\s*,\s*(?:,\s*)+", ", "), r"\s+", " ")
            return F.struct(_stripped(tidy).alias("name"), alias.alias("alias"))

        return _held(_stripped(F.regexp_replace(held, r"(?i)(?:^|[\s,;:])from\s.*$", "")), named)

    return _held(F.regexp_extract(left, bracket, 2), parted)


def piece_parts(title: Column) -> Column:
    """(name, alias, catalogs, numbers, key, movement, movement_name, classical) of a title.

    The movement goes first, then catalogue numbers, numbers and the key; what a last bracket holds is another name of
    the piece unless it is a note on the version. Each step is found once and handed on.
    """

    def after_movement(m: Column) -> Column:
        def after_catalogs(bare: Column) -> Column:
            codes = F.regexp_extract_all(m["rest"], F.lit("(?iu)" + CATALOG), F.lit(2))
            numbers = F.array_distinct(F.concat(F.flatten(F.transform(codes, lambda c: F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)))), F.regexp_extract_all(bare, F.lit("(?iu)" + NUMBERED), F.lit(1))))
            after_key = lambda k: _held(_bracketed(k["left"]), lambda b: _held(_catalogs(m["rest"]), lambda c: parts(k["key"], b, c)))

            def parts(key: Column, b: Column, kept: Column) -> Column:
                classical = (F.size(kept) > 0) | key.isNotNull() | m["movement"].isNotNull() | m["movement_name"].isNotNull() | b["name"].rlike("(?iu)" + FORMS)
                return F.struct(b["name"].alias("name"), b["alias"].alias("alias"), kept.alias("catalogs"), numbers.alias("numbers"), key.alias("key"), m["movement"].alias("movement"), m["movement_name"].alias("movement_name"), classical.alias("classical"))

            return _held(_held(F.regexp_replace(bare, "(?iu)" + NUMBERED, " "), _keyed), after_key)

        return _held(F.regexp_replace(m["rest"], "(?iu)" + CATALOG, " "), after_catalogs)

    return _held(_held(F.concat(F.lit(" "), F.trim(title), F.lit(" ")), _without_movement), after_movement)


def one_spelling(text: Column) -> Column:
    """Keys as "c sharp" and "e flat" in lower or upper case as they come, however they are written."""
    sharp = F.regexp_replace(text, r"(?<!\p{L})([A-Ga-g])\s*(?:[#♯]|-?\s*sharp\b)", "$1 sharp")
    return F.regexp_replace(sharp, r"(?iu)(?<!\p{L})([A-Ga-g])\s*(?:♭|-?\s*flat\b|b(?=\s+(?:major|minor)\b))", "$1 flat")


def letters_for_signs(name: Column) -> Column:
    """"P!nk" and "Ke$ha" as "Pink" and "Kesha"."""
    return F.regexp_replace(F.regexp_replace(name, r"(?<=\p{L})!(?=\p{L})", "i"), r"(?<=\p{L})\$(?=\p{L})", "s")


def artist_names(artist: Column) -> Column:
    """The names that a credit may be written with, as title keys: the whole, the lead, two people, "and" for "&", letters for signs.

    Empty for nobody's names; null gives null. Names that are equal as keys come once, in this order.
    """
    lead = F.get(F.split(artist, r"(?i)\s*,\s*|\s+(?:feat\.?|ft\.?|featuring)\s+"), F.lit(0))
    two = F.split(artist, r"(?i)\s+(?:and|&)\s+")
    people = F.when((F.size(two) == 2) & F.forall(two, lambda p: F.size(F.split(F.trim(p), r"\s+")) >= 2), two).otherwise(F.array().cast("array<string>"))
    joined = F.array(F.regexp_replace(lead, r"(?i)\s+and\s+", " & "), F.regexp_replace(lead, r"\s+&\s+", " and "))
    every = F.concat(F.array(artist, lead), people, joined, F.array(letters_for_signs(artist), letters_for_signs(lead)))
    folded = F.split(fold_case(F.array_join(F.transform(every, lambda n: F.regexp_replace(n, r"\n", " ")), "\n")), "\n")
    keys = F.transform(folded, lambda n: F.trim(F.regexp_replace(F.regexp_replace(n, r"(\s*[(\[][^()\[\]]*[)\]])+\s*$", ""), r"[^\p{L}\p{N}]+", " ")))
    return F.when(is_nobody(artist), F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(keys, lambda k: k != "")))
