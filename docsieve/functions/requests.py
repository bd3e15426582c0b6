"""Titles and artists as typed into a request, without the words on who asked for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, whole: words before "by" or "from" that tell who asked or paid, and artist fields that name nobody.
ASKED_WORDS = r"commission(?:ed)?|requested|request|req\.?|suggested|sponsored|donated|gifted|paid"
NOBODY = "traditional|trad|anonymous|anon|unknown|folk"


def without_credit(text: Column) -> Column:
    """Cut where it tells who asked, with the bracket or the separators before it."""
    return F.trim(F.regexp_replace(text, rf"(?i)[\s,;:|/(\[–—-]+(?:{ASKED_WORDS})\s+(?:by|from)(\s.*)?$", ""))


def without_note(artist: Column) -> Column:
    """An artist without a credit, a dedication and notes in brackets at the end; a handle (@name) stays."""
    bare = F.regexp_replace(without_credit(artist), r"(?i)(?:\s*[,;|–—]|\s+-)\s+for\s+\S.*$", "")
    return F.trim(F.regexp_replace(bare, r"(\s*(\([^()@]*\)|\[[^\[\]@]*\]))+$", ""))


def is_nobody(artist: Column) -> Column:
    return F.trim(artist).rlike(rf"(?i)^({NOBODY})\.?$")
