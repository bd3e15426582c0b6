"""Wikitext to plain text in which italic titles and links are marked by control characters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Marks of an italic title's begin and end, of a link's shown text, and of a title in bold italics.
BEGIN, END, SHOWN, SUBJECT = "\x01", "\x02", "\x03", "\x04"
#: Templates whose text belongs to the sentence, with the argument that holds it (-1: an apostrophe).
TEXT_TEMPLATES = {"nihongo": 1, "nihongo2": 1, "nihongo3": 1, "nihongo foot": 1, "lang": 2, "nowrap": 1, "nobr": 1, "small": 1, "ill": 1, "interlanguage link": 1, "not a typo": 1, "vgy": 1, "'": -1}
LEFT_OUT_LINKS = ("file:", "image:", "category:")

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
REFERENCE = re.compile(r"<ref[^>]*/>|<ref[^>]*>.*?</ref>", re.S | re.I)
BRACKETS = re.compile(r"(\{\{|\}\}|\[\[|\]\])")


def until_none_is_left(pattern: re.Pattern, text: str) -> str:
    """Removals again and again, as one may join what makes another match; every round shortens the text, so it ends."""
    n = 1
    while n:
        text, n = pattern.subn("", text)
    return text


def _closed(opener: str, body: str) -> str:
    if opener == "[[":
        return "" if body.lstrip().lower().startswith(LEFT_OUT_LINKS) else f"[[{body.replace('|', SHOWN)}]]"
    name, *rest = body.split("|")
    at = TEXT_TEMPLATES.get(name.strip().lower())
    if at is None or at > len(rest):
        return ""
    return "'" if at < 0 else re.sub(r"^\s*\d+\s*=\s*", "", rest[at - 1])


def without_markup(text: str) -> str:
    """Templates and links resolved from the inside out in one pass over their brackets; what never closes stays as it is."""
    parts: list[list[str]] = [[]]
    openers: list[str] = []
    for token in BRACKETS.split(text):
        if token in ("{{", "[["):
            openers.append(token)
            parts.append([])
        elif openers and token == {"{{": "}}", "[[": "]]"}[openers[-1]]:
            body = "".join(parts.pop())
            parts[-1].append(_closed(openers.pop(), body))
        else:
            parts[-1].append(token)
    while openers:
        body = "".join(parts.pop())
        parts[-1].append(openers.pop() + body)
    return "".join(parts[0])


def marked_text(text: str | None) -> str:
    """Plain lines of a wikitext: no references, comments, files, tables, templates or tags; italics and links marked."""
    if not text:
        return ""
    before = None
    while before != text:
        before = text
        text = until_none_is_left(REFERENCE, until_none_is_left(COMMENT, text))
    text = without_markup(re.sub(r"\{\|.*?\|\}", "", text, flags=re.S))
    text = re.sub("[<>]", "", until_none_is_left(re.compile(r"<[^>]+>"), text))
    text = re.sub(r"'''''([^'\n][^\n]*?)'''''", rf"{BEGIN}{SUBJECT}\1{END}", text)
    return re.sub(r"''([^'\n][^\n]*?)''", rf"{BEGIN}\1{END}", text.replace("'''", ""))


#: Whole texts go to Python in batches of a hundred rows, not in Arrow batches of 10,000.
_marked = F.udf(marked_text, StringType(), useArrow=False)


def marked(text: Column | str) -> Column:
    return _marked(text)


def link_text(text: Column) -> Column:
    """What links show; a link without shown text shows its page, without the place in it."""
    shown = F.regexp_replace(text, r"\[\[[^\]\x03]*\x03([^\]]*)\]\]", "$1")
    shown = F.regexp_replace(shown, r"\[\[([^\]\x03#]*)[^\]\x03]*\]\]", "$1")
    return F.regexp_replace(shown, r"\[https?://\S+\s*([^\]]*)\]", "$1")


def unmarked(text: Column) -> Column:
    return F.regexp_replace(link_text(text), r"[\x01-\x04]", "")
