"""The first box template of a page's markup as a kind and fields, and what follows from fields."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

BOX = StructType([StructField("kind", StringType()), StructField("fields", MapType(StringType(), StringType()))])
_NOISE = re.compile(r"<!--.*?-->|<ref[^>]*/>|<ref[^>]*>.*?</ref>", re.S | re.I)


def top_level(body: str, mark: str = "|") -> list[str]:
    """Parts of a template's body between marks that are in no inner template and no link."""
    parts, depth, last, i = [], 0, 0, 0
    while i < len(body):
        pair = body[i : i + 2]
        if pair in ("{{", "[["):
            depth, i = depth + 1, i + 2
        elif pair in ("}}", "]]"):
            depth, i = max(0, depth - 1), i + 2
        else:
            if body[i] == mark and depth == 0:
                parts.append(body[last:i])
                last = i + 1
            i += 1
    return [*parts, body[last:]]


def readable(value: str) -> str:
    """Links to their labels, inner templates to their unnamed arguments, one item a line."""
    value = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", value)
    while (new := re.sub(r"\{\{([^{}]*)\}\}", lambda m: "\n".join(x for x in m[1].split("|")[1:] if "=" not in x), value)) != value:
        value = new
    value = re.sub(r"<br\s*/?>|^\s*\*+", "\n", value, flags=re.M | re.I)
    value = re.sub(r"<[^<>]*>|'{2,}", "", value)
    return "\n".join(x for x in (" ".join(y.split()) for y in value.split("\n")) if x)


def first_box(markup: str | None, name: str = "infobox") -> tuple[str, dict[str, str]] | None:
    """(kind, fields) of the first template whose name begins with `name`; None without one or with one never closed."""
    text = _NOISE.sub("", markup or "")
    at = re.search(r"\{\{\s*" + re.escape(name), text, re.I)
    if not at:
        return None
    depth, i = 0, at.start()
    while i < len(text) - 1:
        pair = text[i : i + 2]
        if pair == "{{":
            depth, i = depth + 1, i + 2
        elif pair == "}}":
            depth, i = depth - 1, i + 2
            if depth == 0:
                break
        else:
            i += 1
    if depth:
        return None
    head, *rest = top_level(text[at.start() + 2 : i - 2])
    fields = {}
    for part in rest:
        key, sign, value = part.partition("=")
        value = readable(value)
        if sign and value:
            fields[key.strip().lower().replace(" ", "_")] = value
    return head.strip()[len(name) :].strip().lower(), fields


@F.pandas_udf(BOX)
def box_of(markup: pd.Series) -> pd.DataFrame:
    found = [first_box(x) or (None, None) for x in markup]
    return pd.DataFrame({"kind": [k for k, _ in found], "fields": [f for _, f in found]})


def items_of(fields: Column, key: str) -> Column:
    """The items of a field: its lines, parted at commas too."""
    return F.filter(F.transform(F.split(F.element_at(fields, key), r"\n|, "), lambda x: F.trim(x)), lambda x: x != "")


def facts_of(box: Column, most: int = 160) -> Column:
    """Sentences for the fields that are there, each within `most` characters."""
    fields = box["fields"]
    line = lambda key, text: F.when(F.element_at(fields, key).isNotNull(), F.format_string(text, F.array_join(items_of(fields, key), ", ")))
    lines = F.array(line("released", "It came out in %s."), line("genre", "Its genre is given as %s."), line("writer", "It was written by %s."), line("producer", "It was produced by %s."), line("label", "Its label is %s."))
    return F.filter(lines, lambda x: x.isNotNull() & (F.length(x) <= most))


def said_elsewhere(items: Column, texts: Column) -> Column:
    """Whether every item stands in some of the texts; an empty list is not said."""
    return (F.size(items) > 0) & F.forall(items, lambda i: F.exists(texts, lambda t: F.contains(F.lower(t), F.lower(i))))
