"""License scan: MinHash bands over overlapping windows retrieve templates, containment of shingles verifies them.

Windows of a template's length begin at every eighth of it; a window that lies best over a text that holds 80 % of a
template's shingles has at least a Jaccard similarity of `least_jaccard`, and the number of bands is the least for
which such a window meets the template with a probability of 99 %. DataFrame functions only.

A window that holds 80 % of a template's shingles holds one of them whole, and with it that shingle's longest word that
is not too common, its anchor. So texts without an anchor, and windows without one, are left out; no match is lost by it.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, ROWS, SURE, CONTAINED = 5, 2, 0.99, 80
#: Words too common to be anchors where a shingle has another (fixed values).
COMMON = ("and", "any", "are", "the", "this", "that", "under", "with", "work", "you")
#: Notices to look for (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "BSD grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def plain_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def least_jaccard(size: int) -> float:
    """Of a template of `size` words and the best window of that length over a text that holds 80 % of its shingles."""
    n, off = size - WORDS + 1, stride(size) // 2
    held = max(1, -(-CONTAINED * n // 100) - off)
    return held / (2 * n - held)


def stride(size: int) -> int:
    return max(1, size // 8)


def bands(size: int) -> int:
    """The least number of bands of two values with which that window is met with a probability of 99 %."""
    hit = least_jaccard(size) ** ROWS
    return 1 if hit >= SURE else math.ceil(math.log(1 - SURE) / math.log(1 - hit))


def anchors(template: str) -> set[str]:
    words = plain_words(template)
    return {max(words[i : i + WORDS], key=lambda w: (w not in COMMON, len(w), w)) for i in range(len(words) - WORDS + 1)}


def shingles(words: Column) -> Column:
    """Hashes of the runs of five words of an array of at least five."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - (WORDS - 1)), lambda i: F.xxhash64(F.slice(words, i, WORDS)))


def band_keys(shingled: Column, size: Column, count: Column) -> Column:
    """One hash for each of `count` bands: of its number, the window length and the least values of its permutations."""
    low = lambda band, r: F.array_min(F.transform(shingled, lambda x: F.xxhash64(x, band, F.lit(r))))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.xxhash64(b, size, *[low(b, r) for r in range(ROWS)]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Per document and template found: doc_id, license, contained (shared shingles), template_shingles, word.

    Texts are lower-cased runs of a-z and 0-9. A template is found if a window of its length, with a step to either side, holds at least
    80 % of its shingles; word is the first word of the best such window, the earliest if several are best. Templates of fewer than
    five words are refused. Null and empty texts hold none; equal rows of docs count once. Other columns are ignored;
    an empty table gives an empty one.
    """
    templates = TEMPLATES if templates is None else templates
    sizes = {name: len(plain_words(text)) for name, text in templates.items()}
    if any(n < WORDS for n in sizes.values()):
        raise ValueError("a template has fewer than five words")
    spark = docs.sparkSession
    marks = sorted(set().union(*map(anchors, templates.values())))
    rows = [F.struct(F.lit(k).alias("license"), F.lit(sizes[k]).alias("size"), F.lit(bands(sizes[k])).alias("bands"), F.lit(" ".join(plain_words(t))).alias("line")) for k, t in sorted(templates.items())]
    known = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.license", "t.size", "t.bands", shingles(F.split("t.line", " ")).alias("own"))
    known = known.select("license", "own", F.explode(band_keys(F.col("own"), F.col("size"), F.col("bands"))).alias("band"))

    anchor = f"(?<![a-z0-9])(?:{'|'.join(map(re.escape, marks))})(?![a-z0-9])"
    some = docs.select("doc_id", "text").where(F.lower("text").rlike(anchor))
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    some = some.select("doc_id", words.alias("words")).where(F.size("words") >= WORDS)
    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(marks), i)), lambda i: i.isNotNull())
    some = some.select("doc_id", "words", at.alias("at")).where(F.size("at") > 0)

    lengths = F.array(*[F.struct(F.lit(n).alias("size"), F.lit(stride(n)).alias("step"), F.lit(bands(n)).alias("bands")) for n in sorted(set(sizes.values()))])
    some = some.select("doc_id", "words", "at", F.size("words").alias("n"), F.explode(lengths).alias("l")).select("doc_id", "words", "at", "n", "l.*")
    # Windows of each length that hold an anchor: starts are multiples of the step, and the last place that fits.
    size, step = F.col("size"), F.col("step")
    last = F.greatest(F.col("n") - size, F.lit(0))
    whole = lambda x: F.floor(x / step).cast("int")
    near = F.transform("at", lambda p: F.transform(F.sequence(whole(F.greatest(p - size + 1, F.lit(0))), whole(p)), lambda s: F.least(s * step, last)))
    # Containment is counted a step beyond both ends, so that no shingle is lost to where windows happen to begin. Words
    # are cut out before the windows become rows, so that no row holds a whole text.
    cut = lambda s: F.struct(
        s.alias("start"), F.slice("words", s + 1, size).alias("w"), F.slice("words", F.greatest(s - step, F.lit(0)) + 1, size + 2 * step).alias("wider")
    )
    window = some.select("doc_id", "size", "bands", F.explode(F.transform(F.array_distinct(F.flatten(near)), cut)).alias("x"))
    window = window.select("doc_id", "size", "bands", "x.*").where(F.size("w") >= WORDS)
    keyed = window.select("doc_id", "start", shingles(F.col("wider")).alias("held"), F.explode(band_keys(shingles(F.col("w")), size, F.col("bands"))).alias("band"))
    # The templates are a fixed list of this module or of the caller's, a few rows each.
    met = keyed.join(F.broadcast(known), "band")
    met = met.select("doc_id", "start", "license", F.size(F.array_intersect("own", "held")).alias("contained"), F.size(F.array_distinct("own")).alias("template_shingles"))
    found = met.where(F.col("contained") * 100 >= F.col("template_shingles") * CONTAINED)
    best = F.max(F.struct("contained", (-F.col("start")).alias("before"))).alias("best")
    out = found.groupBy("doc_id", "license", "template_shingles").agg(best)
    return out.select("doc_id", "license", F.col("best.contained").alias("contained"), "template_shingles", (-F.col("best.before")).cast("long").alias("word"))
