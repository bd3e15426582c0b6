"""Limits that captions drop, put back from the sentence that they retell; markup removed until none is left.

All but `without_markup` are built-in expressions. A repair ends: each limit of the sentence is tried once, in order, and
one that the caption has already is passed over, so that a repaired caption is repaired to itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.frames import QUOTED, REGIONS
from docsieve.functions.grounding import LONGEST, screen_reason
from docsieve.functions.text import BLANKS, ascii_edges
from docsieve.functions.wording import quoted

#: Patterns and words that the rules are specified with.
NUMBER = r"(?:US)?[$£€]?\d[\d,]*(?:\.\d+)?"
NUMBER_LIMIT = rf"(?i)\b(an estimated|estimated|approximately|roughly|about|around|nearly|almost|over|more than|less than|fewer than|under|up to)\s+({NUMBER})"
ANY_NUMBER_LIMIT = r"(?i)\b(?:estimated|approximately|roughly|about|around|nearly|almost|over|more than|less than|fewer than|under|up to|some|at least|close to|just)\s+(?:of\s+)?"
SCOPE_ADVERB = r"(?i)\b(usually|typically|mostly|largely|estimated|approximately)\b"
SAME_LIMIT = {
    "usually": r"\b(?:usually|typically|often|generally|normally|commonly|tends?)\b",
    "typically": r"\b(?:usually|typically|often|generally|normally|commonly|tends?)\b",
    "mostly": r"\b(?:most|mostly|majority|largely|mainly|primarily|chiefly)\b",
    "largely": r"\b(?:most|mostly|majority|largely|mainly|primarily|chiefly)\b",
    "estimated": r"\b(?:estimat\w*|about|around|roughly|nearly|approximately|some)\b",
    "approximately": r"\b(?:about|around|roughly|nearly|approximately|estimat\w*|some)\b",
}
SMALL_WORDS = ("the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "by", "with", "was", "were", "is", "it", "its", "as", "from", "also")
REGION_PHRASE = r"\b(?:[Ii]n|[Aa]cross|[Tt]hroughout) (?:the )?(?:" + "|".join(sorted(REGIONS, key=len, reverse=True)) + r")(?: alone)?\b"
ANY_REGION = r"\b(?:" + "|".join(sorted(REGIONS, key=len, reverse=True)) + r"|Japanese|North American|European|American|British)\b"
WIDER_SCOPE = r"(?i)\b(?:internationally|worldwide|globally|overseas|abroad|elsewhere|other (?:regions|countries|territories|markets)|outside (?:of )?(?:the )?\p{Lu}\w+)\b"
FIRST_WEEK = r"(?i)\b(?:in|during) (?:its|their|the) first week(?: of (?:release|sales|its release))?\b"
SEPARATOR = r"[;,]\s|\s(?:while|whereas|but|although)\s"
COMMENT = r"<!--[\s\S]*?(?:-->|$)"
REFERENCE = r"(?i)<ref[^>]*/>|<ref[^>]*>[\s\S]*?</ref>"


def _state(text: Column, dropped: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (F.lit(None).cast("string") if dropped is None else dropped).alias("dropped"))


def without_markup(text: Column, patterns: tuple[str, ...] = (COMMENT, REFERENCE)) -> Column:
    """A text without what the patterns find, nor what is found once that is gone ("<!<!---->--"), until none of them finds any.

    Every turn but the last makes a text shorter, so it ends; turns are as many as things are nested. `$` is the end of the text. Null stays null.
    Whole texts go to Python in batches of a hundred rows, not in Arrow batches of 10,000.
    """
    compiled = [re.compile(p.replace("$)", r"\Z)")) for p in patterns]

    def bare(t: str | None) -> str | None:
        before = None
        while t is not None and t != before:
            before = t
            for p in compiled:
                last = None
                while t != last:
                    last, t = t, p.sub("", t)
        return t

    return F.udf(bare, "string", useArrow=False)(text)


def _standing(word: Column) -> Column:
    """A pattern for a word or phrase with its ends, in any case."""
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), quoted(word), F.lit(r"(?![\p{L}\p{N}])"))


def _times(text: Column, pattern: Column) -> Column:
    return F.size(F.regexp_extract_all(text, pattern, F.lit(0)))


def _bare(number: Column) -> Column:
    return F.regexp_replace(number, "[$£€,]|US", "")


def _figures(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))


def number_limits(caption: Column, sentence: Column, inside: bool = False) -> Column:
    """(text, dropped): a caption with "about" or the like before the numbers that the sentence limits; why, where the place is not clear.

    With `inside` also where a number's signs stand within longer ones, as a plain replacement of text in SQL puts it.
    """
    zipped = F.arrays_zip(F.regexp_extract_all(sentence, F.lit(ascii_edges(NUMBER_LIMIT)), F.lit(1)).alias("limit"), F.regexp_extract_all(sentence, F.lit(ascii_edges(NUMBER_LIMIT)), F.lit(2)).alias("number"))

    def step(acc: Column, x: Column) -> Column:
        out, limit = acc["text"], F.lower(x["limit"])
        hits = F.filter(F.regexp_extract_all(out, F.lit(NUMBER), F.lit(0)), lambda h: _bare(h) == _bare(x["number"]))
        hit = F.get(hits, F.lit(0))
        limited = F.exists(hits, lambda h: F.regexp_like(out, F.concat(F.lit(ascii_edges(ANY_NUMBER_LIMIT)), quoted(h))))
        word = F.when(limit == "estimated", F.lit("an estimated")).otherwise(limit)
        word = F.when(F.startswith(out, hit), F.concat(F.upper(F.left(word, F.lit(1))), F.substr(word, F.lit(2)))).otherwise(word)
        with_limit = lambda n: F.concat(word, F.lit(" "), n)
        if inside:
            put = F.replace(out, hit, with_limit(hit))
        else:
            parts, numbers = F.split(out, NUMBER), F.regexp_extract_all(out, F.lit(NUMBER), F.lit(0))
            put = F.array_join(F.zip_with(parts, numbers, lambda p, n: F.concat(p, F.when(_bare(n) == _bare(x["number"]), with_limit(n)).otherwise(F.coalesce(n, F.lit(""))))), "")
        why = F.concat(F.lit('"'), x["limit"], F.lit(" "), x["number"], F.lit('" without "'), x["limit"], F.lit('"'))
        skip = acc["dropped"].isNotNull() | (F.size(hits) == 0) | limited
        return F.when(skip, acc).when(F.size(hits) > 1, _state(out, why)).otherwise(_state(put))

    return F.aggregate(zipped, _state(caption), step)


def scope_adverbs(start: Column, sentence: Column) -> Column:
    """(text, dropped) of (text, dropped): "usually" and the like back before the next word of the sentence; why, where that word is not once in the caption."""
    found = ascii_edges(SCOPE_ADVERB) + r"(?=([^,;.:!?]*))"
    zipped = F.arrays_zip(F.regexp_extract_all(sentence, F.lit(found), F.lit(1)).alias("word"), F.regexp_extract_all(sentence, F.lit(found), F.lit(2)).alias("after"))
    same = F.create_map(*[F.lit(ascii_edges(v)) for kv in SAME_LIMIT.items() for v in kv])

    def step(acc: Column, x: Column) -> Column:
        out, word = acc["text"], F.lower(x["word"])
        said = F.concat(F.lit(" "), F.regexp_replace(F.lower(out), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
        has = F.contains(said, F.concat(F.lit(" "), F.left(word, F.lit(7)))) | F.regexp_like(out, F.concat(F.lit("(?i)"), F.element_at(same, word)))
        number = (word == "estimated") & x["after"].rlike(r"^\s+(?:US)?[$£€]?\d")
        words = F.regexp_extract_all(x["after"], F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"), F.lit(0))
        content = F.slice(F.filter(words, lambda w: ~F.lower(w).isin(*SMALL_WORDS) & (F.length(w) > 2)), 1, 3)
        told = F.exists(content, lambda w: _times(out, _standing(w)) > 0)
        first = F.get(content, F.lit(0))
        clear = (first == F.get(words, F.lit(0))) & (_times(out, _standing(first)) == 1) & ~F.regexp_like(out, F.concat(F.lit("(?iu)^"), quoted(first), F.lit(r"(?![\p{L}\p{N}])"))) & (word != "estimated")
        put = F.trim(F.regexp_replace(out, F.concat(F.lit("("), _standing(first), F.lit(")")), F.concat(word, F.lit(" $1"))), F.lit(BLANKS))
        why = F.concat(F.lit('"'), word, F.lit('" left out'))
        skip = acc["dropped"].isNotNull() | has | number | ~told
        return F.when(skip, acc).when(clear, _state(put)).otherwise(_state(out, why))

    return F.aggregate(zipped, start, step)


def put_back(caption: Column, sentence: Column, phrase: Column) -> Column:
    """A caption with a phrase after the word, else the two words, that the sentence has before it, if the caption has them once; first and with a
    comma where it opens the sentence so. Null where there is no such place."""
    before = F.split_part(sentence, phrase, F.lit(1))
    words = F.split(F.trim(before), r"\s+")

    def anchor(n: int) -> Column:
        return F.regexp_replace(F.array_join(F.slice(words, -n, n), " "), "[,;:]$", "")

    def after(n: int) -> Column:
        a = F.when(F.size(words) >= n, anchor(n))
        usable = (a != "") & (~F.lower(a).isin(*SMALL_WORDS) if n == 1 else F.lit(True)) & (_times(caption, _standing(a)) == 1)
        return F.when(usable, F.regexp_replace(caption, F.concat(F.lit("("), _standing(a), F.lit(")")), F.concat(F.lit("$1 "), phrase)))

    opens = (F.trim(F.regexp_replace(before, r"""^[^:.!?"“]{1,80}: """, "")) == "") & F.startswith(F.substr(sentence, F.length(before) + F.length(phrase) + 1), F.lit(","))
    low = F.when(caption.rlike(ascii_edges(r"^(?:The|It|Its|A|An|This)\b")), F.concat(F.lower(F.left(caption, F.lit(1))), F.substr(caption, F.lit(2)))).otherwise(caption)
    first = F.concat(F.upper(F.left(phrase, F.lit(1))), F.substr(phrase, F.lit(2)), F.lit(", "), low)
    return F.when(opens, first).otherwise(F.coalesce(after(1), after(2)))


def scope_restored(caption: Column, sentence: Column) -> Column:
    """A caption with the one region and the "first week" that its sentence has and it lacks.

    A sentence that names several regions, or like the caption a wider one ("worldwide"), gives none, and with numbers in the caption the
    phrase's clause must have one of them. Of a sentence whose numbers the caption has none of, nothing is put back.
    """
    own, theirs = _figures(caption), _figures(sentence)
    claim = (F.size(theirs) == 0) | F.arrays_overlap(own, theirs)

    def same_clause(phrase: Column) -> Column:
        return (F.size(own) == 0) | F.exists(F.split(sentence, SEPARATOR), lambda k: F.contains(k, phrase) & F.arrays_overlap(_figures(k), own))

    regions = F.regexp_extract_all(sentence, F.lit(ascii_edges(REGION_PHRASE)), F.lit(0))
    region = F.get(regions, F.lit(0))
    every = F.array_distinct(F.regexp_extract_all(sentence, F.lit(ascii_edges(ANY_REGION)), F.lit(0)))
    leads = F.startswith(sentence, F.concat(region, F.lit(",")))
    alone = (F.size(regions) == 1) & (F.size(every) == 1) & ~sentence.rlike(ascii_edges(WIDER_SCOPE)) & ~caption.rlike(ascii_edges(WIDER_SCOPE)) & ~caption.rlike("(?i)" + ascii_edges(ANY_REGION))
    text = F.when(claim & alone & (leads | same_clause(region)), put_back(caption, sentence, region))
    text = F.coalesce(text, caption)
    weeks = F.regexp_extract_all(sentence, F.lit(ascii_edges(FIRST_WEEK)), F.lit(0))
    week = F.get(weeks, F.lit(0))
    late = F.when(claim & (F.size(weeks) == 1) & ~text.rlike(ascii_edges(r"(?i)\bfirst week\b")) & same_clause(week), put_back(text, sentence, week))
    return F.coalesce(late, text)


def repaired(told: DataFrame, caption_id: str, caption: str, inside: bool = False) -> DataFrame:
    """(caption_id, text, dropped, reason): captions with dropped limits put back from the sentence that holds at least half of their tokens.

    told is of `told_sentences`; of equal shares the first sentence counts, and sentences below 20 characters do not. Scope comes first, then limits of
    numbers, then adverbs; quotes of the sentence limit nothing. Where no place is clear, dropped says why and the text
    is as given, and so it is where it would be too long ("too long with its limit", unless only scope was put back).
    `inside` is that of `number_limits`. What was changed is screened again against its sentence: reason is null when it passes, and for unchanged captions.
    """
    near = told.where(F.length("sentence") >= 20).groupBy(caption_id).agg(F.max(F.struct("share", (-F.col("pos")).alias("at"), "sentence", F.col(caption).alias("c"))).alias("m"))
    rows = near.where("m.share >= 0.5").select(caption_id, F.col("m.c").alias("c"), F.col("m.sentence").alias("s"))
    rows = rows.withColumn("scoped", scope_restored(F.col("c"), F.col("s"))).withColumn("scoped", F.when(F.length("scoped") <= LONGEST, F.col("scoped")).otherwise(F.col("c")))
    rows = rows.withColumn("q", F.regexp_replace("s", QUOTED, " ")).withColumn("n", number_limits(F.col("scoped"), F.col("q"), inside)).withColumn("r", scope_adverbs(F.col("n"), F.col("q")))
    dropped = F.coalesce(F.col("r.dropped"), F.when(F.length("r.text") > LONGEST, "too long with its limit"))
    rows = rows.select(caption_id, "c", "s", F.when(dropped.isNull(), F.col("r.text")).otherwise(F.col("c")).alias("text"), dropped.alias("dropped"))
    return rows.select(caption_id, "text", "dropped", F.when(F.col("text") != F.col("c"), screen_reason(F.col("text"), F.col("s"))).alias("reason"))
