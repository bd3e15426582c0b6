"""Checks of a caption, alone and against its source, in a fixed order of reasons; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.functions.frames import doubts, is_sure
from docsieve.functions.text import words_of

#: Pronouns that need someone named before them, and filler of requests (fixed values).
PRONOUNS = ("he", "her", "his", "it", "its", "she", "their", "these", "they", "this")
FILLER = tuple(
    (
        "is was are were be been are a an the this that it its one here now so just "
        "song songs track tracks single tune piece music musical instrumental theme composition compositions original originals cover "
        "by from of in on for and with to as "
        "written wrote writes composed composer performed performer recorded sung sings sang released credited "
        "artist band group singer songwriter duo trio musician rapper "
        "video game games soundtrack ost score album "
        "you youre re hearing listening playing straight person who "
        "english british american canadian australian irish scottish welsh japanese korean swedish french german "
        "rock pop hip hop rap country folk indie jazz electronic dance metal punk alternative soul r b"
    ).split()
)
LONGEST = 160


def array(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in values])


def not_for_stream(text: Column) -> Column:
    """link, command or mention."""
    return F.when(text.rlike(r"(?i)https?://|www\."), "link").when(text.rlike(r"(^|\s)![a-z]"), "command").when(text.rlike(r"(^|\s)@\w"), "mention")


def unresolved_pronoun(text: Column) -> Column:
    return F.array_contains(array(PRONOUNS), F.get(words_of(text), F.lit(0)))


def quotes_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))


def altered_quote(caption: Column, source: Column) -> Column:
    """A quote of three words or more that the source lacks, or of more than twelve."""
    size = lambda q: F.size(words_of(q))
    return F.exists(quotes_of(caption), lambda q: (size(q) > 12) | ((size(q) >= 3) & ~F.contains(F.lower(source), F.lower(q))))


def numbers_of(text: Column) -> Column:
    return F.filter(words_of(text), lambda w: w.rlike("^[0-9]+$"))


def missing_number(caption: Column, words: Column) -> Column:
    """A number that the words of the source lack."""
    return F.size(F.array_except(numbers_of(caption), words)) > 0


def missing_name(caption: Column, words: Column) -> Column:
    """A capitalised word, the first apart, that the words of the source have in no form."""
    names = F.transform(F.regexp_extract_all(caption, F.lit(r"[^.!?\s]\s+(\p{Lu}\p{L}+)"), F.lit(1)), lambda n: F.lower(n))
    return F.size(F.array_except(names, words)) > 0


def restates(caption: Column, request: Column) -> Column:
    """No word, apostrophes apart, beyond those of the request and filler."""
    words = lambda c: words_of(F.regexp_replace(c, "['’]", ""))
    return F.size(F.array_except(words(caption), F.concat(words(request), array(FILLER)))) == 0


def caption_reason(text: Column) -> Column:
    """The first reason that needs no source."""
    return F.coalesce(F.when(F.size(words_of(text)) == 0, "empty"), not_for_stream(text), F.when(unresolved_pronoun(text), "pronoun"))


def known(source: Column) -> Column:
    """(words, doubts): what the checks need of a source; where many captions share one, it is found once."""
    return F.struct(words_of(source).alias("words"), doubts(source).alias("doubts"))


def source_reason(caption: Column, source: Column, facts: Column | None = None) -> Column:
    """The first reason against the source; none where the source is empty. facts: `known` of it, if at hand."""
    held = known(source) if facts is None else facts
    checks = (("quote", altered_quote(caption, source)), ("number", missing_number(caption, held["words"])), ("name", missing_name(caption, held["words"])), ("hedge", held["doubts"] & is_sure(caption)))
    return F.when(F.coalesce(source, F.lit("")) != "", F.coalesce(*[F.when(check, label) for label, check in checks]))


def screen_reason(caption: Column, source: Column, facts: Column | None = None) -> Column:
    """Reasons in their order: the caption's own, those against the source, then its length."""
    return F.coalesce(caption_reason(caption), source_reason(caption, source, facts), F.when(F.length(caption) > LONGEST, "long"))


#: Word lists of the wider checks (fixed values).
MONTHS = ("january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december")
CONNECTIVES = ("because", "therefore", "thus", "although", "despite", "before", "after", "instead")
EXCEPTIONS = ("except", "unless", "excluding", "apart")
RELATIONS = ("brother", "daughter", "father", "husband", "mother", "sister", "son", "wife")
LIMITS = ("only", "almost", "nearly", "partly", "mainly", "sometimes", "initially", "originally")
ROLES = ("composed", "directed", "performed", "produced", "published", "recorded", "wrote")
AWARDS = ("awarded", "nominated", "won", "prize", "award")


def introduced(caption: Column, source: Column, words: tuple[str, ...]) -> Column:
    """Whether the caption has a word of the list that the source lacks."""
    return F.size(F.array_except(F.array_intersect(words_of(caption), array(words)), words_of(source))) > 0


def lost(caption: Column, sentence: Column, words: tuple[str, ...]) -> Column:
    """Whether the sentence has a word of the list and the caption has none."""
    return F.arrays_overlap(words_of(sentence), array(words)) & ~F.arrays_overlap(words_of(caption), array(words))


def years_of(text: Column) -> Column:
    return F.filter(words_of(text), lambda w: w.rlike("^[12][0-9]{3}$"))


def misplaced_year(caption: Column, retold: Column, source: Column) -> Column:
    """A year of the caption that the source has, but not in any of the retold sentences (an array)."""
    near = F.flatten(F.transform(retold, lambda s: years_of(s)))
    return F.size(F.array_except(F.array_intersect(years_of(caption), years_of(source)), near)) > 0


def dropped_year(caption: Column, sentence: Column) -> Column:
    """A month of the sentence kept while its year is gone."""
    both = F.array_intersect(F.array_intersect(words_of(caption), words_of(sentence)), array(MONTHS))
    return (F.size(both) > 0) & (F.size(years_of(sentence)) > 0) & (F.size(years_of(caption)) == 0)


def turned_round(caption: Column, sentence: Column) -> Column:
    """"a by b" where the sentence has "b by a"."""
    pair = lambda t: (F.regexp_extract(F.lower(t), r"(\w+) by (\w+)", 1), F.regexp_extract(F.lower(t), r"(\w+) by (\w+)", 2))
    (a, b), (c, d) = pair(caption), pair(sentence)
    return (a != "") & (a == d) & (b == c) & (a != b)


def wider_reason(caption: Column, source: Column, retold: Column) -> Column:
    """The first reason of the wider checks; retold is the array of sentences that the caption retells."""
    best = F.coalesce(F.get(retold, F.lit(0)), F.lit(""))
    checks = (
        ("turned", turned_round(caption, best)),
        ("month", introduced(caption, source, MONTHS)),
        ("year", misplaced_year(caption, retold, source)),
        ("dropped-year", dropped_year(caption, best)),
        ("connective", introduced(caption, source, CONNECTIVES)),
        ("exception", introduced(caption, source, EXCEPTIONS)),
        ("relation", introduced(caption, source, RELATIONS)),
        ("role", introduced(caption, source, ROLES)),
        ("award", introduced(caption, source, AWARDS)),
        ("limit", lost(caption, best, LIMITS)),
    )
    return F.coalesce(*[F.when(check, label) for label, check in checks])
