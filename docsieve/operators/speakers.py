"""Whose words and deeds a caption tells, held against the sentences of its source in order.

Every caption meets the sentences of its own source, as for their shares of tokens. What a sentence says of a speaker may
stand in one of the two before it, and a quote may run on: both are lags over a caption's sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions.attribution import NAME_STOPWORDS
from docsieve.functions.text import content_tokens, every_word, full_sentences, share

#: How a caption gives someone's words, how sources give words and views, and what opens a sentence before its doer.
NAME = r"(?:Mc)?\p{Lu}[\p{L}'’.-]*"
SAID_BY = rf"({NAME}(?:\s+{NAME}){{0,3}})\s+(?:also\s+|later\s+|once\s+)?(?:described|said|says|stated|recalled|explained|claimed|admitted|noted|commented|remarked|revealed|insisted|joked|praised|likened|characteri[sz]ed|acknowledged|recounted)\b"
ATTRIBUTION = (
    r"(?i)\b(?:said|says|say|stat(?:ed|es|ing)|recall\w*|explain\w*|claim\w*|admit\w*|told|tell\w*|not(?:ed|es|ing)|comment\w*|remark\w*|reveal\w*|confirm\w*|insist\w*|jok\w*|describ\w*|call(?:ed|s|ing)|prais\w*|liken\w*|characteri[sz]\w*"
    r"|acknowledg\w*|recount\w*|defin\w*|summari[sz]\w*|wr(?:ote|ites?|iting) that|interview\w*|according|quot\w*|felt|feel\w*|believ\w*|consider\w*|deem\w*|refer\w*|compar\w*|express\w*|reflect\w*|label\w*|dubb\w*|thought|argu\w*|observ\w*"
    r"|asked|answer\w*|speak\w*|spoke|mention\w*|announc\w*|cit(?:ed|es|ing)|credit\w*|views?|opinion|marked by)\b|:\s*[\"“]"
)
PRONOUN_SAYS = (
    r"(?i)\b(?:he|she|they)\s+(?:has\s+|have\s+|had\s+|also\s+|later\s+|once\s+)*(?:said|says|stated|recalled|explained|claimed|admitted|told|noted|commented|remarked|revealed|confirmed|insisted|joked|described|called|praised|acknowledged"
    r"|recounted|felt|believed|considered|wrote)\b"
)
BY_THE_MAKER = r"(?i)\b(?:by|to) the (?:composer|songwriter|singer|artist|author|band)\b"
TITLE_WORD = r"^(?:\p{Lu}|\d)|^(?:a|an|the|of|in|on|to|and|for|at|by|or)$"
LEAD_NAME = rf"^({NAME}(?:\s+{NAME}){{0,3}})(?=\s+\p{{Ll}})"
TIME_AND_PLACE = r"(?i)^(?:(?:In|On|By|During|After|Before|Later|From|At|When|While)\b[^,]{0,80},\s*)+"
SUBJECT = rf"^({NAME}(?:\s+{NAME}){{0,3}})(?=\s*,|\s+\p{{Ll}})"
QUOTE = r"""["“][^"”]*["”]"""


def name_words(name: Column) -> Column:
    """Words of a name without 's and words that are no names."""
    words = F.transform(F.split(name, r"\s+"), lambda w: F.regexp_replace(w, "['’]s?$", ""))
    return F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(*NAME_STOPWORDS))


def _stands(text: Column, word: Column) -> Column:
    """Whether a word stands in a text as a whole, in its own case or another."""
    plain = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return F.contains(plain(text), plain(word)) & (F.trim(plain(word)) != "")


def _names(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: _stands(text, w))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[“”]", '"'), "[‘’]", "'")


def told_sentences(captions: DataFrame, sources: DataFrame, key: str, caption_id: str, caption: str, text: str) -> DataFrame:
    """(caption_id, caption, pos, sentence, share): each caption with the sentences of its source and their shares of its tokens.

    A caption's tokens are taken once, before it meets the sentences; what is among them needs no choice among a sentence's words.
    """
    rows = sources.select(key, F.posexplode(full_sentences(F.col(text))).alias("pos", "sentence"))
    held = captions.where(F.col(caption).isNotNull()).select(key, caption_id, caption, content_tokens(F.col(caption)).alias("_ct"))
    return held.join(rows, key).select(caption_id, caption, "pos", "sentence", share(F.col("_ct"), every_word(F.col("sentence"))).alias("share"))


def misattributed_words(told: DataFrame, caption_id: str, caption: str) -> DataFrame:
    """(caption_id, name): captions that give someone words or a view which their source does not give them.

    told is of told_sentences. A sentence gives words to someone whom it names outside of quotes, whom one of the two sentences before
    names where it says he, she or they, or whom the first sentence names where it says by whom in general; a quote without
    a speaker of its own runs on from the sentence before. A name is wrong if no sentence gives it words, if none that has
    a quote of the caption does (titles apart), or none that the caption draws on (within a tenth of the best share, or 30 %).
    Captions that give nobody's words, and those without source, have no row.
    """
    names = name_words(F.regexp_extract(caption, SAID_BY, 1))
    rows = told.withColumn("_names", names).where(F.size("_names") > 0)
    order = Window.partitionBy(caption_id).orderBy("pos")
    bare = F.regexp_replace("sentence", QUOTE, "")
    rows = rows.withColumn("_m", _names(bare, F.col("_names")))
    before = F.coalesce(F.lag("_m", 1).over(order), F.lit(False)) | F.coalesce(F.lag("_m", 2).over(order), F.lit(False))
    first = F.first("_m").over(order.rowsBetween(Window.unboundedPreceding, 0))
    s = F.col("sentence")
    rows = rows.withColumn("_gives", s.rlike(ATTRIBUTION) & (F.col("_m") | (s.rlike(PRONOUN_SAYS) & before) | (s.rlike(BY_THE_MAKER) & first)))
    rows = rows.withColumn("_near", F.col("_gives") | (F.coalesce(F.lag("_gives").over(order), F.lit(False)) & ~bare.rlike(ATTRIBUTION)))
    quotes = F.transform(F.regexp_extract_all(F.regexp_replace(caption, "[“”]", '"'), F.lit('"([^"]+)"'), F.lit(1)), lambda q: F.trim(F.regexp_replace(q, r"[.,!?;:]+$", "")))
    spoken = F.filter(quotes, lambda q: (q != "") & ~F.forall(F.split(q, r"\s+"), lambda w: w.rlike(TITLE_WORD)))
    rows = rows.withColumn("_quotes", F.array_distinct(F.transform(spoken, lambda q: _plain(q))))
    found = F.filter("_quotes", lambda q: F.contains(_plain(F.col("sentence")), q))
    best = F.max("share").over(Window.partitionBy(caption_id))
    rows = rows.select(caption_id, "_names", "_quotes", "share", best.alias("_best"), "_gives", "_near", F.when(F.col("_near"), found).otherwise(F.array().cast("array<string>")).alias("_found"))
    drawn = ((F.col("share") >= F.col("_best") - 0.1) | (F.col("share") >= 0.3)) & F.col("_near")
    summed = rows.groupBy(caption_id).agg(
        F.first("_names").alias("n"), F.first("_quotes").alias("q"), F.max("_best").alias("best"), F.bool_or("_gives").alias("gives"), F.bool_or(drawn).alias("drawn"), F.array_distinct(F.flatten(F.collect_set("_found"))).alias("found")
    )
    wrong = ~F.col("gives") | (F.size(F.array_except("q", "found")) > 0) | ((F.col("best") >= 0.25) & ~F.col("drawn"))
    return summed.where(wrong).select(caption_id, F.element_at("n", -1).alias("name"))


def other_doers(told: DataFrame, caption_id: str, caption: str) -> DataFrame:
    """(caption_id, doer): who did it in all sentences that a caption retells, where it opens on a full name that none of them has.

    told is of told_sentences; retold are the sentences within a tenth of the best share, if that is a quarter. A sentence's
    doer opens it, after times and places; one that the caption names too is no one else. The first sentence's is returned.
    """
    lead = F.regexp_extract(caption, LEAD_NAME, 1)
    words = name_words(lead)
    opens = F.lower(F.get(F.split(lead, r"\s+"), F.lit(0)))
    rows = told.withColumn("_best", F.max("share").over(Window.partitionBy(caption_id))).where("_best >= 0.25 and share >= _best - 0.1")
    rows = rows.where((lead != "") & ~lead.rlike("['’]s?$") & (F.size(words) >= 2) & ~opens.isin(*NAME_STOPWORDS)).withColumn("_words", words)
    subject = F.regexp_extract(F.regexp_replace("sentence", TIME_AND_PLACE, ""), SUBJECT, 1)
    who = F.filter(F.split(subject, r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(*NAME_STOPWORDS))
    verb = (F.size(who) == 1) & F.get(who, F.lit(0)).rlike("(?:ed|ing|ly)$")
    known = ~verb & (F.size(who) > 0) & ~subject.rlike("['’]s?$") & ~F.lower(F.get(F.split(subject, r"\s+"), F.lit(0))).isin(*NAME_STOPWORDS) & ~F.exists(who, lambda w: _stands(F.col(caption), w))
    rows = rows.select(caption_id, "pos", _names(F.col("sentence"), F.col("_words")).alias("_named"), F.when(known, F.array_join(who, " ")).alias("_doer"))
    summed = rows.groupBy(caption_id).agg(F.bool_or("_named").alias("named"), F.count_if(F.col("_doer").isNull()).alias("unknown"), F.min_by("_doer", "pos").alias("doer"))
    return summed.where("not named and unknown = 0").select(caption_id, "doer")
