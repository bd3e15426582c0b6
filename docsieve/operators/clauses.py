"""What captions join from two clauses, and what they leave out of the sentences that they retell: frames and limits.

A caption's retold sentences are those of `speakers.told_sentences` within a tenth of the best share, if that is a quarter. All that is
told of a caption is summed over them in one partial aggregate; a sentence's clauses are an array of its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions.attribution import NAME_STOPWORDS
from docsieve.functions.frames import QUOTED, REGIONS, met
from docsieve.functions.grounding import MONTHS
from docsieve.functions.text import content_tokens, share
from docsieve.operators.speakers import ATTRIBUTION

#: Patterns that the rules are specified with.
YEAR = r"\b(?:1\d{3}|20\d{2})\b"
CLAUSE_OPENER = "who|whom|whose|which|while|whereas|but|although|though|after|before"
WITH_NAMES = r"\bwith ((?:\p{Lu}[\p{L}'’-]+\s?)+)"
CAPITALISED = r"(?:^|[^\p{L}\p{N}'’])\p{Lu}[\p{L}'’-]+"
HEADING = r"""^[^:.!?"“]{2,50}:\s+"""
FRAME_WORK = "film|movie|show|series|sequel|prequel|remake|reboot|novel|musical|episode|book|play|documentary|adaptation|version|recording"
OPENS_ON_ACCOUNT = r"(?i)^According to ([^,]{2,60}),"
ENDS_ON_ACCOUNT = r"(?i),\s*according to ([^,.]{2,60})\.?$"
OPENS_ON_WORK = rf"^(?:In|On|For) ((?:the |this |that )?(?:\p{{Lu}}[\p{{L}}\d'’:-]*|\d{{4}}\b)[^,]{{0,60}}|(?:the|this|that) (?:[\p{{L}}\d'’-]+ ){{0,3}}(?:{FRAME_WORK}))(?:,|\s+\(\d{{4}}\),)"
OPENS_ON_MOMENT = r"^(?:By|At|Around|During|Since|From) (?:(?:this|that|these|those) (?:era|time|point|stage|period|years?|days)|then)\b|^At the time\b"
POINTING = r"^(?:This|That)(?: same)? (\p{Ll}+)\b"
POINTS_BACK = r"\b(?:on|in) (?:the format|(?:this|that|his|her|their) (?:chart|list|format|recording|version|tour|show|film))\b"
LATER_WORK = r"\b(?:(?:film|stage|musical|television|TV) adaptation|remake|reboot)\b"
BETWEEN_NAMES = r"\bbetween (\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)* and \p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)*)"
ANOTHERS_VERSION = r"\b(?:version|cover|rendition)s? (?:recorded |performed |sung )?by (\p{Lu}[\p{L}'’.-]+(?: \p{Lu}[\p{L}'’.-]+)*)"
DECADE = r"\b(?:1[89]|20)\d0s\b"
RANKING = (
    r"\b(?:(?:second|third|fourth|fifth)[- ])?most[- ](?:played|performed|streamed|watched|viewed|recorded|covered|broadcast)\b|\btop \d+ (?:most|best|highest)\b"
    r"|\bbest[- ]selling\b|\bhighest[- ](?:charting|selling|grossing)\b"
)
BY_NAMES = r"\bby ((?:\p{Lu}[\p{L}\d'’-]*\s*){1,4})"
CHART_RECORD = r"\b(?:charts?|charted|peak(?:ed|s)?|number(?:-| )(?:one|\d+)|No\. ?\d+|top (?:\d+|ten|forty)|Hot 100|Billboard|certifi\w+|platinum|gold|sold|sales|copies)\b"


def _spaced(text: Column, lower: bool = True) -> Column:
    """The words of a text between single blanks, so that a word or phrase in it is found with its ends."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text) if lower else text, r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def _has(spaced: Column, word: Column, lower: bool = True) -> Column:
    """Whether a word or phrase stands in spaced words; one without letters or digits never does."""
    plain = F.concat(F.lit(" "), F.trim(_spaced(word, lower)), F.lit(" "))
    return (plain != "  ") & F.contains(spaced, plain)


def _group(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def retold(told: DataFrame, caption_id: str) -> DataFrame:
    """The rows of told_sentences that a caption retells: within a tenth of its best share, none if that is below a quarter."""
    best = F.max("share").over(Window.partitionBy(caption_id))
    return told.withColumn("_best", best).where("_best >= 0.25 and share >= _best - 0.1").drop("_best")


def merged_clauses(told: DataFrame, caption_id: str, caption: str) -> DataFrame:
    """(caption_id, anchor): captions that join a year or a "with" name on from another clause of the one sentence that they retell.

    A caption's clause has at least half of its other words and a fifth more of them than any other clause. The anchor is the first year, else the
    first name after "with", that another clause has and this one lacks; a name of an earlier clause is usually the
    later one's doer and is let pass. Captions that retell several sentences, or a sentence of one clause, have no row.
    """
    one = retold(told, caption_id).groupBy(caption_id).agg(F.count("*").alias("n"), F.first(caption).alias("c"), F.first("sentence").alias("s")).where("n = 1")
    clauses = F.filter(F.transform(F.split("s", rf",\s+(?=(?:{CLAUSE_OPENER})\b)|;\s+"), lambda k: F.trim(k)), lambda k: k != "")
    years = F.regexp_extract_all("c", F.lit(YEAR), F.lit(0))
    names = F.flatten(F.transform(F.regexp_extract_all("c", F.lit(WITH_NAMES), F.lit(1)), lambda n: F.split(F.trim(n), r"\s+")))
    rest = content_tokens(F.regexp_replace(F.regexp_replace("c", YEAR, " "), CAPITALISED, " "))
    rows = one.select(caption_id, "s", clauses.alias("k"), years.alias("years"), names.alias("names"), rest.alias("rest")).where(F.size("k") >= 2)
    shares = F.transform("k", lambda k: share(F.col("rest"), content_tokens(k)))
    rows = rows.select(caption_id, "years", F.concat("years", F.filter("names", lambda n: _has(_spaced(F.col("s")), n))).alias("anchors"), F.transform("k", lambda k: _spaced(k)).alias("k"), shares.alias("shares"))
    order = F.sort_array("shares", False)
    main = F.array_position("shares", F.array_max("shares"))
    rows = rows.where((F.size("anchors") > 0) & (F.get(order, F.lit(0)) >= 0.5) & (F.get(order, F.lit(0)) - F.get(order, F.lit(1)) >= 0.2)).withColumn("main", main)

    def elsewhere(a: Column) -> Column:
        at = F.array_position(F.transform("k", lambda k: _has(k, a)), True)
        return ~_has(F.element_at("k", F.col("main").cast("int")), a) & (at > 0) & (F.array_contains("years", a) | (at > F.col("main")))

    return rows.select(caption_id, F.get(F.filter("anchors", elsewhere), F.lit(0)).alias("anchor")).where("anchor is not null")


def dropped_frames(told: DataFrame, caption_id: str, caption: str, titles: str | None = None) -> DataFrame:
    """(caption_id, frame): the account, work or moment on which every sentence that a caption retells opens (an account may end one), gone from it.

    titles names an array column of told with titles that need no naming. The first sentence's frame is returned; accounts come before
    works, "this" things and moments. A caption that cites someone keeps an account, one that has a word of the frame's
    names or its kind of work keeps a work, and one with a year keeps a moment. Regions, months and years alone are no works.
    """
    s = F.regexp_replace("sentence", HEADING, "")
    rows = retold(told, caption_id).select(
        caption_id, "pos", F.col(caption).alias("c"), (F.col(titles) if titles else F.array().cast("array<string>")).alias("titles"),
        F.coalesce(_group(s, OPENS_ON_ACCOUNT, 1), _group(s, ENDS_ON_ACCOUNT, 1)).alias("account"), _group(s, OPENS_ON_WORK, 1).alias("work"), _group(s, POINTING).alias("pointed"), _group(s, OPENS_ON_MOMENT).alias("moment"),
    )
    kinds = ("account", "work", "pointed", "moment")
    every = [F.when(F.count(k) == F.count("*"), F.min_by(k, "pos")).alias(k) for k in kinds]
    rows = rows.groupBy(caption_id).agg(F.first("c").alias("c"), F.first("titles").alias("titles"), *every)
    c, work = F.col("c"), F.col("work")
    said, kind = _spaced(c), met(work, rf"\b(?:{FRAME_WORK})\b")
    names = F.filter(F.regexp_extract_all(work, F.lit(r"\p{Lu}[\p{L}\d'’-]+"), F.lit(0)), lambda w: ~F.lower(w).isin(*NAME_STOPWORDS))
    place = work.rlike(r"(?i)^(?:the )?(?:" + "|".join(REGIONS) + r")\b") | work.rlike("^(?:the )?(?:" + "|".join(m.capitalize() for m in MONTHS) + r")\b") | work.rlike(r"^\d{4}$")
    known = F.exists(F.coalesce("titles", F.array().cast("array<string>")), lambda t: F.coalesce(_has(_spaced(work), t), F.lit(False)))
    named = F.exists(names, lambda w: _has(said, w)) | F.coalesce(_has(said, kind), F.lit(False)) | known
    is_work = kind.isNotNull() | (F.size(names) >= 2)
    the = F.concat(F.lit("^The "), F.regexp_extract("pointed", POINTING, 1), F.lit(r"\b"))
    frame = F.coalesce(
        F.when(~c.rlike(ATTRIBUTION), F.concat(F.lit("according to "), "account")),
        F.when(is_work & ~place & ~named, work),
        F.when(F.regexp_like(c, the), F.col("pointed")),
        F.when(~c.rlike(YEAR), F.col("moment")),
    )
    return rows.select(caption_id, frame.alias("frame")).where("frame is not null")


def dropped_limits(told: DataFrame, caption_id: str, caption: str, artists: str | None = None) -> DataFrame:
    """(caption_id, limit): what narrows every sentence that a caption retells, quotes apart, and is gone from it, so that it claims more.

    In this order: a pointer back ("on the format"), a pair of names, another's version (not of the artists, an array column of told),
    a later work, a ranking's decade or its maker, "respectively" of charts. It is gone when the caption has none of its words of more
    than three letters written in lower case: that is the rule, so a name in capitals never brings a limit back.
    """
    u = F.regexp_replace("sentence", QUOTED, "")
    found = {
        "pointer": met(u, POINTS_BACK), "pairing": _group(u, BETWEEN_NAMES), "version": _group(u, ANOTHERS_VERSION), "later": met(u, LATER_WORK),
        "ranked": met(u, RANKING), "each": F.when(u.rlike(r"(?i)\brespectively\b") & u.rlike("(?i)" + CHART_RECORD), "respectively"),
    }
    rows = retold(told, caption_id).select(caption_id, "pos", F.col(caption).alias("c"), (F.col(artists) if artists else F.array().cast("array<string>")).alias("artists"), u.alias("u"), *[v.alias(k) for k, v in found.items()])
    every = [F.when(F.count(k) == F.count("*"), F.min_by(k, "pos")).alias(k) for k in found]
    rows = rows.groupBy(caption_id).agg(F.first("c").alias("c"), F.first("artists").alias("artists"), F.min_by("u", "pos").alias("u"), *every)
    c = F.col("c")
    said = _spaced(c, lower=False)

    def lacks(phrase: Column) -> Column:
        return ~F.exists(F.split(F.lower(phrase), r"\s+"), lambda w: (F.length(w) > 3) & _has(said, w, lower=False))

    by = F.regexp_extract("version", ANOTHERS_VERSION, 1)
    own = F.exists(F.coalesce("artists", F.array().cast("array<string>")), lambda a: F.coalesce(_has(_spaced(by), a), F.lit(False)))
    decade, maker = _group(F.col("u"), DECADE), _group(F.col("u"), BY_NAMES, 1)
    ranking = F.when(c.rlike("(?i)" + RANKING) & F.col("ranked").isNotNull(), F.coalesce(F.when(~_has(said, decade, lower=False), decade), F.when(lacks(maker), F.trim(_group(F.col("u"), BY_NAMES)))))
    limit = F.coalesce(
        F.when(lacks(F.regexp_replace("pointer", r"^\S+ \S+ ", "")), F.col("pointer")),
        F.when(lacks(F.regexp_extract("pairing", BETWEEN_NAMES, 1)), F.col("pairing")),
        F.when(lacks(by) & ~own, F.col("version")),
        F.when(lacks(F.col("later")), F.col("later")),
        ranking,
        F.when(c.rlike(r"\p{Lu}\S* and \p{Lu}") & ~c.rlike(r"(?i)\brespectively\b"), F.col("each")),
    )
    return rows.select(caption_id, limit.alias("limit")).where("limit is not null")
