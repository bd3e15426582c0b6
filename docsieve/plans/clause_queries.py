"""Registered queries on clauses, frames and limits that captions merge or leave out, over whole documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import attribution as A
from docsieve.functions import frames as R
from docsieve.functions.grounding import MONTHS
from docsieve.operators import clauses as C
from docsieve.operators import speakers as P
from docsieve.plans.queries import TOKENS, query, table
from docsieve.plans.wording_queries import cases, told

_PAIR, _PAIR_ONCE = r"([^.,\n]+), ([^.,\n]+)[.,]", r"(?<![^.,\n])([^.,\n]++), ([^.,\n]++)[.,]"
_HAS = r"contains(' ' || regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' ', ' ' || trim(regexp_replace(lower({1}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ')"


def _java(sql: str) -> str:
    """SQL for Spark, whose string literals unescape a backslash; halves of sentences are sought from where one starts only, which finds the same."""
    return sql.replace(_PAIR, _PAIR_ONCE).replace("\\", "\\\\")


def _retold(texts: str, caption: str) -> str:
    """SQL: k has the sentences s (at i) that the caption c of each document retells."""
    return rf"""d as (select doc_id, {texts} t, {caption} c from documents),
l as (select doc_id, c, unnest(k) s, unnest(range(len(k))) i from (select *, list_filter(list_transform(flatten(list_transform(string_split(t, chr(10)), lambda x: string_split(regexp_replace(x, '([.!?]["”]?)\s+(["“]?\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), chr(1)))), lambda x: trim(x)), lambda x: x <> '') k from d where c is not null)),
h as (select *, case when len(ct) > 0 then len(list_filter(ct, lambda x: list_contains(st, x))) / len(ct) else 0.0 end share from (select *, {TOKENS.format("c")} ct, {TOKENS.format("s")} st from l)),
k as (select doc_id, c, s, i from (select *, max(share) over (partition by doc_id) best from h) where best >= 0.25 and share >= best - 0.1)"""


def _told(spark: SparkSession, sf_dir: str, texts: str, caption: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_java(texts)).alias("t"), F.expr(_java(caption)).alias("c"))
    return P.told_sentences(docs.select("doc_id", "c"), docs.select("doc_id", "t"), "doc_id", "doc_id", "c", "t")


# Commas become clauses of who did it with years and names; captions tell the first half of a sentence, or the second, with one of them.
_JOINED = "replace(coalesce(text, ''), ', ', ' in 1976 by Ada, who met Otto and ')"
_HALF = f"regexp_extract(coalesce(text, ''), '{_PAIR}', {{}})"
_MERGED = cases("doc_id", f"{_HALF.format(2)} || ' in 1976'", f"{_HALF.format(1)} || ' with Otto'", f"{_HALF.format(1)} || ' in 1976'", f"{_HALF.format(2)} || ' with Ada'", f"{_HALF.format(2)} || ' with Otto in 1976 again'")


@query(rf"""
with {_retold(_JOINED, _MERGED)},
o as (select doc_id, c, s, list_filter(list_transform(string_split(regexp_replace(s, ',\s+(({C.CLAUSE_OPENER})\b)|;\s+', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') k from (select doc_id, any_value(c) c, any_value(s) s from k group by doc_id having count(*) = 1)),
a as (select doc_id, k, regexp_extract_all(c, '{C.YEAR}') y, list_filter(flatten(list_transform(regexp_extract_all(c, '{C.WITH_NAMES.replace("'", "''")}', 1), lambda n: regexp_split_to_array(trim(n), '\s+'))), lambda n: {_HAS.format("s", "n")}) n,
 {TOKENS.format(f"regexp_replace(regexp_replace(c, '{C.YEAR}', ' ', 'g'), '{C.CAPITALISED.replace(chr(39), chr(39) * 2)}', ' ', 'g')")} rest from o where len(k) > 1),
p as (select doc_id, k, y, list_concat(y, n) an, list_transform(k, lambda x: case when len(rest) > 0 then len(list_filter(rest, lambda r: list_contains({TOKENS.format("x")}, r))) / len(rest) else 0.0 end) sh from a),
m as (select *, list_position(sh, list_max(sh)) m from p where list_max(sh) >= 0.5 and list_max(sh) - list_sort(sh, 'DESC')[2] >= 0.2),
r as (select doc_id, list_filter(an, lambda x: not {_HAS.format("k[m]", "x")} and len(list_filter(range(1, len(k) + 1), lambda j: {_HAS.format("k[j]", "x")})) > 0 and (list_contains(y, x) or list_filter(range(1, len(k) + 1), lambda j: {_HAS.format("k[j]", "x")})[1] > m))[1] anchor from m)
select doc_id, anchor from r where anchor is not null""")
def merged_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years and names that captions of documents join on from another clause."""
    return C.merged_clauses(_told(spark, sf_dir, _JOINED, _MERGED), "doc_id", "c")


# Sentences open on an account, a work, a pointing word, a moment or a place; captions tell the second sentence of a document.
_OPENED = "replace(coalesce(text, ''), '. ', " + cases("doc_id", "'. According to Dana Reyes, '", "'. In the 2019 film adaptation, '", "'. By this era '", "'. This pattern '", "'. In Night Harbor Returns, '", "'. In North America, '", "'. Later work: At the time '") + ")"
_SECOND = r"nullif(regexp_extract(coalesce(text, ''), '[.] ([^.\n]+)', 1), '')"
_UNFRAMED = cases("doc_id", f"'The pattern ' || {_SECOND}", _SECOND, f"{_SECOND} || ' in 1980'", f"'According to some, ' || {_SECOND}", f"{_SECOND} || ' of the film at Night'")
_WORK = C.OPENS_ON_WORK.replace("'", "''")


@query(rf"""
with {_retold(_OPENED, _UNFRAMED)},
f as (select doc_id, c, i, coalesce(nullif(regexp_extract(s, '{C.OPENS_ON_ACCOUNT}', 1), ''), nullif(regexp_extract(s, '{C.ENDS_ON_ACCOUNT}', 1), '')) a, nullif(regexp_extract(s, '{_WORK}', 1), '') w, nullif(regexp_extract(s, '{C.POINTING}'), '') p, nullif(regexp_extract(s, '{C.OPENS_ON_MOMENT}'), '') m
 from (select doc_id, c, i, regexp_replace(s, '{C.HEADING}', '') s from k)),
g as (select doc_id, any_value(c) c, case when count(a) = count(*) then arg_min(a, i) end a, case when count(w) = count(*) then arg_min(w, i) end w, case when count(p) = count(*) then arg_min(p, i) end p, case when count(m) = count(*) then arg_min(m, i) end m from f group by doc_id),
n as (select *, nullif(regexp_extract(w, '(?i)\b(?:{C.FRAME_WORK})\b'), '') kind, list_filter(regexp_extract_all(w, '\p{{Lu}}[\p{{L}}\d''’-]+'), lambda x: lower(x) not in {A.NAME_STOPWORDS}) ns from g),
r as (select doc_id, coalesce(case when a is not null and not {told(C.ATTRIBUTION[4:], "c")} then 'according to ' || a end,
 case when w is not null and (kind is not null or len(ns) > 1) and not regexp_matches(w, '(?i)^(?:the )?(?:{"|".join(R.REGIONS)})\b') and not regexp_matches(w, '^(?:the )?(?:{"|".join(m.capitalize() for m in MONTHS)})\b') and not regexp_matches(w, '^\d{{4}}$')
  and len(list_filter(ns, lambda x: {_HAS.format("c", "x")})) = 0 and not coalesce({_HAS.format("c", "kind")}, false) then w end,
 case when regexp_matches(c, '^The ' || regexp_extract(p, '{C.POINTING}', 1) || '\b') then p end, case when not regexp_matches(c, '{C.YEAR}') then m end) frame from n)
select doc_id, frame from r where frame is not null""")
def dropped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts, works and moments that captions of documents leave out."""
    return C.dropped_frames(_told(spark, sf_dir, _OPENED, _UNFRAMED), "doc_id", "c")


# Sentences end on a limit; captions tell the second sentence, some with a word of the limit or a ranking.
_LIMITED = "replace(coalesce(text, ''), '. ', " + cases(
    "doc_id", "' on the format. '", "' between Ana Bell and Rui Costa. '", "' in a version recorded by Ana Bell. '", "' in the stage adaptation. '", "' as the most played waltz of the 1990s by Ada Pell. '", "' gold and platinum respectively. '", "' \"on the format\". '", "' as a best-selling waltz by Ada Pell. '",
) + ")"
_CLAIM = cases("doc_id", _SECOND, f"{_SECOND} || ' as the most played and best-selling'", f"{_SECOND} || ' by Ana and Rui'", f"{_SECOND} || ' in format and stage'", f"{_SECOND} || ' with bell respectively'")
_PLAIN = "(' ' || regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ')"


def _lacks(phrase: str) -> str:
    return f"len(list_filter(regexp_split_to_array(lower({phrase}), '\\s+'), lambda x: length(x) > 3 and trim({_PLAIN.format('x')}) <> '' and contains({_PLAIN.format('c')}, ' ' || trim({_PLAIN.format('x')}) || ' '))) = 0"


@query(rf"""
with {_retold(_LIMITED, _CLAIM)},
u as (select doc_id, c, i, regexp_replace(s, '["“][^"”]*["”]', '', 'g') u from k),
f as (select *, nullif(regexp_extract(u, '(?i){C.POINTS_BACK}'), '') p, nullif(regexp_extract(u, '{C.BETWEEN_NAMES.replace("'", "''")}'), '') b, nullif(regexp_extract(u, '{C.ANOTHERS_VERSION.replace("'", "''")}'), '') v, nullif(regexp_extract(u, '(?i){C.LATER_WORK}'), '') l,
 nullif(regexp_extract(u, '(?i){C.RANKING}'), '') r, case when {told(r"\brespectively\b", "u")} and {told(C.CHART_RECORD, "u")} then 'respectively' end e from u),
g as (select doc_id, any_value(c) c, arg_min(u, i) u, {", ".join(f"case when count({x}) = count(*) then arg_min({x}, i) end {x}" for x in "pbvlre")} from f group by doc_id),
n as (select *, nullif(regexp_extract(u, '{C.DECADE}'), '') dec, nullif(regexp_extract(u, '{C.BY_NAMES.replace("'", "''")}', 1), '') mk, trim(regexp_extract(u, '{C.BY_NAMES.replace("'", "''")}')) mkw from g),
z as (select doc_id, coalesce(case when p is not null and {_lacks(r"regexp_replace(p, '^\S+ \S+ ', '')")} then p end, case when b is not null and {_lacks("substr(b, 9)")} then b end, case when v is not null and {_lacks(f"regexp_extract(v, '{C.ANOTHERS_VERSION.replace(chr(39), chr(39) * 2)}', 1)")} then v end,
 case when l is not null and {_lacks("l")} then l end, case when r is not null and {told(C.RANKING, "c")} then coalesce(case when dec is not null and not contains({_PLAIN.format("c")}, ' ' || dec || ' ') then dec end, case when mk is not null and {_lacks("mk")} then mkw end) end,
 case when regexp_matches(c, '\p{{Lu}}\S* and \p{{Lu}}') and not {told(r"\brespectively\b", "c")} then e end) "limit" from n)
select doc_id, "limit" from z where "limit" is not null""")
def dropped_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits without which captions of documents claim more than their sentences."""
    return C.dropped_limits(_told(spark, sf_dir, _LIMITED, _CLAIM), "doc_id", "c")
