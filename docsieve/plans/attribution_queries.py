"""Registered queries on who said, did or owns what captions tell, boxes of facts and reports of errors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import attribution as A
from docsieve.operators import clicks as K
from docsieve.operators import speakers as P
from docsieve.plans.queries import TOKENS, WORDS, query, table
from docsieve.plans.wording_queries import cases, told

CAPTION = cases(
    "p_size", "'The band wrote ' || p_name", "'It is a compromise of ' || p_name", "'It led the Night chart within three weeks of ' || p_name", "'The song of ' || p_name || ' sold 2 million copies'", "'It was shot in a desert with ' || p_name", "'The album sold 1,000 copies for ' || p_name",
    "'Reyes called it a compromise'",
)
FIRST = cases(
    "p_partkey", "'The company wrote ' || p_name || ' again'", "'Reyes described ' || p_name || ' as a compromise'", "'It led the Night chart, and within three weeks the Soul chart had ' || p_name", "'The album with ' || p_name || ' sold 2 million copies'", "'The music video of ' || p_name || ' was shot in a desert'",
    "'The single sold 1,000 copies with ' || p_name",
)
SECOND = cases("p_size % 5", "'Then came the duo'", "'The official video shows ' || p_name")


@query(rf"""
with a as (select p_partkey, {CAPTION} c, {FIRST} r, {SECOND} s from part),
b as (select *, lower(regexp_extract(c, '(?i){A.AGENT}', 1)) ca, lower(regexp_extract(r, '(?i){A.AGENT}', 1)) ra, regexp_extract(r, '{A.VIEW.replace("'", "''")}', 1) who, {TOKENS.format("c")} ct, {TOKENS.format("r")} rt, {TOKENS.format("s")} st, regexp_extract(c, '{A.FIGURE}') fig,
 instr(c, 'The song') > 0 song, instr(c, 'The album') > 0 album from a)
select p_partkey, case when ca <> '' and ra <> '' and ra <> ca and not regexp_matches(r, '(?i)\b' || ca || '\b') and not regexp_matches(s, '(?i)\b' || ca || '\b') then 'the ' || ca end agent,
 case when who <> '' and not {told(A.VIEW_TOLD, "c")} and not contains(c, who) and len(list_filter(ct, lambda t: list_contains(rt, t) and not list_contains(st, t))) > 0 then who end viewer,
 case when contains(c, 'Night chart within three weeks') and regexp_matches(r, 'Night chart, and within three weeks') then 'within three weeks' end span,
 case when {told(A.VIDEO_FIRST, "r")} and {told(A.VIDEO_FIRST, "s")} and not {told(A.ON_VIDEO, "c")} then 'the music video' when fig <> '' and contains(r, fig) and song and not {told(A.SINGLE, "r")} and {told(A.ALBUM, "r")} then 'the album'
  when fig <> '' and contains(r, fig) and album and not {told(A.ALBUM, "r")} and {told(A.SINGLE, "r")} then 'the single' end owner from b""")
def attribution_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doers, viewers, spans and owners that captions swap or leave out."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(CAPTION).alias("c"), F.array(F.expr(FIRST), F.expr(SECOND)).alias("r"))
    c, r = F.col("c"), F.col("r")
    return rows.select("p_partkey", A.swapped_agent(c, r).alias("agent"), A.unattributed_view(c, r).alias("viewer"), A.moved_chart_detail(c, r).alias("span"), A.wrong_owner(c, r, r).alias("owner"))


_NAME = cases("p_size", "p_name", "'the ' || p_name", "p_name || ' motion picture'", "'other'")
_ARTIST = cases("p_size % 5", "split_part(p_name, ' ', 2) || ' band'", "'nobody'")
_SPACED = f"' ' || array_to_string(list_filter({WORDS}, lambda w: w <> 'and'), ' ')"


@query(rf"""
with a as (select p_partkey k, p_size z, p_name title, split_part(p_name, ' ', 2) game, {_NAME} n, {_ARTIST} artist from part)
select k p_partkey, case k % 3 when 0 then case when replace(replace(n, 'the ', ''), ' ', '') <> replace(title, ' ', '') then 'another title' end
 when 1 then case when z % 7 = 0 then 'a performer' when not ends_with({_SPACED.format("n")}, {_SPACED.format("game")}) then 'another game' end
 else case when z % 3 = 0 and {told(A.SCREEN_SOUNDTRACK, "n")} then 'a film''s album' when not contains(' ' || artist || ' ', ' ' || game || ' ') and not contains(' ' || n || ' ', ' ' || game || ' ') then 'another''s album' end end misfit from a""")
def box_misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why boxes of facts are about another work."""
    k, z = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").withColumns({"n": F.expr(_NAME), "artist": F.expr(_ARTIST)})
    kind = F.when(k % 3 == 0, "song").when(k % 3 == 1, "game").otherwise("album")
    return rows.select("p_partkey", A.box_misfit(kind, F.col("n"), F.array("artist"), F.array("p_name"), F.split_part("p_name", F.lit(" "), F.lit(2)), z % 3 == 0, z % 7 == 0).alias("misfit"))


STATED = cases("p_size", "'It came out in 1999 on Night & Day Records, by ' || p_brand", "'\"' || p_name || ' 1999\" is by Ada de Pell. And The Wells of 2004'", "p_name || ' of 1850 in Rome'", "'A tempo and an ostinato for ' || p_name", "'The ostinato (a pattern that repeats) of a tempo'")
TERMS = (("ostinato", "a pattern that repeats"), (r"\btempo\b", "how fast it goes"))


@query(rf"""
with a as (select p_partkey, {STATED} t from part), b as (select *, regexp_replace(regexp_replace(t, '"[^"]*"', ' ', 'g'), '^\s*\S+', ' ') r from a),
v as (select *, regexp_extract_all(r, '{A.VALUE_YEAR}') y, list_transform(regexp_extract_all(regexp_replace(r, '{A.VALUE_YEAR}', ' ', 'g'), '{A.VALUE_NAME.replace("'", "''")}'), lambda n: trim(regexp_replace(n, '\.+$', ''))) n from b)
select p_partkey, array_to_string(list_concat(y, list_filter(n, lambda x: length(x) > 1 and x not in ('The', 'And', 'A', 'An'))), '|') stated,
 case when contains(t, 'ostinato') and not contains(t, '(a pattern') then replace(t, 'ostinato', 'ostinato (a pattern that repeats)') when contains(t, 'tempo') and length(t) + 19 <= 80 then replace(t, 'tempo', 'tempo (how fast it goes)') else t end told from v""")
def stated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years and names that fixed sentences state, and sentences with a term explained."""
    t = F.col("t")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(STATED).alias("t"))
    return rows.select("p_partkey", F.array_join(A.values_in(t), "|").alias("stated"), A.explained(t, TERMS, 80).alias("told"))


@query("""
with s as (select user_id, event_id % 4 play, case event_id % 4 when 0 then 'now' || user_id % 3 else event_type end song, 'f' || event_id % 5 t from events),
r as (select user_id, event_id report, 'f' || event_id % 7 t, case when event_id % 3 > 0 then case event_id % 5 when 0 then 'now' || user_id % 3 else event_type end end song, event_id % 2 = 0 live from events),
l as (select user_id, song, min(play) play from s where play > 0 group by 1, 2),
x as (select r.*, live and exists (select 1 from s where s.user_id = r.user_id and s.play = 0 and s.t = r.t and (r.song is null or r.song = s.song)) playing,
 exists (select 1 from s join l using (user_id, song, play) where s.user_id = r.user_id and s.song = r.song and s.t = r.t) past from r)
select user_id, report, case when playing then 'now' || user_id % 3 else song end song, t as text, playing from x where playing or past""")
def report_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements that reports of errors mean, of the play that is on or of an earlier one."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    on = F.concat(F.lit("now"), F.col("user_id") % 3)
    statements = e.select("user_id", (k % 4).alias("play"), F.when(k % 4 == 0, on).otherwise(F.col("event_type")).alias("song"), F.concat(F.lit("f"), k % 5).alias("text"))
    reports = e.select("user_id", k.alias("report"), F.concat(F.lit("f"), k % 7).alias("text"), F.when(k % 3 > 0, F.when(k % 5 == 0, on).otherwise(F.col("event_type"))).alias("song"), (k % 2 == 0).alias("live"))
    return K.report_targets(reports, statements, "user_id")


_SAYING = r"regexp_replace(coalesce(text, ''), ' (the|de|der|la) ', ' said '{})"
_SPEAKER = r"regexp_extract(coalesce(text, ''), '(\p{Lu}\p{Ll}{3,})', 1)"
_QUOTE = r"regexp_extract(coalesce(text, ''), '[.] \p{Lu}\p{L}* (\p{L}+ \p{L}+ \p{L}+)', 1)"
_BARE = r"""regexp_replace(s, '["“][^"”]*["”]', '', 'g')"""
_WHOLE = r"' ' || regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' '"


@query(rf"""
with d as (select doc_id, {_SAYING.format(", 'g'")} t, {_SPEAKER} nm, {_QUOTE} q from documents),
c as (select *, nm || ' said that ' || case when q <> '' then '"' || q || '"' else 'it was so' end c from d where nm <> '' and lower(nm) not in {A.NAME_STOPWORDS}),
l as (select doc_id, c, nm, q, unnest(k) s, unnest(range(len(k))) i from (select *, list_filter(list_transform(flatten(list_transform(string_split(t, chr(10)), lambda x: string_split(regexp_replace(x, '([.!?]["”]?)\s+(["“]?\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), chr(1)))), lambda x: trim(x)), lambda x: x <> '') k from c)),
m as (select *, contains({_WHOLE.format(_BARE)}, {_WHOLE.format("nm")}) m, {TOKENS.format("c")} ct, {TOKENS.format("s")} st from l),
g as (select *, {told(P.ATTRIBUTION[4:], "s")} and (m or ({told(P.PRONOUN_SAYS[4:], "s")} and (coalesce(lag(m, 1) over w, false) or coalesce(lag(m, 2) over w, false))) or ({told(P.BY_THE_MAKER[4:], "s")} and first(m) over w)) gives,
  case when len(ct) > 0 then len(list_filter(ct, lambda x: list_contains(st, x))) / len(ct) else 0.0 end share from m window w as (partition by doc_id order by i)),
n as (select *, gives or (coalesce(lag(gives) over (partition by doc_id order by i), false) and not {told(P.ATTRIBUTION[4:], _BARE)}) near, max(share) over (partition by doc_id) best from g)
select doc_id, any_value(nm) "name" from n group by doc_id
having not bool_or(gives) or (any_value(q) <> '' and len(list_filter(string_split(any_value(q), ' '), lambda x: not regexp_matches(x, '^(\p{{Lu}}|\d)') and x not in ('a', 'an', 'the', 'of', 'in', 'on', 'to', 'and', 'for', 'at', 'by', 'or'))) > 0
    and not bool_or(near and contains(s, q))) or (max(best) >= 0.25 and not bool_or(near and (share >= best - 0.1 or share >= 0.3)))""")
def misattributed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which nobody gives their first name the words that a caption puts into its mouth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_SAYING.format("")).alias("t"), F.expr(_SPEAKER.replace("\\", "\\\\")).alias("nm"), F.expr(_QUOTE.replace("\\", "\\\\")).alias("q"))
    words = F.when(F.col("q") != "", F.concat(F.lit('"'), "q", F.lit('"'))).otherwise("it was so")
    docs = docs.select("doc_id", "t", F.when(F.col("nm") != "", F.concat("nm", F.lit(" said that "), words)).alias("c"))
    rows = P.told_sentences(docs.select("doc_id", F.col("doc_id").alias("cid"), "c"), docs.select("doc_id", "t"), "doc_id", "cid", "c", "t")
    return P.misattributed_words(rows, "cid", "c").select(F.col("cid").alias("doc_id"), "name")
