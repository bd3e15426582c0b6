"""Registered queries on titles, recordings, captions' interest and extracts, each with the SQL that it must equal.

The tables have no titles of pages or captions, so these are put together from part names by expressions that both
engines read (ASKED, TITLE, CAPTION, SENTENCE), to reach the branches of the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import interest as I
from docsieve.functions import relevance as R
from docsieve.operators import extracts as E
from docsieve.operators import recordings as C
from docsieve.operators import selection as S
from docsieve.plans.queries import SENTENCES, WORDS, query, table

ASKED = """case p_partkey % 5 when 0 then p_name when 1 then 'The ' || p_name when 2 then p_name || ' ' || cast(p_size as string)
  when 3 then p_name || ' ii: deluxe ' || p_brand else p_name || ' i j' end"""
TITLE = """case p_size % 16 when 0 then p_name when 1 then p_name || ' (song)' when 2 then p_name || ' (film)' when 3 then 'The ' || p_name
  when 4 then p_name || ' ' || cast(p_size as string) when 5 then p_name || ' 2' when 6 then p_name || 's' when 7 then p_name || ' and more' when 8 then p_name || ' records'
  when 9 then p_name || ' (Smith)' when 10 then 'red ' || p_name when 11 then 'Long live the ' || p_name when 12 then p_name || ' tour' when 13 then p_name || ' i k'
  when 14 then p_name || ' ii' else p_name || ' (band)' end"""


def _has(words: str, values: tuple[str, ...]) -> str:
    return f"list_has_any({words}, {list(values)})"


ROMAN_SQL = "list_transform({0}, lambda w: case w when 'ii' then '2' when 'iii' then '3' when 'iv' then '4' when 'v' then '5' when 'vi' then '6' when 'vii' then '7' when 'viii' then '8' when 'ix' then '9' when 'x' then '10' else w end)"
LIGHT_SQL = f"list_filter({{0}}, lambda w: w not in {R.LIGHT})"


def _weighty(words: str) -> str:
    kept = LIGHT_SQL.format(words)
    return ROMAN_SQL.format(f"(case when len({kept}) > 0 then {kept} else {words} end)")


@query(rf"""
with t as (select p_partkey, {ASKED} asked, {TITLE} title, p_partkey % 3 = 0 artist from part),
u as (select *, regexp_replace(title, '\s*\([^()]*\)\s*$', '') bare, regexp_extract(title, '\(([^()]*)\)\s*$', 1) note, regexp_split_to_array(asked, ':| - ')[1] head from t),
v as (select *, {WORDS.format("asked")} want, {WORDS.format("bare")} got, {WORDS.format("note")} nw, {WORDS.format("head")} hw, {WORDS.format("title")} tw from u),
x as (select *, {_weighty("want")} a, {_weighty("got")} b, array_to_string({_weighty("hw")}, ' ') hl, array_to_string(want, ' ') wl, array_to_string(got, ' ') gl from v),
y as (select *, array_to_string(a, ' ') al, array_to_string(b, ' ') bl, list_filter(a, lambda w: regexp_full_match(w, '[0-9]+')) na, list_filter(b, lambda w: regexp_full_match(w, '[0-9]+')) nb,
  len(list_filter(a, lambda w: list_contains(b, w))) held, substr(gl, length(wl) + 1) rest from x)
select p_partkey, case when len(want) = 0 or len(got) = 0 then false
 when len(want) = len(got) and len(list_filter(list_zip(want, got), lambda z: z[1] <> z[2] and least(length(z[1]), length(z[2])) = 1 and left(z[1], 1) <> left(z[2], 1))) > 0 then false
 when starts_with(wl, 'the ') and not starts_with(gl, 'the ') then false
 when note <> '' and not ({_has("nw", R.MUSIC_NOTES)} or (artist and {_has("nw", R.PERFORMER_NOTES)}) or (regexp_matches(note, '^\p{{Lu}}') and not {_has("nw", R.PERFORMER_NOTES)})) then false
 when len(na) > 0 and not list_has_any(na, nb) then false
 when len(list_filter(list_intersect(na, nb), lambda n: list_contains(want, n) <> list_contains(got, n))) > 0 then false
 when starts_with(bl, al || ' ') then not (starts_with(rest, ' s ') or starts_with(rest, ' and ') or ({_has("got", R.COMPANY_WORDS)} and not {_has("want", R.COMPANY_WORDS)})) and not ({_has("got", R.OTHER_MEDIA)} and not {_has("want", R.OTHER_MEDIA)})
 when starts_with(al, bl || ' ') then (hl = bl or regexp_full_match(b[-1], '[0-9]+')) and len(list_filter(na, lambda n: not list_contains(nb, n))) = 0
 when len(got) > len(want) + 1 then false when al = bl then true when bl = al || 's' and len(a) >= 2 then true when len(a) >= 3 then 100 * held >= 85 * len(a)
 else held = len(a) and len(list_filter(b, lambda w: not list_contains(a, w))) = 0 end fits,
 list_filter(want[2:], lambda w: w in {R.EDITION_NOTES} and not list_contains(tw, w))[1] edition,
 len(list_filter(nw, lambda w: w not in {R.MUSIC_NOTES})) > 0 and not list_has_any(list_filter(nw, lambda w: w not in {R.MUSIC_NOTES}), want) another,
 regexp_matches(title, '^\p{{Lu}}[\p{{Ll}}''-]+( \p{{Lu}}[\p{{Ll}}''-]+){{1,2}}$') and not {_has("tw", R.LIGHT)} person from y""")
def title_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's title fits the title asked for, and what else its words tell."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(ASKED).alias("asked"), F.expr(TITLE).alias("title"), (F.col("p_partkey") % 3 == 0).alias("artist"))
    asked, title = F.col("asked"), F.col("title")
    return rows.select(
        "p_partkey", R.title_fits(asked, title, F.col("artist")).alias("fits"), R.missing_edition(asked, title).alias("edition"), R.names_another(title, asked).alias("another"), R.is_like_a_name(title).alias("person")
    )


RECORDINGS = """
with r as (select p_name title, l_suppkey artist, l_shipdate released, l_linestatus = 'O' official, l_returnflag = 'R' reissue, 80 + l_linenumber * 3 score, p_brand album from lineitem join part on l_partkey = p_partkey),
q as (select distinct title || '/' || artist id, title, artist, case when artist % 5 = 0 then 1999 end died from r)"""


def _recordings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_name").alias("title"), F.col("l_suppkey").alias("artist"), F.col("l_shipdate").alias("released"), (F.col("l_linestatus") == "O").alias("official"),
        (F.col("l_returnflag") == "R").alias("reissue"), (80 + F.col("l_linenumber") * 3).alias("score"), F.col("p_brand").alias("album"),
    )
    q = r.select("title", "artist").distinct().withColumn("id", F.concat_ws("/", "title", "artist")).withColumn("died", F.when(F.col("artist") % 5 == 0, 1999))
    return r, q


@query(f"""{RECORDINGS},
g as (select id, died, min(year(released)) y from q join r using (title, artist) where score >= 90 and official and not reissue group by 1, 2),
e as (select id, min(year(released)) e from q join r using (title, artist) group by 1),
ys as (select id, y from g join e using (id) where (died is null or y <= died) and e >= y),
al as (select id, min_by(album, (released, album)) album, min(released) rel from q join r using (title, artist) where score >= 90 and official and not reissue and album <> title group by 1),
ok as (select al.id, album from al left join ys using (id) where y is null or year(rel) <= y + 1)
select q.id, case when y is null then '"' || title || '" is on the album ' || album || '.' when album is null then '"' || title || '" came out in ' || y || '.'
 else '"' || title || '" came out in ' || y || ' and is on the album ' || album || '.' end line from q left join ys using (id) left join ok using (id) where y is not null or album is not null""")
def recording_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First year and album of every title by every artist, as a line."""
    r, q = _recordings(spark, sf_dir)
    years = C.first_years(r, q)
    return C.song_lines(q, years, C.first_albums(r, q, years)).select("id", F.array_join("lines", "|").alias("line"))


@query("""
with k as (select distinct p_name title, p_brand artist from part),
p as (select p_partkey id, case when p_partkey % 3 = 0 then p_brand when p_partkey % 3 = 1 then p_name else p_type end l, case when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then p_brand else p_name end r from part)
select id, case when a and not b then 'keep' when b and not a then 'swap' end vote
from (select id, exists (select 1 from k where artist = l and title = r) a, exists (select 1 from k where title = l and artist = r) b from p)""")
def recording_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 3
    pairs = part.select(
        F.col("p_partkey").alias("id"), F.when(kind == 0, F.col("p_brand")).when(kind == 1, F.col("p_name")).otherwise(F.col("p_type")).alias("left"),
        F.when(kind == 1, F.col("p_brand")).otherwise(F.col("p_name")).alias("right"),
    )
    return C.order_votes(part.select(F.col("p_name").alias("title"), F.col("p_brand").alias("artist")), pairs)


@query("""
with r as (select l_orderkey * 10 + l_linenumber recording, p_name title, l_shipdate released, p_type || ' of ' || p_brand release, l_returnflag = 'R' remix, 80 + l_linenumber * 3 score from lineitem join part on l_partkey = p_partkey),
q as (select distinct p_name || '/' || p_type id, p_name title, lower(p_type) work from part),
n as (select id, recording, row_number() over (partition by id order by released, recording) k from q join r using (title) where score >= 85 and not remix and contains(lower(release), lower(work)))
select id, recording from n where k <= 3""")
def track_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    r = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("recording"), F.col("p_name").alias("title"), F.col("l_shipdate").alias("released"),
        F.concat("p_type", F.lit(" of "), "p_brand").alias("release"), (F.col("l_returnflag") == "R").alias("remix"), (80 + F.col("l_linenumber") * 3).alias("score"),
    )
    q = part.select(F.concat_ws("/", "p_name", "p_type").alias("id"), F.col("p_name").alias("title"), F.lower("p_type").alias("work")).distinct()
    return C.track_candidates(r, q, 3)


CAPTION = """case p_size % 13 when 0 then 'It was recorded in 3 hours' when 1 then 'The first song by the singer' when 2 then 'It was given an award and sold 900 copies'
  when 3 then 'Released on vinyl by its label' when 4 then 'The sequel has a new plot and a developer' when 5 then 'He grew up in a hometown of choir music' when 6 then 'A charity paid for it'
  when 7 then 'About "Velvet Harbor" and more' when 8 then p_name || ' is "the best thing of all times"' when 9 then 'Roughly 20 big voices were heard' when 10 then 'Perhaps the oldest ' || p_name
  when 11 then 'Its "Paper Kites" has characters' else p_name end"""
FILLER = " ".join(f"word{i}" for i in range(30))
SENTENCE = f"""case p_partkey % 6 when 0 then {CAPTION} when 1 then 'Critics said that ' || p_name || ' was perhaps the first of its kind' when 2 then ({CAPTION}) || ' {FILLER}'
  when 3 then 'It was "a very long quote here" in all' when 4 then p_name else 'The oldest and only song of the band' end"""
NAME = "case when p_partkey % 5 = 0 then 'Velvet Harbor' else 'Paper Kites' end"


def _count(text: str) -> str:
    return rf"len(list_filter(regexp_split_to_array(trim({text}), '\s+'), lambda w: w <> ''))"


def _lower(text: str, words: str) -> str:
    return rf"regexp_matches(lower({text}), '{I.whole(words)}')"


def _told(text: str, words: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({text}), '\b({words})\b', 1))"


QUOTES = r"""regexp_extract_all({0}, '"([^"]+)"', 1)"""
IS_TITLE = r"len(list_filter(list_filter(regexp_split_to_array(trim({0}), '\s+'), lambda w: length(w) > 3), lambda w: not regexp_matches(w, '^\p{{Lu}}'))) = 0"
PADDED = "' ' || array_to_string({0}, ' ') || ' '"
KINDS = {
    "picture": _lower("c", "|".join(I.PICTURES)),
    "making": _lower("c", I.MAKING),
    "first": "len(firsts) > 0 and stated",
    "person": _lower("c", I.PERSONAL),
    "good": _lower("c", I.GIFTS),
    "award": _lower("c", I.PRIZES),
    "release": _lower("c", I.RELEASES),
}
CAPTIONS = rf"""
with t as (select p_partkey, p_brand, {CAPTION} c, {SENTENCE} s, {NAME} title, p_size > 25 lead from part),
u as (select *, list_distinct({WORDS.format("c")}) cw, {WORDS.format("s")} sw, {WORDS.format("title")} tw from t),
v as (select *, {_told("c", I.FIRSTS)} firsts, list_filter({QUOTES.format("c")}, lambda q: {IS_TITLE.format("q")} and len({WORDS.format("q")}) > 0) titles from u),
w as (select *, len(list_filter(firsts, lambda x: not list_contains({_told("s", I.FIRSTS)}, x))) = 0 stated, {PADDED.format("tw")} own from v),
m as (select p_partkey, p_brand, lead, list_filter([case when {_lower("s", I.SPEECH)} then 'speech' end,
  case when len(list_filter({QUOTES.format("s")}, lambda q: {_count("q")} >= 4 and not ({IS_TITLE.format("q")}))) > 0 then 'quote' end,
  case when not lead and {_count("s")} >= 30 then 'long' end,
  case when len(list_filter({_told("s", I.LIMITING)}, lambda x: not list_contains({_told("c", I.LIMITING)}, x))) > 0 then 'limit' end,
  case when not lead and 2 * len(list_filter(cw, lambda x: list_contains(sw, x))) < len(list_distinct(sw)) then 'compressed' end], lambda x: x is not null) flags,
  {" + ".join(f"(case when {KINDS[k]} then {p} else 0 end)" for k, p in I.POINTS)} + (case when len(firsts) > 0 and not stated then {I.UNSTATED_FIRST} else 0 end) score,
  case {" ".join(f"when {KINDS[k]} then '{k}'" for k, _ in I.POINTS)} else 'plain' end hook,
  {_lower("c", I.MUSIC)} or {_lower("c", I.MAKING)} or not {_lower("c", I.AROUND)} music,
  len(titles) > 0 and len(list_filter(titles, lambda q: contains({PADDED.format(WORDS.format("q"))}, own) or contains(own, {PADDED.format(WORDS.format("q"))}))) = 0 other from w)"""


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.expr(CAPTION).alias("c"), F.expr(SENTENCE).alias("s"), F.expr(NAME).alias("title"), (F.col("p_size") > 25).alias("lead"))
    c, s = F.col("c"), F.col("s")
    rows = rows.withColumn("i", I.interest(c, s))
    return rows.select(
        "p_partkey", "p_brand", "lead", I.source_risks(c, s, F.col("lead")).alias("flags"), F.col("i.score").alias("score"), F.col("i.hook").alias("hook"), I.about_music(c).alias("music"), I.names_another_title(c, F.col("title")).alias("other")
    )


@query(f"{CAPTIONS} select p_partkey, array_to_string(flags, ',') flags, score, hook, music, other from m")
def caption_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _captions(spark, sf_dir).select("p_partkey", F.array_join("flags", ",").alias("flags"), "score", "hook", "music", "other")


@query(f"""{CAPTIONS},
r as (select p_brand g, p_partkey pos, score, other, not music off, len(flags) risk, lead from m),
a as (select *, sum(other::int) over (partition by g order by pos) no from r), b as (select * from a where not other or no <= 1),
c as (select *, sum((off and not other)::int) over (partition by g order by pos) nf from b), d as (select * from c where not off or other or nf <= 2),
e as (select *, sum((risk = 0)::int) over (partition by g) safe, row_number() over (partition by g, risk = 0 order by risk + case when lead then 0 else 0.5 end, pos) back from d),
f as (select * from e where risk = 0 or back <= 3 - safe),
h as (select g, pos, row_number() over (partition by g order by (risk > 0)::int, other::int, off::int, score desc, lead::int desc, pos) place from f)
select g, pos, place from h where place <= 4""")
def ranked_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of a group ranked by what their words tell: risk, another title, not about music, interest, lead."""
    rows = _captions(spark, sf_dir)
    rows = rows.select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("pos"), "score", "other", (~F.col("music")).alias("off"), F.size("flags").alias("risk"), "lead")
    return S.rank_with_caps(rows, "g", floor=3)


#: Every line with a length divisible by three becomes a heading, of a level and a name that follow from its text.
HEADINGS = ("References", "Plot", "Release and charts", "Music and style", "Other things")
_PICK = " ".join(f"when {i} then '{h}'" for i, h in enumerate(HEADINGS[:-1]))
EXTRACT = rf"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents), l as (select doc_id, unnest(ls) s, unnest(range(len(ls))) i, len(ls) n from d),
k as (select *, case length(s) % 8 {_PICK} else '{HEADINGS[-1]}' end name, length(split_part(s, ' ', 1)) % 5 + 2 lev, length(s) % 3 = 0 head from l),
h as (select doc_id, i, lev, n, name, case when name = 'References' then -1 when name = 'Plot' then 4 when name = 'Release and charts' then 1 when name = 'Music and style' then 2 end own from k where head),
x as (select a.doc_id, a.i, any_value(a.name) name, any_value(a.own) own, coalesce(min(b.i), any_value(a.n)) t from h a left join h b on a.doc_id = b.doc_id and b.i > a.i and b.lev <= a.lev group by 1, 2),
c as (select p.doc_id, p.i, any_value(p.s) s, max(x.i) inner_i, max(x.i) filter (x.own is not null) told from k p left join x on x.doc_id = p.doc_id and x.i < p.i and p.i < x.t where not p.head group by 1, 2),
r as (select c.doc_id, c.i pos, c.s, y.name under, case when inner_i is null then 0 when told is null then 3 when z.own = -1 and told <> inner_i then 3 else z.own end rank
  from c left join x y on y.doc_id = c.doc_id and y.i = inner_i left join x z on z.doc_id = c.doc_id and z.i = told),
e as (select doc_id, pos, under, rank, unnest({SENTENCES.format("s")}) s, unnest(range(len({SENTENCES.format("s")}))) k from r where rank <> -1),
q as (select doc_id, pos, k, under, rank, s, length(s) n from e where length(s) >= 25)"""


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda s: F.coalesce(*[F.when(F.length(s) % 8 == i, F.lit(h)) for i, h in enumerate(HEADINGS[:-1])], F.lit(HEADINGS[-1]))
    mark = lambda s: F.repeat(F.lit("="), F.length(F.split_part(s, F.lit(" "), F.lit(1))) % 5 + 2)
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.when(F.length(s) % 3 == 0, F.concat(mark(s), F.lit(" "), pick(s), F.lit(" =="))).otherwise(s))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("t"))


@query(f"""{EXTRACT},
o as (select *, n + 1 + case when row_number() over w > 1 and lag(under) over w is not distinct from under then 0 else length(coalesce(under, '')) + 4 end cost, row_number() over w place from q window w as (partition by doc_id order by rank, pos, k)),
z as (select *, sum(cost) over (partition by doc_id order by rank, pos, k rows unbounded preceding) used from o)
select doc_id, place, pos, k, rank from z where used <= 900""")
def section_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by the rank of their section, within 900 characters."""
    return E.section_extract(_headed(spark, sf_dir), "doc_id", "t", 900)


@query(rf"""{EXTRACT},
o as (select doc_id, pos, k, n, case when rank = 0 then 1 when not ({_count("s")} < 30 and not {_lower("s", E.SPEECH)} and len(list_filter({QUOTES.format("s")}, lambda y: {_count("y")} >= 4)) = 0) then 4 when k = 0 then 2 else 3 end tier from q),
y as (select *, sum((tier < 4 and n >= 40)::int) over (partition by doc_id) usable from o),
z as (select doc_id, pos, k, tier, sum(n + 1) over (partition by doc_id order by tier, pos, k rows unbounded preceding) used from y where tier < 4 or usable < 8)
select doc_id, pos, k, tier from z where used <= 900""")
def tiered_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The safest sentences to retell first, within 900 characters."""
    return E.tiered_extract(_headed(spark, sf_dir), "doc_id", "t", 900)


@query(rf"""
with d as (select source, unnest({SENTENCES.format("text")}) s from documents), t as (select source, s || case length(s) % 4 when 0 then ' and peaked at 3' when 1 then ' ranked 2 on a list of charted ones' when 2 then ' sold well' else '' end s from d)
select source, count(*) n, sum(({_lower("s", E.CHARTS)} and not {_lower("s", E.RANKINGS)} and regexp_matches(lower(s), '{E.CHART_NUMBER}'))::int) charts from t group by 1""")
def chart_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences of a source tell of charts or sales with a number."""
    from docsieve.functions.text import sentences_of

    rows = table(spark, sf_dir, "documents").select("source", F.explode(sentences_of(F.col("text"))).alias("s"))
    more = F.when(F.length("s") % 4 == 0, " and peaked at 3").when(F.length("s") % 4 == 1, " ranked 2 on a list of charted ones").when(F.length("s") % 4 == 2, " sold well").otherwise("")
    return rows.select("source", F.concat("s", more).alias("s")).groupBy("source").agg(F.count("*").alias("n"), F.sum(E.is_chart(F.col("s")).cast("int")).alias("charts"))
