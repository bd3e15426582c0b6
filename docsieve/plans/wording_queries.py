"""Registered queries on the wording of captions, what they leave unnamed, classical titles and works, each with its SQL.

The tables have no such captions and titles; they are put together from part names by expressions that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import classical as C
from docsieve.functions import frames as R
from docsieve.functions import wording as W
from docsieve.operators import works as K
from docsieve.plans.queries import query, table
from docsieve.sources.shared import dealt


def told(pattern: str, text: str = "t") -> str:
    """SQL for whether a pattern is met in any case."""
    return f"regexp_matches({text}, '(?i)" + pattern.replace("'", "''") + "')"


def place(pattern: str, text: str = "t", group: int = 0) -> str:
    return f"nullif(regexp_extract({text}, '(?i)" + pattern.replace("'", "''") + f"', {group}), '')"


def cases(key: str, *texts: str) -> str:
    """A case of as many texts as given, dealt by a number; SQL that both engines read."""
    return f"case {key} % {len(texts)} " + " ".join(f"when {i} then {text}" for i, text in enumerate(texts)) + " end"


ACT = cases(
    "p_size", "'The singer endorsed a candidate for ' || p_name", "p_name || ' played against the new law in 1999'", "'A tireless friend of ' || p_name", "'The choir sang because ' || p_name || ' burned'", "p_name || ' was reportedly given away'",
    "'The drummer gave 2 million dollars to ' || p_name", "'She is a patron of ' || p_name", "'She is a patron of ' || p_name || ' since 2004'", "'The band marched for fair pay and ' || p_name", "'The band marched for ' || p_name",
    "'He was given the Presidential Citation for ' || p_name", "'Radical Hope sang ' || p_name", "'The radical hopes of ' || p_name", "p_name || ' and human rights'", "'A self-made coupling of ' || p_name", "p_name || ' gave 20 concerts'", "'So-called friends of ' || p_name",
)
_PLAIN = f"regexp_replace(regexp_replace(t, '(?i)\\bRadical Hope\\b', 'x', 'g'), '(?i){W.HONOR_NAMES}', '', 'g')"


@query(rf"""
with a as (select p_partkey, {ACT} t from part), u as (select p_partkey, {_PLAIN} t from a)
select p_partkey, case {" ".join(f"when {told(p)} then '{label}'" for label, p in W.NEUTRAL)} when p_partkey % 3 > 0 and {told(W.MONEY)} then 'a living person''s money'
 when {told(W.PRESENT_ROLE)} and not {told(W.YEAR)} then 'an undated role' when {told(W.phrases(W.SIDE_ACTS))} and not {told(W.OWN_TRADE)} then 'an act that states a side' end reason,
 {told(W.phrases(W.LOADED))} or (p_partkey % 2 = 0 and {told(W.phrases(W.MOTIVE))}) loaded from u""")
def neutral_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why statements on public acts are not neutral, and whether captions judge."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(ACT).alias("t"))
    names, k = F.array(F.lit("Radical Hope"), F.lit("q"), F.lit(None)), F.col("p_partkey")
    return rows.select("p_partkey", W.neutral_breach(F.col("t"), names, k % 3 > 0).alias("reason"), W.loaded_caption(F.col("t"), names, k % 2 == 0).alias("loaded"))


NEWS = cases(
    "p_size", "'The firm signed a five-year deal with ' || p_name", "'It purchased Bright Studios and ' || p_name", "'The studio Bright was renamed ' || p_name", "'The game by a studio was renamed ' || p_name", "'A new console was announced for ' || p_name",
    "p_name || ', of a studio, was renamed'", "'The song was announced for the console ' || p_name", "'A merger of ' || p_name", "'The composer signed a deal with ' || p_name", "p_name || ' was renamed'",
)


@query(rf"""
with a as (select p_partkey, p_name, {NEWS} t from part)
select p_partkey, not contains(t, 'composer') and ({told(W.DEAL)} or regexp_matches(t, '{W.BOUGHT}') or (not (regexp_matches(t, '{W.LED_BY_WORK}') or starts_with(lower(t), lower(p_name))) and (({told(W.RENAMED)} and regexp_matches(t, '{W.COMPANY}')) or {told(W.HARDWARE)}))) company from a""")
def company_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements on a company's business and not on music."""
    t = F.col("t")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr(NEWS).alias("t"))
    return rows.select("p_partkey", W.company_history(t, F.array("p_name"), F.contains(t, F.lit("composer"))).alias("company"))


CAPTION = cases(
    "p_size", "'It reached number 4 with ' || p_name", "'It reached number 4 in Japan with ' || p_name", "'The duo wrote ' || p_name", "'The band wrote ' || p_name", "'It led this chart with ' || p_name", "'It led this chart, the chart of ' || p_name", "'For these three weeks ' || p_name",
    "'It is the same melody as ' || p_name", "'It has the same melody and ' || p_name", "'After the incident ' || p_name", "'After the incident of 1999 ' || p_name", "'The 1937 recording of ' || p_name", "'The live version of it'", "'It led total sales'", "'The orchestra \"Night\" plays ' || p_name", "'It peaked at no. 7'",
    "p_name || ' was probably part of it'",
)
AROUND = cases("p_partkey", "p_name || ' are a German band of four'", "'It may have been written by ' || p_name", "'It is \"perhaps\" ' || p_name", "p_name || ' are the only duo of it'", "'In part it is ' || p_name")
_EVENT_OK = "not regexp_matches(t, '" + R.EVENT_NAMED.replace("'", "''") + "')"


@query(rf"""
with a as (select p_partkey, p_name, {CAPTION} t, {AROUND} s from part),
g as (select *, lower(regexp_extract(t, '{R.GROUP}', 1)) kind, {place(R.THIS_CHART, "t", 1)} listed, contains(lower(t), lower(p_name)) or contains(t, '"') named from a)
select p_partkey, case when not {told(R.CHART_NAMED)} then {place(R.CHART_CLAIM)} end chart,
 case when listed is not null and len(regexp_extract_all(t, '(?i)\b' || listed || '\b')) = 1 then lower({place(R.THIS_CHART)})
  when kind <> '' and not regexp_matches(t, '{R.GROUP_NAMED.replace("'", "''")}') and not regexp_matches(s, '(?i)\b(?:is|are|was|were)\s+(?:an?|the)\b[^.]{{0,80}}?\b(?:' || (case when kind in ('band', 'group') then '{R.ANY_GROUP}' else kind end) || ')s?\b') then 'the ' || kind end reference,
 coalesce({place(R.LOOSE_SPAN)}, case when not regexp_matches(t, '{R.SAME_THING} as\b') then nullif(regexp_extract(t, '{R.SAME_THING}'), '') end, case when {_EVENT_OK} then 'the ' || nullif(regexp_extract(t, '{R.EVENT}', 1), '') end,
  case when not named and not regexp_matches(regexp_replace(t, '(?i){R.RECORDING}', ''), '\p{{Lu}}') then {place(R.RECORDING)} end, case when not named then {place(R.TOTAL)} end) behind,
 case when not {told(R.HEDGE)} then {place(R.HEDGE, "regexp_replace(s, '" + R.QUOTED + "', '', 'g')")} end hedge from g""")
def unnamed_things(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts, groups, spans and events that captions leave unnamed, and doubts that they drop."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr(CAPTION).alias("t"), F.expr(AROUND).alias("s"))
    t, around = F.col("t"), F.array("s")
    return rows.select(
        "p_partkey", R.unnamed_chart(t).alias("chart"), R.unnamed_reference(t, around).alias("reference"), R.left_behind(t, F.array("p_name")).alias("behind"), R.dropped_hedge(t, around).alias("hedge")
    )


MACHINE = cases("p_partkey", "'Wii'", "'SNES'", "'Switch'", "'PS2'", "'Game Boy'", "'Amiga'")
NAMED = cases("p_size", "'for the Wii U and ' || p_name", "'for the Wii and ' || p_name", "'for the Super Famicom ' || p_name", "'they switch ' || p_name", "'on the Switch ' || p_name", "'for PlayStation 2: ' || p_name", "'for Gameboy Advance ' || p_name", "'for Gameboy, ' || p_name", "'for amiga, ' || p_name", "'for nothing'")
_OTHERS = "case m when 'SNES' then '|super nintendo|super famicom|super nintendo entertainment system' when 'PS2' then '|playstation 2' when 'Game Boy' then '|gameboy' else '' end"


@query(rf"""
with a as (select p_partkey, {MACHINE} m, {NAMED} t from part),
b as (select *, regexp_replace(t, '(?i)(Wii|SNES|PS2|Game ?Boy|Super Famicom|Amiga)[\s-]+(U|[2-5]|360|One|Series|Advance|Portable|Vita|Pocket|DSi?|XL|Lite)\b', '-', 'g') c from a)
select p_partkey, case when m = 'Switch' then regexp_matches(c, '\bSwitch\b') else regexp_matches(c, '(?i)\b(' || m || {_OTHERS} || ')\b') end supported from b""")
def supported_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a source names a machine itself."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(MACHINE).alias("m"), F.expr(NAMED).alias("t"))
    return rows.select("p_partkey", R.platform_supported(F.col("m"), F.col("t")).alias("supported"))


CITED = cases("p_size", "'4 | ' || p_name", "'[12] ' || p_name", "'[3]: ' || p_name", "'- 7) ' || p_name", "' 1. [5] | ' || p_name", "'1999 ' || p_name", "p_name || ' ' ")


@query(rf"""
with a as (select p_partkey, p_name, {CITED} t from part)
select p_partkey, case p_size % 7 when 0 then 4 when 1 then 12 when 2 then 3 when 3 then 7 when 4 then 5 else 0 end cited, case when p_size % 7 = 5 then t else p_name end caption from a join part using (p_partkey, p_name)""")
def cited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that lines cite, and their captions."""
    rows = table(spark, sf_dir, "part").select("p_partkey", R.citation(F.expr(CITED)).alias("c"))
    return rows.select("p_partkey", F.col("c.at").alias("cited"), F.col("c.text").alias("caption"))


@query(r"""
select event_id, case event_id % 3 when 0 then 'Authorization: Bearer [removed] of ' || event_type when 1 then 'at /home/[removed]/' || event_type || ' and C:\Users\[removed]\x' else '[removed] ' || event_type || ' [removed]' end report,
 event_id % 4 = 0 or event_id % 4 = 3 same from events""")
def redacted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports without secrets, credentials and account names, and whether two requests are the same."""
    k, kind = F.col("event_id"), F.col("event_type")
    text = F.when(k % 3 == 0, F.concat(F.lit("Authorization: Bearer abc.def of "), kind)).when(k % 3 == 1, F.concat(F.lit("at /home/ada/"), kind, F.lit(" and C:\\Users\\Ada\\x")))
    text = text.otherwise(F.concat(F.lit("k$1ey "), kind, F.lit(" k$1ey")))
    same = R.same_request(kind, F.when(k % 4 == 0, ""), F.when(k % 4 == 2, "none").otherwise(kind), F.when(k % 4 == 1, "who"))
    return table(spark, sf_dir, "events").select("event_id", R.redacted(text, F.array(F.lit("k$1ey"), F.lit(""))).alias("report"), same.alias("same"))


PIECE = cases(
    "p_size", "p_name || ' Sonata in E-flat major, Op. 9, No. 2'", "'Nocturne Op. 27 No. 1 (' || p_name || ')'", "p_name || ' in C# minor, KV 331: III. Rondo'", "p_name || ' Suite, BWV 1007 (2nd movement)'", "p_name || ' Canon in D'", "p_name",
    "p_name || ' Prelude #4 in d minor'", "p_name || ' - Variation 18, Op. 43'", "p_name || ' Sonata, movement III'", "p_name || ' (Live)'", "p_name || ', Op. 3 / 1, D. 5 (from a set)'",
)


@query(rf"""
with a as (select p_partkey, p_name n, p_size % 11 k, regexp_matches(p_name, '(?i){C.FORMS}') formal from part)
select p_partkey, case k when 0 then n || ' Sonata' when 1 then 'Nocturne' when 3 then n || ' Suite' when 4 then n || ' Canon' when 6 then n || ' Prelude' when 8 then n || ' Sonata' when 9 then n || ' (Live)' else n end piece, case k when 1 then n end alias,
 case k when 0 then 'Op. 9' when 1 then 'Op. 27' when 2 then 'K. 331' when 3 then 'BWV 1007' when 7 then 'Op. 43' when 10 then 'Op. 3/1 D. 5' else '' end catalogs, case k when 0 then '9 2' when 1 then '27 1' when 2 then '331' when 3 then '1007' when 6 then '4' when 7 then '43' when 10 then '3 1 5' else '' end numbers,
 case k when 0 then 'E-flat major' when 2 then 'C-sharp minor' when 4 then 'D' when 6 then 'D minor' end key, case k when 2 then 3 when 3 then 2 when 7 then 18 when 8 then 3 end movement, case k when 2 then 'Rondo' end movement_name, k not in (5, 9) or formal classical from a""")
def classical_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pieces read apart."""
    titles = dealt(table(spark, sf_dir, "part").select("p_partkey", F.expr(PIECE).alias("title")), "p_partkey")
    rows = titles.select("p_partkey", C.piece_parts(F.col("title")).alias("c"))
    return rows.select(
        "p_partkey", F.col("c.name").alias("piece"), "c.alias", F.array_join("c.catalogs", " ").alias("catalogs"), F.array_join("c.numbers", " ").alias("numbers"), "c.key", F.col("c.movement").cast("int").alias("movement"), "c.movement_name", "c.classical"
    )


_ARTIST = cases("p_size", "'Ada Pell and ' || p_name", "p_name || ', and more'", "'Té & ' || p_type", "p_name || ' feat. X'", "'Traditional'", "'K' || chr(36) || 'x ' || p_brand", "'P!nk'")
_KEY = r"trim(regexp_replace(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(rf"""
with a as (select p_partkey, p_size % 7 k, {_ARTIST} t, {_KEY.format("p_name")} n, {_KEY.format("p_type")} y, {_KEY.format("p_brand")} b from part)
select p_partkey, case k when 0 then 'ada pell and ' || n || '/' || (case when contains(n, ' ') then 'ada pell/' || n || '/' else '' end) || 'ada pell ' || n when 1 then n || ' and more/' || n when 2 then 'te ' || y || '/te and ' || y when 3 then n || ' feat x/' || n when 4 then ''
 when 5 then 'k x ' || b || '/ksx ' || b else 'p nk/pink' end names from a""")
def credit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that credits may be written with."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.artist_names(F.expr(_ARTIST)), "/").alias("names"))


@query("""
with c as (select p_brand request, p_partkey work, p_partkey % 7 rank, case when p_size % 9 = 0 then 'page' || p_size end page, case when p_partkey % 3 = 0 then [p_partkey - 7, p_size] else [] end parents, p_size place from part where p_partkey % 7 < 4),
w as (select distinct request, rank, unnest(parents) work, work part from c), a as (select c.* from c where not exists (select 1 from w where w.request = c.request and w.rank = c.rank and w.work = c.work and w.part <> c.work)),
t as (select *, coalesce(page, cast(parents[1] as varchar)) target from a),
l as (select *, count(target) over (partition by request, rank) with_end, min(rank) over (partition by request) best from t),
g as (select request, rank, count(*) n, count(distinct target) n_ends, count(page) paged, arg_min(work, (place, work)) first_work, arg_min(work, (place, work)) filter (page is not null) page_work, max(with_end) with_end from l where rank = best and (target is not null or with_end = 0) group by 1, 2)
select request, ['exact', 'name', 'set', 'catalog'][rank + 1] fit, case when with_end = 0 or n_ends = 1 then first_work when paged = 1 then page_work end work, case when with_end = 0 or n_ends = 1 or paged = 1 then 0 else n end tied from g""")
def picked_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work that each request means, or how many are tied."""
    k = F.col("p_partkey")
    fits = F.get(F.array(*[F.lit(x) for x in K.FITS]), (k % 7).cast("int"))
    parents = F.when(k % 3 == 0, F.array(k - 7, F.col("p_size").cast("long"))).otherwise(F.array().cast("array<bigint>"))
    rows = table(spark, sf_dir, "part").select("p_brand", k.cast("long").alias("p_partkey"), fits.alias("fit"), F.when(F.col("p_size") % 9 == 0, F.concat(F.lit("page"), "p_size")).alias("page"), parents.alias("parents"), "p_size")
    return K.picked_works(rows, "p_brand", "p_partkey", "fit", "page", "parents", "p_size")
