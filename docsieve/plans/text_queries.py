"""Registered queries on single titles, names, dates, colours, stores and packing, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import grounding as G
from docsieve.functions import requests as Q
from docsieve.functions import text as T
from docsieve.functions import titles as N
from docsieve.functions import uploads as V
from docsieve.operators import state as K
from docsieve.plans.queries import TOKENS, WORDS, query, table
from docsieve.sources import readers, stores

_RGB = "p_partkey % 256 r, (p_partkey * 7) % 256 g, (p_partkey * 31) % 256 b"
_LINE = "case when {0} / 255.0 <= 0.03928 then {0} / 255.0 / 12.92 else power(({0} / 255.0 + 0.055) / 1.055, 2.4) end"


@query(f"""
with c as (select p_partkey, {_RGB} from part), l as (select p_partkey, 0.2126 * ({_LINE.format("r")}) + 0.7152 * ({_LINE.format("g")}) + 0.0722 * ({_LINE.format("b")}) l from c)
select p_partkey, cast(round(l * 10000) as bigint) luminance, cast(round((1.0 + 0.05) / (l + 0.05) * 1000) as bigint) contrast from l""")
def colour_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luminance of colours, and their contrast with white."""
    k = F.col("p_partkey")
    light = T.luminance(k % 256, (k * 7) % 256, (k * 31) % 256)
    rows = table(spark, sf_dir, "part").select("p_partkey", light.alias("l"))
    return rows.select("p_partkey", F.round(F.col("l") * 10000).cast("long").alias("luminance"), F.round(T.contrast(F.lit(1.0), F.col("l")) * 1000).cast("long").alias("contrast"))


@query("""
select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y') when 1 then strftime(o_orderdate, '%B %Y') when 2 then strftime(o_orderdate, '%-d %B %Y') end date from orders""")
def plain_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as they are written for their precision; the fourth of orders has none."""
    text = F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.plain_date(text, (F.col("o_orderkey") % 4 + 9).cast("int")).alias("date"))


_MARKED = "case turn % 4 when 0 then '- ' || text when 1 then '2) ' || text when 2 then '\"' || text || '\"' else text end"


@query(rf"""
with t as (select conv_id, turn, {_MARKED} s from conversations)
select conv_id, turn, left(trim(regexp_replace(regexp_replace(s, '[\x00-\x1f\x7f]', ' ', 'g'), ' {{2,}}', ' ', 'g')), 200) request,
 regexp_replace(regexp_replace(trim(s), '^(?:[-*•]+|\d+[.)])\s+', ''), '^"([^\n]*)"$', '\1') bare from t""")
def request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made fit to log, and lines without bullets and quotes."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_MARKED.replace("\\", "")).alias("s"))
    return rows.select("conv_id", "turn", T.clean_request(F.col("s")).alias("request"), T.without_markers(F.col("s")).alias("bare"))


_VERSION = """case p_size % 6 when 0 then p_name || ' (Live at Home)' when 1 then p_name || ' - Remastered 2009' when 2 then p_name || ' [Demo] part' when 3 then p_name || ': ' || p_brand when 4 then p_name || ' - ' || p_type else p_name || ' (' || p_brand || ')' end"""


@query(rf"""
with t as (select p_partkey, {_VERSION} t from part),
u as (select *, regexp_replace(t, '(?i)\s*[(\[][^()\[\]]*\b(?:{N.VERSION_WORDS})\b[^()\[\]]*[)\]]', '', 'g') v from t)
select p_partkey, trim(regexp_replace(v, '(?i)\s+[-–—]\s+[^-–—]*\b(?:{N.VERSION_WORDS})\b[^-–—]*$', '')) bare, regexp_matches(t, '(?i)\b(?:{N.VERSION_WORDS})\b') version,
 case when regexp_matches(t, '^([^:]+):\s+(.+)$') then regexp_extract(t, '^([^:]+):\s+(.+)$', 1) when regexp_matches(t, '^(.+?)\s+[-–—]\s+(.+)$') then regexp_extract(t, '^(.+?)\s+[-–—]\s+(.+)$', 1) when regexp_matches(t, '^(.+?)\s*\(([^()]+)\)$') then regexp_extract(t, '^(.+?)\s*\(([^()]+)\)$', 2) end whole,
 case when regexp_matches(t, '^([^:]+):\s+(.+)$') then regexp_extract(t, '^([^:]+):\s+(.+)$', 2) when regexp_matches(t, '^(.+?)\s+[-–—]\s+(.+)$') then regexp_extract(t, '^(.+?)\s+[-–—]\s+(.+)$', 2) when regexp_matches(t, '^(.+?)\s*\(([^()]+)\)$') then regexp_extract(t, '^(.+?)\s*\(([^()]+)\)$', 1) end part from u""")
def title_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without notes on versions, and their two parts."""
    t = F.col("t")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_VERSION).alias("t"))
    rows = rows.select("p_partkey", N.without_version(t).alias("bare"), N.is_version_note(t).alias("version"), N.two_parts(t).alias("p"))
    return rows.select("p_partkey", "bare", "version", "p.whole", "p.part")


@query(rf"""
with c as (select conv_id, turn, text, {WORDS.format("text")} w from conversations)
select conv_id, turn, contains(' ' || trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ', ' de la ') or contains(' ' || trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ', ' the ') named,
 array_to_string(list_transform(w[1:3], lambda x: case when regexp_full_match(x, '[0-9]+') then x else left(x, 1) end), '') initials from c""")
def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether turns mention one of two names as whole words, and the initials of their first three words."""
    text = F.col("text")
    named = N.mentions(text, F.array(F.lit("De la"), F.lit("the")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", named.alias("named"), N.initials(F.slice(T.words_of(text), 1, 3)).alias("initials"))


_UPLOAD = """case p_size % 6 when 0 then p_brand || ' - ' || p_name || ' (Official Video)' when 1 then p_name || ' - ' || p_brand when 2 then p_brand || ' plays "' || p_name || '" now' when 3 then p_name || ' [4K]' when 4 then p_name || ' | lyrics' else p_name || ' podcast' end"""
_CHANNEL = "case p_partkey % 4 when 0 then p_brand || ' - Topic' when 1 then 'BigNameVEVO' when 2 then p_brand || ' Official' else p_type end"


@query(rf"""
with t as (select p_partkey, {_UPLOAD} t, {_CHANNEL} c from part),
u as (select *, trim(regexp_replace(regexp_replace(t, '(?i)\s*[(\[][^()\[\]]*\b(?:{V.LABELS})\b[^()\[\]]*[)\]]', '', 'g'), '(?i)\s*[|｜].*\b(?:{V.LABELS})\b.*$', '')) bare,
 coalesce(nullif(regexp_extract(c, '^(.+) - Topic$', 1), ''), nullif(regexp_extract(c, '(?i)^(.+?)\s*vevo$', 1), ''), nullif(regexp_extract(c, '(?i)^(.+?)\s+official(?:\s+channel)?$', 1), '')) f from t),
v as (select *, coalesce(regexp_replace(f, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), c) who, f is not null official, trim(regexp_extract(bare, '^(.+?)\s+[-–—]\s+(.+)$', 1)) a, trim(regexp_extract(bare, '^(.+?)\s+[-–—]\s+(.+)$', 2)) b,
 regexp_extract(bare, '^(.*?)["“]([^"”]+)["”]', 2) quoted, trim(regexp_extract(bare, '^(.*?)["“]([^"”]+)["”]', 1)) before from u)
select p_partkey, case when a <> '' and lower(b) = lower(who) and lower(a) <> lower(who) then b when a <> '' then a when quoted <> '' and before <> '' then before else who end artist,
 case when a <> '' and lower(b) = lower(who) and lower(a) <> lower(who) then a when a <> '' then b when quoted <> '' and before <> '' then quoted else bare end title,
 case when a <> '' and lower(b) = lower(who) and lower(a) <> lower(who) then true when a <> '' then lower(a) = lower(who) when quoted <> '' and before <> '' then false else official end confident,
 list_has_any({WORDS.format("t")}, {list(V.NOT_MUSIC)}) other from v""")
def upload_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artist and title of uploads."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_UPLOAD).alias("t"), F.expr(_CHANNEL).alias("c"))
    rows = rows.select("p_partkey", V.upload_parts(F.col("t"), F.col("c")).alias("p"), V.is_not_music(F.col("t")).alias("other"))
    return rows.select("p_partkey", "p.artist", "p.title", "p.confident", "other")


_PLAYING = "case p_size % 4 when 0 then p_brand || ' - ' || p_name when 1 then p_name when 2 then p_name || ' – ' || p_brand else ' - ' || p_name end"


@query(rf"""
with t as (select p_partkey, {_PLAYING} s, 'Provided to us' || chr(10) || chr(10) || p_name || ' · ' || p_brand d from part),
u as (select *, trim(regexp_extract(s, '^(.*?)\s+[-–—]\s+(.*)$', 1)) l, trim(regexp_extract(s, '^(.*?)\s+[-–—]\s+(.*)$', 2)) r from t)
select p_partkey, case when l <> '' and r <> '' then l end artist, case when l <> '' and r <> '' then r else trim(s) end title, string_split(string_split(d, chr(10))[3], ' · ')[1] told from u""")
def playing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artist and title of a player's line, and the title of a generated description."""
    d = F.concat(F.lit("Provided to us\n\n"), "p_name", F.lit(" · "), "p_brand")
    rows = table(spark, sf_dir, "part").select("p_partkey", readers.line_parts(F.expr(_PLAYING), "artist-title").alias("s"), readers.auto_description(d).alias("d"))
    return rows.select("p_partkey", "s.artist", "s.title", F.col("d.title").alias("told"))


@query("""
with o as (select event_id k, user_id v from events where event_id % 3 > 0), n as (select event_id k, user_id + 1000 v from events where event_id % 2 = 0)
select k, v from o where not exists (select 1 from n where n.k = o.k) union all select k, v from n""")
def upserted_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    old = e.where("event_id % 3 > 0").select(F.col("event_id").alias("k"), F.col("user_id").alias("v"))
    return stores.upserted(old, e.where("event_id % 2 = 0").select(F.col("event_id").alias("k"), (F.col("user_id") + 1000).alias("v")), "k")


@query("""select event_id, user_id from events where event_type <> 'error' and ts >= timestamp '2024-01-25 12:00:00' - interval 10 days and ts <= timestamp '2024-01-25 12:01:00'""")
def current_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the present rules that are at most ten days old."""
    rules = F.when(F.col("event_type") == "error", "old").otherwise("new")
    store = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"), rules.alias("rules"))
    return stores.current(store, "new", "2024-01-25 12:00:00", 10).select("event_id", "user_id")


@query("""
with recursive o as (select p_brand, p_partkey, p_size, row_number() over (partition by p_brand order by p_partkey) r from part),
s as (select p_brand, r, p_partkey, p_size, p_size <= 60 took, case when p_size <= 60 then p_size else 0 end used from o where r = 1
 union all select o.p_brand, o.r, o.p_partkey, o.p_size, s.used + o.p_size <= 60, case when s.used + o.p_size <= 60 then s.used + o.p_size else s.used end from s join o on o.p_brand = s.p_brand and o.r = s.r + 1)
select p_brand, p_partkey, p_size from s where took""")
def packed_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in order, each taken if it still fits."""
    return K.packed_within(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", ["p_partkey"], "p_size", 60)


@query(rf"""
with c as (select p_partkey, p_name || case p_size % 3 when 0 then ' song' when 1 then ' music and track' else ' drum' end caption, p_name || case p_partkey % 2 when 0 then ' by ' || p_brand else '' end request from part),
t as (select *, {WORDS.format("caption")} ct, {WORDS.format("request")} rt from c)
select p_partkey, len(list_filter(ct, lambda x: not list_contains(rt, x) and x not in {G.FILLER})) = 0 restates from t""")
def restated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions that say no more than the request."""
    more = F.when(F.col("p_size") % 3 == 0, " song").when(F.col("p_size") % 3 == 1, " music and track").otherwise(" drum")
    by = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" by "), "p_brand")).otherwise("")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", more).alias("c"), F.concat("p_name", by).alias("r"))
    return rows.select("p_partkey", G.restates(F.col("c"), F.col("r")).alias("restates"))


_WIDER = """case p_size % 12 when 0 then p_name || ' by ' || p_type when 1 then 'It came out in June' when 2 then 'The album of 2001' when 3 then 'It came out in March' when 4 then 'It was so because of it' when 5 then 'all except ' || p_name
  when 6 then 'its sister ' || p_name when 7 then p_name || ' was produced' when 8 then 'it won a prize' when 9 then 'It was recorded in 2001' when 10 then p_type || ' by ' || p_name else p_name end"""
_SOURCE = "p_type || ' by ' || p_name || ' came out in March 1999. It was only partly recorded in 2001 and written by Sam.'"


def _introduced(words: tuple[str, ...]) -> str:
    return f"len(list_filter(cw, lambda x: x in {words} and not list_contains(sw, x))) > 0"


@query(rf"""
with t as (select p_partkey, {_WIDER} c, {_SOURCE} s, p_type || ' by ' || p_name || ' came out in March 1999' b from part),
w as (select *, {WORDS.format("c")} cw, {WORDS.format("s")} sw, {WORDS.format("b")} bw from t),
y as (select *, list_filter(cw, lambda x: regexp_full_match(x, '[12][0-9]{{3}}')) cy, list_filter(sw, lambda x: regexp_full_match(x, '[12][0-9]{{3}}')) sy, list_filter(bw, lambda x: regexp_full_match(x, '[12][0-9]{{3}}')) yb,
 regexp_extract(lower(c), '(\w+) by (\w+)', 1) c1, regexp_extract(lower(c), '(\w+) by (\w+)', 2) c2, regexp_extract(lower(b), '(\w+) by (\w+)', 1) b1, regexp_extract(lower(b), '(\w+) by (\w+)', 2) b2 from w)
select p_partkey, case when c1 <> '' and c1 = b2 and c2 = b1 and c1 <> c2 then 'turned' when {_introduced(G.MONTHS)} then 'month' when len(list_filter(list_filter(cy, lambda x: list_contains(sy, x)), lambda x: not list_contains(yb, x))) > 0 then 'year'
 when len(list_filter(cw, lambda x: list_contains(bw, x) and x in {G.MONTHS})) > 0 and len(yb) > 0 and len(cy) = 0 then 'dropped-year' when {_introduced(G.CONNECTIVES)} then 'connective' when {_introduced(G.EXCEPTIONS)} then 'exception'
 when {_introduced(G.RELATIONS)} then 'relation' when {_introduced(G.ROLES)} then 'role' when {_introduced(G.AWARDS)} then 'award' when list_has_any(bw, {list(G.LIMITS)}) and not list_has_any(cw, {list(G.LIMITS)}) then 'limit' end reason from y""")
def wider_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first wider check that a caption fails against its source."""
    best = F.concat("p_type", F.lit(" by "), "p_name", F.lit(" came out in March 1999"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_WIDER).alias("c"), F.expr(_SOURCE).alias("s"), F.array(best).alias("r"))
    return rows.select("p_partkey", G.wider_reason(F.col("c"), F.col("s"), F.col("r")).alias("reason"))


_CREDIT = """case p_size % 7 when 0 then p_name || ' (requested by ' || p_brand || ')' when 1 then p_name || ', commissioned by X' when 2 then p_name || ' - for ' || p_brand when 3 then p_name || ' (live) [take 2]' when 4 then p_name || ' (@' || p_type || ')' when 5 then 'Trad.' else p_name end"""


@query(rf"""
with t as (select p_partkey, {_CREDIT} t from part), u as (select *, trim(regexp_replace(t, '(?i)[\s,;:|/(\[–—-]+(?:commission(?:ed)?|requested|request|req\.?|suggested|sponsored|donated|gifted|paid)\s+(?:by|from)(\s.*)?$', '')) a from t),
v as (select *, trim(regexp_replace(regexp_replace(a, '(?i)(?:\s*[,;|–—]|\s+-)\s+for\s+\S.*$', ''), '(\s*(\([^()@]*\)|\[[^\[\]@]*\]))+$', '')) b from u)
select p_partkey, a title, b artist, regexp_full_match(trim(t), '(?i)(traditional|trad|anonymous|anon|unknown|folk)\.?') nobody,
 case when {WORDS.format("a")}[1] = {WORDS.format("p_name")}[1] then true else false end same from v join part using (p_partkey)""")
def request_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and artists without who asked for them."""
    t = F.col("t")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr(_CREDIT).alias("t"))
    rows = rows.select("p_partkey", "p_name", Q.without_credit(t).alias("title"), Q.without_note(t).alias("artist"), Q.is_nobody(t).alias("nobody"))
    same = F.get(T.words_of(F.col("title")), F.lit(0)) == F.get(T.words_of(F.col("p_name")), F.lit(0))
    return rows.select("p_partkey", "title", "artist", "nobody", same.alias("same"))


@query("""
with e as (select user_id, event_id, event_type, ts, value % 40 delay, 'spot' || event_id % 3 spot, row_number() over (partition by user_id order by ts, event_id) nth from events),
t as (select *, greatest(6.0, 2 + (length(event_type) + 4) / 3.0) reading from e),
s as (select *, max(delay) filter (delay <= 20) over (partition by user_id, spot) last from t)
select user_id, event_id, cast(round(case when delay > 20 then delay - 20 else 0 end * 100) as bigint) wait, cast(round(case when delay > 20 then reading else delay + reading - 20 end * 100) as bigint) stay
from s where delay > 20 or (delay + reading - 20 >= 2 and last <= delay)""")
def catch_up_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one who joins 20 seconds late is still shown: on the others' schedule, none replaced in its place."""
    from docsieve.operators import schedule as D

    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") % 40).alias("delay"), F.concat(F.lit("spot"), F.col("event_id") % 3).alias("spot"), D.reading_seconds(F.length("event_type") + 4, F.lit(6.0)).alias("reading"))
    out = D.catch_up(e, "user_id", "spot", 20.0)
    return out.select("user_id", "event_id", F.round(F.col("wait") * 100).cast("long").alias("wait"), F.round(F.col("stay") * 100).cast("long").alias("stay"))


@query("""
with r as (select user_id, event_id, event_type t, value % 40 delay from events where event_id % 3 = 0), m as (select user_id, max(delay) last from r group by 1),
a as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 k from events where event_id % 3 = 1)
select user_id, event_id, cast(round(delay * 100) as bigint) due from r union all
select user_id, event_id, cast(round((greatest(21.0, coalesce(last + 10, 0)) + 10 * k) * 100) as bigint) from a left join m using (user_id)""")
def later_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that come later follow those of the record, ten seconds apart."""
    from docsieve.operators import schedule as D

    e = table(spark, sf_dir, "events")
    record = e.where("event_id % 3 = 0").select("user_id", "event_id", (F.col("value") % 40).alias("delay"))
    out = D.with_later(record, e.where("event_id % 3 = 1").select("user_id", "event_id"), "user_id", "event_id", 20.0, 10.0)
    return out.select("user_id", "event_id", F.round(F.col("delay") * 100).cast("long").alias("due"))

