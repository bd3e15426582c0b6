"""Registered queries on articles of several works, the works that requests mean, loose names and ordered readings, with their SQL.

Documents have no headings, so lines of a length divisible by three become headings of their first words (MADE); the SQL walks
the same lines by joins of headings with those around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions.markup import html_text
from docsieve.functions.text import fold_case
from docsieve.operators import loose_names as L
from docsieve.operators import readings as D
from docsieve.operators import series as R
from docsieve.operators import work_match as M
from docsieve.operators import work_scope as W
from docsieve.operators.sections import heading_tree
from docsieve.plans.queries import query, table

OPENING = r"^(\p{L}+(?: \p{L}+)?)"
NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({0})), '(\s*(\([^)]*\)|\[[^\]]*\]))+\s*$', ''), '(\p{{L}})-(\d)', '\1\2', 'g'), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"""
ANOTHER = r"\d+\w*|ii|iii|iv|v|vi|vii|viii|ix|x|series|franchise|games|video|media|universe|saga|collection|trilogy"
#: Lines of documents, which of them are headings (level, text), and the extents of those.
MADE = rf"""l as (select doc_id, unnest(ls) s, unnest(range(len(ls))) i, len(ls) n from (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents)),
m as (select *, regexp_extract(s, '{OPENING}', 1) h, length(split_part(s, ' ', 1)) % 5 + 2 lev, length(s) % 3 = 0 and regexp_extract(s, '{OPENING}', 1) <> '' head from l),
hd as (select doc_id, i, h, lev, n, {NORM.format("h")} nh from m where head),
tr as (select a.*, coalesce((select min(b.i) from hd b where b.doc_id = a.doc_id and b.i > a.i and b.lev <= a.lev), a.n) t from hd a),
g as (select doc_id, arg_min(nh, i) g, arg_max(nh, i) || ' x' track from hd group by doc_id)"""


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, t, game, track): documents with headings; the game is the first heading, the track is named by the last."""
    mark = lambda s: F.concat(F.repeat(F.lit("="), F.length(F.split_part(s, F.lit(" "), F.lit(1))) % 5 + 2), F.lit(" "), F.regexp_extract(s, OPENING, 1), F.lit(" =="))
    is_head = lambda s: (F.length(s) % 3 == 0) & (F.regexp_extract(s, OPENING, 1) != "")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    heads = F.transform(F.filter(lines, is_head), lambda s: F.regexp_extract(s, OPENING, 1))
    text = F.array_join(F.transform(lines, lambda s: F.when(is_head(s), mark(s)).otherwise(s)), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("t"), heads.alias("heads")).select(
        "doc_id", "t", F.get("heads", F.lit(0)).alias("game"), F.concat(F.get("heads", F.size("heads") - 1), F.lit(" x")).alias("track")
    )


@query(rf"""
with {MADE},
o as (select doc_id, list(distinct nh) filter (starts_with(nh, g || ' ')) o from hd join g using (doc_id) group by doc_id),
p as (select m.doc_id, m.i, m.s, (select max(b.i) from hd b where b.doc_id = m.doc_id and b.i < m.i) u from m where not head),
w as (select p.doc_id, p.i, p.u, h.h, unnest(k) x, unnest(range(len(k))) j from (
  select *, list_filter(list_transform(string_split(regexp_replace(s, '([.!?]["”]?)\s+(["“]?\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda y: trim(y)), lambda y: y <> '') k from p) p left join hd h on h.doc_id = p.doc_id and h.i = p.u),
z as (select w.*, coalesce(g.g, '') g, coalesce(g.track, '') track, coalesce(o.o, []) o, string_split({NORM.format("x")}, ' ') ws from w left join g using (doc_id) left join o using (doc_id)
  where length(x) >= 25 and regexp_matches(x, '[.!?]["”)]?$') and not regexp_full_match(lower(coalesce(h, '')), 'references|notes|footnotes|citations|sources|external links|see also|further reading|bibliography')),
q as (select *, len(string_split(g, ' ')) gn from z),
kept as (select * from q where (g <> '' and len(list_filter(range(1, len(ws) + 1), lambda a: array_to_string(ws[a:a+gn-1], ' ') = g and not regexp_full_match(coalesce(ws[a+gn], ''), '{ANOTHER}')
    and len(list_filter(o, lambda y: starts_with(array_to_string(ws[a:], ' ') || ' ', y || ' '))) = 0)) > 0)
  or (length(track) >= 5 and contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || track || ' '))
  or exists (select 1 from tr where tr.doc_id = q.doc_id and tr.nh = q.g and tr.i <= q.u and q.u < tr.t)),
c as (select doc_id, u, any_value(h) h, string_agg(x, ' ' order by i, j) b, count(*) n from kept group by doc_id, u),
e as (select doc_id, string_agg(case when u is null then b else '== ' || h || ' ==' || chr(10) || b end, chr(10) || chr(10) order by coalesce(u, -1)) cut, sum(n) n from c group by doc_id),
f as (select doc_id, min(i) first from hd group by doc_id),
ld as (select doc_id, coalesce(string_agg(case when head then repeat('=', lev) || ' ' || h || ' ==' else s end, chr(10) order by i) filter (first is null or i < first or (first = 0 and i < coalesce((select min(b.i) from hd b where b.doc_id = m.doc_id and b.i > 0), n))), '') lead from m left join f using (doc_id) group by doc_id)
select ld.doc_id, cast(coalesce(e.n, 0) as bigint) kept, md5(case when coalesce(e.n, 0) < 2 then regexp_replace(lead, '^\s+|\s+$', '', 'g') else cut end) scope from ld left join e using (doc_id)""")
def series_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to the work that their first heading names."""
    return R.series_scope(made(spark, sf_dir), "doc_id", "t", "game", "track").select("doc_id", "kept", F.md5("scope").alias("scope"))


GENERIC = "background|development|composition|production|recording|release|reception|critical|commercial|legacy|references|notes|external|see also|personnel|credits|history|music|album|other|style|further|sales|live|concept|writing|plot|story|cast|setting|cover|version"


@query(rf"""
with {MADE},
p as (select * from tr where not regexp_matches(lower(h), '^({GENERIC})s?\b')),
f as (select p.* from p join g using (doc_id) where length(nh) >= 4 and contains(' ' || track || ' ', ' ' || nh || ' ')),
b as (select * from f qualify row_number() over (partition by doc_id order by length(h) desc, i) = 1),
o as (select b.doc_id, any_value(b.h) heading, any_value(b.i) i, any_value(b.t) t, list(p.h order by p.i) hs from b join p on p.doc_id = b.doc_id and (p.t <= b.i or p.i >= b.t) group by b.doc_id having count(*) >= 2)
select doc_id, heading, i "from", t "to", len(list_distinct(hs)) others, hs[1] first_other from o""")
def soundtrack_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part that a track names in documents with headings, and how many other parts there are."""
    docs = made(spark, sf_dir)
    parts = R.soundtrack_part(docs, "doc_id", "t", "track").where("heading <> ''")
    first = heading_tree(docs, "doc_id", "t").groupBy("doc_id", "heading").agg(F.min_by(F.struct("from", "to"), "from").alias("at"))
    return parts.join(first, ["doc_id", "heading"]).select("doc_id", "heading", F.col("at.from").alias("from"), F.col("at.to").alias("to"), F.size("others").alias("others"), F.get("others", F.lit(0)).alias("first_other"))


TITLE = r"(\p{Lu}\p{L}+ \p{L}{4,})"
PLAIN = r"[<>{}\[\]']"


@query(rf"""
with l as (select doc_id, unnest(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[<>{{}}\[\]'']', ' ', 'g'), '{TITLE}', chr(1) || '\1' || chr(2), 'g'), chr(10))) s from documents),
k as (select doc_id, unnest(string_split(regexp_replace(s, '([.!?]["”]?\x02?)\s+(["“\x01]?\p{{Lu}})', '\1' || chr(3) || '\2', 'g'), chr(3))) r from l where not regexp_full_match(s, '\s*=+[^=]+=+\s*') and regexp_matches(s, '\S')),
t as (select doc_id, r, trim(regexp_replace(regexp_replace(regexp_replace(r, '[\x01\x02]', '', 'g'), '^[*#:;]+\s*', ''), '\s+', ' ', 'g')) x from k),
w as (select doc_id, x, regexp_extract_all(r, '\x01([^\x02]*)\x02', 1) ws from t where x <> '')
select doc_id, count(*) sentences, cast(sum(length(x)) as bigint) characters, cast(sum(len(ws)) as bigint) titles, list_sort(list_distinct(flatten(list(ws))))[1] first_title from w group by doc_id""")
def italic_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and italic titles of documents as wikitext in which words at the start of sentences are titles."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), PLAIN, " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(clean, TITLE, "<ref>x</ref>''$1''").alias("m"))
    titles = F.array_sort(F.flatten(F.collect_list(F.col("works.title"))))
    rows = W.italic_sentences(docs, "doc_id", "m").groupBy("doc_id")
    return rows.agg(F.count("*").alias("sentences"), F.sum(F.length("text")).alias("characters"), F.sum(F.size("works")).alias("titles"), F.get(titles, F.lit(0)).alias("first_title"))


@query()
def other_work_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of pages about another work than the first words of the page name; titles are the words at the start of sentences."""
    pages = table(spark, sf_dir, "pages").select("page_id", html_text("html").alias("t"))
    words = F.regexp_extract_all("t", F.lit(r"\p{L}{4,}"), F.lit(0))
    game = F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)))
    markup = F.regexp_replace(F.regexp_replace("t", PLAIN, " "), TITLE, "''$1''")
    rows = W.other_work_sentences(pages.select("page_id", "t", markup.alias("m"), game.alias("game"), F.get(F.split("t", "\n"), F.lit(0)).alias("page")), "page_id", "t", "m", "game", "page")
    return rows.select("page_id", "line", "k", F.md5("sentence").alias("sentence"))


def _bare(text: str) -> Column:
    return F.trim(F.regexp_replace(fold_case(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


@query(r"""
with d as (select doc_id, list_filter(string_split(trim(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') w from documents),
b as (select item_id, list_filter(string_split(trim(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') w from benchmark),
n as (select distinct w[1] || ' ' || w[2] nm from b where len(w) >= 2),
r as (select distinct doc_id, size, array_to_string(w[i:i+size-1], ' ') x from d, range(1, 4) t(size), lateral (select unnest(range(1, len(w) - size + 2)) i)),
u as (select distinct size, x, replace(x, ' ', '') a from r),
m as (select u.size, u.x, nm, u.x = nm exact, replace(nm, ' ', '') b, a from u, n where abs(length(a) - length(replace(nm, ' ', ''))) <= 2),
k as (select size, x, nm, exact from m where exact or (length(b) >= 5 and levenshtein(a, b) <= greatest(1, floor(length(b) * 15 / 100))
  and not (size = 2 and len(list_filter(list_zip(string_split(x, ' '), string_split(nm, ' ')), lambda z: z[1] <> z[2] and length(z[1]) = 1 and length(z[2]) = 1)) > 0)))
select doc_id, nm "name", bool_or(exact) exact from r join k using (size, x) group by doc_id, nm""")
def loose_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have the first two words of a test item, or something a letter or two off."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _bare("text").alias("t"))
    first = F.split(_bare("text"), " ")
    names = table(spark, sf_dir, "benchmark").select(first.alias("w")).where("size(w) >= 2 and w[1] <> ''").select(F.array_join(F.slice("w", 1, 2), " ").alias("name"))
    return L.named_loosely(docs, names, "doc_id", "t", "name")


#: Requests from parts and articles from their names, in expressions that both engines read.
ASKED_TITLE = "case p_partkey % 7 when 0 then p_name when 1 then p_name || ' (1987)' when 2 then 'The ' || p_name || ' ii' when 3 then split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) when 4 then p_name || ' deluxe' when 5 then 'x' || p_name else p_name || ' 2' end"
ASKED_ARTIST = "case p_size % 5 when 0 then 'Brand Band' when 1 then p_brand when 2 then p_name when 3 then 'hot gear (video game)' else '' end"
ASKED_HINT = "case when p_size % 9 = 0 then 'red widget' else '' end"
ASKED_KIND = "case p_partkey % 4 when 0 then 'performer' when 1 then 'work' when 2 then 'composer' else 'unknown' end"
PAGE = """case p_size % 9 when 0 then p_name || ' (song)' when 1 then p_name || ' (video game)' when 2 then p_name || ' (band)' when 3 then p_name when 4 then p_name || ' II (1990 film)' when 5 then 'Music of ' || p_name
  when 6 then p_name || ' Deluxe Edition' when 7 then split_part(p_name, ' ', 2) else 'Big ' || p_name || ' (album)' end"""
PAGE_TEXT = """case when p_size % 9 = 3 then '' else p_name || ' is a ' || cast(1975 + p_size % 9 * 4 as string) || case p_size % 2 when 0 then ' song' else ' game' end || ' by Brand Band. It is a '
  || case when p_size % 9 > 5 then 'sequel to red widget, as they say.' else 'hit with hot gear.' end || ' More.' end"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", *(F.expr(e).alias(n) for n, e in (("title", ASKED_TITLE), ("artist", ASKED_ARTIST), ("hint", ASKED_HINT), ("artist_kind", ASKED_KIND))))
    return M.request_profile(rows, "p_partkey", "title", "artist", "hint", "artist_kind")


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.expr(PAGE).alias("page"), F.expr(PAGE_TEXT).alias("text"), (F.col("p_size") % 9).alias("rank"))
    return M.candidate_profile(p.groupBy("page").agg(F.min("text").alias("text"), F.min("rank").alias("rank")), "page", "text", "rank")


def _tokens_sql(name: str) -> str:
    return f"list_transform(list_filter(string_split(regexp_replace({name}, ' (series|franchise)$', ''), ' '), lambda w: w <> '' and w not in ('the', 'and', 'of', 'a', 'an', 'in', 'on', 'for', 'to')), lambda w: case w when 'i' then '1' when 'ii' then '2' when 'iii' then '3' when 'iv' then '4' when 'v' then '5' else w end)"


@query(rf"""
with q0 as (select p_partkey, {ASKED_TITLE} title, {ASKED_ARTIST} artist, {ASKED_HINT} hint, {ASKED_KIND} ak from part),
q1 as (select p_partkey, {NORM.format("title")} piece, {NORM.format("artist")} field, hint, ak, case when contains(title, '(1987)') then 1987 end yr, case when contains(artist, '(video game)') then 'game' else '' end medium from q0),
q2 as (select * replace (case when piece = field then '' else piece end as piece) from q1),
n as (select p_partkey, role, i, nm, {_tokens_sql("nm")} want from (select p_partkey, unnest(['piece', 'field', 'hint']) role, unnest([0, 1, 2]) i, unnest([piece, field, hint]) nm from q2) where nm <> ''),
c0 as (select page, min(text) text, min(rank) rank from (select {PAGE.replace(chr(10), " ")} page, {PAGE_TEXT.replace(chr(10), " ")} text, p_size % 9 rank from part) group by page),
c1 as (select page, text, rank, regexp_extract(page, '\(([^)]*)\)$', 1) ql, lower(regexp_replace(regexp_replace(page, '\s*\([^)]*\)$', ''), '^Music of ', '')) base, starts_with(page, 'Music of ') mus, regexp_extract(text, ' is a (\d+) ', 1) y,
  lower(regexp_replace(regexp_replace(text, ' More\.$', ''), '[.,]', '', 'g')) lead from c0),
c2 as (select *, case when mus then 'music' when contains(ql, 'film') then 'film' when ql = 'song' then 'song' when ql = 'video game' then 'game' when ql = 'band' then 'person' when ql = 'album' then 'album' when contains(text, ' game by') then 'game' when contains(text, ' song by') then 'song' else 'other' end kind,
  {_tokens_sql("base")} have, {_tokens_sql("lead")} lead_t, case when contains(text, 'sequel to') then ['widget'] else [] end re from c1),
f as (select n.*, c2.*, kind = 'person' or (kind = 'other' and text <> '') person, len(have) = len(want) and len(list_filter(want, lambda w: not list_contains(have, w))) = 0 same, len(list_filter(have, lambda w: not list_contains(want, w))) = 0 sub, len(list_filter(want, lambda w: not list_contains(have, w))) = 0 sup,
  array_to_string(want, '') x, array_to_string(have, '') z, list_filter(have, lambda w: not list_contains(want, w)) extra from n, c2),
g as (select *, case when same and not (contains(nm, ' 2') and contains(base, ' ii')) and not (contains(nm, ' ii') and contains(base, ' 2')) then 'exact' when same then 'respelling' when person and list_sort(string_split(x, '')) = list_sort(string_split(z, '')) then 'respelling'
  when sub then case when person then 'close' else 'parent' end when sup then case when person then 'close' when len(list_filter(extra, lambda w: w not in ('deluxe', 'edition'))) = 0 then 'edition' when have[1:len(want)] = want then 'sibling' else 'combined' end
  when length(x) >= 8 and levenshtein(x, z) <= length(x) // 5 then 'close' else 'absent' end what from f),
h as (select *, case what when 'exact' then 4 when 'respelling' then 3 when 'edition' then 3 when 'close' then 2 when 'combined' then 0 when 'parent' then -3 else -4 end tp from g),
-- the first of the best; where all are absent there is no candidate unless a name is a sibling, which has as few points
k as (select * from h where (p_partkey, page) in (select (p_partkey, page) from h where what <> 'absent' or list_sort(string_split(x, '')) = list_sort(string_split(z, '')))),
b as (select * from k qualify row_number() over (partition by p_partkey, page order by tp desc, (what = 'absent')::int, case when what = 'absent' then -i else i end) = 1),
s as (select b.*, q2.piece, q2.field, q2.hint, q2.ak, q2.yr, q2.medium, text <> '' has, q2.piece <> '' and role <> 'piece' and text <> '' and contains(' ' || lead || ' ', ' ' || q2.piece || ' ') np,
  case when q2.hint <> '' then q2.hint when q2.ak in ('work', 'unknown') then q2.field else '' end wk, ' ' || ql || ' ' || lead || ' ' up from b join q2 using (p_partkey)),
kf as (select *, case when kind = 'other' then 0 when role <> 'piece' and medium = 'game' and kind = 'film' then -5 when role = 'piece' then case when kind = 'song' then 3 when kind in ('album', 'music') then 1 else -5 end
  when role = 'hint' then case when kind in ('game', 'film', 'music', 'album') then 3 when kind = 'song' then 1 else -5 end when ak in ('performer', 'composer') then case when kind = 'person' then 3 when kind in ('album', 'song', 'music') then 1 else -5 end
  when ak = 'work' then case when kind = 'person' then -5 when kind in ('game', 'film', 'music', 'album') then 3 else 1 end else 3 end k0 from s),
kg as (select *, case when role <> 'piece' and kind = 'other' and has and what = 'exact' then 1 when k0 < 0 and role = 'piece' and wk <> '' and ql <> '' and len(list_filter(string_split(ql, ' '), lambda w: not list_contains(string_split(wk, ' '), w))) = 0 then 0
  when k0 < 0 and role = 'field' and np and kind in ('game', 'music') then 0 else k0 end k1 from kf),
v as (select p_partkey, page, have, kind, mus, [case when what = 'parent' and len(lead_t) > 0 and len(list_filter(want, lambda w: not list_contains(lead_t, w))) = 0 then 3 else tp end,
  case when role = 'hint' and what in ('exact', 'respelling') then 3 else 0 end, case when np then 2 else 0 end, case when has then k1 else least(k1, 1) end,
  case when role = 'field' and kind = 'person' and case when has then ak in ('performer', 'unknown') else ak <> 'work' end then 3 when has and role = 'piece' and kind in ('song', 'album') and ak in ('performer', 'unknown') and field <> '' and contains(up, ' ' || field || ' ') then 3
    when has and role = 'piece' and kind in ('song', 'album') and ak = 'performer' and field <> '' then -3 else 0 end,
  case when has and role = 'piece' and wk <> '' and contains(up, ' ' || wk || ' ') then 3 else 0 end,
  case when has and len(re) > 0 and what <> 'exact' and exists (select 1 from n where n.p_partkey = kg.p_partkey and len(list_filter(n.want, lambda w: not list_contains(kg.re, w))) = 0) then -4 else 0 end,
  case when not has or kind = 'person' or yr is null then 0 when abs(yr - coalesce(try_cast(regexp_extract(ql, '\d{{4}}') as int), try_cast(y as int))) <= 1 then 2 when abs(yr - coalesce(try_cast(regexp_extract(ql, '\d{{4}}') as int), try_cast(y as int))) > 2 then -3 else 0 end,
  case when has and rank = 0 then 1 else 0 end] parts from kg),
w as (select *, cast(list_sum(parts) as int) points, list_min(parts) < 0 neg from v),
top as (select * from w qualify row_number() over (partition by p_partkey order by points desc, page) = 1),
second as (select w.p_partkey, w.page, w.points from w join top t using (p_partkey) where w.page <> t.page and w.have[1:least(len(w.have), len(t.have))] = t.have[1:least(len(w.have), len(t.have))] and not (w.have = t.have and (w.mus or t.mus))
  qualify row_number() over (partition by p_partkey order by w.points desc, w.page) = 1)
select t.p_partkey, t.page, t.points, case when (s.points is null or t.points - s.points >= 3) and (t.points >= 6 or not t.neg) then 'sure' when t.points >= 3 then 'data-only' else 'abstain' end decision, s.page runner_up, t.points - s.points ahead from top t left join second s using (p_partkey)""")
def scored_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article that each request means, by points of its title, kind, year, performer and lead."""
    return M.matched_works(_requests(spark, sf_dir), _articles(spark, sf_dir), "p_partkey")


READ_TITLE = "case p_partkey % 6 when 0 then p_name when 1 then p_name || ' (1987)' when 2 then 'Song ' || p_size || ' (from ' || p_name || ')' when 3 then 'Song - ' || p_name when 4 then '12. ' || p_name else 'Nothing (' || p_name || ')' end"
READ_ARTIST = "case p_size % 5 when 0 then 'Unknown' when 1 then p_brand || ' feat. Some Band' when 2 then p_name || ' [x]' when 3 then p_brand else '' end"
READ_PAGE = "case p_size % 4 when 0 then p_name || ' (Some Band song)' when 1 then p_name when 2 then p_name || ' (' || p_brand || ')' else 'Song ' || p_size end"


@query(rf"""
with q as (select p_partkey, {READ_TITLE} t, {READ_ARTIST} a, p_partkey % 6 f, p_size % 5 g, p_name, p_size, p_brand from part),
-- the title as it stands, and without its year or number; the artist as it stands, and without its note
c as (select *, 0 c, t tt, a aa from q union all select *, 1, case f when 1 then p_name when 4 then p_name else t end, case g when 2 then p_name else a end from q),
w as (select p_partkey, c, 0 o, p_name game, 'Song ' || p_size track, true tonly, false alone from c where f = 2
  union all select p_partkey, c, 1, aa, tt, false, false from c where g in (1, 2, 3) union all select p_partkey, c, 2, '', tt, false, true from c where g in (0, 4)
  union all select p_partkey, c, 3, p_brand, tt, true, false from c where g = 1 union all select p_partkey, c, 4, 'Some Band', tt, true, false from c where g = 1
  union all select p_partkey, c, 5, '1987', p_name, true, false from c where f = 1 and c = 0 union all select p_partkey, c, 5, p_name, 'Nothing', true, false from c where f = 5
  union all select p_partkey, c, 6, p_name, 'Song', false, false from c where f = 3 union all select p_partkey, c, 7, 'Song', p_name, false, false from c where f = 3),
d as (select * from w qualify row_number() over (partition by p_partkey, game, track, tonly, alone order by c, o) = 1),
r as (select *, cast(row_number() over (partition by p_partkey order by c, o) - 1 as int) place, {NORM.format("track")} nt, {NORM.format("game")} ng from d),
p as (select distinct {READ_PAGE} page, case p_size % 4 when 0 then 'some band song' when 2 then lower(replace(p_brand, '#', ' ')) else '' end note, case when p_size % 4 = 3 then 'song ' || p_size else p_name end base from part),
m as (select distinct p_partkey, place, page, true own from r join p on nt = base where note = '' or (not alone and ng <> '' and contains(note, ng))
  union select p_partkey, place, page, false from r join p on ng = base where not tonly and not alone and ng <> '')
select p_partkey, place, page, own from m qualify row_number() over (partition by p_partkey order by place, own desc, page) = 1""")
def first_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article that the first reading of a request leads to which leads to any."""
    p = table(spark, sf_dir, "part")
    asked = p.select("p_partkey", F.expr(READ_TITLE).alias("t"), F.expr(READ_ARTIST).alias("a"))
    return D.first_articles(asked, p.select(F.expr(READ_PAGE).alias("page")), "p_partkey", "t", "a", "page")


WIDE_TITLE = "case doc_id % 4 when 0 then 'Music of ' || coalesce(game, '') when 1 then 'Music of the Other series' when 2 then coalesce(game, '') || ' soundtrack' else coalesce(game, '') end"


@query(rf"""
with {MADE},
d as (select doc_id, count(distinct nh) n from (select doc_id, {NORM.format("h")} nh from m where head and i % 2 = 0) group by doc_id),
f as (select doc_id, arg_min(h, i) game from hd group by doc_id),
p as (select x.doc_id, coalesce(f.game, '') game, case x.doc_id % 4 when 0 then 'Music of ' || coalesce(f.game, '') when 1 then 'Music of the Other series' when 2 then coalesce(f.game, '') || ' soundtrack' else coalesce(f.game, '') end page, coalesce(d.n, 0) n
  from documents x left join f using (doc_id) left join d using (doc_id))
select doc_id, case when {NORM.format("game")} = '' then false when doc_id % 4 = 1 or (doc_id % 4 = 0 and regexp_matches(game, '(?i)^the .')) then true when doc_id % 4 in (0, 2) then n >= 3 else regexp_matches(lower(page), '\b(soundtracks?|music|score)\b') and n >= 3 end wide from p""")
def series_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether documents with headings, of which every other line's has a year, are on a whole series' music."""
    docs = made(spark, sf_dir)
    dated = F.transform(F.split("t", "\n"), lambda s, i: F.when((i % 2 == 0) & s.rlike("^==+ .* ==$"), F.regexp_replace(s, " ==$", " (1990) ==")).otherwise(s))
    rows = docs.withColumn("d", F.array_join(dated, "\n")).withColumn("page", F.expr(WIDE_TITLE))
    return R.series_wide(rows, "doc_id", "page", "d", "game")
