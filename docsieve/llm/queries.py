"""The contract's queries, thin over the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docsieve.llm.common import read
from docsieve.llm.decontaminate import overlaps
from docsieve.llm.jaccard_join import jaccard_components
from docsieve.llm.licenses import scan_licenses
from docsieve.llm.lm_scoring import lm_scores
from docsieve.llm.mixing import mix_sources
from docsieve.llm.secrets import scan_secrets
from docsieve.llm.spelling import spelling_groups
from docsieve.llm.suffix_dedup import remove_repeats
from docsieve.llm.token_output import token_output
from docsieve.llm.topk import top_k
from docsieve.llm.toxicity import toxicity
from docsieve.llm.url_filter import judge_urls
from docsieve.llm.whitening import whitening


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(read(spark, sf_dir, "embeddings"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_top_k": op2_top_k,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_secret_scan": op6_secret_scan,
    "op7_mix_sources": op7_mix_sources,
    "op8_token_output": op8_token_output,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_spelling_groups": op11_spelling_groups,
    "op12_whitening": op12_whitening,
    "op13_lm_score": op13_lm_score,
}

ORACLE_SQL = {
    "op2_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) score from v q, v c
  where q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e))
select query_id, row_number() over (partition by query_id order by score desc, vec_id) rank, vec_id, score from p qualify rank <= 10""",
    "op9_jaccard_join": r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end s from w),
n as (select doc_id, len(s) n from s), e as (select doc_id, unnest(s) x from s),
p as (select a.doc_id a, b.doc_id b, count(*) k from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
both_ways as (select a, b from l union all select b, a from l),
reach as (select doc_id, doc_id c from n union select b.b, r.c from reach r join both_ways b on b.a = r.doc_id)
select doc_id, any_value(n) n_shingles, min(c) component_id from reach join n using (doc_id) group by doc_id""",
    "op10_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select doc_id, i, md5(substr(h, 2 * i + 1, 200)) x from (select doc_id, h, unnest(range(len(h) // 2 - 99)) i from d where len(h) >= 200)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by x order by doc_id, i) k from w) where k > 1),
g as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 100, true) new from r),
u as (select doc_id, i, sum(new::int) over (partition by doc_id order by i) s from g),
sp as (select doc_id, s, min(i) a, max(i) + 100 b from u group by 1, 2),
k as (select doc_id, s, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) p from sp),
t as (select doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) kept, sum(b - a) n, count(*) c from k join d using (doc_id) group by 1)
select d.doc_id, len(h) // 2 n_bytes, cast(coalesce(t.n, 0) as bigint) n_removed, coalesce(t.c, 0) n_spans, sha256(unhex(coalesce(t.kept, h))) kept_sha256 from d left join t using (doc_id)""",
    # Edits by deleted and by masked letters, crc32 byte by byte from a table made by its rule.
    "op11_spelling_groups": r"""
with recursive r as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) w from documents),
d as (select coalesce(cast(doc_id as varchar), '') || ':' || w k, w, count(*) c from r group by all),
t as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by i) t from range(256) x(i)),
b as (select k, w, c, list_transform(range(len(hex(encode(k))) // 2), lambda i: cast('0x' || substr(hex(encode(k)), 2 * i + 1, 2) as bigint)) b from d),
h as (select w, c, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8))) h from b, t),
m as (select case when h % 199 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end w, c from h),
v as (select w, cast(sum(c) as bigint) n from m where length(w) >= 6 group by w having sum(c) >= 5),
e as (select w, n, i, substr(w, 1, i) p, substr(w, i + 2) s from v, range(length(w)) x(i)),
near as (select a.w, b.w x, b.n from e a join e b on a.i = b.i and a.p = b.p and a.s = b.s and length(a.w) = length(b.w) and a.w <> b.w
  union select e.w, v.w, v.n from e join v on v.w = e.p || e.s union select v.w, e.w, e.n from e join v on v.w = e.p || e.s),
f as (select w, count(*) n_near, max(n) form_n, min(x) filter (n = best) form from (select *, max(n) over (partition by w) best from near) group by w),
g as (select v.w, v.n, coalesce(n_near, 0) n_near, case when form_n >= 5 * v.n then form end form, case when form_n >= 5 * v.n then form_n end form_n from v left join f using (w)),
c as (select w, w root, form next from g union all select c.w, g.w, g.form from c join g on g.w = c.next)
select g.w word, form, root, n, n_near, form_n from g join c using (w) where c.next is null""",
}
