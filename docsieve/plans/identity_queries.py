"""Registered query on many phrases in whole documents, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions.identity import phrase_hits
from docsieve.plans.queries import query, table

#: This project's own: short words of which all ordered pairs of two different ones are phrases.
SHORT = ("the", "and", "of", "on", "is", "it", "in", "are", "to", "for", "or", "as", "by", "that", "which", "le", "la", "de", "du", "et", "un", "que", "qui", "avec", "der", "die", "das", "und", "ist", "mit", "von", "el", "los", "en", "con", "una", "por")
PHRASES = [f"{a} {b}" for a in SHORT for b in SHORT if a != b]
_NAME = r"regexp_extract(coalesce(text, ''), '^(\p{L}+ \p{L}+)', 1)"
_WORD = r"[\p{L}\p{N}]"


@query(rf"""
with d as (select doc_id, coalesce(text, '') t, {_NAME} nm from documents),
m as (select doc_id, case when nm = '' then t else regexp_replace(regexp_replace(t, '([^\p{{L}}\p{{N}}])', '\1\1', 'g'), '(?i)(^|[^\p{{L}}\p{{N}}])' || replace(nm, ' ', '  ') || '([^\p{{L}}\p{{N}}]|$)', '\1' || repeat('x', length(nm)) || '\2', 'g') end t from d),
w as (select doc_id, unnest(k[1:len(k) - 1]) a, unnest(k[2:]) b from (select doc_id, regexp_split_to_array(t, '\s+') k from m) where len(k) > 1),
p as (select doc_id, regexp_extract(a, '{_WORD}+$') a, regexp_extract(b, '^{_WORD}+') b from w),
h as (select doc_id, lower(a) || ' ' || lower(b) p from p where lower(a) in {SHORT} and lower(b) in {SHORT} and lower(a) <> lower(b))
select doc_id, count(p) n_hits, count(distinct p) n_phrases from d left join h using (doc_id) group by doc_id""")
def phrase_hits_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often, and how many, of 1,332 phrases stand in each document outside of its name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", phrase_hits(F.col("text"), PHRASES, F.array(F.expr(_NAME.replace("\\", "\\\\")))).alias("h"))
    return docs.select("doc_id", F.size("h").cast("long").alias("n_hits"), F.size(F.array_distinct(F.transform("h", lambda h: h.phrase))).cast("long").alias("n_phrases"))
