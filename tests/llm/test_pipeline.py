"""The pipeline, and each stage on its own input, against plain versions."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docsieve.llm import decontaminate, mixing, toxicity
from tests.llm.test_operators import best_by_trying_all, brute_components, frame

pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=lambda r: r[0])


def overlap(text, items):
    """Whether along any diagonal of any item a stretch of enough tokens agrees, by trying all."""
    doc = next(decontaminate.tokens([text]))[2]
    for item in items:
        if len(item) < decontaminate.SHORT:
            continue
        for d in range(-len(item) + 1, len(doc)):
            a, b = max(0, d), min(len(doc), d + len(item))
            same = doc[a:b] == item[a - d : b - d]
            if same.sum() >= 5 and best_by_trying_all(same, len(item)):
                return True
    return False


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before = rows_of(docs)
    toxic = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{DIR}/labels.parquet")).collect() if r.predicted == 1}
    clean = pipeline.drop_toxic(spark, docs, DIR).cache()
    assert clean.columns == docs.columns and rows_of(clean) == [r for r in before if r[0] not in toxic]

    single = pipeline.drop_near_copies(spark, clean, DIR).cache()
    first = {i for i, _, c in brute_components(rows_of(clean)) if i == c}
    assert rows_of(single) == [r for r in rows_of(clean) if r[0] in first]

    apart = pipeline.drop_contaminated(spark, single, DIR).cache()
    items = [h[at[0] : at[1]] for x in spark.read.parquet(f"{DIR}/benchmark.parquet").collect() for *_, h, at in decontaminate.tokens([x.text])]
    small = [r for r in rows_of(single) if len(r[1]) < 1500][:40]
    kept = {r[0] for r in rows_of(apart)}
    assert all((r[0] in kept) != overlap(r[1], items) for r in small)

    mixed = pipeline.mix(spark, apart, DIR).cache()
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(apart)[0].collect()}
    assert mixed.columns == docs.columns
    assert {r[0]: len(r[1].split()) for r in rows_of(mixed)} == {i: n for i, n in taken.items() if n}

    enc, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in pipeline.write_ids(spark, mixed, DIR).collect()}
    for i, text, _ in rows_of(mixed):
        ids = [*enc.encode(text, add_special_tokens=False).ids, 0]
        assert got.pop(i) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_run_and_empty(spark):
    assert pipeline.run(spark, DIR).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    docs = frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0
