"""The corpus pipeline: toxic documents go, one of each group of near copies stays, contaminated documents go, sources
are mixed to their target weights, and the result is written as token ids and read back."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm.common import read, shared_dir
from docsieve.llm.decontaminate import overlaps
from docsieve.llm.jaccard_join import jaccard_components
from docsieve.llm.mixing import mixed_documents
from docsieve.llm.token_output import token_output
from docsieve.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, learnt from docs and the labels, does not predict to be toxic."""
    told = toxicity(docs, read(spark, sf_dir, "labels")).where("predicted = 1").select(F.col("doc_id").alias("toxic_id")).distinct()
    return docs.join(told, docs["doc_id"] == told["toxic_id"], "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id, and every document without a group."""
    groups = jaccard_components(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("copy_id")).distinct()
    return docs.join(groups, docs["doc_id"] == groups["copy_id"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no test item."""
    hits = overlaps(docs, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(hits, docs["doc_id"] == hits["hit_id"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, as its new text."""
    return mixed_documents(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files of token ids."""
    return token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_ids", write_ids),
]

#: Learnt weights, pseudorandom permutations and a tokenizer are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
