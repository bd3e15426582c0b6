"""Exact top-k by inner product, after the three-phase uniform threshold algorithm (Cao and Wang, 2004).

The dimensions are cut into lists; a vector's score is the sum of its partial scores over the lists. In the first phase
every task gathers, for each query, the k entries that lead each list and resolves their scores: the k-th best of all
these is a safe cutoff. In the second the cutoff goes to all tasks, which go through one list after the other: a
vector that reaches the cutoff has a partial score of at least cutoff / lists in some list, so only such entries are
collected. In the third the partial scores of the collected entries in the other lists are computed, for these
entries alone, and those that reach the cutoff are returned and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.common import materialise, released

#: Lists, bytes of the queries of one pass over the vectors, queries and vectors that are multiplied at once.
LISTS, PASS_BYTES, BLOCK_QUERIES, ROWS = 2, 64 << 20, 2048, 2048
LONG = np.iinfo(np.int64)


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors null, or with null or non-finite components, are out."""
    whole = lambda x: F.floor(x.cast("double") * scale)
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", F.transform("embedding", whole).alias("v"))


def bounded(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether all inner products, and all their parts, are exact in double precision."""
    return not one.size or not two.size or float(np.abs(one.astype(float)).max()) * float(np.abs(two.astype(float)).max()) * one.shape[1] < 2**52


def products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of long integers, as int64; those beyond its range are held at its ends."""
    if not one.size or not two.size:
        return np.zeros((len(one), len(two)), np.int64)
    if bounded(one, two):
        return (one.astype(float) @ two.astype(float).T).astype(np.int64)
    exact = one.astype(object) @ two.astype(object).T
    return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


def resolved(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact inner products of row i of one and row i of two."""
    if bounded(one, two):
        return np.einsum("ij,ij->i", one.astype(float), two.astype(float)).astype(np.int64)
    exact = (one.astype(object) * two.astype(object)).sum(axis=1)
    return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


class Queries:
    """Ids and integer vectors of queries, in blocks of one length, and their cutoffs (the least long where there is none)."""

    def __init__(self, ids: list[int], vectors: list[list[int]], cutoff: dict[int, int] | None = None) -> None:
        self.by: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for n in sorted({len(v) for v in vectors}):
            own = [i for i, v in enumerate(vectors) if len(v) == n]
            for k in range(0, len(own), BLOCK_QUERIES):
                some = own[k : k + BLOCK_QUERIES]
                q_ids = np.array([ids[i] for i in some], np.int64)
                least = np.array([(cutoff or {}).get(int(q), LONG.min) for q in q_ids], np.int64)
                self.by.setdefault(n, []).append((q_ids, np.array([vectors[i] for i in some], np.int64).reshape(len(some), n), least))


def _blocks(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[slice]]]:
    """(query ids, queries, cutoffs, vec_ids, vectors, lists), in blocks of rows of one length."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            size = np.diff(part.column(1).offsets.to_numpy())
            for n in np.unique(size).tolist():
                if n not in queries.by:
                    continue
                rows = part.filter(pa.array(size == n))
                ids = rows.column(0).to_numpy(zero_copy_only=False)
                x = rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), n)
                cut = np.linspace(0, n, min(LISTS, max(1, n)) + 1).astype(int)
                for q_ids, q, cutoff in queries.by[n]:
                    yield q_ids, q, cutoff, ids, x, [slice(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _leaders(base: DataFrame, queries: Queries, k: int) -> DataFrame:
    """First phase: (query_id, score) of at most k gathered vectors of each task."""
    held = base.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for q_ids, q, _, ids, x, lists in _blocks(batches, held.value):
            lead = np.zeros((len(q), len(x)), bool)
            m = min(k + 1, len(x))  # one more, as a query's own vector may lead
            for one in lists:
                np.put_along_axis(lead, np.argpartition(-products(q[:, one], x[:, one]), m - 1, axis=1)[:, :m], True, axis=1)
            lead &= q_ids[:, None] != ids[None, :]
            i, j = np.nonzero(lead)
            score = resolved(q[i], x[j])
            at = np.searchsorted(i, np.arange(len(q) + 1))
            for n, query in enumerate(q_ids.tolist()):
                best[query] = np.sort(np.append(best.get(query, np.zeros(0, np.int64)), score[at[n] : at[n + 1]]))[-k:]
        for query, s in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), query)), pa.array(s)], ["query_id", "score"])

    return base.mapInArrow(released(run), "query_id long, score long")


def _sufficient(base: DataFrame, queries: Queries) -> DataFrame:
    """Second and third phase: (query_id, vec_id, score) of all vectors that reach the cutoff."""
    held = base.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, q, cutoff, ids, x, lists in _blocks(batches, held.value):
            share = cutoff // len(lists) + (cutoff % len(lists) > 0)  # the least whole number from cutoff / lists on
            gathered = q_ids[:, None] == ids[None, :]
            for one in lists:
                part = products(q[:, one], x[:, one])
                i, j = np.nonzero((part >= share[:, None]) & ~gathered)
                gathered[i, j] = True
                others = [two for two in lists if two != one]
                if bounded(q, x):
                    score = sum((resolved(q[i, two], x[j, two]) for two in others), start=part[i, j])
                else:  # parts held at the ends of a long do not add up
                    score = resolved(q[i], x[j])
                ok = score >= cutoff[i]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i][ok]), pa.array(ids[j][ok]), pa.array(score[ok])], ["query_id", "vec_id", "score"])

    return base.mapInArrow(released(run), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, block: int | None = None) -> DataFrame:
    """Per query (rows whose vec_id is divisible by `every`): query_id, rank (from 1), vec_id, score of the k best rows.

    Scores are inner products of floor(scale * x); ties go to the smaller vec_id; a query with fewer than k candidates
    gets all. Candidates are all rows but those of the query's own vec_id; repeated rows are candidates each, a
    repeated query id is one query with its least vector. Vectors null or with a null or non-finite component, and
    those of another length than the query's, take no part. Sums beyond a long are held at its ends. Queries go out
    for one pass over all rows in blocks of about 64 MB (`block` queries, if given). Other columns are ignored; an
    empty table gives an empty one.
    """
    base = materialise(integers(vectors, scale), "integers")
    asked = materialise(base.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n // (block or max(1, PASS_BYTES // (8 * max(width or 1, 1))))))
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        ids, vs = [x.vec_id for x in rows], [x.v for x in rows]
        lead = _leaders(base, Queries(ids, vs), k).withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
        cutoff = {x.query_id: x.score for x in lead.where(F.col("nth") == k).collect()}
        found = materialise(_sufficient(base, Queries(ids, vs, cutoff)), "found")
        out = found if out is None else out.union(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
