"""Whitens embeddings: exact centring, the Gram matrix of all rows by MLlib, a local eigendecomposition, one pass over the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import materialise

HALF = 20
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
Frames = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x): entries as floor(scale * entry), of vectors that are not null and hold only finite entries."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(e.isNotNull() & (F.size(e) > 0) & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda c: F.floor(scale * c)).alias("x"))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: in 64 bits where it fits, else in whole numbers of any size."""
    largest = max((abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    if largest * n + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(n: int, sums: list[int]) -> Frames:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"c": list((_deviations(np.stack(f["x"]), n, sums) / n).astype(float))})

    return run


def _squares(d: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exactly; None where it is beyond 64 bits."""
    if d.dtype != object and d.shape[1] * float(np.abs(d).max(initial=0)) ** 2 < 1 << 62:
        return (d * d).sum(axis=1).tolist()
    return [s if (s := sum(v * v for v in map(int, row))) < 1 << 63 else None for row in d]


def _whitened(n: int, sums: list[int], turn: np.ndarray) -> Frames:
    """vec_id, exact deviation and whitened entries; turn has the scaled components as columns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                d = _deviations(np.stack(f["x"]), n, sums)
                yield pd.DataFrame({"vec_id": f["vec_id"], "deviation": pd.array(_squares(d), dtype="Int64"), "w": list((d / n).astype(float) @ turn)})

    return run


def gramian(rows: DataFrame) -> np.ndarray:
    """Sum over rows of the products of every two entries; rows has c, an array of doubles."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("c").alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def whitening(vectors: DataFrame, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    vectors has vec_id and embedding; other columns are ignored. Means, covariance and components come from the distinct
    vectors; all that remain are whitened. identity_error is measured on the whitened distinct vectors. A component's sign
    is that in which its largest entry is positive.

    Null and empty vectors and those with null or infinite entries or NaN take no part, and of vectors of different lengths only
    those of the commonest (the longer among equals). Repeated rows and null ids stay, each as a row. Components without
    variance are left out, so that a table of equal vectors, like an empty one, gives no rows. deviation is null
    where it is beyond 64 bits.
    """
    spark = vectors.sparkSession
    x = scaled(vectors)
    length = x.groupBy(F.size("x").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    if length is None:
        return spark.createDataFrame([], RESULT)
    x = x.where(F.size("x") == length["k"])
    fit = materialise(x.select("x").distinct(), "distinct-vectors")
    n = fit.count()
    halves = fit.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.shiftright("v", HALF)).alias("high"), F.sum(F.col("v").bitwiseAND((1 << HALF) - 1)).alias("low"))
    sums = [(r["high"] << HALF) + r["low"] for r in sorted(halves.collect(), key=lambda r: r["k"])]
    variances, axes = np.linalg.eigh(gramian(fit.mapInPandas(_centred(n, sums), "c array<double>")) / n)
    total = float(variances.sum())
    order = [k for k in np.argsort(-variances, kind="stable")[:components] if variances[k] > 4 * len(sums) * np.finfo(float).eps * variances.max()]
    if not order:
        return spark.createDataFrame([], RESULT)
    axes = axes[:, order] * np.sign(axes[np.abs(axes[:, order]).argmax(axis=0), order])
    run = _whitened(n, sums, axes / np.sqrt(variances[order]))
    schema = "vec_id string, deviation long, w array<double>"
    seen = fit.select(F.lit("").alias("vec_id"), "x").mapInPandas(run, schema)
    second = gramian(seen.select(F.concat("w", F.array(F.lit(1.0))).alias("c"))) / n  # the column of ones gives the means
    mean = second[:-1, -1]
    error = float(np.abs(second[:-1, :-1] - np.outer(mean, mean) - np.eye(len(order))).max())
    shares = F.array(*(F.lit(float(variances[k]) / total) for k in order))
    ids = x.select(F.col("vec_id").cast("string").alias("vec_id"), "x")  # as text: pandas would round long ids beside nulls
    rows = ids.mapInPandas(run, schema).select(F.col("vec_id").cast("long").alias("vec_id"), "deviation", F.posexplode("w").alias("k", "whitened"))
    return rows.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
