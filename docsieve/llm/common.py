"""What several operators of this subpackage share: shared-folder tables, Arrow access, word and shingle hashes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
SLICE_BYTES = 1 << 20
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_rng = np.random.Generator(np.random.PCG64(20240607))
#: Random value of each byte, the base of the polynomial and the multipliers of a word's place in a shingle.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = U(0x9E3779B97F4A7C15 | 1)
PLACE = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, np.uint64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests on one machine), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage and outlives executors.

    batch_rows is the number of rows of an Arrow batch meanwhile, for rows of several texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docsieve-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_ROWS)
    try:
        if batch_rows:
            spark.conf.set(ARROW_ROWS, str(batch_rows))
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives freed memory back: workers are used again by tasks of quite other needs."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return held


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 4096), BASE, np.uint64))])
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row's begin and end (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes (a longer row stands alone)."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes other than white space, and the row it is in; no word spans rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    gap = SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = gap[:-1]
    inner = at[:-1][at[:-1] < len(data)]
    first[inner] = True
    starts = np.flatnonzero(first & ~gap)
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = gap[1:]
    last[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(last & ~gap) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of every word of words(data, ...), after the byte map `fold`."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    begin = int(starts[0])
    held = data[begin:]
    place = np.arange(len(held)) - np.repeat(starts - begin, np.diff(np.append(starts - begin, len(held))))
    gap = SPACE[held]
    place[gap] = 0
    value = BYTE_VALUE[fold[held]] * powers(int(place.max()) + 1)[place]
    value[gap] = 0
    return mix(np.add.reduceat(value, starts - begin))


def shingle_hashes(word: np.ndarray, row: np.ndarray, n_rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of a row and their rows; a row of fewer words has its whole sequence as one."""
    n = len(word)
    count = np.bincount(row, minlength=n_rows) if n else np.zeros(n_rows, np.int64)
    out, rows = [], []
    if n >= k:
        h = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            h += word[i : n - k + 1 + i] * PLACE[i]
        ok = row[: n - k + 1] == row[k - 1 :]
        out.append(mix(h[ok]))
        rows.append(row[: n - k + 1][ok])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(row, short)
        h = mix(count[short].astype(np.uint64))
        for i in range(k - 1):
            more = count[short] > i
            h[more] += word[first[more] + i] * PLACE[i]
        out.append(mix(h))
        rows.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, r = np.concatenate(out), np.concatenate(rows)
    order = np.argsort(r, kind="stable")
    return h[order], r[order]


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of runs of rows i..j: (i, j, distinct shingle hashes in order of row and hash, where each row's begin and end)."""
    data, at = text_bytes(column)
    for i, j in slices(at):
        part, local = data[at[i] : at[j]], at[i : j + 1] - at[i]
        starts, _, row = words(part, local)
        h, r = shingle_hashes(word_hashes(part, starts), row, j - i, k)
        cut = np.searchsorted(r, np.arange(j - i + 1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            h[a:b].sort()
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        h, r = h[keep], r[keep]
        yield i, j, h, np.searchsorted(r, np.arange(j - i + 1))


def segment_sums(value: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of value between neighbours of cut."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return total[cut[1:]] - total[cut[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
