"""Token ids of a corpus as files of rANS frames, and their reader."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsieve.llm.common import materialise, released, shared_dir
from docsieve.llm.rans import BLOCK_IDS, Table, crc32_combine, decode, encode
from docsieve.llm.tokens import encoder

FILE_IDS = 1 << 23
FRAMES = "part long, block long, n_ids long, piece long, pieces long, doc_ids array<long>, sizes array<long>, frame binary"


def tokenise(docs: DataFrame, vocabulary: str, end: int = 0) -> DataFrame:
    """(doc_id, n, ids) of every row: little-endian ids of 2 bytes, or 4 for a vocabulary of more than 65,536."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids, at = enc.encode([x or "" for x in part.column(1).to_pylist()], end)
                raw, w = ids.tobytes(), ids.itemsize
                held = pa.array([raw[a * w : b * w] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), held], ["doc_id", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n long, ids binary")


def count_ids(tokens: DataFrame, width: int, size: int) -> np.ndarray:
    """How often each id occurs in the whole corpus."""
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                if x.as_buffer().size:
                    total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=size) if x.as_buffer().size > 4096 else 0
            small = b"".join(x.as_py() for x in batch.column(0) if x.as_buffer().size <= 4096)
            total += np.bincount(np.frombuffer(small, kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(released(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for x in rows:
        out[x.id] = x.n
    return out


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = 0) -> None:
    """Writes path/table (id, freq) and path/frames: one row per rANS frame, in files that follow each other by doc_id.

    A frame holds whole documents, about 262,144 ids; a longer document has frames of its own (piece of pieces).
    """
    enc = encoder(vocabulary)
    width, size = np.dtype(enc.kind).itemsize, enc.tokenizer.get_vocab_size()
    tokens = materialise(tokenise(docs, vocabulary, end), "tokens")
    table = Table.of(count_ids(tokens, width, size))
    spark = docs.sparkSession
    freq = table.freq.astype(np.int64)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    files = max(1, -(-total // FILE_IDS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_IDS)))
    held = spark.sparkContext.broadcast(table.freq)
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, block = Table(held.value), TaskContext.get().partitionId(), 0
        docs_, sizes, parts, held_ids = [], [], [], 0

        def frame(ids: np.ndarray, doc_ids: list, sizes: list, piece: int, pieces: int) -> pa.RecordBatch:
            row = [part, block, len(ids), piece, pieces, doc_ids, sizes, encode(ids, table)]
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
            names = ["part", "block", "n_ids", "piece", "pieces", "doc_ids", "sizes", "frame"]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, kind).astype(np.int64)
                if parts and held_ids + len(ids) > BLOCK_IDS:
                    yield frame(np.concatenate(parts), docs_, sizes, 0, 1)
                    block, docs_, sizes, parts, held_ids = block + 1, [], [], [], 0
                if len(ids) > BLOCK_IDS:
                    pieces = -(-len(ids) // BLOCK_IDS)
                    for i in range(pieces):
                        one = ids[i * BLOCK_IDS : (i + 1) * BLOCK_IDS]
                        yield frame(one, [doc], [len(one)], i, pieces)
                        block += 1
                else:
                    docs_.append(doc)
                    sizes.append(len(ids))
                    parts.append(ids)
                    held_ids += len(ids)
        if parts:
            yield frame(np.concatenate(parts), docs_, sizes, 0, 1)

    dealt = tokens.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "n", "ids")
    dealt.select("doc_id", "ids").mapInArrow(released(run), FRAMES).write.option("compression", "none").parquet(f"{path}/frames")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, decoded frame by frame.

    start counts the ids of all documents before it. Pieces of a long document are joined by combining checksums.
    """
    rows = spark.read.schema("id long, freq long").parquet(f"{path}/table").collect()
    freq = np.zeros(max((x.id for x in rows), default=0) + 1, np.uint64)
    for x in rows:
        freq[x.id] = x.freq
    size = spark.read.parquet(f"{path}/table").count()
    assert size == len(rows)
    frames = spark.read.schema(FRAMES).parquet(f"{path}/frames")
    held = spark.sparkContext.broadcast(freq)
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = Window.partitionBy("part").orderBy("block")
    index = frames.select("part", "block", (F.sum("n_ids").over(own) - F.col("n_ids")).alias("within")).join(parts, "part")
    index = index.select("part", "block", (F.col("before") + F.col("within")).alias("first"))
    schema = "part long, block long, nth long, piece long, pieces long, doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(held.value)
        for batch in batches:
            for x in batch.to_pylist():
                ids = decode(x["frame"], table).astype("<u4")
                sizes = np.array(x["sizes"], np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                n = len(sizes)
                cols = [[x["part"]] * n, [x["block"]] * n, range(n), [x["piece"]] * n, [x["pieces"]] * n, x["doc_ids"], ends - sizes + x["first"], sizes, crc]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], schema.replace(" long", "").split(", "))

    read = frames.join(index, ["part", "block"]).select("part", "block", "first", "piece", "pieces", "doc_ids", "sizes", "frame").mapInArrow(released(run), schema)
    read = materialise(read, "decoded")  # a row a document, so that frames are decoded once
    keep = ["doc_id", "start", "n_tokens", "ids_crc32"]

    @F.pandas_udf("long")
    def joined(parts):  # noqa: ANN001, ANN202
        out = []
        for pieces in parts:
            crc = 0
            for p in sorted(pieces, key=lambda p: p["piece"]):
                crc = crc32_combine(crc, p["ids_crc32"], 4 * p["n_tokens"])
            out.append(crc)
        return pd.Series(out, dtype="int64")

    long = read.where("pieces > 1").withColumn("head", F.col("block") - F.col("piece"))
    long = long.groupBy("part", "head", "doc_id").agg(
        F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.collect_list(F.struct("piece", "ids_crc32", "n_tokens")).alias("held")
    )
    return read.where("pieces = 1").select(*keep).union(long.select("doc_id", "start", "n_tokens", joined("held").alias("ids_crc32")))


def token_output(docs: DataFrame, vocabulary: str, end: int = 0) -> DataFrame:
    """Writes the ids of all rows to new files in the shared folder and returns what is read back from them.

    Texts are encoded whole without special tokens and closed by `end`; a null text is empty, so has `end` alone. Rows
    are in ascending doc_id order, a null id first; rows of one id follow by their number of ids and then by the ids.
    Every row gives a row. Other columns are ignored; an empty table gives an empty one.
    """
    path = f"{shared_dir(docs.sparkSession)}/docsieve-ids-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary, end)
    return read_tokens(docs.sparkSession, path)
