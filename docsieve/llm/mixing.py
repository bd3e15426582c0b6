"""Mixing of sources to target weights over fixed-length blocks of words.

The words of a source, its documents laid end to end, are cut into blocks. A source owes a number of blocks in
proportion to its target. Every output shard draws multinomial counts of sources for its slots; the few slots that a
source drew beyond what it owes go to those that drew less. The slots of a source are numbered over all shards and
mapped to its blocks by a pseudorandom permutation of their indexes, once per turn through the source; slots and
documents then meet by block index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.common import U, materialise, mix, released, text_bytes, words

BLOCK_WORDS, SHARD_SLOTS, STRIPES, GRID = 64, 4096, 512, 4096
WEIGHTS = (5, 2, 1)


def word_count() -> Column:
    """A text's number of words, runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): percent of all words shared by weight.

    Sources in code point order, null last, take the weights in turn. No target is above most times its source's
    size; what is beyond goes to the others by weight until none is above. One row a source, so it is small.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # The windows below run over one row a source, never over documents.
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    total = F.sum("source_size").over(Window.partitionBy()) * (percent / 100)
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = left / weight
    # The first source, by cap per weight, that the common level does not fill sets the level for it and all after it;
    # levels taken from later ones are lower.
    by = by.withColumn("level", F.when(level <= F.col("ratio"), level))
    level = F.max("level").over(Window.partitionBy())
    return by.select("source", "source_size", F.coalesce(F.least("cap", level * F.col("w")), F.col("cap")).alias("target"))


def place(sizes: DataFrame) -> DataFrame:
    """sizes and `first`: the place of a document's first word among the words of its source.

    Documents are laid in the order of (stripe, doc_id), a stripe being a hash of doc_id; a window runs over one
    stripe of one source, and a second one over the totals of a source's stripes.
    """
    striped = materialise(sizes.withColumn("stripe", F.pmod(F.xxhash64("doc_id"), F.lit(STRIPES)).cast("int")), "sizes")
    totals = striped.groupBy("source", "stripe").agg(F.sum("size").alias("n"))
    own = Window.partitionBy("source").orderBy("stripe")
    totals = totals.select(F.col("source").alias("s2"), F.col("stripe").alias("t2"), (F.sum("n").over(own) - F.col("n")).alias("before"))
    order = Window.partitionBy("source", "stripe").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    within = striped.withColumn("within", F.sum("size").over(order) - F.col("size"))
    held = within.join(totals, F.col("source").eqNullSafe(F.col("s2")) & (F.col("stripe") == F.col("t2")))
    return held.withColumn("first", F.col("before") + F.col("within")).drop("s2", "t2", "stripe", "before", "within")


def permuted(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """For each index below its size, the image under a permutation of 0..size-1 that the seed picks.

    A balanced Feistel network over the least even number of bits that holds size, stepped on until within it.
    """
    bits = np.maximum(2, np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64))
    half = ((bits + 1) // 2).astype(np.uint64)
    mask = (U(1) << half) - U(1)
    x, todo = index.astype(np.uint64), np.arange(len(index))
    out = x.copy()
    while len(todo):
        h, m, k = half[todo], mask[todo], seed[todo].astype(np.uint64)
        left, right = x[todo] >> h, x[todo] & m
        for r in range(4):
            left, right = right, left ^ (mix(right + mix(k + U(r + 1))) & m)
        x[todo] = (left << h) | right
        out[todo] = x[todo]
        todo = todo[x[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def draw(targets: DataFrame, seed: int, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, slot, sid, nth): the source of every slot and the slot's number among those of its source."""
    spark = targets.sparkSession
    order = Window.orderBy("sid")
    owed = targets.where("owed > 0").select("sid", "owed", (F.sum("owed").over(order) - F.col("owed")).alias("from"))
    owed = materialise(owed, "owed")
    n = owed.agg(F.sum("owed")).first()[0] or 0
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 65536)))
    slots = spark.range(0, n, 1, files).select((F.col("id") / shard_slots).cast("long").alias("shard"), (F.col("id") % shard_slots).alias("slot"))
    # A uniform number names a place among all owed blocks; places are found by a grid, so the join has equal keys.
    u = F.pmod(F.xxhash64(F.lit(seed), "shard", "slot"), F.lit(max(n, 1)))
    slots = slots.withColumn("at", u).withColumn("cell", (F.col("at") * GRID / F.lit(max(n, 1))).cast("long"))
    cell = lambda c: (c * GRID / F.lit(max(n, 1))).cast("long")
    cells = owed.select("sid", "owed", "from", F.explode(F.sequence(cell(F.col("from")), cell(F.col("from") + F.col("owed") - 1))).alias("cell"))
    drawn = slots.join(cells, "cell").where((F.col("at") >= F.col("from")) & (F.col("at") < F.col("from") + F.col("owed")))
    drawn = materialise(drawn.select("shard", "slot", "sid"), "drawn")
    counts = drawn.groupBy("shard", "sid").agg(F.count("*").alias("n"))  # the multinomial counts of each shard
    before = Window.partitionBy("sid").orderBy("shard")
    counts = counts.select("shard", "sid", (F.sum("n").over(before) - F.col("n")).alias("before"))
    in_shard = Window.partitionBy("shard", "sid").orderBy("slot")
    numbered = drawn.withColumn("k", F.row_number().over(in_shard) - 1).join(counts, ["shard", "sid"])
    numbered = numbered.select("shard", "slot", "sid", (F.col("before") + F.col("k")).alias("nth"))
    got = drawn.groupBy("sid").agg(F.count("*").alias("got"))
    tally = owed.join(got, "sid", "left").select("sid", "owed", F.coalesce("got", F.lit(0)).alias("got"))
    over = F.greatest(F.col("got") - F.col("owed"), F.lit(0))
    under = F.greatest(F.col("owed") - F.col("got"), F.lit(0))
    tally = tally.select("sid", "owed", "got", (F.sum(over).over(order) - over).alias("over"), (F.sum(under).over(order) - under).alias("under"))
    gaps = tally.where("owed > got").select(
        F.col("sid").alias("to"), "got", "under", F.explode(F.sequence(F.lit(0).cast("long"), F.col("owed") - F.col("got") - 1)).alias("i")
    )
    gaps = gaps.select((F.col("under") + F.col("i")).alias("gap"), "to", (F.col("got") + F.col("i")).alias("to_nth"))
    told = numbered.join(tally.select("sid", "owed", "over"), "sid")
    told = told.withColumn("gap", F.when(F.col("nth") >= F.col("owed"), F.col("over") + F.col("nth") - F.col("owed")))
    moved = told.where("gap is not null").join(gaps, "gap").select("shard", "slot", F.col("to").alias("sid"), F.col("to_nth").alias("nth"))
    return told.where("gap is null").select("shard", "slot", "sid", "nth").union(moved)


def mix_sources(docs: DataFrame, percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 17, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The mix as (documents, slots).

    documents: doc_id, source, size, source_size, target, taken, pieces (array of from, to, times: words of the
    document, by number, that the mix takes that often), one row for every row of docs. slots: shard, slot, sid,
    block, the order of the mix. A null text has size 0 and is never taken; a null source is a source of its own,
    after all others. Rows of one doc_id are separate documents, in the order of their sizes and then of a hash of
    their texts. Other columns are ignored; an empty table gives empty ones. The same rows and seed give the same mix.
    """
    sized = docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("tie"))
    placed = materialise(place(sized), "placed")
    blocks = F.ceil(F.col("source_size") / block_words)
    targets = source_targets(placed, percent, most, weights)
    owed = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * blocks)).otherwise(0).cast("long")
    sid = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    targets = materialise(targets.select("source", "source_size", "target", blocks.alias("blocks"), F.least(owed, most * blocks).alias("owed"), sid.alias("sid")), "targets")
    slots = draw(targets, seed, block_words)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sid, nth, n = (x.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "nth", "blocks"))
            turn = nth // n
            key = mix((sid.astype(np.uint64) << U(20)) + turn.astype(np.uint64) + mix(np.array([seed], np.uint64)))
            yield pa.RecordBatch.from_arrays([*x.select(["shard", "slot", "sid"]).columns, pa.array(permuted(nth % n, n, key))], ["shard", "slot", "sid", "block"])

    slots = slots.join(targets.select("sid", "blocks"), "sid").select("shard", "slot", "sid", "nth", "blocks")
    slots = materialise(slots.mapInArrow(released(index), "shard long, slot long, sid int, block long"), "slots")
    times = slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    told = targets.select(F.col("source").alias("s2"), "sid", "source_size", "target")
    held = placed.join(told, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    full = held.where("size > 0")
    block = F.explode(F.sequence((F.col("first") / block_words).cast("long"), ((F.col("first") + F.col("size") - 1) / block_words).cast("long")))
    met = full.select("sid", "first", "size", block.alias("block")).join(times, ["sid", "block"])
    start = F.greatest(F.col("block") * block_words - F.col("first"), F.lit(0))
    end = F.least((F.col("block") + 1) * block_words - F.col("first"), F.col("size"))
    met = met.select("sid", "first", start.alias("from"), end.alias("to"), "times")
    taken = met.groupBy("sid", "first").agg(
        F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("taken"), F.array_sort(F.collect_list(F.struct("from", "to", "times"))).alias("pieces")
    )
    # A document of some words is alone at its first word; those without words may share it, and take nothing.
    whole = full.join(taken, ["sid", "first"], "left")
    columns = ["doc_id", "source", "size", "source_size", "target"]
    whole = whole.select(*columns, F.coalesce("taken", F.lit(0)).alias("taken"), "pieces")
    none = held.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"), F.lit(None).cast(whole.schema["pieces"].dataType).alias("pieces"))
    return whole.union(none), slots


def mixed_documents(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The columns of docs, with text cut to the words that the mix takes; documents of which it takes none go.

    A document of which all is taken once keeps its text. Words taken twice follow once more after a line break; the
    white space within a run of taken words stays. n_chars is the number of characters of the new text.
    """
    names, given = docs.columns, docs
    # Other columns travel in a struct, so that their names never meet those used here.
    rest = [c for c in names if c not in ("doc_id", "text", "source", "n_chars")]
    docs = docs.select(*[c for c in ("doc_id", "text", "source", "n_chars") if c in names], F.struct(F.lit(0).alias("_"), *[F.col(c) for c in rest]).alias("mix_rest"))
    taken, _ = mix_sources(docs, **options)
    taken = taken.where("taken > 0").select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("size").alias("mix_n"), "pieces")
    n, ids, known = docs.agg(F.count("*"), F.countDistinct("doc_id"), F.count("doc_id")).first()
    if n == ids == known:
        held = docs.join(taken.select("mix_id", "pieces"), F.col("doc_id") == F.col("mix_id"))
    else:  # rows of one id are told apart by number, so that each meets one share of the mix
        marked = docs.withColumn("mix_size", word_count()).withColumn("mix_tie", F.xxhash64("text"))
        twin = Window.partitionBy("doc_id", "source", "mix_size").orderBy("mix_tie")
        other = Window.partitionBy("mix_id", "mix_source", "mix_n").orderBy("pieces")
        marked = marked.withColumn("mix_nth", F.row_number().over(twin))
        taken = taken.withColumn("mix_k", F.row_number().over(other))
        same = (
            F.col("doc_id").eqNullSafe(F.col("mix_id"))
            & F.col("source").eqNullSafe(F.col("mix_source"))
            & (F.col("mix_size") == F.col("mix_n"))
            & (F.col("mix_nth") == F.col("mix_k"))
        )
        held = marked.join(taken, same)

    @F.pandas_udf("string")
    def cut(text, pieces):  # noqa: ANN001, ANN202
        out = []
        for x, parts in zip(text, pieces, strict=True):
            raw = x.encode()
            data, at = text_bytes(pa.array([x]))
            starts, ends, _ = words(data, at)
            turns = []
            for turn in range(1, max(p["times"] for p in parts) + 1):
                runs = []
                for p in parts:
                    if p["times"] >= turn:
                        if runs and runs[-1][1] == p["from"]:
                            runs[-1][1] = p["to"]
                        else:
                            runs.append([p["from"], p["to"]])
                whole = len(runs) == 1 and runs[0] == [0, len(starts)]
                turns.append(x if whole else "\n".join(raw[starts[a] : ends[b - 1]].decode() for a, b in runs))
            out.append("\n".join(turns))
        return pd.Series(out, dtype="object")

    out = held.withColumn("text", cut("text", "pieces"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(given.schema["n_chars"].dataType))
    return out.select(*[F.col(f"mix_rest.{c}") if c in rest else c for c in names])
