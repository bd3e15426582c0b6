"""Scores texts with a byte-wise context tree (context-tree weighting) learnt from a part of the corpus.

Texts are scored as their lower-cased words joined by one blank and ended by a line feed, so that the model gives a
probability to the same sequence of tokens as the base of word counts beside it. A byte is told by eight binary
decisions. Each decision has a tree of its own over the bytes before; a node of the tree is a context of 0 to DEPTH bytes
with counts of zeros and ones, its Krichevsky-Trofimov estimate and the weighted mixture of that estimate with its
children's. The probability of a decision is the mixture's, over all depths at which its context was met in training.

Only counts matter to these mixtures, never the order of the texts, so the tree is built from a table of byte strings
(context and byte) and their counts. Spark gathers that table, and deals it over tasks by the nearest bytes. The levels nearest to
the root are DataFrame aggregates upwards and joins downwards; deeper levels are numpy inside a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import BASE, LOWER, SPACE, materialise, mix, released, slices, text_bytes, word_hashes

DEPTH = 5
#: Levels of contexts below these are built within tasks: below TOP nearest bytes at most 2**24 strings can follow.
TOP = DEPTH - 2
BLOCK = 32 << 20
PIECE = 4 << 20
STEP = 1 << 22
#: Strings of a task that builds trees, on average; and rows of values that are packed together.
BUCKET = 1 << 17
PACK = 1 << 21
END = int(mix(np.array([0x656E64], np.uint64)).view(np.int64)[0])
LEAD, END_BYTE = np.full(DEPTH, 10, np.uint8), np.full(1, 10, np.uint8)
FOLDED = np.where(SPACE, 32, LOWER).astype(np.uint8)

BLOCKS = "block long, row array<long>, doc_id array<long>, held array<boolean>, at array<long>, data binary"
REQUESTS = "block long, word boolean, key long, c long"
NODES = "ctx long, node int, n0 long, n1 long, lw double"
VALUES = "key long, value double"
PACKED = "block long, word boolean, keys binary, numbers binary"
SCORES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"


def log_gamma(x, log=np.log):
    """Logarithm of the gamma function of x >= 1/2, of arrays or of columns (with log=F.log)."""
    z, fall = x + 8, x
    for k in range(1, 8):
        fall = fall * (x + k)
    tail = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * z * z * z * z * z * z * z)
    return (z - 0.5) * log(z) - z + 0.5 * math.log(2 * math.pi) + tail - log(fall)


def log_kt(n0, n1, log=np.log):
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5, log) + log_gamma(n1 + 0.5, log) - log_gamma(n0 + n1 + 1.0, log) - math.log(math.pi)


def normalised(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Every row as DEPTH line feeds, its lower-cased words joined by blanks, and a line feed."""
    if not len(data):
        yield from (np.append(LEAD, END_BYTE) for _ in at[1:])
        return
    gap = SPACE[data]
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # the first gap after a word stands for all
    first = at[:-1][at[:-1] < len(data)]
    keep[first] = ~gap[first]
    text = FOLDED[data[keep]]
    begin = np.append(0, np.cumsum(keep))[at]
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        yield np.concatenate([LEAD, text[a : b - 1 if b > a and text[b - 1] == 32 else b], END_BYTE])


def _pieces(text: np.ndarray) -> Iterator[np.ndarray]:
    """A normalised row in pieces of about PIECE bytes that end after a blank; each begins with the DEPTH bytes before it."""
    begin = 0
    while begin + DEPTH < len(text):
        end = len(text)
        if end - begin > PIECE:
            gaps = np.flatnonzero(text[begin + PIECE :] == 32)
            end = begin + PIECE + int(gaps[0]) + 1 if len(gaps) else end
        yield text[begin:end]
        begin = end - DEPTH


def text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, held, text) into blocks of about BLOCK bytes of normalised text."""
    part, row, block = TaskContext.get().partitionId() << 36, 0, 0
    held: list[tuple[int, int | None, bool, np.ndarray]] = []
    size = 0

    def packed() -> pa.RecordBatch:
        at = np.concatenate([[0], np.cumsum([len(p[3]) for p in held])])
        raw = pa.compress(pa.py_buffer(np.concatenate([p[3] for p in held])), "zstd", asbytes=True)
        lists = [pa.array([[p[i] for p in held]], kind) for i, kind in ((0, pa.list_(pa.int64())), (1, pa.list_(pa.int64())), (2, pa.list_(pa.bool_())))]
        return pa.record_batch([pa.array([part + block], pa.int64()), *lists, pa.array([at], pa.list_(pa.int64())), pa.array([raw], pa.binary())], ["block", "row", "doc_id", "held", "at", "data"])

    for batch in batches:
        ids, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        data, at = text_bytes(batch.column(2))
        for i, j in slices(at):
            for k, text in enumerate(normalised(data[at[i] : at[j]], at[i : j + 1] - at[i]), i):
                for piece in _pieces(text):
                    held.append((part + row, ids[k], flags[k], piece))
                    size += len(piece)
                    if size >= BLOCK:
                        yield packed()
                        held, size, block = [], 0, block + 1
                row += 1
    if held:
        yield packed()


def _opened(batch: pa.RecordBatch | pa.Table, i: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of block i and where its pieces begin."""
    at = np.array(batch["at"][i].as_py(), np.int64)
    return np.frombuffer(pa.decompress(batch["data"][i].as_py(), int(at[-1]), "zstd"), np.uint8), at


def _strings(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of runs of pieces from i: (i, their byte strings as numbers, where each piece's begin).

    In a number the nearest byte of the context comes first and the byte itself last.
    """
    for i, j in slices(at, STEP):
        part, local = data[at[i] : at[j]], at[i : j + 1] - at[i]
        wide, n = part.astype(np.int64), len(part) - DEPTH
        g = wide[DEPTH - 1 : DEPTH - 1 + n].copy()
        for k in range(2, DEPTH + 1):
            g <<= 8
            g |= wide[DEPTH - k : DEPTH - k + n]
        g <<= 8
        g |= wide[DEPTH:]
        scored = np.ones(len(part), bool)
        for k in range(DEPTH):
            scored[local[:-1] + k] = False
        yield i, g[scored[DEPTH:]], local[:-1] - DEPTH * np.arange(j - i)


def _tokens(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words and of the end of each text, and the pieces they are in."""
    for i, j in slices(at, STEP):
        body, local = data[at[i] : at[j]].copy(), at[i : j + 1] - at[i]
        for k in range(DEPTH):  # the bytes before a piece are no part of its words
            body[local[:-1] + k] = 32
        gap = SPACE[body]
        starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        ends = np.flatnonzero(body[local[1:] - 1] == 10)
        piece = np.searchsorted(local, starts, "right") - 1
        yield np.concatenate([word_hashes(body, starts).view(np.int64), np.full(len(ends), END)]), i + np.concatenate([piece, ends])


def _counted(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each is in pieces that are learnt from (0 for others); found has keys and whether they are learnt."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for key, learnt in found:
        for some, weight in ((key[learnt], 1), (key[~learnt], 0)):
            k, c = np.unique(some, return_counts=True)
            keys.append(k)
            counts.append(c * weight)
    key, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, c = key[order], c[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(c, first) if len(first) else c


def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block its distinct byte strings and words, with their counts in texts that are learnt from."""
    for batch in batches:
        for i in range(batch.num_rows):
            data, at = _opened(batch, i)
            learnt = ~np.array(batch["held"][i].as_py(), bool)
            strings = ((g, np.repeat(learnt[a : a + len(first)], np.diff(np.append(first, len(g))))) for a, g, first in _strings(data, at))
            tokens = ((w, learnt[piece]) for w, piece in _tokens(data, at))
            for word, found in ((False, strings), (True, tokens)):
                key, c = _counted(found)
                for low in range(0, len(key), 1 << 16):
                    part = slice(low, low + (1 << 16))
                    n = len(key[part])
                    yield pa.record_batch([np.full(n, batch["block"][i].as_py()), np.full(n, word), key[part], c[part]], ["block", "word", "key", "c"])


class Lookup:
    """Numbers of distinct keys, found by a table of where the keys of each hash begin."""

    def __init__(self, key: np.ndarray, number: np.ndarray):
        bits = max(1, int(len(key)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        h = self._hash(key)
        order = np.argsort(h, kind="stable")
        self.key, self.number = key[order], number[order]
        self.first = np.searchsorted(h[order], np.arange(1 << bits)).astype(np.int32)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * BASE) >> self.shift).view(np.int64)

    def __getitem__(self, key: np.ndarray) -> np.ndarray:
        """Numbers of keys, all of which are known."""
        at = self.first[self._hash(key)]
        left = np.flatnonzero(self.key[at] != key)
        while len(left):
            at[left] += 1
            left = left[self.key[at[left]] != key[left]]
        return self.number[at]


class Trees:
    """The eight decisions' trees over contexts of TOP to DEPTH bytes, of the strings of some nearest TOP bytes."""

    def __init__(self, key: np.ndarray, c: np.ndarray):
        order = np.argsort(key)
        self.order, key, c = order, key[order], c[order]
        self.levels = {DEPTH: (key, c, None)}
        for d in range(DEPTH - 1, TOP - 1, -1):
            k, n, _ = self.levels[d + 1]
            key_d, up = np.unique((k >> 16 << 8) | (k & 255), return_inverse=True)
            self.levels[d] = (key_d, np.bincount(up, n, len(key_d)), up)

    def decision(self, j: int) -> dict[int, tuple]:
        """Of decision j at each depth: each string's node, and by node: context and prefix, counts, KT, mixture, first child's parent."""
        out, below = {}, None
        for d in range(DEPTH, TOP - 1, -1):
            key, c, up = self.levels[d]
            prefix = key >> (8 - j)
            first = np.append(True, prefix[1:] != prefix[:-1])
            node = np.cumsum(first) - 1
            ones = (key >> (7 - j)) & 1
            n1 = np.bincount(node, c * ones)
            n0 = np.bincount(node, c) - n1
            kt = log_kt(n0, n1)
            mixed = kt
            if below is not None:
                parent = np.zeros(below[0][-1] + 1, np.int64)
                parent[below[0]] = node[self.levels[d][2]]
                out[d + 1] += (parent,)
                mixed = math.log(0.5) + np.logaddexp(kt, np.bincount(parent, below[5], len(kt)))
            out[d] = below = (node, prefix[first], n0, n1, kt, mixed)
        return out

    def top(self) -> pa.RecordBatch:
        """The nodes of TOP bytes."""
        rows = []
        for j in range(8):
            _, prefix, n0, n1, _, mixed = self.decision(j)[TOP][:6]
            rows.append((prefix >> j, (1 << j) | (prefix & ((1 << j) - 1)), n0, n1, mixed))
        ctx, node, n0, n1, lw = (np.concatenate(x) for x in zip(*rows, strict=True))
        return pa.record_batch([ctx, node.astype(np.int32), n0.astype(np.int64), n1.astype(np.int64), lw], ["ctx", "node", "n0", "n1", "lw"])

    def values(self, place: np.ndarray, a: np.ndarray, r: np.ndarray, f: np.ndarray) -> np.ndarray:
        """log10 of each string's probability; place (context << 8 | node, in order) has what came down to the TOP nodes."""
        total = np.zeros(len(self.order))
        for j in range(8):
            nodes = self.decision(j)
            prefix = nodes[TOP][1]
            at = np.searchsorted(place, (prefix >> j << 8) | (1 << j) | (prefix & ((1 << j) - 1)))
            mass, rest, told = a[at], r[at], f[at]
            for d in range(TOP, DEPTH + 1):
                node, _, n0, n1, kt, mixed = nodes[d][:6]
                p = (n1 + 0.5) / (n0 + n1 + 1)
                told = np.where(n0 + n1 > 0, mass + rest * p, told)
                if d < DEPTH:
                    stop = np.exp(math.log(0.5) + kt - mixed)
                    parent = nodes[d + 1][6]
                    mass, rest, told = (mass + rest * stop * p)[parent], (rest * (1 - stop))[parent], told[parent]
            ones = (self.levels[DEPTH][0] >> (7 - j)) & 1
            p = told[node]
            total += np.log10(np.where(ones == 1, p, 1 - p))
        out = np.zeros(len(total))
        out[self.order] = total
        return out


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False)


def _top_nodes(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches([Trees(_numbers(table, "key"), _numbers(table, "c")).top()])


def _values(strings: pa.Table, state: pa.Table) -> pa.Table:
    key = _numbers(strings, "key")
    place = (_numbers(state, "ctx") << 8) | _numbers(state, "node")
    order = np.argsort(place)
    value = Trees(key, _numbers(strings, "c")).values(place[order], *(_numbers(state, x)[order] for x in "arf"))
    return pa.table({"key": key, "value": value})


def _mixed(kt: Column, below: Column) -> Column:
    return math.log(0.5) + F.greatest(kt, below) + F.log1p(F.exp(-F.abs(kt - below)))


def string_values(strings: DataFrame) -> DataFrame:
    """(key, value): log10 of the probability of each byte string's last byte after the others; strings has key and c."""
    n = strings.count()
    dealt = strings.withColumn("bucket", F.pmod(F.xxhash64(F.shiftright("key", 8 * (DEPTH - TOP) + 8)), F.lit(n // BUCKET + 1)))
    nodes = {TOP: materialise(dealt.groupBy("bucket").applyInArrow(_top_nodes, NODES), "nodes")}
    kt = log_kt(F.col("n0").cast("double"), F.col("n1").cast("double"), F.log)
    for d in range(TOP - 1, -1, -1):
        up = nodes[d + 1].groupBy(F.shiftright("ctx", 8).alias("ctx"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("below"))
        nodes[d] = up.select("ctx", "node", "n0", "n1", _mixed(kt, F.col("below")).alias("lw"))
    p = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    stop = F.exp(math.log(0.5) + kt - F.col("lw"))
    state = nodes[0].select("ctx", "node", F.lit(0.0).alias("a"), F.lit(1.0).alias("r"), F.lit(0.5).alias("f"))
    for d in range(TOP):
        told = F.when(F.col("n0") + F.col("n1") > 0, F.col("a") + F.col("r") * p).otherwise(F.col("f"))
        known = nodes[d].join(state, ["ctx", "node"]).select(F.col("ctx").alias("up"), "node", (F.col("a") + F.col("r") * stop * p).alias("a"), (F.col("r") * (1 - stop)).alias("r"), told.alias("f"))
        state = nodes[d + 1].select("ctx", "node", F.shiftright("ctx", 8).alias("up")).join(known, ["up", "node"]).select("ctx", "node", "a", "r", "f")
    state = state.withColumn("bucket", F.pmod(F.xxhash64("ctx"), F.lit(n // BUCKET + 1)))
    return dealt.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(_values, VALUES)


def packed_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word, key, value) rows into one row a block of each run of about PACK rows."""
    held: list[pa.RecordBatch] = []
    n = 0

    def out() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        block, word, key, value = (_numbers(table, x) for x in ("block", "word", "key", "value"))
        order = np.lexsort((key, word, block))
        block, word, key, value = block[order], word[order], key[order], value[order]
        cut = np.append(np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (word[1:] != word[:-1]))), len(block))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            steps = np.diff(key[a:b], prepend=np.int64(0))
            blobs = [pa.array([int(b - a).to_bytes(8, "little") + pa.compress(pa.py_buffer(x.view(np.uint8).reshape(-1, 8).T.copy()), "zstd", asbytes=True)], pa.binary()) for x in (steps, value[a:b])]
            yield pa.record_batch([pa.array([block[a]]), pa.array([bool(word[a])]), *blobs], ["block", "word", "keys", "numbers"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACK:
            yield from out()
            held, n = [], 0
    if n:
        yield from out()


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], 8 * n, "zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(kind).reshape(-1)


def _block_scores(tokens_in_all: float, distinct: float):
    def scores(blocks: pa.Table, values: pa.Table) -> pa.Table:
        told = {}
        for word in (False, True):
            rows = [i for i in range(values.num_rows) if values["word"][i].as_py() == word]
            keys = [np.cumsum(_unpacked(values["keys"][i].as_py(), np.int64)) for i in rows]
            numbers = [_unpacked(values["numbers"][i].as_py(), np.float64) for i in rows]
            told[word] = Lookup(np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*numbers, np.zeros(0)]))
        out = []
        for i in range(blocks.num_rows):
            data, at = _opened(blocks, i)
            n = len(at) - 1
            sums = {x: np.zeros(n) for x in ("score", "base", "tokens", "known")}
            for a, g, first in _strings(data, at):
                sums["score"][a : a + len(first)] = np.add.reduceat(told[False][g], first)
            for w, piece in _tokens(data, at):
                c = told[True][w]
                sums["base"] += np.bincount(piece, np.log10((c + 1) / (tokens_in_all + distinct + 1)), n)
                sums["known"] += np.bincount(piece, c > 0, n)
                sums["tokens"] += np.bincount(piece, minlength=n)
            whole = [pa.array(x.astype(np.int64)) for x in (sums["tokens"], sums["known"])]
            lists = [pa.array(blocks[x][i].as_py(), kind) for x, kind in (("row", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()))]
            out.append(pa.record_batch([*lists, *whole, sums["base"], sums["score"], np.diff(at) - DEPTH], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"]))
        kinds = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])
        return pa.Table.from_batches(out, kinds)

    return scores


def lm_scores(docs: DataFrame, parts: int = 7, held_part: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte): one row a row of docs.

    docs has doc_id and text; other columns are ignored. Texts are learnt from unless crc32 of the id, as text, modulo
    `parts` is held_part; all are scored. score is log10 of the probability of the whole text, as lower-cased words
    joined by single blanks with an end; bits_per_byte is the code length of that form for each of its bytes.
    base_score is the contract's: of word counts with 1 added.

    Null and empty texts, and texts of white space, have the end as their one token. A null id counts as the text '' when
    parts are dealt. Repeated rows and repeated ids are learnt and scored each by itself. A very long text is scored in pieces
    with the bytes before each, and summed. An empty table gives an empty one. Where nothing is learnt, every decision
    has the probability 1/2 and every token counts as unknown.
    Words are counted under a 64-bit hash.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(parts)) == held_part
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.col("text").cast("string").alias("text"))
    blocks = materialise(texts.mapInArrow(released(text_blocks), BLOCKS), "blocks", 256)
    asked = materialise(blocks.mapInArrow(released(requests), REQUESTS), "requests", 1)
    counts = materialise(asked.groupBy("word", "key").agg(F.sum("c").alias("c")), "counts")
    n, distinct = counts.where("word").agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    n, distinct = n or 0, distinct or 0
    values = string_values(counts.where("not word").select("key", "c")).select(F.lit(False).alias("word"), "key", "value")
    values = values.union(counts.where("word").select("word", "key", F.col("c").cast("double").alias("value")))
    values = materialise(values, "values").hint("shuffle_hash")
    told = asked.select("block", "word", "key").join(values, ["word", "key"]).select("block", "word", "key", "value")
    told = told.mapInArrow(released(packed_values), PACKED)
    scored = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_block_scores(float(n), float(distinct)), SCORES)
    rows = scored.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("held_out").alias("held_out"),
        *(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score", "n_bytes")),
    )
    bits = -F.col("score") * math.log2(10) / F.col("n_bytes")
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
