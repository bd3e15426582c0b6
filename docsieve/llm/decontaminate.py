"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask of token positions: the tokens it keeps are hashed, those it skips may differ. Two texts that share
16 tokens in a row with at most 3 of them substituted share a seed of one of the masks (tests enumerate this). Hashes
of test items meet those of the documents; a hit names a document, an item and a diagonal, along which the two are
compared token by token and the best stretch is kept if enough of it agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import PLACE, U, mix, released, signed, slices, text_bytes, word_hashes, words

#: Positions that each mask keeps (fixed values, found by trying masks of five tokens: each skips some positions, and
#: no pattern of 1 substitution in 10 tokens, 2 in 12, 3 in 15 or 16 or 4 in 20 is missed).
MASKS = ((0, 1, 2, 3, 5), (0, 1, 2, 3, 6), (0, 2, 4, 5, 8))
#: The most seeds of test items sent to every task (8 bytes each, and as much again for tokens); beyond, seeds are joined.
SEND_MOST = 1 << 21
MIN_TOKENS, MIN_SHARE, SHORT = 10, 0.8, 5
HIT_BITS = 1 << 22
_table = np.arange(256, dtype=np.uint8)
_table[[i for i in range(128) if not chr(i).isalnum()]] = 32
PLAIN = bytes(_table)


def tokens(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of runs of texts i..j: (i, j, token hashes, where each text's begin and end). Tokens are runs of letters and
    digits of the lower-cased text; characters beyond ASCII count as letters."""
    raw = [(x or "").lower().encode().translate(PLAIN) for x in texts]
    data, at = text_bytes(pa.array(raw, pa.binary()))
    for i, j in slices(at):
        part, local = data[at[i] : at[j]], at[i : j + 1] - at[i]
        starts, _, row = words(part, local)
        yield i, j, word_hashes(part, starts, np.arange(256, dtype=np.uint8)), np.searchsorted(row, np.arange(j - i + 1))


def seeds(word: np.ndarray, at: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every place of a mask within one text."""
    kept = MASKS[mask]
    span = kept[-1] + 1
    n = len(word) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, mask + 1, np.uint64)
    for i, k in enumerate(kept):
        h += word[k : n + k] * PLACE[i]
    pos = np.arange(n)
    row = np.searchsorted(at, pos, "right")
    ok = pos + span <= at[np.minimum(row, len(at) - 1)]
    return mix(h[ok]), pos[ok]


def short_seeds(word: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of all runs of `size` tokens within one text, for items too short for MIN_TOKENS."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, 1000 + size, np.uint64)
    for k in range(size):
        h = mix(h) + word[k : n + k]
    pos = np.arange(n)
    row = np.searchsorted(at, pos, "right")
    ok = pos + size <= at[np.minimum(row, len(at) - 1)]
    return mix(h[ok]), pos[ok]


def best_stretch(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(tokens that agree, first place in doc, end) of a stretch along doc position - item position = diagonal in which
    at least 4 of 5 agree: the one that scores most, 1 for a token that agrees and -4 for another, if enough agree in
    it, else the one in which most agree. Of equals, the first."""
    a, b = max(0, diagonal), min(len(doc), diagonal + len(item))
    same = doc[a:b] == item[a - diagonal : b - diagonal]
    total = np.append(0, np.cumsum(np.where(same, 1, -4)))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmin(total[: end + 1]))
    if not enough(agree := int(same[start:end].sum()), len(item)):
        # The longest stretch up to each end whose score is not below zero begins where the lowest score so far first is that low.
        agreed = np.append(0, np.cumsum(same))
        begin = np.searchsorted(-low, -total, "left")
        end = int(np.argmax(agreed - agreed[begin]))
        start = int(begin[end])
        agree = int(agreed[end] - agreed[start])
        start += int(np.argmax(same[start:end])) if agree else 0
    return agree, a + start, a + end


def enough(agree: int, item_size: int) -> bool:
    """At least 10 tokens, 9 for an item of 10 or 11 (the masks miss some stretches of fewer); all of a shorter item."""
    return agree >= (MIN_TOKENS - (item_size * MIN_SHARE <= MIN_TOKENS - 1) if item_size >= MIN_TOKENS else item_size)


class Items:
    """Test items' tokens, and their seeds in ascending order with the item and place of each."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        self.ids, self.words = ids, []
        for i, j, h, at in tokens(texts):
            self.words += [h[at[r] : at[r + 1]] for r in range(j - i)]
        self.short = sorted({len(w) for w in self.words if SHORT <= len(w) < MIN_TOKENS})
        h, item, pos = [], [], []
        for n, w in enumerate(self.words):
            at = np.array([0, len(w)])
            if len(w) < SHORT:
                continue
            found = [seeds(w, at, m) for m in range(len(MASKS))] if len(w) >= MIN_TOKENS else [short_seeds(w, at, len(w))]
            for x, p in found:
                h.append(x)
                pos.append(p)
                item.append(np.full(len(x), n))
        self.hash, self.item, self.pos = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((h, np.uint64), (item, np.int64), (pos, np.int64)))
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.pos = self.hash[order], self.item[order], self.pos[order]
        self.bits = np.zeros(HIT_BITS, bool)
        self.bits[(self.hash & U(HIT_BITS - 1)).astype(np.int64)] = True

    def hits(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct (row, item, diagonal) of texts at[i]..at[i+1]."""
        out = []
        for h, pos in [seeds(word, at, m) for m in range(len(MASKS))] + [short_seeds(word, at, n) for n in self.short]:
            some = np.flatnonzero(self.bits[(h & U(HIT_BITS - 1)).astype(np.int64)])
            lo = np.searchsorted(self.hash, h[some], "left")
            n = np.searchsorted(self.hash, h[some], "right") - lo
            which = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            p = np.repeat(pos[some], n)
            row = np.searchsorted(at, p, "right") - 1
            out.append(np.stack([row, self.item[which], p - at[row] - self.pos[which]], 1))
        return np.unique(np.concatenate(out), axis=0)


OVERLAPS = "doc_id long, item_id long, agree long, doc_start long, doc_end long, item_start long, item_tokens long"
KINDS = [x.split()[0] for x in OVERLAPS.split(", ")]


def _batch(rows: list[tuple], names: list[str] = KINDS) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names)


def _sent(docs: DataFrame, items: Items) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for k in range(0, batch.num_rows, 512):
                for i, j, word, at in tokens(batch.column(1).slice(k, 512).to_pylist()):
                    best: dict[tuple[int, int], tuple] = {}
                    for row, item, diagonal in items.hits(word, at).tolist() if len(items.hash) else []:
                        agree, a, b = best_stretch(word[at[row] : at[row + 1]], items.words[item], diagonal)
                        if enough(agree, len(items.words[item])):
                            got = (agree, -a, b, a - diagonal)
                            best[row, item] = max(best.get((row, item), got), got)
                    yield _batch([(ids[k + i + r], items.ids[n], g, -a, b, s, len(items.words[n])) for (r, n), (g, a, b, s) in sorted(best.items())])

    return docs.select("doc_id", "text").mapInArrow(released(run), OVERLAPS)


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same with seeds exchanged, for test sets of any size: rows are numbered by a hash of id and text."""

    def sow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, word, at in tokens(batch.column(1).to_pylist()):
                for h, pos in [seeds(word, at, m) for m in range(len(MASKS))] + [short_seeds(word, at, n) for n in range(SHORT, MIN_TOKENS)]:
                    row = np.searchsorted(at, pos, "right") - 1
                    key = batch.column(0).take(pa.array(row + i))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h)), key, pa.array(pos - at[row])], ["h", "key", "pos"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([h[at[r] : at[r + 1]] for i, j, h, at in tokens(batch.column(c).to_pylist()) for r in range(j - i)] for c in ("text", "item"))
            rows = []
            for d, n, diagonals, p, q in zip(*(batch.column(c).to_pylist() for c in ("key", "item_id", "diagonals")), one, two, strict=True):
                found = [(agree, -a, b, a - g) for g in diagonals for agree, a, b in [best_stretch(p, q, g)] if len(q) >= SHORT and enough(agree, len(q))]
                if found:
                    agree, a, b, start = max(found)
                    rows.append((d, n, agree, -a, b, start, len(q)))
            yield _batch(rows, ["key", *KINDS[1:]])

    docs = docs.select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text", F.lit(1)))
    items = items.withColumn("key", F.xxhash64("item_id", "item", F.lit(2)))
    once = docs.dropDuplicates(["key"])
    left = once.select("key", "text").mapInArrow(released(sow), "h long, key long, pos long")
    right = items.select("key", "item").mapInArrow(released(sow), "h long, key long, pos long").select("h", F.col("key").alias("other"), F.col("pos").alias("q"))
    met = left.join(right, "h").select("key", "other", (F.col("pos") - F.col("q")).alias("diagonal"))
    # A pair has fewer diagonals than its texts have tokens; both texts come along once a pair.
    met = met.groupBy("key", "other").agg(F.collect_set("diagonal").alias("diagonals"))
    met = met.join(items.select(F.col("key").alias("other"), "item_id", "item"), "other").join(once.select("key", "text"), "key")
    found = met.select("key", "item_id", "diagonals", "text", "item").mapInArrow(released(compare), OVERLAPS.replace("doc_id", "key"))
    return found.join(docs.select("key", "doc_id"), "key").select(*KINDS)


def overlaps(docs: DataFrame, benchmark: DataFrame, send_most: int = SEND_MOST) -> DataFrame:
    """Per document and test item that overlap: doc_id, item_id, agree, doc_start, doc_end, item_start, item_tokens.

    There is a row if in a stretch at least 10 tokens agree (9 for items of 10 or 11), four of five of the stretch;
    for items of 5 to 9 tokens all of the item, in a row. It tells of the stretch that scores most (see best_stretch),
    or of the one in which most agree if that has too few. Shorter items, and null or empty texts on either side, overlap with nothing.
    Places count tokens. Ties go to the stretch that begins first. Equal rows of docs give equal rows each; repeated
    items count once. A test set of more than send_most seeds is joined instead of sent, with the same result. Other
    columns are ignored.
    """
    items = benchmark.select("item_id", F.col("text").alias("item")).where("item is not null").distinct()
    n = items.agg(F.sum(F.length("item"))).first()[0] or 0
    if n * len(MASKS) // 2 > send_most:  # a token has two characters at least, with the gap after it
        return _joined(docs, items)
    rows = sorted(items.collect(), key=lambda x: (x.item_id is None, x.item_id, x.item))
    return _sent(docs, Items([x.item_id for x in rows], [x.item for x in rows]))
