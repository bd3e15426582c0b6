"""Removal of repeated byte strings by suffix arrays.

A window is a string of `length` bytes. Its minimiser is the first of its 32-byte strings with the least hash; windows
that are equal have equal minimisers, so windows are dealt to shards by minimiser and no equal pair is parted.
Neighbouring windows with one minimiser at one place travel together as a segment. Then:

1. Equal segments (two independent 64-bit hashes, and the minimiser's) are collapsed to the first of them, in the task
   that reads them and again after the exchange; all windows of the others are repeats. Most minimisers are then left
   with one segment and are done.
2. The segments of the other minimisers fetch their bytes and are dealt to shards. A shard builds a suffix array by
   Larsson and Sadakane's refinement, takes common prefixes by Kasai's method, and marks in every run of suffixes
   with `length` bytes in common all windows but the first. A minimiser that runs over the end of a shard is merged
   with the next by binary search in its sorted windows.
3. A hot minimiser, with more than 1,024 different segments, is not dealt to a shard: its segments are cut anew by a
   longer minimiser (64, 88, then 100 bytes) and go through step 1 again. A minimiser of 100 bytes is the window
   itself, so that step 1 settles it. No task holds the segments of a minimiser but up to that number: they are
   streamed in order, and minimisers with very many rows are dealt over several tasks by the segment's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import BASE, BYTE_VALUE, U, materialise, mix, released, signed, slices, text_bytes

#: Lengths of the minimisers of each turn, in percent of a window.
GRAMS = (32, 64, 88, 100)
CHUNK = 1 << 20
#: More than the bytes that chunks() hands out at once.
PLACES = 1 << 22
SHARD_BYTES = 1 << 21
HOT_SEGMENTS = 1024
#: Minimisers with at least this many rows may be dealt over several tasks, and the most segments a task keeps back.
SPLIT_ROWS, PENDING = 1 << 16, 1 << 17
PIECE = 512
#: A second, independent polynomial hash.
BYTE_VALUE_2 = np.random.Generator(np.random.PCG64(77003)).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE_2 = U(0xD1342543DE82EF95)
_powers_of: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _powers_of.get(base)
    if held is None or len(held) < n:
        held = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 4096), U(base), np.uint64))])
        _powers_of[base] = held
    return held


class Rolling:
    """Hashes of any stretch of data: polynomial sums, divided by the power at which the stretch begins."""

    def __init__(self, data: np.ndarray, base: np.uint64 = BASE, value: np.ndarray = BYTE_VALUE) -> None:
        n = len(data)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(value[data] * _powers(int(base), n)[:n], out=self.total[1:])
        self.inverse = _powers(pow(int(base), -1, 1 << 64), n + 1)

    def every(self, size: int) -> np.ndarray:
        return mix((self.total[size:] - self.total[:-size]) * self.inverse[: len(self.total) - size])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of x[i:i+w] for each i, by block-wise running minima."""
    n = len(x)
    full = -(-n // w) * w
    held = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    held[:n] = x
    block = held.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window, end of windows, minimiser, content hash, second content hash) of the segments of the rows of data."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    one, two = Rolling(data), Rolling(data, BASE_2, BYTE_VALUE_2)
    grams = one.every(gram)
    # The place in the low bits makes the leftmost of equal hashes the least: no two windows of a segment can be equal.
    least = sliding_least((grams & ~U(PLACES - 1)) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    size = np.diff(at)
    ok = np.repeat(size - length, np.maximum(size, 0)) >= np.arange(len(data)) - np.repeat(at[:-1], size)
    ok = ok[: len(least)]
    row = np.repeat(np.arange(len(size)), size)[: len(least)]
    new = np.empty(len(least), bool)
    new[0] = True
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new & ok)
    edge = np.flatnonzero(new | ~ok)
    end = np.append(edge, len(least))[np.searchsorted(edge, first, "right")]
    reach = end + length - 1
    return row[first], first, end, grams[(least[first] & U(PLACES - 1)).astype(np.int64)], one.of(first, reach), two.of(first, reach)


def chunks(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Runs of rows of about 1 MB, and long rows in overlapping parts: (bytes, ends of rows, first row, place in it)."""
    for i, j in slices(at, CHUNK):
        if j - i == 1 and at[j] - at[i] > 2 * CHUNK:
            for a in range(int(at[i]), int(at[j]) - length + 1, CHUNK):
                b = min(a + CHUNK + length - 1, int(at[j]))
                yield data[a:b], np.array([0, b - a]), i, a - int(at[i])
        else:
            yield data[at[i] : at[j]], at[i : j + 1] - at[i], i, 0


def spans_of(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Joins spans [a, b) of a key that touch or overlap."""
    order = np.lexsort((a, key))
    key, a, b = key[order], a[order], b[order]
    if not len(key):
        return key, a, b
    if b.max() >= 1 << 42:
        return key, a, b
    of = np.cumsum(np.append(0, key[1:] != key[:-1]))  # spans of later keys stand beyond those of earlier ones
    reach = np.maximum.accumulate(b + of * (int(b.max()) + 2)) - of * (int(b.max()) + 2)
    new = np.append(True, (key[1:] != key[:-1]) | (a[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return key[at], a[at], np.maximum.reduceat(b, at)


#: kind: a span a..b of repeated bytes; a segment not compared with other tasks yet; one that shares its minimiser with
#: other segments; one that does with very many.
REPEATS, LOOSE, OPEN, HOT = range(4)
#: A segment is its minimiser h, content hashes g and e, and its document and windows as key and at = first * (length + 1) + windows.
ROWS = "h long, g long, e long, key long, at long, a long, b long, kind byte, piece binary"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
KINDS = [pa.int64()] * 7 + [pa.int8(), pa.binary()]


def _spans(key: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """The bytes of the segments (key, at) as spans of repeats."""
    first = at // (length + 1)
    key, a, b = spans_of(key, first, first + at % (length + 1) + length - 1)
    none = pa.nulls(len(key), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, none, pa.array(key), none, pa.array(a), pa.array(b), pa.array(np.zeros(len(key), np.int8)), pa.nulls(len(key), pa.binary())], NAMES)


class Segments:
    """Rows of segments as arrays: h, g, e, key, at, and pieces (bytes each) or None."""

    def __init__(self, cols: list[np.ndarray], pieces: np.ndarray | None) -> None:
        self.cols, self.pieces = cols, pieces

    def __len__(self) -> int:
        return len(self.cols[0])

    def take(self, index: np.ndarray) -> Segments:
        return Segments([c[index] for c in self.cols], None if self.pieces is None else self.pieces[index])

    def plus(self, other: Segments) -> Segments:
        pieces = None if self.pieces is None else np.concatenate([self.pieces, other.pieces])
        return Segments([np.concatenate(x) for x in zip(self.cols, other.cols, strict=True)], pieces)

    def rows(self, kind: np.ndarray | int) -> Iterator[pa.RecordBatch]:
        kind = np.full(len(self), kind, np.int8) if np.isscalar(kind) else kind.astype(np.int8)
        for i in range(0, len(self), 1 << 15):
            cut = slice(i, i + (1 << 15))
            cols = [pa.array(c[cut]) for c in self.cols]
            n = len(cols[0])
            pieces = pa.nulls(n, pa.binary()) if self.pieces is None else pa.array(self.pieces[cut], pa.binary())
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(kind[cut]), pieces], NAMES)


def first_of_equals(found: Segments) -> tuple[Segments, np.ndarray, np.ndarray]:
    """found in the order (h, g, e, key, at); which have an equal segment before them; which have one after."""
    h, g, e, key, at = found.cols
    found = found.take(np.lexsort((at, key, e, g, h)))
    same = np.zeros(len(found) + 1, bool)
    if len(found):
        same[1:-1] = np.logical_and.reduce([c[1:] == c[:-1] for c in found.cols[:3]])
    return found, same[:-1], same[1:]


def cut_segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments of all texts (key, text), or of pieces of them (key, a, text), which then come along.

    Equal segments are collapsed within a task as far as they meet in a batch of rows: of those that do, the first is
    kept back for the batches that follow, so that a passage in very many rows leaves a task as a row or a few.
    """
    pieces = "a" in docs.columns

    def cut(batch: pa.RecordBatch) -> Segments | None:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        begin = batch.column(1).to_numpy(zero_copy_only=False) if pieces else np.zeros(len(key), np.int64)
        data, at = text_bytes(batch.column(2 if pieces else 1))
        parts, held = [], []
        for part, local, first_row, place in chunks(data, at, length):
            row, a, b, *hashes = segments(part, local, length, gram)
            first = a - local[row] + place + begin[first_row + row]
            parts.append((*(signed(x) for x in hashes), key[first_row + row], first * (length + 1) + (b - a)))
            if pieces:
                raw = part.tobytes()
                held += [raw[i : j + length - 1] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        if not parts:
            return None
        return Segments([np.concatenate(x) for x in zip(*parts, strict=True)], _objects(held) if pieces else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Segments | None = None
        for batch in batches:
            found = cut(batch)
            if found is None:
                continue
            found, late, before = first_of_equals(found if kept is None else found.plus(kept))
            yield _spans(found.cols[3][late], found.cols[4][late], length)
            again = ~late & before
            if kept is not None:  # what was kept back and not met again is kept on
                again |= ~late & np.isin(found.cols[1], kept.cols[1])
            if again.sum() > PENDING:
                again[:] = False
            yield from found.take(np.flatnonzero(~late & ~again)).rows(LOOSE)
            kept = found.take(np.flatnonzero(again))
        if kept is not None:
            yield from kept.rows(LOOSE)

    return docs.select("key", *(["a"] if pieces else []), "text").mapInArrow(released(run), ROWS)


def _objects(held: list[bytes]) -> np.ndarray:
    out = np.empty(len(held), object)
    out[:] = held
    return out


def busy(rows: DataFrame, split_rows: int) -> DataFrame:
    """(h): minimisers with so many rows that one task should not have to read them all, by a sixteenth of the documents.

    There are at most four for every shuffle partition, so they can be broadcast. Which they are only shifts work.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.where(F.pmod(F.xxhash64("key"), F.lit(16)) == 0).groupBy("h").agg(F.count("*").alias("n"))
    return some.where(F.col("n") * 16 >= split_rows).orderBy(F.desc("n"), "h").limit(4 * parts).select("h", F.lit(True).alias("busy"))


def settle(loose: DataFrame, length: int, hot: int, last: bool, split_rows: int) -> DataFrame:
    """Of equal segments all but the first are repeats; firsts whose minimiser has other firsts stay, OPEN or HOT.

    Rows are streamed in order: a task holds at most `hot` segments of a minimiser. Busy minimisers are dealt by content too,
    and their firsts are HOT. In the last turn a minimiser is the window, and nothing stays.
    """
    dealt = loose.select("h", "g", "e", "key", "at", "piece")
    if not last:
        salt = F.when(F.col("busy"), F.col("g").bitwiseOR(F.lit(1).cast("long"))).otherwise(0)
        dealt = dealt.join(F.broadcast(busy(loose, split_rows)), "h", "left").select("h", "g", "e", "key", "at", "piece", salt.alias("salt"))
    else:
        dealt = dealt.withColumn("salt", F.lit(0).cast("long"))
    dealt = dealt.repartition("h", "salt").sortWithinPartitions("h", "g", "e", "key", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen = None, 0  # the last segment met; firsts of its minimiser that went out as HOT
        kept: Segments | None = None  # firsts of that minimiser that wait for its number to be known
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            pieces = None if batch.column(5).null_count else _objects(batch.column(5).to_pylist())
            salt = batch.column(6).to_numpy(zero_copy_only=False)
            if not len(salt):
                continue
            mark = np.stack(cols[:3])
            new = np.append(before is None or (mark[:, 0] != before).any(), (mark[:, 1:] != mark[:, :-1]).any(0))
            before = mark[:, -1]
            yield _spans(cols[3][~new], cols[4][~new], length)
            if last:
                continue
            found = Segments(cols, pieces).take(np.flatnonzero(new))
            salt = salt[new]
            yield from found.take(np.flatnonzero(salt != 0)).rows(HOT)
            found = found.take(np.flatnonzero(salt == 0))
            if kept is not None:
                found = kept.plus(found)
            if not len(found):
                continue
            h = found.cols[0]
            edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            count = np.diff(np.append(edge, len(h)))
            same = seen and h[0] == seen_h
            count[0] += seen if same else 0
            kind = np.repeat(np.where(count > hot, HOT, np.where(count > 1, OPEN, LOOSE)), np.diff(np.append(edge, len(h))))
            seen, seen_h = (int(count[-1]), h[-1]) if count[-1] > hot else (0, None)
            wait = len(h) if seen else int(edge[-1])
            out = np.flatnonzero(kind[:wait] != LOOSE)
            yield from found.take(out).rows(kind[out])
            kept = found.take(np.arange(wait, len(h)))
        if kept is not None and len(kept) > 1:
            yield from kept.rows(OPEN)

    return dealt.mapInArrow(released(run), ROWS)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of text in the order of their suffixes, by Larsson-Sadakane refinement.

    The first pass sorts by 8 bytes. Each later pass doubles the sorted length: it sorts only positions whose group is
    not yet single, by the rank of the position `h` further on.
    """
    n = len(text)
    held = np.zeros(n + 8, np.uint64)
    held[:n] = text.astype(np.uint64)
    code = np.zeros(n, np.uint64)
    for i in range(8):
        code = (code << U(8)) | held[i : n + i]
    order = np.argsort(code, kind="stable")
    code = code[order]
    new = np.append(True, code[1:] != code[:-1])
    # The end of the text sorts before a zero byte: positions within 8 bytes of it are told apart by place.
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    rank[n] = 0
    h = 8
    while h < n:
        group = rank[order]
        twin = np.zeros(n, bool)
        twin[1:] = group[1:] == group[:-1]
        twin[:-1] |= twin[1:]
        slot = np.flatnonzero(twin)
        if not len(slot):
            break
        pos, own = order[slot], group[slot]
        far = rank[np.minimum(pos + h, n)]
        by = np.lexsort((far, own))
        pos, own, far = pos[by], own[by], far[by]
        order[slot] = pos
        start = np.append(True, (own[1:] != own[:-1]) | (far[1:] != far[:-1]))
        rank[pos] = slot[np.maximum.accumulate(np.where(start, np.arange(len(slot)), 0))] + 1
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Bytes, at most `most`, that each suffix in order shares with the one before it, by Kasai's method.

    The pieces starts..ends of the text advance in step: going to the next position keeps all but one of the bytes.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.append(text, np.zeros(most + 1, np.uint8))
    share = np.zeros(n, np.int64)
    by = np.argsort(starts - ends, kind="stable")  # longest first, so that those still going are a prefix
    at, end = starts[by].copy(), ends[by]
    length = np.zeros(len(at), np.int64)
    live = len(at)
    while live:
        live = int(np.searchsorted(-(end - at)[:live], 0, "left"))
        if not live:
            break
        at_, other, ln = at[:live], before[at[:live]], length[:live]
        ln[other < 0] = 0
        todo = np.flatnonzero((other >= 0) & (ln < most))
        while len(todo):
            x, y = at_[todo] + ln[todo], other[todo] + ln[todo]
            ok = (x < n) & (y < n) & (padded[x] == padded[np.minimum(y, n)])
            todo = todo[ok]
            ln[todo] += 1
            todo = todo[ln[todo] < most]
        share[at_] = ln
        np.maximum(ln - 1, 0, out=ln)
        at_ += 1
    return share[order]


def shard_repeats(text: np.ndarray, size: np.ndarray, key: np.ndarray, a: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Over the segments of one shard: text, window starts in it, their (key, place), their group of equal ones, and whether not first."""
    begin = np.cumsum(size) - size
    order = suffix_array(text)
    # Long segments are stepped through in parts.
    parts = -(-size // PIECE)
    of = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = begin[of] + nth * PIECE
    share = common_prefixes(text, order, starts, np.minimum(starts + PIECE, begin[of] + size[of]), length)
    seg = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(text)) - begin[seg]
    valid = place + length <= size[seg]
    run = np.cumsum(share < length)
    keep = valid[order]
    pos, run = order[keep], run[keep]
    k, s = key[seg[pos]], a[seg[pos]] + place[pos]
    by = np.lexsort((s, k, run))
    pos, run, k, s = pos[by], run[by], k[by], s[by]
    late = np.zeros(len(pos), bool)
    late[1:] = run[1:] == run[:-1]
    return text, pos, k, s, run, late


def compare(opened: DataFrame, length: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, a, b): repeats among the windows of open segments (h, key, a, piece)."""
    dealt = opened.repartition("h").sortWithinPartitions("h", "key", "a")

    def windows(text: np.ndarray, pos: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, length)[pos]).view(f"S{length}").ravel()

    def shard(h, key, a, text, size, carry, last) -> tuple[pa.RecordBatch, tuple | None]:
        text, pos, k, s, run, late = shard_repeats(text, size, key, a, length)
        seg = np.searchsorted(np.cumsum(size), pos, "right")
        gone_k, gone_s = [k[late]], [s[late]]
        firsts = ~late
        if carry is not None:
            own = np.flatnonzero(firsts & (h[seg] == carry[0]))
            mine = windows(text, pos[own])
            at = np.minimum(np.searchsorted(carry[1], mine), len(carry[1]) - 1)
            hit = carry[1][at] == mine
            x, y = own[hit], at[hit]
            earlier = (k[x] < carry[2][y]) | ((k[x] == carry[2][y]) & (s[x] < carry[3][y]))
            gone_k += [np.where(earlier, carry[2][y], k[x])]
            gone_s += [np.where(earlier, carry[3][y], s[x])]
            carry[2][y], carry[3][y] = np.where(earlier, k[x], carry[2][y]), np.where(earlier, s[x], carry[3][y])
            rest = own[~hit]
        after = None
        if not last:
            if carry is not None and carry[0] == h[-1]:
                add = (windows(text, pos[rest]), k[rest], s[rest])
                both = [np.concatenate(z) for z in zip(carry[1:], add, strict=True)]
            else:
                own = np.flatnonzero(firsts & (h[seg] == h[-1]))
                both = [windows(text, pos[own]), k[own].copy(), s[own].copy()]
            by = np.argsort(both[0], kind="stable")
            after = (h[-1], *(z[by] for z in both)) if len(by) else None
        gk, gs = np.concatenate(gone_k), np.concatenate(gone_s)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in spans_of(gk, gs, gs + length)], ["key", "a", "b"]), after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, held = None, []

        def close(more_h: int | None) -> pa.RecordBatch:
            nonlocal carry, held
            h, key, a, size = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2, 4))
            out, carry = shard(h, key, a, np.concatenate([x[3] for x in held]), size, carry, more_h != h[-1])
            held = []
            return out

        total = 0
        for batch in batches:
            h, key, a = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            data, at = text_bytes(batch.column(3))
            i = 0
            while i < len(h):
                if total >= shard_bytes:
                    yield close(h[i])
                    total = 0
                j = min(len(h), max(i + 1, int(np.searchsorted(at, at[i] + shard_bytes - total, "left"))))
                held.append((h[i:j], key[i:j], a[i:j], data[at[i] : at[j]], np.diff(at[i : j + 1])))
                total += int(at[j] - at[i])
                i = j
        if held:
            yield close(None)

    return dealt.select("h", "key", "a", "piece").mapInArrow(released(run), "key long, a long, b long")


def fetch(docs: DataFrame, opened: DataFrame, length: int) -> DataFrame:
    """(h, key, a, kind, piece): the bytes of open segments."""
    first = F.floor(F.col("at") / (length + 1)).cast("long")
    lists = opened.groupBy("key").agg(F.collect_list(F.struct("h", first.alias("a"), (F.col("at") % (length + 1)).alias("n"), "kind")).alias("open"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            raw = data.tobytes()
            found = batch.column(2)
            of = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
            h, a, n, kind = (x.to_numpy(zero_copy_only=False) for x in found.flatten().flatten())
            start = at[of] + a
            pieces = [raw[i:j] for i, j in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)]
            key = batch.column(0).to_numpy(zero_copy_only=False)[of]
            for i in range(0, len(h), 1 << 14):
                cut = slice(i, i + (1 << 14))
                cols = [pa.array(x[cut]) for x in (h, key, a, kind)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(pieces[cut], pa.binary())], ["h", "key", "a", "kind", "piece"])

    return docs.select("key", "text").join(lists, "key").mapInArrow(released(run), "h long, key long, a long, kind byte, piece binary")


def number_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with a long `key` in the order of documents; the distinct keyed texts.

    Usually key is doc_id. If ids repeat or are null, equal rows share a key, and the texts of one id follow in the
    order of a hash; a null id comes before all others.
    """
    n, ids, known = docs.agg(F.count("*"), F.countDistinct("doc_id"), F.count("doc_id")).first()
    if n == ids == known:
        out = docs.select("doc_id", "text", F.col("doc_id").alias("key"))
        return out, out
    told = docs.select("doc_id", "text", F.xxhash64("text").alias("tid"))
    order = told.select("doc_id", "tid").distinct().orderBy("doc_id", "tid").withColumn("key", F.monotonically_increasing_id())
    order = materialise(order, "keys").withColumnsRenamed({"doc_id": "d", "tid": "t"})
    out = told.join(order, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t"))).select("doc_id", "text", "key")
    return out, out.dropDuplicates(["key"])


def repeated_spans(keyed: DataFrame, length: int = 100, shard_bytes: int = SHARD_BYTES, hot: int = HOT_SEGMENTS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(key, a, b): byte spans, possibly overlapping, that together are the bytes covered by a repeated window."""
    done, opened = [], []
    source = keyed.select("key", "text")
    for turn, percent in enumerate(GRAMS):
        gram, last = max(1, length * percent // 100), percent == 100
        cut = materialise(cut_segments(source, length, gram), "cut")
        settled = materialise(settle(cut.where(F.col("kind") == LOOSE), length, hot, last, split_rows), "settled")
        done += [x.where(F.col("kind") == REPEATS).select("key", "a", "b") for x in (cut, settled)]
        if last:
            break
        left = settled.where(F.col("kind") != REPEATS)
        if turn == 0:
            left = materialise(fetch(keyed, left, length), "pieces")
        else:
            left = left.select("h", "key", F.floor(F.col("at") / (length + 1)).cast("long").alias("a"), "kind", "piece")
        opened.append(left.where(F.col("kind") == OPEN).select("h", "key", "a", "piece"))
        source = left.where(F.col("kind") == HOT).select("key", "a", F.col("piece").alias("text"))
        if source.isEmpty():
            break
    done.append(compare(reduce(DataFrame.union, opened), length, shard_bytes))
    return reduce(DataFrame.union, done)


def remove_repeats(docs: DataFrame, length: int = 100, **sizes: int) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, spans (array of a, b), kept (binary), kept_sha256.

    Texts are UTF-8 bytes, null ones empty. A byte is removed if a string of `length` bytes that covers it also
    starts earlier: in a smaller doc_id, or earlier in the same document. Strings may overlap and are judged on the
    input. spans are the maximal removed runs. Texts shorter than `length` keep all bytes. Equal rows count as one
    document and each gets its result; different texts of one id follow in a fixed order, a null id comes first.
    Other columns are ignored; an empty table gives an empty one. sizes (shard_bytes, hot,
    split_rows) only shift work between tasks.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed, once = number_rows(docs)
    found = repeated_spans(once, length, **sizes).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("found"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<a:long,b:long>>, kept binary, kept_sha256 string"
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode()
                spans, kept = [], raw
                if found:
                    a = np.array([x["a"] for x in found], np.int64)
                    b = np.array([x["b"] for x in found], np.int64)
                    _, a, b = spans_of(np.zeros(len(a), np.int64), a, b)
                    spans = list(zip(a.tolist(), b.tolist(), strict=True))
                    kept = b"".join(raw[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
                rows.append((doc, len(raw), len(raw) - len(kept), len(spans), [{"a": i, "b": j} for i, j in spans], kept, hashlib.sha256(kept).hexdigest()))
            for i in range(0, len(rows), 2048):
                cols = zip(*rows[i : i + 2048], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names)

    return keyed.join(found, "key", "left").select("doc_id", "text", "found").mapInArrow(released(run), schema)
