"""Static range asymmetric numeral system (Duda 2014) over token ids, in numpy.

A frame is one block of ids. Its lanes are independent coders with 64-bit states that take the ids in turn and share
one stream of 32-bit words, so that numpy steps all lanes at once. A frame keeps the states and the place in the
stream at every checkpoint, from where decoding can start as well, and checksums of its ids and of its words.

Layout, little-endian: "DSTK", version u8, scale bits u8, spare u16, ids u64, lanes u32, checkpoints u32, steps between
checkpoints u32, words u64, crc32 of the ids as u32, crc32 of the frequency table, crc32 of states and words; then for
each checkpoint its place u64 and a state u64 of each lane; then the words u32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U = np.uint64
SCALE, LANES, BLOCK_IDS, CHECKPOINT_STEPS = 20, 1024, 1 << 18, 128
LOW = U(1 << 31)
HEAD = struct.Struct("<4sBBHQIIIQIII")


class Table:
    """Frequencies of ids, scaled to a sum of 2**20; every id that occurs has one."""

    def __init__(self, freq: np.ndarray) -> None:
        freq = freq[: int(np.flatnonzero(freq)[-1]) + 1]
        self.freq = freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self._symbol: np.ndarray | None = None

    @classmethod
    def of(cls, count: np.ndarray) -> Table:
        """From counts of ids 0..n-1, of which at most 2**20 are above zero."""
        count = np.asarray(count, np.float64)
        used = np.flatnonzero(count)
        if not len(used):
            count, used = np.ones(1), np.zeros(1, np.int64)
        size = 1 << SCALE
        if len(used) > size:
            raise ValueError(f"more than {size} different ids")
        freq = np.zeros(len(count), np.int64)
        freq[used] = np.maximum(1, np.floor(count[used] / count.sum() * size)).astype(np.int64)
        over = int(freq.sum()) - size
        order = used[np.argsort(-freq[used], kind="stable")]
        while over > 0:  # take from the largest, which keep at least one
            give = np.minimum(freq[order] - 1, -(-over // len(order)) + freq[order] // 16)
            give = np.minimum(give, np.maximum(0, over - (np.cumsum(give) - give)))
            freq[order] -= give
            over -= int(give.sum())
        freq[order[0]] -= over
        return cls(freq)

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    freq, start = table.freq[ids], table.start[ids]
    state = np.full(lanes, LOW, np.uint64)
    words, marks = [], []
    for t in range(steps - 1, -1, -1):
        f, c = freq[t * lanes : (t + 1) * lanes], start[t * lanes : (t + 1) * lanes]
        x = state[: len(f)]
        full = x >= f << U(63 - SCALE)
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> U(32), x)
        q = x // f
        state[: len(f)] = (q << U(SCALE)) + (x - q * f) + c
        if t % every == 0:
            marks.append((len(words), state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    size = np.array([len(w) for w in words[::-1]], np.int64)
    place = np.append(0, np.cumsum(size))
    held = b"".join(struct.pack("<Q", int(place[steps - k])) + s.astype("<u8").tobytes() for k, s in marks[::-1]) + stream.astype("<u4").tobytes()
    head = HEAD.pack(b"DSTK", 1, SCALE, 0, n, lanes, len(marks), every, len(stream), zlib.crc32(ids.astype("<u4").tobytes()), table.crc, zlib.crc32(held))
    return head + held


def decode(frame: bytes, table: Table, checkpoint: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids of a frame, or those from a checkpoint up to the checkpoint `stop`; ValueError if a checksum differs."""
    magic, version, scale, _, n, lanes, marks, every, n_words, ids_crc, table_crc, crc = HEAD.unpack_from(frame)
    held = memoryview(frame)[HEAD.size :]
    if magic != b"DSTK" or version != 1 or scale != SCALE or table_crc != table.crc or zlib.crc32(held) != crc:
        raise ValueError("not a whole frame of this table")
    if n == 0:
        return np.zeros(0, np.uint32)
    step = 8 + 8 * lanes
    place = struct.unpack_from("<Q", held, checkpoint * step)[0]
    state = np.frombuffer(held, "<u8", lanes, checkpoint * step + 8).astype(np.uint64)
    words = np.frombuffer(held, "<u4", n_words, marks * step)
    first, end = checkpoint * every, min(-(-n // lanes), (marks if stop is None else stop) * every)
    out = np.empty(min(n, end * lanes) - first * lanes, np.uint32)
    mask = U((1 << SCALE) - 1)
    for t in range(first, end):
        m = min(lanes, n - t * lanes)
        x = state[:m]
        slot = x & mask
        s = table.symbol[slot]
        out[(t - first) * lanes : (t - first) * lanes + m] = s
        x = table.freq[s] * (x >> U(SCALE)) + slot - table.start[s]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << U(32)) | words[place : place + len(low)]
        place += len(low)
        state[:m] = x
    if checkpoint == 0 and stop is None and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("the ids differ from those written")
    return out


def crc32_combine(one: int, two: int, size: int) -> int:
    """crc32 of two strings of bytes together, from their own and the second's size (by powers of its shift matrix)."""

    def times(m: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    shift = [0xEDB88320] + [1 << i for i in range(31)]  # by one bit
    for _ in range(3):
        shift = [times(shift, x) for x in shift]
    while size:
        if size & 1:
            one = times(shift, one)
        shift = [times(shift, x) for x in shift]
        size >>= 1
    return one ^ two
