"""Byte-level BPE ids of whole texts with the tokenizers library, each distinct pre-token encoded once in a worker.

The vocabulary's pre-tokenizer cuts a text into pieces that are then encoded on their own. The same cuts are made
here over arrays of code points, so that a piece that the worker has met before costs a table lookup only. Texts
that hold an added token's string, or are too long for the table, go through the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Sequence
from itertools import chain

import numpy as np

from docsieve.llm.common import U, mix, powers

LETTER, NUMBER, SPACE_ = 1, 2, 3
CACHE_SLOTS, CACHE_MOST, TEXT_CHARS, WHOLE_CHARS = 1 << 22, 3 << 19, 1 << 19, 3 << 18
#: Unicode's White_Space property (fixed values).
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Classes of the code points met so far, in blocks of 256; UNSET is none of them.
UNSET = 255
_classes = np.full(0x110000, UNSET, np.uint8)
_encoders: dict[str, Encoder] = {}


def classes(cp: np.ndarray) -> np.ndarray:
    """Letter, number, white space or other of each code point."""
    out = _classes[cp]
    if (out == UNSET).any():
        kind = {"L": LETTER, "N": NUMBER}
        for block in np.unique(cp[out == UNSET] >> 8).tolist():
            for i in range(block << 8, (block + 1) << 8):
                _classes[i] = kind.get(unicodedata.category(chr(i))[0], 0)
        _classes[[i for i in WHITE_SPACE if _classes[i] != UNSET]] = SPACE_
        out = _classes[cp]
    return out


def pretoken_starts(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of texts at[i]..at[i+1], as GPT-2's pattern cuts them."""
    n = len(cp)
    cls = classes(cp)
    text_start = np.zeros(n + 1, bool)
    text_start[at] = True
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    cut[1:n] = (cls[1:] != cls[:-1]) | text_start[1:n]
    runs = np.flatnonzero(cut)
    a, e = runs[:-1], runs[1:]
    out = cut
    # The last of a run of white space before other text stands alone, or with that text if it is a blank.
    gap = (cls[a] == SPACE_) & ~text_start[e]
    last = e[gap] - 1
    out[last] = True
    out[e[gap]] = cp[last] != 32
    # A lone apostrophe takes s, t, m, d, re, ve or ll with it.
    lone = a[(cp[a] == 39) & (e - a == 1) & (e < n) & ~text_start[e]]
    lone = lone[out[lone] & (cls[np.minimum(lone + 1, n - 1)] == LETTER)]
    if len(lone):
        one = cp[lone + 1]
        two = np.where((lone + 2 < n) & ~text_start[np.minimum(lone + 2, n)], cp[np.minimum(lone + 2, n - 1)], 0)
        size = np.where(np.isin(one, [115, 116, 109, 100]), 1, np.where(((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108), 2, 0))
        lone, size = lone[size > 0], size[size > 0]
        out[lone + 1] = False
        rest = lone + 1 + size
        inner = (rest < n) & ~text_start[np.minimum(rest, n)] & (cls[np.minimum(rest, n - 1)] == LETTER)
        out[rest[inner]] = True
    return np.flatnonzero(out[:n])


class Encoder:
    """One vocabulary with the ids of the pieces met so far (at most about 1,500,000, then it starts afresh)."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(CACHE_SLOTS, np.uint64)
        self.entry = np.zeros(CACHE_SLOTS, np.int32)
        self.off = np.zeros(0, np.int32)
        self.len = np.zeros(0, np.int32)
        self.ids = np.zeros(0, self.kind)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        slot = (h & U(CACHE_SLOTS - 1)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            held = self.key[slot]
            hit = held == h[todo]
            out[todo[hit]] = self.entry[slot[hit]]
            go = ~hit & (held != 0)
            todo, slot = todo[go], (slot[go] + 1) & (CACHE_SLOTS - 1)
        return out

    def add(self, h: np.ndarray, pieces: list[str]) -> None:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), self.kind, int(size.sum()))
        first = len(self.off)
        self.off = np.append(self.off, (len(self.ids) + np.cumsum(size) - size).astype(np.int32))
        self.len = np.append(self.len, size.astype(np.int32))
        self.ids = np.append(self.ids, flat)
        entry = np.arange(first, first + len(h), dtype=np.int32)
        slot = (h & U(CACHE_SLOTS - 1)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = np.flatnonzero(self.key[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)  # of those that want one slot, the first gets it
            won = free[one]
            self.key[slot[won]], self.entry[slot[won]] = h[todo[won]], entry[todo[won]]
            stay = np.ones(len(todo), bool)
            stay[won] = False
            todo, slot = todo[stay], slot[stay]
            slot = np.where(self.key[slot] != 0, (slot + 1) & (CACHE_SLOTS - 1), slot)

    def encode(self, texts: Sequence[str], end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by `end`, and where each text's begin and end."""
        parts, counts = [], []
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j]) <= TEXT_CHARS):
                chars += len(texts[j])
                j += 1
            ids, count = self._encode(texts[i:j], end)
            parts.append(ids)
            counts.append(count)
            i = j
        if not parts:
            return np.zeros(0, self.kind), np.zeros(1, np.int64)
        return np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(counts)))

    def _encode(self, texts: Sequence[str], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        whole = {i: self.tokenizer.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts) if len(x) > WHOLE_CHARS or any(a in x for a in self.added)}
        texts = ["" if i in whole else x for i, x in enumerate(texts)]
        joined = "".join(texts)
        at = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
        if joined:
            cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            starts = pretoken_starts(cp, at)
            ends = np.append(starts[1:], len(cp))
            size = ends - starts
            place = np.arange(len(cp)) - np.repeat(starts, size)
            value = (cp.astype(np.uint64) + U(1)) * U(0xD6E8FEB86659FD93) * powers(int(size.max()))[place]
            h = mix(np.add.reduceat(value, starts) + size.astype(np.uint64)) | U(1)
            entry = self.find(h)
            new = np.flatnonzero(entry < 0)
            if len(new):
                got, first = np.unique(h[new], return_index=True)
                if len(self.off) + len(got) > CACHE_MOST and len(self.off):
                    self.clear()
                    return self._encode([x if i not in whole else "" for i, x in enumerate(texts)], end) if not whole else self._splice(*self._encode(texts, end), whole, end)
                self.add(got, [joined[starts[k] : ends[k]] for k in new[first]])
                entry[new] = self.find(h[new])
            size = self.len[entry].astype(np.int64)
            total = int(size.sum())
            ids = self.ids[np.repeat(self.off[entry] - (np.cumsum(size) - size), size) + np.arange(total)]
            upto = np.append(0, np.cumsum(size))
            count = np.diff(upto[np.searchsorted(starts, at)])
        else:
            ids, count = np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        if end is not None:
            with_end = np.full(len(ids) + len(texts), end, self.kind)
            with_end[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), count)] = ids
            ids, count = with_end, count + 1
        return self._splice(ids, count, whole, end)

    def _splice(self, ids: np.ndarray, count: np.ndarray, whole: dict[int, list[int]], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if not whole:
            return ids, count
        parts = np.split(ids, np.cumsum(count)[:-1])
        for i, x in whole.items():
            parts[i] = np.array([*x, *([] if end is None else [end])], self.kind)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
