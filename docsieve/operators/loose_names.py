"""Strings within a few edits of each other, and names that texts have with a letter or two off.

A string of n letters with a budget of e edits is cut into e + 1 segments. One of them stands unchanged in any string within
the budget, and it stands where the edits before and those behind it still add up to the budget. So the index holds segments,
a probe looks for a few of its substrings, and Spark joins the two; what meets is verified by its edit distance.
Against a small index, texts are looked through for segments before their runs of words become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: The most rows of an index that is broadcast.
SMALL = 100_000
#: Words that are looked through at a time, and places that are held against runs at a time.
WORDS, PLACES = 50_000, 250_000
_BASE, _MIX = np.uint64(1_099_511_628_211), np.uint64(0x9E3779B97F4A7C15)
Budget = Callable[[Column], Column]


def share_of(percent: int) -> Budget:
    """An edit, or the given share of the letters if that is more."""
    return lambda n: F.greatest(F.lit(1), F.floor(n * percent / 100).cast("int"))


def _begin(j: Column, n: Column, e: Column) -> Column:
    """Where segment j of e + 1 begins; the last ones are a letter longer where it does not come out even."""
    short = F.floor(n / (e + 1)).cast("int")
    return j * short + F.greatest(F.lit(0), j - (e + 1 - n % (e + 1)))


def within_budget(probes: DataFrame, index: DataFrame, budget: Budget, longer: int | None = None) -> DataFrame:
    """(a, b): strings a of probes and b of index within budget(length of b) edits of each other, each pair once.

    Further columns of probes are kept, and a pair then comes once for each of their values. With `longer`, a has at most so
    many letters more than b (0: b is never the shorter one). Equal strings are within any budget. Nulls take no part, empty
    strings are those without letters. Exact, whatever the lengths; budgets beyond the length make empty segments, which
    meet all strings of fitting length. An index of up to SMALL segments, which is counted, is broadcast; a larger one is joined.
    """
    kept = probes.columns[1:]
    held = index.select(F.col(index.columns[0]).alias("b")).where("b is not null").distinct()
    held = held.withColumn("n", F.length("b")).withColumn("e", budget(F.col("n")))
    most, count = held.agg(F.max("e"), F.sum(F.col("e") + 1)).first()
    asked = probes.select(F.col(probes.columns[0]).alias("a"), *kept).where("a is not null")
    if most is None:
        return asked.select("a", F.col("a").alias("b"), *kept).where("false")
    segments = held.select("b", "n", "e", F.explode(F.sequence(F.lit(0), F.col("e"))).alias("j"))
    at, end = _begin(F.col("j"), F.col("n"), F.col("e")), _begin(F.col("j") + 1, F.col("n"), F.col("e"))
    segments = segments.select("b", "n", "e", "j", F.substring("b", at + 1, end - at).alias("segment"))
    if count <= SMALL:
        segments = F.broadcast(segments)
    off = F.sequence(F.lit(-most), F.lit(most if longer is None else min(longer, most)))
    asked = asked.select("*", F.length("a").alias("_m"), F.explode(off).alias("_d")).withColumn("n", F.col("_m") - F.col("_d")).where("n >= 0")
    j, d = F.col("j"), F.col("_d")
    asked = asked.withColumn("e", budget(F.col("n"))).where(F.abs(d) <= F.col("e"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.col("e"))).alias("j"))
    at, end, left = _begin(j, F.col("n"), F.col("e")), _begin(j + 1, F.col("n"), F.col("e")), F.col("e") - j
    first = F.greatest(F.lit(0), at - j, at + d - left)
    last = F.least(F.col("_m") - (end - at), at + j, at + d + left)
    asked = asked.withColumn("_size", end - at).withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    asked = asked.select("a", *kept, "n", "j", "_size", F.explode(F.sequence("_first", "_last")).alias("_from"))
    asked = asked.select("a", *kept, "n", "j", F.substring("a", F.col("_from") + 1, F.col("_size")).alias("segment"))
    met = asked.join(segments, ["n", "j", "segment"]).where(F.levenshtein("a", "b") <= F.col("e"))
    return met.select("a", "b", *kept).distinct()


def close_pairs(strings: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different strings within a share of the longer one's letters, one edit at least, in order."""
    strings = strings.distinct()
    pairs = within_budget(strings, strings, share_of(percent), 0).where("length(a) < length(b) or a < b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def windows(texts: DataFrame, key: str, text: str, sizes: list[int]) -> DataFrame:
    """(key, size, words): distinct runs of `size` words of texts of words between single blanks."""
    dealt = texts.select(key, text).repartition(key)  # a text makes some thirty rows of each of its words: shuffling it first is little
    words = dealt.select(key, F.filter(F.split(text, " "), lambda w: w != "").alias("w"))
    rows = words.select(key, "w", F.explode(F.array(*map(F.lit, sizes))).alias("size")).where(F.size("w") >= F.col("size"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.array_join(F.slice("w", i, F.col("size")), " "))
    return rows.select(key, "size", F.explode(F.array_distinct(runs)).alias("words"))


def _initials_differ(a: Column, b: Column) -> Column:
    one, two = F.split(a, " "), F.split(b, " ")
    return (F.size(one) == F.size(two)) & F.exists(F.arrays_zip(one.alias("x"), two.alias("y")), lambda z: (z["x"] != z["y"]) & (F.length(z["x"]) == 1) & (F.length(z["y"]) == 1))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _rolled(codes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hashes): of each `size` code points in a row, for all sizes up to the longest."""
    h = codes
    for size in range(1, min(longest, len(codes)) + 1):
        h = codes if size == 1 else h[:-1] * _BASE + codes[size - 1 :]
        yield size, h


class _Sought:
    """The segments of names and where they stand in a run: name, letters of the run before the segment, letters of the run.

    Names are rows of name, n (words), b (without blanks) and e (edits; -1: only as it is, and then all of it is the segment).
    A segment that begins or ends its runs is sought where words begin or end, others everywhere.
    """

    def __init__(self, names: list[Row]):
        self.names = [r["name"] for r in names]
        self.n, self.e = np.array([r["n"] for r in names]), np.array([r["e"] for r in names])
        self.letters = np.array([len(r["b"]) for r in names])
        held: dict[tuple[int, int], dict[str, list[tuple[int, int, int]]]] = {}
        for i, r in enumerate(names):
            n, e = len(r["b"]), max(r["e"], 0)
            for j in range(e + 1):
                at, end = (k * (n // (e + 1)) + max(0, k - (e + 1 - n % (e + 1))) for k in (j, j + 1))
                for d in range(-min(e, 2), min(e, 2) + 1):
                    first, last = max(0, at - j, at + d - (e - j)), min(n + d - (end - at), at + j, at + d + (e - j))
                    for before in range(first, last + 1):
                        where = 0 if before == 0 else 1 if before + end - at == n + d else 2
                        held.setdefault((end - at, where), {}).setdefault(r["b"][at:end], []).append((i, before, n + d))
        self.tables: dict[int, list[tuple[int, ...]]] = {}
        for (size, where), rows in held.items():
            *_, (_, hashes) = _rolled(_codes("".join(rows)).astype(np.uint64), size)
            hashes = hashes[::size]
            counts, order = np.array([len(x) for x in rows.values()]), np.argsort(hashes, kind="stable")
            bits = min(20, len(rows).bit_length() + 6)
            seen, shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
            seen[(hashes * _MIX) >> shift] = True
            entries = np.array([x for r in rows.values() for x in r]).T
            self.tables.setdefault(size, []).append((where, seen, shift, hashes[order], (np.cumsum(counts) - counts)[order], counts[order], entries))
        # Letters of names with one edit, from either end; what is no letter of a text ends them.
        width = max((len(r["b"]) for r in names if r["e"] == 1), default=0) + 1
        self.ahead, self.behind = np.full((2, len(names), width), 2**32 - 1, np.uint32)
        for i, r in enumerate(names):
            if r["e"] == 1:
                self.ahead[i, : len(r["b"])], self.behind[i, : len(r["b"])] = _codes(r["b"]), _codes(r["b"])[::-1]

    def runs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, name, words) of batches of (key, text): the runs of a text's words that may be a name; all that are within its budget are among them."""
        over = int(self.n.max())
        for batch in batches:
            words, owners = [], []
            for row, text in enumerate(batch.column(1)):
                own = [w for w in (text.as_py() or "").split(" ") if w]
                for i in range(0, len(own), WORDS):
                    words += own[i : i + WORDS + over]
                    owners += [row] * (len(words) - len(owners))
                    if len(words) >= WORDS:
                        yield self._rows(batch, words, owners)
                        words, owners = [], []
            if words:
                yield self._rows(batch, words, owners)

    def _rows(self, batch: pa.RecordBatch, words: list[str], owners: list[int]) -> pa.RecordBatch:
        found: set[tuple[int, str, str]] = set()
        self._look(words, np.array(owners), found)
        rows, names, runs = ([x[i] for x in found] for i in range(3))
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(runs, pa.string())]
        return pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "name", "words"])

    def _look(self, words: list[str], owners: np.ndarray, found: set[tuple[int, str, str]]) -> None:
        codes = _codes("".join(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        starts = np.concatenate(([0], ends[:-1]))
        begun, ended = np.full((2, len(codes) + 1), -1)
        begun[starts] = ended[ends] = np.arange(len(words))
        for size, h in _rolled(codes.astype(np.uint64), max(self.tables)):
            for where, seen, shift, hashes, at, counts, entries in self.tables.get(size, []):
                if where == 2:
                    places = np.flatnonzero(seen[(h * _MIX) >> shift])
                else:
                    places = starts[: np.searchsorted(starts, len(h))] if where == 0 else ends[np.searchsorted(ends, size) :] - size
                    places = places[seen[(h[places] * _MIX) >> shift]]
                which = np.minimum(np.searchsorted(hashes, h[places]), len(hashes) - 1)
                met = hashes[which] == h[places]
                places, which = places[met], which[met]
                total = np.cumsum(counts[which])
                cuts = [0, *np.searchsorted(total, np.arange(PLACES, total[-1] if len(total) else 0, PLACES)), len(places)]
                for i, k in zip(cuts, cuts[1:], strict=False):
                    c = counts[which[i:k]]
                    of = np.repeat(at[which[i:k]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                    name, before, letters = entries[:, of]
                    self._keep(words, owners, codes, begun, ended, name, np.repeat(places[i:k], c) - before, letters, found)

    def _keep(self, words: list[str], owners: np.ndarray, codes: np.ndarray, begun: np.ndarray, ended: np.ndarray, name: np.ndarray, start: np.ndarray, letters: np.ndarray, found: set[tuple[int, str, str]]) -> None:
        end = start + letters
        fits = np.flatnonzero((start >= 0) & (end < len(begun)))
        fits = fits[(begun[start[fits]] >= 0) & (ended[end[fits]] >= 0)]
        name, start, end, first, last = name[fits], start[fits], end[fits], begun[start[fits]], ended[end[fits]]
        fits = (np.abs(last - first + 1 - self.n[name]) <= np.where(self.e[name] < 0, 0, 1)) & (owners[first] == owners[last])
        one = np.flatnonzero(fits & (self.e[name] == 1))
        if len(one):
            # Within one edit: what both begin with and what both end with leave no more than a letter of the longer one.
            of, m, n, k = name[one], (end - start)[one], self.letters[name[one]], np.arange(self.ahead.shape[1])
            ahead = (codes[np.minimum(start[one][:, None] + k, len(codes) - 1)] == self.ahead[of]).argmin(1)
            behind = (codes[np.maximum(end[one][:, None] - 1 - k, 0)] == self.behind[of]).argmin(1)
            fits[one] = np.minimum(ahead, m) + np.minimum(behind, m) >= np.maximum(m, n) - 1
        for row, k, a, z in zip(*(x[fits].tolist() for x in (owners[first], name, first, last)), strict=True):
            found.add((row, self.names[k], " ".join(words[a : z + 1])))


def named_loosely(texts: DataFrame, names: DataFrame, key: str, text: str, name: str, percent: int = 15) -> DataFrame:
    """(key, name, exact): which names stand in which texts, as they are or, from five letters on, a few letters off.

    Texts and names are normal words between single blanks. A run of a name's number of words, one fewer or one more is held
    against it without blanks: within 15 % of its letters, one at least and two more or fewer at most, and no initial of it another.
    Each name comes once a text. Null and empty texts and names have no rows; repeated keys are one text each row's words of which count.
    """
    wanted = names.select(F.col(name).alias("name")).where(F.length(F.trim("name")) > 0).distinct()
    wanted = wanted.select("name", F.size(F.split("name", " ")).alias("n"), F.replace("name", F.lit(" "), F.lit("")).alias("b"))
    letters, budget = F.length("b"), share_of(percent)
    edits = wanted.withColumn("e", F.when(letters >= 5, budget(letters)).otherwise(-1))
    held = edits.limit(SMALL + 1).collect()
    if not held:
        return texts.select(key, F.lit("").alias("name"), F.lit(True).alias("exact")).where("false")
    if sum(max(r["e"], 0) + 1 for r in held) <= SMALL and all(r["e"] < len(r["b"]) for r in held):
        dealt = texts.select(key, text).repartition(key)
        rows = dealt.mapInArrow(_Sought(held).runs, StructType([dealt.schema[0]]).add("name", "string").add("words", "string"))
        a, b = (F.replace(c, F.lit(" "), F.lit("")) for c in ("words", "name"))
        near = (F.length(b) >= 5) & ~_initials_differ(F.col("words"), F.col("name")) & (F.levenshtein(a, b) <= budget(F.length(b)))
        rows = rows.withColumn("exact", F.col("words") == F.col("name")).where(F.col("exact") | near)
    else:
        rows = _joined(texts, wanted, key, text, percent)
    return rows.groupBy(key, "name").agg(F.max("exact").alias("exact"))


def _joined(texts: DataFrame, wanted: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """(key, name, exact) of named_loosely for many names, some of them repeated: all runs are rows and joined."""
    counts = [r["n"] for r in wanted.select("n").distinct().collect()]  # numbers of words: bounded by the longest name
    runs = windows(texts, key, text, sorted({s for n in counts for s in (n - 1, n, n + 1) if s > 0}))
    whole = wanted.select(F.col("name").alias("words"), F.col("n").alias("size"), "name")
    exact = runs.join(F.broadcast(whole) if wanted.count() <= SMALL else whole, ["words", "size"]).select(key, "name", F.lit(True).alias("exact"))
    loose = wanted.where(F.length("b") >= 5)
    bare = runs.select(F.replace("words", F.lit(" "), F.lit("")).alias("a"), key, "size", "words")
    met = within_budget(bare, loose.select("b"), share_of(percent)).where(F.abs(F.length("a") - F.length("b")) <= 2)
    found = met.join(loose, "b").where((F.abs(F.col("size") - F.col("n")) <= 1) & ~_initials_differ(F.col("words"), F.col("name")))
    return exact.union(found.select(key, "name", F.lit(False)))
