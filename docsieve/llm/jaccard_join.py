"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti and Kaushik, 2006).

The domain of shingle hashes is cut into n1 first-level parts, each of them into n2 = 3 second-level parts. Two sets
whose Hamming distance is at most k differ in at most k2 = 1 element in at least n1 - k // 2 first-level parts, so
there they agree in some two of the three second-level parts. Every subset of two second-level parts gives a
signature: the hash of what the set has there, if it has something. Sets are taken in bands of size; a band fixes n1
and k, and a set also signs for the band below it when its partner may be there. Nothing is lost:

* a pair with |r| <= |s| and Jaccard >= t has |r| >= t |s| and distance <= (|r| + |s|) (1 - t) / (1 + t);
* n1 is k // 2 + 1 and `spare` parts more; a part is strong if at least two of its second-level parts are not empty,
  so that no subset of it is empty. A set with at most `spare` parts that are not strong shares a signature with
  each partner;
* a set with more of them also signs with the prefix of its shingles in a fixed order; two such sets share one of these.

Shingles that a large share of a sample of sets have are left out of the domain (the distance over the rest is no
larger, so the bounds hold) and come last in the fixed order. The sample only shifts work: links do not depend on it.

Sets that share a signature are compared: all pairs of a group of at most 32, and in a larger one the pairs with its
four least members. What these links leave apart in a large group is then compared within tasks, over blocks of
the group: the members outside its largest component with all others, and only links that join two components come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import U, materialise, mix, released, segment_sums, shingle_sets, signed
from docsieve.llm.components import components

SKETCH_BITS, SKETCH_DOUBLINGS = 512, 7
BAND = 1.5
#: Second-level parts n2, and in how many of them a pair may differ, k2.
PARTS, APART = 3, 1
SUBSETS = tuple(combinations(range(PARTS), PARTS - APART))
SPARE_PERCENT = 20
ALL_PAIRS = 32
HUBS = 4
#: Shingles of one block of a large group, and members from which on a group is dealt over several tasks.
BLOCK_SHINGLES, SPLIT_GROUP = 1 << 18, 1 << 20
FILTER_BITS = 1 << 22
#: The sample of sets that marks common shingles, the share of it that makes one common, and the most of them sent out.
SAMPLE_SETS, COMMON_SHARE, COMMON_MOST = 4096, 0.01, 1 << 18


def max_distance(total: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Largest Hamming distance of two sets of `total` elements together whose Jaccard reaches percent."""
    return total * (100 - percent) // (100 + percent)


def bands(most: int, percent: int) -> np.ndarray:
    """Upper ends of the bands of set size: each 1.5 times the one before."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out, np.int64)


def band_shape(upper: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For bands with these upper ends: the number n1 of first-level parts (0 if only equal sets link), and how many of them are spare."""
    k = max_distance(upper + upper * 100 // percent, percent)
    least = k // (APART + 1) + 1
    spare = -(-SPARE_PERCENT * least // 100) + 1
    return np.where(k > 0, least + spare, 0), spare


def signatures(h: np.ndarray, cut: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets h[cut[i]:cut[i+1]] (sorted hashes), and the set of each."""
    size = np.diff(cut)
    ends = bands(int(size.max(initial=1)) * 100 // percent + 1, percent)
    parts, spares = band_shape(ends, percent)
    own = np.searchsorted(ends, size)
    row = np.repeat(np.arange(len(size)), size)
    rare = np.ones(len(h), bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        rare = common[at] != h
    value = mix(h ^ U(0xA5A5A5A5A5A5A5A5))
    second = (((h & U(0xFFFFFFFF)) * U(PARTS)) >> U(32)).astype(np.int8)
    sig, of = [], []
    for step in (0, 1):
        band = own - step
        ok = (band >= 0) & (size > 0)
        if step:  # a smaller partner may be in the band below
            ok &= size * percent <= 100 * ends[np.maximum(band, 0)]
        band = np.where(ok, band, 0)
        n1 = np.where(ok, parts[band], 0)
        take = rare & (n1[row] > 0)
        r, v, inner = row[take], value[take], second[take]
        first = ((h[take] >> U(32)) * n1[r].astype(np.uint64)) >> U(32)  # grows with h: a part's elements stand together
        edge = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
        ends_of = np.append(edge, len(v))
        total = [segment_sums(np.where(inner == j, v, U(0)), ends_of) for j in range(PARTS)]
        held = np.stack([np.diff(np.append(0, np.cumsum(inner == j))[ends_of]) > 0 for j in range(PARTS)])
        for n, subset in enumerate(SUBSETS):
            some = np.flatnonzero(np.logical_or.reduce(held[list(subset)]))
            salt = mix(band[r[edge[some]]].astype(np.uint64) << U(34) | first[edge[some]] << U(2) | U(n))
            sig.append(mix(np.sum([total[j][some] for j in subset], axis=0, dtype=np.uint64) ^ salt))
            of.append(r[edge[some]])
        strong = np.bincount(r[edge[held.sum(0) > APART]], minlength=len(size))
        for i in np.flatnonzero((n1 > 0) & (n1 - strong > spares[band])):
            s, c = h[cut[i] : cut[i + 1]], ~rare[cut[i] : cut[i + 1]]
            m = len(s)
            prefix = s[np.lexsort((s, c))][: m - -(-percent * m // 100) + 1]
            sig.append(mix(prefix ^ mix(np.array([band[i] + 7777], np.uint64))))
            of.append(np.full(len(prefix), i))
    return np.concatenate(sig), np.concatenate(of)


def fingerprints(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Two independent hashes of each whole set, as rows of two."""
    size = np.diff(cut).astype(np.uint64) * U(0x9FB21C651E98DF25)
    return np.stack([mix(segment_sums(mix(h + U(x)), cut) + size) for x in (0x632BE59BD9B4E019, 0xC2B2AE3D27D4EB4F)], 1)


def sketches(h: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """Parities of the numbers of elements in cells, 512 or about as many as elements: the bits in which two sketches
    differ never exceed the distance. A sketch folds to one of half the cells by exclusive or of its halves."""
    size = np.diff(cut)
    bits = SKETCH_BITS << np.clip(np.ceil(np.log2(np.maximum(size, 1) / SKETCH_BITS)), 0, SKETCH_DOUBLINGS).astype(np.int64)
    begin = np.append(0, np.cumsum(bits))
    cell = np.repeat(begin[:-1], size) + (mix(h + U(99)) & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(cell, minlength=begin[-1]) & 1).astype(np.uint8))
    return [packed[i // 8 : j // 8].tobytes() for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def fold(column: list[bytes], size: int) -> np.ndarray:
    """Sketches of one length, folded to `size` bytes, as rows of 64-bit words."""
    whole = np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1, size // 8)
    return np.bitwise_xor.reduce(whole, axis=1)


def describe(docs: DataFrame, k: int) -> DataFrame:
    """Per document: doc_id, n_shingles, fp and fp2 (of the whole set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, cut in shingle_sets(batch.column(1), k):
                fp, fp2 = signed(np.ascontiguousarray(fingerprints(h, cut).T))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(cut)), pa.array(fp), pa.array(fp2), pa.array(sketches(h, cut), pa.binary())],
                    ["doc_id", "n_shingles", "fp", "fp2", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n_shingles long, fp long, fp2 long, sketch binary")


def common_shingles(docs: DataFrame, n: int, k: int) -> np.ndarray:
    """Sorted hashes of shingles in at least 1 % of a sample of about 4,096 of n documents (efficiency only)."""
    share = min(1 << 20, (SAMPLE_SETS << 20) // max(n, 1))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).select("text")
    least = max(8, int(COMMON_SHARE * min(n, SAMPLE_SETS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, _ in shingle_sets(batch.column(0), k):
                got, count = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(got)), pa.array(count)], ["h", "n"])

    count = some.mapInArrow(released(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = count.orderBy(F.desc("n"), "h").limit(COMMON_MOST).select("h").collect()
    return np.sort(np.array([x.h for x in rows], np.int64).view(np.uint64))


def sign(docs: DataFrame, common: np.ndarray, percent: int, k: int) -> DataFrame:
    """(sig, fp) of every document's set; a set is signed once in a task, however many copies it has there."""
    held = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, "u8,u8")
        for batch in batches:
            for _, _, h, cut in shingle_sets(batch.column(0), k):
                both = np.ascontiguousarray(fingerprints(h, cut)).view("u8,u8").ravel()
                sig, of = signatures(h, cut, held.value, percent)
                _, first = np.unique(both, return_index=True)
                new = np.zeros(len(both), bool)
                new[first] = True
                new &= ~np.isin(both, seen)
                seen = np.append(seen, both[new])[-(1 << 19) :]
                keep = new[of]
                yield pa.RecordBatch.from_arrays([pa.array(signed(sig[keep])), pa.array(signed(np.ascontiguousarray(both["f0"])[of[keep]]))], ["sig", "fp"])

    return docs.select("text").mapInArrow(released(run), "sig long, fp long")


def busy_groups(docs: DataFrame, common: np.ndarray, percent: int, k: int, split_group: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of so many sets that one task should not have to read them all, by a sixteenth of the documents, and
    members of each to compare the others with. At most four signatures for every shuffle partition; they only shift work."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = sign(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0), common, percent, k)
    hubs = [F.min(F.when(F.pmod("fp", F.lit(HUBS)) == i, F.col("fp"))).alias(f"m{i}") for i in range(HUBS)]
    rows = some.groupBy("sig").agg(F.count("*").alias("n"), F.min("fp").alias("least"), *hubs).where(F.col("n") * 16 >= split_group)
    rows = sorted(rows.orderBy(F.desc("n"), "sig").limit(4 * parts).collect())
    return np.array([x.sig for x in rows], np.int64), np.array([[x.least if x[3 + i] is None else x[3 + i] for i in range(HUBS)] for x in rows], np.int64)


def pair_up(signed_sets: DataFrame, busy: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """From (sig, fp): rows (a, b, null), pairs to check, and (null, fp, sig), the members of large groups.

    A group of at most 32 gives all its pairs. A larger one gives the pairs with its 4 least members, the same in
    every group that they are in; residue() deals with the others. Rows are streamed in order: a task holds at most 32
    members of a group. Busy groups are dealt over several tasks, and meet the members given with them.
    """
    spark = signed_sets.sparkSession
    sent = spark.sparkContext.broadcast(busy if busy is not None and len(busy[0]) else (np.zeros(0, np.int64), np.zeros((0, HUBS), np.int64)))
    dealt = signed_sets.repartition("sig")
    if len(sent.value[0]):
        marks = spark.createDataFrame([(int(x),) for x in sent.value[0]], "sig long").withColumn("busy", F.lit(True))
        salted = signed_sets.join(F.broadcast(marks), "sig", "left")
        dealt = salted.repartition("sig", F.when(F.col("busy"), F.pmod("fp", F.lit(1 << 16))).otherwise(0)).drop("busy")
    dealt = dealt.sortWithinPartitions("sig", "fp")

    def table(a: np.ndarray, b: np.ndarray, sig: np.ndarray | None) -> pa.RecordBatch:
        empty = pa.nulls(len(b), pa.int64())
        cols = [pa.array(a), pa.array(b), empty] if sig is None else [empty, pa.array(b), pa.array(sig)]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", "sig"])

    def star(hubs: np.ndarray, sig: int, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        both = np.stack([np.repeat(hubs, len(own)), np.tile(own, len(hubs))], 1)
        both = np.sort(both[both[:, 0] != both[:, 1]], axis=1)
        yield table(both[:, 0].copy(), both[:, 1].copy(), None)
        yield table(own, own, np.full(len(own), sig))

    def small(fp: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for g in np.unique(size[size > 1]):
            i, j = np.triu_indices(g, 1)
            at = first[size == g][:, None]
            a.append(fp[at + i].ravel())
            b.append(fp[at + j].ravel())
        if a:
            both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
            yield table(both[:, 0].copy(), both[:, 1].copy(), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        busy_sig, busy_hubs = sent.value
        last, large, kept = None, None, (np.zeros(0, np.int64),) * 2  # the row before; the open group's sig and hubs; its rows
        for batch in batches:
            sig, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            if not len(sig):
                continue
            new = np.append(last != (sig[0], fp[0]), (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1]))
            last = (sig[-1], fp[-1])
            sig, fp = sig[new], fp[new]
            if large is not None and len(sig):
                n = int(np.searchsorted(sig, large[0], "right"))
                yield from star(large[1], large[0], fp[:n])
                large = large if n == len(sig) else None
                sig, fp = sig[n:], fp[n:]
            sig, fp = np.append(kept[0], sig), np.append(kept[1], fp)
            if not len(sig):
                continue
            first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            size = np.diff(np.append(first, len(sig)))
            told = np.isin(sig[first], busy_sig)
            many = (size > ALL_PAIRS) | told
            open_end = not many[-1]
            few = np.flatnonzero(~many)[: -1 if open_end else None]
            yield from small(fp, first[few], size[few])
            for i in np.flatnonzero(many).tolist():
                own = fp[first[i] : first[i] + size[i]]
                hubs = busy_hubs[np.searchsorted(busy_sig, sig[first[i]])] if told[i] else own[:HUBS]
                yield from star(np.unique(hubs), sig[first[i]], own)
                if i == len(first) - 1:
                    large = (sig[first[i]], np.unique(hubs))
            kept = (sig[first[-1] :], fp[first[-1] :]) if open_end else (sig[:0], fp[:0])
        if len(kept[0]):
            yield from small(kept[1], np.zeros(1, np.int64), np.array([len(kept[0])]))

    return dealt.select("sig", "fp").mapInArrow(released(run), "a long, b long, sig long")


def near(size_a: np.ndarray, size_b: np.ndarray, sketch_a: np.ndarray, sketch_b: np.ndarray, percent: int) -> np.ndarray:
    """False only for pairs that sizes or sketches show to be below the threshold."""
    fits = (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)) & (np.minimum(size_a, size_b) > 0)
    differ = np.bitwise_count(sketch_a ^ sketch_b).sum(axis=-1, dtype=np.int64)
    return fits & (differ <= max_distance(size_a + size_b, percent))


def screen(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those that sizes and sketches leave possible, with the classes' representatives."""
    one = classes.select(F.col("fp").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"), F.col("rep").alias("ra"))
    two = classes.select(F.col("fp").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"), F.col("rep").alias("rb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            na, nb = (x.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            sa, sb = (np.array(x.column(c).to_pylist(), object) for c in ("sa", "sb"))
            la, lb = (np.fromiter(map(len, s), np.int64, len(s)) for s in (sa, sb))
            ok = np.zeros(len(na), bool)
            for i, j in {*zip(la.tolist(), lb.tolist(), strict=True)}:
                at = np.flatnonzero((la == i) & (lb == j))
                ok[at] = near(na[at], nb[at], fold(list(sa[at]), min(i, j)), fold(list(sb[at]), min(i, j)), percent)
            yield x.select(["a", "b", "ra", "rb"]).filter(pa.array(ok))

    return pairs.join(one, "a").join(two, "b").mapInArrow(released(run), "a long, b long, ra long, rb long")


def only(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """docs (doc_id, text) without most rows whose id is not needed, before they are exchanged.

    The filter is a bitmap of 2**22 hashed ids, whatever the number of ids: made by aggregation, half a megabyte.
    """
    place = needed.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("p"))
    words = place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    held = np.zeros(FILTER_BITS // 64, np.int64)
    for x in words.collect():
        held[x.w] = x.bits
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).to_numpy(zero_copy_only=False)
            ok = (sent.value[p >> 6] >> (p & 63)) & 1
            yield batch.select([0, 1]).filter(pa.array(ok.astype(bool)))

    return docs.withColumn("p", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))).mapInArrow(released(run), "doc_id long, text string")


def texts_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(doc_id, text) of the ids of `needed` (doc_id), one row an id: equal ids of a class stand for one text."""
    return only(docs.select("doc_id", "text"), needed).join(needed, "doc_id", "left_semi")


def verify(pairs: DataFrame, docs: DataFrame, percent: int, k: int) -> DataFrame:
    """(u, v): the representatives of pairs whose shingle sets reach the threshold, counted exactly."""
    needed = pairs.select(F.col("ra").alias("doc_id")).union(pairs.select(F.col("rb").alias("doc_id"))).distinct()
    texts = materialise(texts_of(docs, needed), "texts", 1024)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            one = [h[cut[r] : cut[r + 1]] for i, j, h, cut in shingle_sets(x.column("ta"), k) for r in range(j - i)]
            two = [h[cut[r] : cut[r + 1]] for i, j, h, cut in shingle_sets(x.column("tb"), k) for r in range(j - i)]
            ok = []
            for p, q in zip(one, two, strict=True):
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            yield x.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.select(F.col("ra").alias("u"), F.col("rb").alias("v"))
    joined = left.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tb")), "v")
    joined = joined.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("ta")), "u")
    return joined.select("u", "v", "ta", "tb").mapInArrow(released(run), "u long, v long").distinct()


def joining_links(t: pa.Table, percent: int) -> pa.Table:
    """(u, v): links of one block's sets that join two of its components, at most one fewer than there are.

    t has rep, label, home (whether the set belongs to the block), stranger (whether it is outside the group's largest
    component) and shingles (sorted hashes). Strangers are counted against all sets of the block over an inverted list.
    """
    t = t.combine_chunks()
    rep, label, home, stranger = (t.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "label", "home", "stranger"))
    held = t.column("shingles").combine_chunks()
    size = np.diff(held.offsets.to_numpy()).astype(np.int64)
    flat = held.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(rep)), size)
    mine = np.flatnonzero(home[of])
    order = np.argsort(flat[mine], kind="stable")
    listed, owner = flat[mine][order], of[mine][order]
    names, place = np.unique(label, return_inverse=True)
    root = np.arange(len(names))
    u, v = [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x in np.flatnonzero(stranger):
        own = flat[begin[x] : begin[x] + size[x]]
        lo = np.searchsorted(listed, own, "left")
        n = np.searchsorted(listed, own, "right") - lo
        met = owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        both = np.bincount(met, minlength=len(rep))
        for y in np.flatnonzero((both > 0) & (100 * both >= percent * (size[x] + size - both)) & (place != place[x])).tolist():
            i, j = find(place[x]), find(place[y])
            if i != j:
                root[max(i, j)] = min(i, j)
                u.append(rep[x])
                v.append(rep[y])
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def residue(members: DataFrame, classes: DataFrame, labels: DataFrame, docs: DataFrame, percent: int, k: int, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(u, v): links between components that the first links left apart in large groups, enough to join them.

    Groups of equal membership count once. A set is at home in one block of its group of about 262,144 shingles; members
    outside the group's largest component also visit the other blocks. No task has to hold a group.
    """
    known = classes.select("fp", "n_shingles", "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    known = known.select("fp", "n_shingles", "rep", F.coalesce("label", "rep").alias("label"))
    rows = materialise(members.distinct().join(known, "fp").drop("fp"), "members")
    share = rows.groupBy("sig", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"), F.bit_xor(F.xxhash64("rep")).alias("who"))
    mixed = share.groupBy("sig").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.bit_xor("who").alias("who"), F.max(F.struct("n", "label")).alias("main"))
    once = mixed.where("labels > 1").groupBy("n", "who").agg(F.min(F.struct("sig", "w", "main")).alias("m"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("m.w") / block)).cast("int")
    once = materialise(once.select("m.sig", F.col("m.main.label").alias("main"), blocks.alias("blocks")), "mixed")
    dealt = rows.join(once, "sig").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("stranger", F.col("label") != F.col("main"))
    visits = F.when(F.col("stranger"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    dealt = dealt.select("sig", "rep", "label", "stranger", "own", F.explode(visits).alias("block"))
    dealt = materialise(dealt.select("sig", "block", "rep", "label", "stranger", (F.col("own") == F.col("block")).alias("home")), "dealt")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, cut in shingle_sets(batch.column(1), k):
                held = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(signed(h)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), held], ["rep", "shingles"])

    sets = texts_of(docs, dealt.select(F.col("rep").alias("doc_id")).distinct()).mapInArrow(released(shingled), "rep long, shingles array<long>")
    whole = dealt.join(sets, "rep")
    return whole.groupBy("sig", "block").applyInArrow(lambda t: joining_links(t, percent), "u long, v long").distinct()


def jaccard_components(docs: DataFrame, percent: int = 80, k: int = 5, split_group: int = SPLIT_GROUP, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Two documents link when 100 * intersection >= percent * union of their sets of k-word shingles (bytes A-Z
    lower-cased; words are runs of bytes other than ASCII white space). A document with fewer than k words has its
    whole sequence as its one shingle; an empty or null text has no shingle and links with nothing. Equal sets are
    one class and are not paired. One row comes out for every row that goes in; rows of a null doc_id take part in
    no link and have a null component_id. Other columns are ignored. An empty table gives an empty one. split_group
    and block only shift work between tasks.
    """
    docs = docs.select("doc_id", "text")
    info = materialise(describe(docs, k), "shingles", 2048)
    live = info.where("n_shingles > 0 and doc_id is not null")
    classes = live.groupBy("fp", "fp2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = materialise(classes, "classes")
    n = info.count()
    common = common_shingles(docs, n, k)
    own = docs.where("doc_id is not null")
    busy = busy_groups(own, common, percent, k, split_group) if n >= split_group else None
    found = materialise(pair_up(sign(own, common, percent, k), busy), "pairs", 8192)
    pairs = screen(found.where("a is not null").select("a", "b").distinct(), classes, percent)
    links = materialise(verify(materialise(pairs, "screened", 2048), docs, percent, k), "links", 256)
    members = found.where("sig is not null").select(F.col("b").alias("fp"), "sig")
    if not members.isEmpty():
        links = links.union(materialise(residue(members, classes, components(links), docs, percent, k, block), "residue"))
    # Rows of one doc_id with different texts are one node of the graph.
    same = live.select("doc_id", "fp", "fp2").join(classes.select("fp", "fp2", "rep"), ["fp", "fp2"]).where("doc_id <> rep")
    label = components(links.union(same.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))))
    return info.join(label, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
