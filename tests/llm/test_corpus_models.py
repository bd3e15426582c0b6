"""Spelling groups, whitening and text scores against brute force, and on odd tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from docsieve.llm import lm_scoring, whitening
from docsieve.llm.lm_scoring import lm_scores
from docsieve.llm.spelling import near_words, spelling_groups

SCHEMA = "doc_id long, text string, word string, n long, key string, block long, row int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 3, "k", 7, 1) for i, t in rows], SCHEMA)


def crc(text):
    return zlib.crc32(text.encode())


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_groups(rows):
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = crc(f"{'' if i is None else i}:{run}")
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        near = [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x.encode()), default=None)
        form = best if near and words[best] >= 5 * n else None
        out[w] = [form, w, n, len(near), words[form] if form else None]
    for row in out.values():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {w: tuple(row) for w, row in out.items()}


def variants(rng, base, n):
    out = set(base)
    while len(out) < n:
        w = rng.choice(sorted(out))
        i, c = rng.randrange(len(w) + 1), rng.choice("aabcéÿ")
        out.add(rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]]))
    return sorted(out)


def test_spelling_groups_equal_brute_force(spark):
    rng = random.Random(3)
    words = variants(rng, ["aaaaaa", "abababab", "colour", "organisation", "naïvetés"], 400)
    rows = []
    for i in range(150):
        picked = [rng.choice(words) for _ in range(60)] + [rng.choice(["colour", "Colour", "ORGANISATION", "aaaaaa"]) for _ in range(rng.randint(0, 40))]
        rows.append((i, rng.choice([" ", "-", "9", "\n"]).join(picked)))
    rows += [(200, "qwertya " * 6 + "qwertyb " * 40 + "qwertbb " * 300)]  # forms that lead on
    rows += [(None, "colours " * 7), (None, None), (7, ""), (8, " \n"), (9, "Ünïcödé×÷ÿÿÿ " * 20_000), (9, "colour " * 3), (9, "colour " * 3)]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_groups(frame(spark, rows)).collect()}
    want = brute_groups(rows)
    assert got == want
    assert sum(w[3] for w in want.values()) > 300 and any(w[0] and w[0] != w[1] for w in want.values())
    assert spelling_groups(frame(spark, rows).where("false")).count() == 0


def test_near_words_equal_brute_force(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(300)} | {"abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxy"})
    got = [(r.word, r.near) for r in near_words(spark.createDataFrame([(w, 9) for w in words], "word string, n long")).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if a != b and one_edit(a, b))


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<float>, label int, x string")


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(300, 9)) * [9, 5, 3, 2, 1, 1, 1, 0.5, 0.1] + 4000).astype(np.float32)
    rows = [(k, base[k % 250].tolist()) for k in range(1000)] + [(5000 + k, base[7].tolist()) for k in range(500)]
    odd = [(None, base[3].tolist()), (1 << 60, base[4].tolist()), (2, None), (3, []), (4, [1.0, None] + [0.0] * 7), (5, [math.inf] + [0.0] * 8), (6, [math.nan] + [0.0] * 8), (7, [1.0])]
    got = whitening.whitening(vectors(spark, rows + odd).repartition(5)).collect()
    kept = [r for r in rows + odd[:2]]
    x = np.floor(256 * np.array([r[1] for r in kept], np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    assert len(got) == 4 * len(kept)
    of = collections.defaultdict(list)
    for r in got:
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9
        of[r.vec_id, r.component].append((r.deviation, r.whitened))
    for c in range(4):
        one = np.array([of[r[0], c + 1][0][1] for r in kept])
        want = (x - sums / n) @ axes[:, c] / math.sqrt(e[c])
        assert np.abs(one * np.sign(one @ want) - want).max() < 1e-8
    for (i, _), row in zip(kept, x.tolist(), strict=True):
        assert of[i, 1][0][0] == sum((n * v - int(s)) ** 2 for v, s in zip(row, sums, strict=True))
    assert len(of[5001, 1]) == 1


def test_whitening_without_variance(spark):
    assert whitening.whitening(vectors(spark, [])).count() == 0
    assert whitening.whitening(vectors(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    flat = whitening.whitening(vectors(spark, [(k, [float(k), 2.0, 2.0 * k]) for k in range(9)])).collect()
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    huge = whitening.whitening(vectors(spark, [(k, [1e16 * k, 1.0]) for k in range(3)])).collect()
    assert len(huge) == 3 and huge[0].deviation is None and abs(huge[2].whitened**2 - 1.5) < 1e-9


class Tree:
    """Context-tree weighting of one decision, node by node, in plain Python."""

    def __init__(self, depth):
        self.depth, self.children, self.n = depth, {}, [0, 0]

    def add(self, context, bit):
        self.n[bit] += 1
        if self.depth:
            self.children.setdefault(context[-1], Tree(self.depth - 1)).add(context[:-1], bit)

    def settle(self):
        a, b = self.n
        self.kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        below = sum(c.settle() for c in self.children.values())
        self.mixed = math.log(0.5) + np.logaddexp(self.kt, below) if self.depth else self.kt
        return self.mixed

    def one(self, context):
        p = (self.n[1] + 0.5) / (sum(self.n) + 1)
        child = self.children.get(context[-1]) if self.depth else None
        stop = 1.0 if child is None else math.exp(math.log(0.5) + self.kt - self.mixed)
        return stop * p + (0 if child is None else (1 - stop) * child.one(context[:-1]))


def token_bytes(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def brute_scores(rows):
    depth = lm_scoring.DEPTH
    trees, count = collections.defaultdict(lambda: Tree(depth)), collections.Counter()
    held = [crc("" if i is None else str(i)) % 7 == 2 for i, _ in rows]

    def steps(text):
        raw = b"\n" * depth + b" ".join(token_bytes(text)) + b"\n"
        for k in range(depth, len(raw)):
            for j in range(7, -1, -1):
                yield (raw[k] | 256) >> (j + 1), raw[k - depth : k], raw[k] >> j & 1

    for h, (_, text) in zip(held, rows, strict=True):
        if not h:
            count.update([*token_bytes(text), None])
            for prefix, context, bit in steps(text):
                trees[prefix].add(context, bit)
    for t in trees.values():
        t.settle()
    total, distinct, out = sum(count.values()), len(count), []
    for h, (i, text) in zip(held, rows, strict=True):
        tokens = [*token_bytes(text), None]
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in tokens)
        score = sum(math.log10(p if bit else 1 - p) for prefix, context, bit in steps(text) for p in [trees[prefix].one(context) if prefix in trees else 0.5])
        out.append((-1 if i is None else i, h, len(tokens), sum(count[w] > 0 for w in tokens), total, round(base, 6), round(score, 6)))
    return sorted(out)


def scored(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 3000, "PIECE": 200, "BUCKET": 50, "PACK": 100, "STEP": 64}])
def test_scores_equal_brute_force(spark, monkeypatch, sizes):
    for name, size in sizes.items():
        monkeypatch.setattr(lm_scoring, name, size)
    rng = random.Random(6)
    words = ["lake", "Stone", "naïve", "the", "of", "run-off", "\x00", "日本"]
    rows = [(i, rng.choice([" ", "\n", "  \t"]).join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n "), (None, "null id"), (103, " lead"), (103, "tail "), (104, "x" * 700), (105, "lake " * 500), (106, "unheard Ωords"), (106, "unheard Ωords")]
    assert any(crc(str(i)) % 7 == 2 for i, t in rows if i is not None)
    assert scored(lm_scores(frame(spark, rows).repartition(3))) == brute_scores(rows)


def test_scores_of_an_empty_table_and_of_nothing_learnt(spark):
    assert lm_scores(frame(spark, []).where("false")).count() == 0
    out_id = next(i for i in range(100) if crc(str(i)) % 7 == 2)
    (r,) = lm_scores(frame(spark, [(out_id, "ab c")])).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)
    assert abs(r.score + 40 * math.log10(2)) < 1e-9 and abs(r.bits_per_byte - 8) < 1e-9


def test_held_out_texts_cost_less_than_their_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = lm_scores(docs).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
