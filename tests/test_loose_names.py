"""Strings within a budget of edits and names a few letters off, against all pairs."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import Row

from docsieve.operators import loose_names as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def strings(rng, n, longest, letters="ab"):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)})


@pytest.mark.parametrize("small", [100_000, 0])
def test_within_budget_equals_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(L, "SMALL", small)
    rng = random.Random(2)
    for percent, longest, letters in ((15, 9, "ab"), (30, 14, "ab"), (15, 24, "a"), (50, 7, "abc")):
        left, right = strings(rng, 120, longest, letters), strings(rng, 120, longest, letters)
        frame = lambda xs: spark.createDataFrame([(x,) for x in [*xs, *xs[:5], None]], "s string")
        budget = lambda n: max(1, n * percent // 100)  # noqa: E731,B023
        got = [tuple(r) for r in L.within_budget(frame(left), frame(right), L.share_of(percent)).collect()]
        assert sorted(got) == sorted((a, b) for a in left for b in right if distance(a, b) <= budget(len(b)))
        got = [tuple(r) for r in L.close_pairs(frame(left), percent).collect()]
        assert sorted(got) == sorted(p for p in itertools.combinations(left, 2) if distance(*p) <= budget(max(map(len, p))))
    assert L.within_budget(frame([]), frame([]).where("false"), L.share_of(15)).count() == 0


def loosely(text, name):
    if f" {name} " in f" {text} ":
        return True
    words, want, n = text.split(), name.replace(" ", ""), len(name.split())
    for size in range(max(1, n - 1), n + 2):
        for i in range(len(words) - size + 1):
            run, got = words[i : i + size], "".join(words[i : i + size])
            other = len(run) == n and any(x != y and len(x) == len(y) == 1 for x, y in zip(run, name.split(), strict=True))
            if len(want) >= 5 and not other and abs(len(got) - len(want)) <= 2 and distance(got, want) <= max(1, len(want) * 15 // 100):
                return True
    return False


@pytest.mark.parametrize("small", [100_000, 0])
def test_named_loosely_equals_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(L, "SMALL", small)
    rng = random.Random(3)
    names = ["abba", "a", "luis f rodriguez", "luis j rodriguez", "colbie cailat", "the very long name of an orchestra", "x y", "moon light", "moonlight", "lake"]
    bits = [*names, "colbie caillat", "luis rodriguez", "luisf rodriguez", "moonligt", "mon light", "the very lng name of an orchestre", "lak", "abbas", "and", "of", "b", ""]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 7)))) for i in range(150)] + [(500, None), (501, ""), (502, "abba " * 5000)]
    rows = [(i, None if t is None else " ".join(t.split())) for i, t in rows]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {(r.id, r.name): r.exact for r in L.named_loosely(df, spark.createDataFrame([(n,) for n in [*names, names[0], None, ""]], "nm string"), "id", "t", "nm").collect()}
    assert set(got) == {(i, n) for i, t in rows if t for n in names if loosely(t, n)}
    assert all(exact == (f" {n} " in f" {dict(rows)[i]} ") for (i, n), exact in got.items()) and {True, False} == set(got.values())
    assert L.named_loosely(df, df.where("false"), "id", "t", "t").count() == 0


@pytest.mark.parametrize(("words", "places"), [(50_000, 250_000), (4, 3), (1, 1)])
def test_sought_runs_hold_all_names(monkeypatch, words, places):
    monkeypatch.setattr(L, "WORDS", words)
    monkeypatch.setattr(L, "PLACES", places)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9)))
    names = sorted({" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(60)})

    def off(s):
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(s))
            s = s[:i] + rng.choice(["", "a", "é", " "]) + s[i + rng.randint(0, 1) :]
        return " ".join(s.split())

    texts = [" ".join(rng.choice([off(rng.choice(names)), word()]) for _ in range(rng.randint(0, 30))) for _ in range(80)] + [None, ""]
    rows = [Row(name=x, n=len(x.split()), b=(b := x.replace(" ", "")), e=max(1, len(b) * 15 // 100) if len(b) >= 5 else -1) for x in names]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "t"])
    got = {tuple(r.values()) for b in L._Sought(rows).runs(iter([batch])) for r in b.to_pylist()}
    assert all(f" {run} " in f" {texts[i]} " for i, _, run in got)
    for i, text in enumerate(texts):
        for name in names:
            assert not text or not loosely(text, name) or any((i, name) == x[:2] and loosely(x[2], name) for x in got), (text, name)
            assert not text or f" {name} " not in f" {text} " or (i, name, name) in got


def test_runs_of_texts_are_no_rows(spark):
    texts = spark.createDataFrame([(1, "luis f rodrigues and the moon light"), (2, "b c d")], "id long, t string")
    found = L.named_loosely(texts, spark.createDataFrame([("luis f rodriguez",), ("moonlight",)], "nm string"), "id", "t", "nm")
    assert sorted(map(tuple, found.collect())) == [(1, "luis f rodriguez", False), (1, "moonlight", False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_folded_one_by_one():
    import unicodedata

    import pandas as pd

    from docsieve.functions.text import fold_case

    rng = random.Random(6)
    texts = [None, "", "Plain ASCII", "ΟΔΟΣ Ὀδυσσεύς", "İstanbul", "각한", "a\u0323\u0307b"] + ["".join(chr(rng.choice([rng.randint(32, 0x2FFF), rng.randint(0x300, 0x36F), rng.randint(0xAC00, 0x1FFFF)])) for _ in range(30)) for _ in range(2000)]
    want = [None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)).lower() for x in texts]
    assert list(fold_case.func(pd.Series(texts, dtype=object))) == want
