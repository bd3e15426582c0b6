"""Phrases against one regex each; terms of people and self-description by hand."""

import random
import re

from pyspark.sql import functions as F

from docsieve.functions import identity as I


def test_phrases_equal_one_regex_each(spark):
    rng = random.Random(2)
    words = ["a", "b", "ab", "b c", "É", "a.", "c,", "B", "x\n", "ab-a", "_a", "a'", "İ"]
    phrases = ["a", "a b", "b c", "ab", "é", "a b a", "", " b  c ", "ab a"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(300)] + [None, "", "a " * 5000]
    rows = spark.createDataFrame([(i, t, rng.choice([None, [], ["a b"], ["B c", "c", None]])) for i, t in enumerate(texts)], "i long, t string, n array<string>")
    out = rows.select("i", "t", "n", I.phrase_hits(F.col("t"), phrases, F.col("n")).alias("h")).collect()
    for r in out:
        t = re.sub(r"\s+", " ", r.t or "")
        for n in sorted({n for n in r.n or [] if n and len(n) > 1}, key=len, reverse=True):
            t = re.sub(rf"(?<![^\W_]){re.escape(n)}(?![^\W_])", lambda m: "x" * len(m[0]), t, flags=re.I)
        want = sorted((m.start(), p) for p in {re.sub(r"\s+", " ", p).strip() for p in phrases} - {""} for m in re.finditer(rf"(?<![^\W_]){p}(?![^\W_])", t, re.I))
        assert [(h["at"], h["phrase"]) for h in r.h] == want, (r.t, r.n)
    assert rows.select(I.phrase_hits(F.col("t"), []).alias("h")).where("size(h) > 0").count() == 0


def test_people(spark):
    texts = ["He is a quaker.", "A Quaker hymn was sung", "The Quaker Hill band", "the \"quaker\" tune", "In Quaker halls Ann Quaker Lowe sang", "She calls herself a quaker", "She was identified as a quaker", "Ann identifies as a quaker", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = df.select("i", I.of_people(I.phrase_hits(F.col("t"), ["quaker"])).alias("p"), I.self_describes(F.col("t")).alias("s")).orderBy("i").collect()
    assert [len(r.p) for r in got] == [1, 0, 0, 0, 1, 1, 1, 1, 0]
    assert [r.s for r in got] == [False] * 5 + [True, False, True, False]
    df = df.withColumn("p", I.of_people(I.phrase_hits(F.col("t"), ["quaker"])))
    assert [r[0] for r in df.orderBy("i").select(I.self_described(F.col("t"), F.col("p"), F.array(F.lit("quaker")))).collect()] == [False] * 5 + [True, False, True, False]
