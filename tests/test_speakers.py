"""Whose words and deeds captions tell: by hand, and against plain Python over random sources."""

import random
import re

from pyspark.sql import functions as F

from docsieve.functions.text import content_tokens, share
from docsieve.operators import speakers as S

SOURCE = 'Ada Pell wrote the tune. She said it was "a lucky accident of sound". "It came to me in the rain" was the rest. In 1933, Mara Quill recorded the tune in a barn. Otto Vale thought little of it.'


def told(spark, captions, sources):
    c = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(captions)], "cid long, k long, caption string")
    return S.told_sentences(c, spark.createDataFrame(sources, "k long, text string"), "k", "cid", "caption", "text")


def test_misattributed_words_by_hand(spark):
    captions = [
        'Ada Pell said it was "a lucky accident of sound"', 'Mara Quill said it was "a lucky accident of sound"', 'Pell recalled that "it came to me in the rain"', 'Ada Pell described it as "a dry and sunny day"', "The tune was recorded in a barn",
        'Otto Vale said he wrote "Lucky Accident" in a barn', None,
    ]
    rows = told(spark, [(1, c) for c in captions] + [(2, captions[0]), (3, captions[0])], [(1, SOURCE), (2, None), (4, "x")])
    got = {r.cid: r.name for r in S.misattributed_words(rows, "cid", "caption").collect()}
    assert got == {1: "Quill", 2: "Pell", 3: "Pell", 5: "Vale"}


def test_other_doers_by_hand(spark):
    captions = ["Dale Ortiz recorded the tune in a barn", "Mara Quill recorded the tune in a barn", "The band recorded the tune in a barn", "Dale recorded the tune in a barn", "Dale Ortiz did something else entirely with nothing"]
    got = {r.cid: r.doer for r in S.other_doers(told(spark, [(1, c) for c in captions], [(1, SOURCE)]), "cid", "caption").collect()}
    assert got == {0: "Mara Quill"}


def plain(text):
    return f" {re.sub(r'[^a-z0-9]+', ' ', text.lower())} "


def brute(caption, text):
    m = re.search(S.SAID_BY.replace(r"\p{Lu}", "[A-Z]").replace(r"\p{L}", "A-Za-z"), caption)
    names = [w for w in m[1].split() if w.lower() not in S.NAME_STOPWORDS]
    sentences = re.split(r'(?<=[.!?])\s+(?=["A-Z])|(?<=[.!?]")\s+(?=["A-Z])', text)
    tokens = lambda s: {w for w in plain(s).split() if len(w) > 2 and w not in ("the", "and", "for")}
    bare = [re.sub('"[^"]*"', "", s) for s in sentences]
    names_it = [any(plain(n) in plain(b) for n in names) for b in bare]
    gives = [
        bool(re.search(S.ATTRIBUTION, s)) and (names_it[i] or (bool(re.search(S.PRONOUN_SAYS, s)) and any(names_it[max(0, i - 2) : i])) or (bool(re.search(S.BY_THE_MAKER, s)) and names_it[0]))
        for i, s in enumerate(sentences)
    ]
    near = [g or (i > 0 and gives[i - 1] and not re.search(S.ATTRIBUTION, bare[i])) for i, g in enumerate(gives)]
    if not any(gives):
        return names[-1]
    for q in re.findall('"([^"]+)"', caption):
        q = re.sub(r"[.,!?;:]+$", "", q).strip()
        if all(w[0].isupper() or w in "a an the of in on to and for at by or".split() for w in q.split()):
            continue
        if not any(n and q in s for n, s in zip(near, sentences, strict=True)):
            return names[-1]
    shares = [len(tokens(caption) & tokens(s)) / len(tokens(caption)) for s in sentences]
    if max(shares) < 0.25:
        return None
    return None if any(n for n, x in zip(near, shares, strict=True) if x >= max(shares) - 0.1 or x >= 0.3) else names[-1]


def test_misattributed_words_equal_plain_python(spark):
    rng = random.Random(4)
    people, things = ["Ada Pell", "Otto Vale", "Mara Quill"], ["the tune was made in rain", "it came from a barn", "nobody liked the drums", "a lucky accident of sound"]
    forms = ['{p} said "{t}".', "{p} made it and {t}.", 'He said that {t}.', '"{t}" was the rest.', "It was called odd by the composer.", "In time {t}.", "{p} and {t}."]
    captions, sources = [], []
    for k in range(200):
        said = lambda: rng.choice(forms).format(p=rng.choice(people), t=rng.choice(things))
        text = " ".join(s[0].upper() + s[1:] if s[0] != '"' else '"' + s[1].upper() + s[2:] for s in (said() for _ in range(rng.randint(1, 6))))
        sources.append((k, text))
        captions.append((k, rng.choice(['{p} said that {t}', '{p} described it: "{t}"', '{p} later claimed "{t}" and more']).format(p=rng.choice(people), t=rng.choice(things))))
    got = {r.cid: r.name for r in S.misattributed_words(told(spark, captions, sources), "cid", "caption").collect()}
    want = {i: name for i, (k, c) in enumerate(captions) if (name := brute(c, sources[k][1]))}
    assert got == want and 20 < len(want) < 190


def test_told_shares_take_a_captions_tokens_once(spark):
    rng = random.Random(3)
    words = ["Lake", "lake", "the", "of", "É", "él", "été", "12", "123", "a-b", "Moon's", "...", "moon", "s"]
    line = lambda n: " ".join(rng.choices(words, k=n))
    caps = spark.createDataFrame([(i, line(rng.randint(0, 6))) for i in range(60)] + [(60, ""), (61, None)], "k long, c string")
    texts = spark.createDataFrame([(i, ". ".join("A" + line(rng.randint(0, 8)) for _ in range(4))) for i in range(62)], "k long, t string")
    told = S.told_sentences(caps.withColumn("id", F.col("k")), texts, "k", "id", "c", "t")
    assert told.where(told.share != share(content_tokens(F.col("c")), content_tokens(F.col("sentence")))).count() == 0 and told.where("share > 0").count() > 50
    joined = told._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "split(lower" in joined and "split(lower(coalesce(c" not in joined and "split(lower(c" not in joined
