"""Clauses, frames and limits that captions merge or leave out: by hand."""

import pytest

from docsieve.operators import clauses as C
from docsieve.operators import speakers as S

SOURCE = (
    "The choir was formed in 1976 by Ann Lowe and Bo Hart, who wrote songs together as a team with Cleo Marsh. According to Dana Reyes, the drums were taped twice in a barn. "
    "In the 2019 film adaptation, the harbour burns at night. By this era the lamps had electric motors. This arrangement swaps flutes against violins. "
    "The most played waltz of the 1990s was made by Ada Pell. A quiet version recorded by Ana Bell has whistles."
)


def told(spark, captions, sources=((1, SOURCE), (2, None))):
    c = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(captions)], "cid long, k long, caption string")
    return S.told_sentences(c, spark.createDataFrame(list(sources), "k long, text string"), "k", "cid", "caption", "text")


def test_merged_clauses(spark):
    captions = ["The two wrote songs together as a team in 1976", "The choir was formed with Cleo", "The choir was formed in 1976", "The two wrote songs as a team with Ann", "The lamps had electric motors in 1976", None, ""]
    rows = told(spark, [(1, c) for c in captions] + [(2, captions[0])])
    assert {r.cid: r.anchor for r in C.merged_clauses(rows, "cid", "caption").collect()} == {0: "1976", 1: "Cleo"}


def test_dropped_frames(spark):
    captions = [
        "The drums were taped twice in a barn", "Reyes said the drums were taped twice in a barn", "The harbour burns at night", "The harbour burns at night in the film", "The lamps had electric motors", "The lamps had electric motors in 1910",
        "The arrangement swaps flutes against violins", "One arrangement swaps flutes against violins", None,
    ]
    rows = told(spark, [(1, c) for c in captions])
    got = {r.cid: r.frame for r in C.dropped_frames(rows, "cid", "caption").collect()}
    assert got == {0: "according to Dana Reyes", 2: "the 2019 film adaptation", 4: "By this era", 6: "This arrangement"}
    titled = rows.selectExpr("*", "array('2019 Film', null) titles")
    assert 2 not in {r.cid for r in C.dropped_frames(titled, "cid", "caption", "titles").collect()}


def test_dropped_limits(spark):
    captions = ["The most played waltz was made by Ada Pell", "The most played waltz of the 1990s was made by Ada Pell", "The most played waltz of the 1990s", "A quiet version has whistles", "A quiet version recorded by bell has whistles", "A quiet version by Ana Bell has whistles", None]
    rows = told(spark, [(1, c) for c in captions])
    assert {r.cid: r.limit for r in C.dropped_limits(rows, "cid", "caption").collect()} == {0: "1990s", 1: "by Ada Pell", 2: "by Ada Pell", 3: "version recorded by Ana Bell", 5: "version recorded by Ana Bell"}
    mine = rows.selectExpr("*", "array('ana bell') artists")
    assert 3 not in {r.cid for r in C.dropped_limits(mine, "cid", "caption", "artists").collect()}


@pytest.mark.parametrize("rule", [C.merged_clauses, C.dropped_frames, C.dropped_limits])
def test_empty(spark, rule):
    assert rule(told(spark, [(3, "x")]), "cid", "caption").count() == 0
