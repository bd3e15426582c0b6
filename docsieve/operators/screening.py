"""Screening of a batch of captions: the first reason of each, then greedy removal of near-duplicates."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.functions.grounding import known, screen_reason
from docsieve.functions.text import content_tokens, share
from docsieve.operators.state import fold


class Kept:
    """The kept captions of one batch by slot, and the slots in which each token stands."""

    def __init__(self) -> None:
        self.seen = 0
        self.slots: list[tuple[tuple[int, int], set[str], float]] = []
        self.by_token: dict[str, set[int]] = defaultdict(set)

    def first_near(self, tokens: set[str]) -> int | None:
        """The first slot whose caption is near; only slots with a token in common are looked at."""
        both = Counter(slot for t in tokens for slot in self.by_token.get(t, ()))
        near = (s for s, n in both.items() if is_near(n, len(self.slots[s][1]), len(tokens)))
        return min(near, default=None)

    def put(self, slot: int, caption: tuple[tuple[int, int], set[str], float]) -> None:
        if slot < len(self.slots):
            for t in self.slots[slot][1]:
                self.by_token[t].discard(slot)
            self.slots[slot] = caption
        else:
            self.slots.append(caption)
        for t in caption[1]:
            self.by_token[t].add(slot)


def is_near(both: int, a: int, b: int) -> bool:
    """The rule of `too_similar` on numbers."""
    return min(a, b) > 0 and (2 * both >= a + b - both or 10 * both >= 7 * min(a, b))


def taken(kept: Kept, caption: tuple) -> tuple[Kept, tuple]:
    """The next caption in order and (pos, nth, reason, pos and nth of one that it replaces)."""
    pos, tokens, support, reason = caption
    kept.seen += 1
    me = (pos, kept.seen)
    if reason is not None:
        return kept, (*me, reason, None, None)
    words = set(tokens)
    slot = kept.first_near(words)
    if slot is not None and support <= kept.slots[slot][2]:
        return kept, (*me, "duplicate", None, None)
    out = (None, None) if slot is None else kept.slots[slot][0]
    kept.put(len(kept.slots) if slot is None else slot, (me, words, support))
    return kept, (*me, None, *out)


def screen(captions: DataFrame, batch: str, pos: str) -> DataFrame:
    """captions (batch, pos, caption, source) with reason, null for those kept; known may hold what grounding.known tells of the source.

    Survivors of the reasons are taken in order. One that is a near-duplicate of a kept one, the first such counts, is
    rejected as "duplicate", unless it has strictly more support of its source: then it takes the slot of the kept one,
    which is rejected as "replaced". One that was put in is not compared with the others again. The captions stream in
    order; of a batch only the kept ones are held, as each is compared with all of them. Captions of null pos take no part;
    those of one pos come in the order of their tokens, and each has a row.
    """
    held = captions if "known" in captions.columns else captions.withColumn("known", known(F.col("source")))
    caption, facts = F.col("caption"), F.col("known")
    rows = held.withColumn("tokens", content_tokens(caption)).withColumn("reason", screen_reason(caption, F.col("source"), facts))
    late = F.col("reason").isNull()
    rows = rows.select(batch, F.col(pos).cast("long").alias("p"), F.when(late, F.col("tokens")).alias("tokens"), F.when(late, share(F.col("tokens"), facts["words"])).alias("support"), "reason")
    told = fold(rows, batch, ["p", "tokens", "support", "reason"], "p long, nth long, reason string, out_p long, out_nth long", Kept, taken, lambda _: None)
    each = F.array(F.struct("p", "nth", "reason"), F.struct(F.col("out_p").alias("p"), F.col("out_nth").alias("nth"), F.lit("replaced").alias("reason")))
    each = told.select(batch, F.explode(each).alias("o")).where("o.p is not null").select(batch, "o.*")
    return each.groupBy(batch, "p", "nth").agg(F.max("reason").alias("reason")).select(batch, F.col("p").alias(pos), "reason")
