"""Groups spelling variants: words one edit apart, each led to the much commoner word beside it.

The index holds positional grams. A word of L letters is cut into four consecutive grams at fixed places; one edit leaves
three of the four as they are, at their place or, behind a lost letter, one place before it. Postings are therefore kept
under three grams together, for words of L letters and for those of L - 1 that may lack one (length and position limits).
Within a posting the letters of the fourth gram have postings of their own; those of a word are merged on a heap, words that
come up as often as one edit demands are kept, and the edit is verified.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import materialise, released

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAMS = 4
OUT_ROWS = 1 << 15
PAIRS = "word string, near string, near_n long"


def corpus_words(docs: DataFrame, every: int = 199, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): the words of all texts with their counts; of one run in `every`, by its crc32, a letter is taken out first."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    run = F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _postings(words: DataFrame) -> DataFrame:
    """(length, gram, kept, middle, behind, word, n): every word under three grams together, the fourth in `middle`.

    length is that of the longer word of the pairs looked for; words of one letter less have their later grams one place before.
    """
    short = F.explode(F.array(F.lit(0), F.lit(1))).alias("short")
    roles = words.select("word", "n", short).withColumn("length", F.length("word") + F.col("short"))
    rows = roles.select("*", F.explode(F.sequence(F.lit(0), F.lit(GRAMS - 1))).alias("gram"))

    def edge(i: Column) -> Column:
        return F.floor(i * F.col("length") / GRAMS).cast("int")

    begin, end = edge(F.col("gram")), edge(F.col("gram") + 1) - F.col("short")
    before = F.substring("word", F.lit(1), begin)
    behind = F.substring("word", end + 1, F.length("word"))
    kept = F.concat(before, F.lit(" "), behind)
    return rows.select("length", "gram", kept.alias("kept"), F.substring("word", begin + 1, end - begin).alias("middle"), F.substring(behind, 1, 1).alias("behind"), "short", "word", "n")


def _listed(middles: list[str]) -> dict[tuple[int, str], list[int]]:
    """Of each letter and place the words that have it there, in order."""
    out = defaultdict(list)
    for k, middle in enumerate(middles):
        for place, letter in enumerate(middle):
            out[place, letter].append(k)
    return out


def _often(lists: list[list[int]], bound: int) -> Iterator[int]:
    """Members that come up in the lists at least `bound` times."""
    for k, times in groupby(heapq.merge(*lists)):
        if sum(1 for _ in times) >= bound:
            yield k


def near_middles(long: list[str], short: list[str], behind: str) -> Iterator[tuple[bool, int, int]]:
    """Pairs of one edit among the fourth grams of a posting: (is the second short, first, second), each pair once.

    All of `long` are different and of one length, those of `short` have a letter less. behind is the letter that follows the
    gram: a letter lost there may as well be lost in the next gram, and such a pair is left to that one.
    """
    size = len(long[0]) if long else 0
    same, less = _listed(long), _listed(short)
    for k, middle in enumerate(long):
        if size == 1:  # any two of them are one edit apart
            yield from ((False, k, other) for other in range(k + 1, len(long)))
            if middle != behind:
                yield from ((True, k, other) for other in range(len(short)))
            continue
        lists = [rest for place, letter in enumerate(middle) if (rest := (row := same[place, letter])[bisect_right(row, k) :])]
        yield from ((False, k, other) for other in _often(lists, size - 1))
        if short:
            lists = [less[at, letter] for place, letter in enumerate(middle) for at in (place - 1, place) if (at, letter) in less]
            for other in _often(lists, size - 1):
                lost = short[other]
                first = next((i for i in range(size - 1) if lost[i] != middle[i]), size - 1)
                if lost[first:] == middle[first + 1 :] and not (first == size - 1 and middle[-1] == behind):
                    yield True, k, other


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near words in both directions, from postings in order."""
    out: list[tuple[str, str, int]] = []

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)

    def batch_of() -> pa.RecordBatch:
        word, near, n = zip(*out, strict=True)
        return pa.record_batch([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])

    for _, posting in groupby(rows(), key=lambda r: r[:3]):
        members = ([], [])
        for r in posting:
            members[r[5]].append(r)
        long, short = members
        if len(long) + len(short) < 2 or not long:
            continue
        for is_short, a, b in near_middles([r[3] for r in long], [r[3] for r in short], long[0][4]):
            one, two = long[a], members[is_short][b]
            out.append((one[6], two[6], two[7]))
            out.append((two[6], one[6], one[7]))
            if len(out) >= OUT_ROWS:
                yield batch_of()
                out.clear()
    if out:
        yield batch_of()


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of different words one inserted, deleted or replaced code point apart, both ways, once each.

    words has word, of at least four code points, and n, a word once.
    """
    key = ["length", "gram", "kept"]
    dealt = _postings(words).repartition(*key).sortWithinPartitions(*key, "short", "word")
    return dealt.mapInArrow(released(_pairs), PAIRS)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: each round doubles the steps taken, until no form has a form of its own."""
    held = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while held.join(held.select(F.col("word").alias("root")), "root", "left_semi").limit(1).count():
        after = held.select(F.col("word").alias("root"), F.col("root").alias("after"))
        held = materialise(held.join(after, "root", "left").select("word", F.coalesce("after", "root").alias("root")), "roots")
    return held


def spelling_groups(docs: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row a word of the corpus.

    docs has doc_id and text; other columns are ignored. form is the commonest word near to a word (the first in code-point
    order among equals) if it is at least `times` times as common, else null; root is where forms lead; n_near counts near words.
    As a form is more common than its word, forms make no circle.

    Null and empty texts have no words; a null id counts as the text ''. Repeated rows count each time. Very long texts are
    read whole, and a word of any length has its grams. An empty table gives an empty one.
    """
    words = materialise(corpus_words(docs), "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best_n = -F.col("best.less")
    led = best_n >= times * F.col("n")
    told = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("best.near")).alias("form"), F.when(led, best_n).alias("form_n"))
    told = materialise(told, "forms")
    out = told.join(_roots(told.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
