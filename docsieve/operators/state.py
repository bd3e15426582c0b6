"""State machines over events of a key in order of time, one pass over sorted rows with a few values of state.

Rows are dealt by key and sorted within partitions, so that Spark's sort spills and no key is ever held whole; a key
that begins in one Arrow batch goes on in the next.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby, islice
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Rows of one batch of results.
OUT_ROWS = 4096


def fold(
    events: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple | None]], finish: Callable[[Any], tuple | None]
) -> DataFrame:
    """(key, columns of schema): the events of a key, as tuples of `order` columns, taken in that order.

    step turns a state and an event into a new state and a row to put out, or None; finish gives the row at the end of
    a key, or None. Events of a null key are those of one key.
    """
    types = StructType([StructField(key, events.schema[key].dataType), *_parse_datatype_string(schema).fields])
    fields = to_arrow_schema(types)
    dealt = events.select(key, *order).repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, fields, strict=True)], schema=fields)

        for batch in batches:
            for this, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or this != now[0]:
                    if now is not None and (row := finish(state)) is not None:
                        out.append((now[0], *row))
                    now, state = (this,), start()
                state, row = step(state, tuple(event))
                if row is not None:
                    out.append((this, *row))
                if len(out) >= OUT_ROWS:
                    yield rows()
                    out = []
        if now is not None and (row := finish(state)) is not None:
            out.append((now[0], *row))
        if out:
            yield rows()

    return dealt.mapInArrow(run, types)


def scan(events: DataFrame, keys: list[str], order: list[str], schema: str, run: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """(keys, columns of schema): what run makes of the events of each key, tuples of `order` columns in that order.

    run is a generator: it holds what it has to and puts out rows as it goes; it has to take all events of its key.
    """
    types = StructType([*(events.schema[k] for k in keys), *_parse_datatype_string(schema).fields])
    fields = to_arrow_schema(types)
    dealt = events.select(*keys, *order).repartition(*keys).sortWithinPartitions(*keys, *order)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        made = (key + tuple(row) for key, held in groupby(rows, lambda r: r[: len(keys)]) for row in run(r[len(keys) :] for r in held))
        while out := list(islice(made, OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    return dealt.mapInArrow(batches_of, types)


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def anchored_counts(events: DataFrame, key: str, ts: str, gap_s: int, tie: str) -> DataFrame:
    """(key, plays): events at least gap_s after the last counted one; an ignored event does not move the anchor."""

    def step(state: tuple, event: tuple) -> tuple[tuple, None]:
        anchor, n = state
        hit = anchor is None or event[0] - anchor >= gap_s * 1_000_000
        return ((event[0], n + 1) if hit else state), None

    return fold(events.select(key, micros(ts).alias("t"), tie), key, ["t", tie], "plays long", lambda: (None, 0), step, lambda s: (s[1],))


def hysteresis(events: DataFrame, key: str, ts: str, tie: str, value: str, high: float, low: float, calm: int) -> DataFrame:
    """(key, busy, turns): busy from `high` on, until `calm` readings in a row are below `low`; turns counts changes.

    A null reading changes nothing but breaks a run of calm ones.
    """

    def step(state: tuple, event: tuple) -> tuple[tuple, None]:
        busy, quiet, turns = state
        v = event[2]
        quiet = quiet + 1 if busy and v is not None and v < low else 0
        now = True if v is not None and v >= high else False if quiet >= calm else busy
        return (now, quiet if now else 0, turns + (now != busy)), None

    out = events.select(key, micros(ts).alias("t"), tie, value)
    return fold(out, key, ["t", tie, value], "busy boolean, turns long", lambda: (False, 0, 0), step, lambda s: (s[0], s[2]))


def pace_levels(events: DataFrame, key: str, ts: str, tie: str, seconds: str, late: float = 60, quick_enough: float = 30) -> DataFrame:
    """(key, level, changes): full, short or quick by the time that answers took; null seconds are misses.

    A miss makes it quick. From quick an answer within `late` makes it short; short becomes full after three answers
    within `quick_enough`; full becomes short when the mean of the last three (two at least) is above `late`. A change
    forgets the answers so far.
    """

    def step(state: tuple, event: tuple) -> tuple[tuple, None]:
        level, seen, changes = state
        s = event[2]
        seen = [*seen, s][-3:]
        new = level
        if s is None:
            new = "quick"
        elif level == "quick" and s <= late:
            new = "short"
        elif level == "short" and len(seen) == 3 and all(x <= quick_enough for x in seen):
            new = "full"
        elif level == "full" and len(seen) >= 2 and sum(seen) / len(seen) > late:
            new = "short"
        return (new, [] if new != level or s is None else seen, changes + (new != level)), None

    rows = events.select(key, micros(ts).alias("t"), tie, F.col(seconds).cast("double").alias(seconds))
    return fold(rows, key, ["t", tie, seconds], "level string, changes long", lambda: ("full", [], 0), step, lambda s: (s[0], s[2]))


def packed_lines(rows: DataFrame, key: str, order: str, text: str, most: int = 160) -> DataFrame:
    """(key, nth, line): the texts of a key joined by blanks, in order, each line as full as it goes within `most`.

    Null texts are left out; a text longer than `most` is a line of its own.
    """

    def step(state: tuple, event: tuple) -> tuple[tuple, tuple | None]:
        nth, line = state
        if line is None:
            return (nth, event[1]), None
        if len(line) + 1 + len(event[1]) <= most:
            return (nth, f"{line} {event[1]}"), None
        return (nth + 1, event[1]), (nth, line)

    held = rows.where(F.col(text).isNotNull())
    return fold(held, key, [order, text], "nth long, line string", lambda: (0, None), step, lambda s: None if s[1] is None else s)


def packed_within(items: DataFrame, key: str, order: list[str], size: str, budget: int) -> DataFrame:
    """(key, order columns, size): items in order, each taken if it still fits; later, smaller ones may fit."""
    kinds = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in [*order, size])

    def step(used: int, event: tuple) -> tuple[int, tuple | None]:
        n = event[-1]
        return (used + n, event) if n is not None and used + n <= budget else (used, None)

    return fold(items, key, [*order, size], kinds, lambda: 0, step, lambda s: None)


def rotated(rows: DataFrame, key: str, order: str, kind: str, item: str) -> DataFrame:
    """(key, place, item): greedy order in which no kind follows itself while another is left; "plain" may be followed by any.

    What has to wait is always of the kind put out last, so that one queue holds it; one item of another kind lets itself
    and the first that waits through. Rows stream out in place; only the queue is held.
    """

    def run(events: Iterator[tuple]) -> Iterator[tuple]:
        waiting: deque = deque()
        last, place = "plain", 0
        for _, k, i in events:
            if k == last and last != "plain":
                waiting.append(i)
                continue
            yield place, i
            place += 1
            if waiting:
                yield place, waiting.popleft()
                place += 1
            else:
                last = k
        for place, i in enumerate(waiting, place):
            yield place, i

    held = rows.select(key, F.col(order).alias("_o"), F.col(kind).alias("_k"), F.col(item).cast("long").alias("_i"))
    return scan(held, [key], ["_o", "_k", "_i"], "place long, item long", run)
