"""Headed text: sections with nested extents, headings of every line, and removal of sections by heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^(={2,6})\s*(.*?)\s*={2,6}$"


def line_table(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line, level, heading): level 0 and a null heading for lines that are no headings."""
    rows = pages.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    level = F.length(F.regexp_extract("line", HEADING, 1))
    return rows.withColumn("level", level).withColumn("heading", F.when(level > 0, F.regexp_extract("line", HEADING, 2)))


def heading_tree(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, heading, level, from, to): the headings of every page as a tree, in nested intervals of line numbers.

    A section runs from its heading's line up to the next heading of its level or a higher one, so that `from` numbers the
    tree in pre-order and `to` bounds a subtree: what lies within [from, to) is below, what reaches over it is above.
    Five running values over the headings in falling order give all bounds in one pass. A key names one page; a page
    without headings has no row, null texts have none.
    """
    lines = pages.select(key, F.split(text, "\n").alias("lines"))
    marked = F.transform("lines", lambda x, i: F.struct(i.alias("from"), F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), F.regexp_extract(x, HEADING, 2).alias("heading")))
    rows = lines.select(key, F.size("lines").alias("n"), F.explode(F.filter(marked, lambda h: h["level"] > 0)).alias("h")).select(key, "n", "h.*")
    later = Window.partitionBy(key).orderBy(F.desc("from")).rowsBetween(Window.unboundedPreceding, -1)
    for level in range(2, 7):
        rows = rows.withColumn(f"_next{level}", F.last(F.when(F.col("level") == level, F.col("from")), True).over(later))
    end = F.col("n")
    for level in range(2, 7):
        end = F.when(F.col("level") >= level, F.least(end, f"_next{level}")).otherwise(end)
    return rows.select(key, "heading", "level", "from", end.alias("to"))


def within_any(rows: DataFrame, key: str, at: str, begin: Column, end: Column) -> Column:
    """Whether the place `at` lies in any of the nested intervals that rows up to it begin (null: it begins none)."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.max(F.when(begin.isNotNull(), end)).over(w) > F.col(at), F.lit(False))


def section_table(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, heading, level, from, to): the rows of heading_tree."""
    return heading_tree(pages, key, text)


def without_sections(pages: DataFrame, key: str, text: str, headings: str) -> DataFrame:
    """(key, text, sections): text without the sections, and what is in them, whose heading matches the pattern."""
    gone = section_table(pages, key, text).where(F.col("heading").rlike(headings)).groupBy(key).agg(F.collect_list(F.struct("from", "to")).alias("gone"))
    held = pages.select(key, F.split(text, "\n").alias("lines")).join(gone, key, "left")
    inside = lambda i: F.exists(F.coalesce("gone", F.array().cast("array<struct<from:int,to:int>>")), lambda g: (i >= g["from"]) & (i < g["to"]))
    return held.select(key, F.array_join(F.filter("lines", lambda _, i: ~inside(i)), "\n").alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("sections"))


def last_heading(lines: DataFrame, key: str) -> DataFrame:
    """Every plain line with the heading that it stands under."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("under", F.last("heading", True).over(w)).where("level = 0").drop("level", "heading")
