"""Repairs of captions by hand, that they come to rest, and markup removed until none is left."""

import random
import re

from pyspark.sql import functions as F

from docsieve.functions import repairs as R
from docsieve.operators.speakers import told_sentences

SOURCES = [
    (1, "The record sold about 5,000 copies. The band is usually armed with brass horns."),
    (2, "In Japan, the record reached the shops on Monday. The single sold 300 units in its first week of release."),
    (3, "The game was shown in Canada with bright colours and lamps."),
    (4, "The tour drew an estimated 20 people and nearly 20 dogs. Usually the small fox wore lanterns."),
    (5, "The opera was sung in France and in Italy with painted masks."),
]
CAPTIONS = [
    (1, "The record sold 5,000 copies"), (1, "The record sold over 5,000 copies"), (1, "The band is armed with brass horns"), (2, "The record reached the shops on Monday"), (2, "The single sold 300 units"), (3, "The game was shown with bright colours"),
    (4, "The tour drew 20 people and 20 dogs"), (4, "The fox wore lanterns"), (5, "The opera was sung with painted masks"), (1, "Nothing of the kind happened anywhere"), (1, None), (1, ""),
]


def test_repaired(spark):
    c = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(CAPTIONS)], "cid long, k long, c string")
    told = told_sentences(c, spark.createDataFrame(SOURCES, "k long, t string"), "k", "cid", "c", "t")
    out = R.repaired(told, "cid", "c")
    got = {r.cid: (r.text, r.dropped) for r in out.collect()}
    assert got == {
        0: ("The record sold about 5,000 copies", None), 1: (CAPTIONS[1][1], None), 2: ("The band is usually armed with brass horns", None), 3: ("In Japan, the record reached the shops on Monday", None),
        4: ("The single sold 300 units in its first week of release", None), 5: ("The game was shown in Canada with bright colours", None), 6: (CAPTIONS[6][1], '"an estimated 20" without "an estimated"'),
        7: (CAPTIONS[7][1], '"usually" left out'), 8: (CAPTIONS[8][1], None),
    }
    # what is repaired is at rest
    again = spark.createDataFrame([(i, CAPTIONS[i][0], t) for i, (t, d) in got.items() if d is None], "cid long, k long, c string")
    told = told_sentences(again, spark.createDataFrame(SOURCES, "k long, t string"), "k", "cid", "c", "t")
    assert {r.cid: r.text for r in R.repaired(told, "cid", "c").collect()} == {i: t for i, (t, d) in got.items() if d is None}


def test_words_end_before_letters_with_accents(spark):
    """As in the SQL and the reference, "An" ends in "Ané", and "about" begins after "é"."""
    rows = spark.createDataFrame([("Ané 5 copies", "In Japan, ané 5 copies were sold"), ("Anna 5 copies", "In Japan, anna 5 copies were sold"), ("Sold 5 copies", "éabout 5 copies were sold")], "c string, s string")
    got = rows.select(R.scope_restored(F.col("c"), F.col("s")), R.number_limits(F.col("c"), F.col("s"))["text"]).collect()
    assert [tuple(r) for r in got] == [("In Japan, ané 5 copies", "Ané 5 copies"), ("In Japan, Anna 5 copies", "Anna 5 copies"), ("Sold 5 copies", "Sold about 5 copies")]


def test_limits_stand_before_whole_numbers(spark):
    """A number's signs within longer ones are none of it; its plain replacement, as in the SQL, is asked for. What an adverb is put into has no blanks at its ends."""
    rows = spark.createDataFrame([("Sold 7012, 8701 and 70 of 1.70", "About 70 were sold"), ("70 of 7012", "About 70 were sold"), ("Cost $70", "About $70 was paid")], "c string, s string")
    got = rows.select(R.number_limits(F.col("c"), F.col("s"))["text"], R.number_limits(F.col("c"), F.col("s"), inside=True)["text"]).collect()
    assert [r[0] for r in got] == ["Sold 7012, 8701 and about 70 of 1.70", "About 70 of 7012", "Cost about $70"]
    assert [r[1] for r in got] == ["Sold about 7012, 8about 701 and about 70 of 1.about 70", "About 70 of About 7012", "Cost about $70"]
    told = spark.createDataFrame([("The band wore lanterns ",)], "c string")
    assert told.select(R.scope_adverbs(F.struct(F.col("c").alias("text"), F.lit(None).cast("string").alias("dropped")), F.lit("Usually band people wore lanterns"))["text"]).first()[0] == "The usually band wore lanterns"


def test_repaired_captions_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    texts = ["Otto sang loudly. Reer the 46403707022 horns and lamps ndsh. The end of it", "Otto sang loudly. Reer the lanterns and lamps ndsh \nThe end of it"]
    docs = [(42 * 10 * j + i, t) for j, t in enumerate(texts) for i in range(42)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {r.doc_id: (r.text, r.dropped) for r in entry.queries()["repaired_captions"](spark, str(tmp_path)).collect()}
    assert got == {i: (t, d) for i, t, d in con.execute(entry.oracle_sql()["repaired_captions"]).fetchall()}
    assert any("an estimated 7022" in t for t, _ in got.values()) and any("usually" in t for t, _ in got.values())


def test_without_markup(spark):
    rng = random.Random(5)
    parts = ["<!", "<!--", "-->", "--", ">", "<ref", "</ref>", "/>", " a", "<ref>", "\n", "é"]
    texts = ["<!<!---->--", "a<ref>b<ref>c</ref>d</ref>e", "x<!-- open", None, "", "plain"] + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.o for r in rows.select("i", R.without_markup(F.col("t")).alias("o")).collect()}
    assert [got[i] for i in range(6)] == ["", "ad</ref>e", "x", None, "", "plain"]
    for i, t in enumerate(texts):
        if t is not None:
            assert not re.search(r"<!--|<ref[^>]*/>|<ref[^>]*>[\s\S]*?</ref>", got[i]) and len(got[i]) <= len(t)
            assert ("<" in t) or got[i] == t
