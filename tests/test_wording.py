"""Wording, frames, classical titles and works on single rows: nulls, signs in names and ties."""

from pyspark.sql import functions as F

from docsieve.functions import classical as C
from docsieve.functions import frames as R
from docsieve.functions import wording as W
from docsieve.operators import works as K
from docsieve.plans.wording_queries import classical_titles


def test_wording(spark):
    rows = [("The \\Eheroic (band) played", ["\\Eheroic (band)"]), ("The heroic band", None), (None, None), ("", []), ("Stood up\n to it", [])]
    df = spark.createDataFrame(rows, "t string, n array<string>")
    got = df.select(W.neutral_breach(F.col("t"), F.col("n"), F.lit(None).cast("boolean")), W.loaded_caption(F.col("t"), F.col("n"), F.lit(True)), W.company_history(F.col("t"), F.col("n"), F.lit(False))).collect()
    assert [tuple(r) for r in got] == [(None, False, False), ("loaded wording", True, False), (None, False, False), (None, False, False), ("loaded wording", True, False)]


def test_frames(spark):
    df = spark.createDataFrame([(None,), ("",), ("It hit number one",)], "t string")
    none = F.lit(None).cast("array<string>")
    got = df.select(R.unnamed_chart(F.col("t")), R.unnamed_reference(F.col("t"), none), R.left_behind(F.col("t"), none), R.dropped_hedge(F.col("t"), F.array("t")), R.platform_supported(F.col("t"), F.col("t")), R.citation(F.col("t"))["at"]).collect()
    assert [tuple(r) for r in got] == [(None, None, None, None, False, 0), (None, None, None, None, False, 0), ("hit number one", None, None, None, True, 0)]
    cases = [("Wii", "the Wii U", False), ("wii", "a Wii.", True), ("Genesis", "the Mega Drive", True), ("Switch", "a light switch", False), ("C64", "Commodore 64 music", True)]
    df = spark.createDataFrame(cases, "p string, s string, want boolean")
    assert all(r[0] == r[1] for r in df.select(R.platform_supported(F.col("p"), F.col("s")), "want").collect())


def test_pieces(spark):
    titles = [None, "", "Spring (La Primavera)", "Hob. XVI:52", "Sonata (op. 3, no. 1, \"Elegie\")", "Third Movement of B-flat"]
    df = spark.createDataFrame([(t,) for t in titles], "t string").select(C.piece_parts(F.col("t")).alias("c"), C.artist_names(F.col("t")).alias("n"))
    got = [(r.c.name, r.c.alias, r.c.catalogs, r.c.numbers, r.c.movement) for r in df.collect()]
    assert got[0] == (None, None, None, None, None) and got[1] == ("", None, [], [], None)
    assert got[2:] == [("Spring", "La Primavera", [], [], None), ("", None, ["Hob. XVI:52"], ["52"], None), ("Sonata", "Elegie", ["Op. 3"], ["3", "1"], None), ("of B-flat", None, [], [], 3)]
    assert spark.range(1).select(C.one_spelling(F.lit("C# minor, Eb major, c-sharp"))).first()[0] == "C sharp minor, E flat major, c sharp"


def test_picked_works(spark):
    rows = [("a", 1, "name", None, [2], 0), ("a", 2, "name", "p", [], 1), ("b", 1, "exact", None, [], 0), ("b", 1, "exact", None, [], 0), ("c", 1, "set", "p", [], 1), ("c", 2, "set", "q", [], 0), ("d", 5, "other", "p", [], 0), (None, 5, "set", "p", [], 0)]
    rows += [("e", 1, "catalog", "p", None, 0), ("e", 2, "catalog", None, [9], 1)]
    df = spark.createDataFrame(rows, "r string, w long, f string, p string, u array<long>, k long")
    got = sorted(tuple(r) for r in K.picked_works(df, "r", "w", "f", "p", "u", "k").collect())
    assert got == [("a", "name", 1, 0), ("b", "exact", 1, 0), ("c", "set", None, 2), ("e", "catalog", 1, 0)]
    assert K.picked_works(df.limit(0), "r", "w", "f", "p", "u", "k").count() == 0


def test_titles_are_taken_apart_step_by_step(spark, tmp_path):
    """Each step of a title is found once (1,170 patterns stood in the plan), and a small file's rows are dealt over tasks."""
    rows = spark.createDataFrame([(1, "Nocturne in E-flat major, Op. 9, No. 2"), (2, None), (3, "Suite, Op. 3: II. Rondo (Ring)")], "i long, t string")
    parts = rows.select("i", C.piece_parts(F.col("t")).alias("c"))
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp") + plan.count("RLIKE") < 100
    got = {r.i: r.c for r in parts.collect()}
    assert tuple(got[1])[:5] == ("Nocturne", None, ["Op. 9"], ["9", "2"], "E-flat major") and (got[3].alias, got[3].movement) == ("Ring", None)
    assert got[2].name is None and got[2].catalogs is None and got[2].movement is None
    spark.createDataFrame([(1, "a", 3)], "p_partkey long, p_name string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert classical_titles(spark, str(tmp_path)).rdd.getNumPartitions() >= 8
