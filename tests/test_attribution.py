"""Attribution checks and reports of errors on single rows: nulls, ties, repeated rows and empty tables."""

from pyspark.sql import functions as F

from docsieve.functions import attribution as A
from docsieve.operators import clicks as K


def test_attribution(spark):
    rows = [(None, None), ("", []), ("The band wrote it", ["The company wrote it"]), ("The band wrote it", [None]), ("It led the Soul chart in two weeks", ["It led the Soul chart, then in two weeks the Pop chart"])]
    df = spark.createDataFrame(rows, "c string, r array<string>")
    c, r = F.col("c"), F.col("r")
    got = df.select(A.swapped_agent(c, r), A.unattributed_view(c, r), A.moved_chart_detail(c, r), A.wrong_owner(c, r, r), A.other_recording(c, r)).collect()
    assert [tuple(x) for x in got] == [(None, None, None, None, False), (None, None, None, None, False), ("the band", None, None, None, False), (None, None, None, None, False), (None, None, "in two weeks", None, False)]
    views = ["Reyes described the cue as a compromise", "The cue is long"]
    df = spark.createDataFrame([("A compromise", views), ("The cue", views), ("A compromise by Reyes", views), ("They call it a compromise", views), ("A compromise", views[:1])], "c string, r array<string>")
    assert [x[0] for x in df.select(A.unattributed_view(c, r)).collect()] == ["Reyes", None, None, None, None]
    heads = spark.createDataFrame([("Night version", ["Ada"]), ("Ada version", ["Ada"]), ("Cover versions", None), ("Legacy", None)], "h string, n array<string>")
    assert [x[0] for x in heads.select(A.other_recording(F.col("h"), F.col("n"))).collect()] == [True, False, True, False]


def test_report_targets(spark):
    said = [("c", 0, "s", "a"), ("c", 0, "s", "a"), ("c", 1, "t", "b"), ("c", 2, "t", "d"), ("c", 2, None, "d"), (None, 0, "s", "a")]
    reports = [("c", 1, "a", None, True), ("c", 1, "a", None, True), ("c", 2, "a", None, False), ("c", 3, "b", "t", True), ("c", 4, "d", "t", False), ("c", 5, "a", "t", True), (None, 6, "a", "s", True), ("c", 7, None, "t", None)]
    statements = spark.createDataFrame(said, "ch string, play int, song string, text string")
    asked = spark.createDataFrame(reports, "ch string, report long, text string, song string, live boolean")
    got = sorted(tuple(r) for r in K.report_targets(asked, statements, "ch").collect())
    assert got == [("c", 1, "s", "a", True), ("c", 1, "s", "a", True), ("c", 3, "t", "b", False)]
    assert K.report_targets(asked, statements.limit(0), "ch").count() == 0
    songs = spark.createDataFrame([("x", None, None, "v"), ("x", None, "v", None), (None, "x", "y", "z")], "t string, a string, s string, v string")
    keys = [r[0] for r in songs.select(K.song_key("t", "a", "s", "v")).collect()]
    assert keys[2] is None and len(set(keys)) == 3
