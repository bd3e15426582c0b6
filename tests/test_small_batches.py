"""Whole pages and documents go to Python a hundred at a time, not in Arrow batches of 10,000, and come out the same."""

import pytest
from pyspark.sql import functions as F

from docsieve.functions import markup, repairs, wikitext

CASES = {
    "pages": (lambda: markup.html_text("t"), markup.plain, ["<p>a</p><h2>b</h2>", None, ""]),
    "wikitext": (lambda: wikitext.marked("t"), wikitext.marked_text, ["''a'' [[b|c]]<!-- d -->", None, ""]),
    "markup": (lambda: repairs.without_markup(F.col("t")), lambda t: None if t is None else t.replace("<!--b-->", ""), ["a<!--b-->c", None, ""]),
}


@pytest.mark.parametrize("name", CASES)
def test_rows_go_in_small_batches(spark, name):
    column, plain, texts = CASES[name]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", column().alias("o"))
    assert {r.i: r.o for r in rows.collect()} == {i: plain(t) for i, t in enumerate(texts)}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
