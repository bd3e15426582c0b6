"""The work that a request means, among candidates that fit it in different ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ways in which a candidate fits, the best first (fixed values).
FITS = ("exact", "name", "set", "catalog")


def picked_works(candidates: DataFrame, request: str, work: str, fit: str, page: str, parents: str, place: str) -> DataFrame:
    """(request, fit, work, tied): for each request the work of its best fit, or null with the number of those tied.

    candidates: one row for each candidate, with its page (null or empty: none), an array of works that it is part of, and
    its place in the request's list. A whole goes where one of its parts fits as well; candidates that lead to a page or
    a whole come before others. All that lead to one place are one choice, the first of them; else the only one with
    a page. Rows of other fits and null keys take no part; ties of place go to the smaller work. Requests are summed up by
    partial aggregates, so one with very many candidates is not gathered.
    """
    rank = F.coalesce(*[F.when(F.col(fit) == name, F.lit(i)) for i, name in enumerate(FITS)])
    rows = candidates.select(
        F.col(request).alias("request"), F.col(work).alias("work"), rank.alias("rank"), F.nullif(F.col(page), F.lit("")).alias("page"), F.col(parents).alias("parents"), F.col(place).alias("place")
    ).where("request is not null and work is not null and rank is not null")
    wholes = rows.select("request", "rank", F.explode("parents").alias("work"), F.col("work").alias("part")).where("work <> part").select("request", "rank", "work").distinct()
    at = rows.join(wholes, ["request", "rank", "work"], "left_anti")
    target = F.coalesce("page", F.get(F.col("parents"), F.lit(0)).cast("string"))
    at = at.withColumn("target", target).withColumn("order", F.struct("place", "work"))
    first = lambda c: F.min(F.when(c, F.col("order")))["work"]
    leads, paged = F.col("target").isNotNull(), F.col("page").isNotNull()
    ends = lambda c: (F.min(F.when(c, F.coalesce("target", F.lit("")))) == F.max(F.when(c, F.coalesce("target", F.lit("")))))
    groups = at.groupBy("request", "rank").agg(
        F.count("*").alias("n"), F.count_if(leads).alias("leading"), F.count_if(paged).alias("paged"), first(F.lit(True)).alias("any_work"), first(leads).alias("lead_work"), first(paged).alias("page_work"), ends(leads).alias("one_end")
    )
    picked = F.when(F.col("leading") == 0, F.col("any_work")).when(F.col("one_end"), F.col("lead_work")).when(F.col("paged") == 1, F.col("page_work"))
    groups = groups.select("request", F.struct("rank", picked.alias("work"), F.when(F.col("leading") > 0, F.col("leading")).otherwise(F.col("n")).alias("n")).alias("g"))
    best = groups.groupBy("request").agg(F.min_by("g", "g.rank").alias("g"))
    return best.select("request", F.element_at(F.array(*map(F.lit, FITS)), F.col("g.rank") + 1).alias("fit"), "g.work", F.when(F.col("g.work").isNull(), F.col("g.n")).otherwise(0).alias("tied"))
