"""URL filter: rules first, then gradient-boosted trees on lexical features. DataFrame functions and MLlib only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host and path); a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
FEATURES = ("chars", "host_chars", "depth", "labels", "hyphens", "digit_ratio", "entropy", "params", "suffix_share")
#: The most labelled URLs that are learnt from.
SAMPLE = 20_000
TREES, DEPTH = 20, 3
#: Made-up URLs that are learnt from where the caller has no labels, and what they are made of (fixed values).
SEEDS = 8_000
ONSETS, VOWELS = "b c d f g h k l m n p r s t v w st tr br".split(), "a e i o u ai ea oo".split()
PLAIN_SUFFIXES = "com com com org org net net edu gov io de fr es info".split()
CHEAP_SUFFIXES = "com com net org info info biz top top xyz xyz click site".split()


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the
    end; both empty for a null url or one without ://."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def first_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>, or null."""
    out = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        site, slash, start = rule.partition("/")
        fits = ((host == site) | F.endswith(host, F.lit("." + site))) & F.startswith(path, F.lit(slash + start))
        out.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*out) if out else F.lit(None).cast("struct<rule:string,verdict:string>")


def seed_urls(spark: SparkSession, n: int = SEEDS) -> DataFrame:
    """(url, label, site) of made-up URLs, 1 to block; site is the word that a host is built on.

    There are no labelled URLs among the tables, so labels here follow from how a URL is made, by its form alone and
    without a list of words: those to block tend to long hosts of several parts and digits, to deep paths, to many
    parameters and to cheap suffixes, the others to short names and plain paths. Each trait is drawn on its own, and
    both kinds have all of them, so that no trait tells by itself.
    """
    u = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 20)) / F.lit(1 << 20)
    pick = lambda salt, values: F.element_at(F.array(*[F.lit(v) for v in values]), F.floor(u(salt) * len(values)).cast("int") + 1)

    def word(salt: int, syllables: int) -> Column:
        return F.concat(*[c for k in range(syllables) for c in (pick(salt + 2 * k, ONSETS), pick(salt + 2 * k + 1, VOWELS))])

    bad = F.col("label") == 1
    odds = lambda salt, good, worse: u(salt) < F.when(bad, worse).otherwise(good)
    digits = lambda salt, size: F.lpad(F.floor(u(salt) * 10**size).cast("string"), size, "7")
    rows = spark.range(n).withColumn("label", (F.col("id") % 2).cast("int")).withColumn("site", word(100, 2))
    host = F.concat(
        F.when(odds(1, 0.5, 0.3), pick(2, ["www.", "en.", "shop."])).otherwise(""),
        "site",
        F.when(odds(3, 0.3, 0.9), F.concat(F.when(odds(4, 0.3, 0.7), "-").otherwise(""), word(200, 2))).otherwise(""),
        F.when(odds(5, 0.05, 0.6), F.concat(F.when(odds(6, 0.5, 0.8), "-").otherwise(""), word(300, 3))).otherwise(""),
        F.when(odds(7, 0.05, 0.5), digits(8, 3)).otherwise(""),
        F.lit("."),
        F.when(odds(9, 0.1, 0.8), pick(10, CHEAP_SUFFIXES)).otherwise(pick(11, PLAIN_SUFFIXES)),
    )
    path = F.concat(
        F.lit("/"),
        F.when(odds(20, 0.7, 0.8), F.concat(word(400, 2), F.lit("/"))).otherwise(""),
        F.when(odds(21, 0.3, 0.6), F.concat(word(500, 2), F.lit("/"))).otherwise(""),
        F.when(odds(22, 0.1, 0.6), F.concat(digits(23, 6), F.lit("/"))).otherwise(""),
        F.when(odds(24, 0.5, 0.5), digits(25, 3)).otherwise(word(600, 2)),
        pick(26, ["", "", ".html", "/", "#notes"]),
    )
    query = F.concat(
        F.when(odds(30, 0.25, 0.8), F.concat(F.lit("?id="), digits(31, 2))).otherwise("?"),
        F.when(odds(32, 0.1, 0.6), F.concat(F.lit("&c="), word(700, 2), digits(33, 5))).otherwise(""),
        F.when(odds(34, 0.02, 0.5), F.concat(F.lit("&click="), digits(35, 9))).otherwise(""),
    )
    query = F.when(F.length(query) > 1, F.replace(query, F.lit("?&"), F.lit("?"))).otherwise("")
    return rows.select(F.concat(F.lit("https://"), host, path, query).alias("url"), "label", "site")


def describe(urls: DataFrame) -> DataFrame:
    """urls (url, ...) with host, path, suffix and the features of the text alone."""
    host, path = url_parts(F.col("url"))
    out = urls.withColumn("host", host).withColumn("path", path).withColumn("line", F.coalesce("url", F.lit("")))
    letters = F.filter(F.split("host", ""), lambda c: c != "")
    share = lambda c: (F.length("host") - F.length(F.replace("host", c, F.lit("")))) / F.length("host")
    entropy = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    labels = F.split("host", r"\.")
    query = F.regexp_extract("line", r"\?([^#]*)", 1)
    return out.select(
        "*",
        F.length("line").cast("double").alias("chars"),
        F.length("host").cast("double").alias("host_chars"),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double").alias("depth"),
        F.size(labels).cast("double").alias("labels"),
        (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        (F.length(F.regexp_replace("line", r"[^0-9]", "")) / F.greatest(F.length("line"), F.lit(1))).alias("digit_ratio"),
        F.coalesce(entropy, F.lit(0.0)).alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("params"),
        F.element_at(labels, -1).alias("suffix"),
    )


class UrlModel:
    """Boosted trees, with the share of labelled URLs to block by suffix (at most as many rows as labels) and over all."""

    def __init__(self, trees: GBTClassificationModel | None, suffix: DataFrame, share: float) -> None:
        self.trees, self.suffix, self.share = trees, suffix, share

    def features(self, described: DataFrame) -> DataFrame:
        """described with suffix_share; a suffix without labels has the share over all."""
        return described.join(F.broadcast(self.suffix), "suffix", "left").fillna({"suffix_share": self.share})


def learn(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, sample: int = SAMPLE) -> UrlModel:
    """From (url, label), at most `sample` rows in the order of a hash of the URL; null URLs and labels do not count.

    A suffix's share is (blocked + average) / (labelled + 1).
    """
    rows = labelled.where("url is not null and label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(sample)
    rows = describe(rows.select("url", F.col("label").cast("double").alias("label")))
    share = rows.agg(F.avg("label")).first()[0] or 0.0
    shrunk = (F.sum("label") + share) / (F.count("*") + 1)
    model = UrlModel(None, rows.groupBy("suffix").agg(shrunk.alias("suffix_share")), share)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(model.features(rows))
    model.trees = GBTClassifier(maxIter=trees, maxDepth=depth, seed=5, labelCol="label", featuresCol="features", predictionCol="guess").fit(ready)
    return model


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict (allow or block: the longest fitting rule's, else the trees').

    labelled (url, label with 1 to block) defaults to seed_urls(). A null url, one without :// and an empty one have
    empty host and path and are judged by the trees. Equal rows get equal verdicts; very long URLs are read whole.
    Other columns are ignored; an empty table gives an empty one.
    """
    model = learn(seed_urls(pages.sparkSession) if labelled is None else labelled)
    ready = model.features(describe(pages.select("page_id", "url")))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(ready)
    told = model.trees.transform(ready).withColumn("fit", first_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("guess") == 1.0, "block").otherwise("allow"))
    return told.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
