"""Secret scan: a pattern finds candidates, a random forest removes those that are none.

The forest sees a candidate's length, the changes of character class and other transitions in it, how much of it
common word pieces cover, whether it looks like a path, and the word before it. It learns from labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key, any word with a letter in it, and the sign of assignment after it, perhaps within quotes.
KEY = r"""[0-9_.-]*+[A-Za-z][A-Za-z0-9_.-]*+"""
SIGN = r"""["']?\s*+(?::=|=>|[=:])\s*+"""
#: No other assignment (log level: token=...) and no address follows a key as its value.
NO_VALUE = rf"""(?!//|["']?{KEY}["']?(?:[ \t]++(?::=|=>|[=:])[ \t]*+|(?::=|=>|=)|:[ \t]*+)["']?[^\s"'=,;&]{{6}})"""
#: Key, and value of six characters or more without blanks in either quotes or none; or a run of value characters alone. No value has an upper bound.
CANDIDATE = rf"""(?<![A-Za-z0-9_.-])({KEY}){SIGN}{NO_VALUE}(?:"([^"\s]{{6,}}+)|'([^'\s]{{6,}}+)|([^\s"'&,;]{{5,}}[^\s"'&,;.:)}}\]>]))|(?<![A-Za-z0-9+/_.-])([A-Za-z0-9+/_.-]{{16,}}+={{0,2}})"""
FEATURES = ("chars", "digits", "uppers", "changes", "vowel_turns", "hex", "covered", "slashes", "distinct", "key_secret", "key_plain", "known_form", "placeholder")
SAMPLE, TREES, DEPTH = 20_000, 24, 7
#: Words of keys that name secrets and of those that do not, forms of issued keys, pieces of plain words, words of made-up pass phrases, placeholders (fixed values).
SECRET_KEYS = "api_?key|auth|bearer|credential|passw|private|pwd|secret|token"
PLAIN_KEYS = "checksum|commit|digest|etag|file|hash|id|isbn|md5|path|revision|sha|url|uuid|version"
KNOWN_FORM = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abpr]-[A-Za-z0-9-]{10,}$|^sk_live_[A-Za-z0-9]{16,}$|^AIza[A-Za-z0-9_-]{35}$"
PIECES = "access|address|build|client|config|count|create|data|default|error|event|file|filter|first|format|get|group|handle|index|info|item|key|last|line|list|load|local|main|manager|message|model|name|number|object|option|order|page|param|profile|query|read|record|request|response|result|service|session|set|size|source|start|state|status|string|system|table|test|text|time|type|update|user|value|version|view"
WORDS = "anchor|autumn|battery|bridge|candle|copper|correct|desert|falcon|forest|garden|hammer|horse|island|jungle|kitten|lantern|marble|meadow|ocean|orange|pepper|planet|purple|rabbit|rocket|saddle|silver|spring|staple|summer|thunder|velvet|walnut|window|winter"
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|your|placeholder|redacted|xxxx|\*\*\*|1234567|abcdef|(.)\1{5}"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, nth, key, value): what follows an assignment, and runs of value characters with a digit, in order of place."""
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).alias("nth", "found"))
    value = F.concat(*[F.regexp_extract("found", CANDIDATE, i) for i in (2, 3, 4, 5)])
    out = found.select("doc_id", "nth", F.regexp_extract("found", CANDIDATE, 1).alias("key"), value.alias("value"))
    return out.where((F.col("key") != "") | F.col("value").rlike("[0-9]"))


def describe(found: DataFrame) -> DataFrame:
    """found with the features of value and key."""
    v, size = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    left = lambda pattern: F.length(F.regexp_replace(v, pattern, "")) / size
    flag = lambda c: c.cast("double")
    turns = lambda pattern: F.regexp_count(v, F.lit(pattern)) / size
    out: dict[str, Column] = {
        "chars": F.length("value").cast("double"),
        "digits": 1 - left("[0-9]"),
        "uppers": 1 - left("[A-Z]"),
        "changes": turns("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "vowel_turns": turns("(?i)(?<=[b-df-hj-np-tv-z])(?=[aeiou])"),
        "hex": flag(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "covered": 1 - left(f"(?i){PIECES}"),
        "slashes": turns("[/.]"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / size,
        "key_secret": flag(F.col("key").rlike(f"(?i){SECRET_KEYS}")),
        "key_plain": flag(F.col("key").rlike(f"(?i){PLAIN_KEYS}")),
        "known_form": flag(v.rlike(KNOWN_FORM)),
        "placeholder": flag(v.rlike(PLACEHOLDER)),
    }
    return found.withColumns(out)


def seed_findings(spark: SparkSession, n: int = 250) -> DataFrame:
    """(key, value, label) of made-up findings, 1 for secrets: n of each of twenty-four forms."""
    h = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    wide = lambda salt: F.regexp_replace(F.base64(F.unhex(h(salt))), "=", "")
    pick = lambda salt, values: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in values]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    span = lambda c, low, high: F.substr(c, F.lit(1), (F.lit(low) + F.pmod(F.xxhash64("id"), F.lit(high - low + 1))).cast("int"))
    piece = lambda salt: pick(salt, PIECES.split("|"))
    keys, plain = ["password", "passwd", "token", "api_key", "secret", "auth_token", "pwd", "client_secret", "TOKEN"], ["commit", "sha", "md5", "hash", "id", "uuid", "etag", "checksum", "version"]
    word = lambda salt: pick(salt, WORDS.split("|"))
    long = F.concat_ws("", *[wide(f"J{i}") for i in range(12)])
    caps = F.translate(F.upper(h("d")), "01", "QZ")
    forms = [
        (pick("k", keys), span(h("a"), 16, 40), 1),
        (pick("k", keys), F.substr(h("a"), F.lit(1), F.lit(40)), 1),
        (pick("k", keys), F.upper(F.substr(h("b"), F.lit(1), F.lit(40))), 1),
        (pick("k", keys), span(wide("c"), 16, 43), 1),
        (F.lit(""), F.concat(F.lit("AKIA"), F.substr(caps, F.lit(1), F.lit(16))), 1),
        (pick("k2", ["", "aws_key", "token"]), F.concat(F.lit("AKIA"), F.substr(caps, F.lit(9), F.lit(16))), 1),
        (F.lit(""), F.concat(F.lit("ghp_"), F.substr(F.concat(wide("e"), h("e")), F.lit(1), F.lit(36))), 1),
        (pick("k", keys), F.concat_ws("", piece("p"), F.substr(h("f"), F.lit(1), F.lit(12)), F.lit("Q7")), 1),
        (F.lit(""), F.substr(h("g"), F.lit(1), F.lit(40)), 0),
        (pick("k", plain), F.substr(h("g"), F.lit(1), F.lit(40)), 0),
        (pick("k", ["", *plain]), h("i"), 0),
        (pick("k", ["", *plain]), F.concat_ws("-", F.substr(h("j"), F.lit(1), F.lit(8)), F.substr(h("j"), F.lit(9), F.lit(4)), F.substr(h("j"), F.lit(13), F.lit(4)), F.substr(h("j"), F.lit(17), F.lit(12))), 0),
        (pick("k3", ["", "id", "order", "number"]), F.translate(F.substr(h("l"), F.lit(1), F.lit(16)), "abcdef", "135790"), 0),
        (pick("k4", ["", "path", "file", "token"]), F.concat_ws("/", piece("m"), piece("n"), piece("o"), F.concat(piece("q"), F.lit("2.txt"))), 0),
        (pick("k5", ["", "name", "token", "value", "key"]), F.concat_ws("_", piece("r"), piece("s"), piece("t"), F.pmod("id", F.lit(10)).cast("string")), 0),
        (pick("k", keys), pick("u", ["your_api_key_here", "xxxxxxxxxxxxxxxxxxxx", "changeme_changeme", "example_token_12345678", "00000000000000000000", "placeholder-placeholder", "dummy_secret_value_1"]), 0),
        (F.lit(""), F.concat(piece("v"), piece("w"), piece("x"), F.pmod("id", F.lit(100)).cast("string"), F.lit("abcdefgh")), 0),
        (pick("k", keys), F.concat_ws("", word("A"), word("B"), word("C"), pick("D", ["", *WORDS.split("|")])), 1),
        (pick("k", keys), F.concat(F.initcap(word("E")), F.pmod(F.xxhash64("id"), F.lit(9000)).cast("string"), pick("F", ["", "!", "#", "$x"])), 1),
        (pick("k", keys), span(wide("G"), 8, 15), 1),
        (pick("k6", ["", "", "authorization", *keys]), F.concat(F.lit("eyJ"), span(wide("H"), 16, 30), F.lit("."), span(long, 60, 480), F.lit("."), wide("I")), 1),
        (pick("k", keys), pick("v", ["required", "string", "optional", "undefined", "process.env.SECRET", "${PASSWORD}", "getPassword()", "please", "Bearer", "request.headers", "disabled", word("K")]), 0),
        (pick("k7", ["note", "INFO", "summary", "title", "author_of", "host", "label", "reply"]), pick("L", [word("M"), F.initcap(word("N")), F.concat_ws("-", word("O"), word("P")), F.concat_ws(".", word("Q"), word("R"), F.lit("org"))]), 0),
        (pick("k8", ["date", "time", "total", "count", "phone", "size"]), pick("S", [F.concat(F.lit("2024-01-"), F.pmod("id", F.lit(28)) + 1), F.translate(F.substr(h("T"), F.lit(1), F.lit(9)), "abcdef", "135790"), F.concat(F.pmod("id", F.lit(97)), F.lit(".5000"))]), 0),
    ]
    rows = F.array(*[F.struct(k.alias("key"), v.alias("value"), F.lit(y).alias("label")) for k, v, y in forms])
    return spark.range(n).select(F.explode(rows).alias("f")).select("f.*").where(F.length("value") >= 6)


def learn(labelled: DataFrame, sample: int = SAMPLE) -> RandomForestClassificationModel:
    """From (key, value, label), at most `sample` rows in the order of a hash; nulls do not count."""
    rows = labelled.where("value is not null and label is not null").select(F.coalesce("key", F.lit("")).alias("key"), "value", F.col("label").cast("double").alias("label"))
    rows = describe(rows.orderBy(F.xxhash64("key", "value"), "key", "value", "label").limit(sample))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=3, labelCol="label", featuresCol="features").fit(ready)


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Per candidate: doc_id, nth (place among the document's matches), key, chars, value_sha256, score, secret.

    secret is score >= threshold. Values themselves are not returned. labelled (key, value, label) defaults to
    seed_findings(). A value ends at a blank, or in quotes at the quote. Null and empty texts have no candidates; equal rows
    give equal rows; texts are read whole. Other
    columns are ignored; an empty table gives an empty one.
    """
    model = learn(seed_findings(docs.sparkSession) if labelled is None else labelled)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(describe(candidates(docs)))
    score = vector_to_array(F.col("probability"))[1]
    told = model.setPredictionCol("guess").transform(ready)
    return told.select("doc_id", "nth", "key", F.length("value").alias("chars"), F.sha2("value", 256).alias("value_sha256"), score.alias("score"), (score >= threshold).alias("secret"))
