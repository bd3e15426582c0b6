"""Readers with fixed schemas: malformed records turn to nulls and are left out, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "key string, at timestamp, kind string, song struct<title:string,artist:string,song_id:long,video_id:string>"
FORMATS = ("artist-title", "title-artist", "title")


def decoded() -> Column:
    """Text of the column content: UTF-16 little-endian after its mark, else UTF-8 without its mark."""
    head = F.hex(F.substring("content", 1, 3))
    wide = F.startswith(head, F.lit("FFFE"))
    bare = F.when(wide, F.expr("substring(content, 3)")).when(head == "EFBBBF", F.expr("substring(content, 4)")).otherwise(F.col("content"))
    return F.when(wide, F.decode(bare, "UTF-16LE")).otherwise(F.decode(bare, "UTF-8"))


def line_parts(line: Column, form: str) -> Column:
    """struct<artist, title> of one line in one of three forms; a line without a dash is a title."""
    left, right = F.trim(F.regexp_extract(line, r"^(.*?)\s+[-–—]\s+(.*)$", 1)), F.trim(F.regexp_extract(line, r"^(.*?)\s+[-–—]\s+(.*)$", 2))
    dash = (left != "") & (right != "")
    artist, title = {"artist-title": (left, right), "title-artist": (right, left), "title": (F.lit(None), F.trim(line))}[form]
    return F.struct(F.when(dash, artist).alias("artist"), F.when(dash, title).otherwise(F.trim(line)).alias("title"))


def now_playing(spark: SparkSession, path: str, form: str = "artist-title") -> DataFrame:
    """The newest text file of a folder (ties: the first name), its first line that is not empty, split by its form."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    newest = files.orderBy(F.desc("modificationTime"), "path").limit(1).withColumn("text", decoded())
    line = F.get(F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    return newest.select("path", "modificationTime", line.alias("line")).where("line is not null").withColumn("song", line_parts(F.col("line"), form))


def events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON lines of events; records without a key or a time are left out."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(EVENT).option("mode", "PERMISSIVE").json(path).where("key is not null and at is not null")


def topics(spark: SparkSession, path: str) -> DataFrame:
    """(tag, line) of JSON packs {"lines": [...]}: each line once, a leading [tag] taken off."""
    lines = spark.read.schema("lines array<string>").option("multiLine", True).json(path).select(F.explode("lines").alias("raw")).distinct()
    tag = F.regexp_extract("raw", r"^\[([^\]]+)\]\s*", 1)
    return lines.select(F.when(tag != "", tag).alias("tag"), F.trim(F.regexp_replace("raw", r"^\[[^\]]+\]\s*", "")).alias("line"))


def auto_description(text: Column) -> Column:
    """struct<title, artist> of the fixed layout of generated descriptions: third line "title · artist"."""
    line = F.get(F.split(text, "\n"), F.lit(2))
    parts = F.split(line, " · ")
    return F.when(F.startswith(text, F.lit("Provided to")) & (F.size(parts) >= 2), F.struct(F.get(parts, F.lit(0)).alias("title"), F.get(parts, F.lit(1)).alias("artist")))
