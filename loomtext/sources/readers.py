"""Readers of landed files; each gives rows with an explicit ordinal. Malformed parts become empty, not errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VIDEOS = "channel_id STRING, channel_name STRING, length_curr INT, length_old INT, last_fetched_at STRING, continuation_token STRING, videos ARRAY<STRUCT<id:STRING,title:STRING,duration_text:STRING,relative_published:STRING,url:STRING>>, playlist_lengths MAP<STRING,STRUCT<length_curr:INT,length_old:INT>>"
PLAYLISTS = "channel_id STRING, playlists ARRAY<STRUCT<id:STRING,title:STRING,folder:STRING,alias:STRING,source:STRING>>"
PLAYLIST_MAP = "updated_at STRING, map MAP<STRING,STRING>, details MAP<STRING,STRUCT<title:STRING,duration_text:STRING,url:STRING,playlist_index:INT>>"
ASR = "model STRING, language STRING, segments ARRAY<STRUCT<start:DOUBLE,end:DOUBLE,text:STRING,avg_logprob:DOUBLE,no_speech_prob:DOUBLE,compression_ratio:DOUBLE>>"
REVEALS = "video STRING, scenes ARRAY<STRUCT<scene:INT,start_seconds:DOUBLE,reveals:ARRAY<STRUCT<seconds:DOUBLE,kind:STRING,added_fraction:DOUBLE,kept_fraction:DOUBLE,band:ARRAY<DOUBLE>>>>>"
CHAT = "role STRING, type STRING, message STRUCT<content:ARRAY<STRUCT<type:STRING,text:STRING,name:STRING>>>"
SCENES = "scene_number INT, start_frame INT, start_timecode STRING, start_seconds DOUBLE, end_frame INT, end_timecode STRING, end_seconds DOUBLE"
#: Settings of the silence detector.
NOISE_DB, LEAST_SILENCE = -30.0, 0.35


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each file; an unreadable file gives a row of nulls."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")


def videos(spark: SparkSession, path: str) -> DataFrame:
    return json_document(spark, path, VIDEOS).select("channel_id", "length_curr", "length_old", F.posexplode("videos").alias("pos", "v")).select("channel_id", "length_curr", "length_old", "pos", "v.*")


def playlists(spark: SparkSession, path: str) -> DataFrame:
    return json_document(spark, path, PLAYLISTS).select("channel_id", F.posexplode("playlists").alias("pos", "p")).select("channel_id", "pos", "p.*")


def playlist_map(spark: SparkSession, path: str) -> DataFrame:
    doc = json_document(spark, path, PLAYLIST_MAP)
    return doc.select("details", F.explode("map").alias("id", "playlist")).select("id", "playlist", F.try_element_at("details", F.col("id")).alias("d")).select("id", "playlist", "d.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def whole(spark: SparkSession, path: str) -> DataFrame:
    """A row for each text file: its stem and its text, without BOM and carriage returns."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(stem.alias("stem"), F.regexp_replace("value", "﻿|\r", "").alias("text"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return whole(spark, path).select("stem", F.posexplode(F.split("text", "\n")).alias("line", "value"))


def seconds(stamp: Column) -> Column:
    part = lambda i: F.regexp_extract(stamp, r"(\d+):(\d+):(\d+)[,.](\d+)", i).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000


def srt(spark: SparkSession, path: str) -> DataFrame:
    """stem, ord, start, end, text; blocks without a time line or text are skipped."""
    blocks = whole(spark, path).select("stem", F.posexplode(F.split("text", r"\n\s*\n")).alias("ord", "b"))
    time = r"(\d+:\d+:\d+[,.]\d+)\s*-->\s*(\d+:\d+:\d+[,.]\d+)"
    got = blocks.select("stem", "ord", seconds(F.regexp_extract("b", time, 1)).alias("start"), seconds(F.regexp_extract("b", time, 2)).alias("end"), F.trim(F.regexp_replace(F.regexp_extract("b", r"(?s)-->[^\n]*\n(.*)$", 1), r"\s*\n\s*", " ")).alias("text"))
    return got.where("start is not null and text <> ''")


def asr(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(ASR).json(path, multiLine=True, mode="PERMISSIVE").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.", 1).alias("stem"), "segments")
    return doc.select("stem", F.posexplode("segments").alias("ord", "s")).select("stem", "ord", "s.*")


def segments(subtitles: DataFrame, quality: DataFrame) -> DataFrame:
    """Segments with quality where a stem has them, else from its subtitles."""
    return quality.unionByName(subtitles.join(quality.select("stem"), "stem", "left_anti"), allowMissingColumns=True)


def silences(spark: SparkSession, path: str) -> DataFrame:
    """stem, start, end from a detector's log: each end belongs to the last start before it; negative starts are 0."""
    log = text_lines(spark, path)
    n = lambda k: F.regexp_extract("value", rf"silence_{k}: (-?[\d.]+)", 1).try_cast("double")
    marks = log.select("stem", "line", n("start").alias("s"), n("end").alias("e")).where("s is not null or e is not null")
    w = Window.partitionBy("stem").orderBy("line")
    paired = marks.withColumn("start", F.lag("s").over(w)).where("e is not null and start is not null")
    return paired.select("stem", F.greatest("start", F.lit(0.0)).alias("start"), F.col("e").alias("end")).where("end > start")


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """ord and term: comments off, the first spelling of each term stays."""
    terms = text_lines(spark, path).select("line", F.trim(F.regexp_replace("value", r"(^|\s)#\s.*$|^#.*$", "")).alias("term")).where("term <> ''")
    return terms.groupBy(F.lower("term").alias("k")).agg(F.min_by("term", "line").alias("term"), F.min("line").alias("ord")).select("ord", "term")


def settings(spark: SparkSession, path: str, allowed: list[str]) -> DataFrame:
    """key and value: the first value of a key wins, an unknown key is an error."""
    rows = text_lines(spark, path).where(~F.col("value").rlike(r"^\s*([#;].*)?$")).select("line", F.trim(F.split("value", "=", 2)[0]).alias("key"), F.trim(F.get(F.split("value", "=", 2), F.lit(1))).alias("value"))
    known = rows.withColumn("key", F.when(F.col("key").isin(allowed), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("unknown setting: "), F.col("key")))))
    return known.groupBy("key").agg(F.min_by("value", "line").alias("value"))


def id_lists(spark: SparkSession, path: str) -> DataFrame:
    """stem (one file, one list), ord and id; comments and invalid lines are skipped, the first of equal ids stays."""
    from loomtext.functions.columns import video_id

    rows = text_lines(spark, path).where(~F.col("value").rlike(r"^\s*#")).select("stem", "line", video_id(F.trim("value")).alias("id")).where("id is not null")
    return rows.groupBy("stem", "id").agg(F.min("line").alias("ord"))


def page_slugs(spark: SparkSession, path: str) -> DataFrame:
    """ord, url, slug of an ordered list of page links; numbers are padded to three digits."""
    rows = text_lines(spark, path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    leaf = F.regexp_extract("value", r"(?:leaf|page/)?(n?\d+)(?:[/?#].*)?\s*$", 1)
    slug = F.when(leaf == "", "cover").when(leaf.startswith("n"), leaf).otherwise(F.lpad(leaf, 3, "0"))
    return rows.select(F.col("line").alias("ord"), F.trim("value").alias("url"), slug.alias("slug"))


def markdown_sections(spark: SparkSession, path: str) -> DataFrame:
    """stem, ord, heading, para_no, text of pages or books: sections at ``## ``, paragraphs at blank lines, comments and lone page numbers off."""
    clean = whole(spark, path).withColumn("text", F.regexp_replace("text", r"(?s)<!--.*?-->", ""))
    parts = clean.select("stem", F.posexplode(F.split("text", r"(?m)^## ")).alias("ord", "part"))
    body = parts.withColumn("heading", F.when(F.col("ord") > 0, F.trim(F.substring_index("part", "\n", 1)))).withColumn("body", F.when(F.col("ord") > 0, F.regexp_replace("part", r"^[^\n]*\n?", "")).otherwise(F.col("part")))
    paragraphs = F.filter(F.transform(F.split("body", r"\n\s*\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    return body.select("stem", "ord", "heading", F.posexplode(paragraphs).alias("para_no", "text"))


def marked_blocks(spark: SparkSession, path: str) -> DataFrame:
    """ord, title, done, total, body of a working file whose blocks begin with ``<!-- src: title [done/total] -->``."""
    parts = whole(spark, path).select(F.posexplode(F.split("text", r"(?m)^(?=<!-- src: )")).alias("ord", "part")).where(F.col("part").startswith("<!-- src: "))
    mark = r"^<!-- src: (.*?)(?: \[(\d+)/(\d+)\])? -->"
    g = lambda i: F.regexp_extract("part", mark, i)
    return parts.select("ord", g(1).alias("title"), g(2).try_cast("int").alias("done"), g(3).try_cast("int").alias("total"), F.regexp_replace("part", mark + r"\s*|\s+$", "").alias("body"))


def scenes(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a scene list whose header may follow a preamble."""
    rows = text_lines(spark, path).where(F.col("value").rlike(r"^\d+,\d+,"))
    return rows.select(F.from_csv("value", SCENES).alias("s")).select("s.*")


def chat(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHAT).json(path, mode="PERMISSIVE")


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder: path and size, contents unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("size"))


def png_size(files: DataFrame) -> DataFrame:
    """width and height from the header bytes of PNG files (path, content)."""
    at = lambda i: F.conv(F.hex(F.substring(F.col("content"), i, 4)), 16, 10).cast("int")
    return files.where(F.hex(F.substring(F.col("content"), 1, 4)) == "89504E47").select("path", at(17).alias("width"), at(21).alias("height"))


def srt_text(segments: DataFrame) -> DataFrame:
    """stem and the text of its subtitle file, from stem, ord, start, end, text."""
    from loomtext.functions.columns import srt_timestamp

    n = F.row_number().over(Window.partitionBy("stem").orderBy("ord"))
    block = F.concat(n.cast("string"), F.lit("\n"), srt_timestamp(F.col("start")), F.lit(" --> "), srt_timestamp(F.col("end")), F.lit("\n"), "text", F.lit("\n"))
    rows = segments.select("stem", n.alias("n"), block.alias("b"))
    return rows.groupBy("stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "b"))), lambda x: x["b"]), "\n").alias("text"))
