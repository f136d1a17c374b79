"""Readers of landed JSON results and of headers of landed images; missing parts become nulls."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions.columns import links
from loomtext.sources.readers import NOISE_DB, LEAST_SILENCE, REVEALS, json_document, json_lines

SILENCES = "source STRING, noise_db DOUBLE, min_seconds DOUBLE, silences ARRAY<ARRAY<DOUBLE>>"
SLIDES = "video STRING, channel STRING, playlist STRING, slides_folder STRING, generated STRING, model STRING, slides ARRAY<STRUCT<file:STRING,scene:STRUCT<number:INT,start_seconds:DOUBLE,end_seconds:DOUBLE,length_seconds:DOUBLE>,title:STRING,body:ARRAY<STRING>,photo_description:STRING,role:STRING,section:STRING,flags:ARRAY<STRING>,note:STRING>>"
INFO = "id STRING, url STRING, title STRING, channel STRING, playlist STRING, playlist_index INT, date STRING, duration_seconds DOUBLE, duration_text STRING, chapters ARRAY<STRUCT<start:DOUBLE,end:DOUBLE,title:STRING>>"
EDITS = "video STRING, model STRING, sections MAP<STRING,STRUCT<heading_en:STRING,range:ARRAY<DOUBLE>,rules:INT,coverage:STRUCT<dropped:ARRAY<STRING>,repeated:ARRAY<STRING>>,split_tried:BOOLEAN>>"
COMMENTS = "comments ARRAY<STRUCT<text:STRING,author:STRING,author_is_uploader:BOOLEAN>>"
PRICE = "usd_per_minute DOUBLE, updated STRING, checked STRING, model STRING, source STRING"
ENTRIES = "id STRING, title STRING, duration DOUBLE, playlist_index INT, playlist_autonumber INT"


def stem_of(ending: str) -> Column:
    """The name of the file a row was read from, without ``ending``."""
    return F.regexp_replace(F.col("_metadata.file_name"), ending.replace(".", r"\.") + "$", "")


def stored_silences(spark: SparkSession, path: str, noise_db: float = NOISE_DB, least: float = LEAST_SILENCE) -> DataFrame:
    """stem, start, end; files made with other settings of the detector are left out."""
    files = spark.read.schema(SILENCES).json(path, multiLine=True).select(stem_of(".silences.json").alias("stem"), "*")
    same = files.where((F.col("noise_db") == noise_db) & (F.col("min_seconds") == least))
    return same.select("stem", F.explode("silences").alias("s")).select("stem", F.get("s", F.lit(0)).alias("start"), F.get("s", F.lit(1)).alias("end"))


def reveals(spark: SparkSession, path: str) -> DataFrame:
    """video, scene, seconds, kind, added_fraction, kept_fraction; a scene without reveals gives one row of nulls."""
    scenes = json_document(spark, path, REVEALS).select("video", F.explode("scenes").alias("s"))
    each = scenes.select("video", F.col("s.scene").alias("scene"), F.explode_outer("s.reveals").alias("r"))
    return each.select("video", "scene", "r.seconds", "r.kind", "r.added_fraction", "r.kept_fraction")


def slides(spark: SparkSession, path: str) -> DataFrame:
    """A row for each slide: video, pos from 0 and the slide's fields."""
    return json_document(spark, path, SLIDES).select("video", F.posexplode("slides").alias("pos", "s")).select("video", "pos", "s.*")


def chapters(spark: SparkSession, path: str) -> DataFrame:
    """stem, id, pos from 0, start, end, title; a video without chapters gives one row of nulls."""
    files = spark.read.schema(INFO).json(path, multiLine=True).select(stem_of(".json").alias("stem"), "id", F.posexplode_outer("chapters").alias("pos", "c"))
    return files.select("stem", "id", "pos", "c.start", "c.end", "c.title")


def edits(spark: SparkSession, path: str) -> DataFrame:
    """video, key, heading_en, start, end, rules, lost (dropped and repeated runs; null without a check), split_tried."""
    rows = json_document(spark, path, EDITS).select("video", F.explode("sections").alias("key", "s"))
    lost = F.when(F.col("s.coverage").isNotNull(), F.coalesce(F.size("s.coverage.dropped"), F.lit(0)) + F.coalesce(F.size("s.coverage.repeated"), F.lit(0)))
    return rows.select("video", "key", "s.heading_en", F.get("s.range", F.lit(0)).alias("start"), F.get("s.range", F.lit(1)).alias("end"), "s.rules", lost.alias("lost"), F.coalesce("s.split_tried", F.lit(False)).alias("split_tried"))


def comment_links(spark: SparkSession, path: str) -> DataFrame:
    """stem, pos, link_no, link, before (the text ahead of the link) of comments by the uploader."""
    files = spark.read.schema(COMMENTS).json(path, multiLine=True).select(stem_of(".json").alias("stem"), F.posexplode("comments").alias("pos", "c"))
    own = files.where("c.author_is_uploader").select("stem", "pos", F.col("c.text").alias("text"))
    each = own.select("stem", "pos", "text", F.posexplode(links(F.col("text"))).alias("link_no", "link"))
    return each.select("stem", "pos", "link_no", "link", F.expr("substring_index(text, link, 1)").alias("before"))


def chosen_link(found: DataFrame, label: str) -> DataFrame:
    """stem and link: the first whose text ahead ends in ``label`` (a pattern), else the first of all."""
    rank = F.struct((~F.col("before").rlike(rf"(?iu)(?:{label})\W*$")).alias("k"), "pos", "link_no")
    return found.groupBy("stem").agg(F.min_by("link", rank).alias("link"))


def price(spark: SparkSession, path: str, today: Column, fallback: float, days: int = 30) -> DataFrame:
    """One row: usd_per_minute and ``fresh`` (checked within ``days``); a missing rate takes the fallback and is not fresh."""
    got = json_document(spark, path, PRICE).select(F.coalesce("usd_per_minute", F.lit(fallback)).alias("usd_per_minute"), (F.col("usd_per_minute").isNotNull() & (F.datediff(today, F.to_date("checked")) <= days)).alias("f"))
    return got.select("usd_per_minute", F.coalesce("f", F.lit(False)).alias("fresh"))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of landed list scans: stem (one file, one list), id, title, duration, place (from 1); a missing place counts lines."""
    rows = spark.read.schema(ENTRIES).json(path, mode="DROPMALFORMED").select(stem_of(".jsonl").alias("stem"), "*", F.monotonically_increasing_id().alias("_at")).where("id is not null")
    line = F.row_number().over(Window.partitionBy("stem").orderBy("_at"))
    return rows.select("stem", "id", "title", "duration", F.coalesce("playlist_index", "playlist_autonumber", line).alias("place"))


def chat_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of chat logs with their blocks as JSON text; an event without a message gives one row of nulls."""
    rows = json_lines(spark, path, "role STRING, type STRING, message STRUCT<content:ARRAY<STRING>>")
    return rows.select(F.coalesce("role", "type").alias("role"), F.posexplode_outer("message.content").alias("block_no", "block"))


def under_key(files: DataFrame, text: str, key: str) -> DataFrame:
    """The columns of ``files`` and, for every object under ``key`` at any depth of its JSON ``text``, ord and the object as JSON.

    Objects come in the order of the document, outer before inner; text that is not JSON gives none.
    """

    def found(node) -> Iterator[str]:
        todo = [node]
        while todo:
            at = todo.pop()
            if isinstance(at, dict):
                if isinstance(at.get(key), dict):
                    yield json.dumps(at[key], ensure_ascii=False)
                todo += reversed(at.values())
            elif isinstance(at, list):
                todo += reversed(at)

    def parsed(raw: str | None) -> list[str]:
        try:
            return list(found(json.loads(raw or "")))
        except ValueError:
            return []

    @F.pandas_udf("array<string>")
    def walk(raw: pd.Series) -> pd.Series:
        return raw.map(parsed)

    return files.select("*", F.posexplode(walk(F.col(text))).alias("ord", "object"))


def jpeg_size(raw: bytes) -> tuple[int, int] | None:
    """Width and height from the first frame header; the markers before it are passed by their lengths."""
    at = 2
    while at + 9 <= len(raw):
        if raw[at] != 0xFF:
            return None
        kind = raw[at + 1]
        if kind == 0xFF:
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(raw[at + 7 : at + 9]), int.from_bytes(raw[at + 5 : at + 7])
        else:
            at += 2 + int.from_bytes(raw[at + 2 : at + 4])
    return None


def webp_size(raw: bytes) -> tuple[int, int] | None:
    """Width and height of the three forms of the format (extended, lossless, lossy)."""
    small = lambda a, n: int.from_bytes(raw[a : a + n], "little")
    if len(raw) < 30:
        return None
    if raw[12:16] == b"VP8X":
        return small(24, 3) + 1, small(27, 3) + 1
    if raw[12:16] == b"VP8L":
        return (small(21, 4) & 0x3FFF) + 1, (small(21, 4) >> 14 & 0x3FFF) + 1
    return (small(26, 2) & 0x3FFF, small(28, 2) & 0x3FFF) if raw[12:16] == b"VP8 " else None


def image_size(raw: bytes | None) -> tuple[int, int] | None:
    raw = raw or b""
    if raw[:4] == b"\x89PNG" and len(raw) >= 24:
        return int.from_bytes(raw[16:20]), int.from_bytes(raw[20:24])
    if raw[:2] == b"\xff\xd8":
        return jpeg_size(raw)
    return webp_size(raw) if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP" else None


def image_sizes(files: DataFrame) -> DataFrame:
    """path, width, height of image files (path, content); null for headers that are not known."""

    @F.pandas_udf("width int, height int")
    def sizes(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([image_size(x) or (None, None) for x in raw], columns=["width", "height"]).astype("Int32")

    return files.select("path", sizes(F.col("content")).alias("s")).select("path", "s.*")
