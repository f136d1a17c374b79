"""Sinks. Each gives the rows of the files to be written; ``land`` writes them, a folder for each key, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions.columns import anchor, excel_alias, zero_padded
from loomtext.operators import passes

#: Fixed value: width of wrapped transcripts.
WIDTH = 80


def land(files: DataFrame, path: str, key: str = "stem", text: str = "text") -> None:
    """Write one text file for each key below ``path``; Spark's commit protocol keeps unfinished files out of sight."""
    files.select(key, text).repartition(key).write.mode("overwrite").option("lineSep", "\n").partitionBy(key).text(path)


def in_order(order: list[str], value: str | Column) -> Column:
    """Aggregate: the values as an array, in order."""
    value = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_v")))), lambda x: x["_v"])


def videos_document(videos: DataFrame, stamp: Column) -> DataFrame:
    """The video cache as JSON, a row for each channel: list length recounted, time of the fetch set."""
    body = F.struct("id", "title", "duration_text", "relative_published", "url")
    doc = videos.groupBy("channel_id").agg(in_order(["pos"], body).alias("videos"))
    return doc.select("channel_id", F.to_json(F.struct("channel_id", F.size("videos").alias("length_curr"), stamp.alias("last_fetched_at"), "videos")).alias("text"))


def playlists_document(playlists: DataFrame) -> DataFrame:
    """The playlist cache as JSON, a row for each channel; lists without an alias take letters by their place."""
    body = F.struct("id", "title", "folder", F.coalesce("alias", excel_alias(F.col("pos"))).alias("alias"), "source")
    doc = playlists.groupBy("channel_id").agg(in_order(["pos"], body).alias("playlists"))
    return doc.select("channel_id", F.to_json(F.struct("channel_id", "playlists")).alias("text"))


def map_document(pairs: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """A JSON object of ``key`` to ``value`` for each group; of equal keys the least value stays."""
    one = pairs.where(F.col(key).isNotNull()).groupBy(group, key).agg(F.min(value).alias(value))
    return one.groupBy(group).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))).alias("text"))


def transcript_text(paragraphs: DataFrame, width: int = WIDTH) -> DataFrame:
    """stem and text: paragraphs (stem, ord, text) wrapped to a width, an empty line between them."""
    return paragraphs.withColumn("_w", F.array_join(passes.wrapped(F.col("text"), width), "\n")).groupBy("stem").agg(F.array_join(in_order(["ord"], "_w"), "\n\n").alias("text"))


def marked_text(blocks: DataFrame) -> DataFrame:
    """stem and text of working files, the inverse of ``readers.marked_blocks``: (stem, ord, title, done, total, body)."""
    progress = F.when(F.col("done").isNotNull(), F.format_string(" [%d/%d]", "done", "total")).otherwise("")
    block = F.concat(F.lit("<!-- src: "), "title", progress, F.lit(" -->\n\n"), "body", F.lit("\n"))
    return blocks.groupBy("stem").agg(F.array_join(in_order(["ord"], block), "\n").alias("text"))


def with_rate(scenes: DataFrame) -> DataFrame:
    """Scenes with ``fps``: frames by seconds of the scene, null where it has no length."""
    return scenes.withColumn("fps", F.try_divide(F.col("end_frame") - F.col("start_frame"), F.col("end_seconds") - F.col("start_seconds")))


def reveals_document(reveals: DataFrame) -> DataFrame:
    """video and JSON text of reveals (video, scene, seconds, kind, added_fraction, kept_fraction); scenes without any stay."""
    each = F.when(F.col("seconds").isNotNull(), F.struct("seconds", "kind", "added_fraction", "kept_fraction"))
    scenes = reveals.groupBy("video", "scene").agg(F.array_compact(in_order(["seconds"], each)).alias("reveals"))
    return scenes.groupBy("video").agg(in_order(["scene"], F.struct("scene", "reveals")).alias("scenes")).select("video", F.to_json(F.struct("video", "scenes")).alias("text"))


def slides_document(slides: DataFrame) -> DataFrame:
    """video and one nested JSON text of all its slides (video, pos and any other columns)."""
    body = F.struct(*[c for c in slides.columns if c not in ("video", "pos")])
    return slides.groupBy("video").agg(in_order(["pos"], body).alias("slides")).select("video", F.to_json(F.struct("video", "slides")).alias("text"))


def info_document(videos: DataFrame) -> DataFrame:
    """stem and JSON text of video facts (stem, id, title, upload_date YYYYMMDD, duration, chapters (start_time, end_time, title))."""
    day = F.col("upload_date")
    month = F.when(day.rlike(r"^\d{8}$"), F.concat(day.substr(1, 4), F.lit("-"), day.substr(5, 2)))
    parts = F.transform(F.coalesce("chapters", F.from_json(F.lit("[]"), "array<struct<start_time:double,end_time:double,title:string>>")), lambda c: F.struct(c["start_time"].alias("start"), c["end_time"].alias("end"), F.trim(c["title"]).alias("title")))
    return videos.select("stem", F.to_json(F.struct("id", "title", month.alias("date"), F.col("duration").alias("duration_seconds"), parts.alias("chapters"))).alias("text"))


def report_text(rows: DataFrame, group: str, order: list[str], columns: dict[str, int]) -> DataFrame:
    """``group`` and text of a fixed-width report: a rule line under the names; numbers to the right, text to the left, wider values whole."""
    kinds = dict(rows.dtypes)
    number = lambda c: kinds[c] in ("int", "bigint", "double", "float") or kinds[c].startswith("decimal")

    def cell(value: Column, n: int, right: bool) -> Column:
        value = F.coalesce(value, F.lit(""))
        fill = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(n) - F.length(value)))
        return F.concat(fill, value) if right else F.concat(value, fill)

    line = F.rtrim(F.concat_ws("  ", *[cell(F.col(c).cast("string"), n, number(c)) for c, n in columns.items()]))
    head = F.rtrim(F.concat_ws("  ", *[cell(F.lit(c), n, number(c)) for c, n in columns.items()]))
    rule = "  ".join("-" * n for n in columns.values())
    return rows.groupBy(group).agg(in_order(order, line).alias("_l")).select(group, F.concat_ws("\n", head, F.lit(rule), F.array_join("_l", "\n")).alias("text"))


def markdown_text(sections: DataFrame, contents: bool = True) -> DataFrame:
    """stem and text: sections (stem, title, ord, heading, para_no, text) under headings, with a linked list of contents."""
    parts = sections.groupBy("stem", "title", "ord", "heading").agg(F.array_join(in_order(["para_no"], "text"), "\n\n").alias("_b"))
    entry = F.concat(F.lit("- ["), "heading", F.lit("](#"), anchor(F.col("heading"), any_script=True), F.lit(")"))
    body = F.concat_ws("\n\n", F.concat(F.lit("## "), "heading"), F.when(F.col("_b") != "", F.col("_b")))
    docs = parts.groupBy("stem", "title").agg(F.array_join(in_order(["ord"], entry), "\n").alias("_toc"), F.array_join(in_order(["ord"], body), "\n\n").alias("_text"))
    toc = F.when((F.col("_toc") != "") & F.lit(contents), F.col("_toc"))
    return docs.select("stem", F.concat(F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), toc, "_text"), F.lit("\n")).alias("text"))


def typed_summary(summary: DataFrame, path: str, date: str, seconds: str, cost: str) -> None:
    """The summary as a table with real types: date, duration as an interval of seconds, cost as a decimal of four digits."""
    typed = summary.withColumn(date, F.to_date(date)).withColumn(seconds, F.make_dt_interval(secs=F.col(seconds).cast("decimal(18,6)"))).withColumn(cost, F.col(cost).cast("decimal(12,4)"))
    typed.write.mode("overwrite").parquet(path)


def edit_cache(edits: DataFrame, path: str) -> None:
    """Store edited sections under (video, key = heading and start); the videos written replace their earlier sections, others stay."""
    keyed = edits.withColumn("key", F.concat_ws("|", "heading", F.format_string("%.1f", "start")))
    latest = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("video", "key").orderBy(F.desc("ord")))).where("_r = 1").drop("_r")
    latest.repartition("video").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video").parquet(path)


def organise_plan(files: DataFrame, members: DataFrame) -> DataFrame:
    """id, name, folder, target and status of landed files (id, name, folder) against lists (id, wanted folder, place).

    Status: keep (in place under its name), move, clash (another file has the target too) or unknown (in no list; its
    target is null). A file of several lists goes to the least folder.
    """
    one = members.groupBy("id").agg(F.min(F.struct("wanted", "place")).alias("m")).select("id", "m.*")
    joined = files.join(one, "id", "left").withColumn("target", F.concat_ws("/", "wanted", F.when(F.col("wanted").isNotNull(), zero_padded(F.col("name"), F.col("place")))))
    joined = joined.withColumn("target", F.when(F.col("wanted").isNotNull(), F.col("target")))
    rivals = joined.where("target is not null").groupBy("target").agg(F.count("*").alias("_n"))
    status = F.when(F.col("target").isNull(), "unknown").when(F.col("_n") > 1, "clash").when(F.col("target") == F.concat_ws("/", "folder", "name"), "keep").otherwise("move")
    return joined.join(rivals, "target", "left").select("id", "name", "folder", "target", status.alias("status"))


def repaired_scripts(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Script lines (stem, line, value) with ``fixed``: a quoted path whose last part is that of exactly one known path becomes that path.

    ``known`` holds ``path``. Paths already known and names that are not unique stay; letter case of names is ignored.
    """
    leaf = lambda c: F.lower(F.element_at(F.split(c, r"[\\/]"), -1))
    unique = known.select("path").distinct().groupBy(leaf(F.col("path")).alias("_leaf")).agg(F.count("*").alias("_n"), F.min("path").alias("_to")).where("_n = 1")
    quoted = F.regexp_extract("value", r'"([^"]*[\\/][^"]*)"', 1)
    joined = lines.withColumn("_q", quoted).withColumn("_leaf", F.when(quoted != "", leaf(quoted))).join(unique, "_leaf", "left")
    return joined.select("stem", "line", "value", F.when(F.col("_to").isNotNull(), F.replace("value", F.concat(F.lit('"'), "_q", F.lit('"')), F.concat(F.lit('"'), "_to", F.lit('"')))).otherwise(F.col("value")).alias("fixed"))
