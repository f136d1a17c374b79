"""Files and folders of an older layout, brought into the present one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.columns import slug

#: Columns of an old list that the present one does not have, and those taken over as they are.
LEFT_OUT = ["playlist_map", "playlist_map_at"]
TAKEN_OVER = ["channel_id", "channel_name", "channel_handle", "last_fetched_at", "continuation_token", "pages_fetched", "videos"]
LENGTHS = "map<string,struct<length_curr:int,length_old:int>>"


def migrated(old: DataFrame, present: DataFrame) -> DataFrame:
    """Old cached lists as rows of the present layout, but for channels that have one already or have no videos.

    Both lengths are counted anew, the list counts as checked when it was fetched, and lengths by
    playlist begin empty. Columns that an old file lacks are null; repeated rows of a channel give one.
    """
    have = {n for n in old.columns if n not in LEFT_OUT}
    kept = [F.col(n) if n in have else F.lit(None).cast("int" if n == "pages_fetched" else "string").alias(n) for n in TAKEN_OVER]
    count = F.size("videos").alias("length_curr"), F.size("videos").alias("length_old")
    rows = old.where("channel_id is not null and size(videos) > 0").select(*kept).dropDuplicates(["channel_id"])
    new = rows.join(present.select("channel_id").distinct(), "channel_id", "left_anti")
    return new.select(*TAKEN_OVER, *count, F.col("last_fetched_at").alias("last_validated_at"), F.from_json(F.lit("{}"), LENGTHS).alias("playlist_lengths"))


def former_slug(title: Column, longest: int = 60) -> Column:
    """The folder name of a title before C#, F# and C++ were written out."""
    return slug(F.translate(title, "#+", "  "), longest)


def folder_renames(playlists: DataFrame, folders: DataFrame) -> DataFrame:
    """Folders (``folder``) still named by the older rule: ``former`` and ``folder``, the name that ``playlists`` (title, folder) want.

    A former name that another playlist wants now is left alone; if several playlists had the same one, the least wanted name gets it.
    """
    named = playlists.select("folder", former_slug(F.coalesce("title", F.lit(""))).alias("former")).where("folder is not null and former <> folder")
    free = named.join(playlists.select(F.col("folder").alias("former")).distinct(), "former", "left_anti")
    there = free.join(folders.select(F.col("folder").alias("former")).distinct(), "former", "left_semi")
    return there.groupBy("former").agg(F.min("folder").alias("folder"))
