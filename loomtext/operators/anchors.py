"""Where lists of bullets are spoken: an inverted index of word beginnings, then one pass with a cursor for each text and list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.frames import SMALL_ROWS, cut
from loomtext.operators.passes import scan

#: The least letters of a word that counts, hits that name a bullet, letters that make a word enough by itself, and words quoted.
LETTERS, HITS, LONG, QUOTED = 4, 2, 9, 8


def own_words(bullets: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """(list, bullet, word) of the words of a bullet (list, bullet, text) that no other bullet of its list has."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{%d,}" % LETTERS), F.lit(0)))
    each = bullets.select("list", "bullet", F.explode(words).alias("word"))
    each = each.where(~F.col("word").isin(*stop)) if stop else each
    return each.groupBy("list", "word").agg(F.min("bullet").alias("bullet"), F.count("*").alias("n")).where("n = 1").select("list", "bullet", "word")


def word_beginnings(spoken: DataFrame, wanted: DataFrame) -> DataFrame:
    """``spoken`` (token, ...) with ``word``, in place of the token, for every wanted word that a token begins with: its beginnings meet the words by equality."""
    longest = F.least(F.length("token"), F.lit(64))
    heads = F.transform(F.sequence(F.lit(LETTERS), longest), lambda n: F.substr(F.col("token"), F.lit(1), n))
    each = spoken.where(F.length("token") >= LETTERS).select("*", F.explode(heads).alias("word")).drop("token")
    return each.join(wanted, "word", "left_semi")


def cursor(found: Column) -> Column:
    """The sentence of each bullet, in order: the first of its hits after the one before it; found: array of (bullet, hits: ascending)."""
    state = {"at": F.lit(0), "out": F.array().cast("array<struct<bullet:int,sentence:int>>")}

    def step(s, x, at):
        first = F.get(F.filter(x["hits"], lambda h: h >= s["at"]), F.lit(0))
        return {"at": F.coalesce(first + 1, s["at"]), "out": F.when(first.isNull(), s["out"]).otherwise(F.array_append(s["out"], F.struct(x["bullet"].alias("bullet"), first.alias("sentence"))))}

    return scan(found, state, step)["out"]


def anchors(sentences: DataFrame, bullets: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """The sentence that first names each bullet, looked for after that of the bullet before it: key, list, bullet, sentence.

    ``sentences`` (key, sentence: number from 0, text) and ``bullets`` (list,
    bullet: number, text). A sentence names a bullet if words of it begin with two
    of the bullet's own words, or with one of LONG letters or more. Bullets that
    are not found are left out and don't move the search. Sentences are dealt by
    key once; where the bullets' words are few enough to be sent, all else is
    counted where the sentences lie.
    """
    own = cut(own_words(bullets, stop))
    if own.count() <= SMALL_ROWS:
        own = F.broadcast(own)
    spoken = sentences.repartition("key").select("key", "sentence", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("token"))
    said = word_beginnings(spoken, own.select("word")).select("key", "sentence", "word").distinct()
    hits = said.join(own, "word").groupBy("key", "list", "bullet", "sentence").agg(F.sum(F.when(F.length("word") >= LONG, HITS).otherwise(1)).alias("n")).where(F.col("n") >= HITS)
    each = hits.groupBy("key", "list", "bullet").agg(F.array_sort(F.collect_list("sentence")).alias("hits"))  # sentences of one text
    lists = each.groupBy("key", "list").agg(F.array_sort(F.collect_list(F.struct("bullet", "hits"))).alias("found"))  # one list and one text
    return lists.select("key", "list", F.explode(cursor(F.col("found"))).alias("x")).select("key", "list", "x.bullet", "x.sentence")


def quoted(text: Column) -> Column:
    """The first words of a sentence."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), 1, QUOTED), " ")
