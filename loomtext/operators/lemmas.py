"""Lemmas by rules that a corpus teaches itself: endings of one stem that occur together make a paradigm.

A word is cut into stem and ending in every way; the forms of a stem belong
together, and the most frequent one is the base form. How often an ending goes
with the ending of the base form makes a rule; a word takes the rule of its
longest ending that has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of a stem, at least; letters of an ending, at most; stems that must show a rule.
STEM, ENDING, SHOWN = 4, 4, 3


def cuts(words: DataFrame, least: int) -> DataFrame:
    """words (word, ...) with ``stem`` and ``ending`` for every ending of ``least`` to ENDING letters."""
    n = F.length("word")
    many = F.when(n >= STEM + least, F.sequence(F.lit(least), F.least(F.lit(ENDING), n - STEM)))
    each = words.withColumn("_k", F.explode(many))
    return each.withColumn("stem", F.expr("left(word, length(word) - _k)")).withColumn("ending", F.expr("right(word, _k)")).drop("_k")


def rules(words: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(ending, base, stems): for an ending the ending of the base form that most stems show, from words (word, n: how often)."""
    forms = cuts(words.select("word", "n"), 0)
    heads = forms.groupBy("stem").agg(F.max_by("ending", F.struct("n", (-F.length("ending")).alias("short"), "ending")).alias("base"), F.count("*").alias("forms")).where("forms > 1")
    met = forms.join(heads, "stem").where("ending <> base and ending <> ''").groupBy("ending", "base").agg(F.count("*").alias("stems")).where(F.col("stems") >= shown)
    best = met.groupBy("ending").agg(F.max(F.struct("stems", (-F.length("base")).alias("short"), "base")).alias("m"))
    return best.select("ending", "m.base", "m.stems")


def lemmas(words: DataFrame, learned: DataFrame) -> DataFrame:
    """(word, lemma) of distinct words: the rule of the longest ending applies; without one a word is its own lemma."""
    words = words.select("word").distinct()
    fits = cuts(words, 1).join(learned.select("ending", "base"), "ending")
    best = fits.groupBy("word").agg(F.max_by(F.concat("stem", "base"), F.length("ending")).alias("lemma"))
    return words.join(best, "word", "left").select("word", F.coalesce("lemma", "word").alias("lemma"))
