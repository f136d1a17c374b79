"""Word expressions that every operator shares; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that separate words, those besides the space, and a word.
SPACES = " \t\n\x0b\x0c\r"
OTHER_SPACES = "\t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once per row even where the body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), OTHER_SPACES, " " * len(OTHER_SPACES)), " "), "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def squeezed(text: Column) -> Column:
    """The text without the characters between its words."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
