"""Starts of sections at their announcements, on cases worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from loomtext.operators import announcements as a
from loomtext.operators import passes as p

SEGMENT, SECTION, SILENCE = "array<struct<start:double,end:double,text:string>>", "array<struct<start:double,end:double,heading:string>>", "array<struct<start:double,end:double>>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(rows, kind, *names):
    return F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), kind)


def segments(*rows):
    return arr(rows, SEGMENT, "start", "end", "text")


def test_sentences(spark):
    got = one(spark, a.timed_sentences(segments((0, 4, "One two. And th"), (5, 6, " "), (6, 8, "en more. e.g. this"), (9, 10, "ends. Yes"))))
    assert [r["text"] for r in got] == ["One two.", "And th en more. e.g. this ends.", "Yes"]
    assert [round(r["start"], 6) for r in got] == [0, round(4 * 9 / 15, 6), round(9 + 6 / 9, 6)]
    assert one(spark, a.timed_sentences(segments())) == [] and one(spark, a.timed_sentences(segments((0, 1, "")))) == []


def test_own_words(spark):
    assert one(spark, a.own_words(F.array(F.lit("Unit testing"), F.lit("Mock unit"), F.lit(None).cast("string"), F.lit("The unit again Again")))) == [[], ["mock"], [], ["again"]]


def test_pauses(spark):
    q = arr([(1, 2), (1.5, 4), (9, 9.4)], SILENCE, "start", "end")
    assert [one(spark, a.pause_at(q, F.lit(float(m)))) for m in (0.2, 0.5, 1.5, 4.6, 5)] == [0, 1, 2.5, 2.5, 0]


@pytest.mark.parametrize(
    "sentence, english, quiet, start",
    [
        ("Now the next slide please.", "x.", 1.0, 55.0),
        ("Теперь этот слайдик.", "x.", 1.5, 55.0),
        ("Тогда переходим к делу.", "x.", 1.5, 55.0),
        ("Дальше про заглушки.", "Now mocking.", 1.5, 55.0),
        ("Дальше про заглушки.", "Now hammocks.", 1.5, 60.0),
        ("Now the next slide please.", "x.", 0.9, 60.0),
        ("Now the next slide " + "and on " * 12 + "please.", "x.", 2.0, 60.0),
        ("Plain words of old.", "Plain.", 2.0, 60.0),
    ],
)
def test_announced(spark, sentence, english, quiet, start):
    sections = arr([(0, 60, "Unit"), (60, 120, "Mock objects")], SECTION, "start", "end", "heading")
    said = segments((0, 50, "All of the before."), (55, 59, sentence), (61, 70, "And after."))
    spoken = segments((0, 50, "Before."), (55, 59, english), (61, 70, "After mock."))
    got = one(spark, a.refined(sections, said, spoken, arr([(55 - quiet, 55)], SILENCE, "start", "end")))
    assert [r["start"] for r in got] == [0.0, start] and [r["moved"] for r in got] == [False, start != 60]


def test_looks_pass_over_runs(spark):
    """A look into a long array meets one or two of its runs, and finds what a look at every item would."""
    items = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: (i * 2).cast("double"))
    runs = p.chunked(items)
    assert one(spark, F.size(runs)) == 32 and one(spark, F.size(p.chunked(F.array().cast("array<double>")))) == 1
    assert one(spark, p.around(runs, F.lit(100.0), F.lit(110.0))) == [float(i) for i in range(64, 128, 2)]
    assert one(spark, p.around(p.chunked(F.array().cast("array<double>")), F.lit(0.0), F.lit(1.0))) == []
    headings = F.array(*[F.lit(f"same{'abcdefgh'[k % 8]} only{'ijklmnopq'[k]}") for k in range(9)])
    assert one(spark, a.own_words(headings))[0] == ["samea", "onlyi"] and one(spark, p.stripped(F.lit(" a \u2028"))) == "a \u2028"
