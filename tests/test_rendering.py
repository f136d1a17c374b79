"""Layouts for reading against plain loops and worked cases."""

import json
import random

from pyspark.sql import functions as F

from loomtext.operators import rendering as r


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def plain_pieces(line):
    """Character by character."""
    out, now, quote = [], "", ""
    for x in line:
        if not quote and x == "|":
            out, now = [*out, now], ""
        now += x
        if not quote and x == ";":
            out, now = [*out, now], ""
        quote = "" if quote == x else quote or (x if x in "\"'" else "")
    return [x.strip() for x in [*out, now] if x.strip()]


def test_pieces(spark):
    rng = random.Random(3)
    lines = ["", "a | b; c", "echo 'x | y; z' | \"q;'\" ; ' open | ; ", ";;||", "|;|a;"] + ["".join(rng.choice("ab |;'\"") for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select("x", r.command_pieces(F.col("x")).alias("p")).collect()
    assert all(x["p"] == plain_pieces(x["x"]) for x in rows)
    long = "x" * 40_000 + " | " + "'" + ";" * 40_000
    assert [len(x) for x in one(spark, r.command_pieces(F.lit(long)))] == [40_000, 40_003], "very long runs don't overflow"


def test_commands(spark):
    lines = lambda x, width=20: one(spark, r.command_lines(F.lit(x), F.lit("  "), width))
    assert lines("short | one\n\n  x") == ["  short | one", "", "    x"]
    assert lines("aaaa bbbb | cccc | dddd | eeee") == ["  aaaa bbbb | cccc", "  | dddd | eeee"]
    assert lines("cd x; run 'a; b | c d'") == ["  cd x;", "  run 'a; b | c d'"]
    assert lines("say 'aaaa bbbb cccc dddd eeee ffff'") == ["  say 'aaaa bbbb cccc dddd", "  eeee ffff'"], "at least 24 characters are left"


def test_markup(spark):
    v = lambda x: one(spark, x)
    assert v(r.is_markup(F.lit("<a>x</a>"))) and not v(r.is_markup(F.lit("mentions <a> and </b> if a < b"))) and not v(r.is_markup(F.lit("<a/></a>")))
    assert [(x["token"], x["depth"]) for x in v(r.nested(F.lit("</z><a>t<b/><c>u</c> </a>v")))] == [("</z>", 0), ("<a>", 0), ("t", 1), ("<b/>", 1), ("<c>", 1), ("u", 2), ("</c>", 1), ("</a>", 0), ("v", 0)]
    assert v(r.markup_lines(F.lit("<a><b>one\ntwo</b></a>"))) == ["<a>", "  <b>", "    one", "    two", "  </b>", "</a>"]
    assert v(r.tag_lines(F.lit('<img src="a b" alt="cc"/>'), F.lit(""), 20)) == ["<img", '  src="a b"', '  alt="cc"', "/>"]
    assert v(r.tag_lines(F.lit("<img>"), F.lit("  "))) == ["  <img>"] and v(r.nested(F.lit(""))) == []


def test_lines(spark):
    v = lambda x, width=30: one(spark, r.text_lines(F.lit(x), F.lit(""), width))
    assert v("a\tb  \n\n" + "word " * 8) == ["a    b", "", "word word word word word word", "word word"]
    assert v("x" * 50) == ["x" * 50], "a word without a break stays whole"
    assert one(spark, r.message_lines(F.lit(None).cast("string"))) == [""]


def test_events(spark, tmp_path):
    rows = [(1, 0, "user", "Hi."), (1, 5, "assistant", None), (2, 0, None, "<p>x</p>"), (2, 1, "", "y")]
    turns = spark.createDataFrame(rows, "c long, t long, role string, text string")
    got = {(x["c"], x["t"]): (x["name"], x["rendered"].split("\n")) for x in r.events(turns, "c", "t", "role", "text").collect()}
    assert got[1, 0] == ("0001_user", ["=" * 80, "[1/2] USER", "=" * 80, "", "Hi.", ""])
    assert got[1, 5] == ("0002_assistant", ["-" * 80, "[2/2] ASSISTANT", "-" * 80, "", "", ""])
    assert got[2, 0] == ("0001_event", ["-" * 80, "[1/2] ?", "-" * 80, "", "<p>", "  x", "</p>", ""]) and got[2, 1][0] == "0002_event"
    r.write_events(turns, str(tmp_path / "out"), "c", "t", "role", "text")
    files = sorted(tmp_path.glob("out/*/*/part-*"))
    assert len(files) == 4
    text = next(f for f in files if "conversation=1" in str(f) and "0002" in str(f)).read_text()
    assert json.loads(text) == {"c": 1, "t": 5, "role": "assistant", "text": None}
    assert r.events(turns.limit(0), "c", "t", "role", "text").count() == 0
