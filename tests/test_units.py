"""Scalar functions, folds and readers on small inputs worked out by hand."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions import columns as c
from loomtext.operators import folds, models
from loomtext.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    v = lambda x: one(spark, x)
    lit = F.lit
    assert [v(c.duration_seconds(lit(t))) for t in ("1:02:03", "4:05", "45")] == [3723, 245, None]
    assert [v(c.duration_seconds(lit(t), bare=True)) for t in ("45", "?:??")] == [45, None]
    assert v(c.duration_text(lit(0))) == "0:00" and v(c.duration_text(lit(0), zero="")) == ""
    assert v(c.srt_timestamp(lit(3661.5))) == "01:01:01,500"
    assert v(c.relative_date(lit("3 weeks ago"), lit("2024-03-31").cast("date"))) == "2024-03-10"
    assert v(c.relative_date(lit("1 month ago"), lit("2024-01-15").cast("date"))) == "2023-12"
    assert str(v(c.numbered_day(lit("День 1")))) == "2022-02-24"
    assert [v(c.zero_padded(lit(t), lit(7))) for t in ("5. X.mp4", "#3 X", "12. X", "X")] == ["05. X.mp4", "#03 X", "12. X", "07_X"]
    assert [v(c.excel_alias(lit(n))) for n in (0, 25, 26)] == ["#A", "#Z", "#AA"]
    assert v(c.vision_tokens(lit(1920), lit(1080))) == 1105
    assert abs(v(c.cost_usd(lit(600), lit(0.006), lit(2))) - 0.12) < 1e-9
    assert v(c.slug(lit("Привет, C# мир"))) == "privet_c_sharp_mir"
    assert v(c.video_id(lit("https://youtu.be/abcdefghijk"))) == "abcdefghijk"


def test_folds():
    pieces = folds.split_long("One two three. Four five six. Seven eight.", 4)
    assert " ".join(pieces) == "One two three. Four five six. Seven eight." and len(pieces) == 3
    assert models.lost_runs("a b c d e f g", "a g") == ["b c d e f"] and models.lost_runs("a b", "") == []
    long = " ".join(f"w{i}" for i in range(12))
    assert models.runs_said_twice([f"a {long} b", f"c {long} d"], f"x {long} y") == [long]
    assert models.runs_said_twice([f"a {long} b", f"c {long} d"], f"{long} and {long}") == []


def test_readers(spark, tmp_path):
    (tmp_path / "01_x.srt").write_text("﻿1\r\n00:00:01,500 --> 00:00:02,000\r\nHello\r\nthere\r\n\r\nbad\r\n\r\n3\r\n00:00:03,000 --> 00:00:04,000\r\nEnd.\r\n")
    got = readers.srt(spark, str(tmp_path / "*.srt")).orderBy("ord").collect()
    assert [(r["start"], r["text"]) for r in got] == [(1.5, "Hello there"), (3.0, "End.")]
    assert "00:00:01,500 --> 00:00:02,000\nHello there" in readers.srt_text(readers.srt(spark, str(tmp_path / "*.srt"))).first()["text"]
    (tmp_path / "terms.txt").write_text("C#\nalpha # note\nAlpha\n# all\n\nbeta\n")
    assert [r["term"] for r in readers.glossary(spark, str(tmp_path / "terms.txt")).orderBy("ord").collect()] == ["C#", "alpha", "beta"]
    (tmp_path / "s.txt").write_text("A=1=2\n; no\nA=3\n")
    assert [tuple(r) for r in readers.settings(spark, str(tmp_path / "s.txt"), ["A"]).collect()] == [("A", "1=2")]
    with pytest.raises(Exception, match="unknown setting"):
        readers.settings(spark, str(tmp_path / "s.txt"), ["B"]).collect()
    (tmp_path / "log.txt").write_text("silence_start: -0.1\nsilence_end: 2.0\nsilence_end: 3\nsilence_start: 5\n")
    assert [(r["start"], r["end"]) for r in readers.silences(spark, str(tmp_path / "log.txt")).collect()] == [(0.0, 2.0)]
    (tmp_path / "p.md").write_text("<!-- c -->\n## One\n\ntext a\nmore\n\n12\n\n## Two\n\nb\n")
    assert [(r["heading"], r["text"]) for r in readers.markdown_sections(spark, str(tmp_path / "p.md")).orderBy("ord", "para_no").collect()] == [("One", "text a more"), ("Two", "b")]


def test_model_stub(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "k long, p string")
    got = {r["k"]: r["answer"] for r in models.with_answers(df, "k", "p", models.StubModel()).collect()}
    assert got[1].startswith("a b #") and got[2] is None


def test_sentences_by_abbreviation_beside_breaks(spark):
    """Dots after a line break belong to no word, so they end nothing; long texts of many sentences are cut like short ones."""
    cut = lambda t: one(spark, c.sentences_by_abbreviation(F.lit(t)))
    assert cut("word\n.. next. end") == ["word\n.. next.", "end"]
    assert cut("Św. Jan przyszedł. Był dr. Nowak! OK. a. (np. x) koniec.\" Dalej") == ["Św. Jan przyszedł.", "Był dr. Nowak!", "OK. a. (np. x) koniec.", "Dalej"]
    assert cut("") == [""] and cut(" \n") == [""] and cut("a. ") == ["a."]
    assert cut("One two. " * 3000) == ["One two."] * 3000
