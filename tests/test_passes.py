"""Order-dependent passes against plain loops and cases worked out by hand."""

import math
import random
import re
import textwrap
import time

from pyspark.sql import functions as F

from loomtext.functions import columns as c
from loomtext.operators import passes as p


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(rows, kind):
    return F.from_json(F.lit(__import__("json").dumps(rows)), f"array<{kind}>")


def test_requests(spark):
    sizes = lambda xs: arr([{"n": n, "first": f} for n, f in xs], "struct<n:int,first:boolean>")
    assert one(spark, p.request_starts(sizes([(8000, True), (8000, False), (1, True)]))) == [0, 2]
    assert one(spark, p.request_starts(sizes([(8000, True), (3000, True), (2000, True), (20000, False), (1, False)]))) == [0, 2, 4]
    assert one(spark, p.request_starts(sizes([]))) == []


def test_paragraphs(spark):
    segs = lambda xs: arr([{"start": a, "end": b, "text": t} for a, b, t in xs], "struct<start:double,end:double,text:string>")
    assert one(spark, p.gap_starts(segs([(0, 1, "a"), (1.1, 2, "b"), (4, 5, "c")]))) == [0, 2]
    assert one(spark, p.gap_starts(segs([(0, 1, "a"), (2, 3, " "), (4, 5, "c")]))) == [0], "a blank segment moves the clock"
    assert one(spark, p.gap_starts(segs([(0, 1, "x" * 1000), (1, 2, "end."), (2, 3, "next")]))) == [0, 2]
    timed = lambda xs: arr([{"n": n, "ends": e, "pause": q} for n, e, q in xs], "struct<n:int,ends:boolean,pause:double>")
    assert one(spark, p.pause_starts(timed([(44, True, 0), (1, True, 9), (50, True, 0.8), (60, True, 0.3)]))) == [0, 2]
    assert one(spark, p.pause_starts(timed([(130, True, 0), (1, True, 0.0)]))) == [0, 1], "from 130 words any sentence end will do"
    assert one(spark, p.pause_starts(timed([(230, False, 0), (5, False, 0.17), (5, False, 0.0)]))) == [0]
    assert one(spark, p.pause_starts(timed([(230, False, 0), (5, False, 0.176)]))) == [0, 1]
    assert [one(spark, p.patience(F.lit(n), F.lit(True))) for n in (44, 45, 130)] == [math.inf, 0.8, 0.0]


def test_terms_and_changes(spark):
    assert one(spark, p.prompt_terms(arr(["ab"] * 500, "string"))) == next(k for k in range(500) if int((4 * (k + 1) - 1) / 4) + 1 > 224)
    assert one(spark, p.changes(arr([10, 12, 16, 9, 2], "double"))) == ["added", None, "added", None, "replaced"]


def test_wrapping(spark):
    v = lambda x: one(spark, x)
    assert v(p.justified(F.lit("aa bb cc dd"), 6)) == ["aa  bb", "cc dd"]
    assert v(p.justified(F.lit("a b c ddddd e"), 7)) == ["a  b  c", "ddddd e"]
    assert v(p.doubled(F.lit("a b c d e"), 11)) == "a b  c d  e"
    assert v(p.doubled(F.lit("a b"), 9)) == "a b", "left ragged where doubling is not enough"
    assert v(p.justified(F.lit("short one"), 80, least=0.6)) == ["short one"] and v(p.wrapped(F.lit(""), 10)) == []
    assert v(p.justified(F.lit("x" * 30 + " y"), 10)) == ["x" * 30, "y"]


def test_long_line_is_wrapped_and_filled_as_by_hand(spark):
    """Words of any length and any white space, all rests of a line; a line of 60,000 words takes time by its length, not its square."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "bb", "ccc", "\u2028e\U0001f600", "d" * rng.randrange(1, 30)]) + rng.choice([" ", "  ", "\t", "\r "]) for _ in range(60)) for _ in range(40)]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select(p.wrapped(F.col("x"), 20).alias("w"), p.justified(F.col("x"), 20).alias("p"), p.justified(F.col("x"), 20, p.doubled).alias("d")).collect()
    for x, r in zip(texts, got):
        want = textwrap.wrap(" ".join(re.findall(r"[^\x20\x09-\x0D]+", x)), 20, break_long_words=False, break_on_hyphens=False)
        assert r["w"] == want
        for i, line in enumerate(want):
            words, spare = line.split(" "), 20 - len(line)
            gaps = len(words) - 1
            last = i == len(want) - 1 or gaps < 1
            wide = {(2 * k + 1) * gaps // (2 * spare) for k in range(spare)} if 0 < spare <= gaps else set()
            assert r["p"][i] == (line if last or spare < 0 else "".join(w + (" " * (1 + spare // gaps + (k < spare % gaps)) if k < gaps else "") for k, w in enumerate(words)))
            assert r["d"][i] == (line if last else "".join(w + (" " * (1 + (k in wide)) if k < gaps else "") for k, w in enumerate(words)))
    long = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.repeat(F.lit("w"), (i % 7 + 1).cast("int"))), " ").alias("x"))
    began = time.time()
    assert long.select(F.size(p.wrapped(F.col("x"), 80))).first()[0] > 3000 and time.time() - began < 10


def plain_refined(sections, segments):
    spots = []
    for i, (start, end, text) in enumerate(segments):
        for k in range(len(text) - 1):
            if text[k] in ".!?…" and text[k + 1] == " ":
                spots.append(start + (end - start) * (k + 1) / len(text))
        if text[-1] in ".!?…" and i + 1 < len(segments):
            spots.append(segments[i + 1][0])
    out, before = [], None
    for n, (change, end) in enumerate(sections):
        start = change
        ahead = [s for s in segments if s[0] < change]
        if n and ahead and ahead[-1][2][-1] not in ".!?…":
            low, high = max(before + 15, change - 20), min(end - 15, change + 12)
            found = [(change - t if t <= change else 1.5 * (t - change), t) for t in spots if low <= t <= high] if low < high else []
            start = min(found)[1] if found else change
        out.append((start, abs(start - change) >= 0.05))
        before = start
    return out


def test_boundaries(spark):
    rng = random.Random(4)
    for _ in range(6):
        words = ["w%d%s" % (i, "." if rng.random() < 0.07 else "") for i in range(400)]
        segs = [(5.0 * k, 5.0 * k + 4, " ".join(words[8 * k : 8 * k + 8])) for k in range(50)]
        secs = [(s, min(s + 30.0, 250.0)) for s in range(0, 250, 30)]
        got = one(spark, p.refined(arr([{"start": a, "end": b} for a, b in secs], "struct<start:double,end:double>"), arr([{"start": a, "end": b, "text": t} for a, b, t in segs], "struct<start:double,end:double,text:string>")))
        want = plain_refined(secs, segs)
        assert [r["moved"] for r in got] == [w[1] for w in want] and all(abs(r["start"] - w[0]) < 1e-6 for r, w in zip(got, want))


def test_portions(spark):
    def cut(sections, percent):
        got = one(spark, p.portion(arr([[{"n": n, "first": f} for n, f in s] for s in sections], "array<struct<n:int,first:boolean>>"), percent))
        return [(r["section"], r["units"]) for r in got["out"]], got["problem"]

    assert cut([[(3000, True)] * 4], 50) == ([(0, 2)], None)
    assert cut([[(5, True)]], 10) == ([(0, 1)], None)
    assert cut([[(1000, True)], [(2000, True)] * 6], 10) == ([(0, 1), (1, 2)], None)
    assert cut([[(4900, True)], [(9000, True)]], 10) == ([(0, 1)], None)
    assert cut([[(90_000, True)]] * 2, 10) == ([], "no cut fits the portion")


def test_names(spark):
    v = lambda x: one(spark, x)
    assert v(c.slug(F.lit("Щука и C#, часть 1"))) == "shchuka_i_c_sharp_chast_1" and v(c.slug(F.lit("C++ basics"))) == "cpp_basics"
    assert v(c.slug(F.lit("Song in C#: guitar chords"))) == "song_in_c_guitar_chords" and v(c.slug(F.lit("!!!"))) == "unnamed_playlist" and v(c.slug(F.lit("日本 語"))) == "日本_語"
    assert v(c.anchor(F.lit("a:b Żółć"))) == "a-b-zolc" and v(c.anchor(F.lit("Глава 1: начало"), any_script=True)) == "глава-1-начало" and v(c.anchor(F.lit("Глава"))) == ""
    assert v(c.same_title(F.lit("Rozdział I."), F.lit("rozdzial  i"))) and not v(c.same_title(F.lit("a"), F.lit("!")))
    assert v(c.sentences_by_capital(F.lit("Mr. X saw it. he left. Then"))) == ["Mr.", "X saw it. he left.", "Then"]
    split = lambda x: v(c.sentences_by_abbreviation(F.lit(x)))
    assert split("to jest koniec. potem dalej.") == ["to jest koniec.", "potem dalej."]
    assert split("Mr. X saw prof. Kot. He left. i.e. so. Then") == ["Mr.", "X saw prof. Kot.", "He left.", "i.e.", "so.", "Then"]
    assert split("A. Kot przyszedł. «Tak!» Nie.") == ["A. Kot przyszedł.", "«Tak!", "Nie."]
    assert split("wiek np. (str. 5) itd. Dalej? ") == ["wiek np. (str. 5) itd. Dalej?"] and split("  ") == [""] and split("bez kropki") == ["bez kropki"]
    assert v(c.slug(F.lit("Violin scales: C#"))) == "violin_scales_c" and v(c.slug(F.lit("J# and F# code"))) == "j_sharp_and_f_sharp_code" and v(c.slug(F.lit("Chord c#7"))) == "chord_c_7"
    assert v(c.respelled(F.lit("The THE the, them"), {"the": "ye"})) == "Ye YE ye, them"
    assert v(c.excel_alias(F.lit(702))) == "#AAA" and v(c.excel_alias(F.lit(475254))) == "#AAAAA"
    assert v(c.normalize_handle(F.lit("https://x.test/@name/videos"))) == "@name" and v(c.safe_name(F.lit('a:b  c?'))) == "a_b c_"
    assert v(c.stem(F.lit(3), F.lit("T: x"), F.lit("abcdefghijk"))) == "03_T_ x [abcdefghijk]" and v(c.preview(F.lit("x" * 70), 10)) == "x" * 10 + "…"
    assert v(c.same_path(F.lit("A\\b/"), F.lit("a/B"))) and v(c.language_code(F.lit(" EN "))) == "en" and v(c.cost_text(F.lit(None).cast("double"))) == "$?"
    assert v(c.is_stream(F.lit("Live talk"))) and v(c.is_stream(F.lit("День 5"), F.lit(7300))) and not v(c.is_stream(F.lit("День 5"), F.lit(100)))
    assert v(c.script_tokens(F.lit("абвгд abcd"))) == int(5 / 2.5 + 5 / 4) + 1


def test_long_tails(spark, tmp_path):
    """A sentence that ends before more than forty spaces has ended."""
    from loomtext.plans import catalog

    rows = [(1, "Done." + " " * 41, "a", "en"), (2, "Next", "a", "en"), (3, "no end" + " " * 41, "a", "en"), (4, "Last", "a", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r["doc_id"] for r in catalog.QUERIES["continuity_breaks"](spark, str(tmp_path)).collect()] == [3]


def test_beginning(spark):
    kept = lambda xs, n: one(spark, p.beginning(arr(xs, "string"), F.lit(n)))
    assert kept(["aaaa", "bb", "cccc", "d"], 6) == ["aaaa", "bb"], "the first that doesn't fit ends them"
    assert kept(["aaaa", "bb"], 1) == ["aaaa"] and kept([], 5) == [] and kept(["", "aaaa", "b"], 2) == ["", "aaaa"]
