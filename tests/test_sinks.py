"""Sinks and readers of landed results: round trips and small inputs worked out by hand."""

import json
import struct

from pyspark.sql import functions as F

from loomtext.sources import landed, readers, writers


def files(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def only(df):
    (row,) = df.collect()
    return row["text"]


def test_json_round_trips(spark, tmp_path):
    v = spark.createDataFrame([("c", 1, "b", "B", "1:00", "x", "u"), ("c", 0, "a", "A", None, None, None)], "channel_id string, pos int, id string, title string, duration_text string, relative_published string, url string")
    text = only(writers.videos_document(v, F.lit("2024-01-01")))
    assert json.loads(text)["length_curr"] == 2
    assert [r["id"] for r in readers.videos(spark, files(tmp_path, "v.json", text)).orderBy("pos").collect()] == ["a", "b"]
    p = spark.createDataFrame([("c", 0, "p", "P", "f", None, "s"), ("c", 26, "q", "Q", "g", None, "s"), ("c", 27, "r", "R", "g", "#own", "s")], "channel_id string, pos int, id string, title string, folder string, alias string, source string")
    assert [r["alias"] for r in readers.playlists(spark, files(tmp_path, "p.json", only(writers.playlists_document(p)))).orderBy("pos").collect()] == ["#A", "#AA", "#own"]
    m = spark.createDataFrame([("g", "a", "2"), ("g", "a", "1"), ("g", None, "3")], "g string, k string, v string")
    assert json.loads(only(writers.map_document(m, "g", "k", "v"))) == {"a": "1"}
    r = spark.createDataFrame([("v", 1, 2.0, "added", 0.1, 0.9), ("v", 1, 1.0, "replaced", 0.2, 0.8), ("v", 2, None, None, None, None)], "video string, scene int, seconds double, kind string, added_fraction double, kept_fraction double")
    back = landed.reveals(spark, files(tmp_path, "r.json", only(writers.reveals_document(r)))).orderBy("scene", "seconds").collect()
    assert [(x["scene"], x["seconds"]) for x in back] == [(1, 1.0), (1, 2.0), (2, None)]
    s = spark.createDataFrame([("v", 1, "b.png", "T", ["x"]), ("v", 0, "a.png", None, [])], "video string, pos int, file string, title string, body array<string>")
    assert [x["file"] for x in landed.slides(spark, files(tmp_path, "s.json", only(writers.slides_document(s)))).orderBy("pos").collect()] == ["a.png", "b.png"]
    i = spark.createDataFrame([("01_x", "a", "T", "20240229", 60.0, [(0.0, 5.0, " One ")])], "stem string, id string, title string, upload_date string, duration double, chapters array<struct<start_time:double,end_time:double,title:string>>")
    text = only(writers.info_document(i))
    assert json.loads(text)["date"] == "2024-02"
    assert [tuple(x)[:1] + tuple(x)[2:] for x in landed.chapters(spark, files(tmp_path, "01_x.json", text)).collect()] == [("01_x", 0, 0.0, 5.0, "One")]
    assert json.loads(only(writers.info_document(i.withColumn("chapters", F.lit(None).cast(i.schema["chapters"].dataType)))))["chapters"] == []


def test_texts(spark, tmp_path):
    b = spark.createDataFrame([("w", 1, "Two", 1, 3, "part"), ("w", 0, "One", None, None, "whole")], "stem string, ord int, title string, done int, total int, body string")
    back = readers.marked_blocks(spark, files(tmp_path, "w.md", only(writers.marked_text(b)))).orderBy("ord").collect()
    assert [(r["title"], r["done"], r["total"], r["body"]) for r in back] == [("One", None, None, "whole"), ("Two", 1, 3, "part")]
    p = spark.createDataFrame([("t", 1, "dd"), ("t", 0, "aa bb cc")], "stem string, ord int, text string")
    assert only(writers.transcript_text(p, 5)) == "aa bb\ncc\n\ndd"
    m = spark.createDataFrame([("m", "Doc", 1, "Last one", 0, "z"), ("m", "Doc", 0, "First", 1, "b"), ("m", "Doc", 0, "First", 0, "a")], "stem string, title string, ord int, heading string, para_no int, text string")
    text = only(writers.markdown_text(m, contents=False))
    assert text == "# Doc\n\n## First\n\na\n\nb\n\n## Last one\n\nz\n"
    assert "- [Last one](#" in only(writers.markdown_text(m))
    r = spark.createDataFrame([("g", 2, "name too long", 1.5), ("g", 1, None, 10.0)], "g string, o int, name string, n double")
    assert only(writers.report_text(r, "g", ["o"], {"name": 4, "n": 5})) == "name      n\n----  -----\n       10.0\nname too long    1.5"
    writers.land(p.select("stem", "text").where("ord = 0"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).collect() == [("aa bb cc", "t")]


def test_tables(spark, tmp_path):
    e = spark.createDataFrame([("v", "H", 1.0, 0, "old"), ("v", "H", 1.0, 1, "new"), ("w", "K", 0.0, 0, "k")], "video string, heading string, start double, ord int, body string")
    at = str(tmp_path / "edits")
    writers.edit_cache(e, at)
    writers.edit_cache(e.where("video = 'v' and ord = 0"), at)
    assert sorted((r["video"], r["key"], r["body"]) for r in spark.read.parquet(at).collect()) == [("v", "H|1.0", "old"), ("w", "K|0.0", "k")]
    s = spark.createDataFrame([("2024-01-02", 90, 0.12345)], "d string, s int, c double")
    writers.typed_summary(s, str(tmp_path / "sum"), "d", "s", "c")
    assert [t for _, t in spark.read.parquet(str(tmp_path / "sum")).dtypes] == ["date", "interval day to second", "decimal(12,4)"]
    f = spark.createDataFrame([("a", "x.mp4", "old"), ("b", "02_y.mp4", "P"), ("c", "z.mp4", "old"), ("d", "x.mp4", "more")], "id string, name string, folder string")
    m = spark.createDataFrame([("a", "P", 1), ("a", "Q", 5), ("b", "P", 2), ("d", "P", 1)], "id string, wanted string, place int")
    plan = {r["id"]: r["status"] for r in writers.organise_plan(f, m).collect()}
    assert plan["a"] == plan["d"] == "clash" and plan["c"] == "unknown" and plan["b"] in ("keep", "move")
    lines = spark.createDataFrame([("run", 0, 'cd "C:\\old\\Tool"'), ("run", 1, 'go "x/two"'), ("run", 2, "rem")], "stem string, line int, value string")
    known = spark.createDataFrame([("D:\\new\\tool",), ("a/two",), ("b/two",)], "path string")
    assert [r["fixed"] for r in writers.repaired_scripts(lines, known).orderBy("line").collect()] == ['cd "D:\\new\\tool"', 'go "x/two"', "rem"]
    assert [r["fps"] for r in writers.with_rate(spark.createDataFrame([(0, 50, 1.0, 3.0), (0, 5, 1.0, 1.0)], "start_frame int, end_frame int, start_seconds double, end_seconds double")).collect()] == [25.0, None]


def test_landed(spark, tmp_path):
    files(tmp_path, "a.silences.json", json.dumps({"noise_db": -30.0, "min_seconds": 0.35, "silences": [[1.0, 2.0], [3.0, 4.5]]}))
    files(tmp_path, "b.silences.json", json.dumps({"noise_db": -20.0, "min_seconds": 0.35, "silences": [[1.0, 2.0]]}))
    assert [tuple(r) for r in landed.stored_silences(spark, str(tmp_path / "*.silences.json")).orderBy("start").collect()] == [("a", 1.0, 2.0), ("a", 3.0, 4.5)]
    text = json.dumps({"video": "v", "sections": {"H|1": {"range": [1.0, 2.0], "rules": 3, "coverage": {"dropped": ["x"], "repeated": []}}, "K|2": {"rules": 1}}})
    got = {r["key"]: r for r in landed.edits(spark, files(tmp_path, "e.json", text)).collect()}
    assert got["H|1"]["lost"] == 1 and got["H|1"]["end"] == 2.0 and got["K|2"]["lost"] is None and got["K|2"]["split_tried"] is False
    text = json.dumps({"comments": [{"text": "see https://viewer.example/x", "author_is_uploader": False}, {"text": "https://a.example/1 then slides: https://b.example/2", "author_is_uploader": True}]})
    found = landed.comment_links(spark, files(tmp_path, "n.json", text))
    assert [tuple(r) for r in landed.chosen_link(found, "slides").collect()] == [("n", "https://b.example/2")]
    assert [tuple(r) for r in landed.chosen_link(found, "deck").collect()] == [("n", "https://a.example/1")]
    day = F.lit("2024-03-01").cast("date")
    assert tuple(landed.price(spark, files(tmp_path, "x.json", json.dumps({"usd_per_minute": 0.01, "checked": "2024-02-15"})), day, 0.006).first()) == (0.01, True)
    assert tuple(landed.price(spark, files(tmp_path, "y.json", json.dumps({"checked": "2024-02-15"})), day, 0.006).first()) == (0.006, False)
    at = files(tmp_path, "l.jsonl", '{"id":"a","title":"A","playlist_index":3}\n{"id":"b"}\nnot json\n')
    assert [(r["stem"], r["id"], r["place"]) for r in landed.entries(spark, at).orderBy("id").collect()] == [("l", "a", 3), ("l", "b", 2)]
    at = files(tmp_path, "c.jsonl", '{"type":"x"}\n{"role":"user","message":{"content":[{"type":"text","text":"hi"}]}}\n')
    assert sorted((r["role"], r["block"]) for r in landed.chat_events(spark, at).fillna("").collect()) == [("user", '{"type":"text","text":"hi"}'), ("x", "")]
    df = spark.createDataFrame([(1, '{"a":{"k":{"n":1,"d":[{"k":{"n":2}}]}},"k":{"n":3}}'), (2, "no"), (3, None)], "i int, j string")
    assert [json.loads(r["object"])["n"] for r in landed.under_key(df, "j", "k").orderBy("i", "ord").collect()] == [3, 1, 2]


def test_image_sizes(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xff\xc0" + struct.pack(">HBHH", 17, 8, 30, 20) + b"\0" * 9
    lossy = b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 100, 50)
    wide = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    packed = b"RIFF\0\0\0\0WEBPVP8L" + b"\0" * 4 + b"\x2f" + ((99) | (49 << 14)).to_bytes(4, "little") + b"\0" * 5
    rows = [("png", png), ("jpeg", jpeg), ("lossy", lossy), ("wide", wide), ("packed", packed), ("none", b"zz"), ("null", None)]
    got = {r["path"]: (r["width"], r["height"]) for r in landed.image_sizes(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"png": (640, 480), "jpeg": (20, 30), "lossy": (100, 50), "wide": (100, 50), "packed": (100, 50), "none": (None, None), "null": (None, None)}
