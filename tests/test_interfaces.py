"""Paged lists, older layouts, models, jobs: small inputs with results worked out by hand."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomtext.operators import jobs, models
from loomtext.operators.models import ModelError
from loomtext.sources import older, paged
from loomtext.sources.paged import Page, Scan

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module


def pages_of(pages):
    return lambda token: pages[token]


THREE = {None: Page([("a",), ("b",)], "t1"), "t1": Page([("b",), ("c",), ("c",)], "t2"), "t2": Page([("d",)])}


def test_scan_to_the_end_keeps_first_rows_once():
    assert paged.scan(pages_of(THREE)) == Scan([("a",), ("b",), ("c",), ("d",)], None, 3)


def test_scan_goes_on_from_its_token():
    part = paged.scan(pages_of(THREE), wanted=3)
    assert part == Scan([("a",), ("b",), ("c",)], "t2", 2)
    assert paged.scan(pages_of(THREE), wanted=2, before=part) == part
    whole = paged.scan(pages_of(THREE), before=part)
    assert whole == Scan([("a",), ("b",), ("c",), ("d",)], None, 3)
    assert paged.scan(lambda token: pytest.fail("a complete list is not read again"), before=whole) == whole


@pytest.mark.parametrize("last", [Page([("b",)], "t1"), Page([], "t2")])
def test_scan_stops_at_repeated_token_and_empty_page(last):
    got = paged.scan(pages_of({None: Page([("a",)], "t1"), "t1": last}))
    assert got.token is None and got.pages == 2 and len(got.rows) == 1 + len(last.rows)


def test_scan_of_unreadable_page_is_an_error():
    with pytest.raises(ValueError, match="4 items"):
        paged.scan(pages_of({None: Page([], "t1", 4), "t1": Page([("a",)])}))


def test_page_counts_and_places(spark):
    assert [paged.pages_for(n, 30) for n in (0, 1, 30, 31)] == [1, 1, 1, 2]
    rows = paged.scanned(spark, paged.scan(pages_of(THREE)).rows, "id STRING").orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_paged_stream(spark, tmp_path):
    def fetch(token):
        pages = {None: ([("a",), ("b",)], "t1"), "t1": ([("b",), ("c",)], "t2"), "t2": ([("d",)], None)}
        return Page(*pages[token])

    spark.dataSource.register(paged.source(fetch, "id STRING", "paged_test"))
    stream = spark.readStream.format("paged_test").load().dropDuplicates(["id"])
    q = stream.writeStream.format("memory").queryName("paged_rows").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(6):
            q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r["id"] for r in spark.table("paged_rows").collect()) == ["a", "b", "c", "d"]


def test_older_lists(spark):
    cols = "channel_id string, channel_name string, last_fetched_at string, playlist_map string, videos array<struct<id:string>>"
    old = spark.createDataFrame([("a", "A", "2024", "{}", [("x",), ("y",)]), ("a", "A", "2024", "{}", [("x",), ("y",)]), ("b", "B", "2023", None, []), ("c", "C", "2022", None, [("z",)]), (None, "N", "1", None, [("z",)])], cols)
    got = older.migrated(old, spark.createDataFrame([("c",)], "channel_id string")).collect()
    assert [(r["channel_id"], r["length_curr"], r["length_old"], r["last_validated_at"], r["continuation_token"], r["playlist_lengths"], len(r["videos"])) for r in got] == [("a", 2, 2, "2024", None, {}, 2)]
    assert "playlist_map" not in got[0].asDict()


def test_folder_renames(spark):
    lists = spark.createDataFrame([("Advanced C#", "advanced_c_sharp"), ("Basics", "basics"), ("F# day", "f_sharp_day"), ("F day", "f_day"), ("C#", "c_sharp"), (None, "x")], "title string, folder string")
    there = spark.createDataFrame([("advanced_c",), ("f_day",), ("basics",)], "folder string")
    assert [tuple(r) for r in older.folder_renames(lists, there).collect()] == [("advanced_c", "advanced_c_sharp")]


class Flaky:
    """Fails with the given states, then answers in turn."""

    def __init__(self, states, answers):
        self.states, self.answers = list(states), list(answers)

    def answer(self, prompt):
        if self.states:
            raise ModelError("no", self.states.pop(0))
        return self.answers.pop(0)


def test_busy_services_are_asked_again():
    assert models.patient(lambda m=Flaky([429, 503, None], ["x"]): m.answer(""), pause=0) == "x"
    for states, tries in (([400], 4), ([429, 429], 2)):
        with pytest.raises(ModelError):
            models.patient(lambda m=Flaky(states, ["x"]): m.answer(""), tries, 0)


def test_json_is_asked_for_twice():
    assert models.json_answer(Flaky([], ["[1]", '{"a": 1}']), "", pause=0) == '{"a": 1}'
    with pytest.raises(ModelError, match="no JSON"):
        models.json_answer(Flaky([], ["no", "no", '{"a": 1}']), "", pause=0)


class Upper:
    def answer(self, prompt):
        return json.dumps({"title": prompt.upper()})


def test_json_column(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, p string")
    got = {r["k"]: r["answer"] for r in models.with_json(df, "k", "p", Upper(), "title string, other int").collect()}
    assert tuple(got[1]) == ("A", None) and got[2] is None


class Ear:
    def hear(self, audio):
        return [(0.5, 1.0, f" {audio.decode()} "), (1.0, 2.0, "end")]


def test_speech_times_go_through_the_chunks(spark):
    chunks = spark.createDataFrame([("s", 0, 10.0, b"one"), ("s", 1, 5.0, b"two"), ("t", 0, 3.0, b"tee"), ("t", 1, 1.0, None)], "stem string, chunk int, seconds double, audio binary")
    got = models.transcribed(chunks, Ear(), pause=0).orderBy("stem", "ord").collect()
    assert [tuple(r) for r in got] == [("s", 0, 0.5, 1.0, "one"), ("s", 1, 1.0, 2.0, "end"), ("s", 2, 10.5, 11.0, "two"), ("s", 3, 11.0, 12.0, "end"), ("t", 0, 0.5, 1.0, "tee"), ("t", 1, 1.0, 2.0, "end")]


class Eye:
    def read(self, image):
        if len(image) > 4 or image == b"bad!":
            raise ModelError("refused", 400)
        return image.decode() + "\n"


def test_refused_pages_are_read_by_halves(spark):
    df = spark.createDataFrame([(1, b"page"), (2, b"leftbad!"), (3, None)], "k long, image binary")
    halves = lambda b: [b[:4], b[4:]]
    got = {r["k"]: (r["text"], r["withheld"]) for r in models.pages_read(df, "k", "image", Eye(), halves, pause=0).collect()}
    assert got == {1: ("page\n", 0), 2: (f"left\n\n{models.BLOCKED}\n", 1), 3: (None, None)}
    with pytest.raises(ModelError):
        models.page_text(Eye(), b"leftbad!", None, pause=0)


def test_structure_prompts_are_in_order(spark):
    slides = spark.createDataFrame([("v", 2, "b"), ("v", 1, "a")], "stem string, n int, title string")
    prompt = models.structure_prompts(slides, "stem", "n", "title").first()["prompt"]
    assert json.loads(prompt) == {"recording": "v", "slides": [{"n": 1, "title": "a"}, {"n": 2, "title": "b"}]}
    assert models.structure(slides, "stem", "n", ["title"], Upper(), "title string").first()["answer"]["title"] == prompt.upper()


SOURCE = "one two three four five six seven. eight nine ten eleven twelve thirteen fourteen. "


def body(prompt):
    return "\n".join(line for line in prompt.split("\n")[1:] if not line.startswith(("LOST:", "TWICE:")))


def test_faithful_edit_is_asked_for_once():
    asked = []
    assert models.edited_text(SOURCE, lambda p: asked.append(p) or body(p)) == (SOURCE, 0) and len(asked) == 1


def test_lost_words_are_named_in_the_second_try():
    asked = []

    def ask(prompt):
        asked.append(prompt)
        return SOURCE if "LOST:" in prompt else "one two three four five six seven."

    assert models.edited_text(SOURCE, ask) == (SOURCE, 0)
    assert "LOST: eight nine ten eleven twelve thirteen fourteen" in asked[1]


def test_lost_fragments_are_put_back_and_worse_edits_are_not_kept():
    short = "one two three four five six seven."
    text, weight = models.edited_text(SOURCE, lambda p: short if "one two" in p else body(p))
    assert weight == 0 and text == short + "\n\neight nine ten eleven twelve thirteen fourteen"
    assert models.edited_text(SOURCE, lambda p: short if "one two" in p else "")[1] == 7


def test_losing_texts_are_edited_in_parts():
    source = "a1 a2 a3 a4 a5 a6. b1 b2 b3 b4 b5 b6."
    ask = lambda p: "" if "a1" in p and "b1" in p or "." not in p else body(p)
    assert models.edited_text(source, ask, part_words=6) == ("a1 a2 a3 a4 a5 a6.\n\nb1 b2 b3 b4 b5 b6.", 0)


class Echo:
    def answer(self, prompt):
        return body(prompt)


def test_edited_column(spark):
    df = spark.createDataFrame([(1, SOURCE.strip()), (2, None), (3, "")], "k long, t string")
    got = {r["k"]: (r["edited"], r["faults"]) for r in models.edited(df, "k", "t", Echo(), pause=0).collect()}
    assert got == {1: (SOURCE.strip(), 0), 2: (None, None), 3: ("", 0)}


class Whole:
    def answer(self, prompt):
        return prompt.upper()


def test_translations(spark):
    df = spark.createDataFrame([(1, "a "), (2, None)], "k long, t string")
    got = {r["k"]: r["translation"] for r in models.translated(df, "k", "t", Whole(), "to capitals:", pause=0).collect()}
    assert got == {1: "TO CAPITALS:\nA\n", 2: None}
    with pytest.raises(Exception, match="cut off"):
        models.translated(df, "k", "t", Whole(), pause=0, cut_off="A ").collect()


def test_jobs(spark):
    asked = spark.createDataFrame([("p0-0", "a"), ("p0-1", "b")], "slot string, prompt string")
    got = jobs.run(jobs.StubService(("running", "running", "ended")), asked, pause=0).orderBy("slot").collect()
    assert [tuple(r) for r in got] == [("p0-0", "A"), ("p0-1", "B")]
    with pytest.raises(jobs.JobError, match="stopped"):
        jobs.run(jobs.StubService(("running", "canceling")), asked, pause=0)
    with pytest.raises(jobs.JobError, match="still running"):
        jobs.run(jobs.StubService(("running",)), asked, pause=0, longest=0)


def test_slots_must_fit(spark):
    asked = spark.createDataFrame([(s, "x") for s in ("a", "b", "c", "d")], "slot string, prompt string")
    came = spark.createDataFrame([("a", "1", None), ("b", "1", None), ("b", "2", None), ("c", None, "refused"), ("z", "1", None)], "slot string, answer string, problem string")
    assert {tuple(r) for r in jobs.slot_faults(asked, came).collect()} == {("b", "repeated"), ("c", "failed"), ("d", "missing"), ("z", "unknown")}

    class Wrong(jobs.StubService):
        def fetch(self, job):
            return came

    with pytest.raises(jobs.JobError, match="b repeated, c failed, d missing, z unknown"):
        jobs.run(Wrong(), asked, pause=0)
    assert jobs.slot_faults(asked, came.where(F.lit(False))).count() == 4
