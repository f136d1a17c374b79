"""Model-backed columns: interfaces, stubs whose answers depend only on their input, and the rules around a call.

Models run in Python workers, a row at a time: a call takes seconds, so the exchange with the worker does not count.
Everything else (offsets, contexts, totals) is native. A model must be picklable.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.operators import coverage, folds

#: Answers of a busy service, and the share of lost words from which a section is edited in parts.
BUSY = frozenset({429, 500, 502, 503, 504})
MOST_LOST, PART_WORDS = 0.2, 900
BLOCKED = "*[page text withheld by the model]*"


class ModelError(RuntimeError):
    """A call that failed; ``status`` is that of the service, None where there was no answer."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status

    def __reduce__(self):
        return ModelError, (str(self), self.status)


class TextModel(Protocol):
    def answer(self, prompt: str) -> str: ...


class SpeechModel(Protocol):
    def hear(self, audio: bytes) -> list[tuple[float, float, str]]: ...


class PageModel(Protocol):
    def read(self, image: bytes) -> str: ...


class StubModel:
    """Answers with the first words of the prompt and a short hash of it."""

    def answer(self, prompt: str) -> str:
        return " ".join(prompt.split()[:5]) + " #" + hashlib.sha256(prompt.encode()).hexdigest()[:8]

    def hear(self, audio: bytes) -> list[tuple[float, float, str]]:
        return [(0.0, 1.0, hashlib.sha256(audio).hexdigest()[:8])]

    def read(self, image: bytes) -> str:
        return "# " + hashlib.sha256(image).hexdigest()[:8]


def patient(call: Callable[[], Any], tries: int = 4, pause: float = 10.0) -> Any:
    """The result of ``call``; a busy or silent service is asked again, after a pause that grows with each try."""
    for n in range(1, tries + 1):
        try:
            return call()
        except ModelError as e:
            if n == tries or e.status is not None and e.status not in BUSY:
                raise
        time.sleep(pause * n)


def json_answer(model: TextModel, prompt: str, tries: int = 4, pause: float = 10.0) -> str:
    """An answer that is a JSON object; one that is not is asked for once more."""
    for _ in range(2):
        text = patient(lambda: model.answer(prompt), tries, pause)
        try:
            if isinstance(json.loads(text), dict):
                return text
        except ValueError:
            pass
    raise ModelError(f"no JSON object in the answer: {text[:200]}")


def with_column(df: DataFrame, key: str, value: str, made: str, kind: str, call: Callable[[Any], Any]) -> DataFrame:
    """``key`` and ``made`` (of type ``kind``) for every row, null where ``value`` is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], made: pd.Series([None if v is None or v is pd.NA or v != v else call(v) for v in b[value]], dtype=object)})

    return df.select(key, value).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {made} {kind}")


def with_answers(df: DataFrame, key: str, prompt: str, model: TextModel) -> DataFrame:
    """``key`` and ``answer`` for every row, a batch at a time; null prompts have null answers."""
    return with_column(df, key, prompt, "answer", "string", model.answer)


def with_json(df: DataFrame, key: str, prompt: str, model: TextModel, schema: str, tries: int = 4, pause: float = 10.0) -> DataFrame:
    """``key`` and ``answer`` as a struct of ``schema``; fields that the model left out are null."""
    return with_column(df, key, prompt, "answer", "string", lambda p: json_answer(model, p, tries, pause)).withColumn("answer", F.from_json("answer", schema))


def transcribed(chunks: DataFrame, model: SpeechModel, tries: int = 4, pause: float = 10.0) -> DataFrame:
    """Segments (stem, ord, start, end, text) of recordings cut into chunks (stem, chunk, seconds, audio).

    Times of a chunk begin where the chunks before it end; segments are numbered through the recording.
    """
    before = Window.partitionBy("stem").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = chunks.select(F.struct("stem", "chunk", F.coalesce(F.sum("seconds").over(before), F.lit(0.0)).cast("double").alias("offset")).alias("at"), F.col("audio"))
    placed = placed.select(F.to_json("at").alias("at"), "audio")
    heard = with_column(placed, "at", "audio", "said", "array<struct<start:double,end:double,text:string>>", lambda a: [{"start": float(s), "end": float(e), "text": t.strip()} for s, e, t in patient(lambda: model.hear(bytes(a)), tries, pause)])
    kinds = dict(chunks.dtypes)
    rows = heard.select(F.from_json("at", f"stem {kinds['stem']}, chunk {kinds['chunk']}, offset double").alias("at"), F.posexplode("said").alias("i", "s"))
    number = F.row_number().over(Window.partitionBy("stem").orderBy("chunk", "i")) - 1
    return rows.select("at.*", "i", "s.*").select("stem", number.alias("ord"), (F.col("offset") + F.col("start")).alias("start"), (F.col("offset") + F.col("end")).alias("end"), "text")


def page_text(model: PageModel, image: bytes, halves: Callable[[bytes], list[bytes]] | None, tries: int = 3, pause: float = 3.0) -> str:
    """The text of a page; a refused double page is read by halves, and a half refused again is marked."""
    try:
        return patient(lambda: model.read(image), tries, pause)
    except ModelError:
        if halves is None:
            raise
    parts = []
    for half in halves(image):
        try:
            parts.append(patient(lambda half=half: model.read(half), tries, pause).strip())
        except ModelError:
            parts.append(BLOCKED)
    return "\n\n".join(parts) + "\n"


def pages_read(images: DataFrame, key: str, image: str, model: PageModel, halves: Callable[[bytes], list[bytes]] | None = None, tries: int = 3, pause: float = 3.0) -> DataFrame:
    """``key``, ``text`` and the number of halves that stayed unread (``withheld``)."""
    read = with_column(images, key, image, "text", "string", lambda b: page_text(model, bytes(b), halves, tries, pause))
    return read.withColumn("withheld", (F.length("text") - F.length(F.replace("text", F.lit(BLOCKED)))) / len(BLOCKED)).withColumn("withheld", F.col("withheld").cast("int"))


def structure_prompts(slides: DataFrame, stem: str, order: str, *fields: str) -> DataFrame:
    """One prompt for each recording: its slides in order, as JSON."""
    rows = F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order])))
    return slides.groupBy(stem).agg(F.to_json(F.struct(F.col(stem).alias("recording"), rows.alias("slides"))).alias("prompt"))


def structure(slides: DataFrame, stem: str, order: str, fields: list[str], model: TextModel, schema: str, tries: int = 4, pause: float = 10.0) -> DataFrame:
    """What the model makes of the slides of each recording: ``stem`` and ``answer``."""
    return with_json(structure_prompts(slides, stem, order, *fields), stem, "prompt", model, schema, tries, pause)


def plain_words(text: str) -> list[str]:
    return [w.lower().replace("ё", "е") for w in re.findall(r"\w+", text)]


def lost_runs(source: str, edited: str) -> list[str]:
    """What ``coverage.dropped`` finds, for one answer of a model: words that both texts hold once are anchors, the rest is open."""
    a, b = plain_words(source), plain_words(edited)
    in_a, in_b, place = Counter(a), Counter(b), {w: j for j, w in enumerate(b)}
    met = [(i, place[w]) for i, w in enumerate(a) if in_a[w] == in_b[w] == 1]
    kept = [(-1, -1), *[met[k] for k in coverage.rising([j for _, j in met])], (len(a), len(b))]
    out = []
    for (i, j), (i2, j2) in zip(kept, kept[1:]):
        i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i] == b[j]:
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
        if i2 - i >= coverage.LOST_WORDS:
            out.append(" ".join(a[i:i2]))
    return out


def runs_said_twice(paragraphs: list[str], source: str, least: int = coverage.RUN_WORDS) -> list[str]:
    """What ``coverage.repeated`` finds, for one answer: stretches of grams that another paragraph holds too, more often than the source."""
    said = [plain_words(p) for p in paragraphs]
    holders = Counter(g for ws in said for g in {tuple(ws[i : i + least]) for i in range(len(ws) - least + 1)})
    runs: dict[str, None] = {}
    for ws in said:
        shared = [i for i in range(len(ws) - least + 1) if holders[tuple(ws[i : i + least])] > 1]
        for _, part in groupby(enumerate(shared), lambda x: x[1] - x[0]):
            places = [i for _, i in part]
            runs[" ".join(ws[places[0] : places[-1] + least])] = None
    spaced = lambda ws: "".join(f" {w} " for w in ws)
    all_, original = spaced(w for ws in said for w in ws), spaced(plain_words(source))
    return [r for r in runs if all_.count(spaced(r.split())) > original.count(spaced(r.split()))]


def faults(source: str, edited: str) -> tuple[int, list[str], list[str]]:
    """Words lost or said twice, and both as fragments."""
    lost, twice = lost_runs(source, edited), runs_said_twice([p for p in edited.split("\n\n") if p.strip()], source)
    return sum(len(t.split()) for t in lost + twice), lost, twice


def edit_prompt(source: str, lost: list[str], twice: list[str]) -> str:
    notes = [f"LOST: {t}" for t in lost] + [f"TWICE: {t}" for t in twice]
    return "\n".join(["EDIT:", source, *notes])


def edited_text(source: str, ask: Callable[[str], str], again: int = 1, part_words: int = PART_WORDS, parts: bool = True) -> tuple[str, int]:
    """The best edit of a text and the weight of its faults.

    It is edited once, then up to ``again`` times with the faults of the last try named. What is
    still lost is put back fragment by fragment, if that lowers the weight. If a fifth of the
    words is missing even so, the text is edited in parts, kept only if they are better.
    """
    best, notes = ("", float("inf")), ([], [])
    for _ in range(1 + again):
        text = ask(edit_prompt(source, *notes))
        weight, *notes = faults(source, text)
        best = min(best, (text, weight), key=lambda t: t[1])
        if not weight:
            break
    if best[1]:
        mended = "\n\n".join([best[0], *[ask(edit_prompt(t, [], [])) for t in faults(source, best[0])[1]]])
        best = min(best, (mended, faults(source, mended)[0]), key=lambda t: t[1])
    pieces = folds.split_long(source, part_words) if parts and best[1] >= MOST_LOST * max(1, len(source.split())) else []
    if len(pieces) > 1:
        each = [edited_text(p, ask, again, part_words, parts=False)[0] for p in pieces]
        best = min(best, ("\n\n".join(each), faults(source, "\n\n".join(each))[0]), key=lambda t: t[1])
    return best[0], int(best[1])


def edited(sections: DataFrame, key: str, text: str, model: TextModel, again: int = 1, part_words: int = PART_WORDS, tries: int = 4, pause: float = 10.0) -> DataFrame:
    """``key``, ``edited`` and ``faults`` (words lost or repeated, 0 for a faithful edit); null texts have nulls."""

    def call(source: str) -> dict:
        best, weight = edited_text(source, lambda p: patient(lambda: model.answer(p), tries, pause), again, part_words)
        return {"edited": best, "faults": weight}

    return with_column(sections, key, text, "made", "struct<edited:string,faults:int>", call).select(key, "made.edited", "made.faults")


def translated(requests: DataFrame, key: str, text: str, model: TextModel, system: str = "", tries: int = 4, pause: float = 10.0, cut_off: str | None = None) -> DataFrame:
    """``key`` and ``translation``, ending in one line break; an answer that ends in ``cut_off`` stops the job: half a text must not be kept."""

    def call(source: str) -> str:
        out = patient(lambda: model.answer(f"{system}\n{source}" if system else source), tries, pause)
        if cut_off is not None and out.endswith(cut_off):
            raise ModelError("the answer is cut off", 0)
        return out.strip() + "\n"

    return with_column(requests, key, text, "translation", "string", call)
