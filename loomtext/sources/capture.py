"""Pages shown by a browser and scenes of a recording: an interface to what shows them, and the rules of keeping a picture."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators import passes
from loomtext.operators.models import with_column

CAPTURE = "struct<image:binary,problems:array<string>>"


class Browser(Protocol):
    """``show`` may fail; ``text`` is what the page says, ``shot`` its picture, ``clear`` closes what lies over it."""

    def show(self, url: str) -> None: ...

    def text(self) -> str: ...

    def shot(self) -> bytes: ...

    def clear(self) -> None: ...


def shown(browser: Browser, url: str, tries: int = 3, pause: float = 2.0) -> None:
    """Show a page, again after a growing pause where that fails; the last failure is raised."""
    for n in range(1, tries + 1):
        try:
            return browser.show(url)
        except Exception:
            if n == tries:
                raise
        time.sleep(pause * n)


def picture(browser: Browser, url: str, problems: Callable[[bytes], list[str]], blocked: tuple[str, ...] = (), budget: float = 30.0, pause: float = 2.5, tries: int = 3) -> dict:
    """The picture of a page and the problems it still has once ``budget`` seconds are spent.

    A page that says one of ``blocked`` has no picture and that one problem. What lies
    over a page is closed before a clipped picture is taken again.
    """
    shown(browser, url, tries, pause)
    said = browser.text()
    if found := [f"blocked: {b}" for b in blocked if b in said][:1]:
        return {"image": None, "problems": found}
    until = time.monotonic() + budget
    image = browser.shot()
    while (left := problems(image)) and time.monotonic() < until:
        if any(p.startswith("clipped") for p in left):
            browser.clear()
        time.sleep(pause)
        image = browser.shot()
    return {"image": image, "problems": left}


def captured(urls: DataFrame, key: str, url: str, browser: Callable[[], Browser], problems: Callable[[bytes], list[str]], **limits) -> DataFrame:
    """``key``, ``image`` and ``problems`` for every page; each has a browser of its own, made where it is used."""
    return with_column(urls, key, url, "got", CAPTURE, lambda u: picture(browser(), u, problems, **limits)).select(key, "got.image", "got.problems")


def scene_starts(frames: Column, threshold: float, least: float) -> Column:
    """Positions at which scenes begin among frames (t, change): the first, then changes of ``threshold`` or more, ``least`` seconds after the last begin."""

    def step(s, x, at):
        begins = (at == 0) | ((x["change"] >= threshold) & (x["t"] - s["since"] >= least))
        return begins, {"since": x["t"]}, {"since": s["since"]}

    return passes.starts_where(frames, {"since": F.lit(None).cast("double")}, step)


def scenes(frames: DataFrame, video: str, threshold: float = 27.0, least: float = 1.0) -> DataFrame:
    """Scenes (video, scene from 1, start, end) of frames (video, t, change); a recording without a change is one scene.

    The last scene ends with the last frame. A recording's frames are one array: their times
    and changes, not their pictures.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), F.coalesce("change", F.lit(0)).cast("double").alias("change"))))
    rows = frames.where("t is not null").groupBy(video).agg(ordered.alias("x")).withColumn("s", scene_starts(F.col("x"), threshold, least))
    end = lambda k: F.coalesce(F.get("x", F.get("s", k + 1))["t"], F.element_at("x", -1)["t"])
    made = F.transform("s", lambda at, k: F.struct((k + 1).alias("scene"), F.get("x", at)["t"].alias("start"), end(k).alias("end")))
    return rows.select(video, F.explode(made).alias("y")).select(video, "y.*")


def moments(ranges: DataFrame, before_end: float = 0.5) -> DataFrame:
    """The time ``at`` whose picture stands for a scene: shortly before its end, when the page is full, but not before its start."""
    return ranges.withColumn("at", F.greatest("start", F.col("end") - before_end))
