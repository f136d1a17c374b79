"""Captured pages and scenes on cases worked out by hand."""

import sys

import pytest
from pyspark import cloudpickle

from loomtext.sources import capture

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module


class Screen:
    def __init__(self, shots=(b"ok",), fails=0, says=""):
        self.shots, self.fails, self.says, self.cleared = list(shots), fails, says, 0

    def show(self, url):
        self.fails -= 1
        if self.fails >= 0:
            raise OSError("not loaded")

    def text(self):
        return self.says

    def shot(self):
        return self.shots.pop(0) if len(self.shots) > 1 else self.shots[0]

    def clear(self):
        self.cleared += 1


def faults(image):
    return [image.decode()] if image != b"ok" else []


def test_pages_are_shown_again():
    assert capture.picture(Screen(fails=2), "u", faults, pause=0) == {"image": b"ok", "problems": []}
    with pytest.raises(OSError):
        capture.picture(Screen(fails=3), "u", faults, pause=0)


def test_pictures_are_taken_again():
    s = Screen([b"blank", b"clipped left", b"ok"])
    assert capture.picture(s, "u", faults, pause=0) == {"image": b"ok", "problems": []} and s.cleared == 1
    assert capture.picture(Screen([b"blank"]), "u", faults, budget=0, pause=0) == {"image": b"blank", "problems": ["blank"]}


def test_blocked_pages():
    assert capture.picture(Screen(says="Sorry, log in and wait"), "u", faults, ("log in", "wait"), pause=0) == {"image": None, "problems": ["blocked: log in"]}


def test_captured(spark):
    df = spark.createDataFrame([("p1", "u"), ("p2", None)], "slug string, url string")
    got = {r["slug"]: (r["image"], r["problems"]) for r in capture.captured(df, "slug", "url", Screen, faults, pause=0).collect()}
    assert got == {"p1": (b"ok", []), "p2": (None, None)}


def test_scenes(spark):
    a = [("a", t, c) for t, c in ((0.0, 99.0), (1.0, 1.0), (2.0, 30.0), (2.5, 40.0), (3.0, 27.0), (5.0, 26.9), (6.0, None))]
    df = spark.createDataFrame([*a, ("b", 4.0, 0.0), ("b", 1.0, 50.0), ("c", None, 1.0), ("a", 1.0, 1.0)], "video string, t double, change double")
    got = capture.moments(capture.scenes(df, "video")).orderBy("video", "scene").collect()
    assert [tuple(r) for r in got] == [("a", 1, 0.0, 2.0, 1.5), ("a", 2, 2.0, 3.0, 2.5), ("a", 3, 3.0, 6.0, 5.5), ("b", 1, 1.0, 4.0, 3.5)]
    assert capture.scenes(df.where("false"), "video").count() == 0
