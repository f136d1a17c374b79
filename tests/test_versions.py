"""Versions of texts found by packed grams: the rows of ``dropped``, over several buckets and packs, at few bytes a gram."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loomtext.operators import coverage, meetings


@pytest.fixture
def texts(spark):
    rng = random.Random(3)
    own = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    common, rows = own(30), []
    for i in range(60):
        kept = own(rng.randrange(5, 120))
        if i % 4 == 0:
            kept[3:3] = common  # in more sources than are rare
        if i % 5 == 0 and rows:
            other = rng.choice(rows)[2].split()
            a, b = sorted(rng.randrange(len(other) + 1) for _ in range(2))
            kept = other[:a] + own(rng.randrange(9)) + other[b:] + rng.choice([[], other])  # edited, or with grams twice
        rows.append((i if i % 3 else None, i if i % 7 else None, " ".join(kept)))
    rows += [(100, 100, rows[1][2]), (101, 101, ""), (102, 102, None), (103, 103, " ".join(common)), (None, None, rows[1][2])]
    return spark.createDataFrame(rows, "sid long, eid long, text string").repartition(3).cache()


@pytest.mark.parametrize("rare", [2, 5])
def test_versions(spark, texts, monkeypatch, rare):
    monkeypatch.setattr(meetings, "BUCKET_WORDS", 300)
    want = coverage.dropped(texts.where("sid is not null").select("sid", "text"), texts.where("eid is not null").select("eid", "text"), rare=rare)
    lost, own = coverage.versions(texts, rare=rare)
    got = lost.unionByName(own, allowMissingColumns=True)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert own.count() > 9 and lost.where("gap is not null").count() > 5


def test_bytes_of_a_gram():
    rng = np.random.default_rng(1)
    words, sizes = rng.integers(-(2**63), 2**63, 400_000), np.full(800, 500)
    ids = np.arange(800) * 977
    rows = list(meetings.pack(ids, ids, np.full(800, 3), words, sizes, 8, 4))
    grams = sum(r[1] for r in rows if r[1] > 0)
    assert grams == 800 * 493 and sum(len(x) for r in rows for x in r[2:]) < 9 * grams
    found = meetings.meeter(5, 4)
    names = [x.split()[0] for x in meetings.PACKED.split(", ")]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    twice = pa.table([pa.array(c, k) for c, k in zip(zip(*[r for r in rows if r[0] == 7] * 2, strict=True), kinds, strict=True)], names)
    assert found(twice).num_rows >= 800  # each text of one pack meets its copy in the other
