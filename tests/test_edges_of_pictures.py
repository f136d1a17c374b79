"""Growth and restless cells against plain versions over small pictures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import edges


def plain_grown(a):
    out = np.zeros_like(a)
    for r, c in zip(*np.nonzero(a)):
        out[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2] = True
    return out


def test_growth(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.random(35) < 0.15).tolist(), (rng.random(35) < 0.3).tolist()) for i in range(40)] + [(40, [False] * 35, [False] * 35)]
    df = spark.createDataFrame(rows, "i long, a array<boolean>, b array<boolean>")
    got = {r["i"]: r["g"] for r in df.select("i", edges.growth(F.col("a"), F.col("b"), 5).alias("g")).collect()}
    for i, a, b in rows:
        a, b = np.array(a).reshape(7, 5), np.array(b).reshape(7, 5)
        new, kept = b & ~plain_grown(a), a & plain_grown(b)
        at = np.nonzero(new)[0]
        band = tuple(np.percentile(at, q) / 7 for q in (5, 95)) if len(at) else (0, 0)
        assert (got[i]["new"], got[i]["share"], got[i]["kept"]) == (new.sum(), new.sum() / max(1, b.sum()), kept.sum() / max(1, a.sum()))
        assert (got[i]["low"], got[i]["high"]) == pytest.approx(band)


def test_restless(spark):
    rng = random.Random(2)
    rows = []
    for key, moving in (("inset", [0, 1]), ("all", range(24)), (None, [])):
        for _ in range(30):
            a = [rng.random() for _ in range(24)]
            rows.append((key, a, [x + (1 if i in moving and rng.random() < 0.9 else 0.001) for i, x in enumerate(a)]))
    df = spark.createDataFrame(rows, "key string, a array<double>, b array<double>")
    got = {r["key"]: r["mask"] for r in edges.restless(df, "key", "a", "b", 6, 0.5, 0.5, 0.3).collect()}
    assert got["all"] is None and got[None] == [True] * 24
    assert [i for i, x in enumerate(got["inset"]) if not x] == [0, 1, 2, 6, 7, 8]
