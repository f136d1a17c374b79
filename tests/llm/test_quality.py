"""Pooled quartiles against a walk over every bucket, and the verdicts that follow from them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtext.llm import quality_rules as q

SIGNAL = "word_length"


def plain_bucket(v):
    return v if v < 32 else 32 * (v.bit_length() - 5) + (v >> (v.bit_length() - 6)) - 32


def plain_low(b):
    return b if b < 32 else (b % 32 + 32) << (b // 32 - 1)


def plain_quartiles(rows, prior=100):
    """Every group walks every bucket of all documents."""
    counts = Counter((g, s, plain_bucket(v)) for g, s, v in rows)
    upto = lambda b, keep: sum(n for (g, s, x), n in counts.items() if x <= b and keep(g, s))
    buckets, out = sorted({b for _, _, b in counts}), {}
    every = {b: upto(b, lambda g, s: True) for b in buckets}
    for lang in {g for g, _, _ in rows}:
        of_lang = {b: upto(b, lambda g, s: g == lang) for b in buckets}
        lean = {b: prior * (of_lang[b] + prior * every[b] / len(rows)) / (of_lang[buckets[-1]] + prior) for b in buckets}
        for source in {s for g, s, _ in rows if g == lang}:
            own = {b: upto(b, lambda g, s: g == lang and s == source) for b in buckets}
            n = own[buckets[-1]]
            out[lang, source] = (n, *[plain_low(next(b for b in buckets if (own[b] + lean[b]) * 4 >= (n + prior) * (k - 1e-9))) for k in (1, 3)])
    return out


@pytest.mark.parametrize("sources, docs, prior", [(1, 40, 100), (3, 3000, 100), (60, 900, 100), (200, 700, 5)])
def test_quartiles(spark, sources, docs, prior):
    rnd = random.Random(sources)
    rows = [(rnd.choice(["en", "de", None]), rnd.choice([None, *map(str, range(sources))]) if rnd.random() < 0.7 else "hot", int(rnd.lognormvariate(4, 1.5)) * (rnd.random() > 0.1)) for _ in range(docs)]
    rule = [r for r in q.RULES if r.signal == SIGNAL]
    d = spark.createDataFrame(rows, "lang string, source string, v long").withColumnRenamed("v", SIGNAL)
    sketches = q.sketch(d, ["lang", "source"], rule)
    got = {(r["lang"], r["source"]): (r["n_docs"], r["q1"], r["q3"]) for r in q.quartiles(sketches, prior).collect()}
    assert got == plain_quartiles(rows, prior)


def test_first_where(spark):
    for size in (1, 2, 3, 7, 8, 100):
        items = F.sequence(F.lit(1), F.lit(size))
        for least in {1, 2, size // 2, size, size + 1}:
            want = least if 1 <= least <= size else None if least > size else 1
            assert spark.range(1).select(q.first_where(items, lambda x, m=least: x >= m).alias("x")).first()["x"] == want


def test_kept(spark):
    """A long-worded document falls among plain ones of its source and stays where the source is like that."""
    plain = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    long = " ".join("x" * 40 + f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = [(i, "en", "a", plain) for i in range(400)] + [(400, "en", "a", long)] + [(1000 + i, "fr", "b", long) for i in range(3000)] + [(5000, "en", "a", "too short"), (5001, "en", "a", None)]
    got = {r["doc_id"]: r["kept"] for r in q.apply_rules(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
    assert got[0] and not got[400] and got[1000] and not got[5000] and not got[5001]
