"""The audit of sources against a plain version in loops, its hashes against the library's, and every edge."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomtext.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
NAMES = "doc_id n docs term total terms blocks block one size value rank item part".split()
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def make(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])


def words_of(text):
    return [w.translate(LOWERED) for w in TERM.findall(text or "")]


def plain(rows):
    rows = [(words_of(t), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {x[1] for x in rows}:
        held = Counter(w for words, own, _ in rows if own == lang for w in set(words))
        kept = {w for w, n in held.items() if n >= 30}
        groups = {s: Counter(w for words, own, source in rows if (own, source) == (lang, s) for w in words if w in kept) for s in {x[2] for x in rows if x[1] == lang}}
        share = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        whole = sum(groups.values(), Counter())
        for s, c in groups.items():
            pairs = [(-sum(abs(share(c, w) - share(o, w)) for w in kept), t.encode()) for t, o in groups.items() if t != s]
            over = [(share(whole, w) - share(c, w), w.encode()) for w in c if share(c, w) > share(whole, w)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:50])):
                out += [(lang, s, part, item.decode(), -f, r) for r, (f, item) in enumerate(found, 1)]
    return sorted(out)


def rows_with_edges():
    rng = random.Random(4)
    pool = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(90)] + ["Ünïcode", "ünïcode", "ÀB", "日本語", "a" * 40, "A" * 40, "b" * 31, "x y", "émigré", "Zebra", "zebra", "longer" * 20, "ﬀ", "\U0001f600"]
    rows = []
    for k in range(700):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice(["a", "b", "c", None, ""])
        some = rng.sample(pool, 30) if source == "a" else pool
        rows.append((rng.choice([" ", "\n", "-", "1", "_", "\x00"]).join(rng.choice(some) for _ in range(rng.randrange(60))), lang, source))
    rows += [(None, "en", "a"), ("", None, None), ("alone", "de", "x"), (None, "de", "y"), ("same same", "en", "silent"), (" ".join(rng.choice(pool) for _ in range(200_000)), "en", "long")]
    return rows + rows[:5]


def test_audit(spark, monkeypatch):
    rows = rows_with_edges()
    got = divergence.audit(make(spark, rows).repartition(4))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = plain(rows)
    assert sorted(map(tuple, got.collect())) == want and any(r[0] == "de" and r[4] == 0 for r in want)
    con = duckdb.connect()
    con.execute("create table documents (text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    assert sorted(con.execute(divergence.ORACLE).fetchall()) == want
    monkeypatch.setattr(divergence, "ENTRIES", 40)  # many blocks of terms
    assert sorted(map(tuple, divergence.audit(make(spark, rows)).collect())) == want


def test_audit_of_nothing(spark):
    assert divergence.audit(make(spark, [])).count() == 0
    assert divergence.audit(make(spark, [(None, None, None)])).count() == 0


def slices(words, gap=b" "):
    raw = np.frombuffer(gap.join(words) + bytes(8), dtype=np.uint8).copy()
    sizes = np.array([len(w) for w in words])
    return raw, np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]), sizes


@pytest.mark.parametrize("seed", [0, 1, 2**63 + 5])
def test_hashes(seed):
    rng = random.Random(seed)
    words = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in [*range(1, 80), *range(1, 40)]]
    raw, starts, sizes = slices(words)
    assert divergence.hashes(raw, starts, sizes, seed).tolist() == [xxhash.xxh64_intdigest(w, seed=seed) for w in words]


def test_slices_with_equal_hashes_are_told_apart():
    rng = random.Random(7)
    words = [rng.choice([b"aa", b"ab", b"a" * 9, b"a" * 8 + b"b", b"c" * 40, b"c" * 39 + b"d"]) for _ in range(500)]
    raw, starts, sizes = slices(words)
    poor = lambda raw, starts, sizes, seed: np.zeros(len(starts), dtype=np.uint64)
    for hashed in (poor, divergence.hashes):
        group, firsts = divergence.grouped(raw, starts, sizes, hashed)
        names = [words[i] for i in firsts.tolist()]
        assert len(set(names)) == len(names) and [names[g] for g in group.tolist()] == words


def test_texts_end_terms():
    texts = pa.array(["ab", "", "cd ef", None, "gh", "ab"]).slice(0).fill_null("")
    row, names, times, holders = divergence.counted(texts.slice(1), np.array([0, 0, 1, 1, 0]))
    assert sorted(zip(row.tolist(), names, times.tolist(), holders.tolist())) == [(0, b"ab", 1, 1), (0, b"cd", 1, 1), (0, b"ef", 1, 1), (1, b"gh", 1, 1)]


def test_differences_of_rows():
    rng = np.random.default_rng(8)
    dense = rng.integers(0, 9, (7, 25))
    empty = rng.integers(0, 9, 7)
    stored = rng.random((7, 25)) < 0.3
    stored[2] = stored[6] = False
    whole = np.where(stored, dense, empty[:, None])
    rows, columns = np.nonzero(stored)
    got = divergence.differences(np.searchsorted(rows, np.arange(8)), columns, dense[rows, columns], empty, 25)
    assert (got == np.abs(whole[:, None] - whole[None]).sum(axis=2)).all()


def test_shares_are_exact():
    counts = np.array([0, 3, 10**12, 2 * 10**14])
    n, v = 2 * 10**14 + 10**12 + 3, 4
    assert divergence.smoothed(counts, n, v).tolist() == [1 + 10**9 * (int(c) + 5) // (n + 5 * v) for c in counts]
