"""Search and whitening against plain versions in whole numbers and fractions; every edge of the vectors."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import exact_search, whitening

SF = "/root/testdata/sf0.001"
NAMES = "uid dims shard block home chains v queries floor_score floor_id rank score query_id n deviation component".split()


def make(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])


def clean(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_search(rows, k, every):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if clean(v)]
    out = []
    for a, (i, v) in enumerate(whole):
        if i is None or i % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), math.inf if j is None else j) for b, (j, w) in enumerate(whole) if a != b and len(v) == len(w)]
        out += [(i, r, None if j == math.inf else j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def vectors_with_edges():
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)]  # ties
    rows += [(20, rows[20][1]), (20, rows[21][1]), (None, rows[0][1]), (2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (2003, [float("inf")] * 6)]
    return rows + [(2010, [1.0, 2.0]), (2020, [3.0, 4.0]), (2030, []), (2040, []), (2050, [5.0, 5.0, 5.0])]


@pytest.mark.parametrize("shard, block", [(64, 7), (300, 100), (10_000, 10_000)])
def test_search(spark, shard, block):
    rows = vectors_with_edges()
    random.Random(shard).shuffle(rows)
    got = exact_search.top_k(make(spark, rows).repartition(5), every=10, shard=shard, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(rows, 10, 10)


def test_search_of_nothing_and_of_large_numbers(spark):
    assert exact_search.top_k(make(spark, [])).count() == 0
    assert exact_search.top_k(make(spark, [(1, None)])).count() == 0
    rows = [(i, [2.0**18 * (i + 1), -(2.0**18), 1.0]) for i in range(40)]  # products beyond what a double holds exactly
    assert sorted(map(tuple, exact_search.top_k(make(spark, rows)).collect()), key=repr) == plain_search(rows, 10, 100)


def test_tree():
    """Boxes are tight, children part their parent's rows, every row is in one leaf, equal rows included."""
    rng = np.random.default_rng(3)
    points = np.vstack([rng.integers(-50, 50, (1000, 4)), np.zeros((700, 4), dtype=np.int64)])
    ids = rng.permutation(len(points))
    order, boxes, nodes = exact_search.build(points, ids)
    assert sorted(order.tolist()) == list(range(len(points)))
    for (low, high), (first, last, left, right, least) in zip(boxes, nodes.tolist()):
        inside = points[order[first:last]]
        assert (inside.min(axis=0) == low).all() and (inside.max(axis=0) == high).all() and ids[order[first:last]].min() == least
        if left < 0:
            assert last - first <= exact_search.LEAF
        else:
            assert (nodes[left][0], nodes[left][1], nodes[right][1]) == (first, nodes[right][0], last)


def test_search_prunes(spark):
    """Where vectors lie in clusters, most leaves stay shut."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 4000, (16, 8))
    points = (centres[np.arange(8000) % 16] + rng.normal(0, 30, (8000, 8))).astype(np.int64)
    order, boxes, nodes = exact_search.build(points, np.arange(8000))
    kept = points[order]

    class Counted(np.ndarray):
        opened = 0

        def __getitem__(self, at):
            Counted.opened += isinstance(at, slice)
            return np.asarray(super().__getitem__(at))

    tree = exact_search.Tree({"dims": 8, "width": 8, "points": kept.tobytes(), "ids": order.astype("<i8").tobytes(), "uids": order.astype("<i8").tobytes(), "boxes": boxes.astype("<i8").tobytes(), "nodes": nodes.astype("<i8").tobytes()})
    tree.uids = tree.uids.view(Counted)
    best = [[] for _ in range(20)]
    exact_search.search(tree, points[:20], np.arange(20), best, [None] * 20, 10)
    for i, mine in enumerate(best):
        scores = points @ points[i]
        want = sorted((-int(s), j) for j, s in enumerate(scores) if j != i)[:10]
        assert sorted((-s, -j) for s, j in mine) == want
    leaves = int((nodes[:, 2] < 0).sum())
    assert Counted.opened < 20 * leaves / 4


def plain_whitening(rows):
    """n, exact deviations and the exact covariance of the usable vectors."""
    whole = [(i, [math.floor(64 * x) + 1_000_000 for x in v]) for i, v in rows if clean(v)]
    n, d = len(whole), len(whole[0][1])
    sums = [sum(v[j] for _, v in whole) for j in range(d)]
    far = [[n * v[j] - sums[j] for j in range(d)] for _, v in whole]
    cov = [[Fraction(sum(f[a] * f[b] for f in far), n**3) for b in range(d)] for a in range(d)]
    return whole, n, far, cov


def check_whitening(rows, got, live=None, residual=1e-9):
    whole, n, far, cov = plain_whitening(rows)
    d, kept = len(cov), min(32, len(cov))
    live = kept if live is None else live
    assert len(got) == n * kept and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    trace, shown = sum(cov[j][j] for j in range(d)), np.array([[float(x) for x in f] for f in cov])
    exact = [sum(x * x for x in f) for f in far]
    assert sorted((r["deviation"] for r in by[1]), key=repr) == sorted([x if x < 2**63 else None for x in exact], key=repr)
    falling = [by[k][0]["explained"] for k in range(1, kept + 1)]
    assert falling == sorted(falling, reverse=True)
    if kept == d:
        assert sum(falling) == pytest.approx(1, rel=1e-9)
    white = np.array([[r["whitened"] for r in sorted(by[k], key=lambda r: r["vec_id"])] for k in range(1, live + 1)])
    assert np.abs(white @ white.T / n - np.eye(live)).max() < 1e-6
    for k in range(live, kept):
        assert all(r["whitened"] is None for r in by[k + 1])
    y = np.array([[f / n for f in x] for x in (z for _, z in sorted(zip([i for i, _ in whole], far)))])
    back = y.T @ white.T / n  # the component times the root of its eigenvalue
    for k in range(live):
        value = float(np.sqrt(back[:, k] @ back[:, k]))
        unit = back[:, k] / value
        assert value**2 / float(trace) == pytest.approx(falling[k], rel=1e-5)
        assert np.abs(shown @ unit - value**2 * unit).max() <= residual * float(trace)
        assert unit[np.argmax(np.abs(unit))] > 0
    assert {r["identity_error"] for r in got} and max(r["identity_error"] for r in got) < 1e-4


def test_whitening(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(rows, whitening.whiten(make(spark, rows).repartition(3)).collect())


def test_whitening_of_large_beside_small(spark):
    """Variances that differ by 1e12, and two entries that differ by little."""
    rng = random.Random(2)
    rows = []
    for i in range(300):
        a = rng.gauss(0, 1)
        rows.append((i, [float(np.float32(x)) for x in (a * 40_000, a * 40_000 + rng.gauss(0, 0.2), rng.gauss(0, 0.1), rng.gauss(5, 300), 7.0)]))
    check_whitening(rows, whitening.whiten(make(spark, rows)).collect(), live=4, residual=1e-4)  # the last entry has no variance; small components can't be told from whitened values better


def test_components_are_exact_to_double_precision():
    """Of a matrix with eigenvalues from 1e13 to 40, each returned vector times the exact matrix is its eigenvalue times itself."""
    rng = random.Random(2)
    rows = [[round(1e6 * a), round(1e6 * a + rng.gauss(0, 9)), rng.randrange(20), rng.randrange(9999)] for a in (rng.gauss(0, 1) for _ in range(200))]
    cov = [[sum(Fraction(r[a] * r[b]) for r in rows) / 200 for b in range(4)] for a in range(4)]
    values, x = whitening.eigen(np.array([[np.longdouble(float(c)) + np.longdouble(float(c - Fraction(float(c)))) for c in r] for r in cov]))
    for k in range(4):
        unit = [Fraction(float(v)) for v in x[:, k]]
        for l in range(k + 1):
            other = [Fraction(float(v)) for v in x[:, l]]
            got = float(sum(unit[a] * cov[a][b] * other[b] for a in range(4) for b in range(4))) / math.sqrt(values[k] * values[l])
            assert got == pytest.approx(float(k == l), abs=1e-7)


def test_whitening_edges(spark):
    assert whitening.whiten(make(spark, [])).count() == 0
    one = whitening.whiten(make(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    rows = [(i, v) for i, v in vectors_with_edges() if i is not None and (v is None or len(v) == 6)]
    got = whitening.whiten(make(spark, rows + [(None, [0.5] * 6), (7000, [1.0, 2.0]), (7001, [2.0, 1.0])]))
    assert got.where("vec_id is null").count() == 6 and {(r["n"], r["component"]) for r in got.where("vec_id >= 7000").collect()} == {(2, 1), (2, 2)}
    assert got.where("vec_id = 20").count() == 18 and got.where("vec_id in (2000, 2001, 2002, 2003)").count() == 0
    far = [(i, [2.0**40 * i, float(i)]) for i in range(4)]  # squares beyond a long
    assert {r["deviation"] for r in whitening.whiten(make(spark, far)).collect()} == {None}


def test_double_double():
    """Sums of products keep what doubles lose."""
    rng = random.Random(9)
    high = np.array([[rng.choice([1e8, 1.0, -1e8]) * rng.random() for _ in range(3)] for _ in range(57)])
    low = high * 2.0**-60
    h, lo = whitening.outer_sums(high, low)
    for i in range(3):
        for j in range(i, 3):
            want = sum((Fraction(a) + Fraction(b)) * (Fraction(c) + Fraction(e)) for a, b, c, e in zip(high[:, i], low[:, i], high[:, j], low[:, j]))
            got = Fraction(float(h[i][j - i])) + Fraction(float(lo[i][j - i]))
            assert abs(got - want) <= abs(Fraction(10**16)) * Fraction(1, 2**95)
