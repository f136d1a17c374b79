"""Embedding whitening from a compensated covariance.

Method: entries become whole numbers, so counts and sums are exact and each
entry less its mean is a double-double (a high part and a rest). Centred outer
products are taken with error-free transformations (Dekker's product, Knuth's
sum), summed in double-double inside a task, and the high and low parts of the
tasks are merged the same way, a row of the matrix at a time and in two steps.
The covariance then goes to LAPACK's symmetric solver, which reduces it to a
tridiagonal matrix and divides and conquers (numpy's ``eigh``); a few rounds of
refinement in extended precision sharpen small eigenvalues beside large ones.

What the driver holds grows with the square of a vector's length, never with
the rows; the matrix of the components travels to the tasks with the code.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import store, vectors

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components returned, at most.
COMPONENTS = 32
#: Rows whose outer products are summed together, and partial matrices that are merged in the first step, about.
ROWS, MERGED = 256, 256
#: A component whose share of the largest eigenvalue is below this has no variance.
LEAST = 2.0**-44
#: Splits a double into two halves of 26 bits each.
SPLITTER = 2.0**27 + 1


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and what the rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = SPLITTER * a
    high = c - (c - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray, a_halves, b_halves) -> tuple[np.ndarray, np.ndarray]:
    """a * b rounded, and what the rounding lost."""
    p = a * b
    (ah, al), (bh, bl) = a_halves, b_halves
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def added(high: np.ndarray, low: np.ndarray, more_high: np.ndarray, more_low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-doubles."""
    s, e = two_sum(high, more_high)
    return two_sum(s, e + (low + more_low))


def total(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of double-doubles over the last axis, by halves."""
    while high.shape[-1] > 1:
        if high.shape[-1] % 2:
            high, low = (np.concatenate([x, np.zeros((*x.shape[:-1], 1))], axis=-1) for x in (high, low))
        high, low = added(high[..., ::2], low[..., ::2], high[..., 1::2], low[..., 1::2])
    return high[..., 0], low[..., 0]


def outer_sums(high: np.ndarray, low: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The sums over the rows (rows x dims, double-double) of all products of two entries: for each i those with j >= i."""
    h, lo = np.ascontiguousarray(high.T), np.ascontiguousarray(low.T)
    parts = halves(h)
    out = [], []
    for i in range(len(h)):
        p, e = two_product(h[i], h[i:], (parts[0][i], parts[1][i]), (parts[0][i:], parts[1][i:]))
        s = total(p, e + (h[i] * lo[i:] + lo[i] * h[i:]))
        out[0].append(s[0])
        out[1].append(s[1])
    return out


def as_double_double(values: list[Fraction]) -> tuple[np.ndarray, np.ndarray]:
    high = np.array([float(v) for v in values])
    return high, np.array([float(v - Fraction(h)) for v, h in zip(values, high.tolist())])


def centred(whole: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers less their mean, as double-doubles."""
    top = whole.astype(np.float64)
    rest = (whole - top.astype(np.int64)).astype(np.float64)
    s, e = two_sum(top, -mean[0])
    return two_sum(s, e + (rest - mean[1]))


def merged(sums: DataFrame) -> DataFrame:
    """The double-double sums (i, high, low: arrays) by i, of rows (i, part, high, low), in two steps."""

    def merge(group: pa.Table) -> pa.Table:
        group, width = group.combine_chunks(), len(group["high"][0])
        high, low = (vectors.flat(group[c].combine_chunks()).reshape(-1, width).T for c in ("high", "low"))
        h, lo = total(high, low)
        return pa.table({"i": group["i"][:1], "part": pa.array([0], pa.int32()), "high": pa.array([h], pa.list_(pa.float64())), "low": pa.array([lo], pa.list_(pa.float64()))})

    kind = "i int, part int, high array<double>, low array<double>"
    few = sums.withColumn("some", F.expr(f"cast(part / {MERGED} as int)")).groupBy("i", "some").applyInArrow(merge, kind)
    return few.groupBy("i").applyInArrow(merge, kind).select("i", "high", "low")


def summed(rows: DataFrame, parts) -> np.ndarray:
    """The symmetric matrix of the sums of all products of two entries, in extended precision; ``parts`` gives a batch's rows as double-doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            got = outer_sums(*parts(b))
            kept = got if kept is None else tuple(zip(*[added(*x) for x in zip(*kept, *got)]))
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(kept[0])), pa.int32()), *[pa.array(list(x), pa.list_(pa.float64())) for x in kept]], ["i", "high", "low"])

    sums = rows.mapInArrow(run, "i int, high array<double>, low array<double>").withColumn("part", F.spark_partition_id())
    found = merged(sums).collect()  # a row for each entry of a vector
    out = np.zeros((len(found), len(found)), dtype=np.longdouble)
    for r in found:
        line = np.array(r["high"], dtype=np.longdouble) + np.array(r["low"], dtype=np.longdouble)
        out[r["i"], r["i"] :] = out[r["i"] :, r["i"]] = line
    return out


def eigen(matrix: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of a symmetric matrix given in extended precision.

    Each round corrects all vectors at once from the residuals, taken in extended
    precision; vectors of (nearly) equal eigenvalues are only made orthogonal.
    A vector's largest entry is positive.
    """
    if not len(matrix):
        return np.zeros(0), np.zeros((0, 0))
    size = float(np.abs(matrix).max()) or 1.0
    a = matrix / size
    _, x = np.linalg.eigh(a.astype(np.float64))
    x = x.astype(np.longdouble)
    unit = np.eye(len(a), dtype=np.longdouble)
    for _ in range(rounds):
        r, s = unit - x.T @ x, x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        near = 2 * (np.linalg.norm(off.astype(np.float64), 2) + np.linalg.norm(r.astype(np.float64), 2))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > near
        x = x + x @ np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    values = np.diag(x.T @ (a @ x)) / np.diag(x.T @ x)
    order = np.argsort(-values)
    values, x = values[order], x[:, order] / np.sqrt(np.diag(x.T @ x))[order]
    x = x * np.sign(x[np.argmax(np.abs(x), axis=0), np.arange(len(a))])
    return (np.maximum(values, 0) * size).astype(np.float64), x.astype(np.float64)


def deviations(whole: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over the dimensions of (n * x - S) ** 2; None where it doesn't fit in a long."""
    if not len(sums):
        return [0] * len(whole)
    most = max(n * int(np.abs(whole[:, j]).max(initial=0)) + abs(s) for j, s in enumerate(sums))
    kind = np.int64 if most * most * len(sums) < 2**63 else object
    if kind is object and most < 2**63:
        each = (whole * n - np.array(sums, dtype=np.int64)).astype(object)
    else:
        each = whole.astype(kind) * n - np.array(sums, dtype=kind)
    return [v if v < 2**63 else None for v in (each * each).sum(axis=1).tolist()]


def one_length(rows: DataFrame, dims: int) -> DataFrame:
    """``whiten`` for vectors of one length (vec_id, v)."""

    def whole(batch: pa.RecordBatch) -> np.ndarray:
        return (vectors.scaled(vectors.flat(batch.column("v")), SCALE) + SHIFT).reshape(batch.num_rows, dims)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, dtype=object)
        for b in batches:
            n, sums = n + b.num_rows, sums + whole(b).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dims)], pa.int32()), pa.array([str(x) for x in (n, *sums)])], ["j", "s"])

    counted = rows.mapInArrow(count, "j int, s string").groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row for each entry of a vector
    known = {r["j"]: int(r["s"]) for r in counted}
    n, sums = known[-1], [known[j] for j in range(dims)]
    mean = as_double_double([Fraction(s, n) for s in sums])
    covariance = summed(rows, lambda b: centred(whole(b), mean)) / n
    values, components = eigen(covariance)
    live = int((values > LEAST * max(values, default=0)).sum())
    kept, trace = min(COMPONENTS, dims), float(np.trace(covariance)) if dims else 0.0
    weights = components[:, : min(kept, live)] / np.sqrt(values[: min(kept, live)])
    explained = [float(v) / trace if trace else 0.0 for v in values[:kept]]

    def projected(batch: pa.RecordBatch) -> np.ndarray:
        high, low = centred(whole(batch), mean)
        return high @ weights + low @ weights

    def with_one(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        w = np.hstack([projected(batch), np.ones((batch.num_rows, 1))])
        return w, np.zeros_like(w)

    error = None
    if live:
        again = summed(rows, with_one) / n
        error = float(np.abs(again[:-1, :-1] - np.outer(again[-1, :-1], again[-1, :-1]) - np.eye(min(kept, live))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            ids = b.column("vec_id").take(pa.array(np.repeat(np.arange(m), kept)))
            white = np.full((m, kept), np.nan)
            white[:, : weights.shape[1]] = projected(b)
            dev = pa.array(deviations(whole(b), n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), kept)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, kept + 1), m), pa.int32()), dev, pa.array(white.ravel(), from_pandas=True), pa.array(np.tile(explained, m), pa.float64())], ["vec_id", "component", "deviation", "whitened", "explained"])

    out = rows.mapInArrow(run, "vec_id bigint, component int, deviation bigint, whitened double, explained double")
    return out.select("vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))


def whiten(embeddings: DataFrame) -> DataFrame:
    """Whitened components of every usable vector of ``embeddings`` (vec_id, embedding), a row for each vector and component.

    Returns vec_id, component (from 1, by falling eigenvalue, at most COMPONENTS),
    n, deviation, whitened, explained, identity_error. A vector that is null or
    holds a null or a number that isn't finite takes no part. Repeated rows count
    as often as they occur, ids may be null. Vectors of unequal length are fitted
    apart, each length for itself; empty ones give no rows. A component without
    variance (below LEAST of the largest eigenvalue) has whitened null and
    explained as computed; if no component has any, identity_error is null too. A
    deviation that doesn't fit in a long is null. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    some = embeddings.where(vectors.usable(F.col("embedding"))).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    lengths = sorted(r[0] for r in some.select(F.size("v")).distinct().collect())  # the lengths that occur
    out = embeddings.sparkSession.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    for dims in lengths:
        if dims:
            out = out.unionByName(one_length(some.where(F.size("v") == dims), dims))
    return out
