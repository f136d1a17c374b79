"""Pictures as arrays of cells, row after row: what grew between two of them, and which cells never rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.passes import once

#: Percentiles of the band.
BAND = (0.05, 0.95)


def grown(cells: Column, width: int) -> Column:
    """Cells that are set or touch one that is, in a picture of ``width`` columns; null counts as not set."""

    def of(v: Column) -> Column:
        def near(_, i: Column) -> Column:
            hit = F.lit(False)
            for row in (-1, 0, 1):
                for column in (-1, 0, 1):
                    inside = (i % width + column).between(0, width - 1)
                    hit = hit | (inside & F.coalesce(F.get(v, i + (row * width + column)), F.lit(False)))
            return hit

        return F.transform(v, near)

    return once(cells, of)


def count(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda x: x)).cast("long")


def both(a: Column, b: Column, negate: bool = False) -> Column:
    """Cells that are set in a and in b (or not in b)."""
    return F.zip_with(a, b, lambda x, y: x & (~y if negate else y))


def quantile(rows: Column, q: float) -> Column:
    """The q-quantile of an ascending array, between neighbours in proportion; null for none."""

    def of(v: Column) -> Column:
        at = (F.size(v) - 1) * F.lit(q)
        low = F.get(v, F.floor(at).cast("int"))
        return low + (F.get(v, F.ceil(at).cast("int")) - low) * (at - F.floor(at))

    return F.when(F.size(rows) > 0, once(rows, of))


def growth(before: Column, after: Column, width: int) -> Column:
    """How one picture's set cells grew into another's: struct of new cells, their share of all now, the share of the old ones still in place, and the band (low, high) of the new ones.

    A cell beside an old one isn't new, and one beside a cell of now is still in
    place. The band is where the bulk of the new cells lies, from above, as shares
    of the height; a few specks don't widen it.
    """

    def of(v: Column) -> Column:
        new = both(v["after"], grown(v["before"], width), negate=True)
        kept = both(v["before"], grown(v["after"], width))
        rows = F.filter(F.transform(new, lambda x, i: F.when(x, F.floor(i / width).cast("double"))), lambda r: r.isNotNull())
        height = F.size(v["after"]) / width

        def told(w: Column) -> Column:
            edge = lambda q: F.coalesce(quantile(w["rows"], q) / height, F.lit(0.0))
            return F.struct(
                F.size(w["rows"]).cast("long").alias("new"), (F.size(w["rows"]) / F.greatest(F.lit(1), count(v["after"]))).alias("share"),
                (count(kept) / F.greatest(F.lit(1), count(v["before"]))).alias("kept"), edge(BAND[0]).alias("low"), edge(BAND[1]).alias("high"),
            )

        return once(F.struct(rows.alias("rows")), told)

    return once(F.struct(before.alias("before"), after.alias("after")), of)


def restless(pairs: DataFrame, key: str, before: str, after: str, width: int, delta: float, rate: float, calm: float) -> DataFrame:
    """The calm cells of each key, (key, mask), from pairs of pictures that follow one another.

    A cell that changes by more than ``delta`` in ``rate`` of the pairs or more is
    restless, and so are those that touch one; where less than ``calm`` of the
    cells is left, the mask is null: it would hide real changes. Changes are
    summed for each cell, beside the rows first.
    """
    moved = F.zip_with(F.col(before), F.col(after), lambda x, y: F.abs(y.cast("double") - x.cast("double")) > delta)
    cells = pairs.select(key, F.posexplode(moved).alias("cell", "moved")).groupBy(key, "cell").agg((F.avg(F.col("moved").cast("int")) >= rate).alias("restless"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("cell", "restless"))), lambda x: x["restless"])  # one picture
    mask = F.transform(grown(F.col("r"), width), lambda x: ~x)
    return cells.groupBy(key).agg(rows.alias("r")).select(key, mask.alias("mask")).select(key, F.when(count(F.col("mask")) >= calm * F.size("mask"), F.col("mask")).alias("mask"))
