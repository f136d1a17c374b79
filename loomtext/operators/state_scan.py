"""Scans with a finite number of states, and forward fills, over keys of any size.

A row maps each state to the state after it; a block of rows composes its rows'
maps into one. The maps of a key's blocks, one small row each, give every block
the state in which it is entered, so blocks are scanned apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.operators.frames import same_block


def composed(maps: Column, n_states: int) -> Column:
    """One map for an array of maps, the first one applied first."""
    start = F.array(*[F.lit(i) for i in range(n_states)])
    return F.aggregate(maps, start, lambda s, m: F.transform(s, lambda x: F.get(m, x)))


def entered(maps: Column, first: int | Column = 0) -> Column:
    """The state before each map of an array."""
    first = F.lit(first) if isinstance(first, int) else first
    out = F.aggregate(maps, F.array(first), lambda s, m: F.array_append(s, F.get(m, F.element_at(s, -1))))
    return F.slice(out, F.lit(1), F.size(maps))


def scan_states(df: DataFrame, keys: list[str], bucket: Column, order: str, maps: Column, n_states: int, name: str = "state") -> DataFrame:
    """Add the state in which each row is met (``name``, 0 at the first row of its key).

    ``maps`` gives a row's map: an array with the state after it for each state
    before it. ``bucket`` must rise with ``order``, which tells rows of a key
    apart; a block's rows (a bucket's) are held together, a key's never.
    """
    cut = df.select(F.struct("*").alias("_row"), *keys, bucket.alias("_b"), F.col(order).alias("_o"), maps.cast("array<int>").alias("_m"))
    blocks = cut.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(F.struct("_o", "_m", "_row"))).alias("_rows"))  # one block
    ends = blocks.select(*keys, "_b", composed(F.col("_rows._m"), n_states).alias("_m"))
    line = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_b", "_m"))).alias("_all"))  # a small row for each block
    enters = line.select(*keys, F.explode(F.arrays_zip(F.col("_all._b").alias("_b"), entered(F.col("_all._m")).alias("_e"))).alias("_x")).select(*keys, "_x._b", "_x._e")
    placed = same_block(blocks, enters, [*keys, "_b"])
    each = placed.select(F.explode(F.arrays_zip(F.col("_rows._row").alias("_row"), entered(F.col("_rows._m"), F.col("_e")).alias("_s"))).alias("_x"))
    return each.select("_x._row.*", F.col("_x._s").alias(name))


def filled(df: DataFrame, keys: list[str], bucket: Column, order: str, value: str, name: str) -> DataFrame:
    """Add the last ``value`` that isn't null at or before each row of its key (``name``); a block's rows meet in one task, a key's never."""
    cut = df.withColumn("_b", bucket)
    ends = cut.groupBy(*keys, "_b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_b", F.last("_end", ignorenulls=True).over(before).alias("_ahead"))
    near = cut.withColumn("_near", F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, "_b").orderBy(order)))
    return same_block(near, ends, [*keys, "_b"]).withColumn(name, F.coalesce("_near", "_ahead")).drop("_b", "_near", "_ahead")
