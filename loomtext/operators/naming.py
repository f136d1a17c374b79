"""Names that don't collide, given in order, by rounds over all names at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators import frames

#: Fixed value: the longest name.
LONGEST = 60


def suffixed(base: Column, n: Column, longest: int = LONGEST) -> Column:
    """The n-th name of a base: itself, then ``_2``, ``_3``; the base is cut to make room."""
    mark = F.concat(F.lit("_"), n.cast("string"))
    return F.when(n == 1, base).otherwise(F.concat(F.left(base, F.lit(longest) - F.length(mark)), mark))


def unique_names(df: DataFrame, base: str, order: str, bucket: Column, name: str = "name", longest: int = LONGEST) -> DataFrame:
    """Add ``name``: rows take names in order, each the first of its base's names (``suffixed``) that no row before it took.

    All rows ask at once; a name goes to the first row that asks, and a row that
    is refused asks for its next one, in rounds until nobody is refused. That gives
    the names of the one-by-one way, as a refusal is never taken back. Of one base
    a later row always comes after an earlier one, so rows begin at their own
    number, and what is refused pushes the later rows on in the same round: rounds
    grow with the depth of a cascade, not with the rows. ``bucket`` must rise with
    ``order``, which tells rows apart.
    """
    asked = frames.numbered(df.withColumn("_base", F.col(base)), bucket, [F.col(order)], name="_rank", keys=("_base",)).withColumn("_at", F.col("_rank") + 1).drop("total")
    while True:
        asked = frames.cut(asked.withColumn(name, suffixed(F.col("_base"), F.col("_at"), longest)))
        holders = asked.groupBy(name).agg(F.min(order).alias("_first"))
        refused = asked.join(holders, name).withColumn("_no", F.col(order) > F.col("_first")).drop("_first")
        if not refused.agg(F.max("_no")).first()[0]:
            return asked.drop("_base", "_at", "_rank")
        pushed = refused.withColumn("_over", F.col("_at") + F.col("_no").cast("long") - F.col("_rank"))
        pushed = frames.running_max(pushed, ["_base"], bucket, order, "_over", "_most")
        asked = pushed.withColumn("_at", F.col("_rank") + F.col("_most")).drop("_no", "_over", "_most")
