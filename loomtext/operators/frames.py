"""DataFrame operators. Order is data here: every order-dependent operator takes explicit order columns."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A side known to be this small is broadcast; otherwise Spark decides by its size.
SMALL_ROWS = 100_000


#: Ids of one block, where rows of a hot key are put in order block by block.
BLOCK_IDS = 1 << 20


def id_block(ident: Column) -> Column:
    """Blocks of consecutive ids; they rise with the id."""
    return F.floor(ident / BLOCK_IDS)


def shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where that is unset and one machine runs all."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="loomtext-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` from here on, its lineage cut with a checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` from here on, worked out once into a table in the folder of ``cut``, which goes when the driver's program ends."""
    spark = df.sparkSession
    path = f"{shared(spark).rstrip('/')}/loomtext-{uuid.uuid4().hex}"
    atexit.register(removed, spark, path)
    df.write.parquet(path)
    let_go(spark)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished work, which it does when the driver's JVM collects garbage; those of the very last job may need another call."""
    gc.collect()
    spark._jvm.System.gc()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a path by Spark's own file system; a session that has ended is no error."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the gateway may be gone at exit
        pass


def same_block(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Join by equal columns, nulls among them; the columns of ``df`` and the others of ``small``."""
    small = small.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], *[c for c in small.columns if c not in on])
    equal = [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)]
    return df.join(small, equal, "left").drop(*[f"_on{i}" for i in range(len(on))])


def numbered(df: DataFrame, bucket: Column, order: list[Column], name: str = "pos", keys: tuple = (), inner: Column | None = None) -> DataFrame:
    """Add the position from 0 (``name``) and the row count (``total``) of each key, of all rows without keys; no task sees all rows of a key.

    ``bucket`` must rise with the order, and ``inner``, if given, within a bucket:
    rows are numbered within their block, and the counts of earlier blocks, one
    row each, are added. Rows of a null key or bucket count too, a null bucket first.
    """
    cut = df.withColumn("_b", bucket).withColumn("_c", F.lit(0) if inner is None else inner)
    blocks = cut.groupBy(*keys, "_b", "_c").agg(F.count("*").alias("_n"))
    buckets = blocks.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m"))
    ahead = buckets.withColumn("_ahead", F.sum("_m").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_m")).withColumn("total", F.sum("_m").over(Window.partitionBy(*keys))).drop("_m")
    within = blocks.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_c")) - F.col("_n")).drop("_n")
    before = same_block(within, ahead, [*keys, "_b"])
    ranked = cut.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_b", "_c").orderBy(*order)))
    return same_block(ranked, before, [*keys, "_b", "_c"]).withColumn(name, F.col("_ahead") + F.col("_before") + F.col("_i") - 1).drop("_b", "_c", "_i", "_before", "_ahead")


def previous(df: DataFrame, keys: list[str], bucket: Column, order: str, value: str, name: str) -> DataFrame:
    """Add the ``value`` of the row before in its key (``name``), null at the first; no task sees all rows of a key.

    ``bucket`` must rise with the order: the first row of a block takes the last value of the block before.
    """
    cut = df.withColumn("_b", bucket)
    boxed = F.struct(F.col(value).alias("v"))
    ends = cut.groupBy(*keys, "_b").agg(F.max_by(boxed, F.struct(order)).alias("_end"))
    ends = ends.select(*keys, "_b", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_b")).alias("_ahead"))
    near = cut.withColumn("_near", F.lag(boxed).over(Window.partitionBy(*keys, "_b").orderBy(order)))
    return same_block(near, ends, [*keys, "_b"]).withColumn(name, F.coalesce("_near", "_ahead")["v"]).drop("_b", "_near", "_ahead")


def running_sum(df: DataFrame, keys: list[str], bucket: Column, order: str, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` up to each row and its ties (``name``) and of its whole key (``total``); no task sees all rows of a key.

    ``bucket`` must rise with the order: sums within a block and those of the blocks before, one row each, are added. A null value counts as 0.
    """
    cut = df.withColumn("_b", bucket)
    size = F.coalesce(F.col(value), F.lit(0))
    sums = cut.groupBy(*keys, "_b").agg(F.sum(size).alias("_m"))
    sums = sums.select(*keys, "_b", (F.sum("_m").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_m")).alias("_ahead"), F.sum("_m").over(Window.partitionBy(*keys)).alias("total"))
    inside = cut.withColumn("_in", F.sum(size).over(Window.partitionBy(*keys, "_b").orderBy(order)))
    return same_block(inside, sums, [*keys, "_b"]).withColumn(name, F.col("_ahead") + F.col("_in")).drop("_b", "_in", "_ahead")


def running_max(df: DataFrame, keys: list[str], bucket: Column, order: str, value: str, name: str) -> DataFrame:
    """Add the greatest ``value`` up to each row and its ties (``name``); no task sees all rows of a key, and ``bucket`` must rise with the order."""
    cut = df.withColumn("_b", bucket)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    most = cut.groupBy(*keys, "_b").agg(F.max(value).alias("_m")).select(*keys, "_b", F.max("_m").over(before).alias("_ahead"))
    inside = cut.withColumn("_in", F.max(value).over(Window.partitionBy(*keys, "_b").orderBy(order)))
    return same_block(inside, most, [*keys, "_b"]).withColumn(name, F.greatest("_ahead", "_in")).drop("_b", "_in", "_ahead")


def newest_days(orders: DataFrame) -> dict:
    """The blocks of orders by day, newest first, and within a day by key."""
    return {"bucket": -F.datediff(F.col("o_orderdate"), F.lit("1970-01-01")), "inner": -id_block(F.col("o_orderkey")), "order": [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]}


def newest_first(orders: DataFrame) -> DataFrame:
    """Orders as a feed: ``pos`` from 0, newest first, and ``total``."""
    return numbered(orders, **newest_days(orders))


def display_number(pos: Column, length_curr: Column, length_old: Column) -> Column:
    """Stable number of a list position; new head rows get 0 and less."""
    return pos - length_curr + length_old + 1


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Order-preserving distinct: the first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def best(df: DataFrame, keys: list[str], choice: str, *priority: Column) -> DataFrame:
    """For each key the ``choice`` of least priority; ties go by the choice itself."""
    return df.groupBy(*keys).agg(F.min_by(choice, F.struct(*[p.alias(f"k{i}") for i, p in enumerate(priority)], choice)).alias(choice))


def diff_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: key and ``change`` (added or removed)."""
    added = new.select(key).distinct().join(old.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    removed = old.select(key).distinct().join(new.select(key), key, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def override(base: DataFrame, hand: DataFrame, key: str) -> DataFrame:
    """Rows of ``hand`` replace those of ``base`` with the same key."""
    return base.join(hand.select(key), key, "left_anti").unionByName(hand, allowMissingColumns=True)


def close_ranges(df: DataFrame, keys: list[str], start: str, *order) -> DataFrame:
    """``end``: the next row's start, at the last row start + 1."""
    w = Window.partitionBy(*keys).orderBy(start, *order)
    return df.withColumn("end", F.coalesce(F.lead(start).over(w), F.col(start) + 1))


def gap_sessions(df: DataFrame, keys: list[str], at: Column, order: list, gap: float) -> DataFrame:
    """``session`` numbers from 1; a new one starts after a gap of at least ``gap``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("session", 1 + F.sum(F.when(at - F.lag(at).over(w) >= gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def interval_hit(points: DataFrame, intervals: DataFrame, keys: list[str], width: float, tol: float) -> DataFrame:
    """The longest interval (lo, hi) within ``tol`` of each point (pid, t): pid, longest (0 without one).

    Both sides are cut into buckets of ``width``, so that the join is by equality; an
    interval goes into every bucket it touches.
    """
    cut = lambda c: F.floor(c / width).cast("long")
    spread = intervals.withColumn("_b", F.explode(F.sequence(cut(F.col("lo") - tol), cut(F.col("hi") + tol))))
    met = points.withColumn("_b", cut(F.col("t"))).join(spread, [*keys, "_b"])
    met = met.where((F.col("lo") - tol <= F.col("t")) & (F.col("t") <= F.col("hi") + tol))
    longest = met.groupBy("pid").agg(F.max(F.col("hi") - F.col("lo")).alias("longest"))
    return points.select("pid").join(longest, "pid", "left").select("pid", F.coalesce("longest", F.lit(0.0)).alias("longest"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The row of ``right`` (rid, t) nearest to each of ``left`` (lid, t) by key, the earlier one on ties, then the smaller id.

    One sort of both sides: the last and next right row around each left row.
    """
    both = left.select(*keys, "t", "lid", F.lit(None).cast("long").alias("rid")).unionByName(right.select(*keys, "t", F.lit(None).cast("long").alias("lid"), "rid"))
    w = Window.partitionBy(*keys).orderBy("t", F.col("lid").isNotNull(), F.desc("rid"))
    back = Window.partitionBy(*keys).orderBy(F.desc("t"), F.col("lid").isNotNull(), F.desc("rid"))
    point = F.when(F.col("rid").isNotNull(), F.struct("t", "rid"))
    near = both.withColumn("a", F.last(point, ignorenulls=True).over(w)).withColumn("z", F.last(point, ignorenulls=True).over(back)).where("lid is not null")
    da, dz = F.col("t") - F.col("a.t"), F.col("z.t") - F.col("t")
    closer = F.col("z").isNull() | (da <= dz)
    return near.select("lid", F.when(closer, F.col("a.rid")).otherwise(F.col("z.rid")).alias("rid"), F.when(closer, da).otherwise(dz).alias("gap"))


def backward_asof(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The last ``value`` of ``right`` (t) at or before each row of ``left`` (lid, t)."""
    both = left.select(*keys, "t", "lid", F.lit(None).cast(dict(right.dtypes)[value]).alias(value), F.lit(1).alias("side"))
    both = both.unionByName(right.select(*keys, "t", F.lit(None).cast("long").alias("lid"), value, F.lit(0).alias("side")))
    w = Window.partitionBy(*keys).orderBy("t", "side", value)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("side = 1").select("lid", value)


def ordered_text(df: DataFrame, keys: list[str], order: str, text: str, separator: str = " ") -> DataFrame:
    """Texts of a key joined in order."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return df.groupBy(*keys).agg(F.array_join(pieces, separator).alias(text))


def lines(docs: DataFrame) -> DataFrame:
    """Documents as numbered lines: doc_id, lang, source, line_no from 0, line."""
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def exploded_words(docs: DataFrame, words: Column) -> DataFrame:
    return docs.select("*", F.explode(words).alias("word"))


def top(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def keyed_replace(blocks: DataFrame, fresh: DataFrame, key: list[str], order: str, text: str) -> DataFrame:
    """The first block of a key takes its new text, its other blocks go, order stays; unknown keys change nothing."""
    new = fresh.select(*key, F.col(text).alias("_new"))
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    joined = blocks.withColumn("_r", first).join(new, key, "left").where("_new is null or _r = 1")
    return joined.withColumn(text, F.coalesce("_new", text)).drop("_r", "_new")


def longest_run(df: DataFrame, keys: list[str], order: list, flag: Column) -> DataFrame:
    """The longest run of consecutive rows with ``flag``, 0 where none has it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    islands = df.withColumn("_f", flag).withColumn("_i", F.row_number().over(w) - F.sum(F.when(F.col("_f"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    counts = islands.groupBy(*keys, "_i").agg(F.sum(F.when(F.col("_f"), 1).otherwise(0)).alias("n"))
    return counts.groupBy(*keys).agg(F.max("n").alias("longest"))
