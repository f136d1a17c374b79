"""Mixing sources to target weights along a time-varying curriculum.

Method: each source has a weight schedule over training time 0..1. Its integral
gives the cumulative token demand; inverting that at the place of each use of a
document in its source's queue, passes one after the other, gives the training
position of the use, and rows are range-sorted by position. DataFrame functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm import store, text

#: The weights dealt to sources in turn, and the most that a target may be of its source's size.
WEIGHTS = (1, 2, 3)
MOST = 3
#: Rows that a running sum within a source takes in one task, about.
ROWS = 50_000


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): shares of all sizes by weight, at most ``most`` sizes each.

    Excess over the cap is shared again by weight. In order of cap by weight the
    sources up to some place are capped; the level of the others is what these
    leave by the weights left. Running sums by blocks give every place's level.
    """
    cap = F.col("source_size") * most
    blocks = store.ordered_blocks(sizes.withColumns({"cap": cap, "ratio": cap / F.col("weight")}), ["ratio", "source"], "caps")
    total, weights = blocks.agg(F.sum("source_size"), F.sum("weight")).first()
    per = store.table(blocks.groupBy("blk").agg(F.sum("cap").alias("c"), F.sum("weight").alias("w")), "blocks")  # a row for each block
    upto = Window.orderBy("blk")
    before = store.table(per.select("blk", (F.sum("c").over(upto) - F.col("c")).alias("c0"), (F.sum("w").over(upto) - F.col("w")).alias("w0")), "before")
    inner = Window.partitionBy("blk").orderBy("ratio", F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c: F.coalesce(F.sum(c).over(inner), F.lit(0))
    run = store.join_small(blocks.withColumns({"c1": ahead("cap"), "w1": ahead("weight")}), before, "blk")
    level = (F.lit(total or 0) - F.col("c0") - F.col("c1")) / (F.lit(weights or 1) - F.col("w0") - F.col("w1"))
    found = run.withColumn("level", level).where(F.col("weight") * F.col("level") < F.col("cap")).agg(F.min_by("level", F.struct("ratio", "level"))).first()[0]
    return blocks.select("source", "source_size", "weight", "rank", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(found or 0.0))).alias("target"))


def ranked(names: DataFrame) -> DataFrame:
    """Number the sources from 0 by code point, null last, block by block."""
    blocks = store.ordered_blocks(names, [F.col("source").asc_nulls_last()], "sources")
    per = store.table(blocks.groupBy("blk").agg(F.count("*").alias("n")), "blocks")  # a row for each block
    before = per.select("blk", (F.sum("n").over(Window.orderBy("blk")) - F.col("n")).alias("before"))
    inner = blocks.withColumn("at", F.row_number().over(Window.partitionBy("blk").orderBy(F.col("source").asc_nulls_last())))
    return store.join_small(inner, store.table(before, "before"), "blk").withColumn("rank", F.col("before") + F.col("at") - 1).drop("blk", "before", "at")


def position(share: Column, start: Column, end: Column) -> Column:
    """Time at which a source has spent ``share`` of its demand, if its weight runs linearly from ``start`` to ``end``.

    The integral is start*t + (end-start)*t*t/2, over its value at 1; this is its inverse.
    """
    half = (start + end) / 2
    root = F.sqrt(start * start + 2 * (end - start) * share * half)
    return F.when(F.abs(end - start) < 1e-12, share).otherwise((root - start) / (end - start))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, schedule=None) -> DataFrame:
    """How much of each document the mix takes, and where in training.

    Takes doc_id, text, source; returns doc_id, source, size (words), source_size,
    target (the source's), taken (words, repeats counted), passes and extra (whole
    uses, and words of a last one) and positions (0..1, of all its uses, at the
    middle of each). A source passes whole through its queue as often as its
    target holds its size; the last pass stops at the target, inside a document
    if need be. Queues run in the order of the md5 of doc_id, so reruns agree
    whatever the partitioning. ``schedule(rank)`` gives the start and end weight
    of a source's linear schedule; by default even ranks fall and odd ranks rise.

    Null texts have size 0; documents without words have no use. A null source is
    a source of its own, the last; a null doc_id is queued by its text; repeated
    rows are documents of their own, tied rows being alike; a source of size 0
    has target 0. Very long texts are counted whole and cut only where the target
    ends. Other columns are ignored, whatever their names; an empty table gives
    an empty result.
    """
    n = store.partitions(docs.sparkSession)
    rows = store.table(docs.select("doc_id", "source", text.count_words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\x01"), "text"), F.lit(""))).alias("key")), "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = ranked(by_source).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    goals = store.table(targets(dealt, most), "targets").withColumnRenamed("source", "_s")

    # Queues are cut by the leading digits of the key; that splits a source of any share evenly and keeps the order.
    digits, width = 1, rows.count() // (ROWS * 16)
    while width > 0 and digits < 8:
        digits, width = digits + 1, width // 16
    cut = rows.withColumn("cut", F.substring("key", 1, digits))
    null_safe = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    sums = cut.groupBy("source", "cut").agg(F.sum("size").alias("n"))
    before = store.table(sums.select(F.col("source").alias("_b"), F.col("cut").alias("_cut"), (F.sum("n").over(Window.partitionBy("source").orderBy("cut")) - F.col("n")).alias("before")), "before")
    joined = store.join_small(store.join_small(cut, before, null_safe("source", "_b") & (F.col("cut") == F.col("_cut"))), goals, null_safe("source", "_s"))
    inner = F.sum("size").over(Window.partitionBy("source", "cut").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    start = F.col("before") + inner
    goal = F.least(F.round("target").cast("long"), F.col("source_size") * most)
    full = F.coalesce(F.floor(goal / F.nullif("source_size", F.lit(0))), F.lit(0))
    left = goal - full * F.col("source_size")
    first, last = schedule or (lambda rank: F.when(rank % 2 == 0, 1.5).otherwise(0.5), lambda rank: F.when(rank % 2 == 0, 0.5).otherwise(1.5))
    placed = joined.withColumn("start", start).withColumn("passes", full.cast("long")).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("start"))).cast("long"))
    share = lambda at: F.coalesce(F.least(at / F.nullif(goal, F.lit(0)), F.lit(1.0)), F.lit(1.0))
    when = lambda at: position(share(at), first(F.col("rank")), last(F.col("rank")))
    middle = lambda p: p * F.col("source_size") + F.col("start") + F.when(p < F.col("passes"), F.col("size")).otherwise(F.col("extra")) / 2
    n_uses = F.when(F.col("size") > 0, F.col("passes") + (F.col("extra") > 0).cast("int")).otherwise(0)
    positions = F.when(n_uses > 0, F.transform(F.sequence(F.lit(0).cast("long"), n_uses - 1), lambda p: when(middle(p)))).otherwise(F.array().cast("array<double>"))
    out = placed.withColumn("positions", positions)
    out = out.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("extra")).alias("taken"), "passes", "extra", "positions")
    return out.withColumn("_first", F.get("positions", F.lit(0))).repartitionByRange(n, "_first", "doc_id").sortWithinPartitions("_first", "doc_id").drop("_first")


def plan(docs: DataFrame) -> DataFrame:
    """``mix`` as a row of numbers for each document, in training order: doc_id, size, source_size, target, taken, uses, first_position, last_position."""
    at = lambda i: F.round(F.try_element_at("positions", F.lit(i)), 6)
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("uses"), at(1).alias("first_position"), at(-1).alias("last_position"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, range-sorted by the position of each use; the last use may end inside a document.

    Returns the columns of ``docs``, whatever their names; ``n_chars`` is counted
    anew. A cut copy is the prefix of the text that holds the words taken, white
    space kept. Documents without words are not taken. Repeated rows are matched
    to their places in the queue one by one; null ids and sources are matched too.
    """
    whole = lambda id_, src, size: [F.coalesce(id_.cast("string"), F.lit("")).alias("_k0"), id_.isNull().alias("_k1"), F.coalesce(src, F.lit("")).alias("_k2"), src.isNull().alias("_k3"), size.alias("_k4")]
    key = [f"_k{i}" for i in range(5)]
    tied = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(*order)).alias("_k5")  # noqa: E731  rows alike in id, source and size
    taken = F.concat(F.array_repeat(F.col("size"), F.col("passes").cast("int")), F.when(F.col("extra") > 0, F.array(F.col("extra"))).otherwise(F.array().cast("array<bigint>")))
    planned = mix(docs).where(F.size("positions") > 0).select(*whole(F.col("doc_id"), F.col("source"), F.col("size")), F.arrays_zip(taken.alias("take"), F.col("positions").alias("at")).alias("_uses"))
    planned = planned.select(*key, "_uses", tied([F.col("_uses")]))
    row = lambda c: F.col(f"_row.{c}")
    rows = docs.select(F.struct("*").alias("_row")).select("_row", *whole(row("doc_id"), row("source"), text.count_words(row("text"))))
    joined = rows.select("_row", *key, tied([F.xxhash64("_row.text")])).join(planned, [*key, "_k5"])
    placed = joined.select("_row", F.col("_k4").alias("_n"), F.explode("_uses").alias("_use")).select("_row", "_n", F.col("_use.take").alias("_take"), F.col("_use.at").alias("_at"))
    order = [F.col("_at"), row("doc_id"), F.col("_take")]
    each = placed.repartitionByRange(store.partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    pieces = F.regexp_extract_all(row("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("_take") < F.col("_n"), F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.lit(1), F.col("_take").cast("int"))), "")).otherwise(row("text"))
    each = each.select("_row", cut.alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return each.select(*[(new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


#: The same in DuckDB's SQL.
ORACLE = r"""
with r as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, chr(1) || text, '')) as key from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from r group by source),
o as (select *, sum(3 * source_size) over w - 3 * source_size as caps, sum(weight) over (order by 3.0 * source_size / weight desc, source asc nulls first rows unbounded preceding) as open_weight,
             sum(source_size) over () as total from s window w as (order by 3.0 * source_size / weight, source desc nulls last rows unbounded preceding)),
v as (select max((total - caps) / open_weight) filter (where weight * ((total - caps) / open_weight) < 3 * source_size) as level from o),
t as (select source, source_size, rank, least(3.0 * source_size, weight * level)::double as target from o, v),
q as (select r.doc_id, r.size, t.source_size, t.target, t.rank, least(round(t.target)::bigint, 3 * t.source_size)::bigint as goal,
             sum(r.size) over (partition by r.source order by r.key, r.doc_id, r.size rows unbounded preceding) - r.size as start
      from r join t on r.source is not distinct from t.source),
x as (select *, coalesce(goal // nullif(source_size, 0), 0) as passes, greatest(0, least(size, goal - coalesce(goal // nullif(source_size, 0), 0) * source_size - start)) as extra, case when rank % 2 = 0 then 1.5 else 0.5 end::double as a, case when rank % 2 = 0 then 0.5 else 1.5 end::double as b from q),
y as (select *, case when size > 0 then passes + (extra > 0)::int else 0 end as uses from x),
z as (select *, (start + case when passes > 0 then size else extra end / 2.0) as m0, ((uses - 1) * source_size + start + case when uses <= passes then size else extra end / 2.0) as m1 from y)
select doc_id, size, source_size::bigint as source_size, target, (passes * size + extra)::bigint as taken, uses::bigint as uses,
       case when uses > 0 then round((sqrt(a * a + 2 * (b - a) * least(m0 / goal, 1.0)) - a) / (b - a), 6) end as first_position,
       case when uses > 0 then round((sqrt(a * a + 2 * (b - a) * least(m1 / goal, 1.0)) - a) / (b - a), 6) end as last_position
from z
"""
