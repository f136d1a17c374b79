"""Exact top-k search by inner product, over KD-trees.

Method: rows are dealt to shards, and each shard becomes one stored KD-tree:
median splits of the widest side, tight boxes round every node. A query goes
through a tree best node first, by the largest inner product that a box allows
(for each component the better one of the box's two ends), and stops where no
box can reach its k-th best. That k-th best is propagated: a query first meets
one shard, its home, and takes what it found there along to all others, which
it meets in chains; along a chain the k-th best rises from tree to tree.

Queries travel in blocks, so a task holds one tree and one block at a time, and
nothing grows with the number of rows but the number of trees and blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm import store, vectors

#: Components become floor(SCALE * x).
SCALE = 1024
#: Rows of a shard, of a leaf, and queries of a block.
SHARD, LEAF, BLOCK = 16_384, 128, 512
#: Stands for a null id inside the trees: nulls come last among ties.
NO_ID = 2**63 - 1
TREE = "dims int, shard bigint, points binary, width int, ids binary, uids binary, boxes binary, nodes binary"


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """The usable vectors with their components as longs: uid (a number for each row), vec_id, dims, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("v")
            whole = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32), pa.array(vectors.scaled(vectors.flat(column), scale), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(column.value_lengths(), pa.int32()), whole], ["vec_id", "dims", "v"])

    some = embeddings.where(vectors.usable(F.col("embedding"))).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = some.mapInArrow(run, "vec_id bigint, dims int, v array<bigint>")
    return store.table(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")


def build(points: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A KD-tree of whole numbers: the order of the rows, boxes (nodes x 2 x dims) and nodes (first row, end, left child, right child, least id).

    The widest side of a node's box is split at its median row, so equal rows
    may lie on both sides. Children come after their parent; a leaf has none (-1).
    """
    order, boxes, nodes = np.arange(len(points)), [], []
    todo = [(0, len(points), -1, 0)]
    while todo:
        first, last, parent, side = todo.pop()
        rows = order[first:last]
        inside = points[rows]
        low, high = inside.min(axis=0), inside.max(axis=0)
        me = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = me
        boxes.append((low, high))
        nodes.append([first, last, -1, -1, ids[rows].min()])
        if last - first > LEAF and points.shape[1]:
            middle = (last - first) // 2
            order[first:last] = rows[np.argpartition(inside[:, int(np.argmax(high - low))], middle)]
            todo += [(first, first + middle, me, 0), (first + middle, last, me, 1)]
    return order, np.array(boxes), np.array(nodes, dtype=np.int64)


def trees(rows: DataFrame) -> DataFrame:
    """One stored KD-tree for each shard of ``rows`` (uid, vec_id, dims, shard, v)."""

    def plant(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        dims, shard = group["dims"][0].as_py(), group["shard"][0].as_py()
        points = vectors.flat(group["v"].combine_chunks()).reshape(group.num_rows, dims)
        ids = group["vec_id"].fill_null(NO_ID).to_numpy()
        order, boxes, nodes = build(points, ids)
        kept = vectors.narrow(points[order])
        raw = [kept.tobytes(), ids[order].astype("<i8").tobytes(), group["uid"].to_numpy()[order].astype("<i8").tobytes(), boxes.astype("<i8").tobytes(), nodes.astype("<i8").tobytes()]
        return pa.table([pa.array([dims], pa.int32()), pa.array([shard]), pa.array(raw[:1]), pa.array([kept.itemsize], pa.int32()), *[pa.array([x]) for x in raw[1:]]], names=["dims", "shard", "points", "width", "ids", "uids", "boxes", "nodes"])

    return store.table(rows.select("uid", "vec_id", "dims", "shard", "v").groupBy("dims", "shard").applyInArrow(plant, TREE), "trees")


class Tree:
    """A tree as its row of the table holds it."""

    def __init__(self, row: dict):
        d = row["dims"]
        self.ids, self.uids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["uids"], "<i8")
        self.points = np.frombuffer(row["points"], f"<i{row['width']}").reshape(len(self.ids), d)
        self.nodes = np.frombuffer(row["nodes"], "<i8").reshape(-1, 5)
        self.boxes = np.frombuffer(row["boxes"], "<i8").reshape(len(self.nodes), 2, d)


def better(a: tuple[int, int], b: tuple[int, int] | None) -> bool:
    """Whether (score, id) a comes before b: the higher score, then the smaller id."""
    return b is None or a[0] > b[0] or a[0] == b[0] and a[1] < b[1]


def search(tree: Tree, queries: np.ndarray, uids: np.ndarray, best: list[list[tuple[int, int]]], floor: list[tuple[int, int] | None], k: int) -> None:
    """Take each query through the tree: ``best`` (a heap of (score, -id) for each) gets what is better than its k-th and than its floor.

    Sums of products below 2**53 are exact as doubles; where they may be larger they are whole numbers of Python.
    """
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(tree.boxes).max(initial=0)) * queries.shape[1]
    kind = np.float64 if most < 2**53 else object
    asked, points, boxes = queries.astype(kind), tree.points.astype(kind), tree.boxes.astype(kind)
    bound = np.maximum(asked, 0) @ boxes[:, 1].T + np.minimum(asked, 0) @ boxes[:, 0].T
    nodes, ids = tree.nodes.tolist(), tree.ids
    for i, mine in enumerate(best):
        line, q, top, least = bound[i].tolist(), asked[i], mine, floor[i]
        if len(top) == k and better((top[0][0], -top[0][1]), least):
            least = top[0][0], -top[0][1]
        open_nodes = [(-line[0], 0)]
        while open_nodes:
            reach, at = heapq.heappop(open_nodes)
            if least is not None and -reach < least[0]:
                break
            first, last, left, right, lowest = nodes[at]
            if not better((-reach, lowest), least):
                continue
            if left >= 0:
                for child in (left, right):
                    if least is None or line[child] >= least[0]:
                        heapq.heappush(open_nodes, (-line[child], child))
                continue
            scores = points[first:last] @ q
            good = np.flatnonzero(tree.uids[first:last] != uids[i])
            if least is not None:
                good = good[scores[good] >= least[0]]
            if len(good) > k:
                good = good[np.lexsort((ids[first:last][good], -scores[good]))[:k]]
            for j in good.tolist():
                found = int(scores[j]), int(ids[first + j])
                if not better(found, least):
                    continue
                if len(top) < k:
                    heapq.heappush(top, (found[0], -found[1]))
                else:
                    heapq.heapreplace(top, (found[0], -found[1]))
                if len(top) == k and better((top[0][0], -top[0][1]), least):
                    least = top[0][0], -top[0][1]


FOUND = "uid bigint, query_id bigint, vec_id bigint, score bigint"


def searched(met: DataFrame, k: int) -> DataFrame:
    """The best rows (uid, query_id, vec_id, score) that each query finds in the trees its block meets.

    ``met`` has a row for each block and tree: what TREE has, block, and queries
    (uid, query_id, v, floor_score, floor_id). While a task sees one block the k-th best goes on from tree to tree.
    """

    def told(block: list[tuple[int, int]], best: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        rows = [(u, q, None if i == -NO_ID else -i, s) for (u, q), mine in zip(block, best) for s, i in mine]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([],) * 4)], ["uid", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, best = None, [], []
        for b in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            key = b.column("dims")[0].as_py(), b.column("block")[0].as_py()
            if key != now:
                if names:
                    yield told(names, best)
                asked = b.column("queries").flatten()
                uids = asked.field("uid").to_numpy()
                names = list(zip(uids.tolist(), asked.field("query_id").to_pylist()))
                points = vectors.flat(asked.field("v")).reshape(len(names), key[0])
                floor = [None if s is None else (s, NO_ID if i is None else i) for s, i in zip(asked.field("floor_score").to_pylist(), asked.field("floor_id").to_pylist())]
                now, best = key, [[] for _ in names]
            search(Tree({c: b.column(c)[0].as_py() for c in ("dims", "points", "width", "ids", "uids", "boxes", "nodes")}), points, uids, best, floor, k)
        if names:
            yield told(names, best)

    with store.batches_of(met.sparkSession, 1):
        return store.table(met.mapInArrow(run, FOUND), "found")


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The ``k`` rows of highest inner product with each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows of ``embeddings`` (vec_id, embedding) whose vec_id is
    divisible by ``every``, candidates all rows but the query's own; components
    are floor(scale * x), scores exact. Ties go to the smaller vec_id, a null one
    last. A vector that is null or holds a null or a number that isn't finite
    takes no part. Repeated rows are candidates of their own (and of each other),
    and a repeated query row has its list twice. Vectors of unequal length are
    not compared; empty ones score 0. Fewer candidates than k give fewer rows; an
    empty table gives none. Other columns are ignored, whatever their names.
    Scores must fit in a long.
    """
    spark = embeddings.sparkSession
    rows = whole_vectors(embeddings, scale)
    asks = F.col("vec_id") % every == 0
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n"), F.count_if(asks).alias("asked"))
    chains = store.partitions(spark)
    parts = sizes.select("dims", F.ceil(F.col("n") / shard).alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("asked") / block)).alias("blocks"))
    parts = store.table(parts.withColumn("chains", F.least(F.lit(chains), "shards")), "parts")  # a row for each length of vectors
    dealt = store.join_small(rows, parts, "dims", "inner").withColumn("shard", F.pmod(F.xxhash64("uid"), "shards"))
    planted = trees(dealt)

    own = F.pmod(F.xxhash64("uid", F.lit("block")), "blocks")
    asked = store.table(dealt.where(asks).select("dims", own.alias("block"), F.pmod(own, "shards").alias("home"), "chains", "uid", F.col("vec_id").alias("query_id"), "v"), "queries")

    def blocks(queries: DataFrame) -> DataFrame:
        each = F.struct("uid", "query_id", "v", "floor_score", "floor_id")
        return queries.groupBy("dims", "block", "home", "chains").agg(F.collect_list(each).alias("queries"))  # about ``block`` queries

    none = F.lit(None).cast("bigint")
    first = blocks(asked.withColumns({"floor_score": none, "floor_id": none}))
    at_home = searched(first.join(planted, (planted.dims == first.dims) & (planted.shard == first.home)).drop(first.dims), k)
    last = top(at_home, k).where(F.col("rank") == k).select("uid", F.col("score").alias("floor_score"), F.col("vec_id").alias("floor_id"))
    onward = blocks(asked.join(last, "uid", "left")).withColumn("chain", F.explode(F.sequence(F.lit(0), (F.col("chains") - 1).cast("int"))))
    chained = planted.join(store.join_small(planted.select("dims", "shard"), parts, "dims", "inner").select("dims", "shard", F.pmod("shard", "chains").cast("int").alias("chain")), ["dims", "shard"])
    away = searched(onward.join(chained, ["dims", "chain"]).where("shard <> home"), k)
    return top(at_home.unionByName(away), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same in DuckDB's SQL.
ORACLE = """
with v as (
  select row_number() over () as uid, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.uid, q.vec_id as query_id, c.vec_id, coalesce(cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint), 0) as score
      from v q join v c on q.vec_id % 100 = 0 and q.uid <> c.uid and len(q.v) = len(c.v))
select query_id, cast(row_number() over (partition by uid order by score desc, vec_id nulls last) as integer) as rank, vec_id, score
from s qualify rank <= 10
"""
