"""N-gram Jaccard join: which documents share three quarters of their word shingles.

Method: a token-group matrix. Similar documents form groups; a group keeps the
union of its members' tokens; the overlap of a query with that union bounds its
similarity to every member, and only groups whose bound reaches the threshold
are opened. Three exact reductions come first, as a link needs shared tokens:

1. Documents with equal sets are one class, its smallest doc_id stands for it.
2. Documents with too few tokens that occur elsewhere can have no link.
3. Links to group leaders (verified) make provisional components; a query need
   not open groups of its own component, so a large group of near copies costs
   about as many comparisons as it has members, not their square.

The result is exact: the components of all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import graph, repeats, store, workers

SHINGLE = 5
#: Two documents link when SHARE[1] * intersection >= SHARE[0] * union.
SHARE = (75, 100)
#: Sizes after which the rounding of a prefix's length starts over.
PERIOD = SHARE[1] // math.gcd(*SHARE)
#: Members of a group, and tokens of their sets, about: a group has as many of either as leave the other below.
MEMBERS, TOKENS = 64, 60_000
#: Rows of an Arrow batch between the JVM and Python: token sets and unions are held on both sides, outside the heap.
BATCH = 200


def shingles(raw: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; ASCII capitals are lowered.

    With fewer than SHINGLE words the whole sequence is one shingle; without words there is none.
    """
    words = (raw or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = repeats.word_hashes(words)
    if len(w) < SHINGLE:
        return repeats.gram_hashes(w, len(w)) ^ np.uint64(len(w))
    return np.unique(repeats.gram_hashes(w, SHINGLE))


def most_missing(n: int) -> int:
    """Tokens of a set of n that a linked set may lack."""
    return n * (SHARE[1] - SHARE[0]) // SHARE[1]


def half_universe(raw: bytes | None) -> repeats.Found:
    """Every other token (those with even hashes): half the traffic, nearly all of the pruning."""
    t = shingles(raw)
    keys = t[(t & np.uint64(1)) == 0]
    return repeats.Found(len(t), len(keys), xxhash.xxh3_128_digest(t.tobytes()), keys, keys)


def whole_universe(raw: bytes) -> repeats.Found:
    """All tokens of a stored set."""
    t = np.frombuffer(raw, dtype="<u8")
    return repeats.Found(len(t), len(t), xxhash.xxh3_128_digest(raw), t, t)


def able(found: DataFrame) -> DataFrame:
    """The doc_ids that may have a link: at most a quarter of their tokens occur nowhere else.

    Of the copies in a chunk only the first one read has hits; they count for the smallest doc_id of the copies too.
    """
    shared = repeats.hits(found).groupBy("doc_id").agg(F.sum("hits").alias("hits"))
    missing = F.floor(F.col("n") * (SHARE[1] - SHARE[0]) / SHARE[1])
    each = repeats.info(found).where("n > 0").join(shared, "doc_id", "left").select("doc_id", "n", "size", "identity", F.coalesce("hits", F.lit(0)).alias("hits"))
    copies = each.groupBy("identity", "n", "size").agg(F.min("doc_id").alias("doc_id"), F.max("hits").alias("hits"))
    return each.unionByName(copies.select(*each.columns)).where(F.col("size") - F.col("hits") <= missing).select("doc_id").distinct()


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The stored token sets (doc_id, n, tokens: sorted 64-bit) of the documents in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shingles(raw) for raw in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in got], pa.int64()), pa.array([t.tobytes() for t in got], pa.binary())], ["doc_id", "n", "tokens"])

    picked = store.join_small(docs.select("doc_id", "text"), ids, "doc_id", "inner")
    return store.table(picked.mapInArrow(workers.tidy(run), "doc_id bigint, n bigint, tokens binary").distinct(), "sets")


def prefixes(sets: DataFrame) -> DataFrame:
    """(token, doc_id, n, at: its place from 0) for the rarest tokens of each set: two linked sets share at least one of them.

    A token's rarity is the number of sets that hold it, ties by its hash. Of n
    tokens the first n / 4 + 1 count; those that no other set holds come first
    and are left out, as nothing can meet them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.frombuffer(raw, dtype="<i8") for raw in b.column("tokens").to_pylist()]
            at = np.repeat(np.arange(len(got)), [len(t) for t in got])
            same = b.select(["doc_id", "n", "sid"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got) if got else [], pa.int64()), *same.columns], ["token", "doc_id", "n", "sid"])

    each = sets.select("doc_id", "n", "tokens", F.xxhash64("tokens").alias("sid")).mapInArrow(workers.tidy(run), "token bigint, doc_id bigint, n bigint, sid bigint")
    held = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    met = each.join(held, "token").groupBy("doc_id", "n", "sid").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("met"))  # one set
    take = F.floor(F.col("n") * (SHARE[1] - SHARE[0]) / SHARE[1]) + 1 - (F.col("n") - F.size("met"))
    first = met.where(take > 0).select(F.posexplode(F.slice("met", F.lit(1), take.cast("int"))).alias("i", "m"), "doc_id", "n", (F.col("n") - F.size("met")).alias("alone"))
    return first.select("m.token", "doc_id", "n", (F.col("alone") + F.col("i")).alias("at"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    near = SHARE[1] * F.least("na", "nb") >= SHARE[0] * F.greatest("na", "nb")
    both = pairs.join(left, "a").join(right, "b").where(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [i for i, (x, y) in enumerate(zip(b.column("ta").to_pylist(), b.column("tb").to_pylist())) if linked(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8"))]
            yield b.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return both.select("a", "b", "ta", "tb").mapInArrow(workers.tidy(run), "a bigint, b bigint")


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    n = shared(x, y)
    return SHARE[1] * n >= SHARE[0] * (len(x) + len(y) - n)


def leader_pairs(tokens: DataFrame, rounds: int = 3) -> DataFrame:
    """Distinct pairs of a document and a leader of one of its tokens; leaders are least by ``rounds`` orders."""
    leads = [F.min(F.struct((F.xxhash64("doc_id", F.lit(r)) if r else F.col("doc_id")).alias("k"), F.col("doc_id").alias("d"), "n")).alias(f"l{r}") for r in range(rounds)]
    led = store.table(tokens.groupBy("token").agg(F.count("*").alias("n"), *leads).where("n > 1").drop("n"), "leaders")
    each = tokens.join(led, "token").select("doc_id", "n", F.explode(F.array_distinct(F.array(*[F.struct(f"l{r}.d", f"l{r}.n") for r in range(rounds)]))).alias("l"))
    near = SHARE[1] * F.least("n", "l.n") >= SHARE[0] * F.greatest("n", "l.n")
    return each.where(near).select("doc_id", F.col("l.d").alias("b")).where("doc_id <> b").select(F.greatest("doc_id", "b").alias("a"), F.least("doc_id", "b").alias("b")).distinct()


def enough(c, n, lo, hi):
    """Whether c shared prefix tokens allow a link of a set of n tokens to one of a group with lo to hi.

    Of two sets with m and n tokens one has its whole prefix before any other
    shared token, so they share at most c and what follows the longer rest;
    they must share 75 (m + n) / 175. Of the sizes that can link, the difference is
    least at the first one or, as rounding lets it rise by one between them, at
    one of the last PERIOD.
    """
    rest = lambda m: m - F.floor(m * (SHARE[1] - SHARE[0]) / SHARE[1]) - 1
    need = lambda m: F.ceil(SHARE[0] * (m + n) / (SHARE[0] + SHARE[1])) - F.greatest(rest(n), rest(m))
    first, last = F.greatest(lo, F.ceil(n * SHARE[0] / SHARE[1])), F.least(hi, F.floor(n * SHARE[1] / SHARE[0]))
    return (first <= last) & (c >= F.least(need(first), *[need(F.greatest(first, last - i)) for i in range(PERIOD)]))


def roughly(c, n, lo, hi):
    """What must hold for ``enough``, in few operations: that rule is too long for the JVM to compile where every pair meets it.

    Without rounding the need is a line in the other size up to n and another one beyond, so it is least at lo or hi.
    """
    x, y = SHARE
    need = lambda m: x * (y * (m + n) - (x + y) * F.greatest(m, n))
    return c * (y * (x + y)) >= F.least(need(lo), need(hi))


def group_unions(sets: DataFrame, members: DataFrame) -> DataFrame:
    """The union of the tokens of each group (comp, sub), about MEMBERS documents of one component."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            union = [np.unique(np.concatenate([np.frombuffer(x, dtype="<u8") for x in xs])).tobytes() for xs in b.column("all").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("comp"), b.column("sub"), pa.array(union, pa.binary())], ["comp", "sub", "union"])

    lists = sets.select("doc_id", "tokens").join(members, "doc_id").groupBy("comp", "sub").agg(F.collect_list("tokens").alias("all"))  # about MEMBERS sets
    return lists.mapInArrow(workers.tidy(unite), "comp bigint, sub int, union binary")


def opened(candidates: DataFrame, sets: DataFrame, members: DataFrame, unions: DataFrame) -> DataFrame:
    """The links (a, b) of candidates (doc_id, comp, sub): groups whose bound holds are opened and their members compared."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for i, (x, u) in enumerate(zip(b.column("tokens").to_pylist(), b.column("union").to_pylist())):
                t = np.frombuffer(x, dtype="<u8")
                if len(t) - shared(t, np.frombuffer(u, dtype="<u8")) <= most_missing(len(t)):
                    good.append(i)
            yield b.select(["doc_id", "comp", "sub"]).take(pa.array(good, pa.int64()))

    met = candidates.join(sets.select("doc_id", "tokens"), "doc_id").join(unions, ["comp", "sub"])
    qualified = store.table(met.select("doc_id", "comp", "sub", "tokens", "union").mapInArrow(workers.tidy(bound), "doc_id bigint, comp bigint, sub int"), "qualified")
    pairs = qualified.withColumnRenamed("doc_id", "a").join(members.withColumnRenamed("doc_id", "b"), ["comp", "sub"]).select("a", "b")
    return verified(pairs, sets)


def room(n, at):
    """The size of the largest set that one of n tokens can link to, if the first token they share is at place ``at``: all they share is from there on."""
    x, y = SHARE
    return F.floor(((x + y) * (n - at) - x * n) / x)


def meeting(tokens: DataFrame, members: DataFrame) -> DataFrame:
    """The distinct pairs (doc_id, comp, sub) of a document and a group of a later component that meet at a token which can be the first they share.

    From that token on each side must hold what they have to share. In a family of texts that are alike, but not enough,
    changed tokens come first and leave no room at those of the whole family, so its members don't meet there.
    """
    placed = tokens.withColumn("room", room(F.col("n"), F.col("at"))).join(members.drop("n"), "doc_id")
    fit = placed.groupBy("token").agg(F.min("n").alias("least"), F.max("room").alias("most"))
    fitting = store.table(placed.join(fit, "token").where("least <= room and n <= most").drop("least", "most"), "fitting")
    mixed = fitting.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    open_tokens = store.table(fitting.join(mixed, "token", "left_semi"), "open")
    matrix = open_tokens.groupBy("token", F.col("comp").alias("g_comp"), F.col("sub").alias("g_sub")).agg(F.min("n").alias("g_lo"), F.max("room").alias("g_room"))
    met = open_tokens.join(matrix, "token").where((F.col("comp") < F.col("g_comp")) & (F.col("g_lo") <= F.col("room")) & (F.col("n") <= F.col("g_room")))
    return met.select("doc_id", F.col("g_comp").alias("comp"), F.col("g_sub").alias("sub")).distinct()


def candidates(tokens: DataFrame, members: DataFrame) -> DataFrame:
    """The groups of other components that a document may have a link into, (doc_id, comp, sub), by the matrix of prefix tokens and groups.

    What all shared prefix tokens allow is counted for the pairs that met only. Tokens without ``at`` count as first.
    """
    tokens = tokens if "at" in tokens.columns else tokens.withColumn("at", F.lit(0))
    return allowed(store.table(meeting(tokens, members), "met"), tokens, members)


def allowed(pairs: DataFrame, tokens: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (doc_id, comp, sub) of a document and a group whose shared prefix tokens allow a link."""
    own = tokens.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.first("n").alias("n"), F.collect_set("token").alias("own"))  # one set
    groups = members.join(pairs.select("comp", "sub").distinct(), ["comp", "sub"], "left_semi")
    sizes = groups.groupBy("comp", "sub").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    held = tokens.drop("n").join(groups, "doc_id").groupBy("comp", "sub").agg(F.collect_set("token").alias("held"))  # about MEMBERS sets
    both = pairs.join(own, "doc_id").join(sizes, ["comp", "sub"]).join(held, ["comp", "sub"])
    near = (SHARE[1] * F.col("n") >= SHARE[0] * F.col("lo")) & (SHARE[1] * F.col("hi") >= SHARE[0] * F.col("n"))
    counted = both.where(near).select("doc_id", "comp", "sub", "n", "lo", "hi", F.size(F.array_intersect("own", "held")).alias("c"))
    counted = store.table(counted.where(roughly(*map(F.col, ("c", "n", "lo", "hi")))), "counted")
    return counted.where(enough(F.col("c"), F.col("n"), F.col("lo"), F.col("hi"))).select("doc_id", "comp", "sub")


def join(docs: DataFrame) -> DataFrame:
    """Shingle-set size and component of every document (doc_id, text): doc_id, n_shingles, component_id.

    A null or empty text has no shingles and is linked with nothing. A doc_id
    identifies a document: rows that share one are tied together, each giving a
    row; a null doc_id gives a row without component. Equal texts are one class,
    and of equals the smallest doc_id names the component. Ids are whole numbers
    (any integer type, returned as bigint). Very long texts are read whole. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    with store.batches_of(docs.sparkSession, BATCH):
        return joined(docs)


def joined(docs: DataFrame) -> DataFrame:
    """The rows of ``join``."""
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = repeats.find(docs, "text", half_universe, "shingles", with_refs=False)
    info = repeats.info(found)
    classes = store.table(info.where("n > 0").groupBy("identity").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    chosen = able(found).join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = sets_of(docs, store.table(chosen, "able"))
    again = repeats.find(sets, "tokens", whole_universe, "tokens", with_refs=False)
    fewer = store.table(able(again), "able")
    sets = store.table(store.join_small(sets, fewer, "doc_id", "inner"), "sets")
    tokens = store.table(prefixes(sets), "prefixes")
    store.release(spark)

    edges = store.table(verified(leader_pairs(tokens), sets), "links")
    known = graph.components(edges)
    place = store.table(sets.select("doc_id", "n").join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n", F.coalesce("comp", "doc_id").alias("comp")), "places")
    store.release(spark)
    sizes = place.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("n") / TOKENS)).alias("groups"))
    parted = place.join(sizes, "comp").select("doc_id", "n", "comp", F.pmod(F.xxhash64("doc_id"), "groups").cast("int").alias("sub"))
    members = store.table(parted, "members")

    met = store.table(candidates(tokens, members), "candidates")
    members = members.drop("n").distinct()
    unions = group_unions(sets, members.join(met.select("comp", "sub").distinct(), ["comp", "sub"], "left_semi"))
    more = store.table(opened(met, sets, members, unions), "links")
    store.release(spark)
    final = graph.components(edges.unionByName(more))

    named = final.withColumnRenamed("node", "rep").withColumnRenamed("comp", "component_id")
    labelled = store.table(classes.join(named, "rep", "left").select("identity", F.coalesce("component_id", "rep").alias("component_id"), "copies"), "labelled")
    out = info.join(labelled, "identity", "left")
    rows = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("bigint").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"))
    return rows.unionByName(nameless)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id; documents without words or without a doc_id all stay.

    Columns stay as they are, whatever their names. Equal rows that share a doc_id are one document, so one of them stays.
    """
    stays = F.coalesce((F.col("component_id") == F.col("doc_id")) | (F.col("n_shingles") == 0), F.lit(False))
    each = join(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max(stays).alias("stays"), F.count("*").alias("rows"))
    each = store.table(each.where("rows > 1 or not stays"), "doubtful")  # fewer than those that stay, so that texts seldom need a shuffle
    own = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    kept = store.join_small(docs, each.select("doc_id"), "doc_id", "left_anti").select(*own)
    again = store.table(each.where("stays").select("doc_id"), "again")
    return kept.unionByName(store.join_small(docs, again, "doc_id", "left_semi").select(*own).dropDuplicates(["doc_id", "text"]))


#: The same in DuckDB's SQL.
ORACLE = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i+4], ' ') end as g
      from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
x as (select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from x join n p on p.doc_id = a join n q on q.doc_id = b where 100 * m >= 75 * (p.n + q.n - m)),
u as (select a, b from l union all select b, a from l),
r(node, comp) as (select doc_id, doc_id from d union select u.b, r.comp from r join u on u.a = r.node where r.comp < u.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.comp) as component_id
from d left join n on d.doc_id = n.doc_id join r on r.node = d.doc_id group by all
"""
