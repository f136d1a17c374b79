"""The training-data operators against plain versions, where copies, sizes and the order of reading are mixed."""

import hashlib
import math
import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import mixing, ngram_join, packing, store, substring_dedup


def oracle(rows, sql):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    return sorted(con.execute(sql).fetchall())


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_copies_read_out_of_order(spark):
    a = words(random.Random(1), 80)
    rows = [(5, " ".join(a)), (1, " ".join(a)), (9, " ".join([*a, "and", "more"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    joined = ngram_join.join(docs).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, joined.collect())) == oracle(rows, ngram_join.ORACLE)
    assert [r["doc_id"] for r in ngram_join.keep_one(docs).collect()] == [1]
    assert sorted(map(tuple, substring_dedup.digest(docs).collect())) == oracle(rows, substring_dedup.ORACLE)


def test_first_shared_token_of_another_size(spark):
    """Document 1 may link to 2; the token that it meets their group at first is held by the far larger 3."""
    held = {1: (100, [1, 2, 3]), 2: (110, [2, 3]), 3: (140, [1, 4])}
    tokens = spark.createDataFrame([(t, i, n) for i, (n, ts) in held.items() for t in ts], "token long, doc_id long, n long")
    members = spark.createDataFrame([(1, 100, 1, 0), (2, 110, 2, 0), (3, 140, 2, 0)], "doc_id long, n long, comp long, sub int")
    assert sorted(map(tuple, ngram_join.candidates(tokens, members).collect())) == [(1, 2, 0)]


def test_family_that_is_not_alike_enough(spark):
    """Texts with many changed words each don't meet at the words of their family; those that are near enough do, and the result is that of the SQL."""
    rng = random.Random(4)
    base = words(rng, 104)
    changed = lambda places: [f"x{rng.randrange(10**9)}" if i in places else w for i, w in enumerate(base)]
    rows = [(i, " ".join(changed(range(4 + i % 3, 104, 24)))) for i in range(40)] + [(50, " ".join(base)), (51, " ".join(changed({3, 60})))]
    tokens = ngram_join.prefixes(ngram_join.sets_of(spark.createDataFrame(rows, "doc_id long, text string"), spark.range(60).toDF("doc_id"))).cache()
    assert tokens.where("doc_id < 40").agg({"at": "min"}).first()[0] > 14, "the changed tokens come first"
    members = tokens.selectExpr("doc_id", "n", "doc_id as comp", "0 as sub").distinct()
    assert sorted(map(tuple, ngram_join.meeting(tokens, members).collect())) == [(50, 51, 0)]
    joined = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, joined.collect())) == oracle(rows, ngram_join.ORACLE)


def test_rough_need_never_shuts_a_group(spark):
    """Whatever ``enough`` opens passes the short rule before it; the short rule shuts groups too."""
    met = spark.range(0, 60).selectExpr("id * 3 as n").crossJoin(spark.range(1, 60).selectExpr("id * 3 as lo")).crossJoin(spark.range(0, 3).selectExpr("id * 25 as more")).crossJoin(spark.range(0, 12).selectExpr("id * 2 as c"))
    each = met.select(ngram_join.enough(F.col("c"), F.col("n"), F.col("lo"), F.col("lo") + F.col("more")).alias("opens"), ngram_join.roughly(F.col("c"), F.col("n"), F.col("lo"), F.col("lo") + F.col("more")).alias("rough"))
    got = {(r["opens"], r["rough"]): r["count"] for r in each.groupBy("opens", "rough").count().collect()}
    assert (True, False) not in got and got[True, True] and got[False, False]


def test_batches_of_sets_are_small(spark):
    """Sets and unions cross to Python in small batches; the session keeps its own setting."""
    key, seen, plain = "spark.sql.execution.arrow.maxRecordsPerBatch", [], ngram_join.candidates
    before = spark.conf.get(key)
    ngram_join.candidates = lambda *a: (seen.append(int(spark.conf.get(key))), plain(*a))[1]
    try:
        ngram_join.join(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")).collect()
    finally:
        ngram_join.candidates = plain
    assert seen == [ngram_join.BATCH] and spark.conf.get(key) == before


def test_least_need_of_inner_sizes(spark):
    """A group may be opened with as few shared prefix tokens as any size from lo to hi needs."""
    rest = lambda m: m - m // 4 - 1
    need = lambda m, n: -(-3 * (m + n) // 7) - max(rest(n), rest(m))
    triples = [(n, lo, hi) for n in (*range(1, 26), 99, 100, 101) for lo in range(-(-3 * n // 4), 4 * n // 3 + 1) for hi in range(lo, 4 * n // 3 + 1)]
    rows = [(*t, min(need(m, t[0]) for m in range(t[1], t[2] + 1))) for t in triples]
    df = spark.createDataFrame(rows, "n long, lo long, hi long, least long")
    says = lambda c: ngram_join.enough(c, F.col("n"), F.col("lo"), F.col("hi"))
    assert df.where(~says(F.col("least")) | says(F.col("least") - 1)).count() == 0


def test_training_order(spark, tmp_path):
    """Every use has its place in the curriculum, and packing keeps it, though large files are read first."""
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, rng.randrange(5, 40))), "abc"[min(i % 7, 2)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    goals = {r["source"]: (r["source_size"], int(r["target"] + 0.5)) for r in mixing.mix(docs).collect()}
    want = []
    for rank, (source, (size, goal)) in enumerate(sorted(goals.items())):
        s, e = (1.5, 0.5) if rank % 2 == 0 else (0.5, 1.5)
        at, queue = 0, sorted((hashlib.md5(str(i).encode()).hexdigest(), i, len(t.split())) for i, t, x in rows if x == source)
        while at < goal:
            for _, i, n in queue:
                take = min(n, goal - at)
                if take > 0:
                    share = (at + take / 2) / goal
                    want.append(((math.sqrt(s * s + 2 * (e - s) * share) - s) / (e - s), i, take, source))
                    at += take
    want.sort()
    assert any(goal > size for size, goal in goals.values())
    mixing.mixed_documents(docs).write.parquet(str(tmp_path / "mixed"))
    mixed = packing.in_file_order(spark.read.parquet(str(tmp_path / "mixed")))
    assert [(r["doc_id"], len(r["text"].split())) for r in mixed.orderBy("_place").collect()] == [x[1:3] for x in want]
    pieces = corpus_pipeline.pack_sequences(spark, spark.read.parquet(str(tmp_path / "mixed")), "").where("start = 0").orderBy("sequence_id", "offset").collect()
    for source in goals:
        assert [r["doc_id"] for r in pieces if r["source"] == source] == [x[1] for x in want if x[3] == source]
    plan = {r["doc_id"]: r for r in mixing.plan(docs).collect()}
    for i, r in plan.items():
        at = [x[0] for x in want if x[1] == i]
        assert r["uses"] == len(at) and (not at or (abs(r["first_position"] - min(at)) < 1e-6 and abs(r["last_position"] - max(at)) < 1e-6))


def test_null_ids_stay(spark):
    docs = spark.createDataFrame([(2, "one two"), (1, "one two"), (None, "no id"), (3, "")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in ngram_join.keep_one(docs).collect()) == [("1", "one two"), ("3", ""), ("None", "no id")]


def test_keep_one_does_not_shuffle_texts(spark, tmp_path):
    """Where few documents go, neither those that stay nor repeated rows are dealt out with their texts."""
    rows = [(1, "one two"), (1, "one two"), (2, "one two"), (3, ""), (3, None), (4, "else"), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        kept = ngram_join.keep_one(spark.read.parquet(str(tmp_path / "docs")))
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == [("1", "one two"), ("3", ""), ("3", "None"), ("4", "else"), ("None", "no id")]
    finally:
        spark.conf.set(key, before)


def test_stages_have_small_arrow_batches(spark):
    """The toxicity stage's texts are scored when its result is written, so its batches are bounded beyond the function."""
    docs = spark.createDataFrame([(i, "some words of a text") for i in range(1200)], "doc_id long, text string").coalesce(1)
    with store.batches_of(spark, 10_000):
        kept = corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.001")
        sizes = docs.mapInArrow(lambda batches: (pa.record_batch({"n": pa.array([b.num_rows], pa.int64())}) for b in batches), "n long")
        assert kept.count() == 1200 and max(r["n"] for r in sizes.collect()) <= 500
