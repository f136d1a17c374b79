"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names: values of every operator and pipeline stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import fingerprints, line_dedup, mixing, ngram_join, packing, quality_rules, site_quality, substring_dedup, toxicity, warc_zip

SF = "/root/testdata/sf0.001"
NAMES = "n_words base_failed kept toxic p_toxic p_poor _row _p n_lines n_removed drop _drop n_shingles component_id passes extra position positions _n _k0 size uid start n part sequence_id doc_tokens host path y e p_doc posterior signal bucket h site".split()
#: Names that the files' order uses, and ones that must be quoted.
ODD = ["_file", "_place", "_part", "a.b", "a`b", "a b"]
LONG = " ".join(f"w{i % 7919}" for i in range(120_000))
ROWS = [(1, None, "en", "a"), (2, "", None, None), (3, LONG, "en", "a"), (4, "one two", "en", "b"), (5, "one two", "en", None), (6, LONG + " tail", "de", "a"), (7, " \n\t ", "en", "b"), (6, LONG + " tail", "de", "a"), (None, "no id here", "en", "a")]


def make(spark, rows):
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES if n not in df.columns])


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_quality(spark):
    got = rows_of(quality_rules.apply_rules(make(spark, ROWS)), "doc_id", "n_words", "base_failed")
    assert got == sorted([(1, 0, True), (2, 0, True), (3, 120_000, True), (4, 2, True), (5, 2, True), (6, 120_001, True), (6, 120_001, True), (7, 0, True), (None, 3, True)], key=repr)
    assert quality_rules.apply_rules(make(spark, [])).count() == 0


def test_join_and_keep_one(spark):
    docs = make(spark, ROWS + [(8, "the same text", "en", "a")] * 3 + [(9, "the same text", "en", "a")])
    got = rows_of(ngram_join.join(docs), "doc_id", "n_shingles", "component_id")
    assert got == sorted([(8, 1, 8)] * 3 + [(9, 1, 8), (1, 0, 1), (2, 0, 2), (3, 7919, 3), (4, 1, 4), (5, 1, 4), (6, 7920, 3), (6, 7920, 3), (7, 0, 7), (None, None, None)], key=repr)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and rows_of(kept, "doc_id", "size") == sorted([(i, "own size") for i in (1, 2, 3, 4, 7, 8, None)], key=repr)
    assert ngram_join.keep_one(make(spark, [])).count() == 0
    odd = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in ODD])
    assert ngram_join.keep_one(odd).columns == odd.columns and ngram_join.keep_one(odd).count() == kept.count()


def test_lines(spark):
    line = "the same boilerplate line"
    rows = [(i, f"{line}\nown {i} and more words\n{line}", "en", f"s{i}") for i in range(12)] + [(20, line, "en", "s1"), (None, line, "en", "s2"), (21, None, "en", None), (3, f"{line}\nown 3 and more words\n{line}", "en", "s3")]
    docs = make(spark, rows)
    got = {(r["doc_id"], r["text"]): r for r in line_dedup.remove_boilerplate(docs).collect()}
    assert got[(0, f"{line}\nown 0 and more words")]["n_removed"] == 1 and got[(5, "own 5 and more words")]["n_lines"] == 3
    assert got[(20, "")]["n_removed"] == 1 and got[(None, line)]["n_removed"] == 0 and got[(21, None)]["n_lines"] == 0
    assert all(r["drop"] == "own drop" and r["_drop"] == "own _drop" for r in got.values())
    kept = line_dedup.kept_documents(docs)
    assert kept.columns == docs.columns and 20 not in {r["doc_id"] for r in kept.collect()} and kept.where("n_lines = 'own n_lines'").count() == len(rows) - 1
    assert kept.where("n_chars <> length(text)").count() == 0
    assert line_dedup.kept_documents(make(spark, [])).count() == 0


def test_toxicity(spark):
    rows = [(i, ("vile " if i % 2 else "kind ") * 5 + f"text {i}", "en", "a") for i in range(60)] + ROWS
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = make(spark, rows)
    got = toxicity.judge(docs, labels)
    said = {(r["doc_id"], (r["text"] or "")[:4]): r["toxic"] for r in got.collect()}
    assert said[(1, "vile")] and not said[(2, "kind")] and not said[(2, "")] and not said[(None, "no i")]
    assert got.where("p_poor >= 0 and p_toxic >= 0 and _row = 'own _row'").count() == len(rows)
    clean = toxicity.clean(docs, labels)
    assert clean.columns == docs.columns and clean.where("toxic <> 'own toxic' or p_toxic <> 'own p_toxic'").count() == 0
    assert clean.count() == got.where("not toxic").count() == 30 + len(ROWS)
    assert toxicity.clean(make(spark, []), labels).count() == 0 and toxicity.clean(docs, labels.limit(0)).count() == len(rows)


def test_sites(spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (None, 1)], "doc_id long, quality int")
    got = site_quality.judge(make(spark, ROWS), labels)
    assert got.count() == len(ROWS) and got.where("posterior between 0 and 1 and host_rate between 0 and 1").count() == len(ROWS)
    none = site_quality.judge(make(spark, ROWS), labels.limit(0)).collect()
    assert all(r["p_doc"] == 0.5 and r["kept"] for r in none)
    assert site_quality.judge(make(spark, []), labels).count() == 0


def test_mixing(spark):
    rows = [(1, "a b c", "en", "x"), (1, "a b c", "en", "x"), (None, "d e", "en", "x"), (None, "d e", "en", "x"), (2, None, "en", "y"), (3, " \n", "en", None), (4, "p q r s t u v w", "en", "y"), (5, "z z z", "en", None)]
    docs = make(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r["taken"] == 0 and r["positions"] == [] for r in got if r["size"] == 0)
    for source in ("x", "y", None):
        some = [r for r in got if r["source"] == source]
        assert sum(r["taken"] for r in some) == round(some[0]["target"]) <= 3 * some[0]["source_size"]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.where("passes <> 'own passes' or extra <> 'own extra' or n_chars <> length(text)").count() == 0
    taken = {}
    for r in mixed.collect():
        k = (r["doc_id"], r["source"])
        taken[k] = taken.get(k, 0) + len(r["text"].split())
    want = {}
    for r in got:
        want[(r["doc_id"], r["source"])] = want.get((r["doc_id"], r["source"]), 0) + r["taken"]
    assert taken == {k: v for k, v in want.items() if v}
    assert mixing.mix(make(spark, [])).count() == 0 and mixing.mixed_documents(make(spark, [])).count() == 0


def test_packing(spark):
    import public_tokenizers

    got = packing.pack(make(spark, ROWS), public_tokenizers.path("word_bpe_49k.json")).collect()
    whole = {}
    for r in got:
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    assert whole[(1, 1)] == [(0, 1)] and whole[(2, 1)] == [(0, 1)] and whole[(7, 1)] == [(0, 1)]
    for (_, n), parts in whole.items():
        assert sum(x[1] for x in parts) in (n, 2 * n)
    assert packing.pack(make(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_substrings(spark):
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring_dedup.digest(make(spark, ROWS)).collect()}
    assert got[(1, 0)] == got[(2, 0)] == got[(7, 0)] == got[(4, 2)] == got[(None, 3)] == 0
    assert got[(3, 120_000)] == 120_000 - 7919 and got[(6, 120_001)] == 120_000
    assert substring_dedup.digest(make(spark, []).withColumn("doc_id", F.col("doc_id").cast("int"))).count() == 0


def test_substrings_of_shared_ids(spark):
    """Rows of one doc_id with different texts are documents of their own: what is unique in either stays."""
    rng = __import__("random").Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    a, b, c = ([word() for _ in range(n)] for n in (90, 40, 60))
    rows = [(1, " ".join(a), "en", "a"), (2, " ".join(a[:30] + b), "en", "a"), (2, " ".join(c + a[40:73]), "en", "a"), (2, " ".join(c + a[40:73]), "en", "a"), (3, " ".join(b + c), "en", "a")]
    got = rows_of(substring_dedup.digest(make(spark, rows)), "doc_id", "n_words", "n_removed")
    assert got == sorted([(1, 90, 0), (2, 70, 30), (2, 93, 33), (2, 93, 33), (3, 100, 100)], key=repr)


def test_packing_in_file_order(spark, tmp_path):
    import public_tokenizers

    docs = make(spark, [(i, f"text {i}", "en", "a") for i in range(50)]).select("*", *[F.lit(f"own {n}").alias(n) for n in ODD])
    docs.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "docs"))
    placed = packing.in_file_order(spark.read.parquet(str(tmp_path / "docs")))
    assert set(placed.columns) == set(docs.columns) and [r["doc_id"] for r in placed.orderBy("_place").collect()] == list(range(50))
    assert placed.where("_file = 'own _file' and `a.b` = 'own a.b' and _part = 'own _part'").count() == 50
    assert packing.pack(placed, public_tokenizers.path("word_bpe_49k.json"), order="_place").count() >= 50


def test_fingerprint_edges(spark):
    rows = ROWS + [(8, "", "en", "a"), (9, "one two", "en", "a")]
    docs = make(spark, rows).withColumn("blk", F.lit("own"))
    got = fingerprints.fingerprint_edits(docs).collect()
    assert sorted((repr(r["doc_id"]), r["n_chars"]) for r in got) == sorted((repr(i), len(t or "")) for i, t, _, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by[1] == by[2] == by[7] == by[8] and by[4] == by[5] == by[9] != by[1] and len(by[6]) == 1, "equal texts, and texts without words, have equal fingerprints"
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.fingerprint_edits(make(spark, [])).count() == 0


def test_warc_edges(spark):
    big = "<p>" + "x" * 2_000_000
    rows = [(5, "http://a/5", big), (2, "http://a/2", big), (3, None, None), (4, "http://a/4", ""), (6, "http://a/6", "y" * 99), (7, "http://a/7", "y" * 99), (8, "http://a/8", "é" * 50), (9, "http://a/9", "é" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("own").alias(n) for n in ("payload_bytes", "record_type", "offset", "_row", "digest")])
    got = rows_of(warc_zip.round_trip(spark, pages), "page_id", "payload_bytes", "record_type", "refers_to")
    assert got == sorted([(2, 2_000_003, "response", None), (5, 2_000_003, "revisit", 2), (3, 0, "response", None), (4, 0, "response", None), (6, 99, "response", None), (7, 99, "response", None), (8, 100, "response", None), (9, 100, "revisit", 8)], key=repr)
    assert warc_zip.round_trip(spark, pages.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    """Stages keep the columns, take effect, and run on rows with every edge."""
    real = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(i, t, lang, s) for i, t, lang, s in ROWS if i not in (3, 6)] + [(10_003, LONG, "en", "a"), (10_006, LONG + " tail", "de", "a")]
    docs = real.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    docs = docs.unionByName(make(spark, extra).select(*docs.columns)).withColumn("toxic", F.lit("own"))
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if name == "packing":
            assert out.count() > 0
            break
        assert out.columns == docs.columns, name
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert counts[0] > counts[1] >= counts[2] > counts[3]


@pytest.mark.parametrize("order", ["descending", "shuffled"])
def test_order_of_rows(spark, order):
    """op4 and op10 give the rows of their SQL whatever the order of reading."""
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    key = {"descending": F.desc("doc_id"), "shuffled": F.xxhash64("doc_id")}[order]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(1).sortWithinPartitions(key)
    for run, sql in ((ngram_join.join, ngram_join.ORACLE), (substring_dedup.digest, substring_dedup.ORACLE)):
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert rows_of(run(docs), *names) == sorted(want.fetchall(), key=repr)
