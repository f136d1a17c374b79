"""The training-data operators against their SQL, round trips, archives and held-out labels."""

import hashlib
import io
import zipfile
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import fingerprints, queries, substring_dedup, toxicity, warc_zip

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    flat = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    assert sorted(repr([flat(r[c]) for c in cols]) for r in df.collect()) == sorted(repr([flat(r[names.index(c)]) for c in cols]) for r in want.fetchall())


def test_sketches_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"b{i}" for i in range(400))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    s = lambda c: fingerprints.sketch(F.col(c))
    row = df.select(fingerprints.merge(s("a"), s("b")).alias("m"), fingerprints.containment(s("a"), fingerprints.merge(s("a"), s("b"))).alias("c")).first()
    assert row["c"] == 1.0 and len(row["m"]) > 50


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op9_packing(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in docs.items():
        ids, at = t.encode(text, add_special_tokens=False).ids + [2], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], dtype="<u4")
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0


def test_zip64_and_comments(monkeypatch):
    records = [(f"k{i}", warc_zip.record(i, "http://x/", b"payload %d" % i, hashlib.sha256(b"payload %d" % i).hexdigest(), None)) for i in range(5)]
    for limit in (None, 0):
        if limit is not None:
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
            monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", limit)
        raw = warc_zip.build(records)
        a = warc_zip.Archive(lambda at, n: raw[at : at + n], len(raw))
        assert a.read(warc_zip.DATA) == b"".join(r for _, r in records)
        assert warc_zip.parse(a.read(warc_zip.DATA, len(records[0][1]), len(records[1][1])))["payload"] == b"payload 1"
        with pytest.raises(ValueError):
            a.read(warc_zip.DATA, 0, 1 << 30)
    with pytest.raises(ValueError):
        warc_zip.Archive(lambda at, n: b"nothing"[at : at + n], 7)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"x")
        z.comment = b"PK\x05\x06 is not the end"
    raw = out.getvalue()
    assert warc_zip.Archive(lambda at, n: raw[at : at + n], len(raw)).read("a") == b"x"


def test_warc_edges(spark):
    big = "p" * 200
    pages = spark.createDataFrame([(3, "u", big), (1, "u\n", big), (2, None, None), (4, "u", "s"), (5, "u", "s"), (3, "u", big)], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc_zip.round_trip(spark, pages).collect())
    assert got == [(1, "response", None), (2, "response", None), (3, "revisit", 1), (3, "revisit", 1), (4, "response", None), (5, "response", None)]
    assert warc_zip.round_trip(spark, pages.limit(0)).count() == 0


def test_automaton():
    a = substring_dedup.SuffixAutomaton()
    for s in ("abcbc", "xbcx", "abab"):
        a.add(s)
    text, texts = "zabcbcxbcxabab", ("abcbc", "xbcx", "abab")
    want = [max((n for n in range(e + 1) if any(text[e - n : e] in t for t in texts)), default=0) for e in range(1, len(text) + 1)]
    assert list(a.matching(text)) == want


def test_reference_removal(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(["x", *words[:30], "y"])), (2, "short text"), (3, None)], "doc_id long, text string")
    reference = spark.createDataFrame([(" ".join(words),), (None,)], "text string")
    got = {r["doc_id"]: r["kept"] for r in substring_dedup.remove_reference(docs, reference).collect()}
    assert got == {1: "x y", 2: "short text", 3: ""}
    monkeypatch.setattr(substring_dedup, "MOST_REFERENCE", 50)
    with pytest.raises(ValueError):
        substring_dedup.remove_reference(docs, reference)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, rest = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    judged = toxicity.judge(docs, train).select("doc_id", F.col("toxic").alias("said")).join(rest, "doc_id").groupBy("said", "toxic").count().collect()
    n = {(r["said"], r["toxic"]): r["count"] for r in judged}
    assert n.get((True, 0), 0) <= 0.02 * (n[(False, 0)]) and n[(True, 1)] > 2 * n.get((False, 1), 0)
