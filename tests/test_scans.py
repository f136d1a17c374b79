"""Scans by composed maps, fills, names, lemmas and anchors against one-by-one versions."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomtext.operators import anchors, lemmas, naming, state_scan
from loomtext.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_states_and_fills(spark):
    """Blocks of any width give the states and values of a one-by-one scan; null keys are a key."""
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), i, [rng.randrange(4) for _ in range(4)], rng.choice([None, None, f"v{i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, at long, map array<int>, v string").repartition(5)
    want, state, last = {}, defaultdict(int), {}
    for key, at, step, v in rows:
        last[key] = v if v is not None else last.get(key)
        want[at] = (state[key], last[key])
        state[key] = step[state[key]]
    for width in (1, 7, 64, 10_000):
        block = F.floor(F.col("at") / width)
        met = state_scan.scan_states(df, ["key"], block, "at", F.col("map"), 4)
        got = state_scan.filled(met, ["key"], block, "at", "v", "last").collect()
        assert {r["at"]: (r["state"], r["last"]) for r in got} == want and len(got) == len(rows)
    assert state_scan.scan_states(df.limit(0), ["key"], F.col("at"), "at", F.col("map"), 4).count() == 0


def plain_names(bases, longest):
    used, out = set(), []
    for base in bases:
        name, n = base, 2
        while name in used:
            mark = f"_{n}"
            name, n = base[: longest - len(mark)] + mark, n + 1
        used.add(name)
        out.append(name)
    return out


def test_unique_names(spark):
    rng = random.Random(2)
    cases = [["x", "x", "x_2"], ["x_2", "x", "x"], ["x_2", "x_3", "x", "x", "x_3", "x_2_2", "x_2"], ["abcdefgh"] * 12 + ["abcdef_2", "abcdefgh_2"]]
    cases += [[rng.choice(["x", "x_2", "x_3", "x_2_2", "y", "y_4", "x_11"]) for _ in range(120)] for _ in range(3)]
    for bases in cases:
        df = spark.createDataFrame(list(enumerate(bases)), "at long, base string").repartition(3)
        got = naming.unique_names(df, "base", "at", F.floor(F.col("at") / 16), longest=8)
        assert [r["name"] for r in got.orderBy("at").collect()] == plain_names(bases, 8)
    assert naming.unique_names(df.limit(0), "base", "at", F.col("at")).count() == 0


def plain_lemmas(counts, shown):
    stems = defaultdict(dict)
    for w, n in counts.items():
        for k in range(0, 5):
            if len(w) - k >= 4:
                stems[w[: len(w) - k]][w[len(w) - k :]] = n
    met = Counter()
    for forms in stems.values():
        if len(forms) > 1:
            base = max(forms, key=lambda e: (forms[e], -len(e), e))
            met.update((e, base) for e in forms if e not in (base, ""))
    rules = {}
    for (e, base), n in met.items():
        if n >= shown and (e not in rules or (n, -len(base), base) > rules[e][0]):
            rules[e] = ((n, -len(base), base), base)
    out = {}
    for w in counts:
        fit = [k for k in range(4, 0, -1) if len(w) - k >= 4 and w[-k:] in rules]
        out[w] = w[: -fit[0]] + rules[w[-fit[0] :]][1] if fit else w
    return out


def test_lemmas(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abdefghijklm") for _ in range(rng.randrange(4, 8))) for _ in range(60)]
    counts = Counter(rng.choice(stems) + rng.choice(["", "s", "ed", "ing", "er", "ation"]) for _ in range(2000)) + Counter(["of", "the", "żółw", "żółwie"])
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    learned = lemmas.rules(df)
    assert {r["word"]: r["lemma"] for r in lemmas.lemmas(df, learned).collect()} == plain_lemmas(counts, lemmas.SHOWN)
    made = {r["ending"]: r["base"] for r in learned.collect()}
    assert made, "the paradigm is learned"
    assert lemmas.lemmas(df.limit(0), learned).count() == 0


def plain_anchors(bullets, sentences):
    words = [set(re.findall("[a-z]{4,}", b.lower())) for b in bullets]
    used = Counter(w for ws in words for w in ws)
    out, at = [], 0
    for ws in words:
        own = {w for w in ws if used[w] == 1}
        for i in range(at, len(sentences)):
            hits = {w for w in own if re.search(rf"\b{w}", sentences[i].lower())}
            if len(hits) >= 2 or any(len(w) >= 9 for w in hits):
                out.append(i)
                at = i + 1
                break
        else:
            out.append(None)
    return out


def test_anchors(spark):
    rng = random.Random(4)
    pool = ["alpha", "alphabet", "gamma", "deltas", "common", "parallelization", "extraordinary", "beta", "betas", "epsilon", "zeta"]
    lists = {k: [" ".join(rng.sample(pool, 3)) for _ in range(4)] for k in range(6)}
    texts = {k: [" ".join(rng.sample(pool, 4)) + rng.choice(["s", "ness", ""]) for _ in range(12)] for k in range(5)}
    sentences = spark.createDataFrame([(k, i, t) for k, ts in texts.items() for i, t in enumerate(ts)], "key long, sentence int, text string")
    bullets = spark.createDataFrame([(k, i, t) for k, ts in lists.items() for i, t in enumerate(ts)], "list long, bullet int, text string")
    got = {(r["key"], r["list"], r["bullet"]): r["sentence"] for r in anchors.anchors(sentences, bullets).collect()}
    assert got == {(k, li, b): i for k, ts in texts.items() for li, bs in lists.items() for b, i in enumerate(plain_anchors(bs, ts)) if i is not None}
    one = spark.createDataFrame([(0, "alpha bravo"), (1, "extraordinary")], "bullet int, text string").withColumn("list", F.lit(0))
    said = spark.createDataFrame([(0, "alpha"), (1, "Alphas and bravo"), (2, "extraordinary!")], "sentence int, text string").withColumn("key", F.lit(0))
    assert sorted((r["bullet"], r["sentence"]) for r in anchors.anchors(said, one).collect()) == [(0, 1), (1, 2)]
    assert sorted((r["bullet"], r["sentence"]) for r in anchors.anchors(said, one, stop=("alpha",)).collect()) == [(1, 2)]


def test_null_labels(spark, tmp_path):
    """Rows without label are one group like any other, in the query and in its SQL."""
    import duckdb

    from loomtext.plans import catalog

    rng = random.Random(6)
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(4)]
    rows = [(i, vectors[rng.randrange(4)], rng.choice([None, 1, 2])) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["merge_similar"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["merge_similar"](spark, str(tmp_path)).select("label", "vec_id", "grp").collect()), key=repr) == sorted(want, key=repr)
    assert max(r[2] for r in want if r[0] is None) > 3


@pytest.mark.parametrize("name", ["rare_lemmas", "unknown_lemmas"])
def test_lemmas_read_the_texts_once_more(spark, name):
    """Words are counted once; after that one look at the texts is enough."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation\s?\[doc_id#\d+L?,text", plan)) == 1


def test_anchors_are_counted_where_sentences_lie(spark, monkeypatch):
    """With few bullets the sentences are dealt once, by key; with more than may be sent the result is the same."""
    sentences = spark.createDataFrame([(k, i, t) for k in range(3) for i, t in enumerate(["alphas betas", "nothing", "gamma-ray telescopes", "alpha beta gamma"])], "key long, sentence int, text string")
    bullets = spark.createDataFrame([(0, 0, "Alpha beta"), (0, 1, "telescope"), (1, 0, "gamma alpha")], "list long, bullet int, text string")
    few = anchors.anchors(sentences, bullets)
    assert few._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(anchors, "SMALL_ROWS", 0)
    rows = sorted(map(tuple, few.collect()))
    assert rows == sorted(map(tuple, anchors.anchors(sentences, bullets).collect())) and (0, 0, 1, 2) in rows and (2, 1, 0, 3) in rows
