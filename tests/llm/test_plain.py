"""Operators against plain versions, written here in loops over rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomtext.llm import fingerprints, line_dedup, linear, packing, queries, site_quality, store, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def chained(words):
    """Spark's xxhash64 of several strings: each hash is the seed of the next."""
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
    return signed(seed)


def plain_sketch(text):
    words = text.split()
    if not words:
        return []
    hashes = {chained([" ".join(words)])} if len(words) < 5 else {chained(words[i : i + 5]) for i in range(len(words) - 4)}
    return sorted({h for h in hashes if h < fingerprints.threshold()} | {min(hashes)})


def plain_containment(a, b):
    if not a or not b:
        return float(not a and not b)
    ka, kb = ([h for h in s if h < fingerprints.threshold()] for s in (a, b))
    if not ka and not kb:
        return float(a == b)
    if not ka:
        return float(a[0] in b)
    if not kb:
        return float(b[0] in a)
    return len(set(ka) & set(kb)) / min(len(ka), len(kb))


def test_fingerprints(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op3_fingerprints(spark, SF).collect()}
    ids = sorted(docs, reverse=True)
    write = lambda s: "".join(f"{h % 2**64:016x}" for h in s)
    for at, i in enumerate(ids):
        t, nxt = docs[i], docs[ids[(at + 1) % len(ids)]]
        k = len(t) // 3
        own, edited, other = (plain_sketch(x) for x in (t, t[: len(t) - k] + nxt[:k], nxt))
        assert got[i]["fingerprint"] == write(own) and got[i]["edited_fingerprint"] == write(edited)
        assert got[i]["near_edited"] == pytest.approx(plain_containment(own, edited)) and got[i]["near_next"] == pytest.approx(plain_containment(own, other))


def plain_strength(children):
    """children: {parent: [(n, good)]}."""
    num = den = 0.0
    for rows in children.values():
        rows = [x for x in rows if x[0] > 0]
        if len(rows) < 2:
            continue
        n, g = sum(x[0] for x in rows), sum(x[1] for x in rows)
        m = g / n
        num += sum(x[0] * (x[1] / x[0] - m) ** 2 for x in rows) - m * (1 - m) * (len(rows) - 1)
        den += m * (1 - m) * (n - sum(x[0] ** 2 for x in rows) / n - (len(rows) - 1))
    if den <= 0:
        return 10.0
    rho = min(max(num / den, 1 / 10001), 1 / 2)
    return (1 - rho) / rho


def test_site_posteriors(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        host = rng.choice(["good", "good", "bad", "rare", None])
        rate = {"good": 0.9, "bad": 0.15, "rare": 0.6, None: 0.5}[host]
        rows.append((i, host, rng.choice(["a", "b", None]), min(0.999, max(0.001, rng.gauss(rate, 0.2))), int(rng.random() < rate) if rng.random() < 0.5 else None))
    rows.append((400, "once", "a", 0.4, None))
    base, worth = 0.7, 0.3
    got = {r["i"]: r for r in site_quality.posteriors(spark.createDataFrame(rows, "i long, host string, path string, p_doc double, y int"), base, worth).collect()}
    w = lambda r: worth if r[4] is None else 1.0
    g = lambda r: worth * r[3] if r[4] is None else float(r[4])
    n_host, g_host, n_path, g_path = (defaultdict(float) for _ in range(4))
    for r in rows:
        n_host[r[1]] += w(r)
        g_host[r[1]] += g(r)
        n_path[r[1:3]] += w(r)
        g_path[r[1:3]] += g(r)
    rate = sum(g_host.values()) / sum(n_host.values())
    by_host = defaultdict(list)
    for k in n_path:
        by_host[k[0]].append((n_path[k], g_path[k]))
    a, b = plain_strength({0: [(n_host[h], g_host[h]) for h in n_host]}), plain_strength(by_host)
    moved = 0
    for r in rows:
        h = (g_host[r[1]] - g(r) + a * rate) / (n_host[r[1]] - w(r) + a)
        p = (g_path[r[1:3]] - g(r) + b * h) / (n_path[r[1:3]] - w(r) + b)
        odds = math.log(p / (1 - p)) + math.log(r[3] / (1 - r[3])) - math.log(base / (1 - base))
        post = 1 / (1 + math.exp(-odds))
        assert got[r[0]]["host_rate"] == pytest.approx(h, abs=1e-4) and got[r[0]]["path_rate"] == pytest.approx(p, abs=1e-4) and got[r[0]]["posterior"] == pytest.approx(post, abs=1e-4)
        moved += (post >= 0.5) != (r[3] >= 0.5)
    assert moved > 10
    assert got[400]["host_rate"] == pytest.approx(rate, abs=1e-6), "a site with this document alone has the global rate"


def test_a_bad_site_moves_verdicts(spark):
    """The same middling text is kept on a good site and not on a bad one."""
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(80))
    poor = lambda: " ".join(rng.choice(["##", "||", "$$", "!!", "x"]) for _ in range(80))
    half = " ".join(("word%d" % i) if i % 2 else "#!" for i in range(80))
    docs, labels = [], []
    for i in range(300):
        bad = i % 2
        y = int(rng.random() < (0.1 if bad else 0.9))
        docs.append((i, good() if y else poor(), "bad" if bad else "fine", "en"))
        labels.append((i, y))
    mixed = [(1000 + i, half, ("bad", "fine")[i % 2], "en") for i in range(40)]
    labels += [(1000 + i, int(rng.random() < 0.5)) for i in range(0, 40)]
    d = spark.createDataFrame(docs + mixed, "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r for r in site_quality.judge(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert abs(got[1000]["p_doc"] - got[1001]["p_doc"]) < 0.3
    assert got[1000]["posterior"] < got[1000]["p_doc"] and got[1001]["posterior"] > got[1001]["p_doc"]
    assert not got[1000]["kept"] and got[1001]["kept"]


def plain_chain(texts, labels, folds):
    """The chain by loops: labels {id: {category: 0, 1 or None}}; gives probabilities for all texts."""
    ids = sorted(labels)
    words = {i: set(toxicity.LETTERS.findall((texts[i] or "").lower())) for i in texts}
    best = set()
    for c in toxicity.CATEGORIES:
        known = [i for i in ids if labels[i][c] is not None]
        n, p = len(known), sum(labels[i][c] for i in known)
        held, hit = Counter(w for i in known for w in words[i]), Counter(w for i in known if labels[i][c] for w in words[i])
        gain = {w: n * (hit[w] * n - k * p) ** 2 / max(k * (n - k) * p * (n - p), 1e-9) for w, k in held.items() if k >= 3}
        best |= set(sorted((w for w in gain if gain[w] >= toxicity.LEAST_GAIN), key=lambda w: (-gain[w], w))[: toxicity.MOST_WORDS // 3])
    vocabulary = sorted(best)
    row = lambda i: [float(w in words[i]) for w in vocabulary] + list(toxicity.features(texts[i])[1:])
    x, every = np.array([row(i) for i in ids]), np.array([row(i) for i in texts])
    fold = np.array([folds[i] for i in ids])
    for c in toxicity.CATEGORIES:
        y = np.array([math.nan if labels[i][c] is None else labels[i][c] for i in ids], dtype=float)
        known, outside = ~np.isnan(y), np.zeros(len(ids))
        for k in range(toxicity.FOLDS):
            model = linear.fit(x[known & (fold != k)], y[known & (fold != k)], toxicity.RIDGE)
            outside[fold == k] = linear.predict(x[fold == k], model)
        model = linear.fit(x[known], y[known], toxicity.RIDGE)
        x, every = np.hstack([x, outside[:, None]]), np.hstack([every, linear.predict(every, model)[:, None]])
    return dict(zip(texts, every[:, -3:].tolist()))


def test_chain(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    labels = labels.withColumn("toxic", F.when(F.col("doc_id") % 7 != 0, F.col("toxic")))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {r["doc_id"]: r.asDict() for r in toxicity.categories_of(labels).collect() if r["doc_id"] in texts}
    folds = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    want = plain_chain(texts, known, folds)
    for r in toxicity.judge(docs, labels).collect():
        assert [r[f"p_{c}"] for c in toxicity.CATEGORIES] == pytest.approx(want[r["doc_id"]], abs=2e-3)


def test_newton_stays_finite():
    rng = np.random.default_rng(0)
    x = (rng.random((400, 60)) < 0.05).astype(float)
    y = np.zeros(400)
    y[:4], x[:4, 0] = 1, 1
    w = linear.fit(x, y, 0.3)
    p = linear.predict(x, w)
    assert np.abs(w).max() < 50 and np.abs(x.T @ (p - y) + 0.3 * w[:-1]).max() < 1e-6


def test_sketch_decides_outside_the_band(spark, monkeypatch):
    """With no band every verdict is the sketch's; with an endless one every verdict is an exact count."""
    rows = [(i * 100 + s, f"line number {i} of the test\nown line {i} {s}", f"site{s}") for i, n in enumerate((2, 9, 10, 11, 40)) for s in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counted = []
    real = store.join_small
    monkeypatch.setattr(line_dedup.store, "join_small", lambda big, small, on, how="left", limit=store.BROADCAST_ROWS: (counted.append(small.count()) if "near" in str(small.inputFiles()) else None, real(big, small, on, how, limit))[1])
    want = sorted(map(tuple, line_dedup.digest(docs).collect()))
    assert counted and max(counted) <= 3, "only 9, 10 and 11 sites are near the threshold"
    lost = {r[0] for r in want if r[2]}
    assert lost == {i * 100 + s for i, n in enumerate((2, 9, 10, 11, 40)) if n >= 10 for s in range(1, n)}
    for band in (0.0, 10.0):
        monkeypatch.setattr(line_dedup, "BAND", band)
        assert sorted(map(tuple, line_dedup.digest(docs).collect())) == want


def test_windows_hold_the_mix(spark):
    import public_tokenizers

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shares = {"src0": 0.5, "src1": 0.3}
    for given in (None, shares):
        pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), given).toPandas()
        table = pieces.groupby(["sequence_id", "source"]).length.sum().unstack(fill_value=0)
        full = table[table.sum(axis=1) == 4096] / 4096
        if given is None:
            target = table.sum() / table.sum().sum()
            assert ((full - target).abs().sum(axis=1) / 2).mean() < 0.01
        else:
            own = table.sum() / table.sum().sum()
            first = full.head(3).mean()
            scale = 0.8 + own.drop(["src0", "src1"]).sum()
            assert first["src0"] == pytest.approx(0.5 / scale, abs=0.03) and first["src1"] == pytest.approx(0.3 / scale, abs=0.03)


def plain_rounds(queues, window, least):
    """Deficit round-robin by a loop over single tokens: queues {source: (phase, [(uid, n)])}; gives the stream as (uid, token)."""
    total = sum(n for _, q in queues.values() for _, n in q)
    out = []
    for source, (phase, q) in queues.items():
        earned = sum(n for _, n in q) / total * window
        every = math.ceil(least / earned)
        for t, token in enumerate((uid, k) for uid, n in q for k in range(n)):
            out.append((math.floor(t / (earned * every)) * every + phase, source is None, source or "", t, token))
    return [x[-1] for x in sorted(out)]


def test_round_robin_order(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, rng.choice(["a", "a", "a", "b", None]), rng.randrange(1, 90)) for i in range(80)]
    tokens = spark.createDataFrame([((p << 33) + i, p, s, n) for i, p, s, n in rows], "uid long, part int, source string, n long")
    placed, total = packing.schedule(tokens, window=256, least=16)
    got = {}
    for r in placed.collect():
        for p in r["pieces"]:
            for k in range(p["n"]):
                got[p["begin"] + k] = (r["uid"], p["at"] + k)
    assert sorted(got) == list(range(total))
    queues = defaultdict(list)
    for r in sorted(tokens.collect()):
        queues[r["source"]].append((r["uid"], r["n"]))
    size = lambda s: sum(n for _, n in queues[s])
    phase = {r["source"]: r["h"] for r in tokens.select("source", F.xxhash64("source").alias("h")).distinct().collect()}
    every = {s: math.ceil(16 / (size(s) / total * 256)) for s in queues}
    want = plain_rounds({s: (phase[s] % every[s], q) for s, q in queues.items()}, 256, 16)
    assert [got[i] for i in range(total)] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer(name):
    import public_tokenizers

    t = packing.Words(public_tokenizers.path(name))
    texts = ["Plain words, here!", "It's <x> [y] 1.5 e\u0301a été naïve \u00df ab\u00a0cd", "", "\t mixed\n\nlines  and   spaces ", "日本語 слово ῥήτωρ"]
    for text, raw in zip(texts, t.encode([x.encode() for x in texts])):
        assert np.frombuffer(raw, dtype=t.kind).tolist() == [*t.made.encode(text, add_special_tokens=False).ids, packing.END]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_column_of_texts(name, monkeypatch):
    """A slice of a column with nulls and repeats has the tokenizer's ids, also when no more can be remembered; a word is encoded once for all its texts."""
    import pyarrow as pa
    import public_tokenizers

    monkeypatch.setattr(packing, "REMEMBERED", 3)
    t = packing.Words(public_tokenizers.path(name))
    texts = ["left out", None, "", "  The cat, the CAT!\tthe naïve\x0bnaïve, x1 x1", "it's it's É. (cat) cat|| <|x|>", "\x1cpart\x85two\u2003three\n", "the cat", *[f"w{'abcdefg'[i % 7]} x{i} é{i % 5}" for i in range(40)], "left out"]
    asked = []
    monkeypatch.setattr(t, "of_words", lambda words, f=t.of_words: f([asked.append(w) or w for w in words]))
    for _ in range(2):
        got = t.encode_column(pa.array(texts, pa.string()).slice(1, len(texts) - 2)).to_pylist()
        for text, raw in zip(texts[1:-1], got, strict=True):
            assert np.frombuffer(raw, dtype=t.kind).tolist() == [*t.made.encode(text or "", add_special_tokens=False).ids, packing.END]
    assert not t.by_words or max(map(asked.count, asked)) <= 2
    assert not t.by_parts or b"cat" not in asked
    assert t.encode_column(pa.array([], pa.string())).to_pylist() == []


def plain_removed(rows):
    """Words lost of each document, by window texts in order of (doc_id, start)."""
    seen, lost = {}, {}
    for i, text in sorted(rows):
        w = text.split()
        gone = set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone.update(range(k, k + 20))
            else:
                seen[key] = (i, k)
        lost[i] = [x for k, x in enumerate(w) if k not in gone]
    return lost


@pytest.mark.parametrize("most", [1, 500])
def test_substrings_whatever_the_shards(spark, monkeypatch, most):
    """Hot anchors with many different surroundings, periods and copies, read in no order."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    hot = [word() for _ in range(9)]
    passage = [word() for _ in range(45)]
    rows = []
    for i in range(90):
        w = [word() for _ in range(rng.randrange(5, 60))] + hot + [word() for _ in range(rng.randrange(0, 40))]
        if i % 3 == 0:
            w += passage[rng.randrange(0, 10) : rng.randrange(25, 45)]
        if i % 10 == 0:
            w += ["p%d" % (k % (13 if i % 20 else 3)) for k in range(70)]
        rows.append((i, " ".join(w)))
    rows += [(i + 500, rows[i][1]) for i in range(0, 90, 4)] + [(200, ""), (201, " ".join(hot * 8))]
    rng.shuffle(rows)
    monkeypatch.setattr(substring_dedup, "MOST_SPANS", most)
    got = {r["doc_id"]: r["kept"] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()}
    assert got == {i: " ".join(w) for i, w in plain_removed(rows).items()}
