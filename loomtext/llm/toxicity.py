"""Toxicity by a classifier chain.

Method: categories are predicted one after another by linear models; each later
model also sees the probabilities of the earlier categories. In training these
are out-of-fold predictions, so that a later model learns from probabilities as
uncertain as those it will meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import linear, store

LETTERS = re.compile(r"[^\W\d_]+")
NOISE = re.compile(r"[#*$%&|<>!]")
#: Bounds of training: labelled rows, and features (an equal part of the vocabulary for each category).
MOST_ROWS, MOST_WORDS = 8_000, 400
FOLDS = 3
#: A category is found from the out-of-fold probability that this share of its negatives exceeds, within these bounds.
CLEAN_LOST, CUTS = 0.002, (0.25, 0.5)
#: Least chi-square of a word of the vocabulary, and the ridge of the models.
LEAST_GAIN, RIDGE = 10.0, 0.3


@dataclass
class Chain:
    """A fitted chain: the vocabulary and, for each category in order, its weights."""

    categories: list[str]
    vocabulary: list[str] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    cuts: list[float] = field(default_factory=list)

    def score(self, texts: pd.Series) -> pd.DataFrame:
        """Probabilities of each text, a column for each category. Null texts are empty."""
        at = {w: i for i, w in enumerate(self.vocabulary)}
        x = np.zeros((len(texts), len(at) + 2), dtype=np.float32)
        for i, t in enumerate(texts):
            found, noise, caps = features(t)
            x[i, [at[w] for w in found & at.keys()]] = 1.0
            x[i, -2:] = noise, caps
        return pd.DataFrame(chain_scores(x, self.weights), columns=self.categories)


def features(text: str | None) -> tuple[set[str], float, float]:
    """The distinct lower-case words, the share of noise characters and that of capitals."""
    text = text or ""
    n = max(1, len(text))
    return set(LETTERS.findall(text.lower())), 10 * len(NOISE.findall(text)) / n, sum(map(str.isupper, text)) / n


def chain_scores(x: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    for w in weights:
        x = np.hstack([x, linear.predict(x, w)[:, None]])
    return x[:, x.shape[1] - len(weights) :]


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: list[str], most: int) -> DataFrame:
    """Up to ``most`` labelled documents, chosen by the hash of doc_id: doc_id, fold, categories, text.

    A doc_id labelled twice counts as positive if any label is; a category without a label stays null.
    """
    one = labels.groupBy("doc_id").agg(*[F.max(F.col(c).cast("double")).alias(c) for c in categories])
    picked = one.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most ``most`` narrow rows
    return texts.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)))


def vocabulary_of(rows: DataFrame, categories: list[str], most: int) -> list[str]:
    """The words whose presence tells most about any category, among rows (words, categories); a row counts where its label is known."""
    counts = rows.select(F.explode("words").alias("word"), *categories).groupBy("word")
    best: set[str] = set()
    for c in categories:
        n, p = rows.agg(F.count(c), F.sum(c)).first()
        a, k, n, p = F.col("a"), F.col("k"), float(n), float(p or 0.0)
        gain = n * (a * n - k * p) * (a * n - k * p) / F.greatest(k * (n - k) * F.lit(p * (n - p)), F.lit(1e-9))  # chi-square of presence against the category
        found = counts.agg(F.sum(c).alias("a"), F.count(c).cast("double").alias("k")).where("k >= 3").withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN)
        best |= {r["word"] for r in found.orderBy(F.desc("gain"), "word").limit(most // len(categories)).collect()}
    return sorted(best)


def fit_chain(x: np.ndarray, fold: np.ndarray, labels: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """Weights and cuts of the categories in order; the features of each later one are joined by the out-of-fold probabilities of those before.

    An unknown label (NaN) teaches its category nothing; its row still has probabilities for the later ones.
    """
    weights, cuts = [], []
    for y in labels:
        known = ~np.isnan(y)
        outside = np.zeros(len(y))
        for k in range(FOLDS):
            some = known & (fold != k)
            outside[fold == k] = linear.predict(x[fold == k], linear.fit(x[some], y[some], RIDGE))
        weights.append(linear.fit(x[known], y[known], RIDGE))
        clean = outside[y == 0]
        cuts.append(float(np.clip(np.quantile(clean, 1 - CLEAN_LOST), *CUTS)) if len(clean) else CUTS[1])
        x = np.hstack([x, outside[:, None]])
    return weights, cuts


def train(docs: DataFrame, labels: DataFrame, categories: list[str], most_rows: int = MOST_ROWS, most_words: int = MOST_WORDS) -> Chain:
    """Fit a chain to a bounded sample of labelled documents.

    The vocabulary holds the words whose presence tells most about any category
    in the sample. With no labelled rows every probability is one half.
    """
    sample = labelled_sample(docs, labels, categories, most_rows)
    kinds = f"fold int, noise double, caps double, words array<string>, {', '.join(f'{c} double' for c in categories)}"

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [features(t) for t in b["text"]]
            out = pd.DataFrame({"fold": b["fold"].astype(int), "noise": [g[1] for g in got], "caps": [g[2] for g in got], "words": [sorted(g[0]) for g in got]})
            yield out.assign(**{c: b[c].astype(float) for c in categories})

    rows = store.table(sample.mapInPandas(extract, kinds), "labelled")
    vocabulary = vocabulary_of(rows, categories, most_words)
    kept = F.array_sort(F.filter("words", lambda w: w.isin(vocabulary) if vocabulary else F.lit(False)))
    indexed = rows.select("fold", "noise", "caps", *categories, F.array_join(kept, " ").alias("found")).toPandas()  # at most ``most_rows`` rows
    indexed = indexed.sort_values(list(indexed.columns), kind="stable", na_position="first")
    at = {w: i for i, w in enumerate(vocabulary)}
    x = np.zeros((len(indexed), len(at) + 2))
    for i, found in enumerate(indexed["found"]):
        x[i, [at[w] for w in found.split()]] = 1.0
    x[:, -2], x[:, -1] = indexed["noise"], indexed["caps"]
    weights, cuts = fit_chain(x, indexed["fold"].to_numpy(), [indexed[c].to_numpy(dtype=float) for c in categories])
    return Chain(list(categories), vocabulary, weights, cuts)


def score(docs: DataFrame, chain: Chain, column: str = "text") -> DataFrame:
    """``_row``, a struct of all columns of ``docs``, and ``_p``, one of the categories' probabilities, by whole texts."""
    kinds = ", ".join(f"{c} double" for c in chain.categories)
    probe = F.pandas_udf(chain.score, kinds)
    return docs.select(F.struct("*").alias("_row"), probe(F.col(column)).alias("_p"))


def categories_of(labels: DataFrame) -> DataFrame:
    """The chain's categories from the label table: poor text, toxic text, and both at once."""
    return labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("poor"), F.col("toxic").cast("int").alias("toxic"), ((F.col("quality") == 0) & (F.col("toxic") == 1)).cast("int").alias("poor_toxic"))


CATEGORIES = ["poor", "toxic", "poor_toxic"]


def judged(docs: DataFrame, labels: DataFrame, cut: float | None) -> DataFrame:
    chain = train(docs, categories_of(labels), CATEGORIES)
    cut = chain.cuts[CATEGORIES.index("toxic")] if cut is None else cut
    return score(docs, chain).withColumn("_toxic", (F.col("_p.toxic") >= cut) if chain.vocabulary else F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, cut: float | None = None) -> DataFrame:
    """Score documents and reject those whose toxic probability reaches ``cut``, by default the chain's own.

    Returns the documents' columns, p_poor, p_toxic, p_poor_toxic, and toxic;
    columns of the documents by these four names are replaced, all others stay.
    A null or empty text has no words; very long texts are read whole; a null
    label is unknown and teaches nothing; a null doc_id has no label; repeated
    and tied rows are scored alike; an empty table gives an empty result, an
    empty label table rejects nothing.
    """
    new = {f"p_{c}": F.col(f"_p.{c}") for c in CATEGORIES} | {"toxic": F.col("_toxic")}
    return judged(docs, labels, cut).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def clean(docs: DataFrame, labels: DataFrame, cut: float | None = None) -> DataFrame:
    """The documents that ``judge`` doesn't reject, with the columns they have, whatever their names."""
    return judged(docs, labels, cut).where("not _toxic").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
