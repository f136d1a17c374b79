"""Document quality by hierarchical empirical Bayes over sites.

Method: a linear classifier, fitted out of fold, gives each document's own
evidence. Grouped sums give every host, and every path within a host, counts of
good documents: a labelled document counts by its label, an unlabelled one by
its probability, weighted by how much of the labels' variance such
probabilities explain. A sparse host is shrunk toward the global rate and a
sparse path toward its host's, by beta-binomial strengths estimated from the
spread of children around their parents. A document's posterior odds are the
odds of its site, with the document itself left out, times the likelihood ratio
of its evidence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm import linear, store, text

#: Bound of training: labelled rows.
MOST_ROWS = 20_000
NAMES = ("log_words", "word_length", "noise", "capitals", "bars", "distinct", "line_words")
#: Folds of the classifier: a document is scored by the model that did not see its fold.
FOLDS = 3
#: Bounds of a strength, in documents, and of a probability.
LEAST, MOST, EDGE = 1.0, 1e4, 1e-6


def evidence(column: Column) -> Column:
    """The features of a whole text as a struct of doubles; DataFrame functions only."""
    whole = F.coalesce(column, F.lit(""))

    def of(x: Column) -> Column:
        n, c = F.greatest(F.size(x["w"]), F.lit(1)), F.greatest(x["c"], F.lit(1))
        without = lambda chars: F.length(F.translate(x["t"], chars, ""))
        return F.struct(
            F.log1p(F.size(x["w"]).cast("double")).alias("log_words"),
            (c / n).alias("word_length"),
            ((F.length(x["t"]) - without("#*$%&<>!")) / c * 10).alias("noise"),
            ((F.length(x["t"]) - F.length(F.regexp_replace(x["t"], r"\p{Lu}", ""))) / c * 5).alias("capitals"),
            ((F.length(x["t"]) - without("|")) / n).alias("bars"),
            (F.size(F.array_distinct(x["w"])) / n).alias("distinct"),
            F.log1p(n / (F.length(x["t"]) - without("\n") + 1)).alias("line_words"),
        )

    return text.let(F.struct(whole.alias("t"), text.words(whole).alias("w"), F.length(text.squeezed(whole)).alias("c")), of)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def clipped(p: Column) -> Column:
    return F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))


def fold_of(ident: Column) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(ident, F.lit(11)), F.lit(FOLDS)), F.lit(0))


@dataclass
class Model:
    """Weights by fold (over scaled features and their squares, the intercept last), and what the classifier is worth."""

    weights: list[np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    #: Share of good documents in the sample, and of the labels' variance that out-of-fold probabilities explain.
    base: float
    worth: float

    def score(self, e: str, fold: Column) -> Column:
        """The probability that a document is good, from its evidence and fold."""
        pick = lambda k: F.element_at(F.array(*[F.lit(float(w[k])) for w in self.weights]), (fold + 1).cast("int"))
        z, d = pick(-1), len(NAMES)
        for i, name in enumerate(NAMES):
            x = (F.col(f"{e}.{name}") - float(self.mean[i])) / float(self.scale[i])
            z = z + x * pick(i) + x * x * pick(d + i)
        return clipped(1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))


def train(rows: DataFrame, labels: DataFrame, most: int) -> Model:
    """Fit on up to ``most`` rows of labels (_id, y), chosen by the hash of the id."""
    picked = labels.orderBy(F.xxhash64("_id"), "_id").limit(most)
    got = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("y", fold_of(F.col("doc_id")).alias("fold"), "e.*").toPandas()  # at most ``most`` narrow rows
    got = got.sort_values(["y", "fold", *NAMES])
    x, y, fold = got[list(NAMES)].to_numpy(dtype=float).reshape(-1, len(NAMES)), got["y"].to_numpy(dtype=float), got["fold"].to_numpy()
    mean = x.mean(axis=0) if len(x) else np.zeros(len(NAMES))
    scale = x.std(axis=0) + 1e-9 if len(x) else np.ones(len(NAMES))
    both = np.hstack([(x - mean) / scale, ((x - mean) / scale) ** 2])
    weights = [linear.fit(both[fold != k], y[fold != k]) for k in range(FOLDS)]
    outside = np.zeros(len(y))
    for k, w in enumerate(weights):
        outside[fold == k] = linear.predict(both[fold == k], w)
    spread = ((y - y.mean()) ** 2).sum() if len(y) else 0.0
    worth = max(0.0, 1 - ((y - outside) ** 2).sum() / spread) if spread > 0 else 0.0
    return Model(weights, mean, scale, float((y.sum() + 0.5) / (len(y) + 1)), float(worth))


def strength(children: DataFrame, parent: list[str]) -> float:
    """Beta-binomial strength, in documents: how closely the rates of children (parent, n, good) lie around their parents' (method of moments)."""
    rate = F.col("good") / F.col("n")
    groups = children.where("n > 0").groupBy(*parent).agg(
        F.sum("n").alias("all"), F.sum("good").alias("sum"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum(F.col("n") * rate * rate).alias("second")
    )
    m = F.col("sum") / F.col("all")
    v = m * (1 - m)
    seen = F.col("second") - F.col("all") * m * m  # squared distances to the parent's rate
    chance, room = v * (F.col("k") - 1), v * (F.col("all") - F.col("squares") / F.col("all") - (F.col("k") - 1))
    got = groups.where("k > 1").agg(F.sum(seen - chance), F.sum(room)).first()
    if not got[1] or got[1] <= 0:
        return 10.0
    rho = float(np.clip((got[0] or 0.0) / got[1], 1 / (MOST + 1), 1 / (LEAST + 1)))
    return (1 - rho) / rho


def posteriors(scored: DataFrame, base: float, worth: float) -> DataFrame:
    """Add host_rate, path_rate and posterior to (host, path, p_doc, y), y being null where there is no label.

    ``base`` is the classifier's own prior, ``worth`` the weight of an unlabelled document's probability. Rates leave the row itself out.
    """
    own = F.when(F.col("y").isNotNull(), 1.0).otherwise(worth)
    scored = scored.withColumn("_w", own).withColumn("_g", own * F.coalesce(F.col("y").cast("double"), F.col("p_doc")))
    paths = store.table(scored.groupBy("host", "path").agg(F.round(F.sum("_w"), 6).alias("n"), F.round(F.sum("_g"), 6).alias("good")), "paths")
    hosts = store.table(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    total, good = hosts.agg(F.sum("n"), F.sum("good")).first()
    rate = min(1 - EDGE, max(EDGE, good / total if total else base))
    a, b = strength(hosts, []), strength(paths, ["host"])
    level = paths.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("n").alias("_np"), F.col("good").alias("_gp"))
    level = level.join(hosts.select(F.col("host").alias("_h"), F.col("n").alias("_nh"), F.col("good").alias("_gh")), F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    on = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    met = store.join_small(scored, store.table(level, "sites"), on)
    rest = lambda x: F.greatest(F.lit(0.0), x)  # noqa: E731  what rounding leaves may be a hair below zero
    met = met.withColumn("host_rate", (rest(F.col("_gh") - F.col("_g")) + a * rate) / (rest(F.col("_nh") - F.col("_w")) + a))
    met = met.withColumn("path_rate", (rest(F.col("_gp") - F.col("_g")) + b * F.col("host_rate")) / (rest(F.col("_np") - F.col("_w")) + b))
    odds = logit(clipped(F.col("path_rate"))) + logit(clipped(F.col("p_doc"))) - float(np.log(base / (1 - base)))
    return met.withColumn("posterior", 1 / (1 + F.exp(-odds))).drop("_host", "_path", "_np", "_gp", "_nh", "_gh", "_w", "_g")


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", label: str = "quality", cut: float = 0.5, most: int = MOST_ROWS) -> DataFrame:
    """The posterior quality of every document.

    Returns doc_id, p_doc (the text alone), host_rate and path_rate (shrunk, the
    document left out), posterior and kept (posterior >= ``cut``). Null hosts
    and paths are groups of their own; a null text is empty; very long texts
    are read whole; repeated rows are judged alike and each counts; a null label
    is none, of several labels the greatest counts; without labels every p_doc
    is one half and all is kept; other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    rows = store.table(docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), evidence(F.col("text")).alias("e")), "evidence")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = store.table(known, "labels")
    model = train(rows, known, most)
    scored = rows.select("doc_id", "host", "path", model.score("e", fold_of(F.col("doc_id"))).alias("p_doc"))
    scored = store.table(store.join_small(scored, known, F.col("doc_id") == F.col("_id")).drop("_id"), "scores")
    out = posteriors(scored, model.base, model.worth)
    return out.select("doc_id", "p_doc", "host_rate", "path_rate", "posterior", (F.col("posterior") >= cut).alias("kept"))
