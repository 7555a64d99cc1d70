"""Quality by positive-unlabelled learning.

Trusted positives are the labelled good documents of the training folds; all texts of these folds are the unlabelled ones.
Marks of bad documents are not read. The non-negative unbiased risk is minimised, with the logistic loss, over features of the
text alone: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)). The class prior is estimated from positives and unlabelled texts:
where a classifier that tells these apart is surest of positives, hardly any other text is found, so the share of the unlabelled
ones there, over that of the positives, is the prior. With the prior in the risk, 0.5 is the even point.

A bounded sample (POSITIVES, UNLABELLED) only gives bin edges, a starting point and the steps' scale. The prior comes from counts
over all rows, and each of PASSES steps goes down the gradient over all rows, which Spark sums: a few hundred numbers return.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bound_batches, fold, staged
from quadrille.llm.words import WordTable, long_column, text_runs, windows

#: Rows of each kind in the sample that gives the starting point; of more, those with the least hash are taken.
POSITIVES, UNLABELLED = 10_000, 20_000
#: Steps over all rows; thresholds at which the prior is read; the chance of error of its bounds; sums are exact in units of 1 / UNIT.
PASSES, LEVELS, DELTA, UNIT = 5, 100, 0.1, 1 << 20
FEATURES = ("log_words", "upper", "digits", "symbols", "pipes", "shouts", "punctuation", "other_bytes", "word_length", "distinct", "repeats", "dup_lines", "entropy", "line_words")
QUANTILES = (0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.97, 0.99)
STEPS, RATE = 300, 0.05
#: The ridge on weights: a constant, and a part that falls with the number of positives, as few of them say little.
RIDGE, RIDGE_EACH = 1e-3, 5.0
HELD_OUT = 1
FOLDS = 3


def features(texts: list[str], table: WordTable) -> np.ndarray:
    """A row of FEATURES per text; texts without words get zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.lower().split()
        if not words:
            continue
        n = len(words)
        byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        chars = n_bytes = len(raw)
        solid = max(1, n_bytes - int(byte[[32, 9, 10, 11, 12, 13]].sum()))
        index = table.indexes(words)
        hashes = table.hashes[index]
        triples = windows(hashes, 3)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        share = byte[byte > 0] / chars
        out[i] = (
            np.log1p(n), byte[65:91].sum() / solid, byte[48:58].sum() / solid, byte[[35, 36, 37, 38, 42, 60, 62, 64, 94, 126]].sum() / n, byte[124] / n, byte[33] / n, byte[[44, 46, 58, 59, 63]].sum() / n,
            byte[128:].sum() / solid, solid / n, len(np.unique(index)) / n, 1 - len(np.unique(triples)) / len(triples) if len(triples) else 0.0, 1 - len(set(lines)) / len(lines), -(share * np.log2(share)).sum(), np.log1p(n / len(lines)),
        )
        table.trim()
    return out


@dataclass(frozen=True)
class Model:
    """A linear model over binned and plain features. Without trusted positives every score is 0.5."""

    edges: tuple[np.ndarray, ...]
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return design(x, self.edges, self.mean, self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def design(x: np.ndarray, edges: tuple[np.ndarray, ...], mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """A constant, the plain features, and for each feature whether it is above each edge."""
    steps = [(x[:, [j]] > e[None, :]).astype(float) for j, e in enumerate(edges) if len(e)]
    return np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / spread, -5, 5), *steps])


@dataclass(frozen=True)
class Risk:
    """Sums over rows that the risk and its gradient consist of; they add up."""

    unlabelled: float
    positive: float
    loss_u: float  # of unlabelled rows as negatives
    loss_p: float  # of positives as negatives
    loss_good: float  # of positives as positives
    toward_u: np.ndarray
    toward_p: np.ndarray
    from_good: np.ndarray

    @staticmethod
    def of(x: np.ndarray, u: np.ndarray, p: np.ndarray, w: np.ndarray) -> Risk:
        """Of design rows, of which ``u`` are unlabelled and ``p`` positive."""
        z = x @ w
        up, s = np.logaddexp(0, z), sigmoid(z)
        return Risk(float(u.sum()), float(p.sum()), float(up[u].sum()), float(up[p].sum()), float((up - z)[p].sum()), x[u].T @ s[u], x[p].T @ s[p], x[p].T @ (1 - s[p]))

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.unlabelled, self.positive, self.loss_u, self.loss_p, self.loss_good], self.toward_u, self.toward_p, self.from_good])

    @staticmethod
    def unflat(v: np.ndarray) -> Risk:
        return Risk(*v[:5].tolist(), *np.split(v[5:], 3))

    def negative(self, prior: float) -> float:
        return self.loss_u / self.unlabelled - prior * self.loss_p / self.positive

    def value(self, prior: float) -> float:
        return prior * self.loss_good / self.positive + max(0.0, self.negative(prior))

    def ridge(self) -> float:
        return RIDGE + RIDGE_EACH / self.positive

    def gradient(self, prior: float, w: np.ndarray) -> np.ndarray:
        """Where the estimated negative risk is below zero, the step undoes that instead."""
        toward = self.toward_u / self.unlabelled - prior * self.toward_p / self.positive
        grad = -prior * self.from_good / self.positive + toward if self.negative(prior) >= 0 else -toward
        return grad + self.ridge() * np.append(0, w[1:])


def descended(w: np.ndarray, gradient) -> np.ndarray:
    """STEPS steps of Adam."""
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, STEPS + 1):
        grad = gradient(w)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def apart(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """A classifier of positives against unlabelled rows, whose scores only order rows by how sure positives are."""
    both = np.vstack([positive, unlabelled])
    edges = tuple(np.unique(np.quantile(both[:, j], QUANTILES)) for j in range(both.shape[1]))
    mean, spread = both.mean(0), both.std(0) + 1e-9
    p, u = design(positive, edges, mean, spread), design(unlabelled, edges, mean, spread)
    w = descended(np.zeros(p.shape[1]), lambda w: u.T @ sigmoid(u @ w) / len(u) - p.T @ sigmoid(-(p @ w)) / len(p) + (RIDGE + RIDGE_EACH / len(p)) * np.append(0, w[1:]))
    return Model(edges, mean, spread, w, 0.5)


def prior_of(above_u: np.ndarray, above_p: np.ndarray) -> float:
    """The class prior from the numbers of unlabelled rows and positives above each threshold; the first entries are those of all rows.

    The threshold is the one with the least upper bound, so few rows at the very top don't decide.
    """
    n_u, n_p = above_u[0], above_p[0]
    q_u, q_p = above_u / n_u, above_p / n_p
    slack = np.sqrt(np.log(4 / DELTA) / 2 / n_u) + np.sqrt(np.log(4 / DELTA) / 2 / n_p)
    seen = q_p > 0
    best = np.argmin((q_u[seen] + 1.01 * slack) / q_p[seen])
    return float(np.clip(q_u[seen][best] / q_p[seen][best], 0.02, 0.98))


def started(tells: Model, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[Model, np.ndarray]:
    """The model that minimises the risk on the sample, and the inverse curvature there."""
    p, u = (design(x, tells.edges, tells.mean, tells.spread) for x in (positive, unlabelled))
    x, is_u = np.vstack([u, p]), np.arange(len(u) + len(p)) < len(u)
    w = descended(np.zeros(x.shape[1]), lambda w: Risk.of(x, is_u, ~is_u, w).gradient(prior, w))
    s = sigmoid(u @ w)
    curve = (u * (s * (1 - s))[:, None]).T @ u / len(u) + (RIDGE + RIDGE_EACH / len(p)) * np.eye(len(w))
    return Model(tells.edges, tells.mean, tells.spread, w, prior), np.linalg.inv(curve)


def refined(model: Model, inverse: np.ndarray, risk) -> Model:
    """PASSES steps down the risk over all rows; ``risk`` gives its sums for some weights. A step that leads up is halved."""
    cost = lambda r, w: r.value(model.prior) + r.ridge() / 2 * float(w[1:] @ w[1:])
    w, rate = model.weights, 1.0
    now = risk(w)
    for _ in range(PASSES):
        at = w - rate * inverse @ now.gradient(model.prior, w)
        new = risk(at)
        if cost(new, at) < cost(now, w):
            w, now = at, new
        else:
            rate /= 2
    return Model(model.edges, model.mean, model.spread, w, model.prior)


def untrained() -> Model:
    k = len(FEATURES)
    return Model(tuple(np.empty(0) for _ in range(k)), np.zeros(k), np.ones(k), np.zeros(k + 1), 0.5)


def held_out(doc_id: Column) -> Column:
    return F.pmod(fold(doc_id), F.lit(FOLDS)) == HELD_OUT


def featured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, x (the features of the whole text), u (a row of the training folds), p (a trusted positive among them) of every row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordTable()
        for part in text_runs(batches):
            x = features(part["text"].where(part["text"].notna(), "").tolist(), table)
            yield pd.DataFrame({"doc_id": long_column(part["doc_id"]), "x": list(x)})

    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id", F.lit(True).alias("good"))
    rows = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, x array<double>").join(good, "doc_id", "left")
    learns = ~held_out(F.col("doc_id"))
    return rows.select("doc_id", "x", learns.alias("u"), (learns & F.coalesce("good", F.lit(False))).alias("p"))


def summed(table: DataFrame, numbers) -> np.ndarray:
    """The sum over tasks of the numbers that ``numbers(x, u, p)`` makes of rows. Sums of whole units have no order, so equal inputs give equal results."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in batches:
            if len(part):
                v = numbers(np.stack(part["x"]), part["u"].to_numpy(bool), part["p"].to_numpy(bool))
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total), dtype=np.int32), "v": np.rint(total * UNIT).astype(np.int64)})

    rows = table.filter("u").select("x", "u", "p").mapInPandas(run, "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).toArrow().to_pandas().sort_values("i")
    return rows["v"].to_numpy(np.int64) / UNIT


def trained(table: DataFrame) -> Model:
    """Fit on the rows of ``featured``."""
    sample = lambda which, n: table.filter(which).select("x", F.xxhash64("doc_id", "x").alias("h")).orderBy("h").limit(n).toArrow().to_pandas()
    positive, unlabelled = (sample(*x) for x in (("p", POSITIVES), ("u", UNLABELLED)))
    if not len(positive):
        return untrained()
    positive, unlabelled = (np.stack(x["x"]) for x in (positive, unlabelled))
    spark = table.sparkSession
    half = F.pmod(F.xxhash64("doc_id", "x", F.lit("half")), F.lit(2))
    priors = []
    for fold_ in (0, 1):  # told apart on one half, read on the other
        p, u = (sample(F.expr(which) & (half == fold_), n) for which, n in (("p", POSITIVES), ("u", UNLABELLED)))
        if not len(p):
            continue
        tells = apart(np.stack(p["x"]), np.stack(u["x"]))
        levels = np.append(-np.inf, np.unique(np.quantile(tells.margin(np.stack(p["x"])), np.linspace(0, 0.99, LEVELS))))
        held = spark.sparkContext.broadcast((tells, levels))

        def above(x: np.ndarray, u: np.ndarray, p: np.ndarray, held=held) -> np.ndarray:
            tells, levels = held.value
            z = np.sort(tells.margin(x)), np.sort(tells.margin(x[p]))
            return np.concatenate([len(v) - np.searchsorted(v, levels) for v in z]).astype(float)

        counts = np.split(summed(table.filter(half != fold_), above), 2)
        if len(counts[1]) and counts[1][0]:
            priors.append(prior_of(*counts))
    prior = float(np.mean(priors)) if priors else 0.5
    tells = apart(positive, unlabelled)
    start, inverse = started(tells, positive, unlabelled, prior)

    def risk(w: np.ndarray) -> Risk:
        sent = spark.sparkContext.broadcast((start, w))

        def sums(x: np.ndarray, u: np.ndarray, p: np.ndarray) -> np.ndarray:
            model, w = sent.value
            return Risk.of(design(x, model.edges, model.mean, model.spread), u, p, w).flat()

        return Risk.unflat(summed(table, sums))

    return refined(start, inverse, risk)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its whole text (null: empty). Texts are read once, for their features.

    Repeated rows repeat; an empty table gives none; without positives every score is 0.5.
    """
    table = staged(featured(docs, labels), "op4-features")
    held = docs.sparkSession.sparkContext.broadcast(trained(table))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(np.stack(x)) if len(x) else np.empty(0))

    return table.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("x").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier takes as good, with their columns. Null and empty texts are scored like others; repeated rows stay or go together."""
    held = docs.sparkSession.sparkContext.broadcast(trained(staged(featured(docs, labels), "op4-features")))

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        table = WordTable()
        return pd.Series(held.value.score(features(texts.where(texts.notna(), "").tolist(), table)) >= 0.5)

    return docs.filter(good("text"))
