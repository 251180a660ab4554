"""Quality classifier from positive and unlabelled documents.

A linear model over document counts minimises the non-negative unbiased risk under the sigmoid loss
(bounded, so a small error of the prior cannot outweigh the rest): trusted positives (rows
labelled good) stand for the good class, unlabelled text stands for the mixture, and the class prior,
estimated from the two, says how much of the mixture is good. Where the estimated risk on the bad
class turns negative, its gradient is followed backwards. The prior is the least ratio of the tails
of the unlabelled and the positive score distribution, under a first model that tells the two apart.

Counting and scoring are column expressions over all texts. The fit uses at most ``MAX_ROWS``
positives and as many unlabelled rows (a documented bound), chosen by hash. Without positives every
score is 1, since nothing is known against any document. Null and empty texts are scored like any
other, from counts of zero. Repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardgrid.llm.common import whole_row
from hazardgrid.llm.textstats import features, with_counts

MAX_ROWS = 20_000
THRESHOLD = 0.7
STEPS = 1_500


def inputs() -> dict[str, Column]:
    """Bounded features: each share, and how far it goes beyond usual values."""
    f = features()
    log = lambda c: F.log1p(F.greatest(c, F.lit(0.0)))
    out = {
        "symbols": F.least(f["symbols_per_word"], F.lit(3.0)),
        "some_symbols": F.least(f["symbols_per_word"], F.lit(0.25)),
        "bangs": F.least(f["bangs_per_word"], F.lit(2.0)),
        "some_bangs": F.least(f["bangs_per_word"], F.lit(0.25)),
        "digits": f["digit_share"],
        "capitals": f["capital_share"],
        "some_capitals": F.least(f["capital_share"], F.lit(0.25)),
        "sameness": 1 - f["distinct_word_share"],
        "sameness_2": F.pow(1 - f["distinct_word_share"], F.lit(4.0)),
        "dup_lines": f["dup_line_share"],
        "word_chars": log(f["mean_word_chars"]),
        "line_words": log(f["words_per_line"]),
        "words": log(f["n_words"]),
    }
    return {k: F.coalesce(v, F.lit(0.0)) for k, v in out.items()}


@dataclass
class Model:
    names: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self) -> Column:
        """Probability of good quality from the count columns."""
        if not self.names:
            return F.lit(1.0)
        cols = inputs()
        total = F.lit(float(self.bias))
        for n, m, s, w in zip(self.names, self.mean, self.scale, self.weight):
            total = total + (cols[n] - float(m)) * float(w / s)
        return 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(60.0)), F.lit(-60.0))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _descend(gradient, dims: int, steps: int = STEPS, rate: float = 0.05) -> np.ndarray:
    """Adam from zero; ``gradient(w)`` returns the direction to follow downwards."""
    w, m, v = np.zeros(dims), np.zeros(dims), np.zeros(dims)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(pos: np.ndarray, mix: np.ndarray) -> float:
    """Share of positives in ``mix``: least ratio of upper score tails, which is smallest where only
    positives are left. Half of the positives train the separating model, the others measure it."""
    half = len(pos) // 2
    x = np.vstack((pos[:half], mix))
    y = np.concatenate((np.ones(half), np.zeros(len(mix))))
    weight = np.where(y == 1, len(mix) / max(1, half), 1.0)
    weight /= weight.sum()
    w = _descend(lambda w: x.T @ (weight * (_sigmoid(x @ w) - y)) + 1e-4 * w, x.shape[1], 300)
    p, u = np.sort(pos[half:] @ w), np.sort(mix @ w)
    cuts = np.quantile(p, np.linspace(0.0, 0.6, 61))
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    return float(np.clip((above_u / above_p).min(), 0.05, 0.999))


def fit(pos: np.ndarray, mix: np.ndarray, names: list[str], l2: float = 3e-4) -> Model:
    if not len(pos) or not len(mix):
        return Model([], np.empty(0), np.empty(0), np.empty(0), 0.0, 1.0)
    mean, scale = mix.mean(axis=0), mix.std(axis=0) + 1e-6
    one = lambda x: np.hstack(((x - mean) / scale, np.ones((len(x), 1))))
    p, u = one(pos), one(mix)
    prior = estimate_prior(p, u) if len(pos) > 1 else 0.5

    def gradient(w):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        up = prior * (p.T @ (sp * (1 - sp))) / len(p)
        bad = u.T @ (su * (1 - su)) / len(u) - up
        bad_risk = su.mean() - prior * sp.mean()
        return (bad - up if bad_risk >= 0 else -bad) + l2 * w

    w = _descend(gradient, p.shape[1])
    return Model(names, mean, scale, w[:-1], float(w[-1]), prior)


def held_out(part: int, of: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) == part


def _picked(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Inputs of at most ``MAX_ROWS`` documents, chosen by a hash of their ids."""
    cols = inputs()
    some = ids.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    some = some.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(MAX_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    got = with_counts(rows, repeats=False).orderBy("doc_id").select(*[c.alias(n) for n, c in cols.items()]).collect()
    return np.array([list(r) for r in got], float).reshape(-1, len(cols))


def train(docs: DataFrame, positives: DataFrame) -> Model:
    """``positives``: ids of trusted good documents; ``docs`` is the unlabelled mixture."""
    known = positives.select("doc_id").distinct()
    pos = _picked(docs, docs.select("doc_id").join(known, "doc_id", "left_semi"))
    return fit(pos, _picked(docs, docs), list(inputs()))


def trusted(labels: DataFrame, learn_from: Column | None = None) -> DataFrame:
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL")
    return good if learn_from is None else good.filter(learn_from)


def classify(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None) -> tuple[DataFrame, Model]:
    """Every document's counts and ``score``; labels are used where ``learn_from`` holds."""
    model = train(docs, trusted(labels, learn_from))
    return with_counts(docs.select("doc_id", "text"), repeats=False).withColumn("score", model.score()), model


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` that score at least ``threshold``, with all their columns."""
    model = train(docs, trusted(labels))
    rows = with_counts(docs.select(whole_row(docs).alias("row"), "text"), repeats=False)
    return rows.filter(model.score() >= threshold).select("row.*")
