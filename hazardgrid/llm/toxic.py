"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme-value theory.

Token log-odds between toxic and other labelled documents come from counts under an informative
Dirichlet prior (the pooled token frequencies). A text counts a token once, and copies of a text
count once. Tokens, and five- to seven-letter beginnings for tokens that are not telling by
themselves, enter the lexicon if they are significantly more frequent in toxic texts; all others share
one small negative score. A linear scan finds every maximal scoring segment of a text. Scores of
chance segments in a text of n tokens follow an extreme-value law with parameters lambda and K, so a
segment of score S is significant if K n exp(-lambda S) is small. The excess of the significant
segments over what chance would give is mapped to a probability on the labelled rows.

Counting is a Spark aggregation over at most ``MAX_ROWS`` labelled rows (a documented bound), the scan
runs in tasks over whole texts. Null and empty texts have no segment and get the score of a text
without any. Without labelled rows of both kinds every score is 0. Null labels teach nothing; among repeated
labels the largest counts. Repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardgrid.llm.common import python_ready
from hazardgrid.session import cut_lineage

MAX_ROWS = 20_000
MAX_LEXICON = 20_000
#: Weight of the Dirichlet prior as a share of all tokens.
PRIOR_SHARE = 0.01
#: A token enters the lexicon if its count among toxic texts lies so many standard deviations above
#: what its pooled count would give, and it was seen in so many toxic texts.
MIN_Z = 5.0
MIN_TEXTS = 5
STARTS = (7, 6, 5)
#: Expected number of chance segments up to which a segment is significant.
MAX_EXPECTED = 0.05
THRESHOLD = 0.7
TOKEN = re.compile(r"[^\W\d_]+")
MEMORY = 400_000


@dataclass
class Lexicon:
    scores: dict[str, float]  # words, and "^" + beginnings
    other: float
    lam: float
    k: float
    slope: float = 1.0
    offset: float = 0.0

    def score_of(self, token: str) -> float:
        if token in self.scores:
            return self.scores[token]
        for n in STARTS:
            if len(token) >= n and "^" + token[:n] in self.scores:
                return self.scores["^" + token[:n]]
        return self.other


def maximal_segments(scores) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of a sequence, in one pass.

    Candidate segments wait in a list with the running sums before and after them. A new one joins the
    nearest earlier candidate that starts lower, unless that one already ends higher. The search for
    it follows links to the next lower start, so the whole scan is linear.
    """
    held: list[list] = []  # start, end, sum before, sum after, place of the nearest lower start
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total, -1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]
            if j < 0 or held[j][3] >= new[3]:
                new[4] = j
                held.append(new)
                break
            new = [held[j][0], new[1], held[j][2], new[3], -1]
            del held[j:]
    return [(a, b, y - x) for a, b, x, y, _ in held]


def scan(tokens: list[float] | np.ndarray, other: float) -> list[tuple[int, int, float]]:
    """Segments of a text given its token scores: stretches of ``other`` tokens enter as one score."""
    x = np.asarray(tokens, float)
    hits = np.flatnonzero(x != other)
    if not len(hits):
        return []
    gaps = np.diff(np.concatenate(([-1], hits))) - 1
    mixed = np.empty(2 * len(hits))
    mixed[0::2], mixed[1::2] = gaps * other, x[hits]
    return [(int(hits[a // 2]), int(hits[(b - 1) // 2]) + 1, s) for a, b, s in maximal_segments(mixed.tolist())]


def excess(segments, n_tokens: int, lex: Lexicon) -> tuple[float, int]:
    """Sum of the significant segments' scores beyond the chance level, and their number.

    The chance level of a text is ln(K n) / lambda, the mode of the largest chance segment. Without a
    significant segment the largest one counts with its shortfall.
    """
    if not segments:
        return -math.log(lex.k * max(1, n_tokens)), 0
    level = math.log(lex.k * max(1, n_tokens))
    norm = [lex.lam * s - level for *_, s in segments]
    good = [x for x in norm if x >= -math.log(MAX_EXPECTED)]
    return (sum(good), len(good)) if good else (max(norm), 0)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(MAX_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return rows.groupBy("text").agg(F.max("toxic").alias("toxic"))  # copies teach once


def learn_log_odds(rows: DataFrame) -> Lexicon | None:
    """Lexicon from ``text, toxic``; None without rows of both kinds."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[\\p{L}]+"), F.lit(0))
    seen = rows.select("toxic", F.explode(F.array_distinct(tokens)).alias("w")).groupBy("w").agg(
        F.sum("toxic").alias("t"), F.count("*").alias("n")
    )
    seen = cut_lineage(seen)
    total = seen.agg(F.sum("t").alias("t"), F.sum("n").alias("n")).first()
    if not total.t or total.n == total.t:
        return None
    nt, nn = float(total.t), float(total.n - total.t)
    begins = [F.when(F.length("w") >= k, F.concat(F.lit("^"), F.substring("w", 1, k))) for k in STARTS]
    grams = seen.select(F.explode(F.array("w", *begins)).alias("g"), "t", "n").filter("g IS NOT NULL")
    grams = grams.groupBy("g").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    a, prior = F.lit(PRIOR_SHARE) * F.col("n"), PRIOR_SHARE * (nt + nn)
    yt, yn = F.col("t") + a, F.col("n") - F.col("t") + a
    odds = F.log(yt / (nt + prior - yt)) - F.log(yn / (nn + prior - yn))
    share = nt / (nt + nn)
    z = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    kept = grams.select("g", "t", "n", odds.alias("odds"), z.alias("z"))
    kept = kept.filter((F.col("z") >= MIN_Z) & (F.col("odds") >= 1) & (F.col("t") >= MIN_TEXTS))
    kept = kept.orderBy(F.desc("z"), "g").limit(MAX_LEXICON).collect()
    scores = {r.g: float(r.odds) for r in kept}
    ft = min(0.5, sum(r.t for r in kept if r.g[0] != "^") / nt)
    fn = min(0.5, sum(r.n - r.t for r in kept if r.g[0] != "^") / nn)
    other = min(-0.01, math.log((1 - ft) / (1 - fn)))
    return Lexicon(scores, other, 1.0, 1.0)


class Scorer:
    """Token scores of one lexicon with a bounded memory of tokens seen."""

    def __init__(self, lex: Lexicon):
        self.lex, self.held = lex, {}

    def tokens(self, text: str | None) -> np.ndarray:
        parts = TOKEN.findall((text or "").lower())
        new = set(parts).difference(self.held)
        if new:
            if len(self.held) + len(new) > MEMORY:
                self.held.clear()
                new = set(parts)
            self.held.update((t, self.lex.score_of(t)) for t in new)
        return np.fromiter(map(self.held.__getitem__, parts), float, len(parts))

    def passages(self, text: str | None) -> tuple[float, int, int]:
        x = self.tokens(text)
        total, n = excess(scan(x, self.lex.other), len(x), self.lex)
        return total, n, len(x)


def calibrate(lex: Lexicon, sample: list[tuple[str, int]]) -> Lexicon:
    """lambda, K from the largest segments of the clean texts, then the map to a probability.

    With log-odds scores lambda is 1 in theory; the clean texts' largest segments give K by the mean
    of the extreme-value law. K never falls below 1, the value for independent starts at every token.
    """
    scorer = Scorer(lex)
    read = [(scorer.tokens(t), y) for t, y in sample]
    tops = [(max((s for *_, s in scan(x, lex.other)), default=0.0), max(1, len(x))) for x, y in read if y == 0]
    fits = [lex.lam * s - math.log(n) for s, n in tops if s > 0]
    if len(fits) >= 30:
        lex.k = max(1.0, math.exp(float(np.mean(fits)) - 0.5772) * len(fits) / len(tops))
    x = np.array([excess(scan(t, lex.other), len(t), lex)[0] for t, _ in read])
    y = np.array([y for _, y in read], float)
    x = np.clip(x, -20, 60)
    lex.slope, lex.offset = 1.0, 0.0
    mean, scale = x.mean(), x.std() + 1e-9
    a, b = 0.0, 0.0
    u = (x - mean) / scale
    for _ in range(60):  # Newton steps of a logistic curve with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -50, 50)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * u).sum() + 1e-2 * a, (p - y).sum()])
        h = np.array([[(w * u * u).sum() + 1e-2, (w * u).sum()], [(w * u).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    lex.slope, lex.offset = float(a / scale), float(b - a * mean / scale)
    return lex


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon | None:
    rows = cut_lineage(_labelled(docs, labels))
    lex = learn_log_odds(rows)
    if lex is None:
        return None
    per_class = MAX_ROWS // 10
    order = F.xxhash64("text", F.lit(9))
    sample = []
    for y in (0, 1):
        got = rows.filter(F.col("toxic") == y).orderBy(order).limit(per_class).select("text").collect()
        n = rows.filter(F.col("toxic") == y).count()
        sample.append((got, y, n))
    flat = [(r.text, y) for got, y, _ in sample for r in got]
    return calibrate(lex, flat)


def score(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """``doc_id, score, n_passages, excess`` of every document."""
    spark = docs.sparkSession
    python_ready(spark)
    lex = learn(docs, labels if learn_from is None else labels.filter(learn_from))
    if lex is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("n_passages"), F.lit(0.0).alias("excess"))
    sent = spark.sparkContext.broadcast(lex)  # at most MAX_LEXICON entries

    @F.pandas_udf("score double, n_passages int, excess double")
    def of(texts: pd.Series) -> pd.DataFrame:
        scorer = Scorer(sent.value)
        got = [scorer.passages(t)[:2] for t in texts]
        x = np.clip(np.array([g[0] for g in got], float), -20, 60)
        p = 1 / (1 + np.exp(-np.clip(lex_slope * x + lex_offset, -50, 50)))
        return pd.DataFrame({"score": p, "n_passages": [g[1] for g in got], "excess": x})

    lex_slope, lex_offset = lex.slope, lex.offset
    return docs.select("doc_id", of("text").alias("o")).select("doc_id", "o.*")
