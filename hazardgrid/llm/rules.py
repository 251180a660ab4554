"""Quality rules learned as a decision list by sequential covering.

Rules are conjunctions of thresholds on document counts and predict low quality; the default keeps.
A rule grows literal by literal by information gain on two thirds of the labelled rows, is pruned on
the other third, and is accepted if it holds there; covered rows leave and the next rule grows. Every
step is one aggregation of bucketed features, whatever the number of rows. The result is an ordered
Spark conditional expression.

Defined results: null and empty texts have zero counts and fail the base rule; without labelled rows,
or with labels of one kind, the list is empty and everything that passes the base rule is kept. Among
repeated labels of a document the largest counts. Unlabelled rows and null labels teach nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardgrid.llm.textstats import features, with_counts
from hazardgrid.session import cut_lineage

CUTS = 24
MAX_LITERALS = 3
MAX_RULES = 12
MIN_PRECISION = 0.9
#: A rule must cover this share of the low-quality rows that are left to be worth having.
MIN_COVER = 0.01


@dataclass(frozen=True)
class Literal:
    name: str
    above: bool
    cut: float

    def expression(self) -> Column:
        value = features_plus()[self.name]
        return value >= self.cut if self.above else value < self.cut


@dataclass
class DecisionList:
    """Ordered rules; the first that holds says low quality."""

    rules: list[list[Literal]] = field(default_factory=list)

    def number(self) -> Column:
        """Number of the first rule that holds, from 1; null if none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            cond = F.lit(True)
            for lit in rule:
                cond = cond & lit.expression()
            out = F.when(cond, k) if out is None else out.when(cond, k)
        return F.lit(None).cast("int") if out is None else out

    def text(self) -> list[str]:
        sign = {True: ">=", False: "<"}
        return [" AND ".join(f"{x.name} {sign[x.above]} {x.cut:.6g}" for x in r) for r in self.rules]


def features_plus() -> dict[str, Column]:
    return {**features(), "repeat_share": F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1))}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _holds(rule: list[tuple[str, bool, int]]) -> Column:
    cond = F.lit(True)
    for name, above, bucket in rule:
        cond = cond & ((F.col(name) >= bucket) if above else (F.col(name) < bucket))
    return cond


def learn(labelled: DataFrame) -> DecisionList:
    """``labelled``: count columns, ``doc_id`` and ``good`` (0/1)."""
    feats = features_plus()
    names = list(feats)
    rows = labelled.filter("good IN (0, 1)").select("doc_id", "good", *[c.alias(n) for n, c in feats.items()])
    probs = [k / CUTS for k in range(1, CUTS)]
    tail = [0.001, 0.005, 0.01, 0.02, 0.98, 0.99, 0.995, 0.999]
    points = sorted({*probs, *tail})
    cuts = rows.agg(
        *[F.percentile_approx(F.when(F.col("good") == g, F.col(n)), points, 2000).alias(f"{n}_{g}") for n in names for g in (0, 1)]
    ).first()
    edges = {n: sorted({x for g in (0, 1) for x in (cuts[f"{n}_{g}"] or [])}) for n in names}
    bucket = {
        n: (sum((F.when(F.col(n) >= e, 1).otherwise(0) for e in edges[n]), F.lit(0))).alias(n) for n in names
    }
    prune_row = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    bag = cut_lineage(rows.select("good", prune_row.alias("prune"), *bucket.values()))

    def totals(df: DataFrame) -> tuple[int, int]:
        got = df.agg(F.sum(1 - F.col("good")).alias("bad"), F.sum("good").alias("good")).first()
        return got.bad or 0, got.good or 0

    found, left, out = DecisionList(), F.lit(True), []
    all_bad, _ = totals(bag)
    for _ in range(MAX_RULES):
        grow, held = bag.filter(left & ~F.col("prune")), bag.filter(left & F.col("prune"))
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < MAX_LITERALS:
            pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("bucket")) for n in names])
            hist = grow.filter(_holds(rule)).select("good", F.inline(pairs)).groupBy("name", "bucket")
            hist = hist.agg(F.sum(1 - F.col("good")).alias("bad"), F.sum("good").alias("good")).collect()
            got = best_literal(hist, edges)
            if got is None:
                break
            rule.append(got[0])
            if got[1] == 0:
                break
        if not rule:
            break
        sums = []
        for k in range(1, len(rule) + 1):
            on = _holds(rule[:k])
            sums += [F.sum(F.when(on, 1 - F.col("good"))).alias(f"b{k}"), F.sum(F.when(on, F.col("good"))).alias(f"g{k}")]
        row = held.agg(*sums, F.sum(1 - F.col("good")).alias("bad")).first()
        worth = [((row[f"b{k}"] or 0), (row[f"g{k}"] or 0), k) for k in range(1, len(rule) + 1)]
        bad, good, k = max(worth, key=lambda w: ((w[0] - w[1]) / max(1, w[0] + w[1]), w[0], -w[2]))
        if bad < max(1, MIN_COVER * all_bad / 3) or bad < MIN_PRECISION * (bad + good):
            break
        out.append(rule[:k])
        left = left & ~_holds(rule[:k])
    found.rules = [[Literal(n, above, float(edges[n][b - 1])) for n, above, b in r] for r in out]
    return found


def best_literal(hist, edges) -> tuple[tuple[str, bool, int], int] | None:
    """Literal of most information gain over a histogram, and the good rows it still covers."""
    per: dict[str, dict[int, tuple[int, int]]] = {}
    for r in hist:
        per.setdefault(r.name, {})[r.bucket] = (r.bad, r.good)
    best = None
    for name, buckets in sorted(per.items()):
        bad, good = (sum(v[i] for v in buckets.values()) for i in (0, 1))
        if not bad or not good:
            continue
        was = math.log2(bad / (bad + good))
        for cut in range(1, len(edges[name]) + 1):
            up = [sum(v[i] for b, v in buckets.items() if b >= cut) for i in (0, 1)]
            for above, (p, n) in ((True, up), (False, (bad - up[0], good - up[1]))):
                if p:
                    gain = p * (math.log2(p / (p + n)) - was)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, (name, above, cut), n)
    return None if best is None else best[1:]


def best_labels(labels: DataFrame, column: str, name: str) -> DataFrame:
    return labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(column).alias(name))


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DecisionList]:
    """Every document's counts, ``base_failed``, ``rule`` (number or null) and ``kept``; and the list."""
    counts = cut_lineage(with_counts(docs.select("doc_id", "text"), repeats=True))
    found = learn(counts.join(best_labels(labels, "quality", "good"), "doc_id"))
    out = counts.withColumn("base_failed", base_failed()).withColumn("rule", found.number())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), found
