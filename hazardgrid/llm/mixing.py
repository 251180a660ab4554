"""Mixing to target weights through soft domain memberships.

A naive Bayes model, learned from a labelled table, gives every document a probability for each domain
from the words it contains. Document rates then solve a nonnegative least-squares problem: the expected
tokens of each domain, summed over rate x tokens x probability, shall equal the domain's target.
Projected gradient steps move the rates; a step needs one number per domain from all documents, which
is one aggregation, and the rates themselves stay distributed.

Everything is DataFrame expressions. The model is learned from at most ``MAX_ROWS`` labelled rows and has
at most ``MAX_WORDS`` words (documented bounds); memberships, totals and rates cover all documents.

Defined results: null and empty texts have no tokens, the prior's memberships and a rate like any other;
labels that are null teach nothing and among repeated labels of a document the least counts; a domain
that no label names cannot be a target; without any labelled text all domains are equally likely. An
empty table gives no rows. Repeated rows are documents of their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardgrid.llm.common import text_print, whole_row, words
from hazardgrid.llm.textstats import BANGS, CAPITALS, DIGITS, SYMBOLS, held
from hazardgrid.session import cut_lineage

MAX_ROWS = 20_000
MAX_WORDS = 400
#: Relative error of the domain totals at which the steps stop, and the most steps.
TOLERANCE = 1e-4
MAX_STEPS = 60
STEPS_PER_WRITE = 12
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0)


@dataclass
class Memberships:
    """Naive Bayes over the presence and absence of words: share of a domain's texts that hold each word."""

    domains: list[str]
    prior: list[float]
    lexicon: dict[str, list[float]]
    temperature: float = 1.0


def with_terms(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``n_tokens`` and ``_terms``: the lower-case words of a text, each once, and, as terms of
    their own, how far its make-up is from plain prose.

    The added terms begin with a separator, which no word can hold. The words are a column of their
    own first, so that they are cut once.
    """
    raw = F.lower(F.coalesce("text", F.lit("")))
    capitals = held(F.coalesce("text", F.lit("")), CAPITALS)
    counts = {"symbols": held(raw, SYMBOLS), "bangs": held(raw, BANGS), "digits": held(raw, DIGITS), "capitals": capitals}
    out = docs.select(*keep, words(raw).alias("_w"), *[c.alias(f"_{n}") for n, c in counts.items()])
    some = [*keep, *[f"_{n}" for n in counts]]
    out = out.select(*some, F.size("_w").cast("long").alias("n_tokens"), F.array_distinct("_w").alias("_d"))
    n = F.greatest("n_tokens", F.lit(1))
    makeup = {**{name: F.col(f"_{name}") / n for name in counts}, "sameness": 1 - F.size("_d") / n}
    step = lambda x: F.least(F.floor(x * 10), F.lit(10)).cast("string")
    extra = F.array(*[F.concat(F.lit(f" {name} "), step(x)) for name, x in makeup.items()])
    return out.select(*keep, "n_tokens", F.concat("_d", extra).alias("_terms"))


def learn_memberships(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> Memberships:
    """``labelled``: ``doc_id, domain``. Words are lower-case; a text counts a word once."""
    known = labelled.filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(MAX_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = cut_lineage(with_terms(rows, ["domain"]).select("domain", F.col("_terms").alias("w")))
    size = {r.domain: r["count"] for r in rows.groupBy("domain").count().collect()}
    total = sum(size.values())
    prior = [(size.get(d, 0) + 1) / (total + len(domains)) for d in domains]
    if not total:
        return Memberships(domains, prior, {})
    per = [F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"c{k}") for k, d in enumerate(domains)]
    seen = rows.select("domain", F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *per)
    spread = F.lit(0.0)
    for k, d in enumerate(domains):
        expected = F.col("n") * (size.get(d, 0) / total)
        spread = F.greatest(spread, (F.col(f"c{k}") - expected) / F.sqrt(expected + 1))
    best = seen.filter("n >= 5").orderBy(F.desc(spread), "word").limit(MAX_WORDS).collect()
    lexicon = {}
    for r in best:
        share = (r.n + 0.5) / (total + 1)
        lexicon[r.word] = [(r[f"c{k}"] + 2 * share) / (size.get(d, 0) + 2) for k, d in enumerate(domains)]
    model = Memberships(domains, prior, lexicon)
    model.temperature = best_temperature(rows, model)
    return model


def soften(rows: DataFrame, model: Memberships, keep: list[str]) -> DataFrame:
    """``keep, p0, p1, ...`` from ``keep`` and ``_h``, the lexicon words of each text.

    The words meet the broadcast lexicon (``MAX_WORDS`` rows at most) and are summed per row again;
    a row's words lie together, so the sums are made before the shuffle.
    """
    spark, k = rows.sparkSession, len(model.domains)
    absent = [sum(math.log(1 - q[i]) for q in model.lexicon.values()) for i in range(k)]
    base = [F.lit(math.log(p) + a / model.temperature) for p, a in zip(model.prior, absent)]
    gains = [(w, *(math.log(x / (1 - x)) for x in q)) for w, q in model.lexicon.items()]
    schema = "_word string, " + ", ".join(f"_g{i} double" for i in range(k))
    lexicon = spark.createDataFrame(gains, schema)
    each = rows.withColumn("_r", F.monotonically_increasing_id())
    each = each.select("_r", *keep, F.explode_outer("_h").alias("_word"))
    each = each.join(F.broadcast(lexicon), "_word", "left").groupBy("_r", *keep)
    out = each.agg(*[F.coalesce(F.sum(f"_g{i}"), F.lit(0.0)).alias(f"_g{i}") for i in range(k)])
    score = [base[i] + F.col(f"_g{i}") / model.temperature for i in range(k)]
    top = F.greatest(*score) if k > 1 else score[0]
    out = out.select(*keep, *[F.exp(s - top).alias(f"_e{i}") for i, s in enumerate(score)])
    total = sum((F.col(f"_e{i}") for i in range(k)), F.lit(0.0))
    return out.select(*keep, *[(F.col(f"_e{i}") / total).alias(f"p{i}") for i in range(k)])


def with_memberships(docs: DataFrame, model: Memberships, keep: list[str]) -> DataFrame:
    """``keep``, ``n_tokens`` and ``p0, p1, ...``, the memberships in the order of the domains."""
    lexicon = F.array(*[F.lit(w) for w in model.lexicon]).cast("array<string>")
    out = with_terms(docs, keep).select(*keep, "n_tokens", F.array_intersect("_terms", lexicon).alias("_h"))
    return soften(out, model, [*keep, "n_tokens"])


def best_temperature(rows: DataFrame, model: Memberships) -> float:
    """Divisor of the word evidence with the best likelihood on the labelled rows."""
    lexicon = F.array(*[F.lit(w) for w in model.lexicon]).cast("array<string>")
    held = cut_lineage(rows.select("domain", F.array_intersect("w", lexicon).alias("_h")))
    fits = []
    for t in TEMPERATURES:
        model.temperature = t
        soft = soften(held, model, ["domain"])
        hit = F.lit(1e-12)
        for k, d in enumerate(model.domains):
            hit = hit + F.when(F.col("domain") == d, F.col(f"p{k}")).otherwise(0.0)
        fits.append((soft.agg(F.sum(F.log(hit)).alias("x")).first().x, t))
    return max(fits)[1]


def fit_rates(soft: DataFrame, targets: list[float], max_rate: float | None = None) -> DataFrame:
    """``soft`` with ``rate``; ``targets``: wanted shares of the tokens, in the order of the domains.

    The token budget is what leaves the domain with the largest target at its present size. Totals are
    measured in units of the domains' present sizes; in that scaling the largest eigenvalue of the
    problem is at most 1 (memberships sum to 1), so unit steps converge.
    """
    k = len(targets)
    weight = F.col("n_tokens").cast("double")
    soft = cut_lineage(soft.withColumn("rate", F.lit(1.0)))
    sums = [F.coalesce(F.sum(weight * F.col(f"p{i}") * F.col("rate")), F.lit(0.0)).alias(f"t{i}") for i in range(k)]
    totals = list(soft.agg(*sums).first())
    share = [t / sum(targets) for t in targets]
    lead = max(range(k), key=lambda i: share[i])
    goal = [s * totals[lead] / share[lead] for s in share]
    unit = [max(t, 1e-9) for t in totals]
    rate, waiting = F.col("rate"), 0
    for _ in range(MAX_STEPS):
        gap = [(g - t) / u for g, t, u in zip(goal, totals, unit)]
        if max(abs(x) for x in gap) < TOLERANCE:
            break
        move = F.lit(0.0)
        for i in range(k):
            move = move + F.col(f"p{i}") * gap[i]
        rate = F.greatest(rate + move, F.lit(0.0))
        rate = rate if max_rate is None else F.least(rate, F.lit(max_rate))
        waiting += 1
        if waiting == STEPS_PER_WRITE:
            soft, rate, waiting = cut_lineage(soft.withColumn("rate", rate)), F.col("rate"), 0
        now = soft.agg(*[F.sum(weight * F.col(f"p{i}") * rate) for i in range(k)]).first()
        before, totals = totals, [x or 0.0 for x in now]
        if max(abs(a - b) / u for a, b, u in zip(before, totals, unit)) < TOLERANCE / 10:
            break  # the bound on the rates keeps the rest of the gap open
    return soft.withColumn("rate", rate)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], max_rate: float | None = None, keep=("doc_id",)) -> DataFrame:
    """``keep``, ``n_tokens``, ``p_<domain>`` and ``rate`` of every document."""
    domains = sorted(targets)
    model = learn_memberships(docs, labelled, domains)
    soft = with_memberships(docs, model, list(keep))
    out = fit_rates(soft, [targets[d] for d in domains], max_rate)
    return out.select(*keep, "n_tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)], "rate")


def keep_by_rate(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Documents that a draw at their rate (at most 1) keeps; rows equal in id and text share a draw."""
    same = docs.select("doc_id", "text", text_print().alias("_print"))
    found = mix(same, labelled, targets, max_rate=1.0, keep=("doc_id", "_print"))
    found = found.filter(copies(F.col("rate"), "doc_id", "_print") > 0)
    found = found.select(F.col("doc_id").alias("_id"), "_print").distinct()
    base = docs.select(whole_row(docs).alias("row"), "doc_id", "text")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_print() == F.col("_print"))
    return base.join(found, same, "left_semi").select("row.*")


def copies(rate: Column, *key: str | Column, seed: int = 29) -> Column:
    """Whole number of copies whose expectation is ``rate``, by a hash of the document's key."""
    draw = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return F.floor(rate + draw).cast("long")
