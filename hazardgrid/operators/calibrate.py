"""Scores of probabilities and recalibration maps; every score takes grouping keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardgrid.operators.asof import asof_join, quantile_bucket_of
from hazardgrid.operators.common import STATS_ROWS, as_list, literal_array, salted_join
from hazardgrid.operators.ensemble import CELL, member_totals, weighted_arrivals
from hazardgrid.session import cut_lineage, ship_package


def brier(p: Column, y: Column) -> Column:
    """Aggregate: mean squared error."""
    d = p - y.cast("double")
    return F.avg(d * d)


def bin_index(p: Column, n_bins: int = 10) -> Column:
    """Bin from 0; a lower edge belongs to its bin and 1.0 to the last one."""
    edges = np.linspace(0.0, 1.0, n_bins + 1)[1:-1]
    return F.size(F.filter(literal_array([float(e) for e in edges]), lambda e: p >= e))


def reliability_curve(df: DataFrame, keys, p: str = "p", y: str = "y", n_bins: int = 10) -> DataFrame:
    """Mean prediction and outcome share per bin; an empty bin has count 0 and NULL means."""
    keys = as_list(keys)
    filled = df.groupBy(*keys, bin_index(F.col(p), n_bins).alias("bin")).agg(
        F.avg(p).alias("pred_mean"), F.avg(F.col(y).cast("double")).alias("obs_freq"), F.count("*").alias("n")
    )
    slots = filled.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return slots.join(filled, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(curve: DataFrame, keys) -> DataFrame:
    gap = F.abs(F.col("pred_mean") - F.col("obs_freq"))
    return curve.groupBy(*as_list(keys)).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def ensemble_crps(arrivals: DataFrame, members: DataFrame, truth: DataFrame, horizon: float) -> DataFrame:
    """Mean CRPS of the arrival ensemble per event over cells the truth reached by twice the horizon.

    A member that never arrives counts as four horizons. The pair term uses running weights of the
    sorted arrivals of a cell instead of all pairs of members.
    """
    never = 4.0 * horizon
    scored = truth.filter(F.col("truth_min") <= 2 * horizon).select(*CELL, F.col("truth_min").alias("y"))
    rows = weighted_arrivals(arrivals, members).join(scored.select(*CELL), CELL, "left_semi")
    seen = rows.select(*CELL, F.col("arrival_min").alias("x"), "weight")
    held = seen.groupBy(*CELL).agg(F.sum("weight").alias("_s"))
    rest = salted_join(scored.join(held, CELL, "left"), member_totals(members), "fire_id", ["i", "j"])
    rest = rest.select(
        *CELL, F.lit(never).alias("x"), (F.col("_total") - F.coalesce("_s", F.lit(0.0))).alias("weight"), "_total", "y"
    )
    atoms = seen.join(rest.select(*CELL, "_total", "y"), CELL).unionByName(rest)
    atoms = atoms.withColumn("w", F.col("weight") / F.col("_total"))
    upto = F.sum("w").over(
        Window.partitionBy(*CELL).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    per_cell = atoms.withColumn("_c", upto).groupBy(*CELL).agg(
        F.sum(F.col("w") * F.abs(F.col("x") - F.col("y"))).alias("_t1"),
        F.sum(F.col("w") * F.col("x") * (F.col("_c") * 2 - F.col("w") - 1)).alias("_t2"),
    )
    return per_cell.groupBy("fire_id").agg(F.avg(F.col("_t1") - F.col("_t2")).alias("crps"))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def temperature_scale(p: Column, t: Column) -> Column:
    return F.lit(1.0) / (F.exp(-logit(p) / t) + 1.0)


def fit_temperature(df: DataFrame, keys, p: str = "p", y: str = "y", steps=(0.1, 0.002)) -> DataFrame:
    """Temperature per key with the least log loss, ``exp`` of a point in [-3, 3].

    The rows are reduced to counts per distinct p once; each stage then scores a grid of candidates
    round the best of the stage before, one sum per candidate, so rows are not multiplied.
    """
    keys = as_list(keys)
    counts = df.groupBy(*keys, F.col(p).alias("p")).agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("s")
    )
    best = counts.select(*keys).distinct().withColumn("log_t", F.lit(0.0))
    reach = 3.0
    for step in steps:
        k = round(reach / step)

        def loss(shift):
            q = temperature_scale(F.col("p"), F.exp(F.col("log_t") + shift))
            q = F.least(F.greatest(q, F.lit(1e-9)), F.lit(1 - 1e-9))
            return -(F.col("s") * F.log(q) + (F.col("n") - F.col("s")) * F.log(1 - q))

        shifts = [g * step for g in range(-k, k + 1)]
        sums = [F.sum(loss(x)).alias(f"l{i}") for i, x in enumerate(shifts)]
        scored = counts.join(best, keys).groupBy(*keys, "log_t").agg(F.sum("n").alias("n"), *sums)
        tried = F.array(*[F.struct((F.col("log_t") + x).alias("at"), F.round(F.col(f"l{i}") / F.col("n"), 12).alias("nll")) for i, x in enumerate(shifts)])
        tried = F.filter(tried, lambda t: F.abs(t["at"]) <= 3.0 + 1e-9)
        least = F.array_min(F.transform(tried, lambda t: F.struct(t["nll"].alias("nll"), t["at"].alias("at"))))
        best = scored.select(*keys, least["at"].alias("log_t"))
        reach = step
    return best.select(*keys, F.exp("log_t").alias("temperature"))


def _pooled(fresh: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjacent violators pooled: positions of the first rows of the blocks, their counts and sums.

    ``fresh`` marks rows that begin a new key. Falling runs are merged all at once while that pays; what is
    left goes over a stack. Equal neighbours stay apart.
    """
    at = np.arange(len(n))
    while len(at) > 1:
        bad = (s[:-1] * n[1:] > s[1:] * n[:-1]) & ~fresh[1:]
        first = np.flatnonzero(np.r_[True, ~bad])
        if len(first) > 0.9 * len(at):
            break
        at, fresh, n, s = at[first], fresh[first], np.add.reduceat(n, first), np.add.reduceat(s, first)
    else:
        return at, n, s
    if len(first) == len(at):
        return at, n, s
    out: list[list] = []
    for row in zip(at.tolist(), fresh.tolist(), n.tolist(), s.tolist()):
        out.append(list(row))
        while len(out) > 1 and not out[-1][1] and out[-2][3] * out[-1][2] > out[-1][3] * out[-2][2]:
            _, _, n2, s2 = out.pop()
            out[-1][2] += n2
            out[-1][3] += s2
    return np.array([o[0] for o in out]), np.array([o[2] for o in out]), np.array([o[3] for o in out])


def _pool_frame(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Blocks of rows that are sorted by keys and ``lo``."""
    if pdf.empty:
        return pdf
    fresh = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
    at, n, s = _pooled(fresh, pdf["n"].to_numpy(float), pdf["s"].to_numpy(float))
    return pdf.iloc[at].assign(n=n, s=s)


def _range_hulls(blocks: DataFrame, keys: list[str], ranges: int | None) -> DataFrame:
    """Blocks dealt by ranges of (keys, lo), each range pooled by itself; ``_range`` numbers the ranges."""
    order = [F.col(k) for k in [*keys, "lo"]]
    dealt = blocks.repartitionByRange(ranges, *order) if ranges else blocks.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())

    def pool_range(batches):
        held, rows, limit = [], 0, 200_000
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows > limit:
                held = [_pool_frame(pd.concat(held), keys)]
                rows = len(held[0])
                limit = max(limit, 2 * rows)
        if held:
            yield _pool_frame(pd.concat(held), keys)

    return cut_lineage(dealt.mapInPandas(pool_range, dealt.schema))


#: Slopes tried at once for a bridge.
BRIDGE_TRIES = 15


def _narrow_bridges(rows: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges ``(_a, _b)`` closer to the slope of each pair's bridge.

    At a slope c the excess is the sum of ``s - c n`` over left blocks steeper than c and right blocks flatter
    than c. It falls with c and is zero at the bridge, so one conditional sum per tried slope tells on which
    side of it the bridge lies. Slopes are quantiles of those still open; an excess of zero settles the pair.
    """
    inside = rows.join(edges, by).filter("_v > _a AND _v < _b")
    shares = [(k + 1) / (BRIDGE_TRIES + 1) for k in range(BRIDGE_TRIES)]
    tries = inside.groupBy(*by).agg(F.percentile_approx("_v", shares, 10_000).alias("_c"))
    asked = rows.join(edges.join(tries, by, "left"), by)

    def over(value: str, k: int) -> Column:
        c = F.get("_c", F.lit(k))
        return F.sum(F.when(F.col("_right") == (F.col("_v") < c), F.col(value)))

    sums = [over(v, k).alias(f"{v}{k}") for v in ("n", "s") for k in range(BRIDGE_TRIES)]
    scored = asked.groupBy(*by).agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.any_value("_c").alias("_c"), *sums)
    tried = F.array(
        *[
            F.struct(
                F.get("_c", F.lit(k)).alias("c"),
                (F.col(f"s{k}") - F.get("_c", F.lit(k)) * F.col(f"n{k}")).alias("g"),
                ((F.abs(f"s{k}") + F.abs(F.get("_c", F.lit(k)) * F.col(f"n{k}"))) * 1e-13).alias("eps"),
            )
            for k in range(BRIDGE_TRIES)
        ]
    )
    below = F.array_max(F.transform(F.filter(tried, lambda t: t["g"] > t["eps"]), lambda t: t["c"]))
    above = F.array_min(F.transform(F.filter(tried, lambda t: t["g"] < -t["eps"]), lambda t: t["c"]))
    exact = F.array_min(F.transform(F.filter(tried, lambda t: F.abs(t["g"]) <= t["eps"]), lambda t: t["c"]))
    return cut_lineage(
        scored.select(
            *by,
            F.coalesce(exact, F.greatest("_a", below)).alias("_a"),
            F.coalesce(exact, F.least("_b", above)).alias("_b"),
        )
    )


def _merge_hulls(blocks: DataFrame, keys: list[str], level: int, open_rows: int) -> DataFrame:
    """Hulls of ``2 ** level`` ranges joined with their right neighbours.

    The merged hull keeps the left blocks flatter than the bridge, the right blocks steeper than it, and one
    block for all between. Its slope lies strictly between the first slope on the right and the last on the
    left; these edges move inwards until a pair has at most ``open_rows`` undecided blocks, and only those
    meet in a task. Blocks known to lie under the bridge are one sum.
    """
    by = [*keys, "_pair"]
    rows = blocks.withColumns(
        {
            "_pair": F.shiftright("_range", level + 1),
            "_right": F.shiftright("_range", level).bitwiseAND(F.lit(1)) == 1,
            "_v": F.col("s") / F.col("n"),
        }
    )
    edges = rows.groupBy(*by).agg(F.min(F.when(F.col("_right"), F.col("_v"))).alias("_a"),
                                  F.max(F.when(~F.col("_right"), F.col("_v"))).alias("_b"))
    edges = cut_lineage(edges.filter("_a < _b"))
    pairs = edges.count()
    if not pairs:
        return blocks

    def hinted(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if pairs <= STATS_ROWS else df

    while True:
        inside = rows.join(hinted(edges), by).filter("_v > _a AND _v < _b")
        widest = inside.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        if widest <= open_rows:
            break
        edges = _narrow_bridges(rows, edges, by)
    met = rows.join(hinted(edges), by, "left")
    stays = F.when(F.col("_right"), F.col("_v") >= F.col("_b")).otherwise(F.col("_v") <= F.col("_a"))
    undecided = (F.col("_v") > F.col("_a")) & (F.col("_v") < F.col("_b"))
    names = blocks.columns
    kept = met.filter(F.col("_a").isNull() | stays).select(*names)
    under = met.filter(~stays & ~undecided).groupBy(*by).agg(
        F.min("lo").alias("lo"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("_range").alias("_range")
    )
    asked = met.filter(undecided).select(*names, "_pair").unionByName(under.select(*names, "_pair"))
    merged = asked.groupBy(*by).applyInPandas(
        lambda pdf: _pool_frame(pdf.sort_values("lo"), keys)[names], blocks.schema
    )
    return cut_lineage(kept.unionByName(merged))


def isotonic_fit(
    df: DataFrame, keys, p: str = "p", y: str = "y", ranges: int | None = None, open_rows: int = 100_000
) -> DataFrame:
    """Knots ``(keys, x, fitted)`` of the non-decreasing least-squares map from p to outcome.

    The fitted values are the slopes of the greatest convex minorant of the cumulative sums along p. Rows
    are reduced to counts per distinct p and dealt by ranges; each range gives its own hull, and
    neighbouring hulls are merged in rounds, all keys and pairs of a round at once. Nothing of it passes the
    driver but two counts a round, and no task holds more than a range or ``open_rows`` blocks. Blocks with
    equal means stay apart. Rows without p or y take no part; keys are not NULL; no rows give no knots.
    """
    keys = as_list(keys)
    ship_package(df.sparkSession)
    blocks = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(p).cast("double").alias("lo")).agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("s")
    )
    blocks = _range_hulls(blocks, keys, ranges)
    last = blocks.agg(F.max("_range")).first()[0] or 0
    level = 0
    while last >> level:
        blocks = _merge_hulls(blocks, keys, level, open_rows)
        level += 1
    return blocks.select(*keys, F.col("lo").alias("x"), (F.col("s") / F.col("n")).alias("fitted"))


def isotonic_apply(df: DataFrame, knots: DataFrame, keys, p: str = "p", out: str = "p_cal") -> DataFrame:
    """Linear interpolation between knots, flat beyond the ends; distinct p are looked up once."""
    keys = as_list(keys)
    along = Window.partitionBy(*keys).orderBy("x")
    spans = knots.withColumn("x2", F.lead("x").over(along)).withColumn("f2", F.lead("fitted").over(along))
    ends = knots.groupBy(*keys).agg(F.min_by("fitted", "x").alias("_floor"))
    asked = cut_lineage(df.select(*keys, p).distinct())
    hit = asof_join(asked, spans, keys, p, "x", ["x", "fitted", "x2", "f2"], quantile_bucket_of(asked, p))
    slope = (F.col("f2") - F.col("fitted")) / (F.col("x2") - F.col("x"))
    value = F.when(F.col("x").isNull(), F.col("_floor")).when(
        F.col("x2").isNull(), F.col("fitted")
    ).otherwise(F.col("fitted") + slope * (F.col(p) - F.col("x")))
    mapped = hit.join(ends, keys).select(*keys, p, value.alias(out))
    return df.join(mapped, [*keys, p])


def calibration_block(df: DataFrame, keys) -> DataFrame:
    """Raw and temperature-scaled Brier and calibration error per key, from ``p`` and ``y``."""
    keys = as_list(keys)
    fitted = fit_temperature(df, keys)
    counts = df.groupBy(*keys, "p").agg(
        F.count("*").alias("n"), F.sum(F.col("y").cast("double")).alias("s")
    )
    both = counts.join(fitted, keys).withColumn("q", temperature_scale(F.col("p"), F.col("temperature")))

    def score(value: str, name: str) -> DataFrame:
        v = F.col(value)
        se = F.col("n") * v * v - F.col("s") * v * 2 + F.col("s")
        bins = both.groupBy(*keys, bin_index(v).alias("_bin")).agg(
            F.sum(se).alias("_se"), F.sum("n").alias("_n"), F.abs(F.sum(F.col("n") * v) - F.sum("s")).alias("_gap")
        )
        return bins.groupBy(*keys).agg(
            (F.sum("_se") / F.sum("_n")).alias(f"brier_{name}"),
            (F.sum("_gap") / F.sum("_n")).alias(f"ece_{name}"),
        )

    return fitted.join(score("p", "raw"), keys).join(score("q", "calibrated"), keys)
