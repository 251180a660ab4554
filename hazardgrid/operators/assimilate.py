"""Reweighting of ensemble members by observations, for all events and instants at once.

A report is one observation; its cells are rows. Reports carry ``minutes`` since ignition and an
error ``sigma_m``. Weights are updated in the log domain, so a long run of unlikely reports does
not underflow.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardgrid import constants as K
from hazardgrid.functions.draws import clip, hash_normal, hash_uniform
from hazardgrid.functions.lookup import sigma_for_kind
from hazardgrid.operators.common import as_list, attach_group_stats, number_rows, salted_join
from hazardgrid.session import cut_lineage

#: Cells along a side of a tile or block, and distances that a task holds at once.
TILE, STAIRS = 64, 4_000_000
#: Tasks over which the reports of one event and block are dealt.
SHARES = 8
#: More than the cells of a grid row.
SPAN = 1 << 31
LOG_FLOOR = math.log(K.LIKELIHOOD_FLOOR)


def minutes_between(start: Column, end: Column) -> Column:
    """Elapsed minutes between two instants, both cut to the second."""
    a, b = F.date_trunc("second", start), F.date_trunc("second", end)
    return F.timestamp_diff("SECOND", a, b) / F.lit(60.0)


def report_sigma(own: Column, source: Column, kind: Column, cell_m: Column) -> Column:
    """First usable error of the report, its source or its kind, at least one cell; 0 is unusable."""
    zero = F.lit(0.0)
    return F.greatest(
        F.coalesce(F.nullif(own, zero), F.nullif(source, zero), sigma_for_kind(kind)), cell_m
    )


def normalise_reports(observations: DataFrame, ignitions: DataFrame, cell_m: float) -> DataFrame:
    """Minutes since ignition, error and area flag; reports without geometry are dropped.

    ``observations(fire_id, t, kind, geometry_type, own_sigma_m, source_sigma_m, ...)``.
    """
    sigma = report_sigma(F.col("own_sigma_m"), F.col("source_sigma_m"), F.col("kind"), F.lit(float(cell_m)))
    with_start = salted_join(
        observations.filter(F.col("geometry_type").isNotNull()),
        ignitions.select("fire_id", "ignition_t"), "fire_id", ["t"],
    )
    return (
        with_start.withColumn("minutes", minutes_between(F.col("ignition_t"), F.col("t")))
        .withColumn("sigma_m", sigma)
        .withColumn("is_area", F.col("geometry_type").isin("Polygon", "MultiPolygon"))
        .drop("ignition_t")
    )


def batches(reports: DataFrame, t: str = "minutes") -> DataFrame:
    """Reports with the rank of their instant within the event, from 1.

    Only the distinct instants are ranked, by ranges, so an event with many is many tasks.
    """
    instants = number_rows(reports.select("fire_id", t).distinct(), [F.col(t)], ["fire_id"], "batch")
    return reports.join(instants.withColumn("batch", F.col("batch").cast("int")), ["fire_id", t])


def _tile(c: str) -> Column:
    return F.floor(F.col(c) / TILE).cast("int")


def burned_near_tiles(tiles: DataFrame, arrivals: DataFrame) -> DataFrame:
    """For each member and asked tile, the burned cells that can be nearest to one of its cells at some instant.

    Cells are judged by blocks. A block is left out if another one starts to burn no later and even its
    farthest cell is nearer to the whole tile than the block's nearest: at every instant at which the
    block has a burned cell, that one has a nearer one.
    """
    keys = ["fire_id", "member_id"]
    cells = arrivals.select(*keys, "i", "j", "arrival_min", _tile("i").alias("bi"), _tile("j").alias("bj"))
    cells = cells.filter("arrival_min IS NOT NULL")
    blocks = cells.groupBy(*keys, "bi", "bj").agg(F.min("arrival_min").alias("_start"))
    met = salted_join(blocks, tiles, "fire_id", ["member_id", "bi", "bj"])
    away = {c: F.abs(F.col(f"b{c}") - F.col(f"t{c}")) * TILE for c in "ij"}
    least = [F.greatest(F.lit(0), d - (TILE - 1)) for d in away.values()]
    most = [d + (TILE - 1) for d in away.values()]
    met = met.withColumns({"_lo": least[0] * least[0] + least[1] * least[1], "_hi": most[0] * most[0] + most[1] * most[1]})
    earlier = Window.partitionBy(*keys, "ti", "tj").orderBy("_start").rangeBetween(Window.unboundedPreceding, 0)
    kept = met.withColumn("_bound", F.min("_hi").over(earlier)).filter("_lo <= _bound")
    return kept.select(*keys, "ti", "tj", "bi", "bj").join(cells, [*keys, "bi", "bj"]).drop("bi", "bj")


def distance_to_burned(cells: DataFrame, arrivals: DataFrame, members: DataFrame, cell_m: float) -> DataFrame:
    """For ``cells(fire_id, minutes, i, j)`` and every member: metres to its nearest burned cell.

    NULL when the member has burned nothing by then. A task holds a tile of asked cells and one member's
    burned cells that matter there. In order of burning, the running least distance of a cell is its
    staircase over time; every instant is one look-up in it, so the work does not grow with the instants.
    """
    asked = cells.select("fire_id", "minutes", "i", "j").distinct()
    asked = asked.withColumns({"ti": _tile("i"), "tj": _tile("j")})
    tiles = asked.select(*[F.col(c).alias(c) for c in ("fire_id", "ti", "tj")]).distinct()  # columns of its own for the cogroup
    near = burned_near_tiles(tiles, arrivals)
    asked = salted_join(asked, members.select("fire_id", "member_id"), "fire_id", ["i", "j"])
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in ("fire_id", "member_id", "minutes", "i", "j", "dist_m"))

    def look_up(want: pd.DataFrame, burned: pd.DataFrame) -> pd.DataFrame:
        out = want[["fire_id", "member_id", "minutes", "i", "j"]].reset_index(drop=True)
        dist = np.full(len(out), np.nan)
        burned = burned.sort_values("arrival_min", kind="stable")
        upto = np.searchsorted(burned.arrival_min.to_numpy(float), out.minutes.to_numpy(float), "right") - 1
        bi, bj = burned.i.to_numpy(np.int64), burned.j.to_numpy(np.int64)
        spot, own = np.unique(out[["i", "j"]].to_numpy(np.int64), axis=0, return_inverse=True)
        order = np.argsort(own.ravel(), kind="stable")
        ends = np.searchsorted(own.ravel()[order], np.arange(len(spot) + 1))
        step = max(1, STAIRS // max(1, len(burned)))
        for k in range(0, len(spot) if len(burned) else 0, step):
            some = spot[k : k + step]
            d2 = (some[:, :1] - bi) ** 2 + (some[:, 1:] - bj) ** 2
            stairs = np.minimum.accumulate(d2, axis=1)
            rows = order[ends[k] : ends[min(len(spot), k + step)]]
            rows = rows[upto[rows] >= 0]
            dist[rows] = np.sqrt(stairs[own.ravel()[rows] - k, upto[rows]]) * cell_m
        out["dist_m"] = pd.array(dist, dtype="Float64")
        out.loc[np.isnan(dist), "dist_m"] = pd.NA
        return out

    group = ["fire_id", "member_id", "ti", "tj"]
    return asked.groupBy(*group).cogroup(near.groupBy(*group)).applyInPandas(look_up, schema)


def _per_member(reports: DataFrame, members: DataFrame, report) -> DataFrame:
    heads = reports.select("fire_id", *report, "minutes", "sigma_m").distinct()
    return salted_join(heads, members.select("fire_id", "member_id"), "fire_id", report)


def point_mismatch(
    points: DataFrame, reports: DataFrame, arrivals: DataFrame, members: DataFrame, cell_m: float, report
) -> DataFrame:
    """``(fire_id, report, member_id, d_m)``: RMS distance of a report's cells from the burned area.

    ``points(fire_id, report.., minutes, i, j)`` are in-bounds cells. A report without cells, or a
    member without burned cells, gives five sigmas.
    """
    report = as_list(report)
    counted = points.groupBy("fire_id", *report, "minutes", "i", "j").agg(F.count("*").alias("_n"))
    dist = distance_to_burned(counted, arrivals, members, cell_m)
    rms = (
        counted.join(dist, ["fire_id", "minutes", "i", "j"])
        .groupBy("fire_id", *report, "member_id")
        .agg(F.sqrt(F.sum(F.col("_n") * F.col("dist_m") * F.col("dist_m")) / F.sum("_n")).alias("_rms"))
    )
    every = _per_member(reports, members, report)
    return every.join(rms, ["fire_id", *report, "member_id"], "left").select(
        "fire_id", *report, "member_id", "minutes", "sigma_m",
        F.coalesce("_rms", F.col("sigma_m") * K.NO_OVERLAP_SIGMAS).alias("d_m"),
    )


def area_mismatch(
    area_cells: DataFrame, reports: DataFrame, arrivals: DataFrame, members: DataFrame, cell_m: float, report
) -> DataFrame:
    """Mean distance report to prediction plus 0.4 times prediction to report.

    ``area_cells(fire_id, report.., minutes, i, j)`` are the distinct cells of each area report.
    """
    report = as_list(report)
    keys = ["fire_id", *report, "member_id"]
    under = _region_to_burned(area_cells, arrivals, members, cell_m, report)
    over = _burned_to_region(area_cells, arrivals, cell_m, report)
    total = F.col("_under") + F.col("_over") * K.OVER_PREDICTION_WEIGHT
    return (
        _per_member(reports, members, report)
        .join(under, keys, "left")
        .join(over, keys, "left")
        .select(
            *keys, "minutes", "sigma_m",
            F.coalesce(total, F.col("sigma_m") * K.NO_OVERLAP_SIGMAS).alias("d_m"),
        )
    )


def _kinds(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


def _share(report) -> Column:
    """Reports of one event and instant are dealt over a few tasks."""
    return F.pmod(F.xxhash64(*report), F.lit(SHARES)).cast("int").alias("_share")


def _region_to_burned(area_cells: DataFrame, arrivals: DataFrame, members: DataFrame, cell_m: float, report) -> DataFrame:
    """``(fire_id, report, member_id, _under)``: mean distance of a report's cells from what each member has burned.

    Cells of reports meet the distances of their instant and tile; a task returns one sum per report and member, so
    cells and members never multiply into rows.
    """
    dist = distance_to_burned(area_cells, arrivals, members, cell_m)
    dist = dist.filter("dist_m IS NOT NULL").withColumns({"ti": _tile("i"), "tj": _tile("j")})
    dist = dist.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    cells = area_cells.select("fire_id", *report, "minutes", "i", "j", _tile("i").alias("ti"), _tile("j").alias("tj"), _share(report))
    group = ["fire_id", "minutes", "ti", "tj", "_share"]
    out = ["fire_id", *report, "member_id", "_sum", "_n"]

    def sums(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(known):
            return pd.DataFrame(columns=out)
        who, col = np.unique(known.member_id.to_numpy(), return_inverse=True)
        at = lambda d: (d.i.to_numpy(np.int64) % TILE) * TILE + d.j.to_numpy(np.int64) % TILE
        table = np.full((TILE * TILE, len(who)), np.nan)
        table[at(known), col] = known.dist_m.to_numpy(float)
        names, first, own = _groups(asked, report)
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(len(first)))
        spot, held = at(asked)[order], ~np.isnan(table)
        total, n = np.zeros((len(first), len(who))), np.zeros((len(first), len(who)), np.int64)
        for m in range(len(who)):
            total[:, m] = np.add.reduceat(np.nan_to_num(table[:, m])[spot], starts)
            n[:, m] = np.add.reduceat(held[:, m].astype(np.int64)[spot], starts)
        return _long(asked.fire_id.iloc[0], names, who, total, n, out, report)

    schema = f"{_kinds(cells, 'fire_id', *report)}, {_kinds(dist, 'member_id')}, _sum double, _n long"
    parts = cells.groupBy(*group).cogroup(dist.groupBy(*group)).applyInPandas(sums, schema)
    return parts.groupBy("fire_id", *report, "member_id").agg((F.sum("_sum") / F.sum("_n")).alias("_under"))


def _burned_to_region(area_cells: DataFrame, arrivals: DataFrame, cell_m: float, report) -> DataFrame:
    """``(fire_id, report, member_id, _over)``: mean distance of each member's burned cells from a report's cells.

    A report is one row with its cells. It meets the blocks of arrivals that burn by its instant; there, distances of
    the block's cells are taken once for all members, and a task returns one sum per report and member.
    """
    regions = area_cells.groupBy("fire_id", *report, "minutes").agg(F.collect_list(F.struct("i", "j")).alias("_c"))
    regions = regions.select("fire_id", *report, "minutes", F.col("_c.i").alias("ri"), F.col("_c.j").alias("rj"), _share(report))
    burned = arrivals.filter("arrival_min IS NOT NULL").select(
        "fire_id", "member_id", "i", "j", "arrival_min", _tile("i").alias("bi"), _tile("j").alias("bj")
    )
    blocks = burned.groupBy("fire_id", "bi", "bj").agg(F.min("arrival_min").alias("_start"))
    # Only instants meet blocks; reports then find the blocks of their instant by an equi-join.
    instants = area_cells.select("fire_id", "minutes").distinct()
    met = salted_join(blocks, instants, "fire_id", ["bi", "bj"]).filter("_start <= minutes").drop("_start")
    asked = regions.join(met, ["fire_id", "minutes"])
    near = burned.join(met.select("fire_id", "bi", "bj").distinct(), ["fire_id", "bi", "bj"], "left_semi")
    near = near.select(*[F.col(c).alias(c) for c in near.columns])  # columns of its own for the cogroup
    near = near.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    group = ["fire_id", "bi", "bj", "_share"]
    out = ["fire_id", *report, "member_id", "_sum", "_n"]

    def sums(want: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(want) or not len(held):
            return pd.DataFrame(columns=out)
        who, col = np.unique(held.member_id.to_numpy(), return_inverse=True)
        cell, row = np.unique(held[["i", "j"]].to_numpy(np.int64), axis=0, return_inverse=True)
        at = np.full((len(cell), len(who)), np.inf)
        at[row.ravel(), col] = held.arrival_min.to_numpy(float)
        first = at.min(axis=1)
        total, n = np.zeros((len(want), len(who))), np.zeros((len(want), len(who)), np.int64)
        for k, (minutes, ri, rj) in enumerate(zip(want.minutes.to_numpy(float), want.ri, want.rj)):
            some = first <= minutes
            ci, cj = cell[some, 0], cell[some, 1]
            ri, rj = np.asarray(ri, np.int64), np.asarray(rj, np.int64)
            least = np.full(len(ci), np.inf)
            if len(ri) > 256:
                # Outside a region its nearest cell is one of its rim.
                code = ri * SPAN + rj
                rim = ~(np.isin(code - 1, code) & np.isin(code + 1, code) & np.isin(code - SPAN, code) & np.isin(code + SPAN, code))
                least[np.isin(ci * SPAN + cj, code)] = 0.0
                ri, rj = ri[rim], rj[rim]
            step = max(1, STAIRS // max(1, len(ci)))
            for p in range(0, len(ri), step):
                d2 = (ci[:, None] - ri[p : p + step]) ** 2 + (cj[:, None] - rj[p : p + step]) ** 2
                least = np.minimum(least, d2.min(axis=1))
            by = at[some] <= minutes
            total[k], n[k] = np.sqrt(least) @ by, by.sum(axis=0)
        return _long(want.fire_id.iloc[0], want[report].reset_index(drop=True), who, total, n, out, report)

    schema = f"{_kinds(regions, 'fire_id', *report)}, {_kinds(burned, 'member_id')}, _sum double, _n long"
    parts = asked.groupBy(*group).cogroup(near.groupBy(*group)).applyInPandas(sums, schema)
    return parts.groupBy("fire_id", *report, "member_id").agg((F.sum("_sum") / F.sum("_n") * float(cell_m)).alias("_over"))


def _groups(rows: pd.DataFrame, keys):
    """Distinct keys, a position for each, and the group of every row."""
    own = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    first = np.unique(own, return_index=True)[1]
    return rows[keys].iloc[first].reset_index(drop=True), first, own


def _long(fire, names: pd.DataFrame, who: np.ndarray, total: np.ndarray, n: np.ndarray, out, report) -> pd.DataFrame:
    """Sums and counts of reports by members as rows; members without a cell are left out."""
    k, m = np.nonzero(n)
    part = names.iloc[k].reset_index(drop=True)
    return part.assign(fire_id=fire, member_id=who[m], _sum=total[k, m], _n=n[k, m])[out]


def batch_loglik(mismatch: DataFrame, by=("fire_id", "member_id", "minutes")) -> DataFrame:
    """Log-likelihood per member and instant; each report is floored at 1e-12."""
    z = F.col("d_m") / F.col("sigma_m")
    one = F.greatest(z * z * -0.5, F.lit(LOG_FLOOR))
    return mismatch.groupBy(*by).agg(F.sum(one).alias("loglik"))


def normalise_log_weights(logw: DataFrame, keys, value: str = "logw", out: str = "w") -> DataFrame:
    """Log weights to weights that sum to one per key. They are written once, since two statistics read them."""
    keys, logw = as_list(keys), cut_lineage(logw)
    top = attach_group_stats(logw, keys, _top=F.max(value))
    raised = top.withColumn("_e", F.exp(F.col(value) - F.col("_top")))
    return (
        attach_group_stats(raised, keys, _sum=F.sum("_e"))
        .withColumn(out, F.col("_e") / F.col("_sum"))
        .drop("_top", "_e", "_sum")
    )


def sequential_weights(members: DataFrame, loglik: DataFrame) -> DataFrame:
    """Weights after each instant, without resampling: ``(fire_id, member_id, minutes, w)``.

    The product over instants is a running sum of logs, so no loop over instants is needed.
    """
    run = Window.partitionBy("fire_id", "member_id").orderBy("minutes")
    summed = loglik.withColumn("_ll", F.sum("loglik").over(run))
    prior = salted_join(
        summed, members.select("fire_id", "member_id", "weight"), ["fire_id", "member_id"], ["minutes"]
    )
    logw = prior.filter(F.col("weight") > 0).withColumn("logw", F.log("weight") + F.col("_ll"))
    return normalise_log_weights(logw, ["fire_id", "minutes"]).select("fire_id", "member_id", "minutes", "w")


def weights_at_issues(members: DataFrame, loglik: DataFrame, issues) -> DataFrame:
    """Weights at each issue offset from all instants up to it, with the number of instants used.

    One conditional sum per issue over the log-likelihoods, so issues multiply no rows.
    """
    keys = ["fire_id", "member_id"]
    aggs = []
    for k, at in enumerate(issues):
        used = F.col("minutes") <= at
        aggs += [F.sum(F.when(used, F.col("loglik"))).alias(f"l{k}"), F.count_if(used).alias(f"n{k}")]
    per_member = members.join(loglik.groupBy(*keys).agg(*aggs), keys, "left")
    rows = F.array(
        *[
            F.struct(
                F.lit(int(at)).alias("issue_min"),
                F.coalesce(F.col(f"l{k}"), F.lit(0.0)).alias("_ll"),
                F.coalesce(F.col(f"n{k}"), F.lit(0)).alias("n_batches"),
            )
            for k, at in enumerate(issues)
        ]
    )
    long = per_member.filter(F.col("weight") > 0).select(*keys, "weight", F.inline(rows))
    logw = long.withColumn("logw", F.log("weight") + F.col("_ll"))
    return normalise_log_weights(logw, ["fire_id", "issue_min"]).select(
        *keys, "issue_min", "n_batches", F.col("w").alias("weight")
    )


def needs_resampling(weights: DataFrame, keys="fire_id", w: str = "w", fraction: float = K.ESS_FRACTION):
    """Effective sample size per key and whether it fell below the fraction of the members."""
    return (
        weights.groupBy(*as_list(keys))
        .agg(
            (F.pow(F.sum(w), F.lit(2.0)) / F.sum(F.col(w) * F.col(w))).alias("ess"),
            F.count("*").alias("n"),
        )
        .withColumn("resample", F.col("ess") < F.col("n") * fraction)
    )


def systematic_resample(weights: DataFrame, u, slot: str = "member_id", w: str = "w") -> DataFrame:
    """Children ``(fire_id, child, <slot> = parent)`` at positions ``(u + k) / n``.

    A parent covers the positions in ``(cum - w, cum]``; their count follows from its bounds, so the
    children are generated from the parent row and positions need no join.
    """
    u = u if isinstance(u, Column) else F.lit(float(u))
    run = Window.partitionBy("fire_id").orderBy(slot)
    placed = attach_group_stats(weights, "fire_id", _sum=F.sum(w), _n=F.count("*"), _last=F.max(slot))
    hi = F.sum(w).over(run) / F.col("_sum")
    placed = placed.withColumn("_hi", hi).withColumn("_u", u)
    placed = placed.withColumn("_lo", F.coalesce(F.lag("_hi").over(run), F.lit(0.0)))

    def count_upto(x):
        return F.floor(x * F.col("_n") - F.col("_u") + 1e-9)

    first = F.when(F.col("_lo") <= 0, F.lit(0)).otherwise(count_upto(F.col("_lo")) + 1)
    last = F.when(F.col(slot) == F.col("_last"), F.col("_n") - 1).otherwise(count_upto(F.col("_hi")))
    placed = placed.withColumn("_first", first).withColumn("_stop", last)
    span = F.sequence(F.col("_first"), F.col("_stop")).cast("array<int>")
    return (
        placed.filter(F.col("_first") <= F.col("_stop"))
        .withColumn("child", F.explode(span))
        .select("fire_id", "child", F.col(slot))
    )


def jitter(children: DataFrame, parents: DataFrame, seed: int = 99, round_no: int = 0) -> DataFrame:
    """Children with their parent's parameters, perturbed and held to range; equal weights."""
    out = children.join(parents.drop("weight"), ["fire_id", "member_id"])
    for name, (sd, lo, hi) in K.JITTER.items():
        z = hash_normal(seed, "fire_id", "child", F.lit(name), F.lit(round_no))
        out = out.withColumn(name, clip(F.col(name) + z * sd, lo, hi))
    n = out.groupBy("fire_id").agg(F.count("*").alias("_n"))
    return out.join(n, "fire_id").withColumn("weight", 1 / F.col("_n")).drop("_n")


def _resample(slots: DataFrame) -> DataFrame:
    """Systematic resampling of ``fire_id, slot, member_id, w, u``: child slots and the member each gets.

    Child k takes the slot whose share of the running weight holds (u + k) / n.
    """
    upto = Window.partitionBy("fire_id").orderBy("slot")
    whole = Window.partitionBy("fire_id")
    cum = F.sum("w").over(upto)
    rows = slots.withColumns({"_hi": cum, "_n": F.count("*").over(whole), "_last": F.max("slot").over(whole)})
    rows = rows.withColumn("_lo", F.coalesce(F.lag("_hi").over(upto), F.lit(-1.0)))
    at = lambda k: (F.col("u") + k) / F.col("_n")
    own = F.filter(
        F.sequence(F.lit(0), (F.col("_n") - 1).cast("int")),
        lambda k: (at(k) > F.col("_lo")) & ((at(k) <= F.col("_hi")) | (F.col("slot") == F.col("_last"))),
    )
    return rows.select("fire_id", F.explode(own).alias("slot"), "member_id", "_n")


def assimilate_with_resampling(members: DataFrame, loglik: DataFrame, seed: int = 99) -> DataFrame:
    """Final slots ``(fire_id, slot, member_id, weight)`` after every instant, with resampling.

    A resampled slot keeps its parent's arrival rows (``member_id``). Between two resamplings weights are
    running sums of log-likelihoods, so a round looks at all instants of all events at once, finds
    each event's first instant with too few effective members, resamples there and goes on from it.
    Rounds are as many as the most resamplings of one event; no group holds more than the members of
    one event or the instants of one member.
    """
    instants = loglik.select("fire_id", "minutes").filter("minutes IS NOT NULL").distinct()
    dense = instants.join(members.select("fire_id", "member_id"), "fire_id")
    dense = dense.join(loglik.select("fire_id", "member_id", "minutes", "loglik"), ["fire_id", "member_id", "minutes"], "left")
    running = Window.partitionBy("fire_id", "member_id").orderBy("minutes")
    upto = F.sum(F.coalesce("loglik", F.lit(0.0))).over(running)
    cum = cut_lineage(dense.select("fire_id", "member_id", "minutes", upto.alias("cum")))
    place = F.row_number().over(Window.partitionBy("fire_id").orderBy("member_id")) - 1
    base = F.when(F.col("weight") > 0, F.log("weight"))
    slots = members.select("fire_id", place.alias("slot"), "member_id", base.alias("base"), base.alias("prior"), F.lit(-math.inf).alias("since"))
    slots, done = cut_lineage(slots), None
    each = Window.partitionBy("fire_id", "minutes")
    while True:
        at = slots.join(cum, ["fire_id", "member_id"], "left").filter("minutes IS NULL OR minutes > since")
        at = at.withColumn("lw", F.col("base") + F.coalesce("cum", F.lit(0.0)))
        at = at.withColumn("e", F.coalesce(F.exp(F.col("lw") - F.max("lw").over(each)), F.lit(0.0)))
        at = cut_lineage(at.withColumn("w", F.col("e") / F.sum("e").over(each)))
        ess = at.filter("minutes IS NOT NULL").groupBy("fire_id", "minutes")
        ess = ess.agg((1 / F.sum(F.col("w") * F.col("w"))).alias("ess"), F.count("*").alias("n"))
        hit = ess.filter(F.col("ess") < F.col("n") * K.ESS_FRACTION).groupBy("fire_id").agg(F.min("minutes").alias("hit"))
        hit = cut_lineage(hit)
        over = slots.join(hit, "fire_id", "left_anti")
        last = at.groupBy("fire_id", "slot").agg(F.max_by("w", "minutes").alias("w"), F.max("w").alias("_only"))
        plain = F.coalesce(F.exp("prior"), F.lit(0.0))  # of an event without instants, or resampled at its last one
        plain = plain / F.sum(plain).over(Window.partitionBy("fire_id"))
        over = over.withColumn("_plain", plain).join(last, ["fire_id", "slot"], "left").select(
            "fire_id", "slot", "member_id", F.coalesce("w", "_only", "_plain").alias("weight")
        )
        over = cut_lineage(over)
        done = over if done is None else done.unionByName(over)
        if hit.isEmpty():
            return done
        chosen = at.join(hit, "fire_id").filter("minutes = hit").withColumn("u", hash_uniform(seed, "fire_id", "minutes"))
        fresh = _resample(chosen).join(hit, "fire_id")
        back = cum.select("fire_id", "member_id", F.col("minutes").alias("hit"), "cum")
        fresh = fresh.join(back, ["fire_id", "member_id", "hit"]).select(
            "fire_id", "slot", "member_id", (-F.log("_n") - F.col("cum")).alias("base"), (-F.log("_n")).alias("prior"),
            F.col("hit").alias("since"),
        )
        slots = cut_lineage(fresh)
