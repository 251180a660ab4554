"""Forecast skill against the observed arrival field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardgrid import constants as K
from hazardgrid.operators.common import as_list, literal_array, salted_join
from hazardgrid.operators.spatial import CELL

EPS = 1e-9


def horizon_skill(prob: DataFrame, truth: DataFrame, cell_m: float, keys=("fire_id", "arm")) -> DataFrame:
    """Per horizon: IoU, Dice, Brier, 90 % coverage and region area, in one pass over the cells."""
    keys = [*as_list(keys), "horizon_min"]
    both = prob.join(truth.select(*CELL, "truth_min"), CELL)
    y = F.coalesce(F.col("truth_min") <= F.col("horizon_min"), F.lit(False))
    pred, region = F.col("p") >= 0.5, F.col("p") >= 1.0 - 0.9
    n = both.groupBy(*keys).agg(
        F.count_if(pred & y).alias("inter"),
        F.count_if(pred).alias("n_pred"),
        F.count_if(y).alias("n_true"),
        F.count_if(region & y).alias("n_cov"),
        F.count_if(F.col("p") >= 0.10).alias("n_region"),
        F.avg(F.pow(F.col("p") - y.cast("double"), F.lit(2.0))).alias("brier"),
    )
    some = (F.col("n_pred") > 0) & (F.col("n_true") > 0)
    union = F.col("n_pred") + F.col("n_true") - F.col("inter")
    zero = F.lit(0.0)
    return n.select(
        *keys,
        F.when(some, F.col("inter") / union).otherwise(zero).alias("iou"),
        F.when(some, F.col("inter") * 2.0 / (F.col("n_pred") + F.col("n_true"))).otherwise(zero).alias("dice"),
        "brier",
        F.try_divide("n_cov", "n_true").alias("coverage_90"),
        (F.col("n_region") * float(cell_m) ** 2 / 1e6).alias("region90_area_km2"),
    )


def ablation(skill: DataFrame, keys=("fire_id",), scores=("iou", "dice")) -> DataFrame:
    """Assimilated minus plain forecast per horizon; ``skill`` has an ``arm`` of on or off."""
    aggs = []
    for s in scores:
        for arm in ("on", "off"):
            aggs.append(F.max(F.when(F.col("arm") == arm, F.col(s))).alias(f"{s}_{arm}"))
    wide = skill.groupBy(*keys, "horizon_min").agg(*aggs)
    for s in scores:
        wide = wide.withColumn(f"{s}_gain", F.col(f"{s}_on") - F.col(f"{s}_off"))
    return wide


def issue_skill(
    arrivals: DataFrame, issue_weights: DataFrame, cells: DataFrame, truth: DataFrame, horizon: float, cell_m: float
) -> DataFrame:
    """Region area and IoU at one horizon for the weights of each issue.

    ``issue_weights(fire_id, member_id, issue_min, n_batches, weight)`` sum to one per issue.
    """
    reached = arrivals.filter(F.col("arrival_min") <= horizon).select(*CELL, "member_id")
    field = (
        salted_join(reached, issue_weights, ["fire_id", "member_id"], ["i", "j"])
        .groupBy(*CELL, "issue_min")
        .agg(F.sum("weight").alias("p"))
    )
    issues = issue_weights.groupBy("fire_id", "issue_min").agg(F.max("n_batches").alias("n_batches"))
    grid = salted_join(
        cells.select(*CELL).join(truth.select(*CELL, "truth_min"), CELL), issues, "fire_id", ["i", "j"]
    )
    full = grid.join(field, [*CELL, "issue_min"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    y = F.coalesce(F.col("truth_min") <= horizon, F.lit(False))
    pred = F.col("p") >= 0.5 - EPS
    out = full.groupBy("fire_id", "issue_min").agg(
        F.max("n_batches").alias("n_batches"),
        (F.count_if(F.col("p") >= 0.1 - EPS) * float(cell_m) ** 2 / 1e6).alias("region90_area_km2"),
        F.count_if(pred & y).alias("_i"),
        F.count_if(pred | y).alias("_u"),
    )
    return out.withColumn("iou", F.try_divide("_i", "_u")).drop("_i", "_u")


def lead_time_comparison(
    zones: DataFrame, zone_cells: DataFrame, first: DataFrame, issue_weights: DataFrame, truth: DataFrame,
    horizon: float, issues, confidence: float = 0.5,
) -> DataFrame:
    """Earliest issue at which each arm flags a zone, and the lead that gives on the true arrival.

    ``first`` is the arrival per (zone, member) with prior share ``w``; the assimilated arm uses the
    weights of each issue instead.
    """
    rows = first.join(
        issue_weights.select("fire_id", "member_id", "issue_min", F.col("weight").alias("w_on")),
        ["fire_id", "member_id"],
    )
    hit = F.col("arrival_min") <= F.col("issue_min") + horizon
    conf = rows.groupBy("fire_id", "zone_id", "issue_min").agg(
        F.sum(F.when(hit, F.col("w_on"))).alias("p_on"), F.sum(F.when(hit, F.col("w"))).alias("p_off")
    )

    def earliest(p):
        return F.min(F.when(F.col(p) >= confidence - EPS, F.col("issue_min")))

    flags = conf.groupBy("fire_id", "zone_id").agg(
        earliest("p_on").alias("on_flag_min"), earliest("p_off").alias("off_flag_min")
    )
    came = (
        zone_cells.join(truth, CELL)
        .groupBy("fire_id", "zone_id")
        .agg(F.min("truth_min").alias("truth_arrival_min"))
    )
    keys = ["fire_id", "zone_id"]
    out = zones.select(*keys).join(flags, keys, "left").join(came, keys, "left")
    return (
        out.withColumn("on_lead_min", F.col("truth_arrival_min") - F.col("on_flag_min"))
        .withColumn("off_lead_min", F.col("truth_arrival_min") - F.col("off_flag_min"))
        .withColumn("lead_delta_min", F.col("off_flag_min") - F.col("on_flag_min"))
    )


def coverage_levels(prob: DataFrame, truth: DataFrame, keys, levels=K.COVERAGE_LEVELS) -> DataFrame:
    """Share of the truly burned cells with p >= 1 - level, per level; NULL without burned cells."""
    keys = as_list(keys)
    both = prob.join(truth.select(*CELL, "truth_min"), CELL).filter(
        F.col("truth_min") <= F.col("horizon_min")
    )
    sums = [
        F.count_if(F.col("p") >= F.lit(1.0 - float(a))).alias(f"c{k}") for k, a in enumerate(levels)
    ]
    counts = both.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    every = prob.select(*keys).distinct().join(counts, keys, "left")
    rows = F.array(
        *[
            F.struct(F.lit(float(a)).alias("level"), (F.col(f"c{k}") / F.col("n")).alias("coverage"))
            for k, a in enumerate(levels)
        ]
    )
    return every.select(*keys, F.inline(rows))


def coverage_curve(prob: DataFrame, truth: DataFrame, taus, cell_m: float) -> DataFrame:
    """Coverage and region area per event and threshold, averaged over horizons.

    Thresholds are counted by the position of p among them, so cells multiply by no threshold:
    a histogram over positions, then a running sum over the thresholds of each horizon.
    """
    from pyspark.sql import Window

    taus = [float(t) for t in taus]
    both = prob.join(truth.select(*CELL, "truth_min"), CELL)
    passed = F.size(F.filter(literal_array(taus), lambda t: F.col("p") >= t))
    y = F.coalesce(F.col("truth_min") <= F.col("horizon_min"), F.lit(False))
    hist = both.groupBy("fire_id", "horizon_min", passed.alias("pos")).agg(
        F.count("*").alias("n"), F.count_if(y).alias("ny")
    )
    totals = hist.groupBy("fire_id", "horizon_min").agg(F.sum("ny").alias("total_y"))
    slots = F.posexplode(literal_array(taus)).alias("k", "tau")
    grid = totals.select("fire_id", "horizon_min", "total_y", slots).withColumn("pos", F.col("k") + 1)
    above = Window.partitionBy("fire_id", "horizon_min").orderBy(F.col("pos").desc())
    curve = (
        grid.join(hist, ["fire_id", "horizon_min", "pos"], "left")
        .withColumn("n_reg", F.sum(F.coalesce("n", F.lit(0))).over(above))
        .withColumn("n_hit", F.sum(F.coalesce("ny", F.lit(0))).over(above))
    )
    area = F.col("n_reg") * (float(cell_m) ** 2 / 1e6)
    return curve.groupBy("fire_id", "tau").agg(
        F.coalesce(F.avg(F.try_divide("n_hit", "total_y")), F.lit(0.0)).alias("cov"),
        F.avg(area).alias("area_km2"),
    )


def leave_one_out(curve: DataFrame, raw: DataFrame, target=K.COVERAGE_TARGET) -> DataFrame:
    """Threshold of each event picked on the other events, and the event's own coverage and area there.

    ``curve(fire_id, tau, cov, area_km2)``, ``raw(fire_id, coverage90_raw)``. With fewer than two
    events there is nothing to hold out and the raw level stands.
    """
    others = curve.groupBy("tau").agg(F.sum("cov").alias("_sum"), F.count("*").alias("_n"))
    scored = curve.join(others, "tau").withColumn(
        "_gap", F.abs((F.col("_sum") - F.col("cov")) / (F.col("_n") - 1) - F.lit(float(target)))
    )
    near_raw = F.abs(F.col("tau") - F.lit(K.COVERAGE_RAW_LEVEL))
    chosen = F.struct(F.round("_gap", 12), "tau")
    best = scored.groupBy("fire_id").agg(
        F.max("_n").alias("_events"),
        F.min_by("tau", chosen).alias("tau"),
        F.min_by("cov", chosen).alias("cov"),
        F.min_by("area_km2", chosen).alias("area_cal"),
        F.min_by("area_km2", F.struct(near_raw, "tau")).alias("area_raw"),
    )
    alone = F.col("_events") < 2
    return raw.join(best, "fire_id").select(
        "fire_id",
        "coverage90_raw",
        F.when(alone, F.lit(K.COVERAGE_RAW_LEVEL)).otherwise(F.round("tau", 4)).alias("coverage_tau_star"),
        F.when(alone, F.col("coverage90_raw")).otherwise(F.round("cov", 3)).alias("coverage90_cal"),
        F.when(~alone, F.round("area_raw", 1)).alias("region_area_raw_km2"),
        F.when(~alone, F.round("area_cal", 1)).alias("region_area_cal_km2"),
    )


def mask_agreement(a: DataFrame, b: DataFrame, keys, value_a: str, value_b: str, limit: float) -> DataFrame:
    """Mean absolute difference where ``b`` is below ``limit``, and IoU of the two masks below it.

    An empty union counts as full agreement.
    """
    keys = as_list(keys)
    both = a.join(b, [*keys, "i", "j"])
    in_a = F.coalesce(F.col(value_a) < limit, F.lit(False))
    in_b = F.coalesce(F.col(value_b) < limit, F.lit(False))
    out = both.groupBy(*keys).agg(
        F.avg(F.when(in_b, F.abs(F.col(value_a) - F.col(value_b)))).alias("reached_mae"),
        F.count_if(in_a & in_b).alias("_i"),
        F.count_if(in_a | in_b).alias("_u"),
    )
    iou = F.when(F.col("_u") > 0, F.col("_i") / F.col("_u")).otherwise(F.lit(1.0))
    return out.select(*keys, "reached_mae", iou.alias("mask_iou"))
