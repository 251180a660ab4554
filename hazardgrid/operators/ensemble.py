"""Weighted-ensemble aggregates over ``(member, cell)`` arrival rows.

``member_arrival(fire_id, member_id, i, j, arrival_min)`` has no row where a member never reaches a
cell. ``member(fire_id, member_id, weight)`` may hold unnormalised weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardgrid import constants as K
from hazardgrid.functions.draws import clip, hash_normal
from hazardgrid.functions.geo import to_local, to_wgs84
from hazardgrid.operators.common import (
    as_list,
    attach_group_stats,
    conditional_sums,
    literal_array,
    salted_join,
    unpivot_values,
)

CELL = ["fire_id", "i", "j"]


def draw_members(sites: DataFrame, **prior) -> DataFrame:
    """Member parameters per event, drawn from the prior.

    The last ``round(tail_frac * n)`` members come from a faster prior with a wider direction
    spread. Draws hash ``(fire, member, name)``, so a member's parameters do not depend on how many
    other rows there are or where they lie.
    """
    c = {**K.ENSEMBLE_PRIOR, **prior}
    n, n_tail = int(c["n_members"]), round(c["tail_frac"] * c["n_members"])
    rows = sites.withColumn("member_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    tail = F.col("member_id") >= n - n_tail

    def z(name):
        return hash_normal(c["seed"], "fire_id", "member_id", F.lit(name))

    wind = F.when(
        tail, clip(z("wind") * c["tail_wind_mult_sd"] + c["tail_wind_mult"], 0.6, 4.0)
    ).otherwise(clip(z("wind") * c["wind_mult_sd"] + 1.0, 0.4, 2.4))
    spread = F.when(tail, F.lit(c["tail_dir_factor"])).otherwise(F.lit(1.0)) * c["wind_dir_sd_deg"]
    at = to_local("ignition_lon", "ignition_lat", "center_lon", "center_lat")
    moved = to_wgs84(
        at["x"] + z("east") * c["ignition_sd_m"], at["y"] + z("north") * c["ignition_sd_m"],
        "center_lon", "center_lat",
    )
    return rows.select(
        "fire_id",
        "member_id",
        F.lit(1.0).alias("weight"),
        wind.alias("wind_mult"),
        (z("direction") * spread).alias("wind_dir_offset_deg"),
        clip(z("moisture") * c["moisture_mult_sd"] + 1.0, 0.35, 2.4).alias("moisture_mult"),
        clip(z("ros") * c["ros_mult_sd"] + 1.0, 0.4, 3.0).alias("ros_mult"),
        F.when(tail, F.lit(c["tail_spread_cap_ms"])).otherwise(F.lit(c["spread_cap_ms"])).alias("spread_cap_ms"),
        moved["lon"].alias("ignition_lon"),
        moved["lat"].alias("ignition_lat"),
    )


def normalised(members: DataFrame, keys="fire_id") -> DataFrame:
    """Members with ``w`` summing to one per event; uniform when the weights sum to zero or less."""
    with_total = attach_group_stats(members, keys, _total=F.sum("weight"), _n=F.count("*"))
    w = F.when(F.col("_total") > 0, F.col("weight") / F.col("_total")).otherwise(1 / F.col("_n"))
    return with_total.withColumn("w", w).drop("_total", "_n")


def effective_sample_size(members: DataFrame, keys="fire_id") -> DataFrame:
    w = normalised(members, keys)
    return w.groupBy(*as_list(keys)).agg((1 / F.sum(F.col("w") * F.col("w"))).alias("ess"))


def weighted_arrivals(arrivals: DataFrame, members: DataFrame) -> DataFrame:
    """Arrival rows with their member's raw weight; the member side is salted by cell."""
    return salted_join(
        arrivals, members.select("fire_id", "member_id", "weight"), ["fire_id", "member_id"], ["i", "j"]
    )


def member_totals(members: DataFrame) -> DataFrame:
    return members.groupBy("fire_id").agg(
        F.sum("weight").alias("_total"), F.count("*").alias("_n")
    )


def burn_probability(
    arrivals: DataFrame, members: DataFrame, cells: DataFrame, horizons=K.HORIZONS_MIN, uniform=False
) -> DataFrame:
    """``(fire_id, horizon_min, i, j, p)``: weighted share of members arrived by each horizon.

    All horizons come from one aggregate per cell; cells no member reaches have p = 0.
    """
    if uniform:
        members = members.withColumn("weight", F.lit(1.0))
    sums = conditional_sums("h", horizons, lambda h: F.col("arrival_min") <= h, F.col("weight"))
    per_cell = weighted_arrivals(arrivals, members).groupBy(*CELL).agg(*sums)
    full = salted_join(
        cells.select(*CELL).join(per_cell, CELL, "left"), member_totals(members), "fire_id", ["i", "j"]
    )
    out = full.select(*CELL, "_total", F.inline(unpivot_values("h", horizons, "horizon_min", "s")))
    return out.select(
        "fire_id", "horizon_min", "i", "j", (F.coalesce("s", F.lit(0.0)) / F.col("_total")).alias("p")
    )


def burn_probability_arms(arrivals: DataFrame, members: DataFrame, cells: DataFrame, horizons=K.HORIZONS_MIN) -> DataFrame:
    """``(fire_id, arm, horizon_min, i, j, p)`` with the weights (on) and with equal members (off).

    Both arms and all horizons come from one aggregate over the arrivals.
    """
    came = lambda h: F.col("arrival_min") <= h
    sums = conditional_sums("w", horizons, came, F.col("weight")) + conditional_sums("u", horizons, came, F.lit(1.0))
    per_cell = weighted_arrivals(arrivals, members).groupBy(*CELL).agg(*sums)
    full = salted_join(
        cells.select(*CELL).join(per_cell, CELL, "left"), member_totals(members), "fire_id", ["i", "j"]
    )
    rows = [
        F.struct(F.lit(arm).alias("arm"), F.lit(h).alias("horizon_min"), (F.coalesce(f"{c}{k}", F.lit(0.0)) / F.col(total)).alias("p"))
        for arm, c, total in (("on", "w", "_total"), ("off", "u", "_n"))
        for k, h in enumerate(horizons)
    ]
    return full.select(*CELL, F.inline(F.array(*rows))).select("fire_id", "arm", "horizon_min", "i", "j", "p")


def threshold_regions(prob: DataFrame, levels=K.PROB_BANDS) -> DataFrame:
    """One row per (cell, level) with p at or above the level."""
    reached = F.filter(literal_array([float(v) for v in levels]), lambda v: F.col("p") >= v)
    return prob.withColumn("level", F.explode(reached))


def mean_arrival(arrivals: DataFrame, members: DataFrame, cells: DataFrame) -> DataFrame:
    """Weighted mean arrival per cell; a member that never arrives counts as 1e9 minutes."""
    per_cell = weighted_arrivals(arrivals, members).groupBy(*CELL).agg(
        F.sum(F.col("weight") * F.col("arrival_min")).alias("_s"), F.sum("weight").alias("_w")
    )
    full = salted_join(
        cells.select(*CELL).join(per_cell, CELL, "left"), member_totals(members), "fire_id", ["i", "j"]
    )
    seen, total = F.coalesce("_s", F.lit(0.0)), F.col("_total")
    missing = (total - F.coalesce("_w", F.lit(0.0))) * F.lit(K.NEVER_MIN)
    return full.select(*CELL, ((seen + missing) / total).alias("mean_arrival_min"))


def burned_mask(arrivals: DataFrame, horizon_min: float) -> DataFrame:
    return arrivals.filter(F.col("arrival_min") <= horizon_min)


def forecast_summary(prob: DataFrame, cell_m: float, keys=("fire_id", "horizon_min")) -> DataFrame:
    """Per forecast: greatest p, area with p >= 0.5, and the area of the 90 % region in km2."""
    area = float(cell_m) ** 2
    return prob.groupBy(*as_list(keys)).agg(
        F.max("p").alias("max_prob"),
        (F.count_if(F.col("p") >= 0.5) * area).alias("burning_area_m2"),
        (F.count_if(F.col("p") >= 0.10) * area / 1e6).alias("region90_area_km2"),
    )
