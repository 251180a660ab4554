"""Arrival-time distribution of the ensemble into the cells of an asset.

``asset_cells(fire_id, <asset>, i, j)`` lists the cells of zones, roads or disks. All results rest on
one table with the first arrival per (asset, member).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardgrid.operators.common import salted_join
from hazardgrid.operators.ensemble import CELL, member_totals

EPS = 1e-12


def first_arrivals(
    asset_cells: DataFrame, arrivals: DataFrame, members: DataFrame, asset: str, complete: bool = False
) -> DataFrame:
    """Earliest arrival per (asset, member) with the member's share ``w`` of the total weight.

    Members that never reach an asset have no row, which every statistic below treats as never;
    ``complete`` lists them with a NULL arrival.
    """
    first = (
        asset_cells.join(arrivals, CELL)
        .groupBy("fire_id", asset, "member_id")
        .agg(F.min("arrival_min").alias("arrival_min"))
    )
    shares = members.join(member_totals(members), "fire_id").select(
        "fire_id", "member_id", "weight", F.col("_total").alias("total")
    )
    if complete:
        assets = asset_cells.select("fire_id", asset).distinct()
        wide = salted_join(assets, shares, "fire_id", [asset])
        out = wide.join(first, ["fire_id", asset, "member_id"], "left")
    else:
        out = salted_join(first, shares, ["fire_id", "member_id"], [asset])
    return out.withColumn("w", F.col("weight") / F.col("total"))


def probability_by(minutes) -> Column:
    """Aggregate: weight share of members that arrived by ``minutes``."""
    by = minutes if isinstance(minutes, Column) else F.lit(float(minutes))
    hit = F.sum(F.when(F.col("arrival_min") <= by, F.col("weight")))
    return F.coalesce(hit, F.lit(0.0)) / F.max("total")


def with_cumulative(first: DataFrame, asset: str) -> DataFrame:
    """Adds the weight share of members that arrived no later. One asset has one row per member."""
    w = Window.partitionBy("fire_id", asset).orderBy("arrival_min")
    return first.withColumn("cum", F.sum("weight").over(w) / F.col("total"))


def reached_at(share: float) -> Column:
    """Aggregate: arrival at which the cumulative share first reaches ``share``; NULL if never."""
    return F.min(F.when(F.col("cum") >= share - EPS, F.col("arrival_min")))


def arrival_statistics(
    first: DataFrame,
    asset: str,
    shares: Mapping[str, float] | None = None,
    by: Mapping[str, float] | None = None,
) -> DataFrame:
    """Per asset: arrivals at cumulative ``shares`` and probabilities ``by`` given minutes."""
    aggs = [reached_at(q).alias(n) for n, q in (shares or {}).items()]
    aggs += [probability_by(m).alias(n) for n, m in (by or {}).items()]
    return with_cumulative(first, asset).groupBy("fire_id", asset).agg(*aggs)
