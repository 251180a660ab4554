"""Outlines of cell masks as rings of corners.

A corner ``(x, y)`` lies half a cell south-west of cell ``(i = y, j = x)``. Sides of the mask run with the mask on
their left, so an outer ring has a positive area, the ring of a hole a negative one. Cells that touch only at a
corner have separate rings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardgrid.functions import geo
from hazardgrid.operators.common import as_list
from hazardgrid.operators.spatial import attach_site, boundary_edges
from hazardgrid.session import cut_lineage

EAST, NORTH, WEST, SOUTH = range(4)
#: Side of a cell: direction, corner where it starts.
SIDES = {"s": (EAST, 0, 0), "e": (NORTH, 1, 0), "n": (WEST, 1, 1), "w": (SOUTH, 0, 1)}


def corner_id(x, y, heading) -> Column:
    """Number of a run by start corner and direction; coordinates are not negative."""
    x, y = F.col(x).cast("long"), F.col(y).cast("long")
    return F.shiftleft(y, 33) + F.shiftleft(x, 2) + F.col(heading)


def straight_runs(mask: DataFrame, keys) -> DataFrame:
    """Longest straight stretches of the outline: ``(keys, id, heading, x0, y0, x1, y1)``.

    Neighbouring sides of one grid line and direction are one run, so only turns are nodes of the graph.
    """
    keys = as_list(keys)
    table = F.create_map(*[v for s, d in SIDES.items() for v in (F.lit(s), F.struct(*[F.lit(n).alias(c) for c, n in zip("hxy", d)]))])
    sides = boundary_edges(mask, keys).withColumn("_s", table[F.col("side")])
    sides = sides.select(*keys, F.col("_s.h").alias("heading"), (F.col("j") + F.col("_s.x")).alias("x"), (F.col("i") + F.col("_s.y")).alias("y"))
    flat = F.col("heading").isin(EAST, WEST)
    sides = sides.withColumns({"_along": F.when(flat, F.col("x")).otherwise(F.col("y")), "_line": F.when(flat, F.col("y")).otherwise(F.col("x"))})
    line = Window.partitionBy(*keys, "heading", "_line").orderBy("_along")
    runs = sides.withColumn("_gap", F.col("_along") - F.row_number().over(line)).groupBy(*keys, "heading", "_line", "_gap").agg(
        F.min("_along").alias("_lo"), F.max("_along").alias("_hi")
    )
    rising = F.col("heading").isin(EAST, NORTH)
    start = F.when(rising, F.col("_lo")).otherwise(F.col("_hi"))
    end = F.when(rising, F.col("_hi") + 1).otherwise(F.col("_lo") - 1)
    runs = runs.select(
        *keys, "heading",
        F.when(flat, start).otherwise(F.col("_line")).alias("x0"), F.when(flat, F.col("_line")).otherwise(start).alias("y0"),
        F.when(flat, end).otherwise(F.col("_line")).alias("x1"), F.when(flat, F.col("_line")).otherwise(end).alias("y1"),
    )
    return runs.withColumn("id", corner_id("x0", "y0", "heading"))


def mask_rings(mask: DataFrame, keys=("fire_id",)) -> DataFrame:
    """Corners of the outline of ``mask(keys, i, j)`` in ring order: ``(keys, ring, pos, x, y, x_next, y_next)``.

    Each run is followed by the one that starts where it ends, the left turn where two do. Ring and place come by
    pointer jumping: after k rounds a run knows the least id among its next ``2 ** k`` runs and how far off it is.
    When a round lowers nothing, every window spans its ring. Work is corners times the log of the longest ring,
    whatever a single event's share. ``ring`` is the id of its lowest, then westmost corner. Repeated
    cells count once; cells and keys are not NULL; an empty mask gives no rows.
    """
    keys = as_list(keys)
    runs = cut_lineage(straight_runs(mask, keys))
    out = runs.select(*keys, F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("id").alias("_next"), F.col("heading").alias("_turned"))
    left = (F.col("_turned") == F.pmod(F.col("heading") + 1, F.lit(4))).cast("int")
    place = ["x0", "y0", "x1", "y1"]
    follow = runs.join(out, [*keys, "x1", "y1"]).groupBy(*keys, "id", *place).agg(F.max_by("_next", left).alias("ptr"))
    nodes = cut_lineage(follow.withColumns({"best": F.col("id"), "off": F.lit(0).cast("long")}))
    width = 1
    while True:
        ahead = nodes.select(*keys, F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("best").alias("_best"), F.col("off").alias("_off"))
        lower = F.col("_best") < F.col("best")
        nodes = nodes.join(ahead, [*keys, "ptr"]).select(
            *keys, "id", *place, F.col("_ptr").alias("ptr"), F.least("best", "_best").alias("best"),
            F.when(lower, F.col("_off") + width).otherwise(F.col("off")).alias("off"), lower.alias("_lowered"),
        )
        nodes = cut_lineage(nodes)
        if nodes.filter("_lowered").isEmpty():
            break
        nodes = nodes.drop("_lowered")
        width *= 2
    sizes = nodes.groupBy(*keys, "best").agg(F.count("*").alias("_n"))
    return nodes.join(sizes, [*keys, "best"]).select(
        *keys, F.col("best").alias("ring"), F.pmod(F.col("_n") - F.col("off"), F.col("_n")).alias("pos"),
        F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("x1").alias("x_next"), F.col("y1").alias("y_next"),
    )


def ring_measures(corners: DataFrame, keys=("fire_id",)) -> DataFrame:
    """Signed area in cells, length in sides and corner count per ring; sums only, no ring is gathered."""
    x, y, xn, yn = (F.col(c).cast("long") for c in ("x", "y", "x_next", "y_next"))
    return corners.groupBy(*as_list(keys), "ring").agg(
        (F.sum(x * yn - xn * y) / 2).alias("area_cells"),
        F.sum(F.abs(xn - x) + F.abs(yn - y)).alias("n_sides"), F.count("*").alias("n_corners"),
    )


def ring_polygons(corners: DataFrame, site: DataFrame, keys=("fire_id",)) -> DataFrame:
    """Open lon/lat rings ``(keys, ring, outline)``, outer ones counter-clockwise; ``keys`` include ``fire_id``.

    A ring is one nested value here, so it must fit in a row; ``mask_rings`` keeps it as rows.
    """
    keys = as_list(keys)
    at = attach_site(corners, site, [*keys, "ring", "pos"])
    p = geo.to_wgs84(
        (F.col("x") - F.col("nx") / 2.0) * F.col("cell_m"), (F.col("y") - F.col("ny") / 2.0) * F.col("cell_m"), "center_lon", "center_lat"
    )
    listed = F.array_sort(F.collect_list(F.struct("pos", p["lon"].alias("lon"), p["lat"].alias("lat"))))
    rings = at.groupBy(*keys, "ring").agg(listed.alias("_l"))
    return rings.select(*keys, "ring", F.transform("_l", lambda c: F.struct(c["lon"].alias("lon"), c["lat"].alias("lat"))).alias("outline"))
