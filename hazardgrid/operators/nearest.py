"""Exact distance from query points to the nearest point of a set, per key.

First the 3 x 3 neighbourhood of buckets is searched with one equi-join; a hit within one bucket
width is final. The rest descends a pyramid of ever smaller blocks. Each block carries the tight box
of its points, so its least and greatest distance bound the answer and every block that cannot hold
it is dropped before its children are looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardgrid.operators.common import as_list, salted_join
from hazardgrid.session import cut_lineage


#: Blocks of a key that every open query may meet at the top of the pyramid.
TOP_BLOCKS = 256


def _gap(v, lo, hi):
    return F.greatest(F.lit(0.0), lo - v, v - hi)


def _reach(v, lo, hi):
    return F.greatest(F.abs(v - lo), F.abs(v - hi))


def nearest_distance(
    queries: DataFrame,
    points: DataFrame,
    keys,
    size: float = 2.0,
    levels: int = 2,
    factor: int = 16,
    query_t: str | None = None,
    point_t: str | None = None,
    unique_points: bool = False,
    out: str = "distance",
    with_point: bool = False,
) -> DataFrame:
    """Distinct ``(keys, x, y)`` with ``out``: the distance to the nearest point of the key.

    With ``query_t`` and ``point_t`` only points with ``point_t <= query_t`` count. NULL when there
    is none. ``unique_points`` says that no point of a key repeats, which saves an aggregate.
    ``with_point`` carries the point itself through the search as ``px, py``; of points whose squared
    distance agrees to 12 decimals the least (y, x) is it. ``levels`` is the least number of block levels:
    more are added until the top level has few blocks.
    """
    keys = as_list(keys)
    q_cols = [*keys, "x", "y"] + ([query_t] if query_t else [])
    q = queries.select(*q_cols).distinct().withColumnsRenamed({"x": "qx", "y": "qy"})
    q_id = [*keys, "qx", "qy"] + ([query_t] if query_t else [])
    bucket = {c: F.floor(F.col(v) / size) for c, v in (("bx", "x"), ("by", "y"))}
    pts = points.select(
        *keys, F.col("x").cast("double"), F.col("y").cast("double"),
        (F.col(point_t) if point_t else F.lit(0)).alias("_t"),
    )
    if not unique_points:
        pts = pts.groupBy(*keys, "x", "y").agg(F.min("_t").alias("_t"))
    pts = pts.withColumns(bucket)
    live = F.col("_t") <= F.col(query_t) if query_t else F.lit(True)

    around = q
    for b, v in (("bx", "qx"), ("by", "qy")):
        own = F.floor(F.col(v) / size)
        around = around.withColumn(b, F.explode(F.array(own - 1, own, own + 1)))
    d = F.when(live, F.hypot(F.col("x") - F.col("qx"), F.col("y") - F.col("qy")))
    first = F.struct(F.round(d * d, 12).alias("d2"), F.col("y"), F.col("x"), d.alias("d"))
    best = F.min(F.when(d.isNotNull(), first))
    near = around.join(pts, [*keys, "bx", "by"], "left").groupBy(*q_id).agg(best.alias("_best"))
    near = near.withColumn("_near", F.col("_best.d"))
    # Written once: both branches below read it, and the pyramid is skipped when nothing is open.
    near = cut_lineage(near)
    got = [F.col("_best.d").alias(out)] + ([F.col("_best.x").alias("px"), F.col("_best.y").alias("py")] if with_point else [])
    settled = near.filter(F.col("_near") <= size).select(*q_id, *got)
    open_q = near.filter(F.col("_near").isNull() | (F.col("_near") > size)).drop("_best")

    box = [F.min("_t").alias("_t")]
    box += [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    edges = {"x0": F.col("x"), "x1": F.col("x"), "y0": F.col("y"), "y1": F.col("y")}
    if open_q.isEmpty():
        return settled.withColumnsRenamed({"qx": "x", "qy": "y"})
    blocks = [cut_lineage(pts.withColumns(edges).groupBy(*keys, "bx", "by").agg(*box))]
    while len(blocks) <= levels or not blocks[-1].groupBy(*keys).count().filter(F.col("count") > TOP_BLOCKS).isEmpty():
        up = blocks[-1].withColumns({c: F.floor(F.col(c) / factor) for c in ("bx", "by")})
        blocks.append(cut_lineage(up.groupBy(*keys, "bx", "by").agg(*box)))
    levels = len(blocks) - 1

    def keep_possible(cand: DataFrame) -> DataFrame:
        lo = F.hypot(_gap(F.col("qx"), F.col("x0"), F.col("x1")), _gap(F.col("qy"), F.col("y0"), F.col("y1")))
        hi = F.hypot(_reach(F.col("qx"), F.col("x0"), F.col("x1")), _reach(F.col("qy"), F.col("y0"), F.col("y1")))
        per_query = Window.partitionBy(*q_id)
        bound = F.least(F.min("_hi").over(per_query), F.col("_near"))
        return (
            cand.filter(live)
            .withColumn("_lo", lo)
            .withColumn("_hi", hi)
            .withColumn("_bound", bound)
            .filter(F.col("_lo") <= F.col("_bound") + 1e-9)
            .select(*q_id, "_near", "bx", "by")
        )

    cand = keep_possible(salted_join(open_q, blocks[-1], keys, ["qx", "qy"]))
    for level in reversed(range(levels)):
        child = blocks[level].withColumns(
            {"px": F.floor(F.col("bx") / factor), "py": F.floor(F.col("by") / factor)}
        )
        parent = cand.withColumnsRenamed({"bx": "px", "by": "py"})
        cand = keep_possible(parent.join(child, [*keys, "px", "py"]))
    far_hit = (
        cand.join(pts, [*keys, "bx", "by"])
        .groupBy(*q_id)
        .agg(best.alias("_best"))
        .select(*q_id, *got)
    )
    same = [F.col(f"o.{c}") == F.col(f"f.{c}") for c in q_id]
    far = open_q.alias("o").join(far_hit.alias("f"), same, "left").select(
        *[F.col(f"o.{c}") for c in q_id], *[F.col(f"f.{c}") for c in ([out, "px", "py"] if with_point else [out])]
    )
    return settled.unionByName(far).withColumnsRenamed({"qx": "x", "qy": "y"})
