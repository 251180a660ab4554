"""Grids, masks and spatial joins.

Cells are rows ``(fire_id, i, j)``: i counts north, j counts east. Shapes are rasterised by
generating the cells of a shape from the shape itself, row by row, so the join with cell tables is
an equi-join and never pairs shapes with all cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardgrid.functions import geo
from hazardgrid.operators.common import as_list, attach_group_stats, salted_join

CELL = ["fire_id", "i", "j"]
SITE = ["center_lon", "center_lat", "cell_m", "nx", "ny"]


def attach_site(df: DataFrame, site: DataFrame, spread) -> DataFrame:
    """Grid frame of each row's event; ``spread`` columns salt the few event keys."""
    return salted_join(df, site.select("fire_id", *SITE), "fire_id", as_list(spread))


def grid_cells(site: DataFrame) -> DataFrame:
    """All cells of each event's grid with their local metre coordinates."""
    rows = site.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    cells = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    return cells.select(
        "fire_id", "i", "j",
        geo.axis_metres("j", "nx", "cell_m").alias("x"),
        geo.axis_metres("i", "ny", "cell_m").alias("y"),
    )


def locate(df: DataFrame, site: DataFrame, clip: bool, lon="lon", lat="lat") -> DataFrame:
    """Rows with the cell ``(i, j)`` of their point; outside points are clipped or dropped."""
    p = geo.to_local(lon, lat, "center_lon", "center_lat")
    out = attach_site(df, site, [lon, lat]).withColumn("_p", p)
    out = out.withColumn("i", geo.axis_index(F.col("_p.y"), "ny", "cell_m"))
    out = out.withColumn("j", geo.axis_index(F.col("_p.x"), "nx", "cell_m"))
    if clip:
        out = out.withColumn("i", geo.clip_index("i", "ny")).withColumn("j", geo.clip_index("j", "nx"))
    else:
        out = out.filter(geo.in_bounds("i", "j", "ny", "nx"))
    return out.drop("_p", *SITE)


def _span(lo: Column, hi: Column) -> Column:
    return F.sequence(lo, hi).cast("array<int>")


def _edges(ring: Column) -> Column:
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), nxt.alias("b"))


def polygon_cells(shapes: DataFrame, ring: str, keys) -> DataFrame:
    """Cells whose centre lies in a ring given in cell units (``x`` = j, ``y`` = i).

    Even-odd scan conversion from the sides: one crossing per side and grid row it passes, crossings ranked per
    part and grid row, then the cells between each pair. No ring is copied, and a ring with many vertices is many
    tasks after its first. A multi-polygon is one input row per part; parts are united and tell themselves apart
    by the hash and size of their ring, so repeated rows change nothing. ``shapes`` carries ``nx, ny``. Rings may
    be open or closed; NULL, empty and flat ones have no cells.
    """
    keys = as_list(keys)
    part = ["_part", "_size"]
    # The hash has its own step, below the explode, so that it is taken once a ring.
    parts = shapes.select(*keys, "nx", "ny", F.xxhash64(ring).alias("_part"), F.size(ring).alias("_size"), _edges(F.col(ring)).alias("_sides"))
    sides = parts.select(*keys, *part, "nx", "ny", F.posexplode("_sides").alias("_e", "_s"))
    ax, ay, bx, by = F.col("_s.a.x"), F.col("_s.a.y"), F.col("_s.b.x"), F.col("_s.b.y")
    lo = F.greatest(F.ceil(F.least(ay, by)), F.lit(0))
    hi = F.least(F.ceil(F.greatest(ay, by)) - 1, F.col("ny").cast("long") - 1)
    cuts = sides.filter(lo <= hi).withColumn("i", F.explode(_span(lo, hi)))
    cuts = cuts.select(*keys, *part, "nx", "i", "_e", (ax + (F.col("i") - ay) * (bx - ax) / (by - ay)).alias("_x"))
    # Copies of a part share their ranks, since a side has one crossing a row.
    rank = F.dense_rank().over(Window.partitionBy(*keys, *part, "i").orderBy("_x", "_e"))
    spans = cuts.withColumn("_pair", F.floor((rank - 1) / 2)).groupBy(*keys, *part, "i", "_pair").agg(
        F.min("_x").alias("_from"), F.max("_x").alias("_to"), F.max("nx").alias("nx")
    )
    left = F.greatest(F.ceil("_from"), F.lit(0))
    right = F.least(F.ceil("_to") - 1, F.col("nx").cast("long") - 1)
    return spans.filter(left <= right).withColumn("j", F.explode(_span(left, right))).select(*keys, "i", "j").distinct()


def lonlat_ring_cells(shapes: DataFrame, site: DataFrame, ring: str, keys) -> DataFrame:
    """``polygon_cells`` of lon/lat rings; ``keys`` include ``fire_id`` and spread one event over tasks."""
    keys = as_list(keys)

    def in_cells(p):
        return F.struct(
            (p["x"] / F.col("cell_m") + (F.col("nx") - 1) / 2.0).alias("x"),
            (p["y"] / F.col("cell_m") + (F.col("ny") - 1) / 2.0).alias("y"),
        )

    at = attach_site(shapes.select(*keys, ring), site, keys)
    local = F.transform(F.col(ring), lambda p: geo.to_local(p["lon"], p["lat"], F.col("center_lon"), F.col("center_lat")))
    return polygon_cells(at.withColumn(ring, F.transform(local, in_cells)), ring, keys)


def segment_cells(segments: DataFrame, keys, width: float = 1.0) -> DataFrame:
    """Cells whose centre is within ``width`` cells of a segment ``(i0, j0)-(i1, j1)``.

    Only the stretch of the segment near each grid row is visited, so the work follows its length
    and not its bounding box. ``segments`` carries ``nx, ny``.
    """
    keys = as_list(keys)
    i0, j0, i1, j1 = (F.col(c) for c in ("i0", "j0", "i1", "j1"))
    di, dj = i1 - i0, j1 - j0
    lo = F.greatest(F.ceil(F.least(i0, i1) - width), F.lit(0))
    hi = F.least(F.floor(F.greatest(i0, i1) + width), F.col("ny").cast("long") - 1)
    rows = segments.filter(lo <= hi).withColumn("i", F.explode(_span(lo, hi)))
    t_a, t_b = (F.col("i") - width - i0) / di, (F.col("i") + width - i0) / di
    t_lo = F.when(di == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(t_a, t_b)))
    t_hi = F.when(di == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(t_a, t_b)))
    j_a, j_b = j0 + dj * t_lo, j0 + dj * t_hi
    left = F.greatest(F.ceil(F.least(j_a, j_b) - width), F.lit(0))
    right = F.least(F.floor(F.greatest(j_a, j_b) + width), F.col("nx").cast("long") - 1)
    near = rows.filter(left <= right).withColumn("j", F.explode(_span(left, right)))
    return near.filter(segment_distance2("i", "j", i0, j0, i1, j1) <= width * width).select(
        *keys, "i", "j"
    )


def segment_distance2(i, j, i0, j0, i1, j1) -> Column:
    """Squared distance of a point from a segment."""
    i, j = F.col(i), F.col(j)
    di, dj = i1 - i0, j1 - j0
    len2 = di * di + dj * dj
    t = F.when(len2 == 0, 0.0).otherwise(((i - i0) * di + (j - j0) * dj) / len2)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    a, b = i - i0 - t * di, j - j0 - t * dj
    return a * a + b * b


def disk_offsets(radius: Column) -> Column:
    """Array of ``(di, dj)`` with ``di^2 + dj^2 <= r^2`` for an integer radius column."""
    axis = F.sequence(-radius, radius)
    square = F.flatten(
        F.transform(axis, lambda a: F.transform(axis, lambda b: F.struct(a.alias("di"), b.alias("dj"))))
    )
    return F.filter(
        square, lambda o: o["di"] * o["di"] + o["dj"] * o["dj"] <= radius * radius
    )


def disk_cells(points: DataFrame, site: DataFrame, radius_m: float, keep=()) -> DataFrame:
    """In-bounds cells of integer-radius disks around points; each point's own cell is clipped."""
    at = attach_site(locate(points, site, clip=True), site, ["i", "j"])
    r = F.rint(F.lit(float(radius_m)) / F.col("cell_m")).cast("int")
    out = at.withColumn("_o", F.explode(disk_offsets(r)))
    out = out.withColumn("i", F.col("i") + F.col("_o.di")).withColumn("j", F.col("j") + F.col("_o.dj"))
    return out.filter(geo.in_bounds("i", "j", "ny", "nx")).select("fire_id", *keep, "i", "j")


def degree_disk_cells(points: DataFrame, site: DataFrame, radius_deg: float, keep=()) -> DataFrame:
    """Cells whose centre is within ``radius_deg`` degrees of a point, both axes taken as equal."""
    at = attach_site(points, site, ["lon", "lat"]).withColumn(
        "_p", geo.to_local("lon", "lat", "center_lon", "center_lat")
    )
    reach = F.lit(radius_deg * 111_700.0) / F.col("cell_m") + 1
    ci = F.col("_p.y") / F.col("cell_m") + (F.col("ny") - 1) / 2.0
    cj = F.col("_p.x") / F.col("cell_m") + (F.col("nx") - 1) / 2.0
    lo_i, hi_i = F.greatest(F.floor(ci - reach), F.lit(0)), F.least(F.ceil(ci + reach), F.col("ny").cast("long") - 1)
    lo_j, hi_j = F.greatest(F.floor(cj - reach), F.lit(0)), F.least(F.ceil(cj + reach), F.col("nx").cast("long") - 1)
    cells = (
        at.filter((lo_i <= hi_i) & (lo_j <= hi_j))
        .withColumn("i", F.explode(_span(lo_i, hi_i)))
        .withColumn("j", F.explode(_span(lo_j, hi_j)))
        .withColumn(
            "_c",
            geo.to_wgs84(
                geo.axis_metres("j", "nx", "cell_m"), geo.axis_metres("i", "ny", "cell_m"),
                "center_lon", "center_lat",
            ),
        )
    )
    dx, dy = F.col("_c.lon") - F.col("lon"), F.col("_c.lat") - F.col("lat")
    return cells.filter(dx * dx + dy * dy <= radius_deg * radius_deg).select("fire_id", *keep, "i", "j")


def gradient(cells: DataFrame, value: str, cell_m) -> DataFrame:
    """Central differences, one-sided at the edges: ``gx`` along j and ``gy`` along i."""
    cell_m = cell_m if isinstance(cell_m, Column) else F.lit(float(cell_m))
    v = F.col(value)

    def slope(line: list[str], along: str) -> Column:
        w = Window.partitionBy(*line).orderBy(along)
        before, after = F.lag(v).over(w), F.lead(v).over(w)
        steps = F.when(before.isNotNull(), 1).otherwise(0) + F.when(after.isNotNull(), 1).otherwise(0)
        rise = F.coalesce(after, v) - F.coalesce(before, v)
        return F.when(steps == 0, F.lit(0.0)).otherwise(rise / (steps * cell_m))

    return cells.withColumn("gx", slope(["fire_id", "i"], "j")).withColumn(
        "gy", slope(["fire_id", "j"], "i")
    )


def hillshade(cells: DataFrame, cell_m, azimuth=315.0, altitude=45.0) -> DataFrame:
    """Shaded relief scaled to 0..1 over each event."""
    g = gradient(cells, "elevation", cell_m)
    slope = F.pi() / 2 - F.atan(F.hypot("gx", "gy"))
    aspect = F.atan2(-F.col("gx"), F.col("gy"))
    az, alt = F.radians(F.lit(360.0 - azimuth + 90.0)), F.radians(F.lit(altitude))
    shade = F.sin(alt) * F.sin(slope) + F.cos(alt) * F.cos(slope) * F.cos(az - aspect)
    shaded = attach_group_stats(
        g.select(*CELL, shade.alias("_s")), "fire_id", _lo=F.min("_s"), _hi=F.max("_s")
    )
    scaled = (F.col("_s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)
    return shaded.select(*CELL, F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)).alias("shade"))


def corner_values(cells: DataFrame, value: str) -> DataFrame:
    """Each cell with the values of its three neighbours up and right, for bilinear sampling."""
    row = Window.partitionBy("fire_id", "i").orderBy("j")
    col = Window.partitionBy("fire_id", "j").orderBy("i")
    packed = cells.select(*CELL, F.col(value).alias("e00"), F.lead(value).over(row).alias("e01"))
    return packed.withColumn("e10", F.lead("e00").over(col)).withColumn("e11", F.lead("e01").over(col))


def sample_bilinear(points: DataFrame, cells: DataFrame, value: str, fi: str, fj: str, out: str):
    """Value at fractional cell coordinates; the nearest cell outside the interior.

    ``points`` carries ``fire_id, nx, ny``. The four corners come with one equi-join.
    """
    i0, j0 = F.floor(fi).cast("int"), F.floor(fj).cast("int")
    inside = (i0 >= 0) & (j0 >= 0) & (i0 < F.col("ny") - 1) & (j0 < F.col("nx") - 1)
    at = (
        points.withColumn("_in", inside)
        .withColumn("i", F.when(inside, i0).otherwise(geo.clip_index(F.rint(fi).cast("int"), "ny")))
        .withColumn("j", F.when(inside, j0).otherwise(geo.clip_index(F.rint(fj).cast("int"), "nx")))
    )
    di, dj = F.col(fi) - F.col("i"), F.col(fj) - F.col("j")
    mix = (
        F.col("e00") * (1 - di) * (1 - dj)
        + F.col("e01") * (1 - di) * dj
        + F.col("e10") * di * (1 - dj)
        + F.col("e11") * di * dj
    )
    corners = corner_values(cells, value)
    return (
        at.join(corners, CELL, "left")
        .withColumn(out, F.when(F.col("_in"), mix).otherwise(F.col("e00")))
        .drop("_in", "i", "j", "e00", "e01", "e10", "e11")
    )


def boundary_edges(mask: DataFrame, keys=("fire_id",)) -> DataFrame:
    """Sides of masked cells that face an unmasked cell: ``(i, j, side)``."""
    keys = as_list(keys)
    sides = F.array(
        *[
            F.struct(F.lit(s).alias("side"), F.lit(a).alias("di"), F.lit(b).alias("dj"))
            for s, a, b in (("n", 1, 0), ("s", -1, 0), ("e", 0, 1), ("w", 0, -1))
        ]
    )
    cells = mask.select(*keys, "i", "j").distinct()
    facing = (
        cells.withColumn("_s", F.explode(sides))
        .withColumn("ni", F.col("i") + F.col("_s.di"))
        .withColumn("nj", F.col("j") + F.col("_s.dj"))
    )
    other = cells.select(*keys, F.col("i").alias("ni"), F.col("j").alias("nj"))
    return facing.join(other, [*keys, "ni", "nj"], "left_anti").select(*keys, "i", "j", "_s.side")


def mask_overlap(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """IoU and Dice of two cell masks per key; 0 when either is empty."""
    keys = as_list(keys)
    both = a.select(*keys, "i", "j").distinct().withColumn("_a", F.lit(1)).join(
        b.select(*keys, "i", "j").distinct().withColumn("_b", F.lit(1)), [*keys, "i", "j"], "full"
    )
    out = both.groupBy(*keys).agg(
        F.count("_a").alias("na"),
        F.count("_b").alias("nb"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("inter"),
    )
    union = F.col("na") + F.col("nb") - F.col("inter")
    return out.select(
        *keys,
        (F.col("inter") / union).alias("iou"),
        (F.col("inter") * 2.0 / (F.col("na") + F.col("nb"))).alias("dice"),
    )


def mean_frame_iou(pred: DataFrame, truth: DataFrame, frames: DataFrame, frame, keys) -> DataFrame:
    """Mean over the frames of each key of the masks' IoU; a frame without either mask counts as 1."""
    keys, frame = as_list(keys), as_list(frame)
    per = mask_overlap(pred, truth, [*keys, *frame]).select(*keys, *frame, "iou")
    every = frames.select(*keys, *frame).distinct().join(per, [*keys, *frame], "left")
    return every.groupBy(*keys).agg(F.count("*").alias("n_frames"), F.avg(F.coalesce("iou", F.lit(1.0))).alias("mean_iou"))


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull vertices of distinct points, counter-clockwise (monotone chain)."""
    pts = np.unique(points, axis=0)
    if len(pts) > 64:
        # Only the lowest and highest point of each x can be a vertex.
        first = np.r_[True, pts[1:, 0] != pts[:-1, 0]]
        pts = pts[first | np.r_[first[1:], True]]
    if len(pts) <= 2:
        return pts

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) >= 2:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                out.pop()
            out.append((p[0], p[1]))
        return out

    lower, upper = chain(pts), chain(pts[::-1])
    return np.array(lower[:-1] + upper[:-1])


def convex_hulls(points: DataFrame, keys) -> DataFrame:
    """Hull ring ``array<struct<lon, lat>>`` per key.

    Each partition first reduces its own points to their hull, and only those few vertices are
    shuffled, so a key with a third of all points does not gather them in one task.
    """
    keys = as_list(keys)
    pts = points.select(*keys, F.col("lon").cast("double"), F.col("lat").cast("double"))

    def hulls_of(pdf):
        parts = []
        for key, grp in pdf.groupby(keys, sort=False, dropna=False):
            part = pd.DataFrame(_hull(grp[["lon", "lat"]].to_numpy()), columns=["lon", "lat"])
            for name, value in zip(keys, key):
                part[name] = value
            parts.append(part[pdf.columns])
        return pd.concat(parts) if parts else pdf.iloc[:0]

    def local(batches):
        held, rows, limit = [], 0, 200_000
        for pdf in batches:
            held.append(hulls_of(pdf))
            rows += len(held[-1])
            if rows > limit:
                held = [hulls_of(pd.concat(held))]
                rows = len(held[0])
                limit = max(limit, 2 * rows)
        if held:
            yield hulls_of(pd.concat(held))

    reduced = pts.mapInPandas(local, pts.schema)

    def final(key, pdf):
        hull = _hull(pdf[["lon", "lat"]].to_numpy())
        ring = [{"lon": float(a), "lat": float(b)} for a, b in hull]
        return pd.DataFrame([[*key, ring]], columns=[*keys, "ring"])

    head = ", ".join(f"{k} {pts.schema[k].dataType.simpleString()}" for k in keys)
    return reduced.groupBy(*keys).applyInPandas(
        final, f"{head}, ring array<struct<lon:double,lat:double>>"
    )
