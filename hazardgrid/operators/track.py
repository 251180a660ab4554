"""Detection frames to clusters, tracks and the observed arrival field."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardgrid import constants as K
from hazardgrid.functions import geo
from hazardgrid.operators import spatial
from hazardgrid.operators.common import as_list, attach_group_stats, first_rows
from hazardgrid.session import cut_lineage


def relative_minutes(points: DataFrame, t: str = "t") -> DataFrame:
    """Detections of the geostationary feed with minutes since the event's first one."""
    goes = points.filter((F.col("kind") == "goes") & F.col("lon").isNotNull())
    start = attach_group_stats(goes, "fire_id", _t0=F.min(t))
    mins = F.timestamp_diff("SECOND", F.date_trunc("second", "_t0"), F.date_trunc("second", F.col(t)))
    return start.withColumn("t_min", mins / F.lit(60.0)).drop("_t0")


def _box(prefix: str = "") -> list[Column]:
    return [
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    ]


def _span(lo: str, hi: str, least: bool) -> Column:
    """Least or greatest distance between two boxes along one axis."""
    a0, a1, b0, b1 = (F.col(f"{s}.{c}") for s in ("a", "b") for c in (lo, hi))
    if least:
        return F.greatest(F.lit(0.0), a0 - b1, b0 - a1)
    return F.greatest(F.abs(a1 - b0), F.abs(b1 - a0))


def cluster_points(points: DataFrame, frame, pos: str = "point_id", eps_km: float = K.CLUSTER_EPS_KM):
    """Cluster label per point: points within ``eps_km`` of each other share a cluster.

    ``points`` has ``frame.., pos, lon, lat``; the label is the least ``pos`` of the cluster. Points
    fall into buckets whose diagonal is eps, so a bucket is one cluster and never needs pairs of its
    points. Neighbouring buckets are joined by their tight boxes where those decide, then by a finer
    grid of boxes, and by points only for what is still open. Labels spread over the bucket graph,
    whose nodes have at most twenty neighbours.
    """
    frame = as_list(frame)
    eps = float(eps_km)
    lat0 = attach_group_stats(points.select(*frame, pos, "lon", "lat"), frame, _lat=F.avg("lat"))
    x = F.col("lon") * K.KM_PER_DEG_LON * F.cos(F.radians("_lat"))
    pts = lat0.withColumns({"x": x, "y": F.col("lat") * K.KM_PER_DEG_LAT}).drop("_lat")
    side = eps / math.sqrt(2.0) * (1 - 1e-9)
    pts = pts.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    pts = cut_lineage(pts)
    spots = pts.groupBy(*frame, "cx", "cy", "x", "y").agg(F.min(pos).alias("_p"))
    cells = cut_lineage(spots.groupBy(*frame, "cx", "cy").agg(F.min("_p").alias("node"), *_box()))

    steps = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in steps]))
    a = cells.withColumn("_s", step)
    a = a.withColumns({"nx": F.col("cx") + F.col("_s.dx"), "ny": F.col("cy") + F.col("_s.dy")}).drop("_s")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in frame]
    pairs = a.alias("a").join(
        cells.alias("b"), [*same, F.col("a.nx") == F.col("b.cx"), F.col("a.ny") == F.col("b.cy")]
    )
    least = F.hypot(_span("x0", "x1", True), _span("y0", "y1", True))
    most = F.hypot(_span("x0", "x1", False), _span("y0", "y1", False))
    pairs = pairs.filter(least <= eps).select(
        *[F.col(f"a.{c}") for c in frame], F.col("a.node").alias("u"), F.col("b.node").alias("v"),
        (most <= eps).alias("sure"),
    )
    pairs = cut_lineage(pairs)
    edges = pairs.filter("sure").select(*frame, "u", "v")
    open_pairs = pairs.filter(~F.col("sure")).select(*frame, "u", "v")

    fine_side = side / 8
    fine = spots.withColumns({"fx": F.floor(F.col("x") / fine_side), "fy": F.floor(F.col("y") / fine_side)})
    fine = fine.join(cells.select(*frame, "cx", "cy", "node"), [*frame, "cx", "cy"])
    boxes = fine.groupBy(*frame, "node", "fx", "fy").agg(*_box())
    sub = (
        open_pairs.alias("p")
        .join(boxes.alias("a"), [*[F.col(f"p.{c}") == F.col(f"a.{c}") for c in frame], F.col("p.u") == F.col("a.node")])
        .join(boxes.alias("b"), [*[F.col(f"p.{c}") == F.col(f"b.{c}") for c in frame], F.col("p.v") == F.col("b.node")])
        .filter(least <= eps)
        .select(
            *[F.col(f"p.{c}") for c in frame], "p.u", "p.v", F.col("a.fx").alias("ax"), F.col("a.fy").alias("ay"),
            F.col("b.fx").alias("bx"), F.col("b.fy").alias("by"), (most <= eps).alias("sure"),
        )
    )
    sub = cut_lineage(sub)
    by_box = sub.filter("sure").select(*frame, "u", "v").distinct()
    left = sub.join(by_box, [*frame, "u", "v"], "left_anti")
    p_a = fine.select(*frame, F.col("node").alias("u"), F.col("fx").alias("ax"), F.col("fy").alias("ay"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    p_b = fine.select(*frame, F.col("node").alias("v"), F.col("fx").alias("bx"), F.col("fy").alias("by"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    by_point = (
        left.join(p_a, [*frame, "u", "ax", "ay"])
        .join(p_b, [*frame, "v", "bx", "by"])
        .filter(F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")) <= eps)
        .select(*frame, "u", "v")
        .distinct()
    )
    edges = edges.unionByName(by_box).unionByName(by_point)
    labels = connected_labels(cells.select(*frame, "node"), edges, frame)
    named = cells.select(*frame, "cx", "cy", "node").join(labels, [*frame, "node"])
    return pts.join(named.select(*frame, "cx", "cy", "label"), [*frame, "cx", "cy"]).select(
        *frame, pos, "lon", "lat", "label"
    )


def connected_labels(nodes: DataFrame, edges: DataFrame, keys) -> DataFrame:
    """Least node id of each node's component, by label spreading with pointer jumping.

    Each round takes the least label among the neighbours and then that label's own label, so long
    chains shorten quickly. Rounds are written to the shared folder.
    """
    keys = as_list(keys)
    both = cut_lineage(
        edges.select(*keys, "u", "v").unionByName(
            edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))
        ).distinct()
    )
    labels = cut_lineage(nodes.withColumn("label", F.col("node")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), [*keys, "v"]).groupBy(*keys, "u").agg(
            F.min("label").alias("_n")
        )
        hop = labels.join(near.withColumnRenamed("u", "node"), [*keys, "node"], "left").withColumn(
            "_l", F.least("label", F.coalesce("_n", F.col("label")))
        )
        jump = labels.select(*keys, F.col("node").alias("_l"), F.col("label").alias("_j"))
        moved = hop.join(jump, [*keys, "_l"]).select(
            *keys, "node", F.col("label").alias("_old"), F.least("_l", "_j").alias("label")
        )
        moved = cut_lineage(moved)
        changed = not moved.filter(F.col("_old") != F.col("label")).isEmpty()
        labels = moved.drop("_old")
        if not changed:
            return labels


def primary_clusters(clustered: DataFrame, frame, pos: str = "point_id") -> DataFrame:
    """Largest cluster per frame (ties: the earliest point) with its centroid, and frame counts."""
    frame = as_list(frame)
    per = clustered.groupBy(*frame, "label").agg(
        F.count("*").alias("n"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat")
    )
    totals = per.groupBy(*frame).agg(F.sum("n").alias("n_pixels"), F.count("*").alias("n_objects"))
    top = first_rows(per, frame, [F.col("n").desc(), F.col("label")])
    return top.join(totals, frame).select(*frame, "label", "lon", "lat", "n_pixels", "n_objects")


def frame_areas(points: DataFrame, frame, pixel_km: float = K.PIXEL_KM) -> DataFrame:
    """Hull extent per frame in km2; frames without a polygon count full pixels."""
    frame = as_list(frame)
    n = points.groupBy(*frame).agg(F.count("*").alias("n_pixels"))
    hulls = spatial.convex_hulls(points, frame)
    hull_km2 = geo.polygon_area_m2("ring") / 1e6
    area = F.when(F.size("ring") >= 3, hull_km2).otherwise(F.col("n_pixels") * pixel_km**2)
    floor = F.col("n_pixels") * (pixel_km / 2) ** 2
    return hulls.join(n, frame).select(*frame, "n_pixels", F.greatest(area, floor).alias("area_km2"))


def _along() -> Window:
    return Window.partitionBy("fire_id").orderBy("t_min")


def track_summary(track: DataFrame) -> DataFrame:
    """Per event: frames, detections, peak area, mean speed, net heading and growth.

    ``track(fire_id, t_min, lon, lat, area_km2, n_pixels)`` has one row per frame.
    """
    w = _along()
    dt = (F.col("t_min") - F.lag("t_min").over(w)) / 60.0
    km = geo.haversine_m(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat") / 1000.0
    legs = track.withColumn("_dt", dt).withColumn("_km", km)
    at = F.struct("lon", "lat", "area_km2")
    out = legs.groupBy("fire_id").agg(
        F.count("*").alias("n_frames"),
        F.sum("n_pixels").alias("n_detections"),
        F.max("area_km2").alias("peak_area_km2"),
        F.coalesce(F.avg(F.when(F.col("_dt") > 0, F.col("_km") / F.col("_dt"))), F.lit(0.0)).alias("mean_ros_kmh"),
        F.min_by(at, "t_min").alias("_a"),
        F.max_by(at, "t_min").alias("_b"),
        ((F.max("t_min") - F.min("t_min")) / 60.0).alias("_h"),
    )
    heading = geo.bearing_deg(F.col("_a.lon"), F.col("_a.lat"), F.col("_b.lon"), F.col("_b.lat"))
    growth = (F.col("_b.area_km2") - F.col("_a.area_km2")) / F.col("_h")
    return out.select(
        "fire_id", "n_frames", "n_detections", "peak_area_km2", "mean_ros_kmh",
        F.when(F.col("n_frames") < 2, F.lit(0.0)).otherwise(heading).alias("net_heading_deg"),
        F.when(F.col("_h") > 0, growth).otherwise(F.lit(0.0)).alias("growth_km2_per_h"),
    )


def centroid_path(track: DataFrame) -> DataFrame:
    return track.select("fire_id", "t_min", "lon", "lat").orderBy("fire_id", "t_min")


def observed_arrival(detections: DataFrame, site: DataFrame, disk_m: float = K.TRUTH_DISK_M) -> DataFrame:
    """Earliest minute per cell over the disks of all detections."""
    cells = spatial.disk_cells(detections, site, disk_m, keep=["t_min"])
    return cells.groupBy(*spatial.CELL).agg(F.min("t_min").alias("arrival_min"))


def ignition_point(detections: DataFrame) -> DataFrame:
    """Mean point of each event's first frame."""
    first = attach_group_stats(detections, "fire_id", _t0=F.min("t_min")).filter(F.col("t_min") == F.col("_t0"))
    return first.groupBy("fire_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def extent_at(track: DataFrame, asked: DataFrame) -> DataFrame:
    """Area of the latest frame at or before each asked minute, 0 before the first.

    Distinct (event, minute) pairs are looked up once and joined back, so any number of requests for the
    same minutes costs one lookup each.
    """
    from hazardgrid.operators.asof import asof_join, width_bucket_of

    once = asked.select("fire_id", "at_min").distinct()
    found = asof_join(once, track, "fire_id", "at_min", "t_min", ["area_km2"], width_bucket_of(60.0))
    found = found.withColumn("area_km2", F.coalesce("area_km2", F.lit(0.0)))
    return asked.join(found, ["fire_id", "at_min"])


def evolution_snapshots(
    arrival: DataFrame, responses: DataFrame, window_min: float, assim_min: float, cell_m: float, n: int = 6
) -> DataFrame:
    """Burned area, phase and flagged places per event at ``n`` even times.

    One conditional count per time; the cells are not multiplied by the times.
    """
    times = [window_min * k / (n - 1) for k in range(n)]
    per = arrival.groupBy("fire_id").agg(
        *[F.count_if(F.col("arrival_min") <= t).alias(f"b{k}") for k, t in enumerate(times)]
    )
    flags = responses.groupBy("fire_id").agg(
        *[F.count_if(F.col("lead_min") + assim_min <= t).alias(f"f{k}") for k, t in enumerate(times)],
        *[
            F.sum(F.when(F.col("lead_min") + assim_min <= t, F.col("residents"))).alias(f"r{k}")
            for k, t in enumerate(times)
        ],
    )
    zero = F.lit(0).cast("long")
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("t_min"),
                (F.col(f"b{k}") * float(cell_m) ** 2 / 1e6).alias("area_km2"),
                F.lit("Forecast" if t >= assim_min else "Tracking").alias("phase"),
                (F.coalesce(f"f{k}", zero) if t >= assim_min else zero).alias("n_flagged"),
                (F.coalesce(f"r{k}", zero) if t >= assim_min else zero).alias("residents"),
            )
            for k, t in enumerate(times)
        ]
    )
    return per.join(flags, "fire_id", "left").select("fire_id", F.inline(rows))


def cumulative_detections(frames: DataFrame) -> DataFrame:
    """Running total of detections per event; one row per frame."""
    return frames.withColumn(
        "n_cum", F.sum("n").over(_along().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
