"""Tracking (T)."""

from pyspark.sql import functions as F

from hazardgrid.operators import decide, track
from hazardgrid.operators.common import rounded
from hazardgrid.plans import frag
from hazardgrid.plans.decide_queries import FLAGGED, _flagged
from hazardgrid.plans.registry import query, r

FRAME = ["fire_id", "t_min"]


@query(
    "T1_relative_minutes",
    """SELECT obs_id, date_diff('second', date_trunc('second', MIN(t) OVER (PARTITION BY fire_id)),
              date_trunc('second', t)) / 60.0 AS t_min FROM observation WHERE kind = 'goes'""",
)
def t1(x):
    return track.relative_minutes(x.observation).select("obs_id", "t_min")


COMPONENT = """
WITH RECURSIVE clat AS (SELECT fire_id, t_min, AVG(lat) AS c FROM hotspot GROUP BY fire_id, t_min),
  xy AS (SELECT h.fire_id, h.t_min, point_id, lon, lat, lon * 111.32 * cos(radians(c)) AS x, lat * 110.57 AS y
         FROM hotspot h JOIN clat k ON k.fire_id = h.fire_id AND k.t_min = h.t_min),
  edge AS (SELECT a.point_id AS u, b.point_id AS v FROM xy a JOIN xy b ON b.fire_id = a.fire_id AND b.t_min = a.t_min
           WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 16.0),
  reach AS (SELECT u, u AS v FROM edge UNION SELECT r.u, e.v FROM reach r JOIN edge e ON e.u = r.v),
  lab AS (SELECT u AS point_id, MIN(v) AS label FROM reach GROUP BY u),
  per AS (SELECT fire_id, t_min, label, COUNT(*) AS n, AVG(lon) AS lon, AVG(lat) AS lat
          FROM xy JOIN lab ON lab.point_id = xy.point_id GROUP BY fire_id, t_min, label)
"""


def clusters(x):
    return track.cluster_points(x.hotspot, FRAME)


@query("T2_clusters", COMPONENT + "SELECT point_id, label FROM lab")
def t2(x):
    return clusters(x).select("point_id", "label")


@query(
    "T3_primary_cluster",
    COMPONENT
    + f"""SELECT fire_id, t_min, label, {r('lon')} AS lon, {r('lat')} AS lat, n_pixels, n_objects FROM (
        SELECT *, CAST(SUM(n) OVER (PARTITION BY fire_id, t_min) AS BIGINT) AS n_pixels,
               COUNT(*) OVER (PARTITION BY fire_id, t_min) AS n_objects,
               row_number() OVER (PARTITION BY fire_id, t_min ORDER BY n DESC, label) AS rn FROM per) q WHERE rn = 1""",
)
def t3(x):
    out = track.primary_clusters(clusters(x), FRAME)
    return out.withColumns({"lon": rounded("lon"), "lat": rounded("lat")})


@query("T4_frame_area")
def t4(x):
    return track.frame_areas(x.hotspot, FRAME).withColumn("area_km2", rounded("area_km2", 3))


TRACK = """SELECT fire_id, t_min, AVG(lon) AS lon, AVG(lat) AS lat, CAST(COUNT(*) AS BIGINT) AS n_pixels,
   COUNT(*) * CAST(4 AS DOUBLE) AS area_km2 FROM {hotspot} GROUP BY fire_id, t_min"""
TRACK_CTE = "tr AS (" + TRACK.replace("{hotspot}", "hotspot") + ")"


def _track(x):
    """Whole-frame centroids with the pixel-count area."""
    return x.spark.sql(TRACK, hotspot=x.hotspot)


_leg = frag.hav("plon", "plat", "lon", "lat")
_head = frag.bearing("a.lon", "a.lat", "b.lon", "b.lat")


@query(
    "T5_track_totals",
    f"""WITH {TRACK_CTE} SELECT fire_id, COUNT(*) AS n_frames, CAST(SUM(n_pixels) AS BIGINT) AS n_detections,
          MAX(area_km2) AS peak_area_km2 FROM tr GROUP BY fire_id""",
)
def t5(x):
    return track.track_summary(_track(x)).select("fire_id", "n_frames", "n_detections", "peak_area_km2")


@query(
    "T5_centroid_path",
    f"WITH {TRACK_CTE} SELECT fire_id, t_min, {r('lon')} AS lon, {r('lat')} AS lat FROM tr",
)
def t5_path(x):
    return track.centroid_path(_track(x)).withColumns({"lon": rounded("lon"), "lat": rounded("lat")})


@query(
    "T6_mean_speed",
    f"""WITH {TRACK_CTE}, l AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lag(t_min) OVER w AS pt
          FROM tr WINDOW w AS (PARTITION BY fire_id ORDER BY t_min))
        SELECT fire_id, {r(f'coalesce(AVG({_leg} / 1000 / ((t_min - pt) / 60)) FILTER (t_min > pt), 0)')} AS mean_ros_kmh
        FROM l GROUP BY fire_id""",
)
def t6(x):
    return track.track_summary(_track(x)).select("fire_id", rounded("mean_ros_kmh").alias("mean_ros_kmh"))


ENDS = f"""WITH {TRACK_CTE}, a AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY fire_id ORDER BY t_min) = 1),
  b AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY fire_id ORDER BY t_min DESC) = 1)"""


@query(
    "T7_net_heading",
    f"{ENDS} SELECT a.fire_id, {r(_head, 5)} AS net_heading_deg FROM a JOIN b ON b.fire_id = a.fire_id",
)
def t7(x):
    return track.track_summary(_track(x)).select("fire_id", rounded("net_heading_deg", 5).alias("net_heading_deg"))


@query(
    "T8_growth",
    f"""{ENDS} SELECT a.fire_id, {r('CASE WHEN b.t_min > a.t_min THEN (b.area_km2 - a.area_km2) / ((b.t_min - a.t_min) / 60) ELSE 0 END')}
        AS growth_km2_per_h FROM a JOIN b ON b.fire_id = a.fire_id""",
)
def t8(x):
    return track.track_summary(_track(x)).select("fire_id", rounded("growth_km2_per_h").alias("growth_km2_per_h"))


@query(
    "T9_relative_detections",
    f"""SELECT date_diff('second', date_trunc('second', MIN(t) OVER (PARTITION BY fire_id)),
              date_trunc('second', t)) / 60.0 AS t_min, {r('lon')} AS lon, {r('lat')} AS lat
        FROM observation WHERE kind = 'goes'""",
)
def t9(x):
    out = track.relative_minutes(x.observation)
    return out.select("t_min", rounded("lon").alias("lon"), rounded("lat").alias("lat"))


_c = frag.cell_of("lon", "lat")
DISK_CTE = f"""spot AS (SELECT h.fire_id, t_min, ny, nx, {frag.clip(_c[0], 'ny')} AS i, {frag.clip(_c[1], 'nx')} AS j
    FROM hotspot h JOIN site s ON s.fire_id = h.fire_id),
  obs_arr AS (SELECT fire_id, CAST(i + di AS INT) AS i, CAST(j + dj AS INT) AS j, MIN(t_min) AS arrival_min
    FROM spot, range(-1, 2) a(di), range(-1, 2) b(dj) WHERE di * di + dj * dj <= 1
     AND i + di BETWEEN 0 AND ny - 1 AND j + dj BETWEEN 0 AND nx - 1 GROUP BY fire_id, i + di, j + dj)"""


@query("T10_observed_arrival", f"WITH {DISK_CTE} SELECT fire_id, i, j, arrival_min FROM obs_arr")
def t10(x):
    return track.observed_arrival(x.hotspot, x.site)


@query(
    "T10_ignition_point",
    f"""SELECT fire_id, {r('AVG(lon)')} AS lon, {r('AVG(lat)')} AS lat FROM hotspot h
        WHERE t_min = (SELECT MIN(t_min) FROM hotspot g WHERE g.fire_id = h.fire_id) GROUP BY fire_id""",
)
def t10_ignition(x):
    return track.ignition_point(x.hotspot).withColumns({"lon": rounded("lon"), "lat": rounded("lat")})


@query(
    "T11_extent_at",
    f"""WITH {TRACK_CTE} SELECT q.obs_id, coalesce(tr.area_km2, 0.0) AS area_km2
        FROM (SELECT event_id AS obs_id, CAST(user_id % 5 AS INT) AS fire_id, CAST(event_id % 400 - 5 AS DOUBLE) AS at_min FROM events) q
        ASOF LEFT JOIN tr ON tr.fire_id = q.fire_id AND q.at_min >= tr.t_min""",
)
def t11(x):
    asked = x.events.selectExpr(
        "event_id AS obs_id", "CAST(user_id % 5 AS INT) AS fire_id", "CAST(event_id % 400 - 5 AS DOUBLE) AS at_min"
    )
    return track.extent_at(_track(x), asked).select("obs_id", "area_km2")


@query(
    "T12_evolution_snapshots",
    f"""WITH {DISK_CTE}, {FLAGGED}, tm AS (SELECT k * 72.0::DOUBLE AS t FROM range(0, 6) g(k)),
        burn AS (SELECT fire_id, t, COUNT(*) FILTER (arrival_min <= t) * 4.0::DOUBLE AS area FROM obs_arr, tm GROUP BY fire_id, t),
        fl AS (SELECT fire_id, t, COUNT(*) FILTER (flag_min + 180 <= t) AS nf,
                      CAST(coalesce(SUM(population) FILTER (flag_min + 180 <= t), 0) AS BIGINT) AS pop FROM resp, tm GROUP BY fire_id, t)
        SELECT b.fire_id, b.t AS t_min, area AS area_km2, CASE WHEN b.t >= 180 THEN 'Forecast' ELSE 'Tracking' END AS phase,
               CASE WHEN b.t >= 180 THEN coalesce(nf, 0) ELSE 0 END AS n_flagged,
               CASE WHEN b.t >= 180 THEN coalesce(pop, 0) ELSE 0 END AS residents
        FROM burn b LEFT JOIN fl ON fl.fire_id = b.fire_id AND fl.t = b.t""",
)
def t12(x):
    arrival = track.observed_arrival(x.hotspot, x.site)
    return track.evolution_snapshots(arrival, _flagged(x), 360.0, 180.0, 2000.0)


@query(
    "T13_cumulative_detections",
    """SELECT fire_id, t_min, CAST(SUM(COUNT(*)) OVER (PARTITION BY fire_id ORDER BY t_min) AS BIGINT) AS n_cum
       FROM hotspot GROUP BY fire_id, t_min""",
)
def t13(x):
    frames = x.hotspot.groupBy("fire_id", "t_min").agg(F.count("*").alias("n"))
    return track.cumulative_detections(frames).select("fire_id", "t_min", "n_cum")
