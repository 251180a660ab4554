"""Camera geometry (K)."""

from pyspark.sql import functions as F

from hazardgrid.operators import assimilate, camera, spatial
from hazardgrid.operators.common import rounded
from hazardgrid.plans import frag
from hazardgrid.plans.registry import query, r
from hazardgrid.session import cut_lineage

STEP, RANGE = 1000.0, 25000.0
_tilt = """CASE WHEN n < 5 THEN 0.0 ELSE ((degrees(atan2(CASE WHEN abs(b) > 1e-12 THEN b WHEN a >= c THEN 1.0 ELSE 0.0 END,
   -(CASE WHEN abs(b) > 1e-12 THEN (a + c) / 2 + sqrt((a - c) / 2 * (a - c) / 2 + b * b) - a WHEN a >= c THEN 0.0 ELSE 1.0 END))) + 180.0) % 180.0 + 180.0) % 180.0 - 90.0 END"""
STATE = """st AS (SELECT frame_id, MAX(camera_id) AS camera_id, COUNT(*) AS n, AVG(px) AS cx, AVG(py) AS cy, var_samp(px) AS a, covar_samp(px, py) AS b, var_samp(py) AS c
  FROM mask_pixel GROUP BY frame_id)"""


def _frames(x):
    return x.mask_pixel.select("frame_id", "camera_id").distinct().withColumn("confidence", F.lit(0.8))


@query(
    "K1_frame_state",
    f"""WITH {STATE} SELECT frame_id, n AS area_px, {r('cx')} AS cx, {r('cy')} AS cy,
          {r('coalesce((n - lag(n) OVER (PARTITION BY camera_id ORDER BY frame_id)) / 60.0, 0)')} AS growth_px_s, 0.8::DOUBLE AS confidence FROM st""",
)
def k1(x):
    out = camera.frame_states(x.mask_pixel.drop("camera_id"), _frames(x))
    return out.select(
        "frame_id", "area_px", rounded("cx").alias("cx"), rounded("cy").alias("cy"), rounded("growth_px_s").alias("growth_px_s"), "confidence"
    )


@query("K2_plume_tilt", f"WITH {STATE} SELECT frame_id, {r(_tilt, 4)} AS tilt_deg FROM st")
def k2(x):
    return x.mask_pixel.groupBy("frame_id").agg(rounded(camera.plume_tilt(), 4).alias("tilt_deg"))


_f = "((image_width / 2.0) / tan(radians(fov_deg) / 2.0))"
BEARING = f"""br AS (SELECT m.frame_id, c.*, ((pan_deg + degrees(atan2(cx - image_width / 2.0, {_f}))) % 360.0 + 360.0) % 360.0 AS bearing_deg
  FROM (SELECT frame_id, camera_id, AVG(px) AS cx FROM (SELECT DISTINCT frame_id, camera_id, px FROM mask_pixel) q GROUP BY frame_id, camera_id) m
  JOIN camera c ON c.camera_id = m.camera_id)"""


@query("K3_plume_bearing", f"WITH {BEARING} SELECT frame_id, {r('bearing_deg')} AS bearing_deg FROM br")
def k3(x):
    out = camera.plume_bearings(x.mask_pixel, x.camera)
    return out.select("frame_id", rounded("bearing_deg").alias("bearing_deg"))


_bl = frag.local("lon", "lat", "lon0", "lat0")
_bw = frag.wgs("sx", "sy", "lon0", "lat0")


@query(
    "K4_triangulate",
    f"""WITH {BEARING}, mid AS (SELECT fire_id, AVG(lat) AS lat0, AVG(lon) AS lon0, COUNT(*) AS n FROM br GROUP BY fire_id),
        p AS (SELECT br.fire_id, lat0, lon0, n, {_bl[0]} AS x, {_bl[1]} AS y, sin(radians(bearing_deg)) AS s, cos(radians(bearing_deg)) AS c
              FROM br JOIN mid ON mid.fire_id = br.fire_id),
        m AS (SELECT fire_id, MAX(lat0) AS lat0, MAX(lon0) AS lon0, MAX(n) AS n, SUM(1 - s * s) AS a, SUM(-s * c) AS b, SUM(1 - c * c) AS d,
                     SUM((1 - s * s) * x - s * c * y) AS b1, SUM(-s * c * x + (1 - c * c) * y) AS b2 FROM p GROUP BY fire_id),
        so AS (SELECT *, (d * b1 - b * b2) / (a * d - b * b) AS sx, (a * b2 - b * b1) / (a * d - b * b) AS sy FROM m WHERE n >= 2)
        SELECT so.fire_id, {r(_bw[0], 5)} AS lon, {r(_bw[1], 5)} AS lat, so.n AS n_cameras,
               {r('(SELECT AVG(abs((so.sx - p.x) * p.c - (so.sy - p.y) * p.s)) FROM p WHERE p.fire_id = so.fire_id)', 2)} AS residual_m FROM so""",
)
def k4(x):
    out = camera.triangulate(camera.plume_bearings(x.mask_pixel, x.camera))
    return out.select(
        "fire_id", rounded("lon", 5).alias("lon"), rounded("lat", 5).alias("lat"), "n_cameras", rounded("residual_m", 2).alias("residual_m")
    )


_az = f"radians(pan_deg + degrees(atan2(px - image_width / 2.0, {_f})))"
_el = f"radians(tilt_deg - degrees(atan2(py - image_height / 2.0, {_f})))"


@query(
    "K5_pixel_ray",
    f"""SELECT frame_id, px, py, {r(f'sin({_az}) * cos({_el})')} AS e, {r(f'cos({_az}) * cos({_el})')} AS n, {r(f'sin({_el})')} AS u
        FROM mask_pixel m JOIN camera c ON c.camera_id = m.camera_id""",
)
def k5(x):
    rows = x.mask_pixel.join(x.camera, "camera_id").withColumn("_r", camera.ray_direction(F.col("px"), F.col("py")))
    return rows.select("frame_id", "px", "py", *[rounded(f"_r.{c}").alias(c) for c in ("e", "n", "u")])


_x0, _y0 = frag.local("q.lon", "q.lat", "s.center_lon", "s.center_lat")


def march_sql(rays: str, ids: str, step: float, last: int) -> str:
    """CTE ``mt``: terrain under each step of the rays ``(ids, fire_id, lon, lat, elev_m, e, n, u)``."""
    return f"""m0 AS (SELECT q.*, s.ny, s.nx, s.cell_m, s.center_lon, s.center_lat, k, k * {step}::DOUBLE AS t,
                {_x0} + q.e * (k * {step}::DOUBLE) AS x, {_y0} + q.n * (k * {step}::DOUBLE) AS y
              FROM {rays} q JOIN site s ON s.fire_id = q.fire_id, range(0, {last + 1}) g(k)),
        m1 AS (SELECT *, y / cell_m + (ny - 1) / 2.0 AS fi, x / cell_m + (nx - 1) / 2.0 AS fj FROM m0),
        m2 AS (SELECT *, CAST(floor(fi) AS INT) AS i0, CAST(floor(fj) AS INT) AS j0,
                 floor(fi) >= 0 AND floor(fj) >= 0 AND floor(fi) < ny - 1 AND floor(fj) < nx - 1 AS inside FROM m1),
        mw AS (SELECT {ids}, k, fire_id, i0 + a AS i, j0 + b AS j, (CASE WHEN a = 1 THEN fi - i0 ELSE 1 - (fi - i0) END)
                 * (CASE WHEN b = 1 THEN fj - j0 ELSE 1 - (fj - j0) END) AS wt FROM m2, range(0, 2) c1(a), range(0, 2) c2(b) WHERE inside
               UNION ALL SELECT {ids}, k, fire_id, CAST(greatest(0, least(round_even(fi, 0), ny - 1)) AS INT),
                 CAST(greatest(0, least(round_even(fj, 0), nx - 1)) AS INT), 1.0 FROM m2 WHERE NOT inside),
        ms AS (SELECT {ids}, k, SUM(wt * elevation) AS terrain FROM mw
               LEFT JOIN grid_cell c ON c.fire_id = mw.fire_id AND c.i = mw.i AND c.j = mw.j GROUP BY {ids}, k),
        mt AS (SELECT m1.*, ms.terrain FROM m1 JOIN ms USING ({ids}, k))"""


_back = f"({STEP}::DOUBLE * (1 - prev / (prev - d)))"
_hit = frag.wgs(f"(x - e * {_back})", f"(y - n * {_back})", "center_lon", "center_lat")


def _base(x):
    return camera.base_pixels(x.mask_pixel)


@query(
    "K6_terrain_crossing",
    f"""WITH low AS (SELECT frame_id, camera_id, px, MAX(py) AS py FROM mask_pixel GROUP BY frame_id, camera_id, px),
        ray AS (SELECT frame_id, px, fire_id, lon, lat, elev_m, sin({_az}) * cos({_el}) AS e, cos({_az}) * cos({_el}) AS n, sin({_el}) AS u
                FROM low JOIN camera c ON c.camera_id = low.camera_id),
        {march_sql('ray', 'frame_id, px', STEP, int(RANGE // STEP))},
        df AS (SELECT *, elev_m + u * t - terrain AS d FROM mt),
        pv AS (SELECT *, lag(d) OVER (PARTITION BY frame_id, px ORDER BY k) AS prev FROM df),
        ht AS (SELECT *, row_number() OVER (PARTITION BY frame_id, px ORDER BY k) AS rn FROM pv WHERE d <= 0 AND prev > 0)
        SELECT frame_id, px, {r(f't - {_back}', 2)} AS dist_m, {r(_hit[0])} AS hit_lon, {r(_hit[1])} AS hit_lat FROM ht WHERE rn = 1""",
)
def k6(x):
    """Every base pixel of every frame sent as a ray into its event's terrain."""
    out = camera.first_crossing(_base(x), x.camera, x.grid_cell, x.site, STEP, RANGE)
    return out.select(
        "frame_id", "px", rounded("dist_m", 2).alias("dist_m"), rounded("hit_lon").alias("hit_lon"), rounded("hit_lat").alias("hit_lat")
    )


@query(
    "K7_base_pixels",
    """SELECT frame_id, px, MAX(py) AS py FROM mask_pixel GROUP BY frame_id, px""",
)
def k7(x):
    return _base(x).select("frame_id", "px", "py")


def _cloud(x):
    return camera.pose_cloud(_base(x), x.camera, x.grid_cell, x.site, 12, STEP, RANGE)


@query("K8_pose_cloud")
def k8(x):
    return _cloud(x).select("frame_id", "n_hits", rounded("char_m", 1).alias("char_m"))


@query(
    "K8_front_points",
    f"""WITH low AS (SELECT frame_id, camera_id, px, MAX(py) AS py FROM mask_pixel GROUP BY frame_id, camera_id, px),
        ray AS (SELECT frame_id, px, fire_id, lon, lat, elev_m, sin({_az}) * cos({_el}) AS e, cos({_az}) * cos({_el}) AS n, sin({_el}) AS u
                FROM low JOIN camera c ON c.camera_id = low.camera_id),
        {march_sql('ray', 'frame_id, px', STEP, int(RANGE // STEP))},
        pv AS (SELECT *, elev_m + u * t - terrain AS d, lag(elev_m + u * t - terrain) OVER (PARTITION BY frame_id, px ORDER BY k) AS prev FROM mt),
        hit AS (SELECT DISTINCT frame_id, px FROM pv WHERE d <= 0 AND prev > 0)
        SELECT f.frame_id, f.camera_id, COUNT(hit.px) AS n_points
        FROM (SELECT DISTINCT low.frame_id, low.camera_id, low.px FROM low JOIN camera c ON c.camera_id = low.camera_id) f
        LEFT JOIN hit ON hit.frame_id = f.frame_id AND hit.px = f.px GROUP BY f.frame_id, f.camera_id""",
)
def k8_points(x):
    """Columns of each frame whose base pixel meets the ground under the reported pose."""
    return _cloud(x).select("frame_id", "camera_id", "n_points")


def _fronts(x):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    later = F.make_dt_interval(mins=(F.col("frame_id") % 37 * 10).cast("int"))
    frames = x.mask_pixel.select("frame_id").distinct().withColumn("t", start + later)
    starts = x.site.select("fire_id", start.alias("ignition_t"))
    return assimilate.normalise_reports(camera.camera_fronts(_cloud(x), frames), starts, 2000.0)


@query("K8_camera_front")
def k8_front(x):
    """Every frame as a ``camera_front`` report."""
    out = _fronts(x).select("fire_id", "frame_id", "minutes", "geometry_type", "n_points", "is_area", rounded("sigma_m", 1).alias("sigma_m"))
    return out


@query("K8_front_loglik")
def k8_loglik(x):
    """Log-likelihood of the members under the regions that the cameras saw, per instant."""
    fronts = cut_lineage(_fronts(x).filter("is_area").select("fire_id", "frame_id", "minutes", "sigma_m", "ring"))
    cells = spatial.lonlat_ring_cells(fronts, x.site, "ring", ["fire_id", "frame_id", "minutes"])
    miss = assimilate.area_mismatch(cells, fronts.drop("ring"), x.member_arrival, x.member, 2000.0, "frame_id")
    return assimilate.batch_loglik(miss).withColumn("loglik", rounded("loglik", 4))


GRAY = """SELECT frame_id AS camera_id, px, py, CAST((px * 7 + py * py * 3 + frame_id) % 251 AS DOUBLE) AS v FROM {mask_pixel}"""


@query(
    "K9_detect_skyline",
    f"""WITH g AS ({GRAY.replace('{mask_pixel}', 'mask_pixel')}), d AS (SELECT *, v - lead(v) OVER (PARTITION BY camera_id, px ORDER BY py) AS d FROM g)
        SELECT camera_id, px, row FROM (SELECT camera_id, px, py AS row, d, row_number() OVER (PARTITION BY camera_id, px ORDER BY d DESC, py) AS rn
          FROM d WHERE d IS NOT NULL) q WHERE rn = 1 AND d > 8""",
)
def k9(x):
    return camera.detect_skyline(x.spark.sql(GRAY, mask_pixel=x.mask_pixel))


def _angles(x):
    cols = x.camera.withColumn("px", F.explode(F.array(*[F.lit(c) for c in (0, 16, 32, 48, 63)])))
    return camera.horizon_angles(cols, x.grid_cell, x.site, 2000.0, 30000.0)


_flat = f"radians((((pan_deg + degrees(atan2(px - image_width / 2.0, {_f}))) % 360.0) + 360.0) % 360.0)"


@query(
    "K9_horizon_angles",
    f"""WITH ray AS (SELECT camera_id, px, fire_id, lon, lat, elev_m, sin({_flat}) AS e, cos({_flat}) AS n, 0.0::DOUBLE AS u
                FROM camera, (SELECT unnest([0, 16, 32, 48, 63]) AS px) p),
        {march_sql('ray', 'camera_id, px', 2000.0, 14)}
        SELECT camera_id, px, {r('MAX(degrees(atan2(terrain - elev_m, t)))')} AS horizon_deg FROM mt WHERE k > 0 GROUP BY camera_id, px""",
)
def k9_angles(x):
    return _angles(x).withColumn("horizon_deg", rounded("horizon_deg"))


@query("K9_calibrate_tilt", "SELECT camera_id, tilt_deg + 1.5 AS tilt_deg, 0.0::DOUBLE AS rms_row_error, 5::BIGINT AS n_columns FROM camera")
def k9_tilt(x):
    """Skylines rendered with a tilt 1.5 degrees off the reported one are matched again."""
    angles = _angles(x)
    seen = angles.join(x.camera, "camera_id").select(
        "camera_id", "px", camera.skyline_row(F.col("tilt_deg") + 1.5, F.col("horizon_deg")).alias("row")
    )
    out = camera.calibrate_tilt(seen, angles, x.camera)
    return out.withColumn("rms_row_error", rounded("rms_row_error"))


COLUMNS = list(range(0, 64, 3))
SEEN = [c for c in COLUMNS if c % 7 != 3]
_turned = _flat.replace("pan_deg", "(pan_deg + 2.0)")
_off = f"degrees(atan2(px - image_width / 2.0, {_f}))"


@query(
    "K9_calibrate_pose",
    f"""WITH ray AS (SELECT camera_id, px, fire_id, lon, lat, elev_m, sin({_turned}) AS e, cos({_turned}) AS n, 0.0::DOUBLE AS u
                FROM camera, (SELECT unnest({SEEN}) AS px) p),
        {march_sql('ray', 'camera_id, px', 2000.0, 14)},
        ob AS (SELECT q.camera_id, px, image_height / 2.0 + {_f} * tan(radians(tilt_deg + 1.5 - h)) AS row
               FROM (SELECT camera_id, px, MAX(degrees(atan2(terrain - elev_m, t))) AS h FROM mt WHERE k > 0 GROUP BY camera_id, px) q
               JOIN camera c ON c.camera_id = q.camera_id),
        pray AS (SELECT camera_id, slot, fire_id, lon, lat, elev_m, sin(radians(pan_deg + slot * 0.25::DOUBLE)) AS e,
                   cos(radians(pan_deg + slot * 0.25::DOUBLE)) AS n, 0.0::DOUBLE AS u FROM camera,
                   range(-CAST(ceil(360.0 / 0.25) AS BIGINT), CAST(ceil(360.0 / 0.25) AS BIGINT)) g(slot) WHERE abs(slot) <= ceil((fov_deg / 2.0 + 6) / 0.25) + 1),
        {march_sql('pray', 'camera_id, slot', 2000.0, 14).replace('m0', 'w0').replace('m1', 'w1').replace('m2', 'w2').replace('mw', 'ww').replace('ms', 'ws').replace('mt', 'wt_')},
        pf AS (SELECT camera_id, slot, MAX(degrees(atan2(terrain - elev_m, t))) AS h FROM wt_ WHERE k > 0 GROUP BY camera_id, slot),
        asked AS (SELECT ob.camera_id, px, row, image_width, image_height, fov_deg, pan::DOUBLE AS pan, ({_off} + pan) / 0.25 AS pos
                  FROM ob JOIN camera c ON c.camera_id = ob.camera_id, range(-6, 7) g(pan)),
        hz AS (SELECT asked.*, a.h + (pos - floor(pos)) * (b.h - a.h) AS h FROM asked
               JOIN pf a ON a.camera_id = asked.camera_id AND a.slot = CAST(floor(pos) AS BIGINT)
               JOIN pf b ON b.camera_id = asked.camera_id AND b.slot = CAST(floor(pos) AS BIGINT) + 1),
        er AS (SELECT camera_id, pan, tl * 0.25::DOUBLE - 15.0 AS tilt, round(sqrt(AVG(power(image_height / 2.0 + {_f} * tan(radians(tl * 0.25::DOUBLE - 15.0 - h)) - row, 2))), 9) AS rms,
                 COUNT(*) AS n FROM hz, range(0, 121) g(tl) GROUP BY camera_id, pan, tl)
        SELECT camera_id, tilt::DOUBLE AS tilt_deg, pan AS pan_offset_deg, {r('rms')} AS rms_row_error, n AS n_columns
        FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY rms, pan, tilt) AS rn FROM er) q WHERE rn = 1""",
)
def k9_pose(x):
    """Skylines marched with pan 2 and tilt 1.5 degrees off the reported pose; some columns are not seen."""
    cols = x.camera.withColumn("px", F.explode(F.array(*[F.lit(c) for c in COLUMNS])))
    true = camera.horizon_angles(cols.withColumn("pan_deg", F.col("pan_deg") + 2.0), x.grid_cell, x.site, 2000.0, 30000.0)
    row = F.when(F.col("px") % 7 != 3, camera.skyline_row(F.col("tilt_deg") + 1.5, F.col("horizon_deg")))
    seen = true.join(x.camera, "camera_id").select("camera_id", "px", row.alias("row"))
    profile = camera.horizon_profile(x.camera, x.grid_cell, x.site, 2000.0, 30000.0)
    out = camera.calibrate_pose(seen, profile, x.camera)
    return out.withColumn("rms_row_error", rounded("rms_row_error"))
