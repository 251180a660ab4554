"""Geographic functions, masks and spatial joins (G)."""

from pyspark.sql import functions as F

from hazardgrid import schema
from hazardgrid.functions import geo
from hazardgrid.operators import ensemble, outline, spatial
from hazardgrid.operators.common import rounded
from hazardgrid.plans import frag
from hazardgrid.plans.registry import query, r


def _obs_site(x):
    return spatial.attach_site(x.observation, x.site, ["obs_id"])


OBS_SITE = "observation o JOIN site s ON s.fire_id = o.fire_id"


@query(
    "G1_haversine",
    f"SELECT obs_id, {r(frag.hav('center_lon', 'center_lat', 'lon', 'lat'), 3)} AS dist_m FROM {OBS_SITE}",
)
def g1(x):
    return _obs_site(x).select(
        "obs_id", rounded(geo.haversine_m("center_lon", "center_lat", "lon", "lat"), 3).alias("dist_m")
    )


@query(
    "G2_bearing",
    f"SELECT obs_id, {r(frag.bearing('center_lon', 'center_lat', 'lon', 'lat'))} AS bearing FROM {OBS_SITE}",
)
def g2(x):
    return _obs_site(x).select(
        "obs_id", rounded(geo.bearing_deg("center_lon", "center_lat", "lon", "lat")).alias("bearing")
    )


_d = frag.dest("lon", "lat", "CAST(obs_id % 360 AS DOUBLE)", "frp * 200")


@query(
    "G3_destination",
    f"SELECT obs_id, {r(_d[0])} AS lon2, {r(_d[1])} AS lat2 FROM observation",
)
def g3(x):
    p = geo.destination_point("lon", "lat", (F.col("obs_id") % 360).cast("double"), F.col("frp") * 200)
    return x.observation.select(
        "obs_id", rounded(p["lon"]).alias("lon2"), rounded(p["lat"]).alias("lat2")
    )


_l = frag.local("lon", "lat", "center_lon", "center_lat")
_c = frag.cell_of("lon", "lat")
_ci, _cj = frag.clip(_c[0], "ny"), frag.clip(_c[1], "nx")
_cc = frag.cell_center("i", "j")


@query(
    "G4_local_frame",
    f"""SELECT obs_id, x, y, i, j, inside, {r(_cc[0])} AS cell_lon, {r(_cc[1])} AS cell_lat FROM (
          SELECT o.obs_id, s.*, {r(_l[0], 3)} AS x, {r(_l[1], 3)} AS y, CAST({_ci} AS INT) AS i,
                 CAST({_cj} AS INT) AS j,
                 {_c[0]} BETWEEN 0 AND ny - 1 AND {_c[1]} BETWEEN 0 AND nx - 1 AS inside
          FROM {OBS_SITE}) s""",
)
def g4(x):
    """Metres from degrees, the clipped cell, whether it was inside, and the cell's centre."""
    p = geo.to_local("lon", "lat", "center_lon", "center_lat")
    at = (
        _obs_site(x)
        .withColumn("p", p)
        .withColumn("ui", geo.axis_index(F.col("p.y"), "ny", "cell_m"))
        .withColumn("uj", geo.axis_index(F.col("p.x"), "nx", "cell_m"))
        .withColumn("i", geo.clip_index("ui", "ny"))
        .withColumn("j", geo.clip_index("uj", "nx"))
    )
    c = geo.to_wgs84(
        geo.axis_metres("j", "nx", "cell_m"), geo.axis_metres("i", "ny", "cell_m"), "center_lon", "center_lat"
    )
    return at.select(
        "obs_id", rounded("p.x", 3).alias("x"), rounded("p.y", 3).alias("y"), "i", "j",
        geo.in_bounds("ui", "uj", "ny", "nx").alias("inside"),
        rounded(c["lon"]).alias("cell_lon"), rounded(c["lat"]).alias("cell_lat"),
    )


_pad = "5000.0 / (111320.0 * greatest(0.05, cos(radians((lat - 0.1 + lat + 0.1) / 2.0))))"


@query(
    "G5_pad_bbox",
    f"""SELECT structure_id, {r(f'lon - 0.1 - {_pad}')} AS minlon, {r('lat - 0.1 - 5000.0 / 111320.0')} AS minlat,
               {r(f'lon + 0.1 + {_pad}')} AS maxlon, {r('lat + 0.1 + 5000.0 / 111320.0')} AS maxlat
        FROM structure""",
)
def g5(x):
    b = geo.bbox_around("lon", "lat", 0.1)
    p = geo.pad_bbox_m(b["minlon"], b["minlat"], b["maxlon"], b["maxlat"], 5000.0)
    return x.structure.select(
        "structure_id", *[rounded(p[k]).alias(k) for k in ("minlon", "minlat", "maxlon", "maxlat")]
    )


@query(
    "G6_event_bbox",
    f"""SELECT fire_id, {r('minlon')} AS minlon, {r('minlat')} AS minlat, {r('maxlon')} AS maxlon,
               {r('maxlat')} AS maxlat, {r('(minlon + maxlon) / 2')} AS mid_lon,
               {r('(minlat + maxlat) / 2')} AS mid_lat,
               {r('minlon - CASE WHEN maxlon = minlon THEN 0.005 ELSE (maxlon - minlon) * 0.35 END')} AS pad_minlon,
               {r('maxlat + CASE WHEN maxlat = minlat THEN 0.005 ELSE (maxlat - minlat) * 0.35 END')} AS pad_maxlat
        FROM (SELECT fire_id, MIN(lon) AS minlon, MIN(lat) AS minlat, MAX(lon) AS maxlon, MAX(lat) AS maxlat
              FROM observation GROUP BY fire_id) b""",
)
def g6(x):
    """Bounds, centre and padded bounds of each event's points."""
    b = x.observation.groupBy("fire_id").agg(
        F.min("lon").alias("minlon"), F.min("lat").alias("minlat"),
        F.max("lon").alias("maxlon"), F.max("lat").alias("maxlat"),
    )
    p = geo.pad_bbox_fraction("minlon", "minlat", "maxlon", "maxlat")
    return b.select(
        "fire_id", *[rounded(k).alias(k) for k in ("minlon", "minlat", "maxlon", "maxlat")],
        rounded((F.col("minlon") + F.col("maxlon")) / 2).alias("mid_lon"),
        rounded((F.col("minlat") + F.col("maxlat")) / 2).alias("mid_lat"),
        rounded(p["minlon"]).alias("pad_minlon"), rounded(p["maxlat"]).alias("pad_maxlat"),
    )


_corner = [
    frag.cell_center(i, j) for i, j in (("0", "0"), ("0", "nx - 1"), ("ny - 1", "0"), ("ny - 1", "nx - 1"))
]


@query(
    "G6_grid_bbox",
    f"""SELECT fire_id, {r('least(' + ', '.join(c[0] for c in _corner) + ')')} AS minlon,
               {r('least(' + ', '.join(c[1] for c in _corner) + ')')} AS minlat,
               {r('greatest(' + ', '.join(c[0] for c in _corner) + ')')} AS maxlon,
               {r('greatest(' + ', '.join(c[1] for c in _corner) + ')')} AS maxlat FROM site s""",
)
def g6_grid(x):
    """Event box from the four grid corners."""
    def corner(i, j):
        return geo.to_wgs84(
            geo.axis_metres(j, "nx", "cell_m"), geo.axis_metres(i, "ny", "cell_m"), "center_lon", "center_lat"
        )

    zero, top, right = F.lit(0), F.col("ny") - 1, F.col("nx") - 1
    ring = F.array(*[corner(i, j) for i in (zero, top) for j in (zero, right)])
    b = geo.ring_bbox(ring)
    return x.site.select(
        "fire_id", *[rounded(b[k]).alias(k) for k in ("minlon", "minlat", "maxlon", "maxlat")]
    )


_v = frag.local("vlon", "vlat", "lon", "lat")


@query(
    "G7_polygon_area",
    f"""WITH v AS (SELECT structure_id, k, {_v[0]} AS x, {_v[1]} AS y FROM (
            SELECT structure_id, lon, lat, k, lon + CASE WHEN k IN (0, 3) THEN -0.02 ELSE 0.02 END AS vlon,
                   lat + CASE WHEN k < 2 THEN -0.01 ELSE 0.01 END AS vlat
            FROM structure, range(0, 4) c(k)) q)
        SELECT a.structure_id, {r('abs(SUM(a.x * b.y - b.x * a.y)) / 2 / 1e6', 5)} AS km2
        FROM v a JOIN v b ON b.structure_id = a.structure_id AND b.k = (a.k + 1) % 4 GROUP BY a.structure_id""",
)
def g7(x):
    def v(a, b):
        return F.struct((F.col("lon") + a).alias("lon"), (F.col("lat") + b).alias("lat"))

    ring = F.array(v(-0.02, -0.01), v(0.02, -0.01), v(0.02, 0.01), v(-0.02, 0.01))
    return x.structure.select(
        "structure_id", rounded(geo.polygon_area_m2(ring) / 1e6, 5).alias("km2")
    )


@query(
    "G8_mask_overlap",
    f"""SELECT fire_id, {r('inter / nullif(na + nb - inter, 0)')} AS iou, {r('2.0 * inter / nullif(na + nb, 0)')} AS dice
        FROM (SELECT p.fire_id, COUNT(*) FILTER (p.p >= 0.5) AS na,
                     COUNT(*) FILTER (t.truth_min <= 180) AS nb,
                     COUNT(*) FILTER (p.p >= 0.5 AND t.truth_min <= 180) AS inter
              FROM prob p JOIN truth t ON t.fire_id = p.fire_id AND t.i = p.i AND t.j = p.j
              WHERE p.arm = 'on' AND p.horizon_min = 180 GROUP BY p.fire_id) m""",
)
def g8(x):
    from hazardgrid.plans.ensemble_queries import field

    pred = field(x).filter("horizon_min = 180 AND p >= 0.5")
    out = spatial.mask_overlap(pred, x.truth.filter("truth_min <= 180"), "fire_id")
    return out.select("fire_id", rounded("iou").alias("iou"), rounded("dice").alias("dice"))


@query(
    "G9_grid_cells",
    """SELECT s.fire_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, (j - (nx - 1) / 2.0) * cell_m AS x,
              (i - (ny - 1) / 2.0) * cell_m AS y
       FROM site s, range(0, 20000) a(i), range(0, 20) b(j) WHERE i < ny AND j < nx""",
)
def g9(x):
    return spatial.grid_cells(x.site)


def _zone_rings(x):
    def v(a, b):
        return F.struct((F.col("cj") + a).alias("x"), (F.col("ci") + b).alias("y"))

    h = F.col("half")
    ring = F.array(v(h, 0), v(0, h), v(-h, 0), v(0, -h))
    return spatial.attach_site(x.zone.withColumn("ring", ring), x.site, ["zone_id"])


@query("G10_polygon_cells", "SELECT zone_id, fire_id, i, j FROM zone_cell")
def g10(x):
    cells = spatial.polygon_cells(_zone_rings(x), "ring", ["zone_id", "fire_id"])
    return cells.join(x.grid_cell.select("fire_id", "i", "j"), ["fire_id", "i", "j"], "left_semi").select(
        "zone_id", "fire_id", "i", "j"
    )


ROAD_SQL = """
SELECT road_id, fire_id, i, j FROM (
  SELECT road_id, fire_id, i, j, i - i0 - t * di AS a, j - j0 - t * dj AS b FROM (
    SELECT *, CASE WHEN di = 0 AND dj = 0 THEN 0.0 ELSE
        greatest(0.0, least(1.0, ((i - i0) * di + (j - j0) * dj) / (di * di + dj * dj))) END AS t
    FROM (SELECT r.*, r.i1 - r.i0 AS di, r.j1 - r.j0 AS dj, c.i, c.j
          FROM road r JOIN grid_cell c ON c.fire_id = r.fire_id) q) q2) q3
WHERE a * a + b * b <= 1"""


def road_cells(x):
    roads = spatial.attach_site(x.road, x.site, ["road_id"])
    cells = spatial.segment_cells(roads, ["road_id", "fire_id"])
    return cells.join(x.grid_cell.select("fire_id", "i", "j"), ["fire_id", "i", "j"], "left_semi").select(
        "road_id", "fire_id", "i", "j"
    )


@query("G10_line_cells", ROAD_SQL)
def g10_line(x):
    return road_cells(x)


@query(
    "G11_points_to_cells",
    f"""SELECT obs_id, {_c[0]} AS i, {_c[1]} AS j FROM {OBS_SITE}
        WHERE {_c[0]} BETWEEN 0 AND ny - 1 AND {_c[1]} BETWEEN 0 AND nx - 1""",
)
def g11(x):
    return spatial.locate(x.observation, x.site, clip=False).select("obs_id", "i", "j")


@query(
    "G12_disk_cells",
    f"""SELECT DISTINCT fire_id, CAST(i + di AS INT) AS i, CAST(j + dj AS INT) AS j FROM (
          SELECT s.fire_id, ny, nx, {_ci} AS i, {_cj} AS j FROM {OBS_SITE}) p,
        range(-2, 3) a(di), range(-2, 3) b(dj)
        WHERE di * di + dj * dj <= 4 AND i + di BETWEEN 0 AND ny - 1 AND j + dj BETWEEN 0 AND nx - 1""",
)
def g12(x):
    return spatial.disk_cells(x.observation, x.site, 4000.0).distinct()


@query(
    "G13_satellite_points",
    """SELECT obs_id, kind, t, lon, lat FROM observation
       WHERE kind IN ('goes', 'viirs', 'modis') AND t <= TIMESTAMP '2024-01-20 00:00:00'""",
)
def g13(x):
    """Multi-point reports flattened to the points of satellite products up to an instant."""
    pairs = F.array(F.struct("lon", "lat"))
    reports = x.observation.withColumn("points", pairs).drop("lon", "lat")
    return (
        reports.filter(F.col("kind").isin("goes", "viirs", "modis"))
        .filter("t <= TIMESTAMP_NTZ '2024-01-20 00:00:00'")
        .select("obs_id", "kind", "t", F.inline("points"))
    )


@query(
    "G14_mean_point",
    f"""SELECT fire_id, kind, {r('AVG(lon)')} AS lon, {r('AVG(lat)')} AS lat
        FROM observation GROUP BY fire_id, kind""",
)
def g14(x):
    return x.observation.groupBy("fire_id", "kind").agg(
        rounded(F.avg("lon")).alias("lon"), rounded(F.avg("lat")).alias("lat")
    )


@query("G15_convex_hull")
def g15(x):
    hulls = spatial.convex_hulls(x.observation, ["fire_id", "kind"])
    return hulls.select(
        "fire_id", "kind", F.size("ring").alias("n_vertices"),
        rounded(geo.polygon_area_m2("ring") / 1e6, 3).alias("km2"),
    )


def _list(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


from hazardgrid import constants as K  # noqa: E402


@query(
    "G16_compass",
    f"""SELECT obs_id, {_list(K.COMPASS_8)}[CAST(floor(((b + 22.5) % 360) / 45) AS INT) + 1] AS c8,
               {_list(K.COMPASS_16_WORDS)}[CAST(floor((b + 11.25) / 22.5) AS INT) % 16 + 1] AS c16_words,
               {_list(K.COMPASS_16)}[CAST(floor(b / 22.5 + 0.5) AS INT) % 16 + 1] AS c16
        FROM (SELECT obs_id, CAST((obs_id * 7) % 360 AS DOUBLE) + 0.1 AS b FROM observation) q""",
)
def g16(x):
    b = (F.col("obs_id") * 7 % 360).cast("double") + 0.1
    return x.observation.select(
        "obs_id", geo.compass_8(b).alias("c8"), geo.compass_16_words(b).alias("c16_words"),
        geo.compass_16(b).alias("c16"),
    )


def grad_sql(cell):
    def s(part, order):
        w = f"OVER (PARTITION BY fire_id, {part} ORDER BY {order})"
        b, a = f"lag(elevation) {w}", f"lead(elevation) {w}"
        n = f"(CASE WHEN {b} IS NULL THEN 0 ELSE 1 END + CASE WHEN {a} IS NULL THEN 0 ELSE 1 END)"
        return (
            f"CASE WHEN {n} = 0 THEN 0.0 ELSE (coalesce({a}, elevation) - coalesce({b}, elevation))"
            f" / ({n} * {cell}) END"
        )

    return s("i", "j"), s("j", "i")


_gx, _gy = grad_sql("200.0")


@query("G17_gradient", f"SELECT fire_id, i, j, {r(_gx)} AS gx, {r(_gy)} AS gy FROM grid_cell")
def g17(x):
    g = spatial.gradient(x.grid_cell, "elevation", 200.0)
    return g.select("fire_id", "i", "j", rounded("gx").alias("gx"), rounded("gy").alias("gy"))


@query(
    "G18_hillshade",
    f"""WITH g AS (SELECT fire_id, i, j, {_gx} AS gx, {_gy} AS gy FROM grid_cell),
        h AS (SELECT fire_id, i, j, sin(radians(45.0)) * sin(pi() / 2 - atan(sqrt(gx * gx + gy * gy)))
                + cos(radians(45.0)) * cos(pi() / 2 - atan(sqrt(gx * gx + gy * gy)))
                * cos(radians(135.0) - atan2(-gx, gy)) AS hs FROM g)
        SELECT fire_id, i, j, {r('greatest(0.0, least(1.0, (hs - lo) / (hi - lo + 1e-9)))', 5)} AS shade
        FROM h JOIN (SELECT fire_id, MIN(hs) AS lo, MAX(hs) AS hi FROM h GROUP BY fire_id) m USING (fire_id)""",
)
def g18(x):
    return spatial.hillshade(x.grid_cell, 200.0).select(
        "fire_id", "i", "j", rounded("shade", 5).alias("shade")
    )


_fi = f"({_l[1]} / cell_m + (ny - 1) / 2.0)"
_fj = f"({_l[0]} / cell_m + (nx - 1) / 2.0)"


@query(
    "G19_bilinear_elevation",
    f"""WITH p AS (SELECT o.obs_id, s.fire_id, ny, nx, {_fi} AS fi, {_fj} AS fj FROM {OBS_SITE}),
        q AS (SELECT *, CAST(floor(fi) AS INT) AS i0, CAST(floor(fj) AS INT) AS j0,
                     floor(fi) >= 0 AND floor(fj) >= 0 AND floor(fi) < ny - 1 AND floor(fj) < nx - 1 AS inside
              FROM p),
        w AS (SELECT obs_id, fire_id, i0 + a AS i, j0 + b AS j,
                     (CASE WHEN a = 1 THEN fi - i0 ELSE 1 - (fi - i0) END)
                     * (CASE WHEN b = 1 THEN fj - j0 ELSE 1 - (fj - j0) END) AS wt
              FROM q, range(0, 2) x(a), range(0, 2) y(b) WHERE inside
              UNION ALL SELECT obs_id, fire_id, CAST(greatest(0, least(round_even(fi, 0), ny - 1)) AS INT),
                     CAST(greatest(0, least(round_even(fj, 0), nx - 1)) AS INT), 1.0 FROM q WHERE NOT inside)
        SELECT w.obs_id, {r('SUM(wt * elevation)', 4)} AS elev_m
        FROM w LEFT JOIN grid_cell c ON c.fire_id = w.fire_id AND c.i = w.i AND c.j = w.j GROUP BY w.obs_id""",
)
def g19(x):
    p = geo.to_local("lon", "lat", "center_lon", "center_lat")
    at = (
        _obs_site(x)
        .withColumn("fi", p["y"] / F.col("cell_m") + (F.col("ny") - 1) / 2.0)
        .withColumn("fj", p["x"] / F.col("cell_m") + (F.col("nx") - 1) / 2.0)
    )
    out = spatial.sample_bilinear(at, x.grid_cell, "elevation", "fi", "fj", "elev_m")
    return out.select("obs_id", rounded("elev_m", 4).alias("elev_m"))


@query(
    "G20_perimeter_edges",
    """WITH m AS (SELECT fire_id, i, j FROM truth WHERE truth_min <= 120)
       SELECT m.fire_id, m.i, m.j, s.side
       FROM m, (VALUES ('n', 1, 0), ('s', -1, 0), ('e', 0, 1), ('w', 0, -1)) s(side, di, dj)
       WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.fire_id = m.fire_id AND n.i = m.i + di AND n.j = m.j + dj)""",
)
def g20(x):
    return spatial.boundary_edges(x.truth.filter("truth_min <= 120"))


def rings_sql(mask: str, keys: str) -> str:
    """CTEs that walk the unit sides of ``mask(keys, i, j)`` one by one, ending in ``rings``."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    of = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""sd AS (SELECT {of}, h, a.j + x AS x0, a.i + y AS y0, a.j + x + CASE h WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS x1,
                 a.i + y + CASE h WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS y1
               FROM {mask} a, (VALUES (0, 0, 0, -1, 0), (1, 1, 0, 0, 1), (2, 1, 1, 1, 0), (3, 0, 1, 0, -1)) s(h, x, y, di, dj)
               WHERE NOT EXISTS (SELECT 1 FROM {mask} b WHERE {on} AND b.i = a.i + di AND b.j = a.j + dj)),
        nx AS (SELECT {of}, a.h, a.x0, a.y0, a.x1, a.y1, arg_max(b.h, (b.h = (a.h + 1) % 4)::INT) AS h2 FROM sd a
               JOIN sd b ON {on} AND b.x0 = a.x1 AND b.y0 = a.y1 GROUP BY {of}, a.h, a.x0, a.y0, a.x1, a.y1),
        wk AS (SELECT {keys}, x0 AS sx, y0 AS sy, h AS sh, x0, y0, h, x1, y1, h2 FROM nx
               UNION ALL SELECT {of}, a.sx, a.sy, a.sh, b.x0, b.y0, b.h, b.x1, b.y1, b.h2 FROM wk a
               JOIN nx b ON {on} AND b.x0 = a.x1 AND b.y0 = a.y1 AND b.h = a.h2 WHERE NOT (b.x0 = a.sx AND b.y0 = a.sy AND b.h = a.sh)),
        lead AS (SELECT {keys}, sx, sy, sh, MIN((y0, x0, h)) AS top, SUM(x0 * y1 - x1 * y0) / 2 AS area, COUNT(*) AS n, COUNT(*) FILTER (h <> h2) AS turns
                 FROM wk GROUP BY {keys}, sx, sy, sh),
        rings AS (SELECT {keys}, sx AS x, sy AS y, area::DOUBLE AS area_cells, n AS n_sides, turns AS n_corners FROM lead WHERE (sy, sx, sh) = top)"""


_burned = "m AS (SELECT DISTINCT fire_id, i, j FROM truth WHERE truth_min <= 120)"


@query(
    "G20_perimeter_rings",
    f"""WITH RECURSIVE {_burned}, {rings_sql('m', 'fire_id')}
        SELECT fire_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, area_cells, n_sides, n_corners FROM rings""",
)
def g20_rings(x):
    """Every ring of the burned area, named by its lowest corner; holes have a negative area."""
    corners = outline.mask_rings(x.truth.filter("truth_min <= 120"))
    first = corners.filter("pos = 0").select("fire_id", "ring", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    return outline.ring_measures(corners).join(first, ["fire_id", "ring"]).drop("ring")


@query("G20_ring_polygons")
def g20_polygons(x):
    """The same rings as lon/lat polygons with their area on the ground."""
    polygons = outline.ring_polygons(outline.mask_rings(x.truth.filter("truth_min <= 120")), x.site)
    return polygons.select("fire_id", "ring", "outline", rounded(geo.polygon_area_m2("outline") / 1e6, 4).alias("km2"))


def _flat(b, rng):
    return (
        f"lon + sin(radians({b})) * {rng} / (111.32 * cos(radians(lat)))",
        f"lat + cos(radians({b})) * {rng} / 110.574",
    )


_k = _flat("pan_deg - fov_deg / 2 + fov_deg * (k - 1) / 18.0", "2.2")
_e = _flat("pan_deg", "1.0")


@query(
    "G21_view_cone",
    f"""SELECT camera_id, CAST(k AS INT) AS k,
               {r(f'CASE WHEN k IN (0, 20) THEN lon ELSE {_k[0]} END')} AS lon,
               {r(f'CASE WHEN k IN (0, 20) THEN lat ELSE {_k[1]} END')} AS lat,
               {r(_e[0])} AS tick_lon, {r(_e[1])} AS tick_lat
        FROM camera, range(0, 21) s(k)""",
)
def g21(x):
    end = geo.bearing_endpoint("lon", "lat", "pan_deg", 1.0)
    rings = x.camera.select(
        "camera_id", end.alias("tick"),
        F.posexplode(geo.view_cone("lon", "lat", "pan_deg", "fov_deg")).alias("k", "v"),
    )
    return rings.select(
        "camera_id", "k", rounded("v.lon").alias("lon"), rounded("v.lat").alias("lat"),
        rounded("tick.lon").alias("tick_lon"), rounded("tick.lat").alias("tick_lat"),
    )


_GJ = """CASE obs_id % 5
 WHEN 0 THEN concat('{"type":"Point","coordinates":[', a, ',', b, ']}')
 WHEN 1 THEN concat('{"type":"LineString","coordinates":[[', a, ',', b, '],[0,1]]}')
 WHEN 2 THEN concat('{"type":"Polygon","coordinates":[[[', a, ',', b, '],[1,0],[1,1]],[[5,5],[6,5],[6,6]]]}')
 WHEN 3 THEN concat('{"type":"MultiPolygon","coordinates":[[[[', a, ',', b, '],[1,0],[1,1]]],[[[7,7],[8,7],[8,8]]]]}')
 ELSE '{"type":"MultiPoint","coordinates":[]}' END"""


@query(
    "G22_geojson_round_trip",
    """SELECT obs_id, CAST(CASE obs_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 6 END AS INT)
          AS n_points, CASE WHEN obs_id % 5 < 4 THEN CAST(obs_id % 90 AS DOUBLE) END AS lon,
          CASE WHEN obs_id % 5 < 4 THEN CAST(obs_id % 70 AS DOUBLE) END AS lat,
          obs_id % 5 < 4 AS back_ok FROM observation""",
)
def g22(x):
    raw = x.observation.selectExpr(
        "obs_id", "CAST(obs_id % 90 AS STRING) AS a", "CAST(obs_id % 70 AS STRING) AS b"
    ).select("obs_id", F.expr(_GJ).alias("doc"))
    g = F.from_json("doc", schema.GEOJSON)
    pts = raw.withColumn("g", g).withColumn("p", schema.geojson_points(F.col("g")))
    kind = F.when(F.size("p") == 1, "Point").otherwise("LineString")
    again = F.from_json(schema.points_geojson(kind, F.col("p")), schema.GEOJSON)
    pts = pts.withColumn("p2", schema.geojson_points(again))
    first = F.get("p", F.lit(0))
    return pts.select(
        "obs_id", F.when(F.col("p").isNotNull(), F.size("p")).alias("n_points"),
        first["lon"].alias("lon"), first["lat"].alias("lat"),
        F.coalesce(F.col("p") == F.col("p2"), F.lit(False)).alias("back_ok"),
    )


_sc = frag.cell_of("a.lon", "a.lat")


@query(
    "G23_structure_probability",
    f"""SELECT a.structure_id, p.horizon_min, {r('p.p')} AS p
        FROM structure a JOIN site s ON s.fire_id = a.fire_id
        JOIN prob p ON p.fire_id = a.fire_id AND p.arm = 'on' AND p.i = {frag.clip(_sc[0], 's.ny')}
             AND p.j = {frag.clip(_sc[1], 's.nx')}""",
)
def g23(x):
    at = spatial.locate(x.structure, x.site, clip=True)
    field = ensemble.burn_probability(x.member_arrival, x.member, x.grid_cell, [15, 30, 60, 180])
    return at.join(field, ["fire_id", "i", "j"]).select(
        "structure_id", "horizon_min", rounded("p").alias("p")
    )
