"""Sources and sinks (S). Raw feed text is derived from the tables and parsed by the feed code."""

from pyspark.sql import functions as F

from hazardgrid import constants as K
from hazardgrid.fixtures import _zoneless
from hazardgrid.functions import geo, lookup
from hazardgrid.operators import spatial
from hazardgrid.functions.draws import uniform_sql
from hazardgrid.operators.common import rounded
from hazardgrid.plans import frag
from hazardgrid.plans.ensemble_queries import field
from hazardgrid.plans.geo_queries import grad_sql
from hazardgrid.plans.registry import query, r
from hazardgrid.session import work_path
from hazardgrid.sources import assets, boxes, feeds, sinks, terrain

BOX = {"minlon": -122.75, "minlat": 38.35, "maxlon": -122.5, "maxlat": 38.6}
BOX_SQL = "lon BETWEEN -122.75 AND -122.5 AND lat BETWEEN 38.35 AND 38.6"

LINE = """SELECT obs_id, fire_id,
  CASE obs_id % 4 WHEN 0 THEN 'VIIRS_SNPP_NRT' WHEN 1 THEN 'VIIRS_NOAA20_NRT' WHEN 2 THEN 'MODIS_NRT' ELSE 'OTHER' END AS product,
  concat(CAST(CAST(lat AS DECIMAL(9, 3)) AS STRING), ',', CAST(CAST(lon AS DECIMAL(9, 3)) AS STRING), ',',
    CAST(CAST(t AS DATE) AS STRING), ',', CASE WHEN obs_id % 17 = 0 THEN 'xx' ELSE CAST(hour(t) * 100 AS STRING) END, ',',
    CASE WHEN obs_id % 5 = 0 THEN '' ELSE CAST(CAST(frp AS DECIMAL(9, 2)) AS STRING) END) AS line
FROM {observation}"""


def _lines(x):
    return x.spark.sql(LINE, observation=x.observation)


PASS_SQL = """row_ok AS (SELECT obs_id, fire_id, date_trunc('hour', t) AS t, CAST(CAST(lon AS DECIMAL(9, 3)) AS DOUBLE) AS lon,
    CAST(CAST(lat AS DECIMAL(9, 3)) AS DOUBLE) AS lat,
    CASE WHEN obs_id % 5 = 0 THEN 0.0 ELSE CAST(CAST(frp AS DECIMAL(9, 2)) AS DOUBLE) END AS frp,
    CASE obs_id % 4 WHEN 0 THEN 'VIIRS_SNPP_NRT' WHEN 1 THEN 'VIIRS_NOAA20_NRT' WHEN 2 THEN 'MODIS_NRT' ELSE 'OTHER' END AS product
  FROM observation WHERE obs_id % 17 <> 0)"""


@query(
    "S1_active_fire_csv",
    f"""WITH {PASS_SQL} SELECT obs_id, t, lon, lat, frp FROM row_ok
        WHERE t BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-25 12:00:00'""",
)
def s1(x):
    rows = feeds.between_times(feeds.active_fire_rows(_lines(x)), "2024-01-03 00:00:00", "2024-01-25 12:00:00")
    return rows.select("obs_id", "t", "lon", "lat", "frp")


@query(
    "S2_passes",
    f"""WITH {PASS_SQL} SELECT fire_id, product, t, COUNT(*) AS n_pixels, {r('AVG(frp)')} AS mean_frp,
          {r('AVG(lon)')} AS lon, {r('AVG(lat)')} AS lat FROM row_ok GROUP BY fire_id, product, t""",
)
def s2(x):
    out = feeds.passes(feeds.active_fire_rows(_lines(x)))
    return out.withColumns({c: rounded(c) for c in ("mean_frp", "lon", "lat")})


@query(
    "S3_product_lookup",
    f"""WITH {PASS_SQL} SELECT obs_id, CASE WHEN product LIKE 'VIIRS%' THEN 'viirs' WHEN product LIKE 'MODIS%' THEN 'modis' END AS kind,
          CASE WHEN product LIKE 'VIIRS%' THEN 375.0::DOUBLE WHEN product LIKE 'MODIS%' THEN 1000.0::DOUBLE END AS resolution_m FROM row_ok""",
)
def s3(x):
    return feeds.with_product(feeds.active_fire_rows(_lines(x))).select("obs_id", "kind", "resolution_m")


PIXEL = """SELECT event_id AS pixel_id, CAST(user_id % 5 AS INT) AS fire_id, user_id AS frame_id,
  CASE WHEN user_id % 3 = 0 OR event_id % 4 > 0 THEN CAST(NULL AS DOUBLE) ELSE value - 5 END AS power,
  CAST(event_id % 40 AS INT) AS mask, date_trunc('day', ts) AS t,
  CAST(-0.05 AS DOUBLE) + (event_id % 211) * CAST(0.0005 AS DOUBLE) AS x,
  CAST(0.09 AS DOUBLE) + (event_id % 97) * CAST(0.0008 AS DOUBLE) AS y FROM {events}"""
PIXEL_CTE = "px AS (" + PIXEL.replace("{events}", "events") + ")"
CODES = ", ".join(str(c) for c in K.GEO_FIRE_MASK_CODES)
LIT_CTE = f"""{PIXEL_CTE}, lit AS (SELECT *, MAX(CASE WHEN power > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY frame_id) AS any_p FROM px),
  hot AS (SELECT * FROM lit WHERE (any_p = 1 AND power > 0) OR (any_p = 0 AND mask IN ({CODES})))"""


def _pixels(x):
    return _zoneless(x.spark.sql(PIXEL, events=x.events))


@query("S4_fire_pixels", f"WITH {LIT_CTE} SELECT pixel_id, frame_id FROM hot")
def s4(x):
    return feeds.fire_pixels(_pixels(x)).select("pixel_id", "frame_id")


_H, _A, _B = K.GEO_HEIGHT_M + K.GEO_SEMI_MAJOR_M, K.GEO_SEMI_MAJOR_M, K.GEO_SEMI_MINOR_M
_H, _A, _B = (f"CAST({v} AS DOUBLE)" for v in (_H, _A, _B))
_ratio = f"({_A} * {_A} / ({_B} * {_B}))"
NAV_CTE = f"""n1 AS (SELECT *, sin(x) * sin(x) + cos(x) * cos(x) * (cos(y) * cos(y) + {_ratio} * sin(y) * sin(y)) AS a,
    -2.0 * {_H} * cos(x) * cos(y) AS b, {_H} * {_H} - {_A} * {_A} AS c FROM px),
  n2 AS (SELECT *, (-b - sqrt(b * b - 4 * a * c)) / (2 * a) AS rs FROM n1 WHERE b * b - 4 * a * c >= 0),
  nav AS (SELECT *, -137.0 - degrees(atan((-rs * sin(x)) / ({_H} - rs * cos(x) * cos(y)))) AS lon,
    degrees(atan({_ratio} * rs * cos(x) * sin(y) / sqrt(({_H} - rs * cos(x) * cos(y)) * ({_H} - rs * cos(x) * cos(y))
      + rs * sin(x) * rs * sin(x)))) AS lat FROM n2)"""


@query(
    "S5_navigate_pixels",
    f"""WITH {PIXEL_CTE}, {NAV_CTE} SELECT pixel_id, {r('lon', 5)} AS lon, {r('lat', 5)} AS lat FROM nav
        WHERE lon BETWEEN -150 AND -120 AND lat BETWEEN 20 AND 60""",
)
def s5(x):
    out = feeds.navigate_pixels(_pixels(x), {"minlon": -150, "maxlon": -120, "minlat": 20, "maxlat": 60})
    return out.select("pixel_id", rounded("lon", 5).alias("lon"), rounded("lat", 5).alias("lat"))


@query(
    "S6_nearest_frames",
    """WITH f AS (SELECT CAST(user_id % 5 AS INT) AS fire_id, event_id AS frame_id, date_trunc('second', ts) AS t FROM events),
        s AS (SELECT fire_id, k, TIMESTAMP '2024-01-05 00:00:00' AS t0, 1728000 * k / 5.0 AS want
              FROM (SELECT DISTINCT fire_id FROM f) q, range(0, 6) g(k))
       SELECT fire_id, CAST(k AS INT) AS k, frame_id, t FROM (
         SELECT s.fire_id, k, f.frame_id, f.t, row_number() OVER (PARTITION BY s.fire_id, k
            ORDER BY abs(date_diff('second', t0, f.t) - want), f.t, f.frame_id) AS rn
         FROM s JOIN f ON f.fire_id = s.fire_id) z WHERE rn = 1""",
)
def s6(x):
    frames = _zoneless(
        x.events.selectExpr("CAST(user_id % 5 AS INT) AS fire_id", "event_id AS frame_id", "date_trunc('second', ts) AS t")
    )
    windows = frames.select("fire_id").distinct().selectExpr(
        "fire_id", "TIMESTAMP_NTZ '2024-01-05 00:00:00' AS t0", "TIMESTAMP_NTZ '2024-01-25 00:00:00' AS t1"
    )
    return feeds.nearest_frames(frames, windows)


@query(
    "S7_frame_observations",
    f"""WITH {LIT_CTE} SELECT fire_id, t, COUNT(*) AS n_pixels, 2000.0::DOUBLE AS reported_uncertainty_m FROM hot GROUP BY fire_id, t""",
)
def s7(x):
    return feeds.frames_to_observations(feeds.fire_pixels(_pixels(x)))


DOC = """SELECT c_custkey AS k, CAST(c_custkey % 5 AS INT) AS fire_id, concat(
  '{{"type":"FeatureCollection","features":[{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[',
  a, ',38],[', b, ',38],[', b, ',39],[', a, ',39],[', a, ',38]]]}},"properties":{{"poly_IncidentName":"', c_name,
  '","attr_IncidentName":"', c_mktsegment, ' fire","poly_GISAcres":', CAST(c_custkey % 900 AS STRING),
  CASE c_custkey % 3 WHEN 0 THEN ',"poly_DateCurrent":1700000000000' WHEN 1 THEN ',"poly_CreateDate":1600000000000' ELSE '' END,
  '}}}}]}}') AS doc
FROM (SELECT *, CAST(-122 - c_custkey % 7 AS STRING) AS a, CAST(-100 + c_custkey % 11 AS STRING) AS b FROM {customer}) c"""
NOW_TS = "2024-06-01 00:00:00"


def _features(x):
    docs = x.spark.sql(DOC, customer=x.customer)
    return feeds.perimeter_features(docs, F.lit(NOW_TS).cast("timestamp_ntz"))


@query(
    "S8_perimeter_features",
    f"""SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN TIMESTAMP '2023-11-14 22:13:20' WHEN 1 THEN TIMESTAMP '2020-09-13 12:26:40'
          ELSE TIMESTAMP '{NOW_TS}' END AS t, c_name AS poly_name, CAST(c_custkey % 900 AS DOUBLE) AS acres,
          -122.0 - c_custkey % 7 AS minlon, -100.0 + c_custkey % 11 AS maxlon, 120.0::DOUBLE AS sigma_m
        FROM (SELECT * REPLACE (CAST(c_custkey AS DOUBLE) AS c_custkey) FROM customer) c""".replace("c_custkey AS k,", "CAST(c_custkey AS BIGINT) AS k,"),
)
def s8(x):
    return _features(x).select("k", "t", "poly_name", "acres", "box.minlon", "box.maxlon", "sigma_m")


@query(
    "S9_find_incident",
    """SELECT c_name AS name, (-122.0::DOUBLE - c_custkey % 7 + -100.0::DOUBLE + c_custkey % 11) / 2 AS lon, 38.5::DOUBLE AS lat,
              CAST(c_custkey % 900 AS DOUBLE) AS acres
       FROM customer WHERE upper(c_mktsegment) LIKE '%BUILDING FIRE%' OR upper(concat(c_mktsegment, ' fire')) LIKE '%BUILDING FIRE%'
       ORDER BY c_custkey LIMIT 1""",
)
def s9(x):
    """No polygon name holds the text, so the attribute name decides."""
    out = feeds.find_incident(_features(x), "building fire", "k")
    return out.select("name", "lon", "lat", "acres")


@query(
    "S10_envelope_filter",
    """SELECT c_custkey AS k FROM customer WHERE -122 - c_custkey % 7 <= -95 AND -100 + c_custkey % 11 >= -96
       AND upper(c_name) LIKE '%00%'""",
)
def s10(x):
    box = {"minlon": -96, "maxlon": -95, "minlat": 38.2, "maxlat": 38.4}
    return feeds.intersecting(_features(x), box, "00").select("k")


@query(
    "S10_landed_box_filter",
    """SELECT c_custkey AS k, -122.0 - CAST(c_custkey % 7 AS DOUBLE) AS minlon, -100.0 + CAST(c_custkey % 11 AS DOUBLE) AS maxlon FROM customer
       WHERE -122 - c_custkey % 7 <= -127 AND -100 + c_custkey % 11 >= -129""",
)
def s10_landed(x):
    """Perimeters landed once with box columns, then asked for a box far in the west."""
    path = work_path(x.spark, "boxes")
    boxes.land_boxes(_features(x).drop("ring"), path)
    box = {"minlon": -129, "maxlon": -127, "minlat": 38.2, "maxlat": 38.4}
    return boxes.read_boxes(x.spark, path, box).select("k", "minlon", "maxlon")


@query(
    "S11_largest_perimeter",
    """SELECT fire_id, k, area_deg2 FROM (SELECT CAST(c_custkey % 5 AS INT) AS fire_id, c_custkey AS k,
          CAST(-100 + c_custkey % 11 - (-122 - c_custkey % 7) AS DOUBLE) AS area_deg2 FROM customer) q
       QUALIFY row_number() OVER (PARTITION BY fire_id ORDER BY area_deg2 DESC, k DESC) = 1""",
)
def s11(x):
    return feeds.largest_perimeter(_features(x), "fire_id", "k")


RECORD = """SELECT c_custkey AS k, concat('{{"id":"c', CAST(c_custkey AS STRING), '","lat":',
  CAST(CAST(38.3 + (c_custkey % 37) * 0.01 AS DECIMAL(9, 2)) AS STRING), ',"lon":', CAST(CAST(-122.8 + (c_custkey % 40) * 0.01 AS DECIMAL(9, 2)) AS STRING),
  CASE WHEN c_custkey % 2 = 0 THEN ',"name":"cam","pan_deg":12.5' ELSE '' END, '}}') AS record FROM {customer}"""


@query(
    "S12_camera_records",
    f"""SELECT k, id, name, lat, lon, elev_m, pan_deg, fov_deg, network FROM (
          SELECT c_custkey AS k, concat('c', CAST(c_custkey AS STRING)) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'cam' ELSE 'camera' END AS name,
            CAST(CAST(38.3 + (c_custkey % 37) * 0.01 AS DECIMAL(9, 2)) AS DOUBLE) AS lat, CAST(CAST(-122.8 + (c_custkey % 40) * 0.01 AS DECIMAL(9, 2)) AS DOUBLE) AS lon,
            0.0::DOUBLE AS elev_m, CASE WHEN c_custkey % 2 = 0 THEN 12.5::DOUBLE ELSE 0.0::DOUBLE END AS pan_deg, 60.0::DOUBLE AS fov_deg,
            'ALERTCalifornia' AS network FROM customer) c WHERE {BOX_SQL}""",
)
def s12(x):
    out = feeds.camera_rows(x.spark.sql(RECORD, customer=x.customer), BOX)
    return out.select("k", "id", "name", "lat", "lon", "elev_m", "pan_deg", "fov_deg", "network")


WX = """SELECT c_custkey AS k, concat('{{"windSpeed":{{"values":[', CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN '{{"value":null}}'
  ELSE concat('{{"value":', CAST(c_custkey % 60 AS STRING), '}},{{"value":99}}') END, ']}},"windDirection":{{"values":[{{"value":',
  CAST(c_custkey % 360 AS STRING), '}}]}}}}') AS doc FROM {customer}"""
_sp = "(CASE WHEN c_custkey % 4 < 2 THEN 12.0 ELSE c_custkey % 60 END / 3.6)"


@query(
    "S13_weather_series",
    f"SELECT c_custkey AS k, {r(_sp)} AS speed_ms, CAST(c_custkey % 360 AS DOUBLE) AS dir_from_deg, 20.0::DOUBLE AS rh_pct, 25.0::DOUBLE AS temp_c FROM customer",
)
def s13(x):
    out = feeds.weather_rows(x.spark.sql(WX, customer=x.customer))
    return out.select("k", rounded("speed_ms").alias("speed_ms"), "dir_from_deg", "rh_pct", "temp_c")


@query(
    "S14_wind_components",
    f"""SELECT cell_id, {r('spd * sin(radians((dir + 180) % 360))')} AS u, {r('spd * cos(radians((dir + 180) % 360))')} AS v,
          {r('(degrees(atan2(-wind_u, -wind_v)) + 360.0) % 360.0')} AS dir_from
        FROM (SELECT *, wind_u * 2 AS spd, CAST(cell_id % 360 AS DOUBLE) AS dir FROM grid_cell) g""",
)
def s14(x):
    uv = geo.wind_to_uv(F.col("wind_u") * 2, (F.col("cell_id") % 360).cast("double"))
    return x.grid_cell.select(
        "cell_id", rounded(uv["u"]).alias("u"), rounded(uv["v"]).alias("v"),
        rounded(geo.uv_dir_from("wind_u", "wind_v")).alias("dir_from"),
    )


WGRID = """SELECT CAST(237 AS DOUBLE) + (p_partkey % 50) * CAST(0.013 AS DOUBLE) AS lon,
  CAST(38.2 AS DOUBLE) + floor(p_partkey / 50) * CAST(0.017 AS DOUBLE) AS lat, CAST(p_size AS DOUBLE) AS wind_u,
  CAST(p_partkey % 7 AS DOUBLE) AS wind_v FROM {part}"""


@query(
    "S15_nearest_weather",
    f"""WITH g AS ({WGRID.replace('{part}', 'part')}), d AS (
          SELECT s.structure_id, g.wind_u, g.wind_v, round((g.lon - 360 - s.lon) * (g.lon - 360 - s.lon) + (g.lat - s.lat) * (g.lat - s.lat), 12) AS d2,
                 g.lat, g.lon FROM structure s, g)
        SELECT structure_id, wind_u, wind_v FROM d QUALIFY row_number() OVER (PARTITION BY structure_id ORDER BY d2, lat, lon) = 1""",
)
def s15(x):
    grid = x.spark.sql(WGRID, part=x.part)
    out = feeds.nearest_weather(x.structure.select("structure_id", "lon", "lat"), grid)
    return out.select("structure_id", "wind_u", "wind_v")


@query(
    "S16_source_cascade",
    """SELECT fire_id, source, n FROM (
         SELECT CAST(user_id AS INT) AS fire_id, event_type AS source, COUNT(*) AS n, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2
            WHEN 'click' THEN 3 ELSE 4 END AS pr FROM events GROUP BY user_id, event_type) q
       QUALIFY row_number() OVER (PARTITION BY fire_id ORDER BY pr, source) = 1""",
)
def s16(x):
    c = x.events.groupBy(F.col("user_id").cast("int").alias("fire_id"), F.col("event_type").alias("source")).agg(
        F.count("*").alias("n")
    )
    pr = F.expr("CASE source WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 ELSE 4 END")
    ranked = c.withColumn("priority", F.struct(pr.alias("p"), F.col("source").alias("s")))
    return feeds.source_cascade(ranked).select("fire_id", "source", "n")


def _tile(lon, lat, z):
    return (
        f"(({lon} + 180.0) / 360.0 * {2**z})",
        f"((1.0 - asinh(tan(radians({lat}))) / pi()) / 2.0 * {2**z})",
    )


_t = _tile("lon", "lat", 12)


@query(
    "S17_tile_address",
    f"SELECT obs_id, {r(_t[0])} AS tx, {r(_t[1])} AS ty, {r('lon')} AS back_lon, {r('lat')} AS back_lat FROM observation",
)
def s17(x):
    a = geo.deg_to_tile("lon", "lat", 12)
    back = geo.tile_to_deg(a["x"], a["y"], 12)
    return x.observation.select(
        "obs_id", rounded(a["x"]).alias("tx"), rounded(a["y"]).alias("ty"),
        rounded(back["lon"]).alias("back_lon"), rounded(back["lat"]).alias("back_lat"),
    )


TPIX = """SELECT CAST(40 + p_partkey % 3 AS BIGINT) AS tile_x, CAST(97 AS BIGINT) + p_partkey % 5 AS tile_y, CAST(p_partkey % 16 AS INT) AS px,
  CAST(floor(p_partkey / 16) % 16 AS INT) AS py, MAX(p_size) AS r, MIN(p_size) AS g, MAX(p_partkey % 256) AS b
  FROM {part} GROUP BY p_partkey % 3, p_partkey % 5, p_partkey % 16, floor(p_partkey / 16) % 16"""
_t8 = _tile("lon", "lat", 8)


@query(
    "S18_terrarium_sample",
    f"""WITH tp AS ({TPIX.replace('{part}', 'part')}), q AS (SELECT obs_id, {_t8[0]} AS x, {_t8[1]} AS y FROM observation),
        a AS (SELECT obs_id, CAST(floor(x) AS BIGINT) AS tx, CAST(floor(y) AS BIGINT) AS ty, least(CAST(floor((x - floor(x)) * 16) AS INT), 15) AS px,
                     least(CAST(floor((y - floor(y)) * 16) AS INT), 15) AS py FROM q)
        SELECT obs_id, coalesce(r * 256.0 + g + b / 256.0 - 32768.0, 0.0)::DOUBLE AS elev_m
        FROM a LEFT JOIN tp ON tile_x = tx AND tile_y = ty AND tp.px = a.px AND tp.py = a.py""",
)
def s18(x):
    pix = x.spark.sql(TPIX, part=x.part)
    pts = x.observation.select("obs_id", "lon", "lat")
    return terrain.sample_tiles(pts, pix, 8, 16).select("obs_id", "elev_m")


@query(
    "S19_tile_span",
    f"""SELECT fire_id, n_tiles, n_tiles <= 64 AS ok FROM (SELECT fire_id, CAST((MAX(x) - MIN(x) + 1) * (MAX(y) - MIN(y) + 1) AS BIGINT) AS n_tiles
        FROM (SELECT fire_id, floor({_t[0]}) AS x, floor({_t[1]}) AS y FROM observation) t GROUP BY fire_id) s""",
)
def s19(x):
    return terrain.tile_span(x.observation, 12)


_f40 = " ".join(f"WHEN code BETWEEN {a} AND {b} THEN {f}" for a, b, f in K.FUEL40_RANGES)
CODE = """SELECT p_partkey AS k, p_partkey % 9 AS raster_id, CAST(CASE WHEN p_partkey % 9 < 3 THEN p_size % 21 ELSE 85 + (p_partkey * 7) % 125 END AS INT) AS code FROM {part}"""


@query(
    "S20_fuel_crosswalk",
    f"""WITH c AS ({CODE.replace('{part}', 'part')}), m AS (SELECT *, MAX(code) OVER (PARTITION BY raster_id) AS top FROM c)
        SELECT k, CASE WHEN top <= 20 THEN CASE WHEN code BETWEEN 1 AND 13 THEN code ELSE 0 END ELSE CASE {_f40} ELSE 0 END END AS fuel FROM m""",
)
def s20(x):
    return terrain.map_fuel_codes(x.spark.sql(CODE, part=x.part)).select("k", "fuel")


_wc = "CASE code WHEN 10 THEN 10 WHEN 20 THEN 5 WHEN 30 THEN 1 WHEN 40 THEN 1 WHEN 90 THEN 2 ELSE 0 END"
_g = grad_sql("300.0")
COVER = "SELECT *, CAST(cell_id % 11 * 10 AS INT) AS code FROM {grid_cell}"


def _cover(x):
    return terrain.landcover_fuel(x.spark.sql(COVER, grid_cell=x.grid_cell).drop("fuel"), 300.0)


@query(
    "S21_landcover_fuel",
    f"""WITH g AS (SELECT fire_id, i, j, CAST(cell_id % 11 * 10 AS INT) AS code, {_g[0]} AS gx, {_g[1]} AS gy FROM grid_cell)
        SELECT fire_id, i, j, CASE WHEN ({_wc}) = 5 AND sqrt(gx * gx + gy * gy) > 0.5 THEN 4 ELSE {_wc} END AS fuel FROM g""",
)
def s21(x):
    return _cover(x).select("fire_id", "i", "j", "fuel")


@query(
    "S22_usable_fuel",
    f"""SELECT fire_id, {r('AVG(CASE WHEN fuel > 0 THEN 1.0 ELSE 0.0 END)')} AS burnable,
          AVG(CASE WHEN fuel > 0 THEN 1.0 ELSE 0.0 END) > 0.05 AS usable FROM grid_cell GROUP BY fire_id""",
)
def s22(x):
    return terrain.usable_fuel(x.grid_cell, "fire_id").withColumn("burnable", rounded("burnable"))


@query(
    "S23_heuristic_fuel",
    f"""WITH p AS (SELECT fire_id, quantile_cont(elevation, 0.03) AS p3, quantile_cont(elevation, 0.3) AS p30, quantile_cont(elevation, 0.75) AS p75
                   FROM grid_cell GROUP BY fire_id),
        g AS (SELECT fire_id, i, j, elevation AS e, {_g[0]} AS gx, {_g[1]} AS gy FROM grid_cell)
        SELECT g.fire_id, i, j, CASE WHEN e < p3 AND {uniform_sql(3, 'g.fire_id', 'i', 'j')} < 0.5 THEN 0 WHEN sqrt(gx * gx + gy * gy) > 0.6 THEN 4
          WHEN e < p30 THEN 1 WHEN e < p75 THEN 5 ELSE 10 END AS fuel FROM g JOIN p ON p.fire_id = g.fire_id""",
)
def s23(x):
    return terrain.heuristic_fuel(x.grid_cell.drop("fuel"), 300.0).select("fire_id", "i", "j", "fuel")


@query(
    "S24_landcover_tile",
    """SELECT obs_id, concat('N', lpad(CAST(CAST(floor(lat / 3) * 3 AS INT) AS STRING), 2, '0'), 'W',
          lpad(CAST(-CAST(floor(lon / 3) * 3 AS INT) AS STRING), 3, '0')) AS tile FROM observation""",
)
def s24(x):
    return x.observation.select("obs_id", geo.landcover_tile("lon", "lat").alias("tile"))


ROADROW = """SELECT s_suppkey AS pos, CAST(s_suppkey % 5 AS INT) AS fire_id, CASE s_suppkey % 4 WHEN 0 THEN array() WHEN 1 THEN array('nan')
  ELSE array(s_name, 'alt') END AS names, CASE WHEN s_suppkey % 3 > 0 THEN 'primary' END AS highway FROM {supplier}"""


@query(
    "S25_road_rows",
    """SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 4 < 2 THEN '' ELSE s_name END AS name,
          CASE WHEN s_suppkey % 3 > 0 THEN 'primary' ELSE 'road' END AS highway FROM supplier""",
)
def s25(x):
    return assets.road_rows(x.spark.sql(ROADROW, supplier=x.supplier)).select("pos", "name", "highway")


@query(
    "S26_building_rows",
    f"""SELECT structure_id, CASE WHEN structure_id % 3 = 0 THEN 'yes' ELSE type END AS type, 2.6::DOUBLE AS population_est,
               {r('lon - 0.00015')} AS minlon FROM structure WHERE structure_id % 7 <> 0""",
)
def s26(x):
    rows = x.structure.selectExpr(
        "structure_id", "fire_id", "CASE WHEN structure_id % 7 <> 0 THEN lon END AS lon", "lat",
        "CASE WHEN structure_id % 3 > 0 THEN type END AS building",
    )
    out = assets.building_rows(rows)
    return out.select("structure_id", "type", "population_est", rounded("box.minlon").alias("minlon"))


@query(
    "S27_zone_rows",
    """SELECT structure_id, CASE WHEN structure_id % 4 = 1 THEN CAST(structure_id AS INT) ELSE CASE structure_id % 6 WHEN 0 THEN 150 WHEN 1 THEN 12000
         WHEN 2 THEN 6000 WHEN 3 THEN 2500 ELSE 1200 END END AS population FROM structure""",
)
def s27(x):
    rows = x.structure.selectExpr(
        "structure_id", "lon", "lat",
        "CASE structure_id % 6 WHEN 0 THEN 'Hamlet' WHEN 1 THEN 'town' WHEN 2 THEN 'suburb' WHEN 3 THEN 'neighbourhood' WHEN 4 THEN 'x' END AS place",
        "CASE structure_id % 4 WHEN 0 THEN 'about 12' WHEN 1 THEN CAST(structure_id AS STRING) WHEN 2 THEN '0' END AS population",
    )
    return assets.zone_rows(rows).select("structure_id", "population")


_fz = frag.dest("center_lon", "center_lat", "b.b", "12000.0")


@query(
    "S28_fallback_zones",
    f"""SELECT s.fire_id, concat('zone_', CAST(b.k AS STRING)) AS zone_id, {r(_fz[0])} AS lon, {r(_fz[1])} AS lat
        FROM site s, (VALUES (0, 30.0), (1, 90.0), (2, 150.0), (3, 210.0), (4, 300.0)) b(k, b)
        WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey % 3 = s.fire_id)""",
)
def s28(x):
    events = x.site.selectExpr("fire_id", "center_lon AS lon", "center_lat AS lat")
    zones = x.customer.selectExpr("CAST(c_custkey % 3 AS INT) AS fire_id")
    out = assets.fallback_zones(events, zones, [30, 90, 150, 210, 300], 12000.0)
    return out.select("fire_id", "zone_id", rounded("lon").alias("lon"), rounded("lat").alias("lat"))


@query(
    "S29_source_status",
    """SELECT 'events' AS source, true AS available, COUNT(*) AS n FROM events UNION ALL SELECT 'absent', false, 0""",
)
def s29(x):
    """One source reads, another has no file."""
    _, status = feeds.source_status(
        x.spark, {"events": lambda: x.events, "absent": lambda: x.spark.read.parquet(x.folder + "/absent.parquet")}
    )
    return status.select("source", "available", F.coalesce("n_rows", F.lit(0)).alias("n"))


@query(
    "S30_snapshot_reuse",
    "SELECT CAST(fire_id AS INT) AS event_id, kind AS source, COUNT(*) AS n FROM observation GROUP BY fire_id, kind",
)
def s30(x):
    """Written twice: the second write replaces only its own partitions."""
    path = work_path(x.spark, "snapshot")
    rows = x.observation.select(F.col("fire_id").alias("event_id"), F.col("kind").alias("source"), "obs_id", "t")
    sinks.write_snapshot(rows, path)
    sinks.write_snapshot(rows.filter("source = 'goes'"), path)
    return sinks.read_snapshot(x.spark, path, 3600).groupBy("event_id", "source").agg(F.count("*").alias("n"))


@query(
    "S31_landscape_bank",
    f"""SELECT fire_id, {r('stddev_pop(elevation)', 4)} AS elev_std, {r('AVG(CASE WHEN fuel > 0 THEN 1.0 ELSE 0.0 END)')} AS burnable, COUNT(*) AS n_cells
        FROM grid_cell GROUP BY fire_id HAVING stddev_pop(elevation) >= 1 AND AVG(CASE WHEN fuel > 0 THEN 1.0 ELSE 0.0 END) >= 0.05""",
)
def s31(x):
    out = terrain.landscape_bank(x.grid_cell)
    return out.withColumns({"elev_std": rounded("elev_std", 4), "burnable": rounded("burnable")})


IMAGE = """SELECT p_partkey AS image_id, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('0 0.5 0.25 0.1 0.2', chr(10), 'bad line')
  ELSE concat(chr(10), '0 0.5 0.5 0.2 0.2', chr(10), '1 0.125 0.5 0.25 0.75') END AS annotations FROM {part}"""


@query(
    "S32_label_boxes",
    """SELECT p_partkey AS image_id, 0.5::DOUBLE AS cx, 0.25::DOUBLE AS cy, 0.1::DOUBLE AS w FROM part WHERE p_partkey % 3 = 1
       UNION ALL SELECT p_partkey, 0.5, 0.5, 0.2 FROM part WHERE p_partkey % 3 = 2
       UNION ALL SELECT p_partkey, 0.125, 0.5, 0.25 FROM part WHERE p_partkey % 3 = 2""",
)
def s32(x):
    return assets.label_boxes(x.spark.sql(IMAGE, part=x.part)).select("image_id", "cx", "cy", "w")


@query(
    "S32_label_split",
    """(SELECT p_partkey AS image_id, CAST(p_partkey % 3 AS BIGINT) AS n_boxes FROM part WHERE p_partkey % 3 > 0 ORDER BY p_partkey LIMIT 800)
       UNION ALL (SELECT p_partkey, 0 FROM part WHERE p_partkey % 3 = 0 ORDER BY p_partkey LIMIT 200)""",
)
def s32_split(x):
    images = x.spark.sql(IMAGE, part=x.part)
    return assets.label_split(images, assets.label_boxes(images), "image_id", 800, 200)


def _picture(x):
    layers = {
        "zones": x.zone.selectExpr("fire_id", "zone_id AS id", "name", "population"),
        "cameras": x.camera.selectExpr("fire_id", "camera_id AS id", "name", "pan_deg"),
        "observations": x.observation.selectExpr("fire_id", "obs_id AS id", "kind", "lon", "lat"),
    }
    from hazardgrid.operators.ensemble import forecast_summary

    fc = forecast_summary(field(x), 2000.0).withColumn("arm", F.lit("on"))
    path = work_path(x.spark, "picture")
    sinks.write_picture(sinks.picture_features(layers), sinks.picture_heads(x.site, fc), path)
    return path


@query(
    "S33_picture_sink",
    """SELECT CAST(fire_id AS BIGINT) AS fire_id, 'zones' AS layer, COUNT(*) AS n FROM zone GROUP BY fire_id
       UNION ALL SELECT fire_id, 'cameras', COUNT(*) FROM camera GROUP BY fire_id
       UNION ALL SELECT fire_id, 'observations', COUNT(*) FROM observation GROUP BY fire_id""",
)
def s33(x):
    """Written as JSON, read back and counted."""
    back = x.spark.read.json(_picture(x) + "/features")
    return back.groupBy(F.col("fire_id").cast("long").alias("fire_id"), "layer").agg(F.count("*").alias("n"))


@query(
    "S34_results_sink",
    f"SELECT fire_id, horizon_min, {r('MAX(p)')} AS max_prob FROM prob WHERE arm = 'on' GROUP BY fire_id, horizon_min",
)
def s34(x):
    from hazardgrid.operators.ensemble import forecast_summary

    path = work_path(x.spark, "results")
    sinks.write_results(forecast_summary(field(x), 2000.0), path)
    return x.spark.read.parquet(path).select("fire_id", "horizon_min", rounded("max_prob").alias("max_prob"))


@query(
    "S35_observation_provenance",
    f"""SELECT fire_id, kind, strftime(t_min_ts, '%Y-%m-%d %H:%M UTC') AS t_utc, n AS n_pixels, {r('lat')} AS lat, {r('lon')} AS lon FROM (
          SELECT fire_id, kind, date_trunc('hour', t) AS t_min_ts, COUNT(*) AS n, AVG(lon) AS lon, AVG(lat) AS lat FROM observation
          GROUP BY fire_id, kind, date_trunc('hour', t)) q""",
)
def s35(x):
    grouped = x.observation.groupBy("fire_id", "kind", F.date_trunc("hour", "t").alias("h")).agg(
        F.count("*").alias("n_pixels"), rounded(F.avg("lat")).alias("lat"), rounded(F.avg("lon")).alias("lon")
    )
    return grouped.select(
        "fire_id", "kind", F.concat(F.date_format("h", "yyyy-MM-dd HH:mm"), F.lit(" UTC")).alias("t_utc"),
        "n_pixels", "lat", "lon",
    ).orderBy("t_utc")


@query("S36_events_with_picture", "SELECT DISTINCT CAST(fire_id AS BIGINT) AS fire_id FROM site")
def s36(x):
    out = sinks.events_with_picture(x.spark, _picture(x))
    return out.select(F.col("fire_id").cast("long").alias("fire_id"))


@query(
    "S37_event_registry",
    """SELECT o_orderkey AS event_no, o_orderdate AS start_utc, CAST(floor(2 * (14000 + o_custkey % 12 * 1000) / 250.0) AS INT) AS nx,
              360 AS window_min, 180 AS assim_min FROM orders""",
)
def s37(x):
    """Every order as an event: its parameters drive the operators in place of a loop over events."""
    events = x.orders.selectExpr(
        "o_orderkey AS event_no", "o_orderdate AS start_utc", "250.0D AS cell_m",
        "CAST(14000 + o_custkey % 12 * 1000 AS DOUBLE) AS half_extent_m",
    )
    return assets.registry_for(events).select("event_no", "start_utc", "nx", "window_min", "assim_min")
