"""Ensemble aggregates (E)."""

from pyspark.sql import functions as F

from hazardgrid import constants as K
from hazardgrid.functions.draws import normal_sql
from hazardgrid.operators import ensemble, outline
from hazardgrid.operators.common import rounded
from hazardgrid.plans import frag
from hazardgrid.plans.geo_queries import rings_sql
from hazardgrid.plans.registry import query, r

H = [15, 30, 60, 180]


NUMBERS = ["wind_mult", "wind_dir_offset_deg", "moisture_mult", "ros_mult", "ignition_lon", "ignition_lat"]


def drawn_sql(n: int, n_tail: int) -> str:
    """Check SQL of ``n`` drawn members per event; ignitions at the sites' centres."""
    c = K.ENSEMBLE_PRIOR
    z = lambda name: normal_sql(c["seed"], "fire_id", "member_id", f"'{name}'")
    within = lambda x, lo, hi: f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, {x}))"
    tail = f"member_id >= {n - n_tail}"
    moved = frag.wgs(f"({z('east')} * {c['ignition_sd_m']})", f"({z('north')} * {c['ignition_sd_m']})", "center_lon", "center_lat")
    return f"""SELECT fire_id, CAST(member_id AS INT) AS member_id, 1.0::DOUBLE AS weight,
        CASE WHEN {tail} THEN {within(f"{z('wind')} * {c['tail_wind_mult_sd']} + {c['tail_wind_mult']}", 0.6, 4.0)}
             ELSE {within(f"{z('wind')} * {c['wind_mult_sd']} + 1.0", 0.4, 2.4)} END AS wind_mult,
        {z('direction')} * CASE WHEN {tail} THEN {c['tail_dir_factor']} ELSE 1.0 END * {c['wind_dir_sd_deg']} AS wind_dir_offset_deg,
        {within(f"{z('moisture')} * {c['moisture_mult_sd']} + 1.0", 0.35, 2.4)} AS moisture_mult,
        {within(f"{z('ros')} * {c['ros_mult_sd']} + 1.0", 0.4, 3.0)} AS ros_mult,
        CASE WHEN {tail} THEN {c['tail_spread_cap_ms']}::DOUBLE ELSE {c['spread_cap_ms']}::DOUBLE END AS spread_cap_ms,
        {moved[0]} AS ignition_lon, {moved[1]} AS ignition_lat
      FROM site, range(0, {n}) m(member_id)"""


@query(
    "E1_draw_members",
    f"""SELECT fire_id, member_id, weight, spread_cap_ms, {', '.join(f'{r(c)} AS {c}' for c in NUMBERS)} FROM ({drawn_sql(60, 15)}) d""",
)
def e1(x):
    """Sixty members per event, a quarter of them from the fast tail."""
    sites = x.site.withColumns({"ignition_lon": F.col("center_lon"), "ignition_lat": F.col("center_lat")})
    return ensemble.draw_members(sites, tail_frac=0.25).withColumns({c: rounded(c) for c in NUMBERS})


@query(
    "E2_normalised_weights",
    f"SELECT fire_id, member_id, {r('weight / SUM(weight) OVER (PARTITION BY fire_id)')} AS w FROM member",
)
def e2(x):
    return ensemble.normalised(x.member).select("fire_id", "member_id", rounded("w").alias("w"))


@query(
    "E3_effective_sample_size",
    f"SELECT fire_id, {r('SUM(weight) * SUM(weight) / SUM(weight * weight)')} AS ess FROM member GROUP BY fire_id",
)
def e3(x):
    return ensemble.effective_sample_size(x.member).select("fire_id", rounded("ess").alias("ess"))


def field(x, uniform=False):
    return ensemble.burn_probability(x.member_arrival, x.member, x.grid_cell, H, uniform)


@query(
    "E4_burn_probability",
    f"SELECT fire_id, horizon_min, i, j, {r('p')} AS p FROM prob WHERE arm = 'on'",
)
def e4(x):
    return field(x).withColumn("p", rounded("p"))


@query(
    "E4_burn_probability_unweighted",
    f"SELECT fire_id, horizon_min, i, j, {r('p')} AS p FROM prob WHERE arm = 'off'",
)
def e4_off(x):
    return field(x, uniform=True).withColumn("p", rounded("p"))


@query(
    "E5_threshold_regions",
    """SELECT fire_id, horizon_min, level, COUNT(*) AS n_cells
       FROM prob JOIN (SELECT CAST(unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS DOUBLE) AS level) b ON p >= level
       WHERE arm = 'on' GROUP BY fire_id, horizon_min, level""",
)
def e5(x):
    regions = ensemble.threshold_regions(field(x))
    return regions.groupBy("fire_id", "horizon_min", "level").agg(F.count("*").alias("n_cells"))


_region = """rg AS (SELECT fire_id, horizon_min, level, i, j FROM prob JOIN (SELECT CAST(unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS DOUBLE) AS level) b
       ON p >= level WHERE arm = 'on')"""


@query(
    "E5_region_rings",
    f"""WITH RECURSIVE {_region}, {rings_sql('rg', 'fire_id, horizon_min, level')}
        SELECT fire_id, horizon_min, level, COUNT(*) FILTER (area_cells > 0) AS n_outer, COUNT(*) FILTER (area_cells < 0) AS n_holes,
               SUM(area_cells) AS area_cells, CAST(SUM(n_corners) AS BIGINT) AS n_corners FROM rings GROUP BY fire_id, horizon_min, level""",
)
def e5_rings(x):
    """Outlines of all threshold regions at once."""
    keys = ["fire_id", "horizon_min", "level"]
    rings = outline.ring_measures(outline.mask_rings(ensemble.threshold_regions(field(x)), keys), keys)
    return rings.groupBy(*keys).agg(
        F.count_if(F.col("area_cells") > 0).alias("n_outer"), F.count_if(F.col("area_cells") < 0).alias("n_holes"),
        F.sum("area_cells").alias("area_cells"), F.sum("n_corners").alias("n_corners"),
    )


@query(
    "E6_mean_arrival",
    f"""SELECT c.fire_id, c.i, c.j, {r('''(coalesce(SUM(w.weight * m.arrival_min), 0)
              + (MAX(t.total) - coalesce(SUM(w.weight), 0)) * 1e9) / MAX(t.total)''', 3)} AS mean_arrival_min
        FROM grid_cell c JOIN (SELECT fire_id, SUM(weight) AS total FROM member GROUP BY fire_id) t
             ON t.fire_id = c.fire_id
        LEFT JOIN member_arrival m ON m.fire_id = c.fire_id AND m.i = c.i AND m.j = c.j
        LEFT JOIN member w ON w.fire_id = m.fire_id AND w.member_id = m.member_id
        GROUP BY c.fire_id, c.i, c.j""",
)
def e6(x):
    out = ensemble.mean_arrival(x.member_arrival, x.member, x.grid_cell)
    return out.withColumn("mean_arrival_min", rounded("mean_arrival_min", 3))


@query(
    "E7_burned_mask",
    "SELECT fire_id, member_id, i, j, arrival_min FROM member_arrival WHERE arrival_min <= 60",
)
def e7(x):
    return ensemble.burned_mask(x.member_arrival, 60)


@query(
    "E8_forecast_summary",
    f"""SELECT fire_id, horizon_min, {r('MAX(p)')} AS max_prob,
               COUNT(*) FILTER (p >= 0.5) * 4000000.0::DOUBLE AS burning_area_m2
        FROM prob WHERE arm = 'on' GROUP BY fire_id, horizon_min""",
)
def e8(x):
    s = ensemble.forecast_summary(field(x), 2000.0)
    return s.select("fire_id", "horizon_min", rounded("max_prob").alias("max_prob"), "burning_area_m2")


@query(
    "E9_region_area",
    f"""SELECT fire_id, horizon_min, {r('COUNT(*) FILTER (p >= 0.1) * 4.0')} AS region90_area_km2
        FROM prob WHERE arm = 'on' GROUP BY fire_id, horizon_min""",
)
def e9(x):
    s = ensemble.forecast_summary(field(x), 2000.0)
    return s.select("fire_id", "horizon_min", rounded("region90_area_km2").alias("region90_area_km2"))
