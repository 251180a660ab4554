"""Decisions (D)."""

from pyspark.sql import functions as F

from hazardgrid.functions import text
from hazardgrid.operators import decide, ensemble, exposure, spatial
from hazardgrid.operators.common import rounded
from hazardgrid.plans import frag
from hazardgrid.plans.ensemble_queries import H, field
from hazardgrid.plans.geo_queries import ROAD_SQL, _zone_rings, road_cells
from hazardgrid.plans.registry import query, r


def zone_cells(x):
    return spatial.polygon_cells(_zone_rings(x), "ring", ["zone_id", "fire_id"])


def first_sql(cells, asset):
    """CTEs: first arrival per (asset, member), cumulative shares, and statistics per asset."""
    return f"""first_a AS (
      SELECT c.fire_id, c.{asset}, m.member_id, MIN(m.arrival_min) AS arrival_min
      FROM {cells} c JOIN member_arrival m ON m.fire_id = c.fire_id AND m.i = c.i AND m.j = c.j
      GROUP BY c.fire_id, c.{asset}, m.member_id),
    total_w AS (SELECT fire_id, SUM(weight) AS total FROM member GROUP BY fire_id),
    dist AS (SELECT f.*, w.weight, t.total FROM first_a f
      JOIN member w ON w.fire_id = f.fire_id AND w.member_id = f.member_id
      JOIN total_w t ON t.fire_id = f.fire_id),
    cumd AS (SELECT *, SUM(weight) OVER (PARTITION BY fire_id, {asset} ORDER BY arrival_min) / total AS cum
      FROM dist)"""


def at_share(q):
    return f"MIN(arrival_min) FILTER (cum >= {q} - 1e-12)"


def p_by(m):
    return f"coalesce(SUM(weight) FILTER (arrival_min <= {m}), 0) / MAX(total)"


@query(
    "D1_arrival_distribution",
    f"""WITH {first_sql('zone_cell', 'zone_id')}
        SELECT z.fire_id, z.zone_id, w.member_id, f.arrival_min, {r('w.weight / t.total')} AS w
        FROM (SELECT DISTINCT fire_id, zone_id FROM zone_cell) z
        JOIN member w ON w.fire_id = z.fire_id JOIN total_w t ON t.fire_id = z.fire_id
        LEFT JOIN first_a f ON f.fire_id = z.fire_id AND f.zone_id = z.zone_id AND f.member_id = w.member_id""",
)
def d1(x):
    out = exposure.first_arrivals(zone_cells(x), x.member_arrival, x.member, "zone_id", complete=True)
    return out.select("fire_id", "zone_id", "member_id", "arrival_min", rounded("w").alias("w"))


def _zone_first(x):
    return exposure.first_arrivals(zone_cells(x), x.member_arrival, x.member, "zone_id")


@query(
    "D2_probability_by",
    f"""WITH {first_sql('zone_cell', 'zone_id')}
        SELECT fire_id, zone_id, {r(p_by(12))} AS p12, {r(p_by(30))} AS p30 FROM dist GROUP BY fire_id, zone_id""",
)
def d2(x):
    out = exposure.arrival_statistics(_zone_first(x), "zone_id", by={"p12": 12, "p30": 30})
    return out.select("fire_id", "zone_id", rounded("p12").alias("p12"), rounded("p30").alias("p30"))


@query(
    "D3_lead_time",
    f"""WITH {first_sql('zone_cell', 'zone_id')}
        SELECT fire_id, zone_id, {at_share(0.5)} - 10 AS lead_min FROM cumd GROUP BY fire_id, zone_id""",
)
def d3(x):
    out = exposure.arrival_statistics(_zone_first(x), "zone_id", {"t": 0.5})
    return out.select("fire_id", "zone_id", (F.col("t") - 10).alias("lead_min"))


@query(
    "D4_arrival_quantiles",
    f"""WITH {first_sql('zone_cell', 'zone_id')}
        SELECT fire_id, zone_id, {at_share(0.1)} AS q10, {at_share(0.5)} AS q50, {at_share(0.9)} AS q90
        FROM cumd GROUP BY fire_id, zone_id""",
)
def d4(x):
    return exposure.arrival_statistics(_zone_first(x), "zone_id", {"q10": 0.1, "q50": 0.5, "q90": 0.9})


NOW = 0
EVAC_SQL = f"""{first_sql('zone_cell', 'zone_id')},
  st AS (SELECT fire_id, zone_id, {at_share(0.5)} AS t50, {at_share(0.1)} AS t10, {at_share(0.9)} AS t90,
                {p_by(NOW + 180)} AS conf FROM cumd GROUP BY fire_id, zone_id),
  u AS (SELECT st.*, z.name, z.population, t50 - {NOW} AS lead,
          least(1.0, (CASE WHEN t50 IS NULL THEN conf * 0.3
             WHEN t50 - {NOW} - 60 < 0 THEN least(1.0, conf + 0.4)
             ELSE conf / (1 + (t50 - {NOW} - 60) / 30.0) END) * (0.5 + 0.5 * least(population / 2000.0, 1.0))) AS urg
        FROM st JOIN zone z ON z.zone_id = st.zone_id WHERE conf >= 0.05)"""


@query(
    "D5_evacuation_ranking",
    f"""WITH {EVAC_SQL}
        SELECT fire_id, zone_id, name, lead AS lead_time_min, t10 - {NOW} AS lead_time_low_min,
               t90 - {NOW} AS lead_time_high_min, {r('conf')} AS confidence, {r('urg')} AS urgency,
               CAST(row_number() OVER (PARTITION BY fire_id ORDER BY urg DESC, zone_id) AS INT) AS rank,
               CASE WHEN lead <= 60 THEN 'leave_now' ELSE 'watch' END AS action, lead - 60.0::DOUBLE AS spare_min
        FROM u""",
)
def d5(x):
    out = decide.recommend_evacuations(x.zone, zone_cells(x), x.member_arrival, x.member, NOW, 180)
    return out.drop("population").withColumns(
        {"confidence": rounded("confidence"), "urgency": rounded("urgency")}
    )


RISK_SQL = f"""{first_sql('zone_cell', 'zone_id')},
  hz AS (SELECT unnest([15, 30, 60, 180]) AS horizon_min),
  risk AS (SELECT z.fire_id, z.zone_id, z.population, h.horizon_min,
      coalesce((SELECT coalesce(SUM(d.weight) FILTER (d.arrival_min <= h.horizon_min), 0) / MAX(d.total)
                FROM dist d WHERE d.zone_id = z.zone_id), 0.0) AS prob_burned,
      coalesce(a.frac, 0.0) AS frac
    FROM zone z CROSS JOIN hz h
    LEFT JOIN (SELECT c.zone_id, p.horizon_min, AVG(p.p) AS frac FROM zone_cell c
               JOIN prob p ON p.arm = 'on' AND p.fire_id = c.fire_id AND p.i = c.i AND p.j = c.j
               GROUP BY c.zone_id, p.horizon_min) a ON a.zone_id = z.zone_id AND a.horizon_min = h.horizon_min)"""


def _risk(x):
    return decide.zone_risk(x.zone, zone_cells(x), field(x), x.member_arrival, x.member, H)


@query(
    "D6_zone_risk",
    f"""WITH {RISK_SQL}
        SELECT fire_id, zone_id, horizon_min, {r('prob_burned')} AS prob_burned, {r('frac')} AS area_fraction,
               {r('frac * population', 4)} AS expected_people FROM risk""",
)
def d6(x):
    return _risk(x).select(
        "fire_id", "zone_id", "horizon_min", rounded("prob_burned").alias("prob_burned"),
        rounded("area_fraction").alias("area_fraction"), rounded("expected_people", 4).alias("expected_people"),
    )


_sc = frag.cell_of("a.lon", "a.lat")


@query(
    "D7_structures_exposed",
    f"""SELECT a.fire_id, p.horizon_min, {r('SUM(p.p)', 4)} AS expected,
               COUNT(*) FILTER (p.p >= 0.7) AS high_conf, COUNT(*) AS n_total
        FROM structure a JOIN site s ON s.fire_id = a.fire_id
        JOIN prob p ON p.fire_id = a.fire_id AND p.arm = 'on' AND p.i = {frag.clip(_sc[0], 's.ny')}
             AND p.j = {frag.clip(_sc[1], 's.nx')} GROUP BY a.fire_id, p.horizon_min""",
)
def d7(x):
    out = decide.structures_exposed(x.structure, x.site, field(x))
    return out.withColumn("expected", rounded("expected", 4))


@query(
    "D8_population_at_risk",
    f"""WITH {RISK_SQL} SELECT fire_id, horizon_min, {r('SUM(frac * population)', 3)} AS expected_people
        FROM risk GROUP BY fire_id, horizon_min""",
)
def d8(x):
    out = decide.population_at_risk(_risk(x))
    return out.withColumn("expected_people", rounded("expected_people", 3))


@query(
    "D9_egress_threat",
    f"""WITH road_cell AS ({ROAD_SQL}), {first_sql('road_cell', 'road_id')},
        st AS (SELECT fire_id, road_id, {at_share(0.5)} AS t50, {p_by(180)} AS conf
               FROM cumd GROUP BY fire_id, road_id)
        SELECT st.fire_id, st.road_id,
               CASE WHEN name = '' THEN concat('segment ', substr(CAST(st.road_id AS STRING), 1, 8)) ELSE name END
                   AS target_name,
               t50 AS lead_time_min, t50 - 60.0::DOUBLE AS spare_min, {r('conf')} AS confidence, coalesce(t50 <= 60, false) AS closes_before_clear,
               {r('CASE WHEN t50 <= 60 THEN least(1.0, conf * (1 + (60 - t50) / 60.0)) ELSE conf * 0.4 END')} AS urgency
        FROM st JOIN road q ON q.road_id = st.road_id WHERE conf >= 0.1""",
)
def d9(x):
    out = decide.egress_threat(x.road, road_cells(x), x.member_arrival, x.member, 0, 180)
    return out.withColumns(
        {"confidence": rounded("confidence"), "urgency": rounded("urgency")}
    )


def disk_sql(points, key, radius_deg, name):
    lon, lat = frag.cell_center("c.i", "c.j")
    return f"""{name} AS (
      SELECT DISTINCT q.fire_id, q.{key}, q.i, q.j FROM (
        SELECT c.fire_id, z.{key}, c.i, c.j, {lon} - z.lon AS dx, {lat} - z.lat AS dy
        FROM {points} z JOIN site s ON s.fire_id = z.fire_id JOIN grid_cell c ON c.fire_id = z.fire_id) q
      WHERE dx * dx + dy * dy <= {radius_deg} * {radius_deg})"""


_b = "CAST(k * 15 AS DOUBLE)"
_sd = frag.dest("center_lon", "center_lat", _b, "6000.0")
_si = frag.cell_of("lon", "lat")


@query(
    "D10_staging",
    f"""WITH ring AS (SELECT fire_id, CAST(k AS INT) AS k, center_lon AS lon0, center_lat AS lat0,
                  {_sd[0]} AS lon, {_sd[1]} AS lat FROM site, range(0, 24) g(k)),
        {disk_sql('ring', 'k', '(3000.0 / 111320.0)', 'disk')}, {first_sql('disk', 'k')},
        threat AS (SELECT fire_id, k, {p_by(30)} AS threat FROM dist GROUP BY fire_id, k),
        sc AS (SELECT ring.fire_id, ring.k, lon, lat, coalesce(threat, 0.0) AS threat,
                 {frag.hav('lon', 'lat', 'lon0', 'lat0')} / 1000 AS km, p.p
               FROM ring JOIN site s ON s.fire_id = ring.fire_id
               JOIN prob p ON p.fire_id = ring.fire_id AND p.arm = 'on' AND p.horizon_min = 15
                AND p.i = {frag.clip(_si[0], 'ny')} AND p.j = {frag.clip(_si[1], 'nx')}
               LEFT JOIN threat t ON t.fire_id = ring.fire_id AND t.k = ring.k),
        rk AS (SELECT *, row_number() OVER (PARTITION BY fire_id
                 ORDER BY round((1 - threat) / (1 + km), 9) DESC, k) AS rn FROM sc WHERE p <= 0.1 AND threat <= 0.1)
        SELECT fire_id, concat('stage_', CAST(k AS STRING)) AS target, {r('lon')} AS lon, {r('lat')} AS lat,
               {r('1 - threat')} AS confidence, {r('(1 - threat) / (1 + km)')} AS urgency, CAST(rn AS INT) AS rank
        FROM rk WHERE rn <= 4""",
)
def d10(x):
    centres = x.site.selectExpr("fire_id", "center_lon AS lon", "center_lat AS lat")
    out = decide.suggest_staging(
        centres, x.site, field(x), x.member_arrival, x.member, 15, 15, disk_m=3000.0
    )
    return out.select(
        "fire_id", "target", rounded("lon").alias("lon"), rounded("lat").alias("lat"),
        rounded("confidence").alias("confidence"), rounded("urgency").alias("urgency"), "rank",
    )


METRICS = """COUNT(*) FILTER (flagged) AS n_flagged, COUNT(*) FILTER (flagged AND reached) AS flagged_correct,
   COUNT(*) FILTER (flagged AND NOT reached) AS false_alarms, COUNT(*) FILTER (reached) AS burned,
   COUNT(*) FILTER (reached AND NOT flagged) AS missed,
   round(COUNT(*) FILTER (flagged AND reached) / nullif(COUNT(*) FILTER (flagged), 0), 2) AS precision,
   round(COUNT(*) FILTER (flagged AND reached) / nullif(COUNT(*) FILTER (reached), 0), 2) AS recall"""


@query(
    "D11_decision_metrics",
    f"""SELECT fire_id, {METRICS} FROM (
          SELECT p.fire_id, p.p >= 0.6 AS flagged, coalesce(t.truth_min <= 180, false) AS reached
          FROM prob p JOIN truth t ON t.fire_id = p.fire_id AND t.i = p.i AND t.j = p.j
          WHERE p.arm = 'on' AND p.horizon_min = 180) f GROUP BY fire_id""",
)
def d11(x):
    """Every cell as a place: flagged by the forecast against reached by the fire."""
    flags = field(x).filter("horizon_min = 180").join(x.truth, spatial.CELL)
    flags = flags.select(
        "fire_id", (F.col("p") >= 0.6).alias("flagged"),
        F.coalesce(F.col("truth_min") <= 180, F.lit(False)).alias("reached"),
    )
    return decide.decision_metrics(flags)


DISK = disk_sql("zone_point", "zone_id", "(4000.0 / 111320.0)", "disk")


def sweep_sql(span, step):
    return f"""{DISK}, {first_sql('disk', 'zone_id')},
      st AS (SELECT fire_id, zone_id, {at_share(0.25)} AS tf, {at_share(0.5)} AS t50, {at_share(0.1)} AS t10,
                    {at_share(0.9)} AS t90, {p_by(span)} AS p_reached FROM cumd GROUP BY fire_id, zone_id),
      sweep AS (SELECT z.fire_id, z.zone_id, z.name, z.population, t50, t10, t90, coalesce(p_reached, 0.0) AS p_reached,
                  CASE WHEN ceil(tf / {step}) * {step} <= {span // step * step}
                       THEN ceil(tf / {step}) * {step} END AS flag_min
                FROM zone_point z JOIN (SELECT DISTINCT zone_id FROM disk) d ON d.zone_id = z.zone_id
                LEFT JOIN st ON st.zone_id = z.zone_id)"""


@query(
    "D12_flag_sweep",
    f"""WITH {sweep_sql(180, 8)}
        SELECT fire_id, zone_id, flag_min, {r('p_reached')} AS p_reached FROM sweep""",
)
def d12(x):
    s = decide.flag_sweep(x.zone_point, x.site, x.member_arrival, x.member, 180, 8)
    return s.select("fire_id", "zone_id", "flag_min", rounded("p_reached").alias("p_reached"))


RESP = f"""{sweep_sql(180, 8)},
  resp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fire_id ORDER BY flag_min, zone_id) AS rn
           FROM sweep WHERE flag_min IS NOT NULL) s WHERE rn <= 6)"""


FLAGGED = f"""{sweep_sql(180, 8)},
  resp AS (SELECT * FROM sweep WHERE flag_min IS NOT NULL)"""


def _sweep(x):
    return decide.flag_sweep(x.zone_point, x.site, x.member_arrival, x.member, 180, 8)


def _responses(x):
    return decide.response_list(_sweep(x))


def _flagged(x):
    return decide.flagged_zones(_sweep(x))


@query(
    "D12_response_list",
    f"""WITH {RESP} SELECT fire_id, zone_id, name, CAST(flag_min AS BIGINT) AS lead_min,
          round(p_reached, 2) AS confidence, population AS residents, CAST(rn AS INT) AS rank FROM resp""",
)
def d12_list(x):
    return _responses(x)


@query(
    "D12_response_totals",
    f"""WITH {sweep_sql(180, 8)} SELECT fire_id, COUNT(*) AS n_flagged, CAST(SUM(population) AS BIGINT) AS residents_at_risk
        FROM sweep WHERE flag_min IS NOT NULL GROUP BY fire_id""",
)
def d12_totals(x):
    return decide.response_totals(_flagged(x))


IMPACT = f"""{sweep_sql(270, 6)},
  came AS (SELECT d.zone_id, MIN(t.truth_min) - 90 AS actual_min FROM disk d
           JOIN truth t ON t.fire_id = d.fire_id AND t.i = d.i AND t.j = d.j GROUP BY d.zone_id),
  imp AS (SELECT s.*, c.actual_min, flag_min IS NOT NULL AS flagged, c.actual_min IS NOT NULL AS reached,
                 CAST(c.actual_min - flag_min AS BIGINT) AS warning_min,
                 CAST(t50 + 90 AS BIGINT) AS eta_med, CAST(t10 + 90 AS BIGINT) AS eta_lo, CAST(t90 + 90 AS BIGINT) AS eta_hi
          FROM sweep s LEFT JOIN came c ON c.zone_id = s.zone_id)"""


def _impact(x):
    return decide.impact(x.zone_point, x.site, x.member_arrival, x.member, x.truth, 360, 180)


@query(
    "D13_impact_communities",
    f"""WITH {IMPACT} SELECT fire_id, zone_id, flag_min, actual_min, warning_min, CAST(rn AS INT) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY fire_id ORDER BY warning_min DESC, zone_id) AS rn
          FROM imp WHERE warning_min IS NOT NULL) s WHERE rn <= 16""",
)
def d13(x):
    out = decide.impact_communities(_impact(x))
    return out.select("fire_id", "zone_id", "flag_min", "actual_min", "warning_min", "rank")


@query(
    "D13_impact_brief",
    f"""WITH {IMPACT} SELECT fire_id, zone_id, eta_med, eta_lo, eta_hi, reached, {r('p_reached')} AS p_reached,
               CAST(rn AS INT) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY fire_id ORDER BY eta_med NULLS LAST, zone_id) AS rn
          FROM imp WHERE flagged) s WHERE rn <= 14""",
)
def d13_brief(x):
    out = decide.impact_brief(_impact(x))
    return out.select(
        "fire_id", "zone_id", "eta_med", "eta_lo", "eta_hi", "reached",
        rounded("p_reached").alias("p_reached"), "rank",
    )


@query(
    "D13_impact_summary",
    f"""WITH {IMPACT} SELECT fire_id,
          CAST(coalesce(SUM(population) FILTER (warning_min > 0), 0) AS BIGINT) AS residents_warned,
          coalesce(round(AVG(warning_min) FILTER (warning_min > 0), 1), 0.0) AS mean_warning_min,
          coalesce(MAX(warning_min) FILTER (warning_min > 0), 0) AS max_warning_min,
          CAST(coalesce(SUM(population * warning_min) FILTER (warning_min > 0), 0) AS BIGINT) AS person_minutes,
          {METRICS} FROM imp GROUP BY fire_id""",
)
def d13_summary(x):
    return decide.impact_summary(_impact(x))


@query(
    "D14_area_flagged_ahead",
    """SELECT p.fire_id, COUNT(*) * 4000000.0::DOUBLE AS ahead_m2
       FROM prob p JOIN grid_cell c ON c.fire_id = p.fire_id AND c.i = p.i AND c.j = p.j
       JOIN truth t ON t.fire_id = p.fire_id AND t.i = p.i AND t.j = p.j
       WHERE p.arm = 'on' AND p.horizon_min = 60 AND p.p >= 0.25 AND c.fuel <> 0
         AND NOT coalesce(t.truth_min <= 90, false) GROUP BY p.fire_id""",
)
def d14(x):
    burned = x.truth.filter("truth_min <= 90")
    return decide.area_flagged_ahead(field(x).filter("horizon_min = 60"), x.grid_cell, burned, 2000.0)


# One row per event key for the report tables below: parts stand in for the events' results.
EVENT_RESULT = """
SELECT p_partkey AS event_no,
       CASE p_partkey % 6 WHEN 0 THEN 'park' WHEN 1 THEN 'palisades' WHEN 2 THEN 'eaton' WHEN 3 THEN 'davis'
            WHEN 4 THEN 'gray' ELSE concat('other', CAST(p_partkey % 7 AS STRING)) END AS key,
       CAST(p_size * 997 AS BIGINT) AS residents_at_risk, p_size % 8 AS n_flagged,
       CAST(p_partkey % 40 AS DOUBLE) / 2 AS ahead_km2,
       CAST(p_size AS DOUBLE) / 100 AS iou_on, CAST((p_size * 3) % 47 AS DOUBLE) / 100 AS iou_off,
       CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size % 11 AS DOUBLE) / 10 END AS precision,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size % 9 AS DOUBLE) / 8 END AS recall
FROM {part}"""
EVENT_SQL = "ev AS (" + EVENT_RESULT.replace("{part}", "part") + ")"


def _events(x):
    return x.spark.sql(EVENT_RESULT, part=x.part)


@query(
    "D17_order_times",
    f"""WITH {EVENT_SQL}, o AS (SELECT * FROM (VALUES
          ('park', 'Cohasset', TIMESTAMP '2024-07-25 02:00:00'),
          ('palisades', 'Pacific Palisades', TIMESTAMP '2025-01-07 18:50:00'),
          ('eaton', 'Altadena', TIMESTAMP '2025-01-08 03:00:00'),
          ('davis', 'Washoe City', TIMESTAMP '2024-09-08 01:00:00'),
          ('gray', 'Medical Lake', TIMESTAMP '2023-08-18 20:00:00')) t(key, community, order_utc))
        SELECT event_no, ev.key, community, order_utc FROM ev LEFT JOIN o ON o.key = ev.key""",
)
def d17(x):
    return decide.with_order_times(_events(x)).select("event_no", "key", "community", "order_utc")


_lo, _hi = "floor(residents_at_risk * 0.00015 + 0.5)", "floor(residents_at_risk * 0.00045 + 0.5)"


@query(
    "D18_lives_range",
    f"""WITH {EVENT_SQL} SELECT event_no, CASE WHEN {_lo} > 0
          THEN concat(CAST(CAST({_lo} AS BIGINT) AS STRING), '-', CAST(CAST({_hi} AS BIGINT) AS STRING))
          WHEN {_hi} > 0 THEN concat('up to ', CAST(CAST({_hi} AS BIGINT) AS STRING)) ELSE '<1' END AS lives FROM ev""",
)
def d18(x):
    return _events(x).select("event_no", decide.lives_range(F.col("residents_at_risk")).alias("lives"))


SKILL_ROW = """SELECT CAST(o_custkey % 97 AS BIGINT) AS fire_id, CAST(MIN(o_orderkey) AS BIGINT) AS horizon_min,
  CAST(MIN(o_orderkey) % 97 AS DOUBLE) / 100 AS iou_on, CAST(MAX(o_orderkey) % 89 AS DOUBLE) / 100 AS iou_off
  FROM {orders} GROUP BY o_custkey % 97, o_orderpriority"""


@query(
    "D19_mean_by_position",
    f"""WITH sk AS ({SKILL_ROW.replace('{orders}', 'orders')}),
        rk AS (SELECT *, row_number() OVER (PARTITION BY fire_id ORDER BY horizon_min) AS pos FROM sk)
        SELECT CAST(pos AS INT) AS pos, COUNT(*) AS n_events, CAST(floor(AVG(horizon_min)) AS BIGINT) AS horizon_min,
               {r('AVG(iou_on)')} AS iou_on, {r('AVG(iou_off)')} AS iou_off FROM rk GROUP BY pos""",
)
def d19(x):
    skill = x.spark.sql(SKILL_ROW, orders=x.orders)
    out = decide.mean_by_position(skill)
    return out.withColumns({"iou_on": rounded("iou_on"), "iou_off": rounded("iou_off")})


@query(
    "D20_event_bars",
    f"""WITH {EVENT_SQL} SELECT event_no, {r('iou_on - iou_off')} AS gain, residents_at_risk, ahead_km2,
          {r('residents_at_risk * (0.00015 + 0.00045) / 2')} AS lives_mid,
          coalesce(precision, 0.0) AS precision, coalesce(recall, 0.0) AS recall FROM ev""",
)
def d20(x):
    mid = (0.00015 + 0.00045) / 2
    return _events(x).select(
        "event_no", rounded(F.col("iou_on") - F.col("iou_off")).alias("gain"), "residents_at_risk",
        "ahead_km2", rounded(F.col("residents_at_risk") * mid).alias("lives_mid"),
        F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce("recall", F.lit(0.0)).alias("recall"),
    )


@query(
    "D21_page_totals",
    f"""WITH {EVENT_SQL} SELECT CAST(SUM(residents_at_risk) AS BIGINT) AS residents, SUM(ahead_km2) AS ahead_km2,
          {r('AVG(iou_on - iou_off)')} AS mean_gain FROM ev""",
)
def d21(x):
    return _events(x).agg(
        F.sum("residents_at_risk").alias("residents"), F.sum("ahead_km2").alias("ahead_km2"),
        rounded(F.avg(F.col("iou_on") - F.col("iou_off"))).alias("mean_gain"),
    )


@query(
    "D21_skill_pivot",
    f"""SELECT horizon_min, fire_id, {r('AVG(p.p)')} AS p FROM prob p WHERE arm = 'on' GROUP BY horizon_min, fire_id""",
)
def d21_pivot(x):
    """One row per horizon and event, so any number of events fits."""
    return field(x).groupBy("horizon_min", "fire_id").agg(rounded(F.avg("p")).alias("p"))


@query(
    "D22_positive_warnings",
    f"""WITH {IMPACT} SELECT name AS zone, fire_id, warning_min, population AS residents FROM imp WHERE warning_min > 0""",
)
def d22(x):
    rows = decide.positive_warnings(_impact(x))
    return rows.select(
        F.col("name").alias("zone"), "fire_id", "warning_min", F.col("population").alias("residents")
    ).orderBy(F.col("warning_min").desc())


@query(
    "D22_default_event",
    f"""WITH {IMPACT}, b AS (SELECT * FROM imp WHERE flagged),
        f AS (SELECT i.fire_id, COUNT(*) FILTER (i.flagged) AS n_flagged, COUNT(*) FILTER (i.reached) AS burned,
                     (SELECT COUNT(DISTINCT coalesce(eta_med, -1)) FROM b WHERE b.fire_id = i.fire_id) AS n_eta
              FROM imp i GROUP BY i.fire_id)
        SELECT (SELECT fire_id FROM f ORDER BY n_flagged DESC, fire_id LIMIT 1) AS most_flagged,
               (SELECT fire_id FROM f ORDER BY n_eta DESC, burned DESC, fire_id LIMIT 1) AS most_informative""",
)
def d22_default(x):
    rows = _impact(x)
    flags = rows.groupBy("fire_id").agg(
        F.count_if("flagged").alias("n_flagged"), F.count_if("reached").alias("burned")
    )
    etas = rows.filter("flagged").groupBy("fire_id").agg(
        F.countDistinct(F.coalesce("eta_med", F.lit(-1))).alias("n_eta")
    )
    both = flags.join(etas, "fire_id", "left").na.fill(0, ["n_eta"])
    return both.agg(
        F.max_by("fire_id", F.struct("n_flagged", -F.col("fire_id"))).alias("most_flagged"),
        F.max_by("fire_id", F.struct("n_eta", "burned", -F.col("fire_id"))).alias("most_informative"),
    )


@query(
    "D22_mean_precision_recall",
    f"WITH {EVENT_SQL} SELECT {r('AVG(precision)')} AS precision, {r('AVG(recall)')} AS recall FROM ev",
)
def d22_mean(x):
    return _events(x).agg(
        rounded(F.avg("precision")).alias("precision"), rounded(F.avg("recall")).alias("recall")
    )


@query(
    "D23_ranked_cards",
    """SELECT seq, CAST(row_number() OVER (PARTITION BY fire_id, kind ORDER BY urgency DESC, rec_id, seq) AS INT)
           AS rank, CASE WHEN urgency >= 0.66 THEN 'HIGH' WHEN urgency >= 0.33 THEN 'MODERATE' ELSE 'LOW' END AS label
       FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY valid_t DESC, seq DESC) AS rn
             FROM recommendation) c WHERE rn = 1""",
)
def d23(x):
    from hazardgrid.operators.log import state_as_of

    return decide.ranked_cards(state_as_of(x.recommendation, keys=["rec_id"])).select("seq", "rank", "label")


@query(
    "D24_target_urgency",
    """SELECT a.fire_id, a.target, u.urgency
       FROM (SELECT DISTINCT CAST(c_custkey % 5 AS INT) AS fire_id,
                    concat('zone_', CAST(c_custkey % 60 AS STRING)) AS target FROM customer) a
       LEFT JOIN (SELECT fire_id, target, arg_max(urgency, seq) AS urgency FROM recommendation
                  GROUP BY fire_id, target) u ON u.fire_id = a.fire_id AND u.target = a.target""",
)
def d24(x):
    assets = x.customer.selectExpr(
        "CAST(c_custkey % 5 AS INT) AS fire_id", "concat('zone_', c_custkey % 60) AS target"
    ).distinct()
    return decide.target_urgency(x.recommendation, assets)


@query(
    "D25_observation_mix",
    """SELECT fire_id, kind, COUNT(*) AS n,
              bool_or(bool_or(kind = 'camera_front')) OVER (PARTITION BY fire_id) AS has_camera_front
       FROM (SELECT CAST(user_id % 5 AS INT) AS fire_id, CASE WHEN event_id % 9 = 0 THEN 'unknown'
               WHEN event_type = 'purchase' THEN 'camera_front' ELSE event_type END AS kind FROM events) k
       GROUP BY fire_id, kind""",
)
def d25(x):
    obs = x.events.selectExpr(
        "CAST(user_id % 5 AS INT) AS fire_id",
        "CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_type = 'purchase' THEN 'camera_front' "
        "ELSE event_type END AS kind",
    )
    return decide.observation_mix(obs)


_mid = "CAST(floor(lead_time_min + 0.5) AS BIGINT)"


@query(
    "D26_text_formats",
    f"""SELECT seq, strftime(valid_t, '%H:%MZ') AS clock, concat(CAST(day(valid_t) AS STRING), ' ',
               strftime(valid_t, '%b %H:%MZ')) AS date_clock,
               printf('%.0f%%', confidence * 100) AS pct,
               CASE WHEN lead_time_min IS NULL THEN '-' ELSE concat(CAST({_mid} AS STRING), ' min') END AS minutes,
               CASE WHEN lead_time_min IS NULL THEN 'no ETA' WHEN seq % 3 = 0
                    THEN concat(CAST({_mid} AS STRING), CASE WHEN {_mid} < 0 THEN ' min (past)' ELSE ' min' END)
                    ELSE concat(CAST({_mid} AS STRING), CASE WHEN {_mid} < 0 THEN ' min (past)' ELSE ' min' END,
                         '  ·  80% band ', CAST({_mid} - 5 AS STRING), '-', CAST({_mid} + 9 AS STRING)) END AS lead_band,
               format('{{:,}}', seq) AS number, printf('%.2f km²', seq / 4.0) AS area,
               concat(printf('%.1f', (seq % 40) / 2.0), ' m/s · ', printf('%.0f', (seq % 40) / 2.0 * 3.6), ' km/h') AS wind,
               CASE WHEN urgency >= 0.66 THEN 'HIGH' WHEN urgency >= 0.33 THEN 'MODERATE' ELSE 'LOW' END AS label
        FROM recommendation""",
)
def d26(x):
    lead = F.col("lead_time_min")
    low = F.when(F.col("seq") % 3 != 0, lead - 5)
    ms = (F.col("seq") % 40) / 2.0
    return x.recommendation.select(
        "seq", text.clock(F.col("valid_t")).alias("clock"), text.date_clock(F.col("valid_t")).alias("date_clock"),
        text.percent(F.col("confidence")).alias("pct"), text.minutes(lead).alias("minutes"),
        text.lead_band(lead, low, lead + 9).alias("lead_band"),
        text.grouped_number(F.col("seq").cast("double")).alias("number"),
        text.area_km2(F.col("seq") / 4.0).alias("area"), text.wind(ms).alias("wind"),
        text.urgency_label(F.col("urgency")).alias("label"),
    )


@query(
    "D26_kind_labels",
    """SELECT kind, CASE kind WHEN 'goes' THEN 'GOES hotspot' WHEN 'viirs' THEN 'VIIRS hotspot'
              WHEN 'modis' THEN 'MODIS hotspot' WHEN 'camera_front' THEN 'Camera-derived front'
              WHEN 'official_perimeter' THEN 'Official perimeter' ELSE kind END AS label, COUNT(*) AS n
       FROM (SELECT kind FROM observation UNION ALL SELECT event_type FROM events) k GROUP BY kind""",
)
def d26_labels(x):
    from hazardgrid.functions.lookup import observation_label

    kinds = x.observation.select("kind").unionByName(x.events.select(F.col("event_type").alias("kind")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n")).select(
        "kind", observation_label(F.col("kind")).alias("label"), "n"
    )


@query(
    "D27_run_summary",
    """SELECT fire_id, list_sort(list(DISTINCT kind)) AS feeds, COUNT(*) AS n_observations
       FROM observation GROUP BY fire_id""",
)
def d27(x):
    return x.observation.groupBy("fire_id").agg(
        F.array_sort(F.collect_set("kind")).alias("feeds"), F.count("*").alias("n_observations")
    )
