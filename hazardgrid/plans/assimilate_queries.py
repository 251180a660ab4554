"""Reweighting by observations (P), and what follows from it: D15, D16."""

from pyspark.sql import functions as F

from hazardgrid import constants as K
from hazardgrid.functions.draws import normal_sql
from hazardgrid.functions.lookup import sigma_for_kind
from hazardgrid.operators import assimilate, ensemble, exposure
from hazardgrid.operators.common import rounded
from hazardgrid.plans.decide_queries import first_sql, p_by, zone_cells
from hazardgrid.plans.ensemble_queries import drawn_sql, field
from hazardgrid.plans.registry import query, r

CELL_M = 2000.0
REPORT = ["kind"]
ISSUES = [60, 120, 240, 360]


def points(x):
    """In-bounds cells of each report; a report is one kind of one event at one instant."""
    from hazardgrid.functions import geo
    from hazardgrid.operators.spatial import attach_site

    at = attach_site(x.report_point, x.site, ["point_id"])
    return at.filter(geo.in_bounds("i", "j", "ny", "nx")).select("fire_id", "kind", "minutes", "i", "j")


def reports(x):
    return x.report_point.select("fire_id", "kind", "minutes", "sigma_m").distinct()


REPORT_CTE = """pt AS (SELECT q.fire_id, kind, minutes, i, j FROM report_point q JOIN site s ON s.fire_id = q.fire_id
        WHERE i BETWEEN 0 AND ny - 1 AND j BETWEEN 0 AND nx - 1),
  asked AS (SELECT DISTINCT fire_id, minutes, i, j FROM pt),
  dist AS (SELECT a.fire_id, m.member_id, a.minutes, a.i, a.j, MIN(sqrt((c.i - a.i) * (c.i - a.i)
              + (c.j - a.j) * (c.j - a.j))) * 2000 AS dist_m
           FROM asked a JOIN member m ON m.fire_id = a.fire_id
           LEFT JOIN member_arrival c ON c.fire_id = a.fire_id AND c.member_id = m.member_id
                 AND c.arrival_min <= a.minutes
           GROUP BY a.fire_id, m.member_id, a.minutes, a.i, a.j)"""
MISMATCH_CTE = f"""{REPORT_CTE},
  rep AS (SELECT DISTINCT fire_id, kind, minutes, sigma_m FROM report_point),
  rms AS (SELECT pt.fire_id, kind, pt.minutes, member_id, sqrt(AVG(dist_m * dist_m)) AS rms
          FROM pt JOIN dist d ON d.fire_id = pt.fire_id AND d.minutes = pt.minutes AND d.i = pt.i AND d.j = pt.j
          GROUP BY pt.fire_id, kind, pt.minutes, member_id),
  mis AS (SELECT rep.fire_id, rep.kind, rep.minutes, m.member_id, sigma_m, coalesce(rms, 5 * sigma_m) AS d_m
          FROM rep JOIN member m ON m.fire_id = rep.fire_id
          LEFT JOIN rms ON rms.fire_id = rep.fire_id AND rms.kind = rep.kind AND rms.minutes = rep.minutes
               AND rms.member_id = m.member_id)"""
LOGLIK_CTE = f"""{MISMATCH_CTE},
  ll AS (SELECT fire_id, member_id, minutes, SUM(greatest(-0.5 * (d_m / sigma_m) * (d_m / sigma_m), ln(1e-12)))
             AS loglik FROM mis GROUP BY fire_id, member_id, minutes)"""


def mismatch(x):
    return assimilate.point_mismatch(
        points(x), reports(x), x.member_arrival, x.member, CELL_M, ["kind", "minutes"]
    )


@query(
    "P1_normalise_reports",
    """SELECT obs_id, minutes, greatest(coalesce(nullif(own_sigma_m, 0), nullif(source_sigma_m, 0),
              CASE kind WHEN 'goes' THEN 2000.0 WHEN 'viirs' THEN 375.0 WHEN 'modis' THEN 1000.0
                   WHEN 'camera_front' THEN 500.0 WHEN 'official_perimeter' THEN 120.0 ELSE 750.0 END), 250.0)
              ::DOUBLE AS sigma_m, obs_id % 6 IN (1, 2) AS is_area
       FROM (SELECT o.*, date_diff('second', date_trunc('second', g.t0), date_trunc('second', o.t)) / 60.0 AS minutes
             FROM observation o JOIN (SELECT fire_id, MIN(t) AS t0 FROM observation GROUP BY fire_id) g
               ON g.fire_id = o.fire_id) q WHERE obs_id % 6 <> 0""",
)
def p1(x):
    kinds = F.array(*[F.lit(v) for v in ("Polygon", "MultiPolygon", "Point", "MultiPoint", "LineString")])
    geometry = F.when(F.col("obs_id") % 6 > 0, F.element_at(kinds, (F.col("obs_id") % 6).cast("int")))
    obs = x.observation.withColumn("geometry_type", geometry)
    starts = x.observation.groupBy("fire_id").agg(F.min("t").alias("ignition_t"))
    return assimilate.normalise_reports(obs, starts, 250.0).select("obs_id", "minutes", "sigma_m", "is_area")


@query(
    "P2_batches",
    """SELECT obs_id, CAST(dense_rank() OVER (PARTITION BY fire_id ORDER BY t) AS INT) AS batch FROM observation""",
)
def p2(x):
    return assimilate.batches(x.observation, "t").select("obs_id", "batch")


@query(
    "P3_nearest_burned_cell",
    f"WITH {REPORT_CTE} SELECT fire_id, member_id, minutes, i, j, {r('dist_m', 4)} AS dist_m FROM dist",
)
def p3(x):
    out = assimilate.distance_to_burned(points(x), x.member_arrival, x.member, CELL_M)
    return out.withColumn("dist_m", rounded("dist_m", 4))


@query(
    "P4_point_mismatch",
    f"WITH {MISMATCH_CTE} SELECT fire_id, kind, minutes, member_id, {r('d_m', 4)} AS d_m FROM mis",
)
def p4(x):
    return mismatch(x).select("fire_id", "kind", "minutes", "member_id", rounded("d_m", 4).alias("d_m"))


AREA_CTE = """rep AS (SELECT fire_id, zone_id, CAST(40 + zone_id * 8 AS DOUBLE) AS minutes FROM zone),
  ac AS (SELECT z.fire_id, z.zone_id, rep.minutes, z.i, z.j FROM zone_cell z JOIN rep ON rep.zone_id = z.zone_id),
  und AS (SELECT zone_id, member_id, AVG(d) AS u FROM (
      SELECT ac.zone_id, m.member_id, ac.i, ac.j, MIN(sqrt((c.i - ac.i) * (c.i - ac.i) + (c.j - ac.j) * (c.j - ac.j))) * 2000 AS d
      FROM ac JOIN member m ON m.fire_id = ac.fire_id
      JOIN member_arrival c ON c.fire_id = ac.fire_id AND c.member_id = m.member_id AND c.arrival_min <= ac.minutes
      GROUP BY ac.zone_id, m.member_id, ac.i, ac.j) q GROUP BY zone_id, member_id),
  ovr AS (SELECT zone_id, member_id, AVG(d) AS o FROM (
      SELECT ac.zone_id, c.member_id, c.i, c.j, MIN(sqrt((c.i - ac.i) * (c.i - ac.i) + (c.j - ac.j) * (c.j - ac.j))) * 2000 AS d
      FROM ac JOIN member_arrival c ON c.fire_id = ac.fire_id AND c.arrival_min <= ac.minutes
      GROUP BY ac.zone_id, c.member_id, c.i, c.j) q GROUP BY zone_id, member_id)"""


@query(
    "P5_area_mismatch",
    f"""WITH {AREA_CTE} SELECT rep.zone_id, m.member_id, {r('coalesce(u + 0.4 * o, 10000.0)', 4)} AS d_m
        FROM rep JOIN member m ON m.fire_id = rep.fire_id
        LEFT JOIN und ON und.zone_id = rep.zone_id AND und.member_id = m.member_id
        LEFT JOIN ovr ON ovr.zone_id = rep.zone_id AND ovr.member_id = m.member_id""",
)
def p5(x):
    """Zone outlines as official perimeters, each seen at its own instant."""
    heads = x.zone.select(
        "fire_id", "zone_id", (F.col("zone_id") * 8 + 40).cast("double").alias("minutes"),
        F.lit(2000.0).alias("sigma_m"),
    )
    grid = x.grid_cell.select("fire_id", "i", "j")
    cells = zone_cells(x).join(grid, ["fire_id", "i", "j"], "left_semi").join(
        heads.drop("sigma_m"), ["fire_id", "zone_id"]
    )
    out = assimilate.area_mismatch(cells, heads, x.member_arrival, x.member, CELL_M, "zone_id")
    return out.select("zone_id", "member_id", rounded("d_m", 4).alias("d_m"))


def loglik(x):
    return assimilate.batch_loglik(mismatch(x))


@query(
    "P6_batch_update",
    f"""WITH {LOGLIK_CTE},
        lw AS (SELECT ll.*, ln(w.weight) + loglik AS lw FROM ll
               JOIN member w ON w.fire_id = ll.fire_id AND w.member_id = ll.member_id),
        e AS (SELECT *, exp(lw - MAX(lw) OVER (PARTITION BY fire_id, minutes)) AS e FROM lw)
        SELECT fire_id, minutes, member_id, {r('e / SUM(e) OVER (PARTITION BY fire_id, minutes)')} AS w FROM e""",
)
def p6(x):
    """Each instant's batch applied to the prior weights."""
    prior = loglik(x).join(x.member, ["fire_id", "member_id"])
    logw = prior.withColumn("logw", F.log("weight") + F.col("loglik"))
    out = assimilate.normalise_log_weights(logw, ["fire_id", "minutes"])
    return out.select("fire_id", "minutes", "member_id", rounded("w").alias("w"))


SEQ_CTE = f"""{LOGLIK_CTE},
  cw AS (SELECT ll.fire_id, ll.member_id, ll.minutes, ln(w.weight) + SUM(loglik) OVER (
             PARTITION BY ll.fire_id, ll.member_id ORDER BY ll.minutes) AS lw
         FROM ll JOIN member w ON w.fire_id = ll.fire_id AND w.member_id = ll.member_id),
  ce AS (SELECT *, exp(lw - MAX(lw) OVER (PARTITION BY fire_id, minutes)) AS e FROM cw),
  sw AS (SELECT *, e / SUM(e) OVER (PARTITION BY fire_id, minutes) AS w FROM ce)"""


@query(
    "P7_resample_trigger",
    f"""WITH {SEQ_CTE} SELECT fire_id, minutes, {r('1 / SUM(w * w)', 5)} AS ess, COUNT(*) AS n,
          1 / SUM(w * w) < COUNT(*) * 0.5 AS resample FROM sw GROUP BY fire_id, minutes""",
)
def p7(x):
    weights = assimilate.sequential_weights(x.member, loglik(x))
    out = assimilate.needs_resampling(weights, ["fire_id", "minutes"])
    return out.withColumn("ess", rounded("ess", 5))


@query(
    "P8_systematic_resample",
    """WITH c AS (SELECT fire_id, member_id, SUM(weight) OVER (PARTITION BY fire_id ORDER BY member_id)
                    / SUM(weight) OVER (PARTITION BY fire_id) AS cum, COUNT(*) OVER (PARTITION BY fire_id) AS n FROM member)
       SELECT fire_id, CAST(k AS INT) AS child, MIN(member_id) AS member_id
       FROM c, range(0, 100) p(k) WHERE k < n AND cum >= (0.37 + k) / n GROUP BY fire_id, k""",
)
def p8(x):
    weights = x.member.withColumn("w", F.col("weight"))
    return assimilate.systematic_resample(weights, 0.37)


def _jittered(name: str) -> str:
    sd, lo, hi = K.JITTER[name]
    moved = f"{name} + {normal_sql(99, 'fire_id', 'child', f"'{name}'", '0')} * {sd}"
    return r(moved if lo is None else f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, {moved}))") + f" AS {name}"


@query(
    "P9_jitter_children",
    f"""WITH c AS (SELECT fire_id, member_id, SUM(weight) OVER (PARTITION BY fire_id ORDER BY member_id)
                    / SUM(weight) OVER (PARTITION BY fire_id) AS cum, COUNT(*) OVER (PARTITION BY fire_id) AS n FROM member),
        kids AS (SELECT fire_id, CAST(k AS INT) AS child, MIN(member_id) AS member_id
                 FROM c, range(0, 100) p(k) WHERE k < n AND cum >= (0.37 + k) / n GROUP BY fire_id, k),
        drawn AS ({drawn_sql(20, 0)})
        SELECT kids.fire_id, child, kids.member_id, {', '.join(_jittered(n) for n in K.JITTER)},
               {r('1.0 / COUNT(*) OVER (PARTITION BY kids.fire_id)')} AS weight
        FROM (SELECT kids.*, drawn.* EXCLUDE (fire_id, member_id) FROM kids JOIN drawn ON drawn.fire_id = kids.fire_id AND drawn.member_id = kids.member_id) kids""",
)
def p9(x):
    """Resampled members of a drawn ensemble with perturbed parameters."""
    sites = x.site.withColumns({"ignition_lon": F.col("center_lon"), "ignition_lat": F.col("center_lat")})
    drawn = ensemble.draw_members(sites, n_members=20)
    weights = x.member.withColumn("w", F.col("weight"))
    out = assimilate.jitter(assimilate.systematic_resample(weights, 0.37), drawn)
    return out.select("fire_id", "child", "member_id", *[rounded(c).alias(c) for c in (*K.JITTER, "weight")])


@query(
    "P10_sequential_weights",
    f"WITH {SEQ_CTE} SELECT fire_id, minutes, member_id, {r('w')} AS w FROM sw",
)
def p10(x):
    out = assimilate.sequential_weights(x.member, loglik(x))
    return out.select("fire_id", "minutes", "member_id", rounded("w").alias("w"))


@query("P10_sequential_resampled")
def p10_resampled(x):
    return assimilate.assimilate_with_resampling(x.member, loglik(x))


ISSUE_CTE = f"""{LOGLIK_CTE},
  iss AS (SELECT unnest([60, 120, 240, 360]) AS issue_min),
  il AS (SELECT w.fire_id, w.member_id, issue_min, ln(w.weight) + coalesce(SUM(loglik), 0) AS lw,
                COUNT(ll.loglik) AS n_batches
         FROM member w CROSS JOIN iss LEFT JOIN ll ON ll.fire_id = w.fire_id AND ll.member_id = w.member_id
              AND ll.minutes <= issue_min GROUP BY w.fire_id, w.member_id, issue_min, w.weight),
  ie AS (SELECT *, exp(lw - MAX(lw) OVER (PARTITION BY fire_id, issue_min)) AS e FROM il),
  iw AS (SELECT fire_id, member_id, issue_min, n_batches, e / SUM(e) OVER (PARTITION BY fire_id, issue_min) AS w
         FROM ie)"""


def at_issues(x):
    return assimilate.weights_at_issues(x.member, loglik(x), ISSUES)


@query(
    "P11_issue_weights",
    f"WITH {ISSUE_CTE} SELECT fire_id, issue_min, member_id, n_batches, {r('w')} AS w FROM iw",
)
def p11(x):
    return at_issues(x).select(
        "fire_id", "issue_min", "member_id", "n_batches", rounded("weight").alias("w")
    )


@query(
    "P12_kind_sigma",
    """SELECT obs_id, CASE kind WHEN 'goes' THEN 2000.0 WHEN 'viirs' THEN 375.0 WHEN 'modis' THEN 1000.0
              WHEN 'camera_front' THEN 500.0 WHEN 'official_perimeter' THEN 120.0 ELSE 750.0 END::DOUBLE AS sigma_m
       FROM (SELECT obs_id, kind FROM observation UNION ALL SELECT event_id, event_type FROM events) q""",
)
def p12(x):
    kinds = x.observation.select("obs_id", "kind").unionByName(
        x.events.selectExpr("event_id AS obs_id", "event_type AS kind")
    )
    return kinds.select("obs_id", sigma_for_kind(F.col("kind")).alias("sigma_m"))


def issue_series(x):
    """Region area and overlap with the truth at +180 min for the weights of each issue."""
    from hazardgrid.operators.skill import issue_skill

    return issue_skill(x.member_arrival, at_issues(x), x.grid_cell, x.truth, 180, CELL_M)


@query(
    "D16_sharpening_series",
    f"""WITH {ISSUE_CTE},
        pi AS (SELECT c.fire_id, iss.issue_min, c.i, c.j, coalesce(SUM(iw.w), 0) AS p, MAX(t.truth_min) AS truth_min
               FROM grid_cell c CROSS JOIN iss
               JOIN truth t ON t.fire_id = c.fire_id AND t.i = c.i AND t.j = c.j
               LEFT JOIN member_arrival m ON m.fire_id = c.fire_id AND m.i = c.i AND m.j = c.j AND m.arrival_min <= 180
               LEFT JOIN iw ON iw.fire_id = m.fire_id AND iw.member_id = m.member_id AND iw.issue_min = iss.issue_min
               GROUP BY c.fire_id, iss.issue_min, c.i, c.j)
        SELECT fire_id, issue_min, COUNT(*) FILTER (p >= 0.1 - 1e-9) * 4.0::DOUBLE AS region90_area_km2,
               {r('COUNT(*) FILTER (p >= 0.5 - 1e-9 AND truth_min <= 180) / nullif(COUNT(*) FILTER (p >= 0.5 - 1e-9 OR truth_min <= 180), 0)')} AS iou
        FROM pi GROUP BY fire_id, issue_min""",
)
def d16(x):
    return issue_series(x).select("fire_id", "issue_min", "region90_area_km2", rounded("iou").alias("iou"))


@query(
    "D15_lead_time_comparison",
    f"""WITH {ISSUE_CTE}, {first_sql('zone_cell', 'zone_id').replace('dist AS', 'zdist AS').replace('FROM dist', 'FROM zdist')},
        conf AS (SELECT f.zone_id, iss.issue_min,
                   coalesce(SUM(iw.w) FILTER (f.arrival_min <= iss.issue_min + 120), 0) AS p_on,
                   coalesce(SUM(f.weight / f.total) FILTER (f.arrival_min <= iss.issue_min + 120), 0) AS p_off
                 FROM zdist f CROSS JOIN iss JOIN iw ON iw.fire_id = f.fire_id AND iw.member_id = f.member_id
                      AND iw.issue_min = iss.issue_min GROUP BY f.zone_id, iss.issue_min),
        flags AS (SELECT zone_id, MIN(issue_min) FILTER (p_on >= 0.5 - 1e-9) AS on_flag_min,
                         MIN(issue_min) FILTER (p_off >= 0.5 - 1e-9) AS off_flag_min FROM conf GROUP BY zone_id),
        tr AS (SELECT z.zone_id, MIN(truth_min) AS truth_arrival_min FROM zone_cell z
               JOIN truth t ON t.fire_id = z.fire_id AND t.i = z.i AND t.j = z.j GROUP BY z.zone_id)
        SELECT z.fire_id, z.zone_id, truth_arrival_min, on_flag_min, off_flag_min,
               truth_arrival_min - on_flag_min AS on_lead_min, truth_arrival_min - off_flag_min AS off_lead_min,
               off_flag_min - on_flag_min AS lead_delta_min
        FROM zone z LEFT JOIN flags f ON f.zone_id = z.zone_id LEFT JOIN tr ON tr.zone_id = z.zone_id""",
)
def d15(x):
    from hazardgrid.operators.skill import lead_time_comparison

    first = exposure.first_arrivals(zone_cells(x), x.member_arrival, x.member, "zone_id")
    return lead_time_comparison(x.zone, zone_cells(x), first, at_issues(x), x.truth, 120, ISSUES)
