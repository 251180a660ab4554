"""Calibration and skill (C)."""

import numpy as np
from pyspark.sql import functions as F

from hazardgrid.operators import calibrate, ensemble, skill, spatial
from hazardgrid.operators.common import rounded
from hazardgrid.plans.ensemble_queries import H, field
from hazardgrid.plans.registry import query, r

TAUS = [round(float(t), 4) for t in np.linspace(0.01, 0.6, 30)]


@query("C1_brier", f"SELECT fire_id, {r('AVG((p - y) * (p - y))')} AS brier FROM prob_outcome GROUP BY fire_id")
def c1(x):
    return x.prob_outcome.groupBy("fire_id").agg(rounded(calibrate.brier(F.col("p"), F.col("y"))).alias("brier"))


CURVE = """b AS (SELECT fire_id, CAST(least(floor(p * 10), 9) AS INT) AS bin, AVG(p) AS pm, AVG(y) AS obs, COUNT(*) AS n
  FROM prob_outcome GROUP BY fire_id, least(floor(p * 10), 9))"""


@query(
    "C2_reliability_curve",
    f"""WITH {CURVE} SELECT f.fire_id, CAST(k AS INT) AS bin, {r('pm')} AS pred_mean, {r('obs')} AS obs_freq,
          coalesce(n, 0) AS n FROM (SELECT DISTINCT fire_id FROM b) f CROSS JOIN range(0, 10) g(k)
        LEFT JOIN b ON b.fire_id = f.fire_id AND b.bin = k""",
)
def c2(x):
    out = calibrate.reliability_curve(x.prob_outcome, "fire_id")
    return out.withColumns({"pred_mean": rounded("pred_mean"), "obs_freq": rounded("obs_freq")})


@query(
    "C3_calibration_error",
    f"WITH {CURVE} SELECT fire_id, {r('SUM(n * abs(pm - obs)) / SUM(n)')} AS ece FROM b GROUP BY fire_id",
)
def c3(x):
    out = calibrate.calibration_error(calibrate.reliability_curve(x.prob_outcome, "fire_id"), "fire_id")
    return out.withColumn("ece", rounded("ece"))


@query(
    "C4_ensemble_crps",
    f"""WITH a AS (SELECT t.fire_id, t.i, t.j, t.truth_min AS y, w.weight / tw.total AS w,
                   coalesce(m.arrival_min, 480.0) AS x
            FROM truth t JOIN member w ON w.fire_id = t.fire_id
            JOIN (SELECT fire_id, SUM(weight) AS total FROM member GROUP BY fire_id) tw ON tw.fire_id = t.fire_id
            LEFT JOIN member_arrival m ON m.fire_id = t.fire_id AND m.i = t.i AND m.j = t.j AND m.member_id = w.member_id
            WHERE t.truth_min <= 240),
        t1 AS (SELECT fire_id, i, j, SUM(w * abs(x - y)) AS v FROM a GROUP BY fire_id, i, j),
        t2 AS (SELECT a.fire_id, a.i, a.j, SUM(a.w * b.w * abs(a.x - b.x)) AS v FROM a
               JOIN a b ON b.fire_id = a.fire_id AND b.i = a.i AND b.j = a.j GROUP BY a.fire_id, a.i, a.j)
        SELECT t1.fire_id, {r('AVG(t1.v - 0.5 * t2.v)', 5)} AS crps FROM t1
        JOIN t2 ON t2.fire_id = t1.fire_id AND t2.i = t1.i AND t2.j = t1.j GROUP BY t1.fire_id""",
)
def c4(x):
    out = calibrate.ensemble_crps(x.member_arrival, x.member, x.truth, 120.0)
    return out.withColumn("crps", rounded("crps", 5))


@query(
    "C5_coverage_levels",
    f"""SELECT k.fire_id, k.horizon_min, l.level, {r('cov')} AS coverage
        FROM (SELECT DISTINCT fire_id, horizon_min FROM prob WHERE arm = 'on') k
        CROSS JOIN (SELECT CAST(unnest([0.5, 0.8, 0.9]) AS DOUBLE) AS level) l
        LEFT JOIN (SELECT p.fire_id, p.horizon_min, l2.level, AVG(CASE WHEN p.p >= CAST(1.0 AS DOUBLE) - l2.level THEN 1.0 ELSE 0.0 END) AS cov
              FROM prob p JOIN truth t ON t.fire_id = p.fire_id AND t.i = p.i AND t.j = p.j AND t.truth_min <= p.horizon_min
              CROSS JOIN (SELECT CAST(unnest([0.5, 0.8, 0.9]) AS DOUBLE) AS level) l2
              WHERE p.arm = 'on' GROUP BY p.fire_id, p.horizon_min, l2.level) c
          ON c.fire_id = k.fire_id AND c.horizon_min = k.horizon_min AND c.level = l.level""",
)
def c5(x):
    out = skill.coverage_levels(field(x), x.truth, ["fire_id", "horizon_min"])
    return out.withColumn("coverage", rounded("coverage"))


_z = "ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6)))"


@query(
    "C6_temperature_scale",
    f"""SELECT fire_id, p, y, {r(_z)} AS z, {r(f'1.0 / (1.0 + exp(-({_z}) / 1.7))')} AS q FROM prob_outcome""",
)
def c6(x):
    return x.prob_outcome.select(
        "fire_id", "p", "y", rounded(calibrate.logit(F.col("p"))).alias("z"),
        rounded(calibrate.temperature_scale(F.col("p"), F.lit(1.7))).alias("q"),
    )


def _stage(src, name, grid):
    q = "least(greatest(1.0 / (1.0 + exp(-z / exp(lt))), 1e-9), 1 - 1e-9)"
    return f"""{name} AS (SELECT fire_id, arg_min(lt, (round(nll, 12), lt)) AS lt FROM (
        SELECT fire_id, lt, SUM(-(s * ln({q}) + (n - s) * ln(1 - {q}))) / SUM(n) AS nll
        FROM (SELECT c.*, {grid} AS lt FROM cnt c {src}) g WHERE abs(lt) <= 3.0 + 1e-9 GROUP BY fire_id, lt) s
        GROUP BY fire_id)"""


TEMP_CTE = f"""cnt AS (SELECT fire_id, p, {_z} AS z, COUNT(*) AS n, SUM(y) AS s FROM prob_outcome GROUP BY fire_id, p),
  {_stage('CROSS JOIN range(-30, 31) h(k)', 's1', '0.0::DOUBLE + k * 0.1::DOUBLE')},
  {_stage('JOIN s1 ON s1.fire_id = c.fire_id CROSS JOIN range(-50, 51) h(k)', 's2', 's1.lt + k * 0.002::DOUBLE')}"""


@query("C7_fit_temperature", f"WITH {TEMP_CTE} SELECT fire_id, {r('exp(lt)')} AS temperature FROM s2")
def c7(x):
    out = calibrate.fit_temperature(x.prob_outcome, "fire_id")
    return out.withColumn("temperature", rounded("temperature"))


ISO_CTE = """cnt AS (SELECT fire_id, p, COUNT(*) AS n, SUM(y) AS s FROM prob_outcome GROUP BY fire_id, p),
  run AS (SELECT *, SUM(n) OVER w AS cn, SUM(s) OVER w AS cs, row_number() OVER w AS k
          FROM cnt WINDOW w AS (PARTITION BY fire_id ORDER BY p)),
  seg AS (SELECT a.fire_id, a.k AS ka, b.k AS kb, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m
          FROM run a JOIN run b ON b.fire_id = a.fire_id AND b.k >= a.k),
  lowest AS (SELECT r.fire_id, r.k, s.ka, MIN(s.m) AS m FROM run r JOIN seg s ON s.fire_id = r.fire_id
             AND s.ka <= r.k AND s.kb >= r.k GROUP BY r.fire_id, r.k, s.ka),
  fit AS (SELECT r.fire_id, r.p, MAX(l.m) AS fitted FROM run r JOIN lowest l ON l.fire_id = r.fire_id AND l.k = r.k
          GROUP BY r.fire_id, r.p),
  knot AS (SELECT fire_id, MIN(p) AS x, AVG(fitted) AS fitted FROM fit GROUP BY fire_id, round(fitted, 10))"""


@query("C8_isotonic_fit", f"WITH {ISO_CTE} SELECT fire_id, x, {r('fitted')} AS fitted FROM knot")
def c8(x):
    out = calibrate.isotonic_fit(x.prob_outcome, "fire_id")
    return out.withColumn("fitted", rounded("fitted"))


@query(
    "C9_isotonic_apply",
    f"""WITH {ISO_CTE},
        sp AS (SELECT *, lead(x) OVER w AS x2, lead(fitted) OVER w AS f2,
                      row_number() OVER w AS k FROM knot WINDOW w AS (PARTITION BY fire_id ORDER BY x)),
        ask AS (SELECT fire_id, p + 0.003 AS p, COUNT(*) AS n FROM prob_outcome GROUP BY fire_id, p)
        SELECT a.fire_id, {r('a.p')} AS p, a.n, {r('CASE WHEN x2 IS NULL THEN fitted ELSE fitted + (f2 - fitted) / (x2 - x) * (a.p - x) END')} AS p_cal
        FROM ask a JOIN sp ON sp.fire_id = a.fire_id AND a.p >= sp.x AND (sp.x2 IS NULL OR a.p < sp.x2)""",
)
def c9(x):
    knots = calibrate.isotonic_fit(x.prob_outcome, "fire_id")
    ask = x.prob_outcome.withColumn("p", F.col("p") + 0.003)
    out = calibrate.isotonic_apply(ask, knots, "fire_id")
    return out.groupBy("fire_id", rounded("p").alias("p"), rounded("p_cal").alias("p_cal")).agg(
        F.count("*").alias("n")
    )


SKILL_CTE = """cnt AS (SELECT p.fire_id, p.arm, p.horizon_min,
    COUNT(*) FILTER (p.p >= 0.5 AND t.truth_min <= p.horizon_min) AS inter, COUNT(*) FILTER (p.p >= 0.5) AS np,
    COUNT(*) FILTER (t.truth_min <= p.horizon_min) AS nt,
    COUNT(*) FILTER (p.p >= 1.0::DOUBLE - 0.9::DOUBLE AND t.truth_min <= p.horizon_min) AS nc,
    COUNT(*) FILTER (p.p >= 0.1) AS nr,
    AVG((p.p - CASE WHEN t.truth_min <= p.horizon_min THEN 1 ELSE 0 END) * (p.p - CASE WHEN t.truth_min <= p.horizon_min THEN 1 ELSE 0 END)) AS brier
  FROM prob p JOIN truth t ON t.fire_id = p.fire_id AND t.i = p.i AND t.j = p.j GROUP BY p.fire_id, p.arm, p.horizon_min),
  sk AS (SELECT *, CASE WHEN np > 0 AND nt > 0 THEN inter / (np + nt - inter) ELSE 0.0 END AS iou,
    CASE WHEN np > 0 AND nt > 0 THEN 2.0 * inter / (np + nt) ELSE 0.0 END AS dice,
    nc / nullif(nt, 0) AS cov, nr * 4.0 AS area FROM cnt)"""


def _skill(x):
    arms = ensemble.burn_probability_arms(x.member_arrival, x.member, x.grid_cell, H)
    return skill.horizon_skill(arms, x.truth, 2000.0)


@query(
    "C10_horizon_skill",
    f"""WITH {SKILL_CTE} SELECT fire_id, arm, horizon_min, {r('iou')} AS iou, {r('dice')} AS dice, {r('brier', 9)} AS brier,
          {r('cov')} AS coverage_90, {r('area')} AS region90_area_km2 FROM sk""",
)
def c10(x):
    s = _skill(x)
    names = ["iou", "dice", "brier", "coverage_90", "region90_area_km2"]
    return s.select("fire_id", "arm", "horizon_min", *[rounded(n, 9 if n == "brier" else 6).alias(n) for n in names])


@query(
    "C11_ablation",
    f"""WITH {SKILL_CTE} SELECT a.fire_id, a.horizon_min, {r('a.iou - b.iou')} AS iou_gain, {r('a.dice - b.dice')} AS dice_gain
        FROM sk a JOIN sk b ON b.fire_id = a.fire_id AND b.horizon_min = a.horizon_min AND b.arm = 'off' WHERE a.arm = 'on'""",
)
def c11(x):
    out = skill.ablation(_skill(x))
    return out.select(
        "fire_id", "horizon_min", rounded("iou_gain").alias("iou_gain"), rounded("dice_gain").alias("dice_gain")
    )


@query(
    "C11_mean_gain",
    f"""WITH {SKILL_CTE} SELECT a.fire_id, {r('AVG(a.iou - b.iou)')} AS mean_gain FROM sk a JOIN sk b
        ON b.fire_id = a.fire_id AND b.horizon_min = a.horizon_min AND b.arm = 'off' WHERE a.arm = 'on' GROUP BY a.fire_id""",
)
def c11_mean(x):
    out = skill.ablation(_skill(x))
    return out.groupBy("fire_id").agg(rounded(F.avg("iou_gain")).alias("mean_gain"))


CURVE_CTE = f"""tau AS (SELECT CAST(unnest({TAUS}) AS DOUBLE) AS tau),
  cc AS (SELECT p.fire_id, p.horizon_min, tau, COUNT(*) FILTER (p.p >= tau) AS nr,
           COUNT(*) FILTER (p.p >= tau AND t.truth_min <= p.horizon_min) AS nh, COUNT(*) FILTER (t.truth_min <= p.horizon_min) AS ny
         FROM prob p JOIN truth t ON t.fire_id = p.fire_id AND t.i = p.i AND t.j = p.j CROSS JOIN tau
         WHERE p.arm = 'on' GROUP BY p.fire_id, p.horizon_min, tau),
  curve AS (SELECT fire_id, tau, coalesce(AVG(nh / nullif(ny, 0)), 0.0) AS cov, AVG(nr * 4.0) AS area_km2
            FROM cc GROUP BY fire_id, tau)"""


def _curve(x):
    return skill.coverage_curve(field(x), x.truth, TAUS, 2000.0)


@query(
    "C12_coverage_curve",
    f"WITH {CURVE_CTE} SELECT fire_id, tau, {r('cov')} AS cov, {r('area_km2')} AS area_km2 FROM curve",
)
def c12(x):
    return _curve(x).withColumns({"cov": rounded("cov"), "area_km2": rounded("area_km2")})


LOO_CTE = f"""{CURVE_CTE},
  sc AS (SELECT *, abs((SUM(cov) OVER (PARTITION BY tau) - cov) / (COUNT(*) OVER (PARTITION BY tau) - 1) - 0.9) AS gap FROM curve),
  pick AS (SELECT *, row_number() OVER (PARTITION BY fire_id ORDER BY round(gap, 12), tau) AS rn,
             first_value(area_km2) OVER (PARTITION BY fire_id ORDER BY abs(tau - 0.1), tau) AS area_raw FROM sc),
  raw AS (SELECT p.fire_id, AVG(CASE WHEN p.p >= 1.0::DOUBLE - 0.9::DOUBLE THEN 1.0 ELSE 0.0 END) AS raw90 FROM prob p
          JOIN truth t ON t.fire_id = p.fire_id AND t.i = p.i AND t.j = p.j AND t.truth_min <= p.horizon_min
          WHERE p.arm = 'on' AND p.horizon_min = 180 GROUP BY p.fire_id)"""


def _loo(x):
    raw = skill.coverage_levels(field(x), x.truth, ["fire_id", "horizon_min"], [0.9])
    raw = raw.filter("horizon_min = 180").select("fire_id", F.col("coverage").alias("coverage90_raw"))
    return skill.leave_one_out(_curve(x), raw)


@query(
    "C13_leave_one_out",
    f"""WITH {LOO_CTE} SELECT pick.fire_id, {r('raw90')} AS coverage90_raw, {r('tau', 4)} AS coverage_tau_star,
          {r('cov', 3)} AS coverage90_cal, {r('area_raw', 1)} AS region_area_raw_km2, {r('area_km2', 1)} AS region_area_cal_km2
        FROM pick JOIN raw ON raw.fire_id = pick.fire_id WHERE rn = 1""",
)
def c13(x):
    return _loo(x).withColumn("coverage90_raw", rounded("coverage90_raw"))


@query(
    "C14_field_agreement",
    f"""WITH e AS (SELECT fire_id, i, j, MIN(arrival_min) AS a FROM member_arrival GROUP BY fire_id, i, j)
        SELECT e.fire_id, {r('AVG(abs(a - truth_min)) FILTER (truth_min < 120)')} AS reached_mae,
               {r('coalesce(COUNT(*) FILTER (a < 120 AND truth_min < 120) / nullif(COUNT(*) FILTER (a < 120 OR truth_min < 120), 0), 1.0)')} AS mask_iou
        FROM e JOIN truth t ON t.fire_id = e.fire_id AND t.i = e.i AND t.j = e.j GROUP BY e.fire_id""",
)
def c14(x):
    first = x.member_arrival.groupBy("fire_id", "i", "j").agg(F.min("arrival_min").alias("a"))
    out = skill.mask_agreement(first, x.truth, "fire_id", "a", "truth_min", 120.0)
    return out.withColumns({"reached_mae": rounded("reached_mae"), "mask_iou": rounded("mask_iou")})


@query(
    "C14_mean_frame_iou",
    f"""WITH f AS (SELECT camera_id, frame_id, COUNT(*) FILTER (px % 3 > 0 AND py % 4 > 0) AS inter, COUNT(*) FILTER (px % 3 > 0 OR py % 4 > 0) AS total
                   FROM mask_pixel GROUP BY camera_id, frame_id)
        SELECT camera_id, COUNT(*) AS n_frames, {r('AVG(CASE WHEN total > 0 THEN inter / total ELSE 1.0 END)')} AS mean_iou FROM f GROUP BY camera_id""",
)
def c14_frames(x):
    """Two masks cut out of each frame's pixels by row and by column."""
    cells = x.mask_pixel.withColumnsRenamed({"py": "i", "px": "j"})
    out = spatial.mean_frame_iou(cells.filter("j % 3 > 0"), cells.filter("i % 4 > 0"), cells, "frame_id", "camera_id")
    return out.withColumn("mean_iou", rounded("mean_iou"))


@query(
    "C15_calibration_block",
    f"""WITH {TEMP_CTE},
        q AS (SELECT o.fire_id, o.p, o.y, 1.0 / (1.0 + exp(-({_z}) / exp(lt))) AS q FROM prob_outcome o JOIN s2 ON s2.fire_id = o.fire_id),
        e1 AS (SELECT fire_id, SUM(abs(g)) / SUM(n) AS ece FROM (SELECT fire_id, SUM(p) - SUM(y) AS g, COUNT(*) AS n FROM q
               GROUP BY fire_id, least(floor(p * 10), 9)) b GROUP BY fire_id),
        e2 AS (SELECT fire_id, SUM(abs(g)) / SUM(n) AS ece FROM (SELECT fire_id, SUM(q) - SUM(y) AS g, COUNT(*) AS n FROM q
               GROUP BY fire_id, least(floor(q * 10), 9)) b GROUP BY fire_id)
        SELECT q.fire_id, {r('exp(MAX(lt))')} AS temperature, {r('AVG((p - y) * (p - y))')} AS brier_raw,
               {r('AVG((q - y) * (q - y))')} AS brier_calibrated, {r('MAX(e1.ece)')} AS ece_raw, {r('MAX(e2.ece)')} AS ece_calibrated
        FROM q JOIN s2 ON s2.fire_id = q.fire_id JOIN e1 ON e1.fire_id = q.fire_id JOIN e2 ON e2.fire_id = q.fire_id GROUP BY q.fire_id""",
)
def c15(x):
    out = calibrate.calibration_block(x.prob_outcome, "fire_id")
    return out.select("fire_id", *[rounded(c).alias(c) for c in out.columns if c != "fire_id"])


@query(
    "C16_mean_coverage",
    f"""WITH {LOO_CTE} SELECT {r('AVG(raw90)')} AS coverage_raw, {r('AVG(round(cov, 3))')} AS coverage_cal
        FROM pick JOIN raw ON raw.fire_id = pick.fire_id WHERE rn = 1""",
)
def c16(x):
    return _loo(x).agg(
        rounded(F.avg("coverage90_raw")).alias("coverage_raw"), rounded(F.avg("coverage90_cal")).alias("coverage_cal")
    )
