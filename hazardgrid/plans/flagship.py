"""The decision slice: as of an issue time, which zones first, how long, on what evidence?"""

from pyspark.sql import functions as F

from hazardgrid.operators import decide
from hazardgrid.operators.common import rounded
from hazardgrid.plans.assimilate_queries import ISSUE_CTE, at_issues
from hazardgrid.plans.decide_queries import at_share, first_sql, zone_cells
from hazardgrid.plans.registry import query, r

ISSUE_MIN = 120
_DIST = (
    first_sql("zone_cell", "zone_id")
    .replace("dist AS", "zdist AS")
    .replace("FROM dist", "FROM zdist")
    .replace("JOIN member w ON", "JOIN (SELECT * FROM iw WHERE issue_min = 120) w ON")
    .replace("w.weight", "w.w AS weight")
    .replace("(SELECT fire_id, SUM(weight) AS total FROM member GROUP BY fire_id)", "(SELECT fire_id, 1.0::DOUBLE AS total FROM site)")
)


@query(
    "flagship_evacuation_slice",
    f"""WITH {ISSUE_CTE}, {_DIST},
        st AS (SELECT fire_id, zone_id, {at_share(0.5)} AS t50,
                 coalesce(SUM(weight) FILTER (arrival_min <= 300), 0) AS conf FROM cumd GROUP BY fire_id, zone_id),
        ev AS (SELECT p.fire_id, COUNT(*) AS n_evidence FROM report_point p WHERE minutes <= 120 GROUP BY p.fire_id)
        SELECT st.fire_id, st.zone_id, t50 - 120 AS lead_time_min, {r('conf', 5)} AS confidence, ev.n_evidence
        FROM st JOIN ev ON ev.fire_id = st.fire_id WHERE conf >= 0.05""",
)
def flagship(x):
    """Reports up to the issue reweight the members; the weights rank the zones; the reports are the evidence."""
    weights = at_issues(x).filter(F.col("issue_min") == ISSUE_MIN).select("fire_id", "member_id", "weight")
    ranked = decide.recommend_evacuations(x.zone, zone_cells(x), x.member_arrival, weights, ISSUE_MIN, 180)
    used = x.report_point.filter(F.col("minutes") <= ISSUE_MIN).groupBy("fire_id").agg(
        F.count("*").alias("n_evidence")
    )
    return ranked.join(used, "fire_id").select(
        "fire_id", "zone_id", "lead_time_min", rounded("confidence", 5).alias("confidence"), "n_evidence"
    )
