"""Structured Streaming (ST): each stream drains the events file and is compared with the batch result."""

from pyspark.sql import functions as F

from hazardgrid import constants as K
from hazardgrid.operators.common import rounded
from hazardgrid.plans.registry import query, r
from hazardgrid.streaming import ordered, streams


def _events(x):
    return streams.open_feed(x.spark, x.folder, "events.parquet", x.events.schema)


def _observations(x):
    return _events(x).select(
        F.col("event_id").alias("obs_id"), (F.col("user_id") % 5).cast("int").alias("fire_id"),
        F.col("event_type").alias("kind"), streams.event_time("ts").alias("t"), "value",
    )


@query(
    "ST1_continuous_ingest",
    "SELECT event_id AS obs_id, CAST(user_id % 5 AS INT) AS fire_id, event_type AS kind, ts AS t, value FROM events",
)
def st1(x):
    rows = streams.drain_append(_observations(x), "ingest")
    return rows.withColumn("t", F.col("t").cast("timestamp_ntz"))


@query(
    "ST2_current_state",
    """SELECT kind, obj_id, seq, valid_t, value FROM (SELECT *, row_number() OVER (PARTITION BY kind, obj_id
          ORDER BY valid_t DESC, seq DESC) AS rn FROM object_version) s WHERE rn = 1""",
)
def st2(x):
    versions = _events(x).select(
        F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("obj_id"),
        (F.col("event_id") + 1).alias("seq"), F.date_trunc("hour", streams.event_time("ts")).alias("valid_t"), "value",
    )
    out = streams.drain_updates(streams.current_state(versions), ["kind", "obj_id"], "state")
    return out.withColumn("valid_t", F.col("valid_t").cast("timestamp_ntz"))


@query("ST3_without_duplicates", "SELECT event_id AS obs_id, user_id % 5 AS fire_no FROM events")
def st3(x):
    """Every observation arrives twice."""
    twice = _observations(x).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = streams.drain_append(streams.without_duplicates(twice), "dedup")
    return rows.select("obs_id", F.col("fire_id").cast("long").alias("fire_no"))


@query(
    "ST4_running_loglik",
    """SELECT CAST(user_id % 5 AS INT) AS fire_id, CAST(event_id % 20 AS INT) AS member_id,
              CAST(-SUM(event_id % 64) AS DOUBLE) / 64 AS loglik, COUNT(*) AS n_scores FROM events GROUP BY user_id % 5, event_id % 20""",
)
def st4(x):
    scores = _events(x).selectExpr(
        "CAST(user_id % 5 AS INT) AS fire_id", "CAST(event_id % 20 AS INT) AS member_id",
        "-CAST(event_id % 64 AS DOUBLE) / 64 AS loglik",
    )
    return streams.drain_updates(streams.running_loglik(scores), ["fire_id", "member_id"], "loglik")


def _ordered(x, fraction: float):
    """Hourly instants of the events' scores; the last hour waits for a later one."""
    t = F.date_trunc("hour", streams.event_time("ts"))
    scores = _events(x).select(
        (F.col("user_id") % 5).cast("int").alias("fire_id"), (F.col("event_id") % 20).cast("int").alias("member_id"), t.alias("t"),
        (F.unix_seconds(t) / 60.0).cast("double").alias("minutes"), (-(F.col("event_id") % 64) / 64.0).cast("double").alias("loglik"),
    )
    out = ordered.ordered_weights(scores, x.member, fraction=fraction)
    return streams.drain_append(out, "ordered").withColumn("weight", rounded("weight"))


@query(
    "ST4_ordered_weights",
    f"""WITH s AS (SELECT CAST(user_id % 5 AS INT) AS fire_id, CAST(event_id % 20 AS INT) AS member_id, date_trunc('hour', ts) AS t,
                     SUM(CAST(-(event_id % 64) AS DOUBLE) / 64) AS loglik FROM events GROUP BY ALL),
        i AS (SELECT DISTINCT fire_id, t FROM s WHERE t < (SELECT MAX(t) FROM s) - INTERVAL '10' MINUTE),
        c AS (SELECT i.fire_id, i.t, m.member_id, ln(m.weight) + SUM(coalesce(s.loglik, 0)) OVER (
                     PARTITION BY i.fire_id, m.member_id ORDER BY i.t) AS lw
              FROM i JOIN member m ON m.fire_id = i.fire_id
              LEFT JOIN s ON s.fire_id = i.fire_id AND s.t = i.t AND s.member_id = m.member_id),
        e AS (SELECT *, exp(lw - MAX(lw) OVER (PARTITION BY fire_id, t)) AS e FROM c)
        SELECT fire_id, CAST(epoch(t) / 60 AS DOUBLE) AS minutes, member_id,
               {r('e / SUM(e) OVER (PARTITION BY fire_id, t)')} AS weight FROM e""",
)
def st4_ordered(x):
    """Weights after each instant, never resampled, so that SQL can follow them."""
    return _ordered(x, 0.0).select("fire_id", "minutes", "member_id", "weight")


@query("ST4_ordered_resampled")
def st4_resampled(x):
    """As above with resampling; a test compares it with the batch operator."""
    return _ordered(x, K.ESS_FRACTION)


@query(
    "ST5_issued_windows",
    """SELECT CAST(user_id % 5 AS INT) AS fire_id, date_trunc('hour', ts) AS start_t, COUNT(*) AS n FROM events
       WHERE date_trunc('hour', ts) + INTERVAL '1' HOUR <= (SELECT date_trunc('millisecond', MAX(ts)) FROM events) - INTERVAL '10' MINUTE
       GROUP BY user_id % 5, date_trunc('hour', ts)""",
)
def st5(x):
    return streams.drain_append(streams.issued_counts(_observations(x)), "issued")


@query(
    "ST6_cadence_counts",
    """SELECT CAST(user_id % 5 AS INT) AS fire_id, time_bucket(INTERVAL '5' MINUTE, ts) AS start_t, COUNT(*) AS n FROM events
       GROUP BY user_id % 5, time_bucket(INTERVAL '5' MINUTE, ts)""",
)
def st6(x):
    return streams.drain_updates(streams.cadence_counts(_observations(x)), ["fire_id", "start_t"], "cadence")
