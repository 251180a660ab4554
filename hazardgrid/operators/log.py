"""Append-only log of object versions, and reads of it as of an instant.

A version row is ``seq, kind, obj_id, valid_t, tx_t, data``. The current version of an object is the
one with the greatest ``(valid_t, seq)``; as-of reads look at ``valid_t`` only.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardgrid.operators.asof import asof_join
from hazardgrid.operators.common import as_list, first_rows, number_rows

OBJECT = ["kind", "obj_id"]


def naive_utc(t: Column, zone: str = "UTC") -> Column:
    """A zoned instant, or a local time of ``zone``, as UTC without a zone."""
    return F.to_utc_timestamp(t, zone).cast("timestamp_ntz")


def _at(at: datetime | str | Column) -> Column:
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp_ntz")


def append_versions(log: DataFrame, batch: DataFrame, order=("tx_t", "obj_id")) -> DataFrame:
    """Log plus a batch whose ``seq`` continues the log's, rising in ``order``.

    Numbers are dense: the batch is dealt by range of ``order`` and each range adds the count of the
    ranges before it, so no single task sees it all.
    """
    top = log.agg(F.max("seq")).first()[0] or 0
    numbered = number_rows(batch.drop("seq"), [F.col(c) for c in order], name="seq")
    return log.unionByName(numbered.withColumn("seq", F.col("seq") + int(top)).select(*log.columns), allowMissingColumns=True)


def state_as_of(log: DataFrame, at=None, keys=OBJECT, tx_at=None) -> DataFrame:
    """Current version of every object as of ``at`` (NULL = latest), optionally as known at ``tx_at``."""
    if at is not None:
        log = log.filter(F.col("valid_t") <= _at(at))
    if tx_at is not None:
        log = log.filter(F.col("tx_t") <= _at(tx_at))
    return first_rows(log, keys, [F.col("valid_t").desc(), F.col("seq").desc()])


def get_objects(log: DataFrame, requests: DataFrame, at: str = "at", payload=("seq", "valid_t")):
    """For each ``(kind, obj_id, at)`` request the version current at that instant, or NULLs."""
    return asof_join(
        requests, log, OBJECT, at, "valid_t", list(payload), lambda t: F.date_trunc("day", t), ["seq"]
    )


def history(log: DataFrame, kind: str | None = None, obj_id: str | None = None) -> DataFrame:
    if kind is not None:
        log = log.filter(F.col("kind") == kind)
    if obj_id is not None:
        log = log.filter(F.col("obj_id") == obj_id)
    return log.orderBy(*OBJECT, "valid_t", "seq")


def kinds(log: DataFrame) -> DataFrame:
    return log.select("kind").distinct().orderBy("kind")


def count_versions(log: DataFrame, by_kind: bool = False) -> DataFrame:
    return (log.groupBy("kind") if by_kind else log.groupBy()).agg(F.count("*").alias("n"))


def time_bounds(log: DataFrame) -> DataFrame:
    return log.agg(F.min("valid_t").alias("first_t"), F.max("valid_t").alias("last_t"))


def version_times(log: DataFrame) -> DataFrame:
    return log.select("kind", "valid_t").distinct().orderBy("kind", "valid_t")


def first_usable_issue(observations: DataFrame, issues: DataFrame, keys="fire_id", t="t", issue_t="issued_at"):
    """Causal mask: each observation with the first issue that may use it, those with ``t <= issue_t``.

    Every later issue may use it too, so a reader filters ``issue_t <= its own issue`` and no observation
    is repeated per issue. Observations after the last issue drop out.
    """
    day = lambda c: F.date_trunc("day", c)
    out = asof_join(observations, issues, keys, t, issue_t, [issue_t], day, prefer="first")
    return out.filter(F.col(issue_t).isNotNull())


def acknowledge(log: DataFrame, decisions: DataFrame, keys=("rec_id",)) -> DataFrame:
    """Batch of new versions of the current recommendations that a person acknowledged or overrode.

    ``decisions`` holds ``keys, user, note``; a NULL or empty note is an acknowledgement, any other
    is appended to the rationale. The new version keeps its ``valid_t`` and has no ``seq`` yet:
    ``append_versions`` gives it one above all others, which makes it the current version.
    """
    keys = as_list(keys)
    current = state_as_of(log, keys=keys)
    noted = F.trim(
        F.concat(F.col("rationale"), F.lit("\n[override by "), F.col("user"), F.lit("] "), F.col("note"))
    )
    has_note = F.coalesce(F.length("note"), F.lit(0)) > 0
    return (
        current.join(decisions, keys, "inner")
        .withColumn("rationale", F.when(has_note, noted).otherwise(F.col("rationale")))
        .withColumn("acknowledged_by", F.col("user"))
        .drop("user", "note", "seq")
    )


def evidence(forecasts: DataFrame, observations: DataFrame, keys=("fire_id", "issued_at")) -> DataFrame:
    """Long table of the ids that justify each issue: its forecasts, and the observations new to it.

    An id is stored once, with the first issue that may use it; an issue rests on all observations of
    its event up to it. Every recommendation of the issue shares the same evidence.
    """
    keys = as_list(keys)
    return (
        forecasts.select(*keys, F.col("forecast_id").cast("string").alias("evidence_id"))
        .unionByName(observations.select(*keys, F.col("obs_id").cast("string").alias("evidence_id")))
        .distinct()
    )


def links(**edges: DataFrame) -> DataFrame:
    """Union of ``rel = DataFrame(src, dst)`` tables into ``link(src, rel, dst)``, each link once."""
    out = None
    for rel, df in edges.items():
        part = df.select(
            F.col("src").cast("string").alias("src"),
            F.lit(rel.rstrip("_")).alias("rel"),
            F.col("dst").cast("string").alias("dst"),
        ).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def forecasts_as_of(log: DataFrame, at=None, horizon_min: int | None = None, by_issue: bool = False):
    """Forecast versions current at ``at``.

    A forecast is valid at issue plus horizon, so at its own issue time it is not yet visible;
    ``by_issue`` reads by issue time instead.
    """
    if by_issue:
        log = log.withColumn("valid_t", F.col("issued_at"))
    out = state_as_of(log, at, keys=["obj_id"])
    return out if horizon_min is None else out.filter(F.col("horizon_min") == horizon_min)


def observation_count(observations: DataFrame, scrub_t, issued_t, t: str = "t") -> DataFrame:
    """Observations per event up to the earlier of two instants; an unknown time counts."""
    cutoff = F.least(_at(scrub_t), _at(issued_t))
    seen = F.col(t).isNull() | (F.col(t) <= cutoff)
    return observations.groupBy("fire_id").agg(F.count_if(seen).alias("n_obs"))


def active_horizon(offset_min: Column, horizons) -> Column:
    """Greatest horizon at or before an offset, else the first one."""
    hs = F.array(*[F.lit(int(h)) for h in horizons])
    return F.coalesce(
        F.array_max(F.filter(hs, lambda h: h <= offset_min + 1e-6)), F.lit(int(horizons[0]))
    )
