"""Ensemble weights updated in event-time order inside a stream, with resampling.

Scores wait in keyed state until the watermark has passed their instant, so instants are applied in order
however their rows arrive, and each once. State per event: its slots with their log weights, and
the scores that wait. A timer per instant applies it: weights are multiplied and normalised, and if too few
members are effective the slots are drawn anew by systematic resampling, with the same draws as the
batch operator (``operators.assimilate.assimilate_with_resampling``). A row whose instant has already been
applied is late and changes nothing. State lies in RocksDB and in the checkpoint, so a restarted stream goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from hazardgrid import constants as K
from hazardgrid.functions.draws import hash_uniform
from hazardgrid.session import ship_package

OUTPUT = "fire_id int, minutes double, slot int, member_id int, weight double, resampled boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def apply_instant(logw: np.ndarray, gain: np.ndarray, u: float, fraction: float) -> tuple[np.ndarray, np.ndarray | None]:
    """Normalised weights after an instant, and the slots that its children copy, if it resamples."""
    logw = logw + gain
    w = np.exp(logw - logw.max()) if np.isfinite(logw).any() else np.ones(len(logw))
    w = w / w.sum()
    n = len(w)
    if 1 / (w * w).sum() >= n * fraction:
        return w, None
    parent = np.searchsorted(np.cumsum(w), (u + np.arange(n)) / n)
    return w, np.minimum(parent, n - 1)


class OrderedWeights(StatefulProcessor):
    """One event's ensemble; see the module."""

    def __init__(self, fraction: float):
        self.fraction = fraction

    def init(self, handle) -> None:
        self.handle = handle
        self.slots = handle.getValueState("slots", "member_id array<int>, logw array<double>")
        self.waiting = handle.getMapState("waiting", "t long", "member_id array<int>, loglik array<double>, minutes double, u double")
        self.pending = handle.getValueState("pending", "t array<long>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        held = initialState.sort_values("member_id")
        with np.errstate(divide="ignore"):
            logw = np.log(held.weight.to_numpy(float))
        self.slots.update((held.member_id.tolist(), logw.tolist()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, new = timerValues.getCurrentWatermarkInMs(), set()
        for some in rows:
            for t, g in some[some.t_ms > passed].groupby("t_ms"):
                sums = g.groupby("member_id").loglik.sum()
                if self.waiting.containsKey((int(t),)):
                    members, loglik, *_ = self.waiting.getValue((int(t),))
                    sums = sums.add(pd.Series(loglik, index=members), fill_value=0.0)
                new.add(int(t))
                value = sums.index.astype(int).tolist(), sums.tolist(), float(g.minutes.iat[0]), float(g.u.iat[0])
                self.waiting.updateValue((int(t),), value)
        held = self.pending.get()[0] if self.pending.exists() else []
        for t in new.difference(held):
            self.handle.registerTimer(t)
        self.pending.update((sorted(new.union(held)),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto, held = expiredTimerInfo.getExpiryTimeInMs(), self.pending.get()[0] if self.pending.exists() else []
        due = [t for t in held if t <= upto]  # whatever the order of the timers, instants are applied in theirs
        self.pending.update((held[len(due) :],))
        for t in due:
            members, loglik, minutes, u = self.waiting.getValue((t,))
            self.waiting.removeKey((t,))
            if not self.slots.exists():
                continue
            scores = dict(zip(members, loglik))
            members, logw = (np.array(x) for x in self.slots.get())
            gain = np.array([scores.get(m, 0.0) for m in members.tolist()])
            w, parent = apply_instant(logw, gain, u, self.fraction)
            if parent is not None:
                members, w = members[parent], np.full(len(w), 1 / len(w))
            with np.errstate(divide="ignore"):
                self.slots.update((members.tolist(), np.log(w).tolist()))
            yield pd.DataFrame({
                "fire_id": np.int32(key[0]), "minutes": minutes, "slot": np.arange(len(w), dtype=np.int32),
                "member_id": members.astype(np.int32), "weight": w, "resampled": parent is not None,
            })

    def close(self) -> None:
        pass


def ordered_weights(
    scores: DataFrame, members: DataFrame, delay: str = "10 minutes", fraction: float = K.ESS_FRACTION, seed: int = 99
) -> DataFrame:
    """Slots after every instant that the watermark has passed.

    ``scores(fire_id, member_id, t, minutes, loglik)`` is a stream, ``members(fire_id, member_id, weight)`` a table.
    Rows of events without members are ignored; scores of unknown members, too.
    """
    spark = scores.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = scores.withWatermark("t", delay).select(
        "fire_id", "member_id", "t", F.unix_millis("t").alias("t_ms"), "minutes", "loglik",
        hash_uniform(seed, "fire_id", "minutes").alias("u"),
    )
    start = members.select("fire_id", "member_id", F.col("weight").cast("double").alias("weight")).groupBy("fire_id")
    return rows.groupBy("fire_id").transformWithStateInPandas(
        OrderedWeights(fraction), OUTPUT, "Append", "EventTime", initialState=start
    )
