"""Streams that are stopped, restarted and fed late rows against batch results."""

import datetime as dt
import random

from pyspark.sql import functions as F

from hazardgrid.operators import assimilate
from hazardgrid.streaming import ordered, streams

START = dt.datetime(2025, 8, 20)
SCHEMA = "fire_id int, member_id int, t timestamp, minutes double, loglik double"


def land(spark, folder, rows):
    rows = [(f, m, START + dt.timedelta(minutes=at), float(at), ll) for f, m, at, ll in rows]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_ordered_weights_equal_the_batch_operator(spark, tmp_path):
    rng = random.Random(5)
    members = spark.createDataFrame([(f, m, 1 / 12) for f in (0, 1) for m in range(12)], "fire_id int, member_id int, weight double")
    scores = [(f, m, at, -rng.random() * 4) for f in (0, 1) for at in range(10, 130, 10) for m in range(12) if rng.random() < 0.9]
    first = [s for s in scores if s[2] in (10, 30, 40)]
    rest = [s for s in scores if s not in first and s[2] != 20]
    late = [s for s in scores if s[2] == 20 and s[0] == 0]  # within the delay: applied in order all the same
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def drain():
        feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        streams.append_feed(ordered.ordered_weights(feed, members, "30 minutes"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()

    land(spark, folder, first)
    drain()
    land(spark, folder, late)
    drain()  # a restarted stream goes on from its state
    land(spark, folder, rest + [(f, 99, 400, 0.0) for f in (0, 1)])
    drain()
    land(spark, folder, [(f, m, 15, -50.0) for f in (0, 1) for m in range(6)])  # too late to count
    land(spark, folder, [(0, 0, 500, 0.0)])
    drain()
    got = spark.read.parquet(f"{out}/rows").filter("minutes < 300")
    kept = [(f, m, float(at), ll) for f, m, at, ll in first + late + rest]
    loglik = spark.createDataFrame(kept, "fire_id int, member_id int, minutes double, loglik double")
    want = {(r.fire_id, r.slot): (r.member_id, r.weight) for r in assimilate.assimilate_with_resampling(members, loglik).collect()}
    last = got.groupBy("fire_id", "slot").agg(F.max_by(F.struct("member_id", "weight"), "minutes").alias("x"), F.count("*").alias("n"))
    have = {(r.fire_id, r.slot): (r.x.member_id, r.x.weight) for r in last.collect()}
    assert have.keys() == want.keys()
    assert all(have[k][0] == want[k][0] and abs(have[k][1] - want[k][1]) < 1e-9 for k in want)
    assert got.filter("resampled").count() > 0
    assert {r.n for r in last.collect() if r.fire_id == 0} == {12} and {r.n for r in last.collect() if r.fire_id == 1} == {11}


def test_update_stream_goes_on_after_a_restart(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(k % 3, k % 7, k, -float(k)) for k in range(60)]
    for at in range(0, 60, 10):
        land(spark, folder, rows[at : at + 10])
        feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        out = streams.drain_updates(streams.running_loglik(feed), ["fire_id", "member_id"], "x", compact_every=3, path=path)
    want = {}
    for f, m, _, ll in rows:
        want[f, m] = want.get((f, m), 0.0) + ll
    assert {(r.fire_id, r.member_id): r.loglik for r in out.collect()} == want
