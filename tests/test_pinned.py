"""Known answers on small literal tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardgrid import schema
from hazardgrid.functions.draws import hash_uniform
from hazardgrid.functions import geo, ros
from hazardgrid.operators import assimilate, calibrate, camera, decide, log, nearest, query_text, skill, spatial, spread, track
from hazardgrid.session import cut_lineage


def one(df):
    return df.first()


def test_brier_extremes(spark):
    df = spark.createDataFrame([(0, 1.0, 1), (0, 0.0, 0), (1, 0.0, 1), (1, 1.0, 0)], "k int, p double, y int")
    got = {r.k: r.b for r in df.groupBy("k").agg(calibrate.brier(F.col("p"), F.col("y")).alias("b")).collect()}
    assert got == {0: 0.0, 1: 1.0}


def test_versions_as_of(spark):
    rows = [(1, "Fire", "f", "2025-08-20 18:00:00", "active"), (2, "Fire", "f", "2025-08-20 20:00:00", "contained")]
    lg = spark.createDataFrame(rows, "seq long, kind string, obj_id string, valid_t string, status string")
    lg = lg.withColumn("valid_t", F.col("valid_t").cast("timestamp_ntz"))
    at = lambda t: [r.status for r in log.state_as_of(lg, t).collect()]
    assert at("2025-08-20 18:00:00") == ["active"]
    assert at("2025-08-20 21:00:00") == ["contained"]
    assert at("2025-08-20 17:00:00") == []


def test_observation_needs_provenance(spark):
    rows = [("Observation", '{"id":"a","fire_id":"f","kind":"goes"}'), ("Observation", '{"id":"b","fire_id":"f","kind":"goes","provenance":{"source":"s","product":"p"}}')]
    lg = spark.createDataFrame(rows, "kind string, data string")
    good, bad = schema.rehydrate(lg, "Observation")
    assert [r.id for r in good.collect()] == ["b"]
    assert [r.problem for r in bad.collect()] == ["missing provenance"]


@pytest.mark.parametrize(
    "flags,precision,recall",
    [([(True, True), (True, False), (False, True)], 0.5, 0.5), ([(False, False)], None, None), ([(True, True), (False, True)], 1.0, 0.5)],
)
def test_decision_metrics(spark, flags, precision, recall):
    df = spark.createDataFrame([(0, f, a) for f, a in flags], "fire_id int, flagged boolean, reached boolean")
    r = one(decide.decision_metrics(df))
    assert (r.precision, r.recall) == (precision, recall)


def test_rate_of_spread_bounds(spark):
    df = spark.createDataFrame([(0, 0.06, 9.0), (1, 0.06, 9.0), (1, 0.06, 3.0), (1, 0.11, 9.0)], "f int, m double, w double")
    v = [r.v for r in df.select(ros.rothermel(F.col("f"), F.col("m"), F.col("w"), F.lit(0.0))["ros_head_ms"].alias("v")).collect()]
    assert v[0] == 0.0
    assert 20 < v[1] * 60 < 200
    assert v[2] < v[1] and v[3] < v[1]


def test_two_far_pairs_are_two_clusters(spark):
    pts = [(0, -122.60, 38.50), (1, -122.61, 38.50), (2, -122.20, 38.60), (3, -122.21, 38.60)]
    df = spark.createDataFrame([(7, *p) for p in pts], "frame int, point_id long, lon double, lat double")
    got = {r.point_id: r.label for r in track.cluster_points(df, "frame").collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2}


def test_clusters_match_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 300
    lon, lat = -122 + rng.random(n) * 1.2, 38 + rng.random(n) * 1.2
    df = spark.createDataFrame(pd.DataFrame({"frame": 0, "point_id": np.arange(n), "lon": lon, "lat": lat}))
    got = {r.point_id: r.label for r in track.cluster_points(df, "frame").collect()}
    x, y = lon * 111.32 * math.cos(math.radians(lat.mean())), lat * 110.57
    label = np.arange(n)
    near = np.hypot(x[:, None] - x, y[:, None] - y) <= 4.0
    for _ in range(n):
        new = np.array([label[near[k]].min() for k in range(n)])
        if (new == label).all():
            break
        label = new
    assert [got[k] for k in range(n)] == label.tolist()


def test_nearest_distance_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    q = pd.DataFrame({"k": 0, "x": rng.integers(0, 900, 80).astype(float), "y": rng.integers(0, 900, 80).astype(float), "t": rng.integers(0, 60, 80).astype(float)}).drop_duplicates(["x", "y", "t"])
    p = pd.DataFrame({"k": 0, "x": rng.integers(0, 900, 60).astype(float), "y": rng.integers(0, 900, 60).astype(float), "a": rng.integers(5, 60, 60).astype(float)})
    out = nearest.nearest_distance(spark.createDataFrame(q), spark.createDataFrame(p), "k", query_t="t", point_t="a").toPandas()
    assert len(out) == len(q)
    for r in out.itertuples():
        live = p[p.a <= r.t]
        want = np.hypot(live.x - r.x, live.y - r.y).min() if len(live) else None
        assert (want is None and math.isnan(r.distance)) or r.distance == pytest.approx(want)


def plain_pooling(p, y):
    """Pooling of adjacent violators in plain Python: first p and mean of each block."""
    out = []
    for x in sorted(set(p)):
        at = [v for q, v in zip(p, y) if q == x]
        out.append([x, len(at), sum(at)])
        while len(out) > 1 and out[-2][2] * out[-1][1] > out[-1][2] * out[-2][1]:
            _, n, s = out.pop()
            out[-1][1] += n
            out[-1][2] += s
    return [(x, s / n) for x, n, s in out]


@pytest.mark.parametrize("ranges,open_rows", [(None, 100_000), (2, 4), (13, 1), (32, 0)])
def test_isotonic_matches_plain_pooling(spark, ranges, open_rows):
    rng = np.random.default_rng(3)
    p = rng.random(600)
    wavy = (rng.random(600) < p * 0.6 + 0.2 * np.sin(p * 9) ** 2).astype(int)
    shapes = {
        0: (p, wavy),
        1: (p, rng.permutation(wavy)),
        2: (p, (p * 5).astype(int)),  # already in order, many ties
        3: (p, 5 - (p * 5).astype(int)),  # falling: one block
        4: (np.arange(40) / 40, np.tile([1, 0], 20)),  # equal means
        5: (np.arange(40) / 40, np.tile([0, 1, 2, 0], 10)),
        6: (np.array([0.5]), np.array([1])),
    }
    pdf = pd.concat([pd.DataFrame({"k": k, "p": a, "y": b}) for k, (a, b) in shapes.items()])
    got = calibrate.isotonic_fit(spark.createDataFrame(pdf), "k", ranges=ranges, open_rows=open_rows).toPandas()
    for k, (a, b) in shapes.items():
        mine = got[got.k == k].sort_values("x")
        want = plain_pooling(a.tolist(), b.tolist())
        assert mine.x.tolist() == [x for x, _ in want], k
        assert mine.fitted.tolist() == pytest.approx([f for _, f in want])


def test_isotonic_without_rows_or_values(spark):
    rows = spark.createDataFrame([(0, None, 1), (0, 0.5, None), (1, 0.25, 1)], "k int, p double, y int")
    assert [tuple(r) for r in calibrate.isotonic_fit(rows, "k").collect()] == [(1, 0.25, 1.0)]
    assert calibrate.isotonic_fit(rows.limit(0), "k").isEmpty()


def plain_filter(prior, table, u):
    """One event's instants in order: update, and resample when too few members count."""
    n = len(prior)
    slot, w = np.arange(n), np.array(prior) / np.sum(prior)
    for t, ll in sorted(table.items()):
        lw = np.log(w) + np.array(ll)[slot]
        w = np.exp(lw - lw.max())
        w /= w.sum()
        if 1 / np.sum(w * w) < 0.5 * n:
            pick = np.minimum(np.searchsorted(np.cumsum(w), (u[t] + np.arange(n)) / n), n - 1)
            slot, w = slot[pick], np.full(n, 1 / n)
    return slot.tolist(), w


def test_resampling_filter_matches_plain_loop(spark):
    rng = np.random.default_rng(4)
    m, steps, fires = 12, 9, 4
    ll = -rng.random((fires, steps, m)) * np.array([0.1, 2, 4, 6])[:, None, None]
    prior = rng.random((fires, m)) + 0.1
    mem = [(f, k, float(prior[f, k])) for f in range(fires) for k in range(m)] + [(9, k, 1.0 + k) for k in range(3)]
    rows = [(f, k, float(t), float(ll[f, t, k])) for f in range(fires) for t in range(steps) for k in range(m)]
    mem = spark.createDataFrame(mem, "fire_id int, member_id int, weight double")
    lik = spark.createDataFrame(rows, "fire_id int, member_id int, minutes double, loglik double")
    u = {}
    for r in lik.select("fire_id", "minutes", hash_uniform(99, "fire_id", "minutes").alias("u")).distinct().collect():
        u.setdefault(r.fire_id, {})[r.minutes] = r.u
    got = assimilate.assimilate_with_resampling(mem, lik).toPandas().sort_values(["fire_id", "slot"])
    for f in range(fires):
        slot, w = plain_filter(prior[f], {float(t): ll[f, t] for t in range(steps)}, u[f])
        own = got[got.fire_id == f]
        assert own.member_id.tolist() == slot and np.allclose(own.weight, w)
    assert np.allclose(got[got.fire_id == 9].weight, np.array([1, 2, 3]) / 6)


def test_two_bearings_cross_within_100_m(spark):
    at = (-122.55, 38.52)
    cams = [(-122.70, 38.45), (-122.40, 38.40)]
    df = spark.createDataFrame([(0, lo, la, *at) for lo, la in cams], "fire_id int, lon double, lat double, tlon double, tlat double")
    df = df.withColumn("bearing_deg", geo.bearing_deg("lon", "lat", "tlon", "tlat"))
    r = one(camera.triangulate(df).withColumn("d", geo.haversine_m("lon", "lat", F.lit(at[0]), F.lit(at[1]))))
    assert r.d < 100


def test_hull_area_of_square(spark):
    pts = [(0, a / 100 - 122, b / 100 + 38) for a in range(11) for b in range(11)]
    df = spark.createDataFrame(pts, "k int, lon double, lat double").repartition(4)
    r = one(spatial.convex_hulls(df, "k").select(F.size("ring").alias("n"), (geo.polygon_area_m2("ring") / 1e6).alias("km2")))
    assert r.n == 4
    assert r.km2 == pytest.approx(11.12 * 11.12 * math.cos(math.radians(38.05)), rel=0.01)


def test_arrival_search_matches_dijkstra(spark):
    import heapq

    rng = np.random.default_rng(6)
    n, rows, cost = 6, [], {}
    for i in range(n):
        for j in range(n):
            for di, dj in spread.NEIGHBOURS:
                if 0 <= i + di < n and 0 <= j + dj < n:
                    c = float(rng.integers(1, 20))
                    rows.append((0, 0, i, j, i + di, j + dj, c))
                    cost[(i, j, i + di, j + dj)] = c
    edges = spark.createDataFrame(rows, "fire_id int, member_id int, i int, j int, ni int, nj int, minutes double")
    src = spark.createDataFrame([(0, 0, 0, 0)], "fire_id int, member_id int, i int, j int")
    got = {(r.i, r.j): r.arrival_min for r in spread.earliest_arrival(src, edges, 1e6).collect()}
    best, heap = {}, [(0.0, 0, 0)]
    while heap:
        d, i, j = heapq.heappop(heap)
        if (i, j) in best:
            continue
        best[(i, j)] = d
        for (a, b, c, e), w in cost.items():
            if (a, b) == (i, j):
                heapq.heappush(heap, (d + w, c, e))
    assert got == best


def test_leave_one_out_uses_the_others(spark):
    rows = [(f, t, max(0.0, 1 - t * (1 + f)), 10.0 - t) for f in range(3) for t in (0.05, 0.1, 0.2)]
    curve = spark.createDataFrame(rows, "fire_id int, tau double, cov double, area_km2 double")
    raw = spark.createDataFrame([(f, 0.5) for f in range(3)], "fire_id int, coverage90_raw double")
    got = {r.fire_id: r.coverage_tau_star for r in skill.leave_one_out(curve, raw).collect()}
    for f in range(3):
        means = {t: np.mean([c for g, t2, c, _ in rows if g != f and t2 == t]) for t in (0.05, 0.1, 0.2)}
        assert got[f] == min(means, key=lambda t: (round(abs(means[t] - 0.9), 12), t))


def test_rows_are_numbered_densely_with_a_hot_key(spark):
    from hazardgrid.operators.common import number_rows

    rows = [(k % 7 if k % 3 else 99, (k * 37) % 1001, k) for k in range(3000)] + [(None, 5, 9000), (None, 4, 9001)]
    df = spark.createDataFrame(rows, "g int, v int, id int")
    got = {r.id: r.rank for r in number_rows(df, [F.col("v").desc(), F.col("id")], ["g"]).collect()}
    groups = {}
    for g, v, i in rows:
        groups.setdefault(g, []).append((-v, i))
    assert got == {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g), 1)}
    assert sorted(r.rank for r in number_rows(df, [F.col("id")]).collect()) == list(range(1, len(rows) + 1))


def test_acknowledged_version_becomes_current(spark):
    held = spark.createDataFrame(
        [(1, "a", "2024-01-01", "r", None), (2, "a", "2024-01-02", "s", None), (3, "b", "2024-01-01", "t", None)],
        "seq long, rec_id string, valid_t string, rationale string, acknowledged_by string",
    ).withColumn("valid_t", F.col("valid_t").cast("timestamp_ntz"))
    said = spark.createDataFrame([("a", "kim", ""), ("b", "kim", "no road")], "rec_id string, user string, note string")
    after = log.append_versions(held, log.acknowledge(held, said), ["rec_id"])
    now = {r.rec_id: r for r in log.state_as_of(after, keys=["rec_id"]).collect()}
    assert (now["a"].seq, now["a"].rationale, now["a"].acknowledged_by) == (4, "s", "kim")
    assert now["b"].seq == 5 and now["b"].rationale.endswith("[override by kim] no road")


def test_a_source_that_breaks_while_it_is_read_counts_as_failed(spark, tmp_path):
    from hazardgrid.sources import feeds

    spark.range(5).write.parquet(str(tmp_path / "good"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "bad"))
    part = next((tmp_path / "bad").glob("part-*"))
    data = part.read_bytes()
    part.write_bytes(data[:4] + b"\xff" * (len(data) - 300) + data[len(data) - 296 :])
    read = lambda name: lambda: spark.read.schema("id long").parquet(str(tmp_path / name))
    empty = lambda: spark.createDataFrame([], "id long")
    frames, status = feeds.source_status(spark, {"good": read("good"), "bad": read("bad"), "none": read("none"), "empty": empty})
    found = {r.source: (r.available, r.n_rows, r.error is None) for r in status.collect()}
    assert found == {"good": (True, 5, True), "bad": (False, None, False), "none": (False, None, False), "empty": (True, 0, True)}
    assert frames["good"].count() == 5 and set(frames) == {"good", "empty"}


def test_nearest_point_is_carried_with_the_distance(spark):
    rng = np.random.default_rng(2)
    pts = [(0, float(x), float(y)) for x, y in rng.random((400, 2)) * 50]
    qs = [(0, float(x), float(y)) for x, y in rng.random((60, 2)) * 200 - 70]
    out = nearest.nearest_distance(
        spark.createDataFrame(qs, "k int, x double, y double"), spark.createDataFrame(pts, "k int, x double, y double"), "k", with_point=True
    )
    for r in out.collect():
        d = min(math.hypot(r.x - x, r.y - y) for _, x, y in pts)
        assert r.distance == pytest.approx(d) and math.hypot(r.x - r.px, r.y - r.py) == pytest.approx(d)


def test_burned_distance_over_many_tiles_and_instants(spark):
    rng = np.random.default_rng(7)
    rows = [(0, m, int(i), int(j), float(rng.integers(0, 300))) for m in range(3) for i, j in np.unique(rng.integers(0, 200, (60, 2)), axis=0)]
    rows = [r for r in rows if r[1] < 2] + [(0, 2, 199, 0, 250.0)]
    asked = [(0, float(t), int(i), int(j)) for t in (0, 40, 100, 260, 300) for i, j in rng.integers(0, 200, (25, 2))]
    cells = spark.createDataFrame(asked + asked[:3], "fire_id int, minutes double, i int, j int")
    arrivals = spark.createDataFrame(rows, "fire_id int, member_id int, i int, j int, arrival_min double")
    members = spark.createDataFrame([(0, m) for m in range(4)] + [(1, 0)], "fire_id int, member_id int")
    got = {(r.member_id, r.minutes, r.i, r.j): r.dist_m for r in assimilate.distance_to_burned(cells, arrivals, members, 10.0).collect()}
    want = {}
    for _, t, i, j in asked:
        for m in range(4):
            d = [math.hypot(i - a, j - b) * 10 for _, k, a, b, at in rows if k == m and at <= t]
            want[m, t, i, j] = min(d) if d else None
    assert got.keys() == want.keys()
    assert all(got[k] is None if v is None else got[k] == pytest.approx(v) for k, v in want.items())
    assert any(v is None for v in want.values())


def test_frame_without_masks_counts_as_full_agreement(spark):
    frames = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "c int, f int")
    mask = lambda rows: spark.createDataFrame(rows, "c int, f int, i int, j int")
    got = one(spatial.mean_frame_iou(mask([(0, 1, 0, 0)]), mask([(0, 1, 0, 0), (0, 1, 0, 1), (0, 2, 5, 5)]), frames, "f", "c"))
    assert (got.n_frames, got.mean_iou) == (3, pytest.approx((0.5 + 0.0 + 1.0) / 3))


def test_questions_meet_their_answers(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    recs = frame(
        [("r1", 1, "evacuate", "North", 0.9, 30.0, 0.8), ("r2", 1, "evacuate", "South", 0.95, None, 0.8), ("r3", 1, "stage", "Depot", 0.1, None, 0.5)],
        "rec_id string, fire_id int, kind string, target_name string, urgency double, lead_time_min double, confidence double",
    )
    cameras = frame([(1, k, f"c{k:02}") for k in range(12)], "fire_id int, camera_id int, name string")
    seen = frame([(1, k, "goes" if k % 3 else "viirs") for k in range(30)], "fire_id int, obs_id long, kind string")
    fires = frame([(1, "Ridge", "active")], "fire_id int, name string, status string")
    asked = frame(
        [(1, 1, " Who should EVACUATE first?"), (2, 1, "which road is at risk"), (3, 1, "cameras"), (4, 1, "satellite"), (5, 1, "status"),
         (6, 1, "hello"), (7, 2, "status"), (8, 2, None), (8, None, "crew")],
        "question_id int, fire_id int, question string",
    )
    known = query_text.answers(recs, cameras, seen, fires)
    got = {(r.question_id, r.fire_id): (r.intent, r.answer, r.cites) for r in query_text.answer_questions(asked, known).collect()}
    assert got[1, 1] == ("evacuations", "Evacuate first: South [0.95]; North [0.90, 30 min ahead]", ["r2", "r1"])
    assert got[2, 1] == ("egress", "Roads under threat: nothing flagged", [])
    assert got[3, 1] == ("cameras", "12 cameras: " + ", ".join(f"c{k:02}" for k in range(10)), [str(k) for k in range(10)])
    assert got[4, 1] == ("observations", "30 observations: goes 20, viirs 10", [str(k) for k in range(10)])
    assert got[5, 1] == ("status", "Ridge: active", ["1"])
    assert got[6, 1] == ("help", query_text.HELP, []) == got[8, 2]
    assert got[7, 2] == ("status", None, []) and got[8, None] == ("staging", None, [])


def test_skyline_seen_with_two_errors_is_recovered(spark):
    """Terrain is a smooth ring of hills, known in closed form; the observed skyline is computed from that alone."""
    ny = nx = 121
    cell, far = 250.0, 12_000.0

    def height(east, north):
        az = math.degrees(math.atan2(east, north))
        crest = 300 + 150 * math.sin(math.radians(az * 5)) + 90 * math.sin(math.radians(az * 11 + 40))
        return crest * math.exp(-(((math.hypot(east, north) - 7000) / 2000) ** 2))

    cells = [(0, i, j, height((j - 60) * cell, (i - 60) * cell)) for i in range(ny) for j in range(nx)]
    dem = spark.createDataFrame(cells, "fire_id int, i int, j int, elevation double")
    site = spark.createDataFrame([(0, -122.0, 38.0, cell, nx, ny)], "fire_id int, center_lon double, center_lat double, cell_m double, nx int, ny int")
    cams = spark.createDataFrame(
        [(k, 0, -122.0, 38.0, 50.0, 20.0 * k, 0.0, 60.0, 640, 480, 4.0) for k in range(3)],
        "camera_id int, fire_id int, lon double, lat double, elev_m double, pan_deg double, tilt_deg double, fov_deg double, "
        "image_width int, image_height int, tilt_uncertainty_deg double",
    )
    f = 320 / math.tan(math.radians(30))
    rows = []
    for k, (pan, tilt) in enumerate([(3.0, -2.25), (-4.0, 1.5)]):
        for px in range(0, 640, 20):
            az = math.radians(20.0 * k + pan + math.degrees(math.atan2(px - 320, f)))
            top = max(math.degrees(math.atan2(height(d * math.sin(az), d * math.cos(az)) - 50, d)) for d in np.arange(50, far, 50.0))
            rows.append((k, px, 240 + f * math.tan(math.radians(tilt - top))))
    rows += [(2, 0, 100.0), (2, 20, 100.0), (2, 40, None)]
    observed = spark.createDataFrame(rows, "camera_id int, px int, row double")
    profile = camera.horizon_profile(cams, dem, site, 100.0, far)
    found = camera.calibrate_pose(observed, profile, cams)
    got = {r.camera_id: r for r in found.collect()}
    assert [(got[k].pan_offset_deg, got[k].tilt_deg, got[k].n_columns) for k in range(3)] == [(3.0, -2.25, 32), (-4.0, 1.5, 32), (0.0, 0.0, 0)]
    assert got[0].rms_row_error < 6 and got[2].rms_row_error is None
    moved = {r.camera_id: (r.pan_deg, r.tilt_deg, r.tilt_uncertainty_deg) for r in camera.apply_pose(cams, found).collect()}
    assert moved == {0: (3.0, -2.25, 1.0), 1: (16.0, 1.5, 1.0), 2: (40.0, 0.0, 4.0)}


def _camera_table(spark, n=6):
    """Rough ground whose heights follow from the cell, and cameras of which two stand in one cell."""
    dem = spark.range(40 * 40).selectExpr("0 AS fire_id", "CAST(id DIV 40 AS INT) AS i", "CAST(id % 40 AS INT) AS j",
                                          "CAST((id * 37) % 91 AS DOUBLE) AS elevation")
    site = spark.createDataFrame([(0, -122.0, 38.0, 200.0, 40, 40)], "fire_id int, center_lon double, center_lat double, cell_m double, nx int, ny int")
    cams = spark.createDataFrame(
        [(c, 0, -122.0 + 0.0001 * (c % 2) + 0.01 * (c // 2), 38.0, 150.0 + c, 60.0 * c, -2.0, 50.0, 64, 48) for c in range(n)],
        "camera_id int, fire_id int, lon double, lat double, elev_m double, pan_deg double, tilt_deg double, fov_deg double, image_width int, image_height int",
    )
    return dem, site, cams


def _shuffled_rows(spark, df):
    """Rows that the exchanges of a finished query wrote."""
    seen, todo, total = set(), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "ShuffleExchangeExec" and node.id() not in seen:
            seen.add(node.id())
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return total


def test_steps_of_rays_are_never_shuffled(spark):
    """Marching 13 poses over 27 steps must not move more rows than the frames' columns, the frames and the terrain have."""
    dem, site, cams = _camera_table(spark)
    base = cut_lineage(spark.range(60 * 16).selectExpr("id DIV 16 AS frame_id", "CAST(id DIV 16 % 6 AS INT) AS camera_id", "CAST(id % 16 * 4 AS INT) AS px", "30 AS py"))
    cloud = camera.pose_cloud(base, cams, dem, site, 12, 100.0, 2600.0)
    rows = cloud.collect()
    assert len(rows) == 60 and sum(r.n_hits for r in rows) > 1000
    assert _shuffled_rows(spark, cloud) < 4 * base.count()


def test_pose_search_makes_no_row_per_pose(spark):
    dem, site, cams = _camera_table(spark)
    profile = cut_lineage(camera.horizon_profile(cams, dem, site, 100.0, 2600.0))
    f = 32 / math.tan(math.radians(25))
    seen = profile.join(cams, "camera_id").filter("slot % 8 = 0").withColumn("_b", F.col("slot") * 0.25).filter("abs(_b) < 18")
    # Columns that look just along a slot of the profile when the pan is two degrees off.
    seen = seen.withColumn("px", F.lit(32.0) + f * F.tan(F.radians(F.col("_b") - 2.0)))
    seen = cut_lineage(seen.select("camera_id", "px", camera.skyline_row(F.col("tilt_deg") + 1.5, F.col("horizon_deg")).alias("row")))
    found = camera.calibrate_pose(seen, profile, cams)
    rows = found.collect()
    assert {(r.tilt_deg, r.pan_offset_deg) for r in rows} == {(-0.5, 2.0)} and max(r.rms_row_error for r in rows) < 1e-6
    assert _shuffled_rows(spark, found) < 2 * (seen.count() + profile.count())


def test_area_mismatch_multiplies_no_cells_by_members(spark):
    rng = np.random.default_rng(4)
    burned = {(m, i, j): float(rng.integers(0, 90)) for m in range(6) for i in range(60, 72) for j in range(8) if rng.random() < 0.6}
    regions = {k: {(int(i), int(j)) for i, j in zip(rng.integers(55, 75, 30), rng.integers(0, 12, 30))} for k in range(1000)}
    regions[0] = {(i, j) for i in range(52, 78) for j in range(12)}  # whose inner cells are left out of the search
    arrivals = cut_lineage(spark.createDataFrame([(0, m, i, j, t) for (m, i, j), t in burned.items()], "fire_id int, member_id int, i int, j int, arrival_min double"))
    minutes = {k: 30.0 * (k % 3) for k in regions}
    cells = cut_lineage(spark.createDataFrame([(0, k, minutes[k], i, j) for k, r in regions.items() for i, j in r], "fire_id int, rep int, minutes double, i int, j int"))
    heads = cut_lineage(spark.createDataFrame([(0, k, minutes[k], 500.0) for k in regions], "fire_id int, rep int, minutes double, sigma_m double"))
    members = cut_lineage(spark.createDataFrame([(0, m) for m in range(6)], "fire_id int, member_id int"))
    miss = assimilate.area_mismatch(cells, heads, arrivals, members, 100.0, "rep")
    got = {(r.rep, r.member_id): r.d_m for r in miss.collect()}
    for k, region in list(regions.items())[:20]:
        for m in range(6):
            lit = [(i, j) for (q, i, j), t in burned.items() if q == m and t <= minutes[k]]
            gap = lambda a, b: np.mean([min(math.dist(p, q) for q in b) for p in a]) * 100.0
            assert got[k, m] == pytest.approx(gap(region, lit) + 0.4 * gap(lit, region) if lit else 2500.0), (k, m)
    assert _shuffled_rows(spark, miss) < cells.count() * 6


def test_edges_of_a_cell_are_summed_in_its_row(spark):
    cells = cut_lineage(spark.range(400).selectExpr("0 AS fire_id", "CAST(id DIV 20 AS INT) AS i", "CAST(id % 20 AS INT) AS j", "CAST(id % 7 * 9 AS DOUBLE) AS elevation",
        "CAST(id % 14 AS INT) AS fuel", "CAST(5 AS DOUBLE) AS wind_u", "CAST(2 AS DOUBLE) AS wind_v", "CAST(0.06 AS DOUBLE) AS moisture"))
    members = cut_lineage(spark.range(20).selectExpr("0 AS fire_id", "CAST(id AS INT) AS member_id", "CAST(1 AS DOUBLE) AS wind_mult", "CAST(id AS DOUBLE) AS wind_dir_offset_deg",
        "CAST(1 AS DOUBLE) AS moisture_mult", "CAST(1 AS DOUBLE) AS ros_mult", "CAST(3 AS DOUBLE) AS spread_cap_ms"))
    heads = spread.head_spread(cells, members, 200.0)
    totals = spread.edge_totals(heads, 200.0)
    got = {(r.member_id, r.i, r.j): (r.n_edges, r.total_min, r.least_min) for r in totals.collect()}
    assert _shuffled_rows(spark, totals) < 400 * 20
    want = spread.edge_costs(cut_lineage(heads), 200.0).groupBy("member_id", "i", "j").agg(F.count("*").alias("n"), F.sum("minutes").alias("t"), F.min("minutes").alias("l"))
    rows = want.collect()
    assert len(rows) == len(got) > 4000
    assert all(got[r.member_id, r.i, r.j] == (r.n, pytest.approx(r.t), r.l) for r in rows)


def test_search_takes_up_only_cells_within_reach(spark):
    cells = spark.range(20 * 1000).selectExpr("0 AS fire_id", "CAST(id DIV 20 AS INT) AS i", "CAST(id % 20 AS INT) AS j")
    caps = spark.createDataFrame([(0, 3.0), (0, 2.0)], "fire_id int, spread_cap_ms double")
    near = spread.within_reach(cells, cells.filter("i = 100 AND j = 10"), caps, 200.0, 60.0)
    # 3 m/s for an hour are 54 cells; one more for the gradient and one for rounding.
    assert near.agg(F.min("i"), F.max("i"), F.count("*")).first()[:] == (44, 156, 113 * 20)


def test_grown_rings_have_exact_areas(spark):
    rings = {"point": [(3.0, 4.0)], "pair": [(0.0, 0.0), (6.0, 8.0)], "square": [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0)],
             "triangle": [(0.0, 0.0), (4.0, 0.0), (0.0, 3.0)]}
    flat = {"point": (0, 0), "pair": (0, 20), "square": (25, 20), "triangle": (6, 12)}
    df = spark.createDataFrame([(k, v) for k, v in rings.items()], "k string, ring array<struct<x:double,y:double>>")
    grown = df.withColumn("g", geo.grow_ring("ring", 2.0))
    got = {r.k: r for r in grown.select("k", "g", geo.ring_area("g").alias("area")).collect()}
    disc = 32 * math.sin(math.pi / 32) * 4  # 64 chords of radius 2
    for k, (area, around) in flat.items():
        # A corner whose turn is no multiple of the chord angle has slightly shorter chords.
        assert got[k].area == pytest.approx(area + around * 2.0 + disc, rel=2e-4), k
        for p in got[k].g:
            far = min(math.hypot(p.x - a, p.y - b) for a, b in rings[k])
            assert far == pytest.approx(2.0)
    assert one(df.limit(1).select(geo.grow_ring(F.lit(None).cast("array<struct<x:double,y:double>>"), 1.0).alias("g"))).g is None


def test_camera_front_is_an_observation_that_moves_the_weights(spark):
    """Flat ground 200 m below a camera looking north: one member burned where it looks, one in the south."""
    n, cell = 81, 100.0
    dem = spark.createDataFrame([(0, i, j, 0.0) for i in range(n) for j in range(n)], "fire_id int, i int, j int, elevation double")
    site = spark.createDataFrame([(0, -122.0, 38.0, cell, n, n)], "fire_id int, center_lon double, center_lat double, cell_m double, nx int, ny int")
    cams = spark.createDataFrame(
        [(c, 0, -122.0, 38.0, 200.0, 0.0, tilt, 40.0, 64, 48, 0.5, 0.5, e) for c, tilt, e in ((0, -6.0, 100.0), (1, -6.0, 0.0), (2, 40.0, 70.0))],
        "camera_id int, fire_id int, lon double, lat double, elev_m double, pan_deg double, tilt_deg double, fov_deg double, "
        "image_width int, image_height int, pan_uncertainty_deg double, tilt_uncertainty_deg double, pose_uncertainty_m double",
    )
    base = spark.createDataFrame([(c * 10, c, px, 24) for c in range(3) for px in range(16, 49, 4)], "frame_id int, camera_id int, px int, py int")
    cloud = {r.camera_id: r for r in camera.pose_cloud(base, cams, dem, site, 40, 50.0, 6000.0).collect()}
    assert [cloud[c].n_points for c in range(3)] == [9, 9, 0] and cloud[2].region is None and cloud[2].char_m == 70.0
    ahead = cloud[0].front_points[4]
    assert ahead.px == 32 and ahead.lon == pytest.approx(-122.0) and (ahead.lat - 38.0) * 111_195 == pytest.approx(200 / math.tan(math.radians(6)), rel=2e-3)
    assert cloud[1].char_m < cloud[0].char_m < cloud[1].char_m + 400  # each frame has its own draws
    frames = spark.createDataFrame([(c * 10, "2024-01-01 01:00:00") for c in range(3)], "frame_id int, t string")
    frames = frames.withColumn("t", F.col("t").cast("timestamp_ntz"))
    fronts = camera.camera_fronts(camera.pose_cloud(base, cams, dem, site, 40, 50.0, 6000.0), frames)
    starts = spark.createDataFrame([(0, "2024-01-01 00:00:00")], "fire_id int, ignition_t string").withColumn("ignition_t", F.col("ignition_t").cast("timestamp_ntz"))
    reports = assimilate.normalise_reports(fronts, starts, cell)
    assert {(r.frame_id, r.minutes, r.geometry_type, r.is_area) for r in reports.collect()} == {(0, 60.0, "Polygon", True), (10, 60.0, "Polygon", True)}
    cells = spatial.lonlat_ring_cells(reports, site, "ring", ["fire_id", "frame_id", "minutes"])
    seen = {(r.i, r.j) for r in cells.filter("frame_id = 0").collect()}
    assert (59, 40) in seen and all(i > 45 for i, _ in seen)
    arrivals = spark.createDataFrame([(0, 0, i, j, 10.0) for i, j in seen] + [(0, 1, 80 - i, j, 10.0) for i, j in seen],
                                     "fire_id int, member_id int, i int, j int, arrival_min double")
    members = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "fire_id int, member_id int, weight double")
    miss = assimilate.area_mismatch(cells, reports.select("fire_id", "frame_id", "minutes", "sigma_m"), arrivals, members, cell, "frame_id")
    logw = assimilate.batch_loglik(miss).withColumn("logw", F.col("loglik"))
    w = {r.member_id: r.w for r in assimilate.normalise_log_weights(logw, ["fire_id", "minutes"]).collect()}
    assert w[0] > 0.9 and w[0] + w[1] == pytest.approx(1.0)


def plain_rings(cells):
    """Rings of a set of ``(i, j)`` by walking its sides with the mask on the left."""
    step = [(1, 0), (0, 1), (-1, 0), (0, -1)]
    sides = {}
    for i, j in cells:
        for h, (x, y, di, dj) in enumerate([(j, i, -1, 0), (j + 1, i, 0, 1), (j + 1, i + 1, 1, 0), (j, i + 1, 0, -1)]):
            if (i + di, j + dj) not in cells:
                sides.setdefault((x, y), set()).add(h)
    rings = []
    while any(sides.values()):
        x, y = min((p for p, hs in sides.items() if hs), key=lambda p: (p[1], p[0]))
        h, ring = min(sides[x, y]), []
        while h in sides[x, y]:
            sides[x, y].remove(h)
            ring.append((x, y, h))
            x, y = x + step[h][0], y + step[h][1]
            turn = [(h + k) % 4 for k in (1, 0, 3)]
            h = next((t for t in turn if t in sides[x, y]), None)
        rings.append([(a, b) for k, (a, b, h) in enumerate(ring) if h != ring[k - 1][2]])
    return rings


def test_mask_rings_match_a_walk(spark):
    from hazardgrid.operators import outline

    rng = np.random.default_rng(11)
    masks = {
        0: {(2, 3)},
        1: {(i, j) for i in range(6) for j in range(7)} - {(2, 2), (3, 3), (3, 4)},  # holes that touch at a corner
        2: {(0, 0), (1, 1), (2, 2), (1, 3)},
        3: {(i, j) for i in range(30) for j in range(30) if i % 2 == 0 or j == (29 if i % 4 == 1 else 0)},  # one long snake
        4: {(int(a), int(b)) for a, b in rng.integers(0, 25, (400, 2))},
    }
    rows = [(k, i, j) for k, cells in masks.items() for i, j in cells] + [(0, 2, 3)]
    df = spark.createDataFrame(rows, "fire_id int, i int, j int")
    corners = outline.mask_rings(df)
    got = corners.toPandas().sort_values(["fire_id", "ring", "pos"])
    areas = {r.fire_id: (r.a, r.n) for r in outline.ring_measures(corners).groupBy("fire_id").agg(F.sum("area_cells").alias("a"), F.count("*").alias("n")).collect()}
    for k, cells in masks.items():
        mine = [list(zip(g.x, g.y)) for _, g in got[got.fire_id == k].groupby("ring")]
        assert sorted(mine) == sorted(plain_rings(cells)), k
        assert areas[k] == (len(cells), len(mine))
    assert outline.mask_rings(df.limit(0)).isEmpty()
    site = spark.createDataFrame([(k, -122.0, 38.0, 100.0, 30, 30) for k in masks], "fire_id int, center_lon double, center_lat double, cell_m double, nx int, ny int")
    polygons = outline.ring_polygons(corners, site)
    flat = polygons.select("fire_id", "ring", (geo.polygon_area_m2("outline") / 1e4).alias("cells"))
    for r in flat.join(outline.ring_measures(corners), ["fire_id", "ring"]).collect():
        assert r.cells == pytest.approx(abs(r.area_cells), rel=1e-3)


def inside(ring, i, j):
    """Even-odd rule for a cell centre."""
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > i) != (by > i) and j < ax + (i - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def test_polygon_cells_of_parts_copies_and_odd_rings(spark):
    star = [(20 + (18 if k % 2 else 7) * math.cos(k * math.pi / 7 + 0.1), 15 + (13 if k % 2 else 5) * math.sin(k * math.pi / 7 + 0.1)) for k in range(14)]
    shapes = {
        "star": [star], "copies": [star, star], "closed": [star + star[:1]],
        "parts": [[(1.2, 1.1), (9.7, 1.4), (5.0, 8.8)], [(4.1, 0.5), (12.3, 3.3), (3.0, 12.5)], [(30.5, 20.2), (38.9, 28.0), (29.0, 33.0)]],
        "bow": [[(2.5, 2.5), (22.5, 20.5), (22.5, 2.5), (2.5, 20.5)]], "outside": [[(-9.5, -9.5), (60.0, -3.0), (50.0, 45.0)]],
        "flat": [[(1.0, 5.0), (9.0, 5.0)]], "empty": [[]], "none": [None],
    }
    rows = [(k, 40, 30, None if p is None else [(float(a), float(b)) for a, b in p]) for k, parts in shapes.items() for p in parts]
    df = spark.createDataFrame(rows, "k string, nx int, ny int, ring array<struct<x:double,y:double>>")
    got = {}
    for r in spatial.polygon_cells(df, "ring", "k").collect():
        got.setdefault(r.k, []).append((r.i, r.j))
    for k, parts in shapes.items():
        want = {(i, j) for p in parts if p for i in range(30) for j in range(40) if inside(p, i, j)}
        assert sorted(got.get(k, [])) == sorted(want), k


def test_ring_of_many_vertices_is_scanned_by_sides(spark):
    n = 100_000
    ring = [(150 + (120 + 20 * math.sin(9 * t)) * math.cos(t), 150 + (120 + 20 * math.sin(9 * t)) * math.sin(t)) for t in np.linspace(0, 2 * math.pi, n, endpoint=False)]
    df = spark.createDataFrame([(0, 300, 300, ring)], "k int, nx int, ny int, ring array<struct<x:double,y:double>>")
    cells = spatial.polygon_cells(df, "ring", "k")
    exact = math.pi * (120**2 + 20**2 / 2)
    assert cells.count() == pytest.approx(exact, rel=2e-3)


def test_landed_boxes_are_pruned(spark, tmp_path):
    import pyarrow.parquet as pq

    from hazardgrid.sources import boxes

    def draw(salt):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1_000_000)) / 1e6

    rows = spark.range(60_000).withColumns({"x": draw(1) * 40 - 130, "y": draw(2) * 20 + 30})
    wide = F.when(F.col("id") % 500 == 0, 15.0).otherwise(0.02)
    rows = rows.withColumn("x", F.when(F.col("id") % 3 == 0, -100.0).otherwise(F.col("x")))  # one hot place line
    rows = rows.withColumn("box", F.struct(F.col("x").alias("minlon"), F.col("y").alias("minlat"), (F.col("x") + wide).alias("maxlon"), (F.col("y") + wide).alias("maxlat")))
    path = str(tmp_path / "boxes")
    boxes.land_boxes(rows.select("id", "box"), path, files=48)
    box = {"minlon": -120.5, "maxlon": -120.0, "minlat": 35.0, "maxlat": 35.5}
    found = boxes.read_boxes(spark, path, box)
    b = F.col("box")
    plain = rows.filter((b["minlon"] <= -120.0) & (b["maxlon"] >= -120.5) & (b["minlat"] <= 35.5) & (b["maxlat"] >= 35.0))
    assert sorted(r.id for r in found.select("id").collect()) == sorted(r.id for r in plain.select("id").collect()) != []
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert all(c in pushed for c in boxes.EDGES)
    needed = total = 0
    for f in (tmp_path / "boxes").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            s = {meta.row_group(g).column(k).path_in_schema: meta.row_group(g).column(k).statistics for k in range(meta.num_columns)}
            total += meta.row_group(g).num_rows
            meets = s["minlon"].min <= -120.0 and s["maxlon"].max >= -120.5 and s["minlat"].min <= 35.5 and s["maxlat"].max >= 35.0
            needed += meets * meta.row_group(g).num_rows
    assert total == 60_000 and needed < 0.15 * total
    assert boxes.read_boxes(spark, path, {"minlon": 10, "maxlon": 11, "minlat": 0, "maxlat": 1}).isEmpty()


def test_files_of_a_folder_follow_its_size(spark, tmp_path):
    from hazardgrid.sources import sinks

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    held = spark.conf.get(key)
    spark.conf.set(key, "200k")
    try:
        event = F.when(F.col("id") < 100, F.col("id") % 5 + 1).otherwise(0)
        rows = spark.range(0, 200_000, 1, 8).select(event.alias("event_id"), F.lit("goes").alias("source"), F.xxhash64("id").alias("v"))
        sinks.write_snapshot(rows, str(tmp_path / "s"))
    finally:
        spark.conf.set(key, held)
    files = {k: len(list((tmp_path / "s" / f"event_id={k}").rglob("*.parquet"))) for k in range(6)}
    assert files[0] >= 4 and all(files[k] == 1 for k in range(1, 6)), files
    assert sinks.read_snapshot(spark, str(tmp_path / "s")).count() == 200_000
