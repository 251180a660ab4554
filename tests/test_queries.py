"""Registered queries against their check SQL on the smallest tables, and invariants."""

import pytest
from pyspark.sql import functions as F

import check
from hazardgrid.plans import catalogue  # noqa: F401
from hazardgrid.plans.registry import CHECK_SQL, QUERIES, Inputs
from tests.conftest import FOLDER

GROUPS = ("V2", "V3", "G10", "E4", "D3", "C2", "S1", "S4", "R2", "K3", "ST2")
NAMES = [n for n in QUERIES if n in CHECK_SQL and n.split("_")[0] in GROUPS]


@pytest.fixture(scope="module")
def con():
    return check.duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_matches_check_sql(spark, con, name):
    status, note = check.compare(spark, con, FOLDER, name)
    assert status == "ok", note


def test_every_query_has_a_key_of_the_survey():
    assert len(QUERIES) > 200
    assert all(n[0] in "VGEPCTDSRKf" for n in QUERIES)


def test_probability_grows_with_horizon_and_stays_in_range(spark):
    from hazardgrid.plans.ensemble_queries import field

    p = field(Inputs(spark, FOLDER)).groupBy("fire_id", "i", "j").pivot("horizon_min", [15, 30, 60, 180]).agg(F.max("p"))
    bad = p.filter("`15` > `30` OR `30` > `60` OR `60` > `180` OR `15` < 0 OR `180` > 1 + 1e-12")
    assert bad.isEmpty()


def test_late_rows_change_no_issued_window(spark, tmp_path):
    from hazardgrid.streaming import streams

    def land(k, rows):
        spark.createDataFrame(rows, "obs_id long, fire_id int, t string").withColumn(
            "t", F.col("t").cast("timestamp")
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    land(0, [(1, 0, "2024-01-01 00:10:00"), (2, 0, "2024-01-01 05:00:00")])
    src = streams.open_feed(spark, str(tmp_path / "in"), "*.parquet", "obs_id long, fire_id int, t timestamp", 1)
    q = streams.append_feed(streams.issued_counts(src), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    before = spark.read.parquet(str(tmp_path / "out")).collect()
    land(1, [(3, 0, "2024-01-01 00:20:00"), (4, 0, "2024-01-01 05:10:00")])
    src = streams.open_feed(spark, str(tmp_path / "in"), "*.parquet", "obs_id long, fire_id int, t timestamp", 1)
    streams.append_feed(streams.issued_counts(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    after = spark.read.parquet(str(tmp_path / "out")).filter("start_t < TIMESTAMP_NTZ '2024-01-01 01:00:00'").collect()
    assert [r.n for r in before] == [1] and [r.n for r in after] == [1]


def test_landed_csv_and_json(spark, tmp_path):
    from hazardgrid.sources import feeds

    (tmp_path / "f.csv").write_text(
        "latitude,longitude,bright_ti4,acq_date,acq_time,frp\n38.5,-122.5,300,2024-01-02,905,4.5\n"
        "38.6,-122.4,300,2024-01-02,x,1\n38.7,-122.3,300,2024-01-02,0,\n"
    )
    rows = feeds.read_active_fire_csv(spark, str(tmp_path / "f.csv"), "MODIS_NRT").orderBy("t").collect()
    assert [(str(r.t), r.frp) for r in rows] == [("2024-01-02 00:00:00", 0.0), ("2024-01-02 09:05:00", 4.5)]
    (tmp_path / "c.json").write_text('[{"id":"a","lat":38.5,"lon":-122.5},{"id":"b","lat":10,"lon":-122.5}]')
    box = {"minlon": -123, "maxlon": -122, "minlat": 38, "maxlat": 39}
    cams = feeds.read_cameras(spark, str(tmp_path / "c.json"), box).collect()
    assert [(c.id, c.name, c.fov_deg) for c in cams] == [("a", "camera", 60.0)]


def test_copies_in_different_files_are_dropped(spark, tmp_path):
    from hazardgrid.streaming import streams

    for ids in ([1, 2], [2, 1, 3]):
        rows = [(k, 0, f"2024-01-01 00:1{k}:00") for k in ids]
        spark.createDataFrame(rows, "obs_id long, fire_id int, t string").withColumn("t", F.col("t").cast("timestamp")).coalesce(
            1
        ).write.mode("append").parquet(str(tmp_path / "in"))
        src = streams.open_feed(spark, str(tmp_path / "in"), "*.parquet", "obs_id long, fire_id int, t timestamp", 1)
        once = streams.without_duplicates(src)
        streams.append_feed(once, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = [r.obs_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [1, 2, 3]


def test_update_stream_is_compacted_and_right(spark, tmp_path):
    from hazardgrid.streaming import streams

    for k in range(5):
        spark.createDataFrame([(0, m, float(k + m)) for m in range(3)], "fire_id int, member_id int, loglik double").coalesce(1).write.mode(
            "append"
        ).parquet(str(tmp_path / "in"))
    src = streams.open_feed(spark, str(tmp_path / "in"), "*.parquet", "fire_id int, member_id int, loglik double", 1)
    out = streams.drain_updates(streams.running_loglik(src), ["fire_id", "member_id"], "test", compact_every=2)
    assert {r.member_id: (r.loglik, r.n_scores) for r in out.collect()} == {m: (10.0 + 5 * m, 5) for m in range(3)}
