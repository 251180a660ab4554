"""Input views derived from the test tables.

Each view is one SQL text that Spark and DuckDB both accept; ``{name}`` refers to a table or to
another view. Spark runs it through ``fixture``; the value checks splice it in as a CTE. Parts form
five events (``fire_id`` = key modulo 5) on grids 20 cells wide whose height grows with the data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}

VIEWS["site"] = """
SELECT fire_id, CAST(-122.6 AS DOUBLE) + CAST(0.02 AS DOUBLE) * fire_id AS center_lon,
       CAST(38.5 AS DOUBLE) AS center_lat, CAST(2000 AS DOUBLE) AS cell_m, 20 AS nx,
       CAST(MAX(i) + 1 AS INT) AS ny
FROM (SELECT CAST(p_partkey % 5 AS INT) AS fire_id, floor(p_partkey / 100) AS i FROM {part}) s
GROUP BY fire_id"""

VIEWS["grid_cell"] = """
SELECT CAST(p_partkey % 5 AS INT) AS fire_id, CAST(floor(p_partkey / 100) AS INT) AS i,
       CAST(floor(p_partkey / 5) % 20 AS INT) AS j, p_partkey AS cell_id,
       p_retailprice + p_size * CAST(8 AS DOUBLE) AS elevation, CAST(p_size % 14 AS INT) AS fuel,
       CAST(5 + p_partkey % 6 AS DOUBLE) AS wind_u, CAST(2 + p_partkey % 3 AS DOUBLE) AS wind_v,
       CAST(0.04 AS DOUBLE) + (p_partkey % 10) * CAST(0.01 AS DOUBLE) AS moisture
FROM {part}"""

# Arrivals grow with the distance from the ignition cell (3, 10).
VIEWS["member_arrival"] = """
SELECT fire_id, member_id, i, j, MIN(q * 6) + MAX(abs(i - 3) + abs(j - 10)) * 8 AS arrival_min
FROM (SELECT CAST(l_partkey % 5 AS INT) AS fire_id, CAST(l_suppkey % 20 AS INT) AS member_id,
             CAST(floor(l_partkey / 100) AS INT) AS i, CAST(floor(l_partkey / 5) % 20 AS INT) AS j,
             l_quantity AS q FROM {lineitem}) l
GROUP BY fire_id, member_id, i, j"""

VIEWS["member"] = """
SELECT DISTINCT CAST(l_partkey % 5 AS INT) AS fire_id, CAST(l_suppkey % 20 AS INT) AS member_id,
       CAST(1 + (l_suppkey % 20) % 4 AS DOUBLE) AS weight
FROM {lineitem}"""

VIEWS["truth"] = """
SELECT fire_id, i, j, CASE WHEN size % 11 = 0 THEN NULL
       ELSE CAST(size * 4 + (abs(i - 3) + abs(j - 10)) * 16 AS DOUBLE) END AS truth_min
FROM (SELECT CAST(p_partkey % 5 AS INT) AS fire_id, CAST(floor(p_partkey / 100) AS INT) AS i,
             CAST(floor(p_partkey / 5) % 20 AS INT) AS j, p_size AS size FROM {part}) t"""

VIEWS["observation"] = """
SELECT event_id AS obs_id, CAST(user_id % 5 AS INT) AS fire_id,
       CASE event_type WHEN 'error' THEN 'goes' WHEN 'view' THEN 'viirs' WHEN 'click' THEN 'modis'
            WHEN 'purchase' THEN 'camera_front' ELSE 'official_perimeter' END AS kind,
       ts AS t,
       CAST(-122.8 AS DOUBLE) + (user_id % 40) * CAST(0.01 AS DOUBLE)
           + (event_id % 5) * CAST(0.001 AS DOUBLE) AS lon,
       CAST(38.3 AS DOUBLE) + (user_id % 37) * CAST(0.01 AS DOUBLE)
           + (event_id % 7) * CAST(0.001 AS DOUBLE) AS lat,
       value AS frp,
       CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN CAST(0 AS DOUBLE)
            ELSE CAST(100 + (event_id % 40) * 50 AS DOUBLE) END AS own_sigma_m,
       CASE WHEN event_id % 4 = 0 THEN CAST(300 + event_id % 9 AS DOUBLE) END AS source_sigma_m,
       props
FROM {events}"""

# One row per point of a report that holds many points; reports fall on 37 instants.
VIEWS["report_point"] = """
SELECT event_id AS point_id, CAST(user_id % 5 AS INT) AS fire_id, event_type AS kind,
       CAST((event_id * 7) % 37 * 10 AS DOUBLE) AS minutes,
       CAST(user_id % 22 - 1 AS INT) AS i, CAST((event_id * 3 + user_id) % 22 - 1 AS INT) AS j,
       CAST(4000 AS DOUBLE) AS sigma_m
FROM {events}"""

# Detections of 37 frames per event, about three kilometres apart.
VIEWS["hotspot"] = """
SELECT event_id AS point_id, CAST(user_id % 5 AS INT) AS fire_id, CAST((event_id * 7) % 37 * 10 AS DOUBLE) AS t_min,
       CAST(-122.9 AS DOUBLE) + (user_id * 17 % 40) * CAST(0.03 AS DOUBLE) + (event_id % 3) * CAST(0.004 AS DOUBLE) AS lon,
       CAST(38.2 AS DOUBLE) + (event_id * 13 % 37) * CAST(0.03 AS DOUBLE) AS lat
FROM {events}"""

VIEWS["object_version"] = """
SELECT event_id + 1 AS seq, event_type AS kind, CAST(user_id AS STRING) AS obj_id,
       date_trunc('hour', ts) AS valid_t, ts AS tx_t, props AS data, value
FROM {events}"""

VIEWS["recommendation"] = """
SELECT o_orderkey + 1 AS seq, CAST(o_custkey % 5 AS INT) AS fire_id,
       CAST(o_custkey AS STRING) AS rec_id, o_orderdate AS valid_t,
       CASE o_custkey % 3 WHEN 0 THEN 'evacuate' WHEN 1 THEN 'close_road' ELSE 'stage' END AS kind,
       concat('zone_', CAST(o_custkey % 50 AS STRING)) AS target,
       concat('Area ', CAST(o_custkey % 50 AS STRING)) AS target_name,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST((o_orderkey * 7) % 150 - 10 AS DOUBLE) END
           AS lead_time_min,
       CAST((o_orderkey * 7) % 101 AS DOUBLE) / 100 AS confidence,
       CAST((o_orderkey * 13) % 1000 + 0.2 AS DOUBLE) / 1000 AS urgency,
       concat('reason ', o_orderpriority) AS rationale
FROM {orders}"""

VIEWS["forecast_version"] = """
SELECT seq, fire_id, obj_id, issued_at, horizon_min,
       CASE horizon_min WHEN 15 THEN issued_at + INTERVAL '15' MINUTE
            WHEN 30 THEN issued_at + INTERVAL '30' MINUTE
            WHEN 60 THEN issued_at + INTERVAL '60' MINUTE
            ELSE issued_at + INTERVAL '180' MINUTE END AS valid_t
FROM (SELECT o_orderkey + 1 AS seq, CAST(o_custkey % 5 AS INT) AS fire_id,
             CAST(o_custkey AS STRING) AS obj_id, o_orderdate AS issued_at,
             CASE o_custkey % 4 WHEN 0 THEN 15 WHEN 1 THEN 30 WHEN 2 THEN 60 ELSE 180 END
                 AS horizon_min
      FROM {orders}) f"""

VIEWS["zone"] = """
SELECT n.n_nationkey AS zone_id, n.n_nationkey % 5 AS fire_id, n.n_name AS name,
       CAST((n.n_nationkey * 3) % 10 AS DOUBLE) AS ci, CAST((n.n_nationkey * 11) % 20 AS DOUBLE) AS cj,
       CAST(3.3 AS DOUBLE) AS half, CAST(coalesce(c.n, 0) * 100 AS BIGINT) AS population
FROM {nation} n
LEFT JOIN (SELECT c_nationkey, COUNT(*) AS n FROM {customer} GROUP BY c_nationkey) c
       ON c.c_nationkey = n.n_nationkey"""

# A zone's centre as a point on the ground, for the disks around it.
VIEWS["zone_point"] = """
SELECT zone_id, fire_id, name, population,
       CAST(-122.78 AS DOUBLE) + ((zone_id * 7) % 36) * CAST(0.01 AS DOUBLE) AS lon,
       CAST(38.33 AS DOUBLE) + ((zone_id * 5) % 31) * CAST(0.01 AS DOUBLE) AS lat
FROM {zone}"""

VIEWS["road"] = """
SELECT s_suppkey AS road_id, CAST(s_suppkey % 5 AS INT) AS fire_id,
       CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END AS name,
       CAST(s_suppkey % 9 AS DOUBLE) AS i0, CAST((s_suppkey * 7) % 20 AS DOUBLE) AS j0,
       CAST((s_suppkey * 3 + 1) % 11 AS DOUBLE) AS i1, CAST((s_suppkey * 13 + 3) % 20 AS DOUBLE) AS j1
FROM {supplier}"""

VIEWS["structure"] = """
SELECT c_custkey AS structure_id, CAST(c_custkey % 5 AS INT) AS fire_id, c_mktsegment AS type,
       CAST(-122.8 AS DOUBLE) + (c_custkey % 40) * CAST(0.01 AS DOUBLE) AS lon,
       CAST(38.3 AS DOUBLE) + (c_custkey % 37) * CAST(0.01 AS DOUBLE) AS lat
FROM {customer}"""

VIEWS["camera"] = """
SELECT s_suppkey AS camera_id, CAST(s_suppkey % 5 AS INT) AS fire_id, s_name AS name,
       CAST(-122.75 AS DOUBLE) + (s_suppkey % 20) * CAST(0.015 AS DOUBLE) AS lon,
       CAST(38.36 AS DOUBLE) + (s_suppkey % 17) * CAST(0.015 AS DOUBLE) AS lat,
       CAST(1500 + s_suppkey % 7 * 60 AS DOUBLE) AS elev_m,
       CAST((s_suppkey * 37) % 360 AS DOUBLE) AS pan_deg,
       CAST(s_suppkey % 7 - 3 AS DOUBLE) AS tilt_deg, CAST(50 AS DOUBLE) AS fov_deg,
       64 AS image_width, 48 AS image_height
FROM {supplier}"""

VIEWS["mask_pixel"] = """
SELECT DISTINCT user_id AS frame_id, user_id % 10 AS camera_id,
       CAST(event_id % 64 AS INT) AS px, CAST(floor(event_id / 64) % 48 AS INT) AS py
FROM {events}"""

VIEWS["prob_outcome"] = """
SELECT CAST(l_partkey % 5 AS INT) AS fire_id, (l_quantity - CAST(0.5 AS DOUBLE)) / 50 AS p,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y
FROM {lineitem}"""

# Weighted share of members that reached a cell by each horizon, both arms of the comparison.
VIEWS["prob"] = """
SELECT c.fire_id, a.arm, h.horizon_min, c.i, c.j,
       coalesce(SUM(CASE WHEN m.arrival_min <= h.horizon_min
                         THEN CASE WHEN a.arm = 'on' THEN w.weight ELSE 1 END END), 0)
           / MAX(CASE WHEN a.arm = 'on' THEN t.total ELSE t.n END) AS p
FROM {grid_cell} c
JOIN (SELECT 'on' AS arm UNION ALL SELECT 'off') a ON 1 = 1
JOIN (SELECT 15 AS horizon_min UNION ALL SELECT 30 UNION ALL SELECT 60 UNION ALL SELECT 180) h
  ON 1 = 1
JOIN (SELECT fire_id, SUM(weight) AS total, COUNT(*) AS n FROM {member} GROUP BY fire_id) t
  ON t.fire_id = c.fire_id
LEFT JOIN {member_arrival} m ON m.fire_id = c.fire_id AND m.i = c.i AND m.j = c.j
LEFT JOIN {member} w ON w.fire_id = m.fire_id AND w.member_id = m.member_id
GROUP BY c.fire_id, a.arm, h.horizon_min, c.i, c.j"""

# Cells whose centre lies in a zone's diamond, and cells within one cell of a road.
VIEWS["zone_cell"] = """
SELECT z.zone_id, z.fire_id, c.i, c.j
FROM {zone} z JOIN {grid_cell} c ON c.fire_id = z.fire_id
WHERE abs(c.i - z.ci) + abs(c.j - z.cj) <= z.half"""


def _refs(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def _plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _zoneless(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, the type the tables use."""
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    for name in zoned:
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


def fixture(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view (or table) as a DataFrame."""
    if name in TABLES:
        return table(spark, folder, name)
    sql = VIEWS[name]
    inputs = {ref: fixture(spark, folder, ref) for ref in _refs(sql)}
    return _zoneless(spark.sql(sql, **inputs))


def with_views(sql: str) -> str:
    """Check SQL with the views it names put in front as CTEs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name not in VIEWS:
            return
        for ref in _refs(VIEWS[name]):
            visit(ref)
        order.append(name)

    for word in re.findall(r"\b[a-z_]+\b", sql):
        visit(word)
    ctes = [f"{name} AS ({_plain(VIEWS[name])})" for name in order]
    body = sql.strip()
    if not ctes:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return head + ",\n".join(ctes) + ",\n" + body[len(head) :]
    return "WITH " + ",\n".join(ctes) + "\n" + body
