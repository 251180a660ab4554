"""Versioned-log reads (V)."""

from pyspark.sql import functions as F

from hazardgrid import schema
from hazardgrid.operators import log, query_text
from hazardgrid.operators.common import rounded
from hazardgrid.plans.registry import query, r

AT = "2024-01-16 00:00:00"


@query(
    "V1_append_versions",
    """WITH v AS (SELECT event_id + 1 AS seq, event_type AS kind, CAST(user_id AS STRING) AS obj_id, ts AS tx_t FROM events)
       SELECT kind, obj_id, tx_t, false AS appended, seq FROM v WHERE seq % 2 = 1
       UNION ALL SELECT kind, obj_id, tx_t, true, (SELECT MAX(seq) FROM v WHERE seq % 2 = 1) + row_number() OVER (ORDER BY tx_t, obj_id, kind)
       FROM v WHERE seq % 2 = 0""",
)
def v1(x):
    """Half of the versions are the log, the other half arrive as one batch."""
    src = x.object_version
    merged = log.append_versions(
        src.filter("seq % 2 = 1").select("seq", "kind", "obj_id", "valid_t", "tx_t", "data"),
        src.filter("seq % 2 = 0").select("kind", "obj_id", "valid_t", "tx_t", "data"),
        ["tx_t", "obj_id", "kind"],
    )
    top = src.filter("seq % 2 = 1").agg(F.max("seq")).first()[0]
    return merged.withColumn("appended", F.col("seq") > top).select("kind", "obj_id", "tx_t", "appended", "seq")


STATE_SQL = """SELECT kind, obj_id, seq, valid_t, value FROM (
  SELECT *, row_number() OVER (PARTITION BY kind, obj_id ORDER BY valid_t DESC, seq DESC) AS rn
  FROM object_version {where}) s WHERE rn = 1"""


@query("V2_state_as_of", STATE_SQL.format(where=f"WHERE valid_t <= TIMESTAMP '{AT}'"))
def v2(x):
    return log.state_as_of(x.object_version, AT).select("kind", "obj_id", "seq", "valid_t", "value")


@query("V2_state_latest", STATE_SQL.format(where=""))
def v2_latest(x):
    return log.state_as_of(x.object_version).select("kind", "obj_id", "seq", "valid_t", "value")


@query(
    "V2_state_as_known",
    STATE_SQL.format(
        where=f"WHERE valid_t <= TIMESTAMP '{AT}' AND tx_t <= TIMESTAMP '2024-01-15 12:30:00'"
    ),
)
def v2_tx(x):
    return log.state_as_of(x.object_version, AT, tx_at="2024-01-15 12:30:00").select(
        "kind", "obj_id", "seq", "valid_t", "value"
    )


@query(
    "V3_get_object_as_of",
    """SELECT q.req_id, q.kind, q.obj_id, q.at, v.seq, v.valid_t
       FROM (SELECT seq AS req_id, kind, obj_id, tx_t + INTERVAL '90' MINUTE AS at
             FROM object_version) q
       ASOF LEFT JOIN (SELECT kind, obj_id, valid_t, max(seq) AS seq FROM object_version
                       GROUP BY kind, obj_id, valid_t) v
         ON q.kind = v.kind AND q.obj_id = v.obj_id AND q.at >= v.valid_t""",
)
def v3(x):
    """One request per version, ninety minutes after it was written."""
    requests = x.object_version.selectExpr(
        "seq AS req_id", "kind", "obj_id", "tx_t + INTERVAL '90' MINUTE AS at"
    )
    return log.get_objects(x.object_version, requests)


@query("V4_history", "SELECT kind, obj_id, valid_t, seq, value FROM object_version")
def v4(x):
    return log.history(x.object_version).select("kind", "obj_id", "valid_t", "seq", "value")


@query("V5_kinds", "SELECT DISTINCT kind FROM object_version")
def v5(x):
    return log.kinds(x.object_version)


@query(
    "V6_count_versions",
    """SELECT kind, COUNT(*) AS n FROM object_version GROUP BY kind
       UNION ALL SELECT 'all' AS kind, COUNT(*) AS n FROM object_version""",
)
def v6(x):
    total = log.count_versions(x.object_version).select(F.lit("all").alias("kind"), "n")
    return log.count_versions(x.object_version, by_kind=True).unionByName(total)


@query("V7_time_bounds", "SELECT MIN(valid_t) AS first_t, MAX(valid_t) AS last_t FROM object_version")
def v7(x):
    return log.time_bounds(x.object_version)


@query("V8_version_times", "SELECT DISTINCT kind, valid_t FROM object_version")
def v8(x):
    return log.version_times(x.object_version)


@query("V9_naive_utc", "SELECT event_id, ts + INTERVAL '7' HOUR AS utc_t FROM events")
def v9(x):
    return x.events.select(
        "event_id", log.naive_utc(F.col("ts").cast("timestamp"), "GMT-7").alias("utc_t")
    )


PAYLOAD = """
SELECT event_id + 1 AS seq, 'Observation' AS kind, CAST(user_id AS STRING) AS obj_id, ts AS valid_t,
       CASE WHEN event_id % 13 = 0 THEN 'not json'
            ELSE concat('{{"id":"o', CAST(event_id AS STRING), '","fire_id":"f',
                 CAST(user_id % 5 AS STRING), '","kind":"',
                 CASE event_id % 7 WHEN 0 THEN 'radar' WHEN 1 THEN 'goes' ELSE 'viirs' END, '"',
                 CASE WHEN event_id % 11 = 0 THEN '' ELSE
                     concat(',"provenance":{{"source":"src', CAST(event_id % 3 AS STRING),
                            '","product":"p"}}') END,
                 ',"reported_uncertainty_m":', CAST(event_id % 500 AS STRING), '}}') END AS data
FROM {events}"""
VERDICT = """CASE WHEN event_id % 13 = 0 THEN 'not parseable'
                  WHEN event_id % 11 = 0 THEN 'missing provenance'
                  WHEN event_id % 7 = 0 THEN 'unknown kind' END"""


def _payload(x):
    from hazardgrid.fixtures import _zoneless

    return _zoneless(x.spark.sql(PAYLOAD, events=x.events))


@query(
    "V10_rehydrate",
    f"""SELECT event_id + 1 AS seq, concat('o', CAST(event_id AS STRING)) AS id,
               concat('f', CAST(user_id % 5 AS STRING)) AS fire_id,
               CASE event_id % 7 WHEN 1 THEN 'goes' ELSE 'viirs' END AS kind,
               concat('src', CAST(event_id % 3 AS STRING)) AS source,
               CAST(event_id % 500 AS DOUBLE) AS sigma_m
        FROM events WHERE ({VERDICT}) IS NULL""",
)
def v10(x):
    good, _ = schema.rehydrate(_payload(x), "Observation")
    return good.selectExpr(
        "seq", "id", "fire_id", "kind", "provenance.source AS source", "reported_uncertainty_m AS sigma_m"
    )


@query(
    "V10_rejected",
    f"SELECT event_id + 1 AS seq, {VERDICT} AS problem FROM events WHERE ({VERDICT}) IS NOT NULL",
)
def v10_bad(x):
    _, bad = schema.rehydrate(_payload(x), "Observation")
    return bad.select("seq", "problem")


ISSUES = """SELECT f.fire_id, t.issued_at FROM (SELECT DISTINCT CAST(user_id % 5 AS INT) AS fire_id FROM events) f
  JOIN (SELECT TIMESTAMP '2024-01-08 00:00:00' AS issued_at
        UNION ALL SELECT TIMESTAMP '2024-01-15 00:00:00'
        UNION ALL SELECT TIMESTAMP '2024-01-22 00:00:00') t ON 1 = 1"""


def _issues(x):
    at = ["2024-01-08 00:00:00", "2024-01-15 00:00:00", "2024-01-22 00:00:00"]
    instants = F.array(*[F.lit(a).cast("timestamp_ntz") for a in at])
    return x.observation.select("fire_id").distinct().withColumn("issued_at", F.explode(instants))


@query(
    "V11_causal_mask",
    f"""SELECT o.fire_id, MIN(i.issued_at) AS issued_at, o.obs_id, o.t FROM observation o
        JOIN ({ISSUES}) i ON i.fire_id = o.fire_id AND o.t <= i.issued_at GROUP BY o.fire_id, o.obs_id, o.t""",
)
def v11(x):
    return log.first_usable_issue(x.observation, _issues(x)).select("fire_id", "issued_at", "obs_id", "t")


@query(
    "V12_acknowledge_override",
    """SELECT (SELECT MAX(seq) FROM recommendation) + row_number() OVER (ORDER BY rec_id) AS seq, rec_id, valid_t, 'duty' AS acknowledged_by,
              CASE WHEN CAST(rec_id AS BIGINT) % 2 = 0 THEN rationale
                   ELSE concat(rationale, chr(10), '[override by duty] road is open') END AS rationale
       FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY valid_t DESC, seq DESC) AS rn
             FROM recommendation) c WHERE rn = 1""",
)
def v12(x):
    decisions = x.recommendation.select("rec_id").distinct().selectExpr(
        "rec_id", "'duty' AS user",
        "CASE WHEN CAST(rec_id AS BIGINT) % 2 = 0 THEN NULL ELSE 'road is open' END AS note",
    )
    held = x.recommendation.withColumn("acknowledged_by", F.lit(None).cast("string"))
    after = log.append_versions(held, log.acknowledge(x.recommendation, decisions), ["rec_id"])
    return log.state_as_of(after, keys=["rec_id"]).select("seq", "rec_id", "valid_t", "acknowledged_by", "rationale")


@query(
    "V13_ingest_observation",
    """SELECT row_number() OVER (ORDER BY ts, CAST(event_id AS STRING)) AS seq, CAST(event_id AS STRING) AS obj_id,
              'Observation' AS kind, ts AS valid_t FROM events""",
)
def v13(x):
    """Observations written as versions of one kind into an empty log."""
    batch = x.observation.selectExpr(
        "'Observation' AS kind", "CAST(obs_id AS STRING) AS obj_id", "t AS valid_t", "t AS tx_t",
        "to_json(named_struct('id', obs_id, 'kind', kind, 'lon', lon, 'lat', lat)) AS data",
    )
    empty = x.object_version.select("seq", "kind", "obj_id", "valid_t", "tx_t", "data").filter("false")
    return log.append_versions(empty, batch).select("seq", "obj_id", "kind", "valid_t")


@query(
    "V14_evidence",
    f"""SELECT DISTINCT fire_id, issued_at, evidence_id FROM (
          SELECT i.fire_id, i.issued_at, concat('fc_', CAST(h.h AS STRING)) AS evidence_id
          FROM ({ISSUES}) i
          JOIN (SELECT 15 AS h UNION ALL SELECT 30 UNION ALL SELECT 60 UNION ALL SELECT 180) h ON 1 = 1
          UNION ALL
          SELECT o.fire_id, MIN(i.issued_at), CAST(o.obs_id AS STRING) FROM observation o
          JOIN ({ISSUES}) i ON i.fire_id = o.fire_id AND o.t <= i.issued_at GROUP BY o.fire_id, o.obs_id) e""",
)
def v14(x):
    issues = _issues(x)
    forecasts = issues.withColumn(
        "forecast_id", F.explode(F.array(*[F.lit(f"fc_{h}") for h in (15, 30, 60, 180)]))
    )
    return log.evidence(forecasts, log.first_usable_issue(x.observation, issues))


@query(
    "V15_links",
    """SELECT DISTINCT CAST(fire_id AS STRING) AS src, 'has' AS rel, CAST(obs_id AS STRING) AS dst
       FROM observation
       UNION ALL SELECT DISTINCT CAST(obs_id AS STRING), 'from', kind FROM observation
       UNION ALL SELECT DISTINCT CAST(camera_id AS STRING), 'sees', CAST(fire_id AS STRING) FROM camera
       UNION ALL SELECT DISTINCT CAST(p.fire_id AS STRING), 'threatens', CAST(z.zone_id AS STRING)
           FROM prob p JOIN zone_cell z ON z.fire_id = p.fire_id AND z.i = p.i AND z.j = p.j
           WHERE p.arm = 'on' AND p.horizon_min = 180 AND p.p >= 0.5
       UNION ALL SELECT DISTINCT rec_id, 'protects', target FROM recommendation
       UNION ALL SELECT DISTINCT CAST(cell_id AS STRING), 'force', CAST(fire_id AS STRING)
           FROM grid_cell""",
)
def v15(x):
    from hazardgrid.plans.decide_queries import zone_cells
    from hazardgrid.plans.ensemble_queries import field

    threats = (
        field(x).filter("horizon_min = 180 AND p >= 0.5")
        .join(zone_cells(x), ["fire_id", "i", "j"])
        .selectExpr("fire_id AS src", "zone_id AS dst")
    )
    return log.links(
        has=x.observation.selectExpr("fire_id AS src", "obs_id AS dst"),
        from_=x.observation.selectExpr("obs_id AS src", "kind AS dst"),
        sees=x.camera.selectExpr("camera_id AS src", "fire_id AS dst"),
        threatens=threats,
        protects=x.recommendation.selectExpr("rec_id AS src", "target AS dst"),
        force=x.grid_cell.selectExpr("cell_id AS src", "fire_id AS dst"),
    )


@query(
    "V16_state_all_kinds",
    STATE_SQL.format(where=f"WHERE valid_t <= TIMESTAMP '{AT}'").replace("seq, valid_t, value", "data"),
)
def v16(x):
    """One row per object, ordered by kind: a kind may hold any number of objects."""
    return log.state_as_of(x.object_version, AT).select("kind", "obj_id", "data").orderBy("kind", "obj_id")


FORECAST_SQL = """SELECT seq, obj_id, fire_id, horizon_min, issued_at FROM (
  SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY {t} DESC, seq DESC) AS rn
  FROM forecast_version WHERE {t} <= TIMESTAMP '1997-06-30 00:00:00') s WHERE rn = 1 {h}"""


@query("V17_forecasts_as_of", FORECAST_SQL.format(t="valid_t", h="AND horizon_min = 60"))
def v17(x):
    return log.forecasts_as_of(x.forecast_version, "1997-06-30 00:00:00", 60).select(
        "seq", "obj_id", "fire_id", "horizon_min", "issued_at"
    )


@query("V17_forecasts_by_issue", FORECAST_SQL.format(t="issued_at", h=""))
def v17_issue(x):
    return log.forecasts_as_of(x.forecast_version, "1997-06-30 00:00:00", by_issue=True).select(
        "seq", "obj_id", "fire_id", "horizon_min", "issued_at"
    )


RECS_NOW = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id
    ORDER BY valid_t DESC, seq DESC) AS rn FROM recommendation) s WHERE rn = 1)"""


@query("V18_decisions_as_of", f"SELECT rec_id, kind, target, urgency FROM {RECS_NOW} d")
def v18(x):
    return (
        log.state_as_of(x.recommendation, keys=["rec_id"])
        .orderBy(F.col("urgency").desc(), "rec_id")
        .select("rec_id", "kind", "target", "urgency")
    )


@query(
    "V19_camera_frame",
    """SELECT camera_id, CASE WHEN camera_id % 3 <> 0
          THEN concat('/outputs/', CAST(fire_id AS STRING), '/frame_', CAST(camera_id AS STRING), '.png')
          END AS frame_url FROM camera""",
)
def v19(x):
    frame = F.when(F.col("camera_id") % 3 != 0, F.format_string("frame_%d.png", "camera_id"))
    return x.camera.select(
        "camera_id", query_text.frame_url(F.col("fire_id").cast("string"), frame).alias("frame_url")
    )


#: Check SQL of the list answers by query, for the dispatch.
TOP_SQL: dict[str, str] = {}


def _top_sql(name, kind, n, item, prefix, none):
    TOP_SQL[name] = f"""
WITH top AS (SELECT *, row_number() OVER (PARTITION BY fire_id ORDER BY urgency DESC, rec_id) AS k
             FROM {RECS_NOW} d WHERE kind = '{kind}')
SELECT f.fire_id, concat('{prefix}', coalesce(t.body, '{none}')) AS answer, t.cites
FROM (SELECT DISTINCT fire_id FROM recommendation) f
LEFT JOIN (SELECT fire_id, string_agg({item}, '; ' ORDER BY k) AS body, list(rec_id ORDER BY k) AS cites
           FROM top WHERE k <= {n} GROUP BY fire_id) t ON t.fire_id = f.fire_id"""
    return TOP_SQL[name]


@query(
    "V20_top_evacuations",
    _top_sql(
        "V20_top_evacuations", "evacuate", 5,
        """CASE WHEN lead_time_min IS NOT NULL THEN printf('%s [%.2f, %.0f min ahead]', target_name,
           urgency, lead_time_min) ELSE printf('%s [%.2f]', target_name, urgency) END""",
        "Evacuate first: ", "nothing flagged",
    ),
)
def v20(x):
    return query_text.top_evacuations(log.state_as_of(x.recommendation, keys=["rec_id"]))


@query(
    "V21_top_egress",
    _top_sql(
        "V21_top_egress", "close_road", 5, "printf('%s [%.0f%%]', target_name, confidence * 100)",
        "Roads under threat: ", "nothing flagged",
    ),
)
def v21(x):
    return query_text.top_egress(log.state_as_of(x.recommendation, keys=["rec_id"]))


@query("V21_top_staging", _top_sql("V21_top_staging", "stage", 4, "target_name", "Stage at: ", "none"))
def v21_staging(x):
    return query_text.top_staging(log.state_as_of(x.recommendation, keys=["rec_id"]))


@query(
    "V22_camera_list",
    """SELECT fire_id, COUNT(*) OVER (PARTITION BY fire_id) AS n_cameras,
              row_number() OVER (PARTITION BY fire_id ORDER BY camera_id) AS place, camera_id AS cited_id, name FROM camera""",
)
def v22(x):
    return query_text.camera_list(x.camera)


@query(
    "V22_fire_status",
    """SELECT fire_id, concat('Event ', CAST(fire_id AS STRING), ': ',
          CASE fire_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'contained' ELSE 'out' END) AS answer
       FROM site""",
)
def v22_status(x):
    fires = x.site.selectExpr(
        "fire_id", "concat('Event ', fire_id) AS name",
        "CASE fire_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'contained' ELSE 'out' END AS status",
    )
    return query_text.fire_status(fires)


@query(
    "V23_observation_counts",
    """SELECT fire_id, kind, COUNT(*) AS n FROM observation GROUP BY fire_id, kind""",
)
def v23(x):
    return query_text.observation_counts(x.observation)


@query("V23_observation_citations", "SELECT fire_id, kind, obs_id AS cited_id FROM observation")
def v23_cites(x):
    return query_text.observation_citations(x.observation)


ROUTE_SQL = """CASE
  WHEN regexp_matches(q, 'evacuat|at risk|urgent|threat') AND NOT contains(q, 'road') THEN 'evacuations'
  WHEN contains(q, 'road') OR contains(q, 'egress') OR contains(q, 'route') THEN 'egress'
  WHEN contains(q, 'stag') OR contains(q, 'resource') OR contains(q, 'crew') THEN 'staging'
  WHEN contains(q, 'camera') THEN 'cameras'
  WHEN contains(q, 'observ') OR contains(q, 'feed') OR contains(q, 'hotspot') OR contains(q, 'satellite')
      THEN 'observations'
  WHEN contains(q, 'fire') OR contains(q, 'status') THEN 'status' ELSE 'help' END"""


@query(
    "V24_route_questions",
    f"""SELECT doc_id, {ROUTE_SQL} AS intent
        FROM (SELECT doc_id, lower(text) AS q FROM documents
              UNION ALL SELECT -1 - conv_id * 1000 - turn, lower(text) FROM conversations
              UNION ALL SELECT -1000000000 - c_custkey, lower(concat('which ', CASE c_custkey % 9
                 WHEN 0 THEN 'zones to evacuate' WHEN 1 THEN 'road is at risk' WHEN 2 THEN 'egress'
                 WHEN 3 THEN 'crews' WHEN 4 THEN 'cameras' WHEN 5 THEN 'satellite feeds'
                 WHEN 6 THEN 'fire' WHEN 7 THEN 'Staging' ELSE 'x' END)) FROM customer) d""",
)
def v24(x):
    made = x.customer.selectExpr(
        "-1000000000 - c_custkey AS doc_id",
        """concat('which ', CASE c_custkey % 9 WHEN 0 THEN 'zones to evacuate'
           WHEN 1 THEN 'road is at risk' WHEN 2 THEN 'egress' WHEN 3 THEN 'crews' WHEN 4 THEN 'cameras'
           WHEN 5 THEN 'satellite feeds' WHEN 6 THEN 'fire' WHEN 7 THEN 'Staging' ELSE 'x' END) AS text""",
    )
    asked = (
        x.documents.select("doc_id", "text")
        .unionByName(x.conversations.selectExpr("-1 - conv_id * 1000 - turn AS doc_id", "text"))
        .unionByName(made)
    )
    return asked.select("doc_id", query_text.intent(F.col("text")).alias("intent"))


QUESTION_SQL = """concat('which ', CASE c_custkey % 9 WHEN 0 THEN 'zones to evacuate' WHEN 1 THEN 'road is at risk'
    WHEN 2 THEN 'egress' WHEN 3 THEN 'crews' WHEN 4 THEN 'cameras' WHEN 5 THEN 'satellite feeds' WHEN 6 THEN 'fire'
    WHEN 7 THEN 'Staging' ELSE 'x' END)"""


def _answer_sql(intent: str, name: str) -> str:
    cites = "list_transform(cites, lambda c: CAST(c AS VARCHAR))"
    return f"SELECT fire_id, '{intent}' AS intent, answer, {cites} AS cites FROM ({TOP_SQL[name]}) a_{intent}"


@query(
    "V24_answer_questions",
    f"""WITH known AS ({_answer_sql("evacuations", "V20_top_evacuations")} UNION ALL {_answer_sql("egress", "V21_top_egress")}
          UNION ALL {_answer_sql("staging", "V21_top_staging")}
          UNION ALL SELECT fire_id, 'cameras', concat(CAST(COUNT(*) AS VARCHAR), ' cameras: ', array_to_string((list(name ORDER BY camera_id))[1:10], ', ')),
                 (list(CAST(camera_id AS VARCHAR) ORDER BY camera_id))[1:10] FROM camera GROUP BY fire_id
          UNION ALL SELECT o.fire_id, 'observations', concat(CAST(SUM(n) AS VARCHAR), ' observations: ', string_agg(concat(kind, ' ', CAST(n AS VARCHAR)), ', ' ORDER BY kind)),
                 (SELECT (list(CAST(obs_id AS VARCHAR) ORDER BY obs_id))[1:10] FROM observation b WHERE b.fire_id = o.fire_id)
                 FROM (SELECT fire_id, kind, COUNT(*) AS n FROM observation GROUP BY fire_id, kind) o GROUP BY o.fire_id
          UNION ALL SELECT fire_id, 'status', concat('Event ', CAST(fire_id AS STRING), ': ', CASE fire_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'contained' ELSE 'out' END),
                 [CAST(fire_id AS VARCHAR)] FROM site),
        asked AS (SELECT question_id, fire_id, {ROUTE_SQL} AS intent
                  FROM (SELECT c_custkey AS question_id, CAST(c_custkey % 5 AS INT) AS fire_id, lower({QUESTION_SQL}) AS q FROM customer) c)
        SELECT question_id, asked.fire_id, asked.intent, CASE WHEN asked.intent = 'help' THEN '{query_text.HELP}' ELSE answer END AS answer,
               coalesce(cites, []::VARCHAR[]) AS cites
        FROM asked LEFT JOIN known ON known.fire_id = asked.fire_id AND known.intent = asked.intent""",
)
def v24_answers(x):
    """Every question meets the answer to its intent, with the ids that answer rests on."""
    questions = x.customer.selectExpr("c_custkey AS question_id", "CAST(c_custkey % 5 AS INT) AS fire_id", f"{QUESTION_SQL} AS question")
    fires = x.site.selectExpr(
        "fire_id", "concat('Event ', fire_id) AS name", "CASE fire_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'contained' ELSE 'out' END AS status"
    )
    recs = log.state_as_of(x.recommendation, keys=["rec_id"])
    return query_text.answer_questions(questions, query_text.answers(recs, x.camera, x.observation, fires))


@query(
    "V25_wind_of_cells",
    f"""SELECT cell_id, {r("sqrt(wind_u * wind_u + wind_v * wind_v)")} AS speed,
               {r("(degrees(atan2(wind_u, wind_v)) + 360.0) % 360.0")} AS dir_to_deg FROM grid_cell""",
)
def v25(x):
    from hazardgrid.functions import geo

    return x.grid_cell.select(
        "cell_id",
        rounded(geo.uv_speed("wind_u", "wind_v")).alias("speed"),
        rounded(geo.uv_dir_to("wind_u", "wind_v")).alias("dir_to_deg"),
    )


@query(
    "V26_observation_count",
    """SELECT user_id % 5 AS fire_id, COUNT(*) FILTER (WHERE event_id % 10 = 0
           OR ts <= TIMESTAMP '2024-01-10 00:00:00') AS n_obs FROM events GROUP BY user_id % 5""",
)
def v26(x):
    obs = x.events.selectExpr(
        "user_id % 5 AS fire_id", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS t"
    )
    return log.observation_count(obs, "2024-01-10 00:00:00", "2024-01-20 00:00:00")


@query(
    "V27_active_horizon",
    """SELECT event_id, CASE WHEN value * 3 >= 180 - 1e-6 THEN 180 WHEN value * 3 >= 60 - 1e-6 THEN 60
              WHEN value * 3 >= 30 - 1e-6 THEN 30 ELSE 15 END AS horizon_min FROM events""",
)
def v27(x):
    return x.events.select(
        "event_id", log.active_horizon(F.col("value") * 3, [15, 30, 60, 180]).alias("horizon_min")
    )
