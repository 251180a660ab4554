"""Answers to the fixed questions about an event, each citing the ids it rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardgrid.operators.common import first_rows, number_rows, salted_join

# Question rules in order, as intent, pattern that must match, pattern that must not.
INTENT_RULES = [
    ("evacuations", "evacuat|at risk|urgent|threat", "road"),
    ("egress", "road|egress|route", None),
    ("staging", "stag|resource|crew", None),
    ("cameras", "camera", None),
    ("observations", "observ|feed|hotspot|satellite", None),
    ("status", "fire|status", None),
]


def intent(question: Column) -> Column:
    """Which question a text asks; ``help`` when no rule applies."""
    q = F.lower(F.trim(question))
    expr = None
    for name, wanted, unwanted in INTENT_RULES:
        cond = q.rlike(wanted)
        if unwanted:
            cond = cond & ~q.rlike(unwanted)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("help"))


def frame_url(event: Column, last_frame: Column) -> Column:
    return F.when(
        F.length(last_frame) > 0, F.concat(F.lit("/outputs/"), event, F.lit("/"), last_frame)
    )


def _top(recs: DataFrame, kind: str, n: int, item: Column, prefix: str, none: str) -> DataFrame:
    """Per event the ``n`` most urgent of a kind as text; the group never exceeds ``n`` rows."""
    top = first_rows(
        recs.filter(F.col("kind") == kind), "fire_id", [F.col("urgency").desc(), F.col("rec_id")], n, "k"
    )
    listed = top.groupBy("fire_id").agg(
        F.sort_array(F.collect_list(F.struct("k", item.alias("item"), "rec_id"))).alias("rows")
    )
    body = F.array_join(F.col("rows.item"), "; ")
    return (
        recs.select("fire_id")
        .distinct()
        .join(listed, "fire_id", "left")
        .select(
            "fire_id",
            F.concat(F.lit(prefix), F.coalesce(body, F.lit(none))).alias("answer"),
            F.col("rows.rec_id").alias("cites"),
        )
    )


def top_evacuations(recs: DataFrame) -> DataFrame:
    item = F.when(
        F.col("lead_time_min").isNotNull(),
        F.format_string("%s [%.2f, %.0f min ahead]", "target_name", "urgency", "lead_time_min"),
    ).otherwise(F.format_string("%s [%.2f]", "target_name", "urgency"))
    return _top(recs, "evacuate", 5, item, "Evacuate first: ", "nothing flagged")


def top_egress(recs: DataFrame) -> DataFrame:
    item = F.format_string("%s [%.0f%%]", F.col("target_name"), F.col("confidence") * 100)
    return _top(recs, "close_road", 5, item, "Roads under threat: ", "nothing flagged")


def top_staging(recs: DataFrame) -> DataFrame:
    return _top(recs, "stage", 4, F.col("target_name"), "Stage at: ", "none")


def camera_list(cameras: DataFrame) -> DataFrame:
    """Answer line of every camera: how many the event has, the camera's place among them and its name."""
    n = cameras.groupBy("fire_id").agg(F.count("*").alias("n_cameras"))
    placed = number_rows(cameras.select("fire_id", "camera_id", "name"), [F.col("camera_id")], ["fire_id"], "place")
    return placed.join(n, "fire_id").select("fire_id", "n_cameras", "place", F.col("camera_id").alias("cited_id"), "name")


def fire_status(fires: DataFrame) -> DataFrame:
    return fires.select("fire_id", F.concat("name", F.lit(": "), "status").alias("answer"))


def observation_counts(observations: DataFrame) -> DataFrame:
    """Count per event and kind."""
    return observations.groupBy("fire_id", "kind").agg(F.count("*").alias("n"))


def observation_citations(observations: DataFrame) -> DataFrame:
    """The ids behind the counts, one per row, so an event may cite any number."""
    return observations.select("fire_id", "kind", F.col("obs_id").alias("cited_id"))


#: Cameras and observations that one answer names or cites; their number is always told.
SHOWN = 10
HELP = "Questions are answered on evacuations, roads, staging, cameras, observations and status."


def _text_ids(cites: Column) -> Column:
    return F.coalesce(cites.cast("array<string>"), F.array().cast("array<string>"))


def answers(recs: DataFrame, cameras: DataFrame, observations: DataFrame, fires: DataFrame) -> DataFrame:
    """``fire_id, intent, answer, cites``: a row for each event and intent that has something to say.

    An answer holds a bounded number of items; lists are cut by rank before anything is gathered.
    """

    def listed(rows: DataFrame, key: str, item: Column) -> DataFrame:
        n = rows.groupBy("fire_id").agg(F.count("*").alias("n"))
        top = first_rows(rows, "fire_id", [F.col(key)], SHOWN, "k")
        some = top.groupBy("fire_id").agg(F.sort_array(F.collect_list(F.struct("k", item.alias("item"), F.col(key).alias("id")))).alias("rows"))
        return n.join(some, "fire_id")

    cams = listed(cameras, "camera_id", F.col("name")).select(
        "fire_id", F.concat(F.col("n").cast("string"), F.lit(" cameras: "), F.array_join("rows.item", ", ")).alias("answer"),
        F.col("rows.id").alias("cites"),
    )
    kinds = observation_counts(observations).groupBy("fire_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "n"))), lambda k: F.concat(k["kind"], F.lit(" "), k["n"])), ", ").alias("by_kind")
    )  # kinds are a fixed list
    seen = listed(observations, "obs_id", F.lit("")).join(kinds, "fire_id").select(
        "fire_id", F.concat(F.col("n").cast("string"), F.lit(" observations: "), "by_kind").alias("answer"), F.col("rows.id").alias("cites")
    )
    status = fire_status(fires).withColumn("cites", F.array(F.col("fire_id")))
    parts = {
        "evacuations": top_evacuations(recs), "egress": top_egress(recs), "staging": top_staging(recs),
        "cameras": cams, "observations": seen, "status": status,
    }
    out = None
    for name, part in parts.items():
        part = part.select("fire_id", F.lit(name).alias("intent"), "answer", _text_ids(F.col("cites")).alias("cites"))
        out = part if out is None else out.unionByName(part)
    return out


def answer_questions(questions: DataFrame, known: DataFrame) -> DataFrame:
    """``question_id, fire_id, intent, answer, cites`` for every ``(question_id, fire_id, question)``.

    The text names the intent, the intent and the event name the answer. A question that no rule knows gets the
    help text; one on an event that has nothing to say gets a null answer and cites nothing.
    """
    asked = questions.select("question_id", "fire_id", intent(F.col("question")).alias("intent"))
    out = salted_join(asked, known, ["fire_id", "intent"], ["question_id"], "left")
    answer = F.when(F.col("intent") == "help", F.lit(HELP)).otherwise(F.col("answer"))
    return out.select("question_id", "fire_id", "intent", answer.alias("answer"), _text_ids(F.col("cites")).alias("cites"))
