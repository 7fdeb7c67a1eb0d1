"""Queries: questionnaires and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.timefn import HOUR
from sensorloom.operators import labels, ranges
from sensorloom.plans import views as v
from sensorloom.plans.registry import query
from sensorloom.plans.views import sql_with

# Question texts are the roles; the third is never asked, so its columns stay NULL.
_QUESTIONS = [("user", "q_user"), ("assistant", "q_assistant"), ("narrator", "q_narrator")]


@query(
    "questionnaire_pivot",
    sql_with(
        "questionnaire",
        "SELECT event, " + ", ".join(
            f"arg_min(substr(answer, 3, length(answer) - 4), answer_order) FILTER (contains(question, '{t}')) AS {n}, "
            f"min(answer_order) FILTER (contains(question, '{t}')) AS {n}_time" for t, n in _QUESTIONS
        ) + " FROM questionnaire GROUP BY event",
    ),
)
def _questionnaire_pivot(spark, d):
    answers = v.questionnaire(spark, d).withColumn("answer_us", F.col("answer_order"))
    return labels.questionnaire_pivot(answers, _QUESTIONS, ["event"])


@query(
    "duplicate_answers",
    sql_with(
        "questionnaire",
        """SELECT event, answer_order, question FROM questionnaire
        QUALIFY answer_order > min(answer_order) OVER (PARTITION BY event, question) OR question NOT IN ('user', 'assistant')""",
    ),
)
def _duplicate_answers(spark, d):
    return labels.duplicate_answers(v.questionnaire(spark, d), _QUESTIONS, ["event"]).select("event", "answer_order", "question")


_RULES = [
    ("A", {"event_type": "view"}),
    ("B", {"event_type": "view", "k4": "1"}),
    ("C", {"event_type": "click", "k4": "2", "size": "big"}),
    ("D", {"k4": "3", "size": "small"}),
]


def _answers(spark, d):
    return v.ev(spark, d).select(
        "event_id",
        "device",
        "us",
        "event_type",
        (F.col("k") % 4).cast("string").alias("k4"),
        F.when(F.col("value") >= 50, "big").otherwise("small").alias("size"),
    )


_ANSWERS_SQL = """ans AS (SELECT event_id, device, us, event_type, CAST(k % 4 AS VARCHAR) AS k4, CASE WHEN value >= 50 THEN 'big' ELSE 'small' END AS size FROM ev)"""


@query(
    "rule_labels",
    sql_with(
        "ev",
        """SELECT event_id, CASE WHEN k4 = '3' AND size = 'small' THEN 'D' WHEN event_type = 'click' AND k4 = '2' AND size = 'big' THEN 'C'
        WHEN event_type = 'view' AND k4 = '1' THEN 'B' WHEN event_type = 'view' THEN 'A' END AS label FROM ans""",
        _ANSWERS_SQL,
    ),
)
def _rule_labels(spark, d):
    return labels.rule_labels(_answers(spark, d), _RULES, "label").select("event_id", "label")


@query(
    "dict_labels",
    sql_with(
        "ev",
        """SELECT event_id, CASE WHEN k4 = '0' THEN 'zero' WHEN k4 = '2' THEN 'two' WHEN event_type = 'view' THEN 'look' WHEN event_type = 'click' THEN 'touch' END AS label FROM ans""",
        _ANSWERS_SQL,
    ),
)
def _dict_labels(spark, d):
    sources = [("event_type", {"view": "look", "click": "touch"}), ("k4", {"0": "zero", "2": "two"})]
    return labels.dict_labels(_answers(spark, d), sources, "label").select("event_id", "label")


@query(
    "event_label_table",
    sql_with(
        "ev",
        "SELECT device, hour_us, arg_max(event_type, us) AS event_type, arg_max(k4, us) AS k4 FROM (SELECT *, us - us % 86400000000 AS hour_us FROM ans) GROUP BY ALL",
        _ANSWERS_SQL,
    ),
)
def _event_label_table(spark, d):
    rows = _answers(spark, d).withColumn("hour_us", F.col("us") - F.pmod("us", F.lit(24 * HOUR)))
    return labels.event_label_table(rows, ["event_type", "k4"], "us", ["device", "hour_us"])


_SYN_SQL = f"""lab AS (SELECT s.event_id, s.device, s.us, substr(l.label, 4) AS label, l.start_us + least((s.us - l.start_us) // {3 * HOUR},
    greatest(CAST(ceil((l.end_us - l.start_us) / {3.0 * HOUR}) AS BIGINT) - 1, 0)) * {3 * HOUR} + {3 * HOUR // 2} AS event_us
  FROM sensor s JOIN lab_session l ON s.us BETWEEN l.start_us AND l.end_us)"""


def _tagged(spark, d):
    sessions = v.lab_session(spark, d)
    labelled = ranges.interval_label(v.sensor(spark, d), sessions)
    return labels.synthetic_events(labelled, sessions, 3 * HOUR)


@query("synthetic_events", sql_with("sensor lab_session", "SELECT event_id, device, us, label, event_us FROM lab", _SYN_SQL))
def _synthetic_events(spark, d):
    return _tagged(spark, d).select("event_id", "device", "us", "label", "event_us")


@query(
    "synthetic_event_labels",
    sql_with(
        "sensor lab_session",
        "SELECT event_us, arg_min(label, (us, event_id)) AS label, device FROM lab GROUP BY device, event_us",
        _SYN_SQL,
    ),
)
def _synthetic_event_labels(spark, d):
    return labels.synthetic_event_labels(_tagged(spark, d), tie=["event_id"])
