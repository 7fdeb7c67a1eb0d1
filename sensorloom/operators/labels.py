"""Questionnaire reshaping and label construction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.operators.ranges import interval_lookup

# Question texts and the columns they fill, in the order they are tried (fixed values).
QUESTIONS = [
    ("Current Location", "location"),
    ("Body Motion", "bodyposition"),
    ("Activity", "activity"),
    ("Phone Location", "smartphonelocation"),
    ("Evaluation of Phone Use", "aligned"),
]


def _question(text: Column, questions: Sequence[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(text.contains(t), F.lit(name)) for t, name in questions])


def strip_brackets(answer: Column) -> Column:
    """Cut the two leading and the two trailing characters of ``["answer"]``."""
    return F.when(F.length(answer) > 4, F.substring(answer, F.lit(3), F.length(answer) - 4)).otherwise(F.lit(""))


def questionnaire_pivot(
    answers: DataFrame,
    questions: Sequence[tuple[str, str]] = QUESTIONS,
    keys: Sequence[str] = ("device", "event_us"),
    order: str = "answer_order",
    text: str = "question",
    answer: str = "answer",
    time: str = "answer_us",
) -> DataFrame:
    """One row per event with the first answer to each question and its time; missing ones NULL.

    A conditional ``min_by`` per question: one map-side combined pass, no pivot job.
    """
    named = answers.withColumn("_q", _question(F.col(text), questions))
    firsts = [
        part
        for _, name in questions
        for part in (
            F.min_by(strip_brackets(F.col(answer)), F.when(F.col("_q") == name, F.col(order))).alias(name),
            F.min_by(F.col(time), F.when(F.col("_q") == name, F.col(order))).alias(f"{name}_time"),
        )
    ]
    return named.groupBy(*keys).agg(*firsts)


def duplicate_answers(
    answers: DataFrame,
    questions: Sequence[tuple[str, str]] = QUESTIONS,
    keys: Sequence[str] = ("device", "event_us"),
    order: str = "answer_order",
    text: str = "question",
) -> DataFrame:
    """Answers that are not the first to their question of the event, or belong to no known question."""
    named = answers.withColumn("_q", _question(F.col(text), questions))
    first = named.filter("_q IS NOT NULL").groupBy(*keys, "_q").agg(F.min(order).alias("_first"))
    return (
        named.join(first, [*keys, "_q"], "left")
        .filter(F.col("_first").isNull() | (F.col(order) > F.col("_first")))
        .drop("_q", "_first")
    )


def rule_labels(df: DataFrame, rules: Sequence[tuple[str, dict[str, str]]], into: str) -> DataFrame:
    """Label rows whose columns equal a rule's values; later rules overwrite earlier ones.

    Rules are configuration, so they become one expression and need no join.
    """
    cases = [
        F.when(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in cond.items()]), F.lit(label))
        for label, cond in reversed(rules)
    ]
    return df.withColumn(into, F.coalesce(*cases))


def dict_labels(df: DataFrame, sources: Sequence[tuple[str, dict[str, str]]], into: str) -> DataFrame:
    """Label by dictionaries over one or more columns; a later source overrides where it maps."""
    mapped = [
        F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col(column)]
        for column, mapping in reversed(sources)
    ]
    return df.withColumn(into, F.coalesce(*mapped))


def event_label_table(
    events: DataFrame, columns: Sequence[str], order: str, keys: Sequence[str] = ("device", "event_us")
) -> DataFrame:
    """Lookup table event → label columns; the last entry per event counts."""
    last = F.max_by(F.struct(*columns), F.col(order)).alias("_l")
    return events.groupBy(*keys).agg(last).select(*keys, "_l.*")


def synthetic_events(
    rows: DataFrame, sessions: DataFrame, length_us: int, us: str = "us", keys: Sequence[str] = ()
) -> DataFrame:
    """Cut each session into events of ``length_us`` centred at start + length/2, and tag the rows with ``event_us``.

    A row on the edge of two events goes to the later one; the last event is the
    last whose centre lies before end + length/2. Later sessions win. Sessions of
    single devices name them in ``keys``; without keys they hold for all devices.
    """
    length = F.lit(length_us).cast("long")
    last = F.ceil((F.col("end_us") - F.col("start_us")) / length) - 1
    reach = sessions.withColumn("_last", F.greatest(last, F.lit(0)).cast("long")).withColumn(
        "end_us", F.col("start_us") + (F.col("_last") + 1) * length
    )
    found = interval_lookup(rows, reach, ["_last"], us, keys=keys)
    index = F.least(F.expr(f"({us} - _hit.start_us) div {length_us}"), F.col("_hit._last"))
    return found.withColumn("event_us", F.col("_hit.start_us") + index * length + F.lit(length_us // 2)).drop("_hit")


def synthetic_event_labels(
    tagged: DataFrame, label: str = "label", device: str = "device", us: str = "us", tie: Sequence[str] = ()
) -> DataFrame:
    """Event (device and time) → label of the event's first row of that device."""
    return tagged.groupBy(device, "event_us").agg(F.min_by(label, F.struct(us, *tie)).alias(label)).select("event_us", label, device)
