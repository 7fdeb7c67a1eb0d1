"""Row and column filters, deduplication and the accounting around them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.functions.scalars import ratio


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order``.

    ``row_number = 1`` is cut to one candidate per key and input partition before
    the shuffle, so a heavily duplicated key does not travel.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def gps_accuracy_filter(df: DataFrame, max_accuracy: float, accuracy: str = "accuracy") -> DataFrame:
    return df.filter(F.col(accuracy) <= max_accuracy)


def gps_accuracy_analytics(
    df: DataFrame, max_accuracy: float, event_keys: Sequence[str], accuracy: str = "accuracy"
) -> DataFrame:
    """Rows, columns and events before and after the accuracy filter, with relative changes."""
    kept = F.col(accuracy) <= max_accuracy
    n_columns = len(df.columns)
    # One row per event first: counting distinct events over all rows would copy each row.
    per_event = df.groupBy(*event_keys).agg(F.count("*").alias("_n"), F.count(F.when(kept, 1)).alias("_kept"))
    sums = per_event.agg(F.sum("_n").alias("r0"), F.sum("_kept").alias("r1"), F.count("*").alias("e0"), F.count(F.when(F.col("_kept") > 0, 1)).alias("e1"))
    one = sums.fillna(0, ["r0", "r1"])
    null = F.lit(None).cast("double")
    stages = F.array(
        F.struct(
            F.lit("before").alias("stage"),
            F.col("r0").alias("n_rows"),
            F.lit(n_columns).cast("long").alias("n_columns"),
            F.col("e0").alias("n_events"),
            null.alias("rows_change"),
            null.alias("columns_change"),
            null.alias("events_change"),
        ),
        F.struct(
            F.lit("after").alias("stage"),
            F.col("r1").alias("n_rows"),
            F.lit(n_columns).cast("long").alias("n_columns"),
            F.col("e1").alias("n_events"),
            ratio(F.col("r1") - F.col("r0"), F.col("r0")).alias("rows_change"),
            F.lit(0.0).alias("columns_change"),
            ratio(F.col("e1") - F.col("e0"), F.col("e0")).alias("events_change"),
        ),
    )
    return one.select(F.inline(stages))


def gps_threshold_sweep(
    df: DataFrame,
    thresholds: Sequence[float],
    event_keys: Sequence[str],
    accuracy: str = "accuracy",
    speed: str | None = None,
    max_speed: float = 300.0,
) -> DataFrame:
    """Rows and events that stay below each accuracy threshold, after the speed sanity filter.

    Rows are not multiplied by the thresholds: the best accuracy per event is
    found first and only events meet the list of thresholds.
    """
    base = df if speed is None else df.filter(F.col(speed) < max_speed)
    listed = sorted(thresholds)
    below = reduce(lambda acc, t: acc + F.when(F.col(accuracy) < t, 0).otherwise(1), listed, F.lit(0))
    # level = number of thresholds the row fails; pre-aggregate per event and level.
    per_event = base.groupBy(*event_keys, below.alias("_level")).agg(F.count("*").alias("_n"))
    per_event = per_event.groupBy(*event_keys).agg(
        *[F.sum(F.when(F.col("_level") <= i, F.col("_n"))).alias(f"_n{i}") for i in range(len(listed))]
    )
    total = per_event.agg(
        *[F.coalesce(F.sum(f"_n{i}"), F.lit(0)).alias(f"r{i}") for i in range(len(listed))],
        *[F.count(f"_n{i}").alias(f"e{i}") for i in range(len(listed))],
    )
    return total.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(float(t)).alias("threshold"), F.col(f"r{i}").alias("n_rows"), F.col(f"e{i}").alias("n_events")
                    )
                    for i, t in enumerate(listed)
                ]
            )
        )
    )


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop the columns without a single value (one counting pass)."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    return df.select(*[c for c in df.columns if counts[c] > 0])


def in_label_segment(length_us: int, segment_us: int, us: str = "us", event_us: str = "event_us") -> Column:
    half = length_us // 2
    return (F.col(us) >= F.col(event_us) - half) & (F.col(us) <= F.col(event_us) + half - segment_us)


def label_segment_filter(df: DataFrame, length_us: int, segment_us: int, us: str = "us", event_us: str = "event_us") -> DataFrame:
    """Keep rows whose whole feature segment lies inside ±length/2 of the event."""
    return df.filter(in_label_segment(length_us, segment_us, us, event_us))


def label_segment_sweep(
    df: DataFrame,
    lengths_us: Sequence[int],
    segment_us: int,
    label: str = "label",
    event_keys: Sequence[str] = ("device", "event_us"),
    us: str = "us",
    event_us: str = "event_us",
) -> DataFrame:
    """Events per label for each label-segment length.

    An event qualifies from its tightest row on, so each event is reduced to that
    one number before the list of lengths is expanded.
    """
    reach = F.greatest(F.col(event_us) - F.col(us), F.col(us) + segment_us - F.col(event_us))
    need = df.groupBy(*event_keys, label).agg(F.min(reach).alias("_need"))
    lengths = F.array(*[F.lit(x).cast("long") for x in lengths_us])
    return (
        need.withColumn("length_us", F.explode(lengths))
        .filter(F.expr("length_us div 2") >= F.col("_need"))
        .groupBy("length_us", label)
        .agg(F.count("*").alias("n_events"))
    )


def keep_classes(df: DataFrame, classes: Sequence[str], label: str = "label") -> DataFrame:
    return df.filter(F.col(label).isin(*classes))


def min_records_filter(df: DataFrame, min_records: int, keys: Sequence[str] = ("device",)) -> DataFrame:
    """Keep the rows of keys with more than ``min_records`` rows.

    The counts are combined map-side and come back through a semi join, so the
    rows of a large key are not gathered in one window.
    """
    enough = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > min_records)
    return df.join(enough, list(keys), "left_semi")


def sensor_coverage_filter(
    counts: DataFrame,
    hertz: dict[str, float],
    segment_s: float,
    min_percent: float,
    label: str = "label",
    exclude: Sequence[str] = ("exclude",),
) -> DataFrame:
    """Events with enough records of every listed sensor.

    ``counts``: one row per event with one count column per sensor. Counts below
    ``segment · frequency · percent`` become 0 and events with any 0 are dropped.
    """
    labelled = counts.filter(F.col(label).isNotNull() & ~F.col(label).isin(*exclude))
    needed = {s: segment_s * hz * min_percent / 100 for s, hz in hertz.items()}
    cut = labelled.withColumns(
        {s: F.when(F.col(s) < F.lit(n), F.lit(0)).otherwise(F.col(s)).cast("long") for s, n in needed.items()}
    )
    enough: Column = reduce(lambda a, b: a & b, [F.col(s) > 0 for s in hertz])
    return cut.filter(enough)


def cleaning_funnel(
    df: DataFrame,
    steps: Sequence[tuple[str, Column]],
    device: str = "device",
    event_keys: Sequence[str] = ("device", "event_us"),
    start: str = "start",
) -> DataFrame:
    """Participants, events, samples and columns at the start and after each cleaning condition.

    One pass: a row's level is the number of conditions it passes in order; rows are
    counted per event and level, events per participant, and only then per step.
    """
    level = F.lit(0)
    for _, condition in reversed(steps):
        level = F.when(condition, level + 1).otherwise(0)
    numbers = range(len(steps) + 1)
    per_event = df.groupBy(device, *[k for k in event_keys if k != device]).agg(
        *[F.count(F.when(level >= i, 1)).alias(f"s{i}") for i in numbers]
    )
    per_device = per_event.groupBy(device).agg(
        *[F.sum(f"s{i}").alias(f"s{i}") for i in numbers],
        *[F.count(F.when(F.col(f"s{i}") > 0, 1)).alias(f"e{i}") for i in numbers],
    )
    total = per_device.agg(
        *[F.sum(f"s{i}").alias(f"s{i}") for i in numbers],
        *[F.sum(f"e{i}").alias(f"e{i}") for i in numbers],
        *[F.count(F.when(F.col(f"s{i}") > 0, 1)).alias(f"p{i}") for i in numbers],
    )
    cells = [
        F.struct(
            F.lit(i).cast("long").alias("step_no"),
            F.lit(name).alias("step"),
            F.col(f"p{i}").alias("n_participants"),
            F.coalesce(f"e{i}", F.lit(0)).alias("n_events"),
            F.coalesce(f"s{i}", F.lit(0)).alias("n_samples"),
            F.lit(len(df.columns)).cast("long").alias("n_columns"),
        )
        for i, name in enumerate([start, *[n for n, _ in steps]])
    ]
    return total.select(F.inline(F.array(*cells)))
