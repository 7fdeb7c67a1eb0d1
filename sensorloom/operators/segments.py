"""Tumbling segments, movement between fixes, sequences and modal locations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.functions.geo import haversine_m
from sensorloom.functions.scalars import floor_div
from sensorloom.functions.timefn import DAY, SECOND, hour_of
from sensorloom.operators.ordered import SLICE_US, previous_two_rows, row_index

EVENT_KEYS = ("device", "event_us")


def assign_segments(
    rows: DataFrame, segment_us: int, keys: Sequence[str] = EVENT_KEYS, us: str = "us"
) -> DataFrame:
    """Add ``segment`` = floor((ts - first ts of the event) / segment length) for complete segments.

    A segment stays only if its end lies before the event's last record. The
    bounds are combined map-side and joined back, so the rows of an event are not
    gathered in one window. ``rows`` is read twice: hand in a materialised frame
    if it is the result of an expensive join.
    """
    bounds = rows.groupBy(*keys).agg(F.min(us).alias("_t0"), F.max(us).alias("_t1"))
    placed = rows.join(bounds, list(keys)).withColumn("segment", floor_div(F.col(us) - F.col("_t0"), segment_us))
    complete = F.col("_t0") + (F.col("segment") + 1) * F.lit(segment_us).cast("long") < F.col("_t1")
    return placed.filter(complete).drop("_t0", "_t1")


def min_segment_rows(segment_us: int, hertz: float, share: float = 0.7) -> int:
    """Rows a segment must exceed; halves are rounded to even."""
    return round(segment_us / SECOND * hertz * share)


def tumbling_segments(
    rows: DataFrame,
    segment_us: int,
    min_rows: int,
    keys: Sequence[str] = EVENT_KEYS,
    us: str = "us",
) -> DataFrame:
    """Rows of the complete segments that hold more than ``min_rows`` rows."""
    placed = assign_segments(rows, segment_us, keys, us)
    full = placed.groupBy(*keys, "segment").agg(F.count("*").alias("_n")).filter(F.col("_n") > min_rows)
    return placed.join(full, [*keys, "segment"], "left_semi")


def distance_speed_accel(
    fixes: DataFrame,
    keys: Sequence[str] = EVENT_KEYS,
    us: str = "us",
    tie: Sequence[str] = (),
    lat: str = "lat",
    lon: str = "lon",
    metric=haversine_m,
    slice_us: int | None = SLICE_US,
) -> DataFrame:
    """Metres, km/h and km/h per second between successive fixes.

    First fix: distance 0, speed and acceleration NULL; a zero time gap gives NULL.
    """
    steps = previous_two_rows(fixes, [lat, lon], keys, us, tie, slice_us, ("_p", "_q"))

    def gap(later: str, earlier: str) -> Column:
        return (F.col(later) - F.col(earlier)) / F.lit(float(SECOND))

    def metres(a: str, b: str) -> Column:
        return metric(F.col(f"{a}{lat}"), F.col(f"{a}{lon}"), F.col(f"{b}{lat}"), F.col(f"{b}{lon}"))

    speeds = steps.withColumns(
        {
            "_m": metres("_p.", ""),
            "_gap_s": gap(us, f"_p.{us}"),
            "_before": F.try_divide(metres("_q.", "_p."), gap(f"_p.{us}", f"_q.{us}")) * 3.6,
        }
    )
    speed = F.try_divide(F.col("_m"), F.col("_gap_s")) * 3.6
    return speeds.withColumns(
        {
            "distance_m": F.coalesce("_m", F.lit(0.0)),
            "speed_kmh": speed,
            "accel_kmhs": F.try_divide(speed - F.col("_before"), F.col("_gap_s")),
        }
    ).drop("_p", "_q", "_m", "_gap_s", "_before")


def sequence_windows(
    rows: DataFrame,
    columns: Sequence[str],
    label: str,
    length: int,
    step: int,
    keys: Sequence[str] = ("device",),
    us: str = "us",
    tie: Sequence[str] = (),
    include_last: bool = False,
    slice_us: int = SLICE_US,
) -> DataFrame:
    """Fixed-length sequences of ``length`` rows starting every ``step`` rows, with the majority label.

    The last possible start is left out unless ``include_last``. Each output array
    holds exactly ``length`` rows, so group sizes are bounded by the argument.
    """
    indexed = row_index(rows, "_i", keys, us, tie, slice_us)
    totals = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    limit = F.col("_n") - length + (1 if include_last else 0)
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - length + 1) / F.lit(step)))
    last = floor_div(F.col("_i"), step)
    spread = (
        indexed.join(totals, list(keys))
        .filter(last >= first)
        .withColumn("_j", F.explode(F.sequence(first.cast("long"), last)))
        .withColumn("_s", F.col("_j") * step)
        .filter(F.col("_s") < limit)
    )
    return spread.groupBy(*keys, F.col("_s").alias("start_row")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_i", F.array(*columns).alias("v")))), lambda x: x["v"]
        ).alias("sequence"),
        F.expr(f"mode(`{label}`, true)").alias(label),
    )


def modal_location(
    fixes: DataFrame,
    start_hour: int,
    end_hour: int,
    decimals: int = 3,
    device: str = "device",
    us: str = "us",
    lat: str = "lat",
    lon: str = "lon",
) -> DataFrame:
    """Commonest rounded location per (device, date) within the hours ``[start, end)``."""
    hour: Column = hour_of(F.col(us))
    counted = (
        fixes.filter((hour >= start_hour) & (hour < end_hour))
        .groupBy(
            device,
            floor_div(F.col(us), DAY).alias("day"),
            F.round(lat, decimals).alias(lat),
            F.round(lon, decimals).alias(lon),
        )
        .agg(F.count("*").alias("n"))
    )
    w = Window.partitionBy(device, "day").orderBy(F.col("n").desc(), lat, lon)
    return counted.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
