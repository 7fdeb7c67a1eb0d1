"""Stays: runs at one place, with trusted starts and ends."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sensorloom.functions.timefn import MINUTE, SECOND
from sensorloom.operators.ordered import SLICE_US, count_within, run_number, running_sum
from sensorloom.session import materialize


def place_runs(
    rows: DataFrame,
    place: str = "place",
    device: str = "device",
    us: str = "us",
    tie: Sequence[str] = (),
    slice_us: int = SLICE_US,
) -> DataFrame:
    """Add ``run`` = number of the uninterrupted run at one place (a missing place is a run of its own)."""
    return run_number(rows, place, "run", (device,), us, tie, slice_us)


def stays(
    rows: DataFrame,
    hertz: float,
    min_duration_s: float,
    min_fraction: float = 0.5,
    horizon_us: int = MINUTE,
    place: str = "place",
    device: str = "device",
    us: str = "us",
    tie: Sequence[str] = (),
    slice_us: int = SLICE_US,
) -> DataFrame:
    """One row per stay: run, place, bounds, duration, trust of both ends and the stay number.

    A run is a stay when it lasts longer than ``min_duration_s`` and holds the
    wanted fraction of the expected records. An end is trusted when the horizon
    before its first (after its last) record holds that fraction as well.
    """
    runs = place_runs(rows.select(*dict.fromkeys([device, us, place, *tie])), place, device, us, tie, slice_us)
    return _stays_of(runs, hertz, min_duration_s, min_fraction, horizon_us, place, device, us, tie, slice_us).drop("_lo", "_hi")


def _stays_of(runs, hertz, min_duration_s, min_fraction, horizon_us, place, device, us, tie, slice_us) -> DataFrame:
    """Stays of rows that carry a run number, with the order keys of their first and last row."""
    counted = count_within(
        runs.select(*dict.fromkeys([device, us, place, *tie, "run"])), {"_before": (-horizon_us, -1), "_after": (0, horizon_us - 1)}, (device,), us, slice_us
    )
    order = F.struct(us, *tie)
    grouped = counted.groupBy(device, "run").agg(
        F.first(place, ignorenulls=True).alias(place),
        F.min(us).alias("start_us"),
        F.max(us).alias("end_us"),
        F.count("*").alias("n_rows"),
        F.min(F.struct(order.alias("_o"), "_before")).alias("_f"),
        F.max(F.struct(order.alias("_o"), "_after")).alias("_l"),
    )
    grouped = grouped.select(
        "*", F.col("_f._o").alias("_lo"), F.col("_l._o").alias("_hi"), F.col("_f._before").alias("_before"), F.col("_l._after").alias("_after")
    ).drop("_f", "_l")
    seconds = (F.col("end_us") - F.col("start_us")) / F.lit(float(SECOND))
    expected = F.floor(seconds * F.lit(hertz))
    near = math.floor(horizon_us / SECOND * hertz) * min_fraction
    kept = (
        grouped.withColumn("duration_s", seconds)
        .filter((F.col("duration_s") > min_duration_s) & (F.col("n_rows") >= expected * F.lit(min_fraction)))
        .withColumn("start_trusted", F.col("_before") >= F.lit(near))
        .withColumn("end_trusted", F.col("_after") >= F.lit(near))
        .drop("_before", "_after")
    )
    kept = materialize(kept, "stays")  # few rows, numbered in two passes
    one = F.lit(1).cast("long")
    return running_sum(kept, one, "stay_no", (device,), "start_us", ("run",), slice_us)


def stay_records(
    rows: DataFrame,
    hertz: float,
    min_duration_s: float,
    min_fraction: float = 0.5,
    horizon_us: int = MINUTE,
    place: str = "place",
    device: str = "device",
    us: str = "us",
    tie: Sequence[str] = (),
    slice_us: int = SLICE_US,
) -> DataFrame:
    """All rows with stay number, first/last flags, and durations on a stay's last record."""
    runs = place_runs(rows, place, device, us, tie, slice_us)
    found = _stays_of(runs, hertz, min_duration_s, min_fraction, horizon_us, place, device, us, tie, slice_us)
    order = F.struct(us, *tie)
    info = found.select(device, "run", "stay_no", "duration_s", "start_trusted", "end_trusted", "_lo", "_hi")
    joined = runs.join(info, [device, "run"], "left")
    in_stay = F.col("stay_no").isNotNull()
    first, last = in_stay & (order == F.col("_lo")), in_stay & (order == F.col("_hi"))
    both = F.col("start_trusted") & F.col("end_trusted")
    return joined.select(
        *rows.columns,
        F.col("stay_no").alias("stay"),
        first.cast("int").alias("stay_first"),
        last.cast("int").alias("stay_last"),
        F.when(last, F.col("duration_s")).alias("stay_s"),
        (first & F.col("start_trusted")).cast("int").alias("stay_first_trusted"),
        (last & F.col("end_trusted")).cast("int").alias("stay_last_trusted"),
        F.when(last & both, F.col("duration_s")).alias("stay_s_trusted"),
        F.when(both, F.col("stay_no")).alias("stay_trusted"),
    ).na.fill(0, ["stay_first", "stay_last", "stay_first_trusted", "stay_last_trusted"])
