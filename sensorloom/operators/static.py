"""Static periods from sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.functions.scalars import floor_div, ratio


def _bins(rows: DataFrame, step_us: int, extra: list[Column], aggregates: list[Column], device: str, us: str) -> DataFrame:
    """Pre-aggregate rows to step-wide bins anchored at the device's first record."""
    bounds = rows.groupBy(device).agg(F.min(us).alias("_t0"), F.max(us).alias("_t1"))
    return (
        rows.join(bounds, device)
        .groupBy(device, "_t0", "_t1", floor_div(F.col(us) - F.col("_t0"), step_us).alias("_bin"), *extra)
        .agg(*aggregates)
    )


def _to_windows(bins: DataFrame, size_us: int, step_us: int) -> DataFrame:
    """Copy each bin to the windows it belongs to; keep windows that end before the last record."""
    if size_us % step_us:
        raise ValueError("the window size must be a multiple of the step")
    span = size_us // step_us
    first = F.greatest(F.lit(0).cast("long"), F.col("_bin") - (span - 1))
    return (
        bins.withColumn("_w", F.explode(F.sequence(first, F.col("_bin"))))
        .withColumn("start_us", F.col("_t0") + F.col("_w") * F.lit(step_us).cast("long"))
        .withColumn("end_us", F.col("start_us") + F.lit(size_us).cast("long"))
        .filter(F.col("end_us") < F.col("_t1"))
    )


def _judge(windows: DataFrame, expected: float, min_expected: float, min_static: float, device: str) -> DataFrame:
    actual, static = F.col("actual"), F.col("static")
    flagged = (actual >= F.lit(expected * min_expected)) & (static >= actual * F.lit(min_static))
    return windows.select(
        device,
        "start_us",
        "end_us",
        "actual",
        F.lit(float(expected)).alias("expected"),
        ratio(actual, F.lit(expected)).alias("share_expected"),
        "static",
        ratio(static, actual).alias("share_static"),
        flagged.alias("is_static"),
    )


def static_windows(
    rows: DataFrame,
    value: str,
    threshold: float,
    size_us: int,
    step_us: int,
    expected: float,
    min_expected: float = 0.75,
    min_static: float = 0.999,
    device: str = "device",
    us: str = "us",
) -> DataFrame:
    """Every non-empty sliding window with its record counts and the static flag.

    Rows are first reduced to one record per step; a window is then the sum of
    its bins, so the rows themselves are shuffled once and never multiplied.
    """
    aggregates = [F.count("*").alias("_n"), F.count(F.when(F.col(value) < threshold, 1)).alias("_s")]
    windows = (
        _to_windows(_bins(rows, step_us, [], aggregates, device, us), size_us, step_us)
        .groupBy(device, "start_us", "end_us")
        .agg(F.sum("_n").alias("actual"), F.sum("_s").alias("static"))
    )
    return _judge(windows, expected, min_expected, min_static, device)


def static_windows_topk(
    rows: DataFrame,
    value: str,
    size_us: int,
    step_us: int,
    expected: float,
    min_expected: float = 0.75,
    min_static: float = 0.99,
    k: int = 10,
    decimals: int = 3,
    device: str = "device",
    us: str = "us",
) -> DataFrame:
    """Variant whose static count is that of the ``k`` commonest rounded values of the window."""
    rounded = F.round(value, decimals).alias("_v")
    bins = _bins(rows, step_us, [rounded], [F.count("*").alias("_n")], device, us)
    keys = [device, "start_us", "end_us"]
    counted = _to_windows(bins, size_us, step_us).groupBy(*keys, "_v").agg(F.sum("_n").alias("_n"))
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_n").desc(), "_v"))
    top = counted.withColumn("_rn", ranked).filter(F.col("_rn") <= k).groupBy(*keys).agg(F.sum("_n").alias("static"))
    total = counted.groupBy(*keys).agg(F.sum("_n").alias("actual"))
    return _judge(total.join(top, keys), expected, min_expected, min_static, device)


def static_periods(windows: DataFrame, device: str = "device") -> DataFrame:
    """Merge flagged windows that overlap (next start before the running end) into periods.

    Works on windows, whose number per device is bounded by the time span over the step.
    """
    flagged = windows.filter("is_static")
    earlier = Window.partitionBy(device).orderBy("start_us", "end_us").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(device).orderBy("start_us", "end_us").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.col("start_us") < F.max("end_us").over(earlier), 0).otherwise(1)
    merged = (
        flagged.withColumn("_open", opens)
        .withColumn("_period", F.sum("_open").over(upto))
        .groupBy(device, "_period")
        .agg(
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.sum("actual").alias("actual"),
            F.sum("expected").alias("expected"),
            F.sum("static").alias("static"),
        )
    )
    return merged.select(
        device,
        "start_us",
        "end_us",
        (F.col("end_us") - F.col("start_us")).alias("duration_us"),
        "actual",
        "expected",
        ratio(F.col("actual"), F.col("expected")).alias("share_expected"),
        "static",
        ratio(F.col("static"), F.col("actual")).alias("share_static"),
    )
