"""Data-quality reports, contingency tables with margins and descriptive summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.functions.scalars import floor_div, one_row, ratio
from sensorloom.functions.timefn import DAY, HOUR, MINUTE, SECOND, hour_of
from sensorloom.operators.quantiles import exact_percentiles

EVENT_KEYS = ("device", "event_us")


# --- data quality -----------------------------------------------------------------------------


def sensor_sanity(
    rows: DataFrame,
    sensors: DataFrame,
    grid: DataFrame | None = None,
    row_columns: Sequence[str] | None = None,
    device: str = "device",
    us: str = "us",
) -> DataFrame:
    """Per (source, sensor, device): duplicates, entries, time range and completeness.

    Exact copies are counted after a map-side combined grouping of whole rows.
    ``grid(source, sensor)`` lists what should exist: a pair without data gives
    one row of -1. ``sensors(sensor, hz)``.
    """
    full = list(row_columns or rows.columns)
    distinct = rows.groupBy(*full).agg(F.count("*").alias("_copies"))
    stats = distinct.groupBy("source", "sensor", device).agg(
        F.sum(F.col("_copies") - 1).alias("duplicates"),
        F.count("*").alias("entries"),
        F.min(us).alias("begin_us"),
        F.max(us).alias("end_us"),
    )
    minutes = (F.col("end_us") - F.col("begin_us")) / F.lit(float(MINUTE))
    out = (
        stats.join(sensors, "sensor", "left")
        .withColumn("minutes", minutes)
        .withColumn("expected", F.col("minutes") * 60 * F.col("hz"))
        .withColumn("completeness", ratio(F.col("entries"), F.col("expected")))
        .select("source", "sensor", device, "duplicates", "entries", "begin_us", "end_us", "minutes", "expected", "completeness")
    )
    if grid is None:
        return out
    types = dict(out.dtypes)
    absent = grid.join(stats.select("source", "sensor").distinct(), ["source", "sensor"], "left_anti").select(
        "source", "sensor", *[F.lit(-1).cast(types[c]).alias(c) for c in out.columns if c not in ("source", "sensor")]
    )
    return out.unionByName(absent)


def sensor_overview(sanity: DataFrame, users: DataFrame, sensors: DataFrame, device: str = "device") -> DataFrame:
    """Full user × sensor grid over all sources; zeros where nothing was recorded.

    Users and sensors are dimensions; the grid is their product by definition.
    """
    merged = sanity.filter(F.col("entries") >= 0).groupBy(device, "sensor").agg(
        F.sum("duplicates").alias("duplicates"),
        F.sum("entries").alias("entries"),
        F.min("begin_us").alias("begin_us"),
        F.max("end_us").alias("end_us"),
    )
    names = F.array_sort(F.collect_list(F.struct("sensor", "hz"))).alias("_sensors")
    listed = sensors.agg(names).scalar()  # one entry per sensor type
    grid = users.select(device).distinct().withColumn("_sensors", listed).select(device, F.inline("_sensors"))
    minutes = F.floor((F.col("end_us") - F.col("begin_us")) / F.lit(float(MINUTE)))
    return (
        grid.join(merged, [device, "sensor"], "left")
        .withColumn("minutes", minutes)
        .na.fill(0, ["duplicates", "entries", "begin_us", "end_us", "minutes"])
        .withColumn("expected", F.col("minutes") * 60 * F.col("hz"))
        .withColumn("completeness", F.coalesce(ratio(F.col("entries"), F.col("expected")), F.lit(0.0)))
    )


def overview_is_consistent(sanity: DataFrame, overview: DataFrame, device: str = "device") -> DataFrame:
    """Whether every recorded (device, sensor) of the sanity report is in the overview: counts of both."""
    recorded = sanity.filter(F.col("entries") >= 0).select(device, "sensor").distinct()
    found = overview.filter(F.col("entries") > 0).agg(F.count("*")).scalar()
    counts = recorded.agg(F.count("*").alias("n_recorded")).withColumn("n_overview", found)
    return counts.withColumn("consistent", F.col("n_recorded") == F.col("n_overview"))


# --- events × sensors -------------------------------------------------------------------------


def event_sensor_volume(
    events: DataFrame,
    joined: DataFrame,
    sensors: Sequence[str],
    half_us: int,
    conditions: dict[str, Column] | None = None,
    keys: Sequence[str] = EVENT_KEYS,
    us: str = "us",
) -> DataFrame:
    """Records per event and sensor within ± ``half_us``; an extra condition may apply per sensor."""
    near = F.abs(F.col(us) - F.col(keys[-1])) <= half_us
    extra = conditions or {}
    counts = joined.filter(near).groupBy(*keys).agg(
        *[F.count(F.when((F.col("sensor") == s) & extra.get(s, F.lit(True)), 1)).alias(s) for s in sensors]
    )
    return events.select(*keys).distinct().join(counts, list(keys), "left").na.fill(0, list(sensors))


def event_sensor_volume_total(volume: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Events with at least one record, per sensor."""
    return volume.agg(*[F.count(F.when(F.col(s) > 0, 1)).alias(s) for s in sensors])


def event_summary_stats(
    joined: DataFrame, statistics: dict[str, Sequence[str]], keys: Sequence[str] = EVENT_KEYS
) -> DataFrame:
    """Per event the wanted statistics (``mean``, ``std`` sample, ``max``) of each column."""
    build = {"mean": F.avg, "std": F.stddev_samp, "max": F.max}
    return joined.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), *[build[s](c).alias(f"{c}_{s}") for c, wanted in statistics.items() for s in wanted]
    )


def events_missing_data(events: DataFrame, joined: DataFrame, keys: Sequence[str] = EVENT_KEYS) -> DataFrame:
    """Events without a single record."""
    return events.select(*keys).distinct().join(joined.select(*keys), list(keys), "left_anti")


def event_trace(joined: DataFrame, half_us: int, columns: Sequence[str], keys: Sequence[str] = EVENT_KEYS, us: str = "us") -> DataFrame:
    """Rows of all sensors aligned to their event: seconds relative to it within ± ``half_us``."""
    offset = F.col(us) - F.col(keys[-1])
    return joined.filter(F.abs(offset) <= half_us).select(
        *keys, (offset / F.lit(float(SECOND))).alias("seconds"), *columns
    )


# --- contingency tables -----------------------------------------------------------------------


def contingency_margins(
    df: DataFrame, row: str, column: str, values: Sequence, scale: float | None = None, decimals: int | None = None
) -> DataFrame:
    """Counts of ``row`` × ``column`` with a total column and a total row.

    One grouped pass; the totals come from the few grouped cells. With ``scale``
    every cell is multiplied (and rounded) before the totals are taken. Values that
    are not listed have no column but count in the totals.
    """
    known = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = known.groupBy(F.col(row).cast("string").alias(row)).agg(
        *[F.count(F.when(F.col(column) == v, 1)).alias(str(v)) for v in values],
        F.count(F.when(~F.col(column).isin(list(values)), 1)).alias("_other"),
    )
    names = [*[str(v) for v in values], "_other"]
    if scale is not None:
        scaled = {n: F.col(f"`{n}`") * F.lit(scale) for n in names}
        if decimals is not None:
            scaled = {n: F.round(c, decimals) for n, c in scaled.items()}
        cells = cells.withColumns(scaled)
    cells = cells.withColumn("total", reduce(lambda a, b: a + b, [F.col(f"`{n}`") for n in names]))
    totals = cells.agg(F.lit("total").alias(row), *[F.sum(f"`{n}`").alias(n) for n in [*names, "total"]])
    return cells.unionByName(totals).drop("_other")


def user_class_counts(
    events: DataFrame, classes: Sequence[str], cities: DataFrame | None = None, device: str = "device", label: str = "label"
) -> DataFrame:
    """Events per user and class with totals; optionally the user's city ``cities(device, city)``."""
    table = contingency_margins(events, device, label, classes)
    return table if cities is None else _with_city(table, cities, device)


def user_class_minutes(
    events: DataFrame,
    classes: Sequence[str],
    event_seconds: float,
    cities: DataFrame | None = None,
    device: str = "device",
    label: str = "label",
) -> DataFrame:
    """As ``user_class_counts`` in minutes: events × event length / 60, one decimal."""
    table = contingency_margins(events, device, label, classes, event_seconds / 60, 1)
    return table if cities is None else _with_city(table, cities, device)


def _with_city(table: DataFrame, cities: DataFrame, device: str) -> DataFrame:
    dim = cities.groupBy(F.col(device).cast("string").alias(device)).agg(F.min("city").alias("city"))
    return table.join(dim, device, "left")


# --- value counts -----------------------------------------------------------------------------


def value_counts_topn(df: DataFrame, column: str, n: int, factor: float = 1.0, above: int = 0) -> DataFrame:
    """The ``n`` commonest values (ties by value) with count and count × factor, if above a limit."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > above)
        .orderBy(F.col("n").desc(), "value")
        .limit(n)
        .withColumn("scaled", F.col("n") * F.lit(float(factor)))
    )


def answer_distribution(df: DataFrame, columns: Sequence[str], above: int) -> DataFrame:
    """Per question: answers given, answers whose value is chosen more than ``above`` times, and their share."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("question"), F.col(c).cast("string").alias("value")) for c in columns])))
    counts = long.filter("value IS NOT NULL").groupBy("question", "value").agg(F.count("*").alias("_n"))
    return (
        counts.groupBy("question")
        .agg(F.sum("_n").alias("n_answers"), F.coalesce(F.sum(F.when(F.col("_n") > above, F.col("_n"))), F.lit(0)).alias("n_above"))
        .withColumn("share_above", ratio(F.col("n_above"), F.col("n_answers")))
    )


def non_null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null values per column, one pass."""
    one = df.agg(*[F.count(c).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "n_values")


def participant_overview(events: DataFrame, users: DataFrame, device: str = "device", event_us: str = "event_us") -> DataFrame:
    """Events and recording duration per participant; durations of a participant's devices are summed."""
    per_device = events.groupBy(device).agg(
        F.count("*").alias("_n"), F.min(event_us).alias("_first"), F.max(event_us).alias("_last")
    )
    span = F.col("_last") - F.col("_first")
    hours = F.col("duration_us") / F.lit(float(HOUR))
    return (
        per_device.join(users.select(device, "new_id", "city"), device, "left")
        .groupBy(F.coalesce("new_id", device).alias("participant"), "city")
        .agg(
            F.sum("_n").alias("n_events"),
            F.min("_first").alias("first_us"),
            F.max("_last").alias("last_us"),
            F.sum(span).alias("duration_us"),
        )
        .withColumns({"duration_hours": F.round(hours, 1), "duration_days": F.round(hours / 24, 1)})
    )


# --- distributions ----------------------------------------------------------------------------


def quantile_limits(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.01, 0.99), keys: Sequence[str] = ()
) -> DataFrame:
    """Axis limits: exact quantiles per column, overall or per event."""
    q = exact_percentiles(df, columns, probs, keys)
    return q.select(
        *keys, *[F.col(f"{c}_q")[i].alias(f"{c}_{round(p * 100):02d}") for c in columns for i, p in enumerate(probs)]
    )


def point_occurrence(df: DataFrame, x: str, y: str, decimals: int | None = None) -> DataFrame:
    """Records per point and the largest such count."""
    def at(c: str) -> Column:
        return (F.col(c) if decimals is None else F.round(c, decimals)).alias(c)

    counts = df.groupBy(at(x), at(y)).agg(F.count("*").alias("n"))
    return counts.withColumn("n_max", counts.agg(F.max("n")).scalar())


def static_start_histogram(periods: DataFrame, start_us: str = "start_us") -> DataFrame:
    return periods.groupBy(hour_of(F.col(start_us)).alias("hour")).agg(F.count("*").alias("n_periods"))


def distance_histogram(df: DataFrame, column: str, low: int, high: int, width: int) -> DataFrame:
    """Counts per bin ``[low + i·width, low + (i+1)·width)``."""
    inside = df.filter((F.col(column) >= low) & (F.col(column) < high))
    edge = (F.floor((F.col(column) - low) / width) * width + low).cast("long")
    return inside.groupBy(edge.alias("bin_start")).agg(F.count("*").alias("n"))


def static_period_coverage(rows: DataFrame, target: Sequence[str], label: str = "label") -> DataFrame:
    """Share of target and of other records that have a static period near."""
    near = F.col("static_start_minutes").isNotNull() | F.col("static_end_minutes").isNotNull()
    return rows.filter(F.col(label).isNotNull()).groupBy(F.col(label).isin(*target).alias("is_target")).agg(
        F.count("*").alias("n_rows"), F.avg(near.cast("double")).alias("share_near")
    )


def days_with_data(rows: DataFrame, min_rows: int, device: str = "device", us: str = "us") -> DataFrame:
    """Days with at least ``min_rows`` records per device."""
    per_day = rows.groupBy(device, floor_div(F.col(us), DAY).alias("_day")).agg(F.count("*").alias("_n"))
    return per_day.groupBy(device).agg(F.count(F.when(F.col("_n") >= min_rows, 1)).alias("n_days"))


def clusters_for_coverage(
    rows: DataFrame, share: float = 0.9, big_above: int = 10_800, device: str = "device", place: str = "place"
) -> DataFrame:
    """Places per device, places needed to cover a share of the records, and places above a size."""
    sizes = rows.groupBy(device, place).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(device)
    running = whole.orderBy(F.col("_n").desc(), place).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(running), F.lit(0))
    return (
        sizes.withColumn("_needed", before < F.sum("_n").over(whole) * F.lit(share))
        .groupBy(device)
        .agg(
            F.count("*").alias("n_places"),
            F.count(F.when(F.col("_needed"), 1)).alias("n_for_coverage"),
            F.count(F.when(F.col("_n") > big_above, 1)).alias("n_big"),
        )
    )


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    basics = df.agg(
        *[
            F.struct(
                F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")
            ).alias(c)
            for c in columns
        ]
    )
    quartiles = one_row(exact_percentiles(df, columns, [0.25, 0.5, 0.75]))
    both = basics.withColumn("_q", quartiles)
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(c)["n"].alias("n"),
            F.col(c)["mean"].alias("mean"),
            F.col(c)["std"].alias("std"),
            F.col(c)["min"].cast("double").alias("min"),
            *[F.col("_q")[f"{c}_q"][i].alias(f"q{q}") for i, q in enumerate((25, 50, 75))],
            F.col(c)["max"].cast("double").alias("max"),
        )
        for c in columns
    ]
    return both.select(F.inline(F.array(*cells)))
