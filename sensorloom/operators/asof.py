"""As-of joins, session bounds and nearest-record lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.functions.scalars import ratio
from sensorloom.functions.timefn import MINUTE, SECOND
from sensorloom.session import materialize
from sensorloom.operators.ordered import SLICE_US, choose_slice, sides_unbounded, sides_within


def _closest(us: Column, lower: int, upper: int) -> Column:
    """The nearer of ``_prev`` and ``_next``; at equal gaps the earlier one."""
    gap_prev = us - F.col("_prev.us")
    gap_next = F.col("_next.us") - us
    use_next = F.col("_prev").isNull() | (gap_next < gap_prev)
    return F.when(F.col("_next").isNotNull() & use_next, F.col("_next")).otherwise(F.col("_prev"))


def measured_slice(frames: Sequence[DataFrame], reach: int, keys: Sequence[str], us: str) -> int:
    """The widest slice whose fullest part stays small, over the times of all frames; no finer than the reach or a second.

    A busy hour of one key is split by it, and a quiet table is not cut at all.
    """
    times = reduce(DataFrame.unionByName, [f.select(*keys, us) for f in frames])
    return choose_slice(times, keys, us, finest=max(reach, SECOND))


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    payload: Sequence[str],
    before: int,
    after: int,
    keys: Sequence[str] = ("device",),
    us: str = "us",
    tie: Sequence[str] = (),
    prefix: str = "",
    slice_us: int | None = None,
) -> DataFrame:
    """Each left row with the payload of the nearest right row in ``[us - before, us + after]``.

    Adds ``<prefix>matched_us``. Unmatched left rows keep NULLs. Slices are measured unless given.
    """
    slice_us = slice_us or measured_slice([left, right], max(before, after), keys, us)
    sides = sides_within(left, right, payload, before, after, keys, us, tie, slice_us)
    hit = sides.withColumn("_hit", _closest(F.col(us), before, after)).drop("_prev", "_next")
    return hit.select(
        *left.columns,
        F.col("_hit.us").alias(f"{prefix}matched_us"),
        *[F.col(f"_hit.{c}").alias(f"{prefix}{c}") for c in payload],
    )


def asof_nearest_merge(
    left: DataFrame,
    right: DataFrame,
    payload: Sequence[str],
    tolerance: int,
    prefix: str,
    keys: Sequence[str] = ("device",),
    us: str = "us",
    event_us: str = "event_us",
    tie: Sequence[str] = (),
    slice_us: int | None = None,
) -> DataFrame:
    """Full-outer nearest merge within a tolerance.

    Right rows whose time was not taken by any left row are appended with their
    own time, key and event time. The matches feed both the result and the search for
    unmatched rows, so they are written once; a fold over many sensors stays linear.
    """
    slice_us = slice_us or measured_slice([left, right], tolerance, keys, us)
    carried = [*payload, event_us]
    matched = materialize(
        asof_nearest(left, right, carried, tolerance, tolerance, keys, us, tie, "_m_", slice_us), "merged"
    )
    head = [c for c in left.columns if c != event_us]
    main = matched.select(
        *head,
        F.coalesce(event_us, f"_m_{event_us}").alias(event_us),
        F.col("_m_matched_us").alias(f"{prefix}timestamp_merged"),
        *[F.col(f"_m_{c}").alias(f"{prefix}{c}") for c in payload],
    )
    taken = (
        matched.filter(F.col("_m_matched_us").isNotNull())
        .select(*keys, F.col("_m_matched_us").alias(us))
        .distinct()
    )
    rest = right.join(taken, [*keys, us], "left_anti").select(
        *keys,
        us,
        event_us,
        F.col(us).alias(f"{prefix}timestamp_merged"),
        *[F.col(c).alias(f"{prefix}{c}") for c in payload],
    )
    return main.unionByName(rest, allowMissingColumns=True)


def asof_multi_sensor_merge(
    base: DataFrame,
    others: Sequence[tuple[str, DataFrame, Sequence[str]]],
    tolerance: int,
    keys: Sequence[str] = ("device",),
    tie: Sequence[str] = (),
    slice_us: int | None = None,
) -> DataFrame:
    """Fold several sensors ``(prefix, frame, payload)`` into one series by full-outer nearest merges."""
    slice_us = slice_us or measured_slice([base, *(frame for _, frame, _ in others)], tolerance, keys, "us")
    out = base
    for prefix, frame, payload in others:
        out = asof_nearest_merge(out, frame, payload, tolerance, prefix, keys, tie=tie, slice_us=slice_us)
    return out


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    payload: Sequence[str],
    tolerance: int = 100_000,
    keys: Sequence[str] = ("device", "event_us"),
    us: str = "us",
    tie: Sequence[str] = (),
    prefix: str = "",
    slice_us: int | None = None,
) -> DataFrame:
    """Each left row with the last right row of the same key at most ``tolerance`` earlier."""
    return asof_nearest(left, right, payload, tolerance, 0, keys, us, tie, prefix, slice_us)


def session_bounds(
    events: DataFrame,
    screen: DataFrame,
    unlock: int = 3,
    device: str = "device",
    event_us: str = "event_us",
    answer_us: str | None = None,
    slice_us: int = SLICE_US,
) -> DataFrame:
    """Last unlock at/before and first unlock at/after each event, and the seconds between them.

    Where ``answer_us`` is given and set, it replaces the event time as the
    reference point. A missing side stays NULL.
    """
    point = F.col(event_us) if answer_us is None else F.coalesce(answer_us, event_us)
    unlocks = screen.filter(F.col("status") == unlock).select(F.col(device), F.col("us"))
    found = sides_unbounded(events.withColumn("us", point), unlocks, [], keys=(device,), slice_us=slice_us)
    start, end = F.col("_prev.us"), F.col("_next.us")
    return found.select(
        *events.columns,
        start.alias("session_start"),
        end.alias("session_end"),
        ((end - start) / F.lit(float(SECOND))).alias("session_s"),
    )


def _session_keep(us: str, event_us: str, reach: int) -> tuple[Column, Column]:
    start, end, event = F.col("session_start"), F.col("session_end"), F.col(event_us)
    covers_all = (event - start >= reach) & (end - event >= reach)
    unknown = start.isNull() | end.isNull()
    keep = unknown | covers_all | F.col(us).between(start, end)
    return keep, unknown | covers_all


def clip_to_session(
    rows: DataFrame,
    sessions: DataFrame,
    reach: int = 5 * MINUTE,
    keys: Sequence[str] = ("device", "event_us"),
    us: str = "us",
) -> DataFrame:
    """Keep a row when its event's session holds it, has an unknown bound, or spans ± ``reach``."""
    event_us = keys[-1]
    bounds = sessions.select(*keys, "session_start", "session_end").dropDuplicates(list(keys))
    keep, _ = _session_keep(us, event_us, reach)
    return rows.join(bounds, list(keys), "left").filter(keep).select(*rows.columns)


def clip_report(
    rows: DataFrame,
    sessions: DataFrame,
    frequency: float,
    reach: int = 5 * MINUTE,
    keys: Sequence[str] = ("device", "event_us"),
    us: str = "us",
) -> DataFrame:
    """Per clipped event: rows before, rows deleted, expected deletions and percent of expected."""
    event_us = keys[-1]
    bounds = sessions.select(*keys, "session_start", "session_end").dropDuplicates(list(keys))
    keep, untouched = _session_keep(us, event_us, reach)
    per_event = (
        rows.join(bounds, list(keys), "left")
        .filter(~untouched)
        .groupBy(*keys, "session_start", "session_end")
        .agg(F.count("*").alias("n_rows"), F.count(F.when(~keep, 1)).alias("n_deleted"))
    )
    event = F.col(event_us)
    kept_span = F.least(event - F.col("session_start"), F.lit(reach)) + F.least(
        F.col("session_end") - event, F.lit(reach)
    )
    expected = (F.lit(2 * reach) - kept_span) / F.lit(float(SECOND)) * F.lit(float(frequency))
    return per_event.select(
        *keys,
        "n_rows",
        "n_deleted",
        expected.alias("expected_deleted"),
        (ratio(F.col("n_deleted"), expected) * 100).alias("percent_of_expected"),
    )


def nearest_static_period(
    rows: DataFrame,
    periods: DataFrame,
    threshold: int,
    device: str = "device",
    us: str = "us",
    slice_us: int = SLICE_US,
) -> DataFrame:
    """Signed minutes to the nearest static-period start (start - ts) and end (ts - end).

    NULL when the gap is not below ``threshold``. ``periods(device, start_us, end_us)``.
    """
    reach = threshold - 1  # strictly below
    out = rows
    for side, sign in (("start", 1), ("end", -1)):
        marks = periods.select(F.col(device), F.col(f"{side}_us").alias(us))
        out = asof_nearest(out, marks, [], reach, reach, (device,), us, prefix="_s_", slice_us=slice_us)
        gap = (F.col("_s_matched_us") - F.col(us)) * sign
        out = out.withColumn(f"static_{side}_minutes", gap / F.lit(float(MINUTE))).drop("_s_matched_us")
    return out


def first_after_event(
    rows: DataFrame, keys: Sequence[str] = ("device", "event_us"), us: str = "us", tie: Sequence[str] = ()
) -> DataFrame:
    """First record at/after each event (one candidate per key leaves each input partition)."""
    w = Window.partitionBy(*keys).orderBy(us, *tie)
    after = rows.filter(F.col(us) >= F.col(keys[-1]))
    return after.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def nearest_to_event(
    rows: DataFrame,
    keys: Sequence[str] = ("device", "event_us"),
    us: str = "us",
    tie: Sequence[str] = (),
    label: str | None = None,
) -> DataFrame:
    """Record closest in time to its event, with the event's date and time of day; unlabelled rows are skipped."""
    event_us = keys[-1]
    base = rows if label is None else rows.filter(F.col(label).isNotNull())
    w = Window.partitionBy(*keys).orderBy(F.abs(F.col(us) - F.col(event_us)), us, *tie)
    ts = F.timestamp_micros(event_us)
    return (
        base.withColumn("_rn", F.row_number().over(w))
        .filter("_rn = 1")
        .drop("_rn")
        .withColumns({"event_date": F.date_format(ts, "yyyy-MM-dd"), "event_time": F.date_format(ts, "HH:mm:ss")})
    )


def label_lookup(
    rows: DataFrame, labels: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("device", "event_us")
) -> DataFrame:
    """Attach label columns by event key; an event without entry gets NULL."""
    return rows.join(labels.select(*keys, *columns), list(keys), "left")


def feature_rejoin(
    rows: DataFrame, features: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("device", "us")
) -> DataFrame:
    """Attach feature columns by exact (device, time); rows without features go."""
    return rows.join(features.select(*keys, *columns), list(keys), "inner")
