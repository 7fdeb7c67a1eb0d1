"""Ordered scans that never put a whole device into one task.

A plain ``Window.partitionBy(device)`` sends every row of a device to one task,
which fails once a single device holds a large part of the data. The
helpers here cut each device's timeline into slices of fixed width and work on
``(device, slice)``; what has to cross a slice border travels in one of two ways:

* **halo** - rows within a bounded reach of the border are copied to the
  neighbouring slice (one shuffle, used when there is a tolerance);
* **carry** - one summary row per non-empty slice is scanned per device and
  joined back (used for unbounded look-back, running sums and run numbers). The
  number of summary rows depends on the time span, not on the number of rows.

The slice width never changes a result. ``choose_slice`` picks it from the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.functions.scalars import floor_div
from sensorloom.functions.timefn import DAY, HOUR, MINUTE

SLICE = "_slice"
PART = "_part"

# Default slice: at sensor rates an hour holds tens of thousands of rows, and a device that
# owns a third of all data still spreads over thousands of tasks. ``choose_slice`` measures instead.
SLICE_US = HOUR
#: Rows of a key that one slice holds where the width is measured.
TARGET_ROWS = 2_000_000


def choose_slice(
    df: DataFrame, keys: Sequence[str] = ("device",), us: str = "us", target_rows: int | None = None, finest: int = MINUTE
) -> int:
    """The widest slice (``finest`` times a power of two, at most 4096 days) whose fullest
    ``(keys, slice)`` holds at most ``target_rows`` (``TARGET_ROWS``) rows.

    One aggregation pass; only one number per width reaches the driver.
    """
    cells = df.groupBy(*keys, floor_div(F.col(us), finest).alias("_cell")).agg(F.count("*").alias("_n"))
    widths = [finest]
    while widths[-1] * 2 <= 4096 * DAY:
        widths.append(widths[-1] * 2)
    levels = (
        cells.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(len(widths) - 1))))
        .groupBy(*keys, "_level", F.expr("shiftright(_cell, _level)").alias("_c"))
        .agg(F.sum("_n").alias("_n"))
        .groupBy("_level")
        .agg(F.max("_n").alias("_n"))
        .filter(F.col("_n") <= (target_rows or TARGET_ROWS))
        .agg(F.max("_level").alias("_level"))
    )
    level = levels.first()["_level"]
    return widths[level or 0]


def with_slice(df: DataFrame, us: str = "us", slice_us: int = DAY, keys: Sequence[str] | None = None) -> DataFrame:
    """Add the slice number and, with ``keys``, the partition key ``_part`` = struct of keys and slice.

    As a struct the partition key is never NULL and compares NULL fields as equal,
    so the carry join reuses the window's shuffle and still serves NULL keys.
    """
    out = df.withColumn(SLICE, floor_div(F.col(us), slice_us))
    return out if keys is None else out.withColumn(PART, F.struct(*keys, SLICE))


def with_halo(df: DataFrame, before: int, after: int, us: str = "us", slice_us: int = SLICE_US) -> DataFrame:
    """Copy each row to every slice it can be seen from.

    ``before`` / ``after``: how far a reader looks back / ahead. The copy in the
    row's own slice has ``_home`` = true.
    """
    at = F.col(us)
    return (
        df.withColumn(
            SLICE,
            F.explode(F.sequence(floor_div(at - F.lit(after), slice_us), floor_div(at + F.lit(before), slice_us))),
        )
        .withColumn("_home", F.col(SLICE) == floor_div(at, slice_us))
    )


def _carry(
    df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column], scans: dict[str, Column]
) -> DataFrame:
    """One row per (keys, slice): aggregate, then scan along the slices of a key.

    Grouping includes the partition key, so rows already shuffled by it stay in place.
    """
    per_slice = df.groupBy(PART, *keys, SLICE).agg(*[c.alias(n) for n, c in aggregates.items()])
    return per_slice.select(*keys, SLICE, *[c.alias(n) for n, c in scans.items()])


def _attach(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join the carried values back on the partition key the rows are already shuffled by."""
    values = [c for c in carry.columns if c not in keys and c != SLICE]
    summary = carry.select(F.struct(*keys, SLICE).alias("_of"), *values)
    return df.join(summary, F.col(PART) == F.col("_of"), "left").drop("_of")


def _values(columns: Sequence[str], us: str, tie: Sequence[str]) -> Column:
    return F.struct(*dict.fromkeys([us, *tie, *columns]))


def previous_row(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = ("device",),
    us: str = "us",
    tie: Sequence[str] = (),
    slice_us: int | None = SLICE_US,
    into: str = "_prev",
) -> DataFrame:
    """Add ``into`` = struct of time and ``columns`` of the preceding row of the key (NULL at the first).

    ``slice_us`` = None here and below: one plain window, for keys known to be small.
    """
    values = _values(columns, us, tie)
    if slice_us is None:
        return df.withColumn(into, F.lag(values).over(Window.partitionBy(*keys).orderBy(us, *tie)))
    sliced = with_slice(df, us, slice_us, keys)
    local = Window.partitionBy(PART).orderBy(us, *tie)
    along = Window.partitionBy(*keys).orderBy(SLICE)
    carry = _carry(sliced, keys, {"_last": F.max(values)}, {"_from_before": F.lag("_last").over(along)})
    out = _attach(sliced.withColumn(into, F.lag(values).over(local)), carry, keys)
    return out.withColumn(into, F.coalesce(into, "_from_before")).drop("_from_before", SLICE, PART)


def previous_two_rows(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = ("device",),
    us: str = "us",
    tie: Sequence[str] = (),
    slice_us: int | None = SLICE_US,
    into: tuple[str, str] = ("_prev1", "_prev2"),
) -> DataFrame:
    """Add the structs of the preceding row and of the one before it, in a single scan."""
    one, two = into
    values = _values(columns, us, tie)
    if slice_us is None:
        w = Window.partitionBy(*keys).orderBy(us, *tie)
        return df.withColumns({one: F.lag(values).over(w), two: F.lag(values, 2).over(w)})
    sliced = with_slice(df, us, slice_us, keys)
    local = Window.partitionBy(PART).orderBy(us, *tie)
    along = Window.partitionBy(*keys).orderBy(SLICE)
    stepped = sliced.withColumns({one: F.lag(values).over(local), two: F.lag(values, 2).over(local)})
    carry = _carry(
        stepped.select(PART, *keys, SLICE, values.alias("_v"), one),
        keys,
        {"_last": F.max(F.struct("_v", F.col(one).alias("_p")))},
        {
            "_c1": F.lag("_last._v").over(along),
            "_c2": F.coalesce(F.lag("_last._p").over(along), F.lag("_last._v", 2).over(along)),
        },
    )
    out = _attach(stepped, carry, keys)
    return out.withColumns(
        {
            two: F.coalesce(two, F.when(F.col(one).isNotNull(), F.col("_c1")).otherwise(F.col("_c2"))),
            one: F.coalesce(one, "_c1"),
        }
    ).drop("_c1", "_c2", SLICE, PART)


def running_sum(
    df: DataFrame,
    value: Column,
    into: str,
    keys: Sequence[str] = ("device",),
    us: str = "us",
    tie: Sequence[str] = (),
    slice_us: int | None = SLICE_US,
) -> DataFrame:
    """Add ``into`` = inclusive running sum of a LONG ``value`` along the key's timeline."""
    if slice_us is None:
        whole = Window.partitionBy(*keys).orderBy(us, *tie).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(into, F.sum(value).over(whole))
    sliced = with_slice(df, us, slice_us, keys).withColumn("_v", value)
    local = Window.partitionBy(PART).orderBy(us, *tie).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = _carry(sliced, keys, {"_s": F.sum("_v")}, {"_offset": F.sum("_s").over(before)})
    out = _attach(sliced.withColumn(into, F.sum("_v").over(local)), carry, keys)
    return out.withColumn(into, F.col(into) + F.coalesce("_offset", F.lit(0))).drop("_offset", "_v", SLICE, PART)


def row_index(
    df: DataFrame,
    into: str,
    keys: Sequence[str] = ("device",),
    us: str = "us",
    tie: Sequence[str] = (),
    slice_us: int | None = SLICE_US,
) -> DataFrame:
    """Add ``into`` = 0-based position of the row on the key's timeline."""
    return running_sum(df, F.lit(1).cast("long"), into, keys, us, tie, slice_us).withColumn(into, F.col(into) - 1)


def run_number(
    df: DataFrame,
    value: str,
    into: str,
    keys: Sequence[str] = ("device",),
    us: str = "us",
    tie: Sequence[str] = (),
    slice_us: int | None = SLICE_US,
) -> DataFrame:
    """Add ``into`` = number of the uninterrupted run of equal values (each NULL is a run of its own).

    One window per slice finds the changes inside it; the per-slice summary (first
    and last value, number of changes) settles the changes at the borders.
    """
    part = [*keys] if slice_us is None else [PART]
    base = df if slice_us is None else with_slice(df, us, slice_us, keys)
    local = Window.partitionBy(*part).orderBy(us, *tie)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    same = F.coalesce(F.lag(value).over(local) == F.col(value), F.lit(False))
    changed = F.when(F.row_number().over(local) == 1, 0).when(same, 0).otherwise(1).cast("long")
    marked = base.withColumn("_new", changed)
    if slice_us is None:
        return marked.withColumn(into, F.sum("_new").over(upto) + 1).drop("_new")
    entry = F.struct(us, *tie, F.col(value).alias("_val"))
    along = Window.partitionBy(*keys).orderBy(SLICE)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    per_slice = marked.groupBy(PART, *keys, SLICE).agg(
        F.min(entry)["_val"].alias("_first"), F.max(entry)["_val"].alias("_last"), F.sum("_new").alias("_changes")
    )
    opens = F.when(F.lag("_last").over(along) == F.col("_first"), 0).otherwise(1)
    carry = per_slice.withColumn("_open", opens).select(
        *keys,
        SLICE,
        (F.coalesce(F.sum(F.col("_changes") + F.col("_open")).over(before), F.lit(0)) + F.col("_open")).alias("_offset"),
    )
    out = _attach(marked.withColumn(into, F.sum("_new").over(upto)), carry, keys)
    return out.withColumn(into, F.col(into) + F.col("_offset")).drop("_new", "_offset", SLICE, PART)


def count_within(
    df: DataFrame,
    windows: dict[str, tuple[int, int]],
    keys: Sequence[str] = ("device",),
    us: str = "us",
    slice_us: int = SLICE_US,
) -> DataFrame:
    """Add, per name, the number of rows of the key in ``[us + lo, us + hi]`` (micros, inclusive).

    Taken as the difference of two running counts: frames that start at the
    partition's beginning are updated row by row, whereas a sliding frame is
    summed again for every row.
    """
    before = max(0, *[-lo for lo, _ in windows.values()])
    after = max(0, *[hi for _, hi in windows.values()])
    slice_us = max(slice_us, before, after)
    halo = with_halo(df, before, after, us, slice_us)
    base = Window.partitionBy(*keys, SLICE).orderBy(us)

    def upto(bound: int) -> Column:
        return F.count(F.lit(1)).over(base.rangeBetween(Window.unboundedPreceding, bound))

    counted = halo.withColumns({name: upto(hi) - upto(lo - 1) for name, (lo, hi) in windows.items()})
    return counted.filter("_home").drop("_home", SLICE)


def _stacked(left: DataFrame, right: DataFrame, payload: Sequence[str], keys: Sequence[str], us: str, tie: Sequence[str]):
    r_struct = F.struct(F.col(us).alias("us"), *tie, *[c for c in payload if c not in (us, "us", *tie)])
    left_rows = left.select(
        *keys, F.col(us).alias("_us"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l")
    )
    right_rows = right.select(*keys, F.col(us).alias("_us"), F.lit(0).alias("_side"), r_struct.alias("_r"))
    return left_rows, right_rows


def _sides(rows: DataFrame, part: Sequence[str]) -> DataFrame:
    """Nearest right row at/before and at/after each row inside a slice.

    Right rows sort first at equal times in both directions, so an exact match
    is seen from both sides. Duplicated right times: the last one looking back,
    the first one looking ahead. Two sorts, one shuffle: a frame that reaches
    to the end of the partition would be recomputed per row.
    """
    tie = F.col("_r")
    back = (
        Window.partitionBy(*part)
        .orderBy(F.col("_us"), F.col("_side"), tie.asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ahead = (
        Window.partitionBy(*part)
        .orderBy(F.col("_us").desc(), F.col("_side"), tie.desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return rows.withColumn("_prev", F.last("_r", ignorenulls=True).over(back)).withColumn(
        "_next", F.last("_r", ignorenulls=True).over(ahead)
    )


def sides_within(
    left: DataFrame,
    right: DataFrame,
    payload: Sequence[str],
    before: int,
    after: int,
    keys: Sequence[str] = ("device",),
    us: str = "us",
    tie: Sequence[str] = (),
    slice_us: int = SLICE_US,
) -> DataFrame:
    """Left rows with ``_prev`` / ``_next``: the closest right rows inside ``[us - before, us + after]``.

    Bounded reach, so the right side is copied over slice borders (halo).
    """
    slice_us = max(slice_us, before, after, 1)
    left_rows, right_rows = _stacked(left, right, payload, keys, us, tie)
    rows = with_slice(left_rows, "_us", slice_us).unionByName(
        with_halo(right_rows, before, after, "_us", slice_us).drop("_home"), allowMissingColumns=True
    )
    found = _sides(rows, [*keys, SLICE]).filter(F.col("_side") == 1)
    keep_prev = F.when(F.col("_us") - F.col("_prev.us") <= before, F.col("_prev"))
    keep_next = F.when(F.col("_next.us") - F.col("_us") <= after, F.col("_next"))
    return found.select("_l.*", keep_prev.alias("_prev"), keep_next.alias("_next"))


def sides_unbounded(
    left: DataFrame,
    right: DataFrame,
    payload: Sequence[str],
    keys: Sequence[str] = ("device",),
    us: str = "us",
    tie: Sequence[str] = (),
    slice_us: int = SLICE_US,
) -> DataFrame:
    """Left rows with the last right row at/before and the first at/after, however far away."""
    left_rows, right_rows = _stacked(left, right, payload, keys, us, tie)
    rows = with_slice(left_rows.unionByName(right_rows, allowMissingColumns=True), "_us", slice_us, keys)
    along = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    back_along = Window.partitionBy(*keys).orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = _carry(
        rows,
        keys,
        {"_hi": F.max("_r"), "_lo": F.min("_r")},
        {
            "_c_prev": F.last("_hi", ignorenulls=True).over(along),
            "_c_next": F.last("_lo", ignorenulls=True).over(back_along),
        },
    )
    found = _attach(_sides(rows, [PART]).filter(F.col("_side") == 1), carry, keys)
    return found.select(
        "_l.*",
        F.coalesce("_prev", "_c_prev").alias("_prev"),
        F.coalesce("_next", "_c_next").alias("_next"),
    )
