"""Interval (range) joins by time buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sensorloom.functions.scalars import floor_div, ratio
from sensorloom.operators.ordered import SLICE_US, sides_unbounded
from sensorloom.session import materialize


def event_window_join(
    rows: DataFrame,
    events: DataFrame,
    before: int,
    after: int,
    device: str = "device",
    us: str = "us",
    event_us: str = "event_us",
    how: str = "inner",
) -> DataFrame:
    """Rows within ``[event - before, event + after]`` (micros, inclusive) of an event of the same device.

    Each event is copied to the at most two buckets its window touches and meets
    the rows by an equi-join on (device, bucket); the exact test follows. A heavy
    device spreads over its buckets, and a heavy bucket is split by the adaptive
    skew join because only the event side is copied.
    """
    width = max(before + after, 1)
    start, end = F.col(event_us) - before, F.col(event_us) + after
    bucketed = events.withColumn(
        "_bucket", F.explode(F.sequence(floor_div(start, width), floor_div(end, width)))
    )
    clash = [c for c in rows.columns if c in events.columns and c != device]
    slim = rows.drop(*clash).withColumn("_bucket", floor_div(F.col(us), width))
    bucketed = bucketed.withColumnsRenamed({device: "_device", "_bucket": "_near"})
    # The time test belongs to the join: a row that meets no event stays in an outer join.
    met = (F.col(device) == F.col("_device")) & (F.col("_bucket") == F.col("_near")) & F.col(us).between(F.col(event_us) - before, F.col(event_us) + after)
    return slim.join(bucketed, met, how).drop("_bucket", "_near", "_device")


def event_completeness(
    events: DataFrame,
    joined: DataFrame,
    expected: float,
    keys: Sequence[str] = ("device", "event_us"),
    partial_below: float = 0.9,
) -> DataFrame:
    """Found over expected records per event; ``is_partial`` when the fraction is at most the limit."""
    found = joined.groupBy(*keys).agg(F.count("*").alias("found"))
    share = ratio(F.coalesce(F.col("found"), F.lit(0)), F.lit(expected))
    return (
        events.select(*keys)
        .distinct()
        .join(found, list(keys), "left")
        .select(
            *keys,
            F.coalesce("found", F.lit(0)).alias("found"),
            share.alias("fraction"),
            (share <= partial_below).alias("is_partial"),
        )
    )


def first_complete_source(
    joined: DataFrame,
    expected: float,
    source_rank: str = "source_rank",
    keys: Sequence[str] = ("device", "event_us"),
    complete_above: float = 0.9,
) -> DataFrame:
    """Rows of each event from the sources up to and including the first that holds it completely.

    Sources are ordered by ``source_rank``; the decision is taken on one small
    row per (event, source) and joined back.
    """
    per_source = joined.groupBy(*keys, source_rank).agg(F.count("*").alias("_found"))
    earlier = Window.partitionBy(*keys).orderBy(source_rank).rowsBetween(Window.unboundedPreceding, -1)
    kept = (
        per_source.withColumn("_done", F.max(ratio(F.col("_found"), F.lit(expected))).over(earlier))
        .filter(F.col("_done").isNull() | (F.col("_done") <= complete_above))
        .select(*keys, source_rank)
    )
    return joined.join(kept, [*keys, source_rank], "left_semi")


def disjoint_cover(intervals: DataFrame, columns: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """``keys, us, _hit``: from each ``us`` on, the covering interval of highest ``priority`` (NULL: none), until the next ``us``.

    An interval is the union of at most two blocks for each power of two (canonical blocks); each block keeps its
    best interval, a map-side maximum. The winner at an endpoint is the best of the blocks that hold it, one for each
    power, found by equality. No interval meets another one, and nothing is gathered.
    """
    whole = intervals.filter(F.col("start_us") <= F.col("end_us"))
    entry = F.struct("priority", "start_us", "end_us", *columns)
    spans = materialize(whole.select(*keys, F.col("start_us").alias("_from"), (F.col("end_us") + 1).alias("_to"), entry.alias("_entry")), "intervals")
    longest = spans.agg(F.max(F.col("_to") - F.col("_from"))).first()[0] or 1
    levels = int(longest).bit_length()
    first, last = F.expr("shiftright(_from + shiftleft(1L, _level) - 1, _level)"), F.expr("shiftright(_to, _level)")
    placed = spans.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumns({"_a": first, "_b": last}).filter("_a < _b")
    ends = F.array_compact(F.array(F.when(F.col("_a") % 2 != 0, F.col("_a")), F.when(F.col("_b") % 2 != 0, F.col("_b") - 1)))
    blocks = placed.select(*keys, "_level", "_entry", F.explode(ends).alias("_block")).groupBy(*keys, "_level", "_block").agg(F.max("_entry").alias("_entry"))
    points = spans.select(*keys, F.explode(F.array("_from", "_to")).alias("us")).distinct()
    asked = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("_block", F.expr("shiftright(us, _level)"))
    on = [*keys, "_level", "_block"]
    found = asked.alias("a").join(blocks.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on], "left").select("a.*", "b._entry")
    return materialize(found.groupBy(*keys, "us").agg(F.max("_entry").alias("_hit")).select(*keys, "us", "_hit"), "cover")


def interval_lookup(
    rows: DataFrame,
    intervals: DataFrame,
    columns: Sequence[str] = (),
    us: str = "us",
    keys: Sequence[str] = (),
    slice_us: int = SLICE_US,
) -> DataFrame:
    """Rows inside an interval with ``_hit`` = struct of the covering interval of highest ``priority``.

    ``intervals(keys, start_us, end_us, priority, …)``, bounds inclusive; of equal priorities the later start, then the
    later end. A row looks back to the last piece of the disjoint cover, so it is never multiplied.
    """
    cover = disjoint_cover(intervals, columns, keys).withColumnRenamed("us", us)
    found = sides_unbounded(rows, cover, ["_hit"], keys, us, slice_us=slice_us)
    return found.withColumn("_hit", F.col("_prev._hit")).drop("_prev", "_next").filter(F.col("_hit").isNotNull())


def interval_label(rows: DataFrame, intervals: DataFrame, us: str = "us", strip: int = 3) -> DataFrame:
    """Label of the interval holding the row; the later interval wins; unlabelled rows go.

    The first ``strip`` characters of a label are a running prefix and are cut off.
    """
    found = interval_lookup(rows, intervals, ["label"], us)
    return found.withColumn("label", F.substring(F.col("_hit.label"), strip + 1, 1_000_000)).drop("_hit")
