"""Time-series features of segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sensorloom.functions.scalars import ratio
from sensorloom.operators.ordered import SLICE_US, previous_row, row_index, running_sum
from sensorloom.operators.quantiles import BUFFER_VALUES, with_percentiles
from sensorloom.session import materialize

SEGMENT_KEYS = ("device", "event_us", "segment")
#: Rows of a segment that one task may scan whole.
WHOLE_ROWS = 100_000
_PROBS = [i / 10 for i in range(1, 10)]


def segment_features(
    rows: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = SEGMENT_KEYS,
    us: str = "us",
) -> DataFrame:
    """Maximum, minimum, mean, median, population deviation and root mean square per segment and axis.

    Also the segment's first record time and row count.
    """
    aggregates = [F.min(us).alias("first_us"), F.count("*").alias("n_rows")]
    for c in columns:
        aggregates += [
            F.max(c).alias(f"{c}__maximum"),
            F.min(c).alias(f"{c}__minimum"),
            F.avg(c).alias(f"{c}__mean"),
            F.stddev_pop(c).alias(f"{c}__standard_deviation"),
            F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"{c}__root_mean_square"),
        ]
    out = with_percentiles(rows, aggregates, columns, [0.5], keys)
    return out.withColumns({f"{c}__median": F.col(f"{c}_q")[0] for c in columns}).drop(*[f"{c}_q" for c in columns])


def gps_segment_features(moves: DataFrame, keys: Sequence[str] = SEGMENT_KEYS, us: str = "us") -> DataFrame:
    """Mean, median and maximum of speed and acceleration of GPS segments (rows without both are dropped)."""
    full = moves.na.drop(subset=["speed_kmh", "accel_kmhs"])
    out = segment_features(full, ["speed_kmh", "accel_kmhs"], keys, us)
    wanted = [f"{c}__{f}" for c in ("speed_kmh", "accel_kmhs") for f in ("mean", "median", "maximum")]
    return out.select(*keys, "first_us", "n_rows", *wanted)


def segment_features_ext(
    rows: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = SEGMENT_KEYS,
    us: str = "us",
    tie: Sequence[str] = (),
    slice_us: int = SLICE_US,
    whole_rows: int = WHOLE_ROWS,
) -> DataFrame:
    """Further whole-segment statistics, one row for each segment and axis (``column``).

    Moments, energy, change sums, counts around the mean, positions of the extremes
    (as a fraction of the rows), longest strike above the mean, mean crossings,
    lag-1 autocorrelation, linear trend slope and the quantiles .1-.9.

    Segments of at most ``whole_rows`` rows are shuffled once, all axes side by side; larger ones are scanned in slices.
    """
    rows = rows.select(*dict.fromkeys([*keys, us, *tie]), *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)])
    limit = min(whole_rows, BUFFER_VALUES // len(columns))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    if (sizes.agg(F.max("_rows")).first()[0] or 0) <= limit:
        return _finished(_whole_segments(rows, columns, keys, us, tie))
    large = materialize(sizes.filter(F.col("_rows") > limit).select(F.struct(*keys).alias("_of")), "large-segments")
    at = F.struct(*keys) == F.col("_of")  # compares NULLs inside as equal
    small, big = rows.join(large, at, "left_anti"), materialize(rows.join(large, at, "left_semi"), "large-segment-rows")
    return _finished(_whole_segments(small, columns, keys, us, tie).unionByName(_sliced_segments(big, columns, keys, us, tie, slice_us)))


def _levels(x: Column) -> dict[str, Column]:
    return {"_mean": F.avg(x), "_n": F.count("*"), "_max": F.max(x), "_min": F.min(x), "_var": F.var_pop(x)}


def _flat(var: Column, least: Column, most: Column) -> Column:
    """Merged moments of equal values may leave a variance of the last bits, of which skewness and kurtosis would be taken."""
    return F.when(least == most, 0.0 * least).otherwise(var)


def _flips(x: Column, before: Column, mean: Column) -> tuple[Column, Column]:
    """Whether a value lies above the mean, and whether that differs from the value before."""
    above = x > mean
    flipped = before.isNotNull() & ((before > mean) != above)
    return above.cast("long"), F.coalesce(flipped, F.lit(False)).cast("long")


def _statistics(k: object = "") -> list[Column]:
    """The aggregates of an axis from its marked rows."""
    x, before, mean, most, least, var, above, flip = (F.col(f"{c}{k}") for c in ("_x", "_before", "_mean", "_max", "_min", "_var", "_above", "_flip"))
    i, n = F.col("_i"), F.col("_n")
    change = F.abs(x - before)
    centred = (x - mean) * (before - mean)
    return [
        F.max(var).alias("variance"),
        F.sum(x * x).alias("abs_energy"),
        F.avg(change).alias("mean_abs_change"),
        F.coalesce(F.sum(change), F.lit(0.0)).alias("absolute_sum_of_changes"),
        F.sum(above).alias("count_above_mean"),
        F.count(F.when(x < mean, 1)).alias("count_below_mean"),
        (F.min(F.when(x == most, i)) / F.max(n)).alias("first_location_of_maximum"),
        ((F.max(F.when(x == most, i)) + 1) / F.max(n)).alias("last_location_of_maximum"),
        (F.min(F.when(x == least, i)) / F.max(n)).alias("first_location_of_minimum"),
        ((F.max(F.when(x == least, i)) + 1) / F.max(n)).alias("last_location_of_minimum"),
        F.sum(flip).alias("number_crossing_mean"),
        ratio(F.sum(centred), F.max(n - 1) * F.max(var)).alias("autocorrelation_lag_1"),
        F.regr_slope(x, i.cast("double")).alias("linear_trend_slope"),
        F.sum(F.pow(x - mean, F.lit(3))).alias("_m3"),
        F.sum(F.pow(x - mean, F.lit(4))).alias("_m4"),
        F.max(n).alias("n_rows"),
    ]


def _whole_segments(rows: DataFrame, columns: Sequence[str], keys: Sequence[str], us: str, tie: Sequence[str]) -> DataFrame:
    """Statistics of segments that fit a task: one shuffle and one sort for all scans, axes and aggregates."""
    axes = range(len(columns))
    timeline = Window.partitionBy(*keys).orderBy(us, *tie)
    upto, segment = timeline.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    x = [F.col(f"_x{k}") for k in axes]
    marked = rows.withColumns({"_i": (F.row_number().over(timeline) - 1).cast("long"), **{f"_before{k}": F.lag(x[k]).over(timeline) for k in axes}})
    levels = {f"{name}{k}" if name != "_n" else name: c for k in axes for name, c in _levels(x[k]).items()}
    marked = marked.withColumns({name: c.over(segment) for name, c in levels.items()})
    marked = marked.withColumns({f"_var{k}": _flat(F.col(f"_var{k}"), F.col(f"_min{k}"), F.col(f"_max{k}")) for k in axes})
    for place, name in enumerate(("_above", "_flip")):
        marked = marked.withColumns({f"{name}{k}": _flips(x[k], F.col(f"_before{k}"), F.col(f"_mean{k}"))[place] for k in axes})
    # A strike is what the count of rows above has grown by since the last crossing.
    marked = marked.withColumns({f"_sum{k}": F.coalesce(F.sum(f"_above{k}").over(upto), F.lit(0)) for k in axes})
    start = [F.when(F.col(f"_flip{k}") == 1, F.col(f"_sum{k}") - F.coalesce(f"_above{k}", F.lit(0))) for k in axes]
    marked = marked.withColumns({f"_start{k}": F.coalesce(F.last(start[k], ignorenulls=True).over(upto), F.lit(0)) for k in axes})
    asked, unknown = F.array(*[F.lit(p) for p in _PROBS]), F.array_repeat(F.lit(None).cast("double"), len(_PROBS))
    parts = []
    for k, c in enumerate(columns):
        strike = F.max(F.col(f"_sum{k}") - F.col(f"_start{k}")).alias("longest_strike_above_mean")
        quantiles = F.coalesce(F.percentile(x[k], asked), unknown).alias("_q")
        parts.append(F.struct(F.lit(c).alias("column"), *_statistics(k), strike, quantiles).alias(f"_axis{k}"))
    return marked.groupBy(*keys).agg(*parts).select(*keys, F.inline(F.array(*[f"_axis{k}" for k in axes])))


def _sliced_segments(rows: DataFrame, columns: Sequence[str], keys: Sequence[str], us: str, tie: Sequence[str], slice_us: int) -> DataFrame:
    """The same statistics of segments of any size, whose timelines are cut into slices."""
    axes = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_x{k}").alias("_x")) for k, c in enumerate(columns)])
    rows = rows.select(*dict.fromkeys([*keys, us, *tie]), F.inline(axes))
    keys, x = [*keys, "column"], F.col("_x")
    indexed = materialize(row_index(rows, "_i", keys, us, tie, slice_us), "segment-index")
    levels = indexed.groupBy(*keys).agg(*[c.alias(name) for name, c in _levels(x).items()])
    levels = levels.withColumn("_var", _flat(F.col("_var"), F.col("_min"), F.col("_max")))
    same = F.struct(*keys) == F.col("_of")
    levels = levels.select(F.struct(*keys).alias("_of"), "_mean", "_n", "_max", "_min", "_var")
    stepped = previous_row(indexed, ["_x"], keys, us, tie, slice_us, "_p").withColumn("_before", F.col("_p._x")).drop("_p")
    above, flip = _flips(x, F.col("_before"), F.col("_mean"))
    marked = materialize(stepped.join(levels, same).drop("_of").withColumns({"_above": above, "_flip": flip}), "segment-marks")
    runs = materialize(running_sum(marked, F.col("_flip"), "_run", keys, us, tie, slice_us), "segment-runs")
    strike = runs.filter("_above = 1").groupBy(*keys, "_run").agg(F.count("*").alias("_len")).groupBy(F.struct(*keys).alias("_of")).agg(F.max("_len").alias("longest_strike_above_mean"))
    out = with_percentiles(runs, _statistics(), ["_x"], _PROBS, keys).withColumnRenamed("_x_q", "_q")
    return out.join(strike, same, "left").drop("_of").withColumn("longest_strike_above_mean", F.coalesce("longest_strike_above_mean", F.lit(0)))


def _finished(out: DataFrame) -> DataFrame:
    """Sample skewness and excess kurtosis with the usual small-sample corrections, and the quantiles as columns."""
    nn, var = F.col("n_rows").cast("double"), F.col("variance")
    m2, m3, m4 = var, F.col("_m3") / nn, F.col("_m4") / nn
    skew = F.try_divide(F.sqrt(nn * (nn - 1)), nn - 2) * F.try_divide(m3, F.pow(m2, F.lit(1.5)))
    kurt = F.try_divide((nn - 1), (nn - 2) * (nn - 3)) * ((nn + 1) * F.try_divide(m4, m2 * m2) - 3 * (nn - 1))
    return out.withColumns(
        {
            "skewness": F.when(nn > 2, skew),
            "kurtosis": F.when(nn > 3, kurt),
            **{f"quantile_{p}".replace(".", "_"): F.col("_q")[i] for i, p in enumerate(_PROBS)},
        }
    ).drop("_m3", "_m4", "_q")


def feature_inventory(
    features: DataFrame, sensors: Sequence[str], axes: Sequence[str], id_columns: Sequence[str] = ()
) -> DataFrame:
    """Number of feature columns per sensor prefix and axis, with the record count."""
    names = [c for c in features.columns if c not in id_columns]
    rows = [(s, a, sum(c.startswith(f"{s[:3]}_{a}") for c in names)) for s in sensors for a in axes]
    spark: SparkSession = features.sparkSession
    listed = spark.createDataFrame(rows, "sensor string, axis string, number_features long")
    return listed.withColumn("number_records", features.agg(F.count("*")).scalar())


def select_features_by_name(
    features: DataFrame, exact: Sequence[str] = (), containing: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Columns named exactly, or containing one of the texts, plus the columns to keep."""
    chosen = [c for c in features.columns if c in keep or c in exact or any(t in c for t in containing)]
    return features.select(*[F.col(f"`{c}`") for c in chosen])


