"""Exact quantiles that never gather a large group in one buffer.

Groups of bounded size take Spark's exact aggregate. In larger ones each quantile has a bracket of values, at first
all of them. A pass counts what lies below the bracket, on its ends and inside, and cuts the inside at 256 points of
a bounded sketch (combined map-side); the cells around the rank are the next bracket. When few values are left
inside, they alone are collected, and the quantile follows from the counts. Ties on the ends are counted, not kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.session import materialize

#: Values that one buffer holds, over all columns.
BUFFER_VALUES = 1_000_000
#: Cells into which a pass cuts a bracket, and the accuracy of the sketch; its error is far below a cell.
CELLS, ACCURACY = 256, 10_000

_GROUP = ["_k", "_c"]


def exact_percentiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (), buffer_values: int = BUFFER_VALUES) -> DataFrame:
    """``keys`` plus, per column, an array ``<column>_q`` of interpolated quantiles.

    NULLs are left out and a group of NULLs alone keeps its row with NULL quantiles; NULL keys are a group of
    their own; NaN counts as the largest value. Without ``keys`` there is one row, also for an empty table.
    """
    limit = _limit(columns, buffer_values)
    key = F.struct(*keys, F.lit(0).alias("_"))  # compares NULLs inside as equal, so that joins keep them
    whole = _whole(columns, probs)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if _largest(sizes) <= limit:
        return df.groupBy(*keys).agg(*whole)
    large = materialize(sizes.filter(F.col("_n") > limit).select(key.alias("_k")), "large-groups")
    keyed = df.withColumn("_k", key)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns]))
    values = keyed.join(large, "_k", "left_semi").select("_k", pairs.alias("_p")).select("_k", "_p.*")
    # The sketch needs an order without NaN: it stands with infinity there, and the last ranks give it back.
    values = values.withColumn("_nan", F.isnan("_v")).withColumn("_v", F.when(F.col("_nan"), F.lit(float("inf"))).otherwise(F.col("_v")))
    quantiles = _select(values, probs, _brackets(values, probs, limit))
    wide = [F.max(F.when(F.col("_c") == c, F.col("_q"))).alias(f"{c}_q") for c in columns]
    if not keys:
        return quantiles.agg(*wide)
    found = quantiles.groupBy("_k").agg(*wide).select(*[F.col("_k")[k].alias(k) for k in keys], *[f"{c}_q" for c in columns])
    return found.unionByName(keyed.join(large, "_k", "left_anti").groupBy(*keys).agg(*whole))


def with_percentiles(df: DataFrame, aggregates: Sequence[Column], columns: Sequence[str], probs: Sequence[float], keys: Sequence[str], buffer_values: int = BUFFER_VALUES) -> DataFrame:
    """Other aggregates and the quantiles in one row a group; NULL keys and groups of NULLs stay."""
    if _largest(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))) <= _limit(columns, buffer_values):
        return df.groupBy(*keys).agg(*aggregates, *_whole(columns, probs))
    grouped, quantiles = df.groupBy(*keys).agg(*aggregates), exact_percentiles(df, columns, probs, keys, buffer_values)
    return grouped.join(quantiles, reduce(and_, [grouped[k].eqNullSafe(quantiles[k]) for k in keys])).drop(*[quantiles[k] for k in keys])


def _limit(columns: Sequence[str], buffer_values: int) -> int:
    return max(2, buffer_values // len(columns))


def _whole(columns: Sequence[str], probs: Sequence[float]) -> list[Column]:
    """The exact aggregate, which holds the distinct values of a group; a group of NULLs has NULL quantiles, no group none."""
    asked, unknown = F.array(*[F.lit(float(p)) for p in probs]), F.array_repeat(F.lit(None).cast("double"), len(probs))
    return [F.when(F.count(F.lit(1)) > 0, F.coalesce(F.percentile(F.col(c).cast("double"), asked), unknown)).alias(f"{c}_q") for c in columns]


def _largest(sizes: DataFrame) -> int:
    return sizes.agg(F.max("_n")).first()[0] or 0


def _ranks(prob: float) -> tuple[Column, Column]:
    position = (F.col("_n") - 1) * F.lit(float(prob))
    return F.floor(position), F.ceil(position)


def _brackets(values: DataFrame, probs: Sequence[float], limit: int) -> DataFrame:
    """``_n, _n_nan, _lo, _hi`` by group: at most ``limit`` values strictly inside a bracket that matter to its quantile."""
    repeated = lambda c: F.array_repeat(c, len(probs))
    open_ = materialize(
        values.groupBy(*_GROUP).agg(F.count("_v").alias("_n"), F.count_if("_nan").alias("_n_nan"), repeated(F.min("_v")).alias("_lo"), repeated(F.max("_v")).alias("_hi")),
        "brackets",
    )
    done: DataFrame | None = None
    grid = F.array(*[F.lit(k / CELLS) for k in range(CELLS + 1)])
    v = F.col("_v")
    while True:
        parts = []
        for i in range(len(probs)):
            lo, hi = F.col("_lo")[i], F.col("_hi")[i]
            inside = F.when((v > lo) & (v < hi), v)
            parts += [F.count(F.when(v <= lo, 1)).alias(f"_upto{i}"), F.count(inside).alias(f"_in{i}"), F.percentile_approx(inside, grid, ACCURACY).alias(f"_grid{i}")]
        facts = F.any_value(F.struct("_n", "_n_nan", "_lo", "_hi")).alias("_s")
        counted = materialize(values.join(open_, _GROUP).groupBy(*_GROUP).agg(facts, *parts).select(*_GROUP, "_s.*", *[f"_{n}{i}" for i in range(len(probs)) for n in ("upto", "in", "grid")]), "bracket-counts")
        need, low, high = [], [], []
        for i, prob in enumerate(probs):
            first, last = _ranks(prob)
            upto, inside, cells = F.col(f"_upto{i}"), F.col(f"_in{i}"), F.col(f"_grid{i}")
            need.append((inside > limit) & (last >= upto) & (first < upto + inside))
            at = lambda rank: F.least(F.greatest((rank - upto) / inside, F.lit(0.0)), F.lit(1.0)) * CELLS  # noqa: E731, B023
            a, b = (F.floor(at(first)) - 2).cast("int"), (F.ceil(at(last)) + 2).cast("int")
            low.append(F.when(need[i] & (a >= 0), F.get(cells, a)).otherwise(F.col("_lo")[i]))
            high.append(F.when(need[i] & (b <= CELLS), F.get(cells, b)).otherwise(F.col("_hi")[i]))
        more = reduce(or_, need)
        closed = counted.filter(~F.coalesce(more, F.lit(False))).select(*_GROUP, "_n", "_n_nan", "_lo", "_hi")
        done = closed if done is None else done.unionByName(closed)
        if counted.filter(more).isEmpty():
            return done
        open_ = materialize(counted.filter(more).select(*_GROUP, "_n", "_n_nan", F.array(*low).alias("_lo"), F.array(*high).alias("_hi")), "brackets")


def _select(values: DataFrame, probs: Sequence[float], brackets: DataFrame) -> DataFrame:
    """``_q`` of every group from the counts around its brackets and the few values inside."""
    v = F.col("_v")
    parts = []
    for i, prob in enumerate(probs):
        lo, hi = F.col("_lo")[i], F.col("_hi")[i]
        parts += [
            F.count(F.when(v < lo, 1)).alias(f"_below{i}"),
            F.max(F.when(v < lo, v)).alias(f"_under{i}"),
            F.count(F.when(v == lo, 1)).alias(f"_first{i}"),
            F.count(F.when((v > lo) & (v < hi), v)).alias(f"_in{i}"),
            F.count(F.when((v == hi) & (hi > lo), 1)).alias(f"_last{i}"),
            F.min(F.when(v > hi, v)).alias(f"_over{i}"),
        ]
    facts = F.any_value(F.struct("_n", "_n_nan", "_lo", "_hi")).alias("_s")
    counted = materialize(values.join(brackets, _GROUP).groupBy(*_GROUP).agg(facts, *parts), "bracket-sides")
    # A bracket whose quantile lies on its ends may hold many values inside; only those that matter are collected.
    wanted = []
    for i, prob in enumerate(probs):
        position = (F.col("_s._n") - 1) * F.lit(float(prob))
        start = F.col(f"_below{i}") + F.col(f"_first{i}")
        wanted.append((F.ceil(position) >= start) & (F.floor(position) < start + F.col(f"_in{i}")))
    inner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), w.alias("w"), F.col("_s._lo")[i].alias("lo"), F.col("_s._hi")[i].alias("hi")) for i, w in enumerate(wanted)])).alias("_b")
    asked = counted.select(*_GROUP, inner).filter("_b.w").select(*_GROUP, "_b.i", "_b.lo", "_b.hi")
    held = values.join(asked, _GROUP).filter((v > F.col("lo")) & (v < F.col("hi"))).groupBy(*_GROUP, "i").agg(F.array_sort(F.collect_list("_v")).alias("_held"))
    lists = held.groupBy(*_GROUP).agg(*[F.max(F.when(F.col("i") == i, F.col("_held"))).alias(f"_inside{i}") for i in range(len(probs))])
    joined = counted.join(lists, _GROUP, "left")
    return joined.select(*_GROUP, F.array(*[_quantile(i, p) for i, p in enumerate(probs)]).alias("_q"))


def _quantile(i: int, prob: float) -> Column:
    """The interpolated quantile from the counts around the bracket ``i``."""
    n, lo, hi = F.col("_s._n"), F.col("_s._lo")[i], F.col("_s._hi")[i]
    inside = F.col(f"_inside{i}")
    to_lo = F.col(f"_below{i}")
    to_inside = to_lo + F.col(f"_first{i}")
    to_hi = to_inside + F.col(f"_in{i}")

    def at(rank: Column) -> Column:
        return (
            F.when(rank >= n - F.col("_s._n_nan"), F.lit(float("nan")))
            .when(rank < to_lo, F.col(f"_under{i}"))
            .when(rank < to_inside, lo)
            .when(rank < to_hi, F.get(inside, (rank - to_inside).cast("int")))
            .when(rank < to_hi + F.col(f"_last{i}"), hi)
            .otherwise(F.col(f"_over{i}"))
        )

    position = (n - 1) * F.lit(float(prob))
    low, high = F.floor(position), F.ceil(position)
    # Each of the two values is looked up once, by a transform.
    ends = F.transform(F.array(low, high), at)
    mixed = F.transform(F.array(ends), lambda e: F.when((low == high) | (e[0] == e[1]), e[0]).otherwise((high - position) * e[0] + (position - low) * e[1]))
    return F.when(n > 0, F.get(mixed, F.lit(0)))
