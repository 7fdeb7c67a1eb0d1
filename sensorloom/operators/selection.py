"""Feature cleaning, imputation, relevance tests, scaling and class weights."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.functions.scalars import one_row, ratio
from sensorloom.operators.quantiles import exact_percentiles
from sensorloom.session import materialize


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def column_facts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: non-null values, whether all of them are equal, and the NULL share. One pass."""
    one = df.agg(
        F.count("*").alias("_rows"),
        *[F.struct(F.count(c).alias("n"), (F.min(c) == F.max(c)).alias("same")).alias(c) for c in columns],
    )
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(c)["n"].alias("n_values"),
            F.coalesce(F.col(c)["same"], F.lit(False)).alias("is_constant"),
            (1 - F.col(c)["n"] / F.col("_rows")).alias("null_share"),
        )
        for c in columns
    ]
    return one.select(F.inline(F.array(*cells)))


def constant_null_columns(df: DataFrame, columns: Sequence[str], max_null: float = 0.9) -> DataFrame:
    """Columns to drop: constant ones, and ones with more than ``max_null`` NULLs."""
    return column_facts(df, columns).filter(F.col("is_constant") | (F.col("null_share") > max_null))


def select_usable(
    df: DataFrame, columns: Sequence[str], label: str, max_null: float = 0.9
) -> tuple[DataFrame, DataFrame]:
    """Drop constant columns, mostly empty columns and unlabelled rows; also the row and column report.

    Two jobs of one aggregated row each decide which columns stay; the data is not collected.
    """
    facts = {r["column"]: r for r in column_facts(df, columns).collect()}
    constant = [c for c in columns if facts[c]["is_constant"]]
    empty = [c for c in columns if c not in constant and facts[c]["null_share"] > max_null]
    kept = df.drop(*constant, *empty)
    usable = kept.filter(F.col(label).isNotNull())
    width = len(df.columns)
    widths = [(width, width - len(constant)), (width - len(constant), len(kept.columns)), (len(kept.columns), len(kept.columns))]
    names = ["constant columns", f"columns above {max_null} NULL", "rows without label"]
    counts = df.agg(F.count("*").alias("_all"), F.count(label).alias("_labelled"))
    cells = [
        F.struct(
            F.lit(i).cast("long").alias("step_no"),
            F.lit(name).alias("step"),
            F.col("_all").alias("rows_before"),
            (F.col("_labelled") if i == 2 else F.col("_all")).alias("rows_after"),
            F.lit(w[0]).cast("long").alias("columns_before"),
            F.lit(w[1]).cast("long").alias("columns_after"),
        )
        for i, (name, w) in enumerate(zip(names, widths))
    ]
    report = counts.select(F.inline(F.array(*cells))).withColumns(
        {"rows_deleted": F.col("rows_before") - F.col("rows_after"), "columns_deleted": F.col("columns_before") - F.col("columns_after")}
    )
    return usable, report


def impute_columns(df: DataFrame, columns: Sequence[str], clip_infinite: bool = True) -> DataFrame:
    """Replace missing values by the column's median of finite values.

    ``clip_infinite``: +inf becomes the column maximum and -inf the minimum;
    otherwise infinities count as missing. The statistics are one row.
    """
    finite = df.select(*[_finite(c).alias(c) for c in columns])
    limits = finite.agg(*[F.max(c).alias(f"_hi_{c}") for c in columns], *[F.min(c).alias(f"_lo_{c}") for c in columns])
    medians = exact_percentiles(finite, columns, [0.5])
    inf = F.lit(float("inf"))

    def filled(c: str) -> Column:
        x = F.col(c).cast("double")
        median = F.coalesce(F.col("_med")[f"{c}_q"][0], F.lit(0.0))
        missing = x.isNull() | F.isnan(x)
        high = F.coalesce(F.col("_lim")[f"_hi_{c}"], F.lit(0.0)) if clip_infinite else median
        low = F.coalesce(F.col("_lim")[f"_lo_{c}"], F.lit(0.0)) if clip_infinite else median
        return F.when(missing, median).when(x == inf, high).when(x == -inf, low).otherwise(x)

    joined = df.withColumns({"_lim": one_row(limits), "_med": one_row(medians)})
    return joined.select(*[filled(c).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- relevance --------------------------------------------------------------------------------


#: Terms of the series and of the continued fraction of the normal tail; both reach double precision with them.
TAIL_TERMS = 60


def two_sided_p(z: Column) -> Column:
    """Probability that a standard normal value is at least ``z`` (not negative) away from zero.

    A series with positive terms below 3.5, a continued fraction above.
    """
    terms = F.sequence(F.lit(TAIL_TERMS), F.lit(1), F.lit(-1))
    series = F.aggregate(terms, F.lit(1.0), lambda acc, n: 1 + z * z / (2 * n + 1) * acc)
    fraction = F.aggregate(terms, z, lambda acc, n: z + n / acc)
    density = F.exp(-z * z / 2) * F.lit(math.sqrt(2 / math.pi))
    return F.when(z < 3.5, F.greatest(1 - density * z * series, F.lit(0.0))).otherwise(density / fraction)


def mann_whitney_u(df: DataFrame, columns: Sequence[str], label: str, buckets: int | None = None) -> DataFrame:
    """One-vs-rest Mann-Whitney U of every feature and class, with tie-corrected z.

    Equal values are counted first (map-side combined); ranks come from running
    counts inside quantile buckets of each feature plus the bucket offsets, so no
    task has to sort a whole feature. Unless given there is a bucket for each million
    distinct values of a feature.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("_v")) for c in columns])
    long = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("class"), F.inline(pairs)).filter("_v IS NOT NULL")
    cells = long.groupBy("feature", "_v", "class").agg(F.count("*").alias("_nc"))
    cells = materialize(cells, "cells")
    values = cells.groupBy("feature", "_v").agg(F.sum("_nc").alias("_n"))
    if buckets is None:
        buckets = 2 + cells.count() // (1_000_000 * len(columns))
    grid = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    splits = values.groupBy("feature").agg(F.percentile_approx("_v", grid, 4 * buckets).alias("_splits"))
    # NULL-free bucket id: how many splits lie below the value.
    placed = values.join(splits, "feature").withColumn(
        "_b", F.aggregate("_splits", F.lit(0), lambda acc, s: acc + F.when(s < F.col("_v"), 1).otherwise(0))
    ).drop("_splits")
    inside = Window.partitionBy("feature", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("feature").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("feature", "_b").agg(F.sum("_n").alias("_bn"))
        .select("feature", "_b", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"))
    )
    ranked = (
        placed.withColumn("_local", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(offsets, ["feature", "_b"])
        .select("feature", "_v", "_n", (F.col("_off") + F.col("_local") + (F.col("_n") + 1) / 2).alias("_rank"))
    )
    totals = ranked.groupBy("feature").agg(
        F.sum("_n").alias("_all"), F.sum(F.pow("_n", F.lit(3)) - F.col("_n")).alias("_ties")
    )
    sums = (
        cells.join(ranked.select("feature", "_v", "_rank"), ["feature", "_v"])
        .groupBy("feature", "class")
        .agg(F.sum(F.col("_nc") * F.col("_rank")).alias("rank_sum"), F.sum("_nc").alias("n_class"))
        .join(totals, "feature")
    )
    n1, n = F.col("n_class").cast("double"), F.col("_all").cast("double")
    n2 = n - n1
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * (n + 1 - ratio(F.col("_ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), sigma)
    return sums.select("feature", "class", "n_class", F.col("_all").alias("n_rows"), "rank_sum", u.alias("u"), z.alias("z"))


def relevant_features(df: DataFrame, columns: Sequence[str], label: str, fdr: float = 0.05) -> DataFrame:
    """Features relevant for at least one class after Benjamini-Yekutieli control per class.

    The test table has one row per (feature, class).
    """
    tests = mann_whitney_u(df, columns, label).withColumn(
        "p_value", F.coalesce(two_sided_p(F.col("z")), F.lit(1.0))
    )
    harmonic = sum(1 / i for i in range(1, len(columns) + 1))
    per_class = Window.partitionBy("class")
    ranked = tests.withColumn("_i", F.row_number().over(per_class.orderBy("p_value", "feature")))
    limit = F.col("_i") * F.lit(fdr) / F.lit(len(columns) * harmonic)
    cut = ranked.withColumn("_cut", F.max(F.when(F.col("p_value") <= limit, F.col("_i"))).over(per_class))
    return cut.groupBy("feature").agg(
        F.min("p_value").alias("min_p_value"),
        F.count(F.when(F.col("_i") <= F.col("_cut"), 1)).alias("n_relevant_classes"),
    ).withColumn("is_relevant", F.col("n_relevant_classes") > 0)


# --- scaling and weights ----------------------------------------------------------------------


def minmax_scale(train: DataFrame, target: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale ``target`` to the range of ``train``; a constant column becomes 0."""
    stats = train.agg(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])
    joined = target.withColumn("_st", one_row(stats))

    def rescaled(c: str) -> Column:
        low, high = F.col("_st")[f"_lo_{c}"], F.col("_st")[f"_hi_{c}"]
        return F.coalesce(ratio(F.col(c) - low, high - low), F.col(c) * 0.0)

    scaled = {c: rescaled(c) for c in columns}
    return joined.select(*[scaled[c].alias(c) if c in columns else F.col(c) for c in target.columns])


def robust_scale(train: DataFrame, target: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - median) / interquartile range of ``train``; a zero range leaves x - median."""
    stats = exact_percentiles(train, columns, [0.25, 0.5, 0.75])
    joined = target.withColumn("_st", one_row(stats))

    def scaled(c: str) -> Column:
        low, mid, high = (F.col("_st")[f"{c}_q"][i] for i in range(3))
        spread = high - low
        return (F.col(c) - mid) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)

    return joined.select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in target.columns])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k · n_c) per class."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n_class"))
    whole = one_row(counts.agg(F.sum("n_class").alias("n"), F.count("*").alias("k")))
    weight = F.col("_all.n") / (F.col("_all.k") * F.col("n_class"))
    return counts.withColumn("_all", whole).select(label, "n_class", weight.alias("weight"))

