"""Evaluation of predictions: metrics, confusion tables, tests and one-per-class assignment."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.functions.scalars import ratio, ratio_or_zero

# --- metrics ----------------------------------------------------------------------------------


def _class_cells(predictions: DataFrame, by: Sequence[str], truth: str, guess: str, count: str | None) -> DataFrame:
    """Per (by, class): rows of the class, rows predicted as it, and hits."""
    n = F.sum(count) if count else F.count("*")
    pairs = predictions.groupBy(*by, F.col(truth).alias("_t"), F.col(guess).alias("_p")).agg(n.alias("_n"))
    sides = F.array(
        F.struct(F.col("_t").alias("class"), F.col("_n").alias("support"), F.lit(0).cast("long").alias("guessed"),
                 F.when(F.col("_t") == F.col("_p"), F.col("_n")).otherwise(0).alias("hits")),
        F.struct(F.col("_p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("_n").alias("guessed"),
                 F.lit(0).cast("long").alias("hits")),
    )
    return pairs.select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits")
    )


def classification_metrics(
    predictions: DataFrame, by: Sequence[str] = (), average: str = "macro", truth: str = "y_test", guess: str = "y_pred",
    count: str | None = None,
) -> DataFrame:
    """Accuracy, balanced accuracy, F1, precision and recall from the confusion counts.

    ``average``: "macro" or "weighted"; ``count`` names a column with the rows that a row stands for. Undefined ratios count as 0; balanced
    accuracy averages over the classes present in the truth.
    """
    cells = _class_cells(predictions, by, truth, guess, count)
    recall = ratio_or_zero(F.col("hits"), F.col("support"))
    precision = ratio_or_zero(F.col("hits"), F.col("guessed"))
    f1 = ratio_or_zero(2 * F.col("hits"), F.col("support") + F.col("guessed"))
    weight = F.col("support").cast("double") if average == "weighted" else F.lit(1.0)

    def mean(value: Column) -> Column:
        return ratio(F.sum(value * weight), F.sum(weight))

    return cells.groupBy(*by).agg(
        F.sum("support").alias("n_rows"),
        ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, recall)).alias("balanced_accuracy"),
        mean(f1).alias("f1"),
        mean(precision).alias("precision"),
        mean(recall).alias("recall"),
    )


def metrics_fold_summary(per_subject: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold accuracies."""
    return per_subject.agg(
        F.count("*").alias("n_folds"),
        F.avg("accuracy").alias("accuracy_mean"),
        F.stddev_pop("accuracy").alias("accuracy_std"),
        F.avg("balanced_accuracy").alias("balanced_accuracy_mean"),
        F.stddev_pop("balanced_accuracy").alias("balanced_accuracy_std"),
    )


def confusion_matrix(
    predictions: DataFrame, classes: Sequence[str], truth: str = "y_test", guess: str = "y_pred"
) -> DataFrame:
    """Counts and row shares per true class (rows) and predicted class (columns), in the given order."""
    rows = predictions.filter(F.col(truth).isin(*classes)).groupBy(F.col(truth).alias("true_class")).agg(
        *[F.count(F.when(F.col(guess) == c, 1)).alias(c) for c in classes]
    )
    total = reduce(lambda a, b: a + b, [F.col(c) for c in classes])
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("true_class")) - 1
    return rows.select(
        position.alias("class_no"), "true_class", *classes, *[ratio(F.col(c), total).alias(f"{c}_share") for c in classes]
    )


def binomial_test(
    predictions: DataFrame, by: Sequence[str] = (), truth: str = "y_test", guess: str = "y_pred"
) -> DataFrame:
    """Exact one-sided p-value of the number of hits against chance 1 / (classes present)."""
    shape = predictions.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col(truth) == F.col(guess), 1)).alias("hits"),
        F.count_distinct(truth).alias("k"),
    )
    return shape.withColumn("p_value", binomial_tail(F.col("hits"), F.col("n"), 1 / F.col("k")))


def binomial_tail(hits: Column, n: Column, p: Column) -> Column:
    """P(X >= hits) of a binomial variable, by the continued fraction of the regularised incomplete beta function.

    The tail is I_p(hits, n - hits + 1). The fraction needs some multiples of the root of n as steps, whatever the
    counts; the point probability in front of it comes from deviances, which keep their digits for large n.
    """
    n, x, p = n.cast("double"), hits.cast("double"), p.cast("double")
    q = 1 - p
    a, b = x, n - x + 1
    left = p < (a + 1) / (a + b + 2)
    steps = F.sequence(F.lit(1), F.ceil(100 + 6 * F.sqrt(n)).cast("int"))
    fraction = F.when(left, q * _beta_fraction(a, b, p, steps)).otherwise(x * q / b * _beta_fraction(b, a, q, steps))
    tail = binomial_point(x, n, p) * fraction
    return F.when(x <= 0, 1.0).when(p >= 1, 1.0).when(x >= n, F.exp(n * F.ln(p))).otherwise(F.least(F.when(left, tail).otherwise(F.greatest(1 - tail, F.lit(0.0))), F.lit(1.0)))


def _beta_fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """The continued fraction of the incomplete beta function by the modified Lentz method."""

    def away(v: Column) -> Column:
        return F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def link(state: Column, factor: Column) -> Column:
        d, c = 1 / away(1 + factor * state["d"]), away(1 + factor / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * d * c).alias("h"))

    def even(state: Column, k: Column) -> Column:
        return link(state, k * (b - k) * x / ((a - 1 + 2 * k) * (a + 2 * k)))

    def odd(state: Column, k: Column) -> Column:
        return link(state, -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 1 + 2 * k)))

    first = 1 / away(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    # Two links a step: the steps stand twice in the array, the first time for the even link.
    pairs = F.flatten(F.transform(steps, lambda k: F.array(k, -k)))
    number = lambda k: F.abs(k).cast("double")
    return F.aggregate(pairs, start, lambda s, k: F.when(k > 0, even(s, number(k))).otherwise(odd(s, number(k))), lambda s: s["h"])


def binomial_point(x: Column, n: Column, p: Column) -> Column:
    """P(X = x) for 0 < x < n and 0 < p < 1, from the deviances of x and n - x and the errors of Stirling's formula."""

    def deviance(seen: Column, expected: Column) -> Column:
        e = (seen - expected) / expected
        return expected * ((1 + e) * F.log1p(e) - e)

    def error(v: Column) -> Column:
        small = log_factorial(v) - (v + 0.5) * F.ln(v) + v - 0.9189385332046727
        return F.when(v < 16, small).otherwise(1 / (12 * v) - 1 / (360 * F.pow(v, F.lit(3))) + 1 / (1260 * F.pow(v, F.lit(5))))

    power = error(n) - error(x) - error(n - x) - deviance(x, n * p) - deviance(n - x, n * (1 - p))
    return F.sqrt(n / (F.lit(2 * math.pi) * x * (n - x))) * F.exp(power)


def log_factorial(x: Column) -> Column:
    """ln(x!) for x >= 0 by Stirling's series at x + 9, shifted back by the logarithms of the factors between."""
    y = x + 9.0
    series = (
        (y + 0.5) * F.ln(y) - y + F.lit(0.9189385332046727) + F.lit(1 / 12) / y - F.lit(1 / 360) / F.pow(y, F.lit(3))
        + F.lit(1 / 1260) / F.pow(y, F.lit(5)) - F.lit(1 / 1680) / F.pow(y, F.lit(7))
    )
    return reduce(lambda acc, i: acc - F.ln(x + float(i)), range(1, 10), series)


# --- one prediction per class -----------------------------------------------------------------


def _assigned(predictions: DataFrame, classes: Sequence[str], limits: Sequence[float], subject: str, row: str, truth: str | None, other: str, tries: int) -> DataFrame:
    """``limit``, subject, row, ``y_pred_final`` and the truth of the rows that a class takes.

    At most ``tries`` rows per (participant, class) can matter. They are found first
    (a cut that happens before the shuffle) and gathered to one short record per
    participant; only that record meets the limits, and the assignment is an expression over it.
    """
    served = [c for c in classes if c != other]
    best: DataFrame | None = None
    for i, c in enumerate(served):
        w = Window.partitionBy(subject).orderBy(F.col(c).desc_nulls_last(), row)
        top = (
            predictions.withColumn("_try", F.row_number().over(w))
            .filter(F.col("_try") <= tries)
            .select(subject, F.lit(i).alias("_class"), "_try", F.col(row).alias("_row"), F.col(c).alias("_prob"), (F.col(truth) if truth else F.lit(None).cast("string")).alias("_truth"))
        )
        best = top if best is None else best.unionByName(top)
    queue = best.groupBy(subject).agg(F.sort_array(F.collect_list(F.struct("_class", "_try", "_row", "_prob", "_truth"))).alias("_q"))
    queue = queue.withColumn("limit", F.explode(F.array(*[F.lit(float(p)) for p in limits])))
    kinds = dict(best.dtypes)
    start = F.struct(F.array().cast(f"array<struct<_row:{kinds['_row']},_name:string,_truth:{kinds['_truth']}>>").alias("taken"), F.lit(-1).alias("done"))
    names = F.array(*[F.lit(c) for c in served])

    def serve(state: Column, entry: Column) -> Column:
        free = ~F.exists(state["taken"], lambda t: t["_row"] == entry["_row"])
        turn = (state["done"] != entry["_class"]) & free
        take = turn & (entry["_prob"] >= F.col("limit"))
        own = F.struct(entry["_row"].alias("_row"), names[entry["_class"]].alias("_name"), entry["_truth"].alias("_truth"))
        return F.struct(
            F.when(take, F.array_append(state["taken"], own)).otherwise(state["taken"]).alias("taken"),
            F.when(turn, entry["_class"]).otherwise(state["done"]).alias("done"),
        )

    taken = queue.select("limit", subject, F.explode(F.aggregate("_q", start, serve, lambda s: s["taken"])).alias("_t"))
    return taken.select("limit", subject, F.col("_t._row").alias(row), F.col("_t._name").alias("y_pred_final"), F.col("_t._truth").alias("_truth"))


def one_per_class(
    predictions: DataFrame,
    classes: Sequence[str],
    probability: float,
    subject: str = "subject",
    row: str = "row_id",
    other: str = "other",
    tries: int = 3,
) -> DataFrame:
    """At most one row per participant and class, the rest ``other``.

    Classes are served in order. A class looks at its participant's row of highest
    probability; if that row is already taken, at the next one, ``tries`` rows in all.
    The first free one is assigned if it reaches ``probability``.
    """
    assigned = _assigned(predictions, classes, [probability], subject, row, None, other, tries).select(subject, row, "y_pred_final")
    return predictions.join(assigned, [subject, row], "left").withColumn("y_pred_final", F.coalesce("y_pred_final", F.lit(other)))


def one_per_class_sweep(
    predictions: DataFrame,
    classes: Sequence[str],
    probabilities: Sequence[float],
    subject: str = "subject",
    row: str = "row_id",
    truth: str = "y_test",
    other: str = "other",
    tries: int = 3,
) -> DataFrame:
    """Balanced accuracy and macro precision of the assignment for each probability limit.

    Only candidates meet the limits; all other rows are counted once, as ``other``.
    """
    taken = _assigned(predictions, classes, probabilities, subject, row, truth, other, tries)
    pairs = taken.groupBy("limit", F.col("_truth").alias("_t"), "y_pred_final").agg(F.count("*").alias("_n"))
    limits = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("limit")
    whole = predictions.groupBy(F.col(truth).alias("_t")).agg(F.count("*").alias("_n")).select("_t", "_n", limits)
    rest = whole.unionByName(pairs.select("_t", (-F.col("_n")).alias("_n"), "limit")).groupBy("limit", "_t").agg(F.sum("_n").alias("_n"))
    cells = pairs.unionByName(rest.filter("_n > 0").select("limit", "_t", F.lit(other).alias("y_pred_final"), "_n"))
    metrics = classification_metrics(cells, ["limit"], "macro", "_t", "y_pred_final", "_n")
    return metrics.select(F.col("limit").alias("probability"), "balanced_accuracy", "precision")


def place_mapping(
    assigned: DataFrame,
    classes: Sequence[str],
    subject: str = "subject",
    columns: Sequence[str] = ("lat", "lon"),
    row: str = "row_id",
) -> DataFrame:
    """Participant → class → coordinates and probability of the class's (first) assigned row."""
    probability = F.coalesce(*[F.when(F.col("y_pred_final") == c, F.col(c)) for c in classes])
    named = assigned.filter(F.col("y_pred_final").isin(*classes)).withColumn("_p", probability)
    first = F.min_by(F.struct(*columns, F.col("_p").alias("probability")), F.col(row)).alias("_f")
    return named.groupBy(subject, F.col("y_pred_final").alias("class")).agg(first).select(subject, "class", "_f.*")


def run_comparison(runs: Sequence[tuple[dict[str, str], DataFrame]], order: Sequence[str]) -> DataFrame:
    """One table of the result rows of several runs, tagged and sorted."""
    tagged = [frame.withColumns({k: F.lit(x) for k, x in tags.items()}) for tags, frame in runs]
    return reduce(DataFrame.unionByName, tagged).orderBy(*order)
