"""Leave-one-subject-out forests, nested tuning, permutation tests and importances, and routed scoring on MLlib."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, ShortType, StructField, StructType

from sensorloom.operators.selection import class_weights, impute_columns
from sensorloom.session import by_sorting, materialize

FOREST = {"numTrees": 20, "maxDepth": 5}
#: Models that are fitted at the same time; each fit is a distributed job of its own.
AT_ONCE = 8
#: Rows of a task at least where a table is small: many small fits gain nothing from being cut further.
TASK_ROWS = 20_000
#: Hashed moves of a place in a drawn permutation.
MOVES = 6
#: Forests that are scored in one pass.
SCORED_TOGETHER = 6


def in_parallel(spark: SparkSession, jobs: Sequence[Callable], at_once: int = AT_ONCE) -> list:
    """The results of functions that run Spark jobs, in order."""
    if not jobs:
        return []
    with ThreadPool(min(at_once, len(jobs))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs, chunksize=1)


def subject_values(df: DataFrame, subject: str) -> list:
    """The subjects to leave out in turn; each one is a model, so many participants are better combined into folds."""
    return sorted(r[0] for r in df.select(subject).distinct().collect() if r[0] is not None)


# --- a feature table that many models train on --------------------------------------------------


@dataclass
class Folds:
    """Labelled rows written out once, with the features as a vector and the class as a number.

    ``counts`` holds the rows of each subject by class, so that weights and skipped folds need no job.
    """

    rows: DataFrame
    classes: list
    counts: dict
    keep: list[str]
    label: str
    subject: str

    @property
    def subjects(self) -> list:
        return sorted(self.counts)

    def trained_on(self, without: Collection) -> list[int]:
        """Rows by class of all subjects but ``without``."""
        return [sum(n) for n in zip(*[c for s, c in self.counts.items() if s not in without])] or [0] * len(self.classes)

    def of(self, subjects: Collection) -> Column:
        return F.col(self.subject).isin(list(subjects))

    def fit(self, without: Collection, seed: int, params: dict, number: Column | None = None) -> RandomForestClassificationModel | None:
        """A forest on all subjects but ``without``, classes weighted alike; None with fewer than two classes.

        ``number`` replaces the class numbers by others with the same counts.
        """
        counts = self.trained_on(without)
        if sum(n > 0 for n in counts) < 2:
            return None
        present = sum(n > 0 for n in counts)
        weights = F.array(*[F.lit(sum(counts) / (present * n) if n else 0.0) for n in counts])
        rows = _few_tasks(self.rows.filter(~self.of(without)) if without else self.rows, sum(counts))
        number = F.col("_number") if number is None else number
        named = {"ml_attr": {"type": "nominal", "name": "_label", "vals": [str(c) for c in self.classes]}}
        train = rows.select("_features", number.cast("double").alias("_label", metadata=named), weights[number.cast("int")].alias("_weight"))
        forest = RandomForestClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", probabilityCol="_prob", seed=seed, **{**FOREST, **params})
        return forest.fit(train)

    def predict(self, model: RandomForestClassificationModel, rows: DataFrame) -> DataFrame:
        """``rows`` with ``y_test``, ``y_pred`` and a probability for each class; classes unseen in training get 0."""
        names = F.array(*[F.lit(c) for c in self.classes])
        probs = vector_to_array("_prob")
        kept = [c for c in dict.fromkeys([*self.keep, self.subject]) if c not in self.classes]
        return model.transform(rows).select(
            *kept, F.col(self.label).alias("y_test"), names[F.col("prediction").cast("int")].alias("y_pred"), *[probs[k].alias(str(c)) for k, c in enumerate(self.classes)]
        )

    def hits(self, model: RandomForestClassificationModel, subjects: Collection) -> dict:
        """Per subject: rows of each class that the model finds."""
        return self.hits_of_all([model], subjects)[0]

    def hits_of_all(self, models: Sequence[RandomForestClassificationModel], subjects: Collection) -> list[dict]:
        """``hits`` of each model, from one pass over the subjects' rows."""
        scored = _few_tasks(self.rows.filter(self.of(subjects)), sum(sum(self.counts[s]) for s in subjects)).select(self.subject, "_number", "_features")
        for k, model in enumerate(models):
            only = model.copy().setRawPredictionCol("").setProbabilityCol("").setPredictionCol(f"_p{k}")
            scored = only.transform(scored)
        right = [F.sum((F.col(f"_p{k}") == F.col("_number")).cast("long")).alias(f"_n{k}") for k in range(len(models))]
        out = [{s: [0] * len(self.classes) for s in subjects} for _ in models]
        for r in scored.groupBy(self.subject, "_number").agg(*right).collect():
            for k in range(len(models)):
                out[k][r[0]][int(r[1])] = int(r[2 + k])
        return out

    def balanced_accuracy(self, hits: dict, subjects: Collection) -> float:
        """Mean recall of the classes that the subjects have."""
        rows = [sum(n) for n in zip(*[self.counts[s] for s in subjects])]
        right = [sum(n) for n in zip(*[hits[s] for s in subjects])]
        recalls = [a / b for a, b in zip(right, rows) if b]
        return sum(recalls) / len(recalls)


def _few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more tasks than its rows are worth; larger tables stay as they are."""
    return df.coalesce(max(1, rows // TASK_ROWS))


def folds(df: DataFrame, features: Sequence[str], label: str, subject: str, keep: Sequence[str] = ()) -> Folds:
    """Write the labelled rows of ``df`` for training. Subjects and classes are few enough to be models and columns."""
    data = df.filter(F.col(label).isNotNull() & F.col(subject).isNotNull())
    cells = data.groupBy(subject, label).count().collect()
    classes = sorted({r[1] for r in cells})
    counts: dict = {}
    for s, c, n in cells:
        counts.setdefault(s, [0] * len(classes))[classes.index(c)] = n
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1 if classes else F.lit(0)
    assembled = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep").transform(data)
    columns = list(dict.fromkeys([*keep, subject, label]))
    return Folds(materialize(assembled.select(*columns, "_features", number.cast("int").alias("_number")), "features"), classes, counts, list(keep), label, subject)


def _spread(each: Folds) -> list:
    """Subjects with more than one class; the others are no test."""
    return [s for s in each.subjects if sum(n > 0 for n in each.counts[s]) > 1]


def _outer_models(each: Folds, seed: int, params_of: Callable[[object], dict]) -> dict:
    """For every subject that is a test, the model of all others."""
    subjects = _spread(each)
    fitted = in_parallel(each.rows.sparkSession, [lambda s=s: each.fit({s}, seed, params_of(s)) for s in subjects])
    return {s: m for s, m in zip(subjects, fitted) if m is not None}


def _predict_folds(each: Folds, models: dict, extra: Callable[[object], list[Column]] = lambda s: []) -> DataFrame:
    if not models:
        raise ValueError("no subject has more than one class")
    parts = [each.predict(m, each.rows.filter(each.of({s}))).select("*", *extra(s)) for s, m in models.items()]
    return reduce(DataFrame.unionByName, parts)


def loso_predictions(
    df: DataFrame, features: Sequence[str], label: str, subject: str, seed: int = 11, keep: Sequence[str] = (), **params
) -> DataFrame:
    """Predict each subject with a forest trained on the others; folds with one class in training or test are skipped.

    Folds are an outer loop by nature; every fit is a distributed job over the materialised feature table, some run
    at a time, and all predictions are one job.
    """
    each = folds(df, features, label, subject, keep)
    return _predict_folds(each, _outer_models(each, seed, lambda s: params))


def forest_pipeline(features: Sequence[str], label: str, classes: Sequence[str], seed: int = 11, **params) -> Pipeline:
    """Assembler, label index in the order of ``classes``, weighted forest and readable predictions."""
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="_label", weightCol="_weight", probabilityCol="_prob", seed=seed, **{**FOREST, **params}
    )
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep"),
            indexer,
            forest,
            IndexToString(inputCol="prediction", outputCol="y_pred", labels=sorted(classes)),
        ]
    )


def _weighted(df: DataFrame, label: str) -> DataFrame:
    return df.join(class_weights(df, label).select(label, F.col("weight").alias("_weight")), label)


def _classes(df: DataFrame, label: str) -> list[str]:
    return sorted(r[0] for r in df.filter(F.col(label).isNotNull()).select(label).distinct().collect())


def fit_forest(train: DataFrame, features: Sequence[str], label: str, seed: int = 11, **params) -> tuple[PipelineModel, list[str]] | None:
    """Weighted forest on ``train``; None when only one class is present."""
    classes = _classes(train, label)
    if len(classes) < 2:
        return None
    return forest_pipeline(features, label, classes, seed, **params).fit(_weighted(train, label)), classes


def _score(model: PipelineModel, classes: Sequence[str], rows: DataFrame, label: str, all_classes: Sequence[str]) -> DataFrame:
    """Predictions and one probability column per class; classes unseen in training get 0."""
    staged = rows.withColumn("_weight", F.lit(1.0))
    for stage in model.stages:
        if "StringIndexer" not in type(stage).__name__:
            staged = stage.transform(staged)
    probs = vector_to_array("_prob")
    named = [
        (probs[list(classes).index(c)] if c in classes else F.lit(0.0)).alias(c) for c in all_classes
    ]
    kept = [c for c in rows.columns if c not in all_classes]
    return staged.select(*kept, F.col(label).alias("y_test"), "y_pred", *named)


def split_predictions(
    df: DataFrame, features: Sequence[str], label: str, key: str, subject: str, test_subjects: Sequence | None = None,
    test_share: float = 0.5, seed: int = 11, **params,
) -> DataFrame:
    """Fixed train / test split for a single model: whole subjects are on one side.

    ``test_subjects`` names the test set; without it a hash of the subject chooses about ``test_share`` of them.
    """
    data = materialize(df.filter(F.col(label).isNotNull() & F.col(subject).isNotNull()), "features")
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(subject)), F.lit(10_000))
    test = bucket < int(test_share * 10_000) if test_subjects is None else F.col(subject).isin(list(test_subjects))
    fitted = fit_forest(data.filter(~test), features, label, seed, **params)
    if fitted is None:
        raise ValueError("one class in the training half")
    everything = _classes(data, label)
    return _score(*fitted, data.filter(test), label, everything).select(key, "y_test", "y_pred", *everything)


def loso_centroids(
    df: DataFrame, features: Sequence[str], label: str, subject: str, classes: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Predict each subject from the mean features of each class over the other subjects, without fitting a forest.

    The probability of a class falls with the distance from its mean; a class that only the subject itself has gets 0.
    Means come from sums by subject and class less the subject's own, so all folds take one pass.
    """
    sums = df.filter(F.col(label).isNotNull()).groupBy(subject, label).agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.sum(f) for f in features]).alias("_s"))
    sums = materialize(sums, "class-sums")
    total = sums.groupBy(label).agg(F.sum("_n").alias("_all"), F.array(*[F.sum(F.col("_s")[j]) for j in range(len(features))]).alias("_sum"))
    each = sums.select(subject).distinct().withColumn(label, F.explode(F.array(*[F.lit(c) for c in classes])))
    others = F.col("_all") - F.coalesce("_n", F.lit(0))
    mean = F.transform(F.col("_sum"), lambda t, j: (t - F.coalesce(F.col("_s")[j], F.lit(0.0))) / others)
    means = each.join(total, label).join(sums, [subject, label], "left").filter(others > 0).groupBy(subject).agg(F.map_from_entries(F.collect_list(F.struct(label, mean))).alias("_means"))
    x = F.array(*[F.col(f).cast("double") for f in features])
    apart = lambda c: F.sqrt(F.aggregate(F.zip_with("_x", F.col("_means")[c], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v))
    near = df.filter(F.col(label).isNotNull()).join(means, subject).withColumn("_x", x)
    near = near.select(*dict.fromkeys([*keep, subject]), F.col(label).alias("y_test"), *[F.coalesce(1 / (apart(c) + 1e-9), F.lit(0.0)).alias(f"_near_{c}") for c in classes])
    whole = reduce(Column.__add__, [F.col(f"_near_{c}") for c in classes])
    shares = near.select(*dict.fromkeys([*keep, subject]), "y_test", *[(F.col(f"_near_{c}") / whole).alias(c) for c in classes])
    best = F.greatest(*classes) if len(classes) > 1 else F.col(classes[0])
    return shares.withColumn("y_pred", F.coalesce(*[F.when(F.col(c) == best, F.lit(c)) for c in classes]))


# --- tuning inside each fold ---------------------------------------------------------------------


@dataclass
class Tuned:
    """``scores``: outer fold, setting, number of inner groups, mean balanced accuracy and whether it was chosen."""

    predictions: DataFrame
    scores: DataFrame


def nested_grid_search(
    df: DataFrame, features: Sequence[str], label: str, subject: str, grid: dict[str, Sequence], inner_out: int = 2, seed: int = 11,
    keep: Sequence[str] = (),
) -> Tuned:
    """Predict each subject with the parameters that score best on the other subjects alone.

    For an outer subject the others are left out in groups of ``inner_out`` (incomplete groups are not), and the
    setting with the best mean balanced accuracy over the groups is fitted again on all of them; the earlier one of
    equals. A model depends only on its setting and on whom it is fitted without, so one fit serves every
    outer fold and group that leave out the same subjects together, and one job scores it on all of those.
    """
    each = folds(df, features, label, subject, keep)
    settings = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    outer = _spread(each)
    groups: dict = {}
    for s in outer:
        rest = [o for o in each.subjects if o != s]
        cut = [tuple(rest[i : i + inner_out]) for i in range(0, len(rest) - inner_out + 1, inner_out)]
        groups[s] = [g for g in cut if sum(n > 0 for n in each.trained_on({s, *g})) > 1]
    asked = sorted({frozenset((s, *g)) for s in outer for g in groups[s]}, key=sorted)
    tasks = [(k, without) for k in range(len(settings)) for without in asked]

    def score(k: int, without: frozenset) -> dict:
        return each.hits(each.fit(without, seed, settings[k]), without)

    found = dict(zip(tasks, in_parallel(df.sparkSession, [lambda t=t: score(*t) for t in tasks])))
    rows, chosen = [], {}
    for s in outer:
        means = []
        for k in range(len(settings)):
            scores = [each.balanced_accuracy(found[k, frozenset((s, *g))], g) for g in groups[s]]
            means.append(sum(scores) / len(scores) if scores else 0.0)
        chosen[s] = max(range(len(settings)), key=lambda k: (means[k], -k))
        rows += [(s, k, str(sorted(settings[k].items())), len(groups[s]), means[k], k == chosen[s]) for k in range(len(settings))]
    kind = dict(df.dtypes)[subject]
    scores = df.sparkSession.createDataFrame(rows, f"`{subject}` {kind}, setting int, parameters string, n_folds int, balanced_accuracy double, chosen boolean")
    models = _outer_models(each, seed, lambda s: settings[chosen[s]])
    return Tuned(_predict_folds(each, models, lambda s: [F.lit(chosen[s]).alias("setting")]), scores)


# --- permutations --------------------------------------------------------------------------------


def numbered(df: DataFrame, keys: Sequence[str], order: Column, tie: str, slices: int = 64) -> DataFrame:
    """``df`` with ``_at``, the place of each row (from 1) within its keys, by a hash.

    Rows are numbered inside slices of the hash range and moved on by the slices before, so no task holds a whole key.
    """
    width = F.lit((1 << 53) / slices)
    marked = df.withColumn("_order", F.shiftrightunsigned(order, 11)).withColumn("_slice", F.floor(F.col("_order") / width).cast("int"))
    local = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy("_order", tie))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    offsets = marked.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = marked.withColumn("_local", local).join(offsets, [*keys, "_slice"])
    return placed.withColumn("_at", F.col("_before") + F.col("_local")).drop("_order", "_slice", "_local", "_before")


def shuffled_labels(each: Folds, row: str, subjects: Sequence, rounds: int, seed: int) -> DataFrame:
    """``row, _shuffled``: by place of the left-out subject and by round, a permutation of the other subjects' classes.

    For each left-out subject the rows of all others are numbered once, their classes once a round, and the numbers
    meet in one join keyed by (subject, round). The left-out subject's own rows hold nulls.
    """
    out = F.explode(F.array(*[F.struct(F.lit(k).alias("_out"), F.lit(s).alias("_who")) for k, s in enumerate(subjects)])).alias("_o")
    others = each.rows.select(row, each.subject, "_number", out).filter(F.col("_o._who") != F.col(each.subject)).select(row, "_number", "_o._out")
    others = materialize(others, "left-out")
    places = numbered(others, ["_out"], F.xxhash64(row), row).select(row, "_out", "_at")
    drawn = others.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    drawn = numbered(drawn, ["_out", "_round"], F.xxhash64(F.lit(seed), "_out", "_round", row), row).select("_out", "_round", "_at", "_number")
    by_round = drawn.groupBy("_out", "_at").agg(F.array_sort(F.collect_list(F.struct("_round", "_number"))).alias("_r"))
    labels = places.join(by_sorting(by_round), ["_out", "_at"]).select(row, "_out", F.col("_r._number").alias("_r"))
    return labels.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("_out", "_r"))).alias("_shuffled"))


def shuffled_places(places: np.ndarray, n: int, *key: int) -> np.ndarray:
    """Where a random permutation of 0 to ``n`` - 1, named by ``key``, takes ``places``; each place is moved on its own.

    A place is a cell of a grid with about the square root of ``n`` columns; in turn its row is moved by a hash of its column and
    its column by a hash of its row. Each move can be undone, so no two places meet. The few places that leave the
    range, as the grid has up to a line of cells more, are moved on until they are back in it.
    """
    wide = math.isqrt(max(n - 1, 0)) + 1
    high = -(-max(n, 1) // wide)
    salts = np.random.SeedSequence(key).generate_state(MOVES, np.uint64)

    def by(x: np.ndarray, salt: np.uint64, size: int) -> np.ndarray:
        """A hash below ``size`` (the finalizer of SplitMix64)."""
        x = x.astype(np.uint64) + salt
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def moved(x: np.ndarray) -> np.ndarray:
        row, column = x // wide, x % wide
        for k in range(0, MOVES, 2):
            row = (row + by(column, salts[k], high)) % high
            column = (column + by(row, salts[k + 1], wide)) % wide
        return row * wide + column

    out = moved(places)
    while (away := np.flatnonzero(out >= n)).size:
        out[away] = moved(out[away])
    return out


def with_drawn_labels(each: Folds, row: str, subjects: Sequence, rounds: int, seed: int) -> Folds:
    """``each`` with ``_drawn<k>`` for the k-th left-out subject: by round, a permutation of the other subjects' class numbers.

    The rows of a subject are numbered by a hash of their names, and the subjects follow each other. The places drawn hold the classes
    one after another, so the counts alone tell a place and a class: rows are sorted once, not once a round, and nothing
    is joined. The left-out subject's own rows hold nulls.
    """
    starts, ends = [], []
    for s in subjects:
        others = [o for o in each.subjects if o != s]
        starts.append(dict(zip(others, itertools.accumulate((sum(each.counts[o]) for o in others), initial=0))))
        ends.append(np.cumsum(each.trained_on({s})))
    names = [f"_drawn{k}" for k in range(len(subjects))]

    def draw(who: pa.Array, at: pa.Array) -> pa.Array:
        who, at, out = who.to_pylist(), at.to_numpy(zero_copy_only=False) - 1, []
        for k, (start, end) in enumerate(zip(starts, ends)):
            other = np.array([w in start for w in who], dtype=bool)
            places = at[other] + np.array([start[w] for w in who if w in start], dtype=np.int64)
            drawn = [np.searchsorted(end, shuffled_places(places, int(end[-1]), seed, k, r), side="right") for r in range(rounds)]
            offsets = pa.array(np.append(0, np.cumsum(other) * rounds).astype(np.int32), mask=np.append(~other, False))
            out.append(pa.ListArray.from_arrays(offsets, pa.array(np.array(drawn, dtype=np.int16).T.ravel())))
        return pa.StructArray.from_arrays(out, names=names)

    kind = StructType([StructField(c, ArrayType(ShortType())) for c in names])
    placed = numbered(each.rows, [each.subject], F.xxhash64(row), row)
    drawn = placed.withColumn("_drawn", F.arrow_udf(draw, kind)(each.subject, "_at")).select(*each.rows.columns, "_drawn.*")
    return replace(each, rows=materialize(drawn, "drawn"))


def permutation_test(
    df: DataFrame, features: Sequence[str], label: str, subject: str, row: str, rounds: int = 50, seed: int = 11, **params
) -> DataFrame:
    """Each subject's balanced accuracy against forests whose training labels were shuffled, ``rounds`` times.

    ``round`` 0 is the model itself; the left-out subject's labels stay. ``row`` names the rows. See ``permutation_p_values``.
    """
    each = folds(df, features, label, subject, [row])
    subjects = [s for s in _spread(each) if sum(n > 0 for n in each.trained_on({s})) > 1]
    if not subjects:
        raise ValueError("no subject has more than one class")
    each = with_drawn_labels(each, row, subjects, rounds, seed)
    each.rows.persist()  # a fit reads its rows four times

    def score(place: int, numbers: Sequence[int]) -> list[tuple]:
        s = subjects[place]
        fitted = [each.fit({s}, seed, params, F.col(f"_drawn{place}")[r - 1] if r else None) for r in numbers]
        return [(s, r, each.balanced_accuracy(hits, {s})) for r, hits in zip(numbers, each.hits_of_all(fitted, {s}))]

    every = range(rounds + 1)
    tasks = [(place, every[i : i + SCORED_TOGETHER]) for i in range(0, len(every), SCORED_TOGETHER) for place in range(len(subjects))]
    try:
        scores = [x for found in in_parallel(df.sparkSession, [lambda t=t: score(*t) for t in tasks]) for x in found]
    finally:
        each.rows.unpersist()
    return df.sparkSession.createDataFrame(scores, f"`{subject}` {dict(df.dtypes)[subject]}, round int, score double")


def permutation_p_values(scores: DataFrame, subject: str) -> DataFrame:
    """p = (1 + rounds at least as good) / (1 + rounds) for every subject."""
    real = scores.filter("round = 0").select(subject, F.col("score").alias("score"))
    drawn = scores.filter("round > 0").select(subject, F.col("score").alias("_drawn"))
    joined = real.join(drawn, subject, "left")
    better = F.count(F.when(F.col("_drawn") >= F.col("score"), 1))
    return joined.groupBy(subject, "score").agg(F.count("_drawn").alias("rounds"), ((better + 1) / (F.count("_drawn") + 1)).alias("p_value"))


def permutation_importance(df: DataFrame, features: Sequence[str], label: str, subject: str, row: str, seed: int = 11, **params) -> DataFrame:
    """What each feature is worth: per left-out subject and class, the share of rows found before and after permuting it.

    A feature's values are permuted among the rows of the subject: values are numbered by a seeded hash, rows by another, and
    the numbers meet in one join. Models are not fitted again, and all features of all folds are scored in one frame.
    """
    each = folds(df, features, label, subject, [row])
    models = _outer_models(each, seed, lambda s: params)
    if not models:
        raise ValueError("no subject has more than one class")
    rows = each.rows.filter(each.of(models)).withColumn("_x", vector_to_array("_features"))
    rows = numbered(rows.select(row, subject, "_number", "_x"), [subject], F.xxhash64(row), row)
    values = rows.select(row, subject, F.posexplode("_x").alias("_feature", "_value"))
    values = numbered(values, [subject, "_feature"], F.xxhash64(F.lit(seed), "_feature", row), row).select(subject, "_at", "_feature", "_value")
    changed = rows.join(values, [subject, "_at"])
    put = F.transform("_x", lambda x, k: F.when(k == F.col("_feature"), F.col("_value")).otherwise(x))
    same = rows.select(subject, "_number", F.lit(-1).alias("_feature"), F.col("_x").alias("_y"))
    every = same.unionByName(changed.select(subject, "_number", "_feature", put.alias("_y"))).withColumn("_features", array_to_vector("_y"))
    every = materialize(every.select(subject, "_number", "_feature", "_features"), "permuted")
    scored = reduce(DataFrame.unionByName, [m.transform(every.filter(each.of({s}))).select(subject, "_number", "_feature", "prediction") for s, m in models.items()])
    counts = scored.groupBy(subject, "_number", "_feature").agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col("prediction") == F.col("_number")).cast("long")).alias("_hits"))
    counts = materialize(counts, "permuted-hits")
    before = counts.filter("_feature < 0").select(subject, "_number", F.col("_hits").alias("_before"))
    names, labels = (F.array(*[F.lit(v) for v in values]) for values in (features, each.classes))
    joined = counts.filter("_feature >= 0").join(before, [subject, "_number"])
    return joined.select(
        subject, names[F.col("_feature")].alias("feature"), labels[F.col("_number")].alias("class"), F.col("_n").alias("n_rows"),
        F.col("_before").alias("found"), F.col("_hits").alias("found_permuted"), ((F.col("_before") - F.col("_hits")) / F.col("_n")).alias("drop"),
    )


def mean_importance(drops: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Mean drop over folds of the mean over the classes of a fold, as balanced accuracy weighs them."""
    folds_of = [c for c in drops.columns if c not in ("feature", "class", "n_rows", "found", "found_permuted", "drop")]
    per_fold = drops.groupBy(*dict.fromkeys([*folds_of, *by])).agg(F.avg("drop").alias("_d"))
    return per_fold.groupBy(*by).agg(F.avg("_d").alias("importance"), F.count(F.lit(1)).alias("n_folds"))


def feature_importance(
    df: DataFrame, features: Sequence[str], label: str, subject: str, seed: int = 11, **params
) -> DataFrame:
    """Mean impurity importance of every feature over the leave-one-subject-out folds."""
    each = folds(df, features, label, subject)
    fitted = in_parallel(df.sparkSession, [lambda s=s: each.fit({s}, seed, params) for s in each.subjects])
    rows = [(str(s), f, float(w)) for s, m in zip(each.subjects, fitted) if m is not None for f, w in zip(features, m.featureImportances.toArray())]
    found = df.sparkSession.createDataFrame(rows, "fold string, feature string, weight double")
    return found.groupBy("feature").agg(F.avg("weight").alias("importance"), F.count("*").alias("n_folds"))


# --- models in use -------------------------------------------------------------------------------


def deployment_fit(df: DataFrame, features: Sequence[str], label: str, path: str, seed: int = 11, **params) -> list[str]:
    """Fit on all rows and save the model; returns its classes in probability order."""
    fitted = fit_forest(df.filter(F.col(label).isNotNull()), features, label, seed, **params)
    if fitted is None:
        raise ValueError("one class only")
    fitted[0].write().overwrite().save(path)
    return fitted[1]


def routed_scoring(
    df: DataFrame,
    models: dict,
    deployment: tuple[PipelineModel, Sequence[str]],
    label: str,
    subject: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Score each subject with its own model (trained without it), others with the deployment model.

    ``models``: subject → (model, classes). Missing and infinite features are imputed first, as a forest
    would take them for values. Rows are split by subject and united again.
    """
    features = deployment[0].stages[0].getInputCols()
    df = impute_columns(df, features)
    everything = sorted({c for _, classes in [*models.values(), deployment] for c in classes})
    known = list(models)
    parts = [(m, c, F.col(subject) == F.lit(s), "own") for s, (m, c) in models.items()]
    rest = ~F.coalesce(F.col(subject).isin(*known), F.lit(False)) if known else F.lit(True)
    parts.append((*deployment, rest, "deployment"))
    out: DataFrame | None = None
    for model, classes, where, name in parts:
        scored = _score(model, classes, df.filter(where), label, everything).select(
            *dict.fromkeys([*keep, subject]), "y_test", "y_pred", F.lit(name).alias("model")
        )
        out = scored if out is None else out.unionByName(scored)
    return out
