"""Queries: evaluation and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sensorloom.operators import evaluation, models
from sensorloom.plans import views as v
from sensorloom.plans.q_features import rounded
from sensorloom.plans.registry import query
from sensorloom.plans.views import sql_with
from sensorloom.session import materialize, scratch_path

_CL = v.CLASSES


def _metric_sql(by: str, average: str) -> str:
    """Metrics from the confusion cells; ``by`` is a column list or empty."""
    b = f"{by}, " if by else ""
    g = f" GROUP BY {by}" if by else ""
    w = "support" if average == "weighted" else "1.0"
    return f"""SELECT {b}CAST(sum(support) AS BIGINT) AS n_rows, round(sum(hits) / sum(support)::DOUBLE, 6) AS accuracy,
      round(avg(CASE WHEN support > 0 THEN hits / support::DOUBLE END), 6) AS balanced_accuracy,
      round(sum({w} * CASE WHEN support + guessed = 0 THEN 0 ELSE 2 * hits / (support + guessed)::DOUBLE END) / sum({w}), 6) AS f1,
      round(sum({w} * CASE WHEN guessed = 0 THEN 0 ELSE hits / guessed::DOUBLE END) / sum({w}), 6) AS precision,
      round(sum({w} * CASE WHEN support = 0 THEN 0 ELSE hits / support::DOUBLE END) / sum({w}), 6) AS recall
      FROM (SELECT {b}class, count(*) FILTER (class = y_test) AS support, count(*) FILTER (class = y_pred) AS guessed,
        count(*) FILTER (class = y_test AND class = y_pred) AS hits FROM PRED, (SELECT unnest(['c0', 'c1', 'c2', 'c3', 'other']) AS class)
        GROUP BY {b}class HAVING count(*) FILTER (class = y_test OR class = y_pred) > 0){g}"""


@query("classification_metrics", sql_with("prediction", _metric_sql("", "macro").replace("PRED", "prediction")))
def _classification_metrics(spark, d):
    return rounded(evaluation.classification_metrics(v.prediction(spark, d)))


@query("metrics_per_subject", sql_with("prediction", _metric_sql("subject", "weighted").replace("PRED", "prediction")))
def _metrics_per_subject(spark, d):
    return rounded(evaluation.classification_metrics(v.prediction(spark, d), ["subject"], "weighted"))


@query(
    "metrics_fold_summary",
    sql_with(
        "prediction",
        """SELECT count(*) AS n_folds, round(avg(accuracy), 5) AS accuracy_mean, round(stddev_pop(accuracy), 5) AS accuracy_std,
        round(avg(balanced_accuracy), 5) AS balanced_accuracy_mean, round(stddev_pop(balanced_accuracy), 5) AS balanced_accuracy_std FROM m""",
        "m AS (" + _metric_sql("subject", "weighted").replace("PRED", "prediction") + ")",
    ),
)
def _metrics_fold_summary(spark, d):
    per_subject = rounded(evaluation.classification_metrics(v.prediction(spark, d), ["subject"], "weighted"))
    return rounded(evaluation.metrics_fold_summary(per_subject), 5)


@query(
    "confusion_matrix",
    sql_with(
        "prediction",
        "SELECT CAST(substr(y_test, 2) AS BIGINT) AS class_no, y_test AS true_class, " + ", ".join(
            f"count(*) FILTER (y_pred = '{c}') AS {c}, round(count(*) FILTER (y_pred = '{c}') / count(*)::DOUBLE, 6) AS {c}_share" for c in _CL
        ) + " FROM prediction GROUP BY y_test",
    ),
)
def _confusion_matrix(spark, d):
    return rounded(evaluation.confusion_matrix(v.prediction(spark, d), _CL))


@query(
    "binomial_test",
    sql_with(
        "prediction",
        """SELECT subject, n, hits, k, round(sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) - x * ln(k) + (n - x) * ln((k - 1) / k::DOUBLE))), 6) AS p_value
        FROM (SELECT subject, count(*) AS n, count(*) FILTER (y_test = y_pred) AS hits, count(DISTINCT y_test) AS k FROM prediction GROUP BY subject),
        LATERAL (SELECT unnest(range(hits, n + 1)) AS x) GROUP BY subject, n, hits, k""",
    ),
)
def _binomial_test(spark, d):
    return rounded(evaluation.binomial_test(v.prediction(spark, d), ["subject"]))


# --- one prediction per class -----------------------------------------------------------------


def _assign_sql(limits: str) -> str:
    """Serve the classes in turn: three candidates each, the first free one is taken if good enough."""
    out = [f"lim AS (SELECT unnest({limits}) AS p)", "tk AS (SELECT NULL::DOUBLE AS p, NULL::BIGINT AS subject, NULL::BIGINT AS vec_id, NULL::VARCHAR AS cls WHERE false)"]
    taken = "tk"
    for i, c in enumerate(_CL):
        out.append(
            f"q{i} AS (SELECT p, subject, vec_id, {c} AS pr, row_number() OVER (PARTITION BY p, subject ORDER BY {c} DESC, vec_id) AS rn FROM prediction, lim)"
        )
        out.append(
            f"f{i}x AS (SELECT * FROM q{i} q WHERE rn <= 3 AND NOT EXISTS (SELECT 1 FROM {taken} t WHERE t.p = q.p AND t.subject = q.subject AND t.vec_id = q.vec_id) "
            f"QUALIFY row_number() OVER (PARTITION BY p, subject ORDER BY rn) = 1)"
        )
        out.append(f"t{i} AS (SELECT * FROM {taken} UNION ALL SELECT p, subject, vec_id, '{c}' FROM f{i}x WHERE pr >= p)")
        taken = f"t{i}"
    out.append(
        f"asg AS (SELECT pr.*, lim.p, coalesce(t.cls, 'other') AS y_pred_final FROM prediction pr CROSS JOIN lim "
        f"LEFT JOIN {taken} t ON t.p = lim.p AND t.subject = pr.subject AND t.vec_id = pr.vec_id)"
    )
    return ", ".join(out)


@query("one_per_class", sql_with("prediction", "SELECT vec_id, subject, y_test, y_pred_final FROM asg", _assign_sql("[0.6::DOUBLE]")))
def _one_per_class(spark, d):
    out = evaluation.one_per_class(v.prediction(spark, d), _CL, 0.6, row="vec_id")
    return out.select("vec_id", "subject", "y_test", "y_pred_final")


_STEPS = [i / 20 for i in range(1, 20)]


@query(
    "one_per_class_sweep",
    sql_with(
        "prediction",
        "SELECT p AS probability, balanced_accuracy, precision FROM ("
        + _metric_sql("p", "macro").replace("PRED", "(SELECT p, y_test, y_pred_final AS y_pred FROM asg)")
        + ")",
        _assign_sql("[" + ", ".join(f"{p}::DOUBLE" for p in _STEPS) + "]"),
    ),
)
def _one_per_class_sweep(spark, d):
    return rounded(evaluation.one_per_class_sweep(v.prediction(spark, d), _CL, _STEPS, row="vec_id"))


@query(
    "place_mapping",
    sql_with(
        "gps prediction",
        """SELECT subject, y_pred_final AS class, arg_min(lat, vec_id) AS lat, arg_min(lon, vec_id) AS lon,
        round(arg_min(CASE y_pred_final WHEN 'c0' THEN c0 WHEN 'c1' THEN c1 WHEN 'c2' THEN c2 ELSE c3 END, vec_id), 6) AS probability
        FROM asg JOIN gps ON event_id = vec_id WHERE y_pred_final <> 'other' GROUP BY subject, y_pred_final""",
        _assign_sql("[0.2::DOUBLE]"),
    ),
)
def _place_mapping(spark, d):
    assigned = evaluation.one_per_class(v.prediction(spark, d), _CL, 0.2, row="vec_id")
    located = assigned.join(v.gps(spark, d).select(F.col("event_id").alias("vec_id"), "lat", "lon"), "vec_id")
    return evaluation.place_mapping(located, _CL, row="vec_id").withColumn("probability", F.round("probability", 6))


@query(
    "run_comparison",
    sql_with(
        "prediction",
        "SELECT * FROM (SELECT *, 'all' AS dataset, 'macro' AS segment FROM ma UNION ALL SELECT *, 'all', 'weighted' FROM mw) ORDER BY dataset, segment",
        "ma AS (" + _metric_sql("", "macro").replace("PRED", "prediction") + "), mw AS (" + _metric_sql("", "weighted").replace("PRED", "prediction") + ")",
    ),
)
def _run_comparison(spark, d):
    frame = v.prediction(spark, d)
    runs = [({"dataset": "all", "segment": a}, evaluation.classification_metrics(frame, average=a)) for a in ("weighted", "macro")]
    return rounded(evaluation.run_comparison(runs, ["dataset", "segment"]))


# --- models -----------------------------------------------------------------------------------

_FEATURES = [f"f{i}" for i in range(v.N_FEATURES)]


def _table(spark, d):
    return v.feature_matrix(spark, d).withColumn("label", F.concat(F.lit("c"), (F.col("label") % 4).cast("string")))


@query("loso_predictions")
def _loso_predictions(spark, d):
    return rounded(models.loso_predictions(_table(spark, d), _FEATURES, "label", "device", keep=["vec_id"]))


@query("split_predictions")
def _split_predictions(spark, d):
    return rounded(models.split_predictions(_table(spark, d), _FEATURES, "label", "vec_id", "device", [0, 1, 2]))


def _folds_sql(more: str) -> str:
    """Facts of leave-one-subject-out results that hold whatever the forests are."""
    return "SELECT vec_id % 6 AS device, " + more + " FROM embeddings WHERE label IS NOT NULL GROUP BY ALL"


def _prediction_facts(predictions, subject="device"):
    """Per subject: rows, and whether every row has one whole probability and the class that has the most of it."""
    whole = F.abs(sum((F.col(c) for c in _CL), F.lit(0.0)) - 1) < 1e-9
    is_best = F.coalesce(*[F.when(F.col("y_pred") == c, F.col(c)) for c in _CL]) == F.greatest(*_CL)
    return predictions.groupBy(subject).agg(F.count("*").alias("n_rows"), F.count_distinct("vec_id").alias("n_ids"), F.bool_and(whole).alias("whole"), F.bool_and(is_best).alias("best"))


_FACTS = _folds_sql("count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids, true AS whole, true AS best")
_GRID = {"numTrees": [10, 20], "maxDepth": [3, 5], "minInstancesPerNode": [1, 5]}


@query("loso_prediction_facts", _FACTS)
def _loso_prediction_facts(spark, d):
    return _prediction_facts(models.loso_predictions(_table(spark, d), _FEATURES, "label", "device", keep=["vec_id"]))


@query("split_prediction_facts", "SELECT device, n_rows, n_ids, whole, best FROM (" + _FACTS + ") WHERE device IN (0, 1, 2)")
def _split_prediction_facts(spark, d):
    found = models.split_predictions(_table(spark, d), _FEATURES, "label", "vec_id", "device", [0, 1, 2])
    return _prediction_facts(found.withColumn("device", F.col("vec_id") % 6))


@query("loso_evaluation")
def _loso_evaluation(spark, d):
    """Metrics of the forests' own predictions, by subject and over all."""
    found = materialize(models.loso_predictions(_table(spark, d), _FEATURES, "label", "device", keep=["vec_id"]), "predictions")
    of_subjects = evaluation.classification_metrics(found, ["device"], "weighted").withColumn("device", F.col("device").cast("string"))
    return rounded(of_subjects.unionByName(evaluation.classification_metrics(found, average="macro").withColumn("device", F.lit("all"))))


@query("loso_grid_search")
def _loso_grid_search(spark, d):
    return rounded(models.nested_grid_search(_table(spark, d), _FEATURES, "label", "device", _GRID).scores)


@query("nested_predictions")
def _nested_predictions(spark, d):
    return rounded(models.nested_grid_search(_table(spark, d), _FEATURES, "label", "device", _GRID, keep=["vec_id"]).predictions)


@query(
    "nested_search_facts",
    "SELECT device, 8::BIGINT AS n_settings, true AS chosen_is_best, n_rows, whole, best, true AS same_setting FROM (" + _FACTS + ")",
)
def _nested_search_facts(spark, d):
    """The chosen setting recomputed from the scores, and predictions made with it."""
    tuned = models.nested_grid_search(_table(spark, d), _FEATURES, "label", "device", _GRID, keep=["vec_id"])
    first = F.min_by("setting", F.struct(-F.col("balanced_accuracy"), "setting"))
    scores = tuned.scores.groupBy("device").agg(F.count("*").alias("n_settings"), first.alias("_best"), F.min(F.when(F.col("chosen"), F.col("setting"))).alias("_chosen"))
    found = materialize(tuned.predictions, "predictions")
    facts = _prediction_facts(found).drop("n_ids").join(found.groupBy("device").agg(F.min("setting").alias("_low"), F.max("setting").alias("_high")), "device")
    same = (F.col("_low") == F.col("_chosen")) & (F.col("_high") == F.col("_chosen"))
    return facts.join(scores, "device").select("device", "n_settings", (F.col("_best") == F.col("_chosen")).alias("chosen_is_best"), "n_rows", "whole", "best", same.alias("same_setting"))


@query("permutation_test")
def _permutation_test(spark, d):
    scores = materialize(models.permutation_test(_table(spark, d), _FEATURES, "label", "device", "vec_id"), "permutation-scores")
    return rounded(models.permutation_p_values(scores, "device"))


@query(
    "shuffled_label_facts",
    """SELECT device AS left_out, r AS round, 'c' || CAST(label % 4 AS VARCHAR) AS label, count(*) AS n_rows, true AS moved
    FROM (SELECT DISTINCT vec_id % 6 AS device FROM embeddings) JOIN embeddings ON vec_id % 6 <> device, (SELECT unnest(range(1, 51)) AS r) GROUP BY ALL""",
)
def _shuffled_label_facts(spark, d):
    """Every round of every left-out subject keeps the other subjects' label counts, and moves labels."""
    each = models.folds(_table(spark, d), _FEATURES, "label", "device", ["vec_id"])
    drawn = models.with_drawn_labels(each, "vec_id", each.subjects, 50, 11).rows
    out = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("left_out"), F.col(f"_drawn{k}").alias("_r")) for k, s in enumerate(each.subjects)])).alias("_o")
    rows = drawn.select("_number", out).select("_o.left_out", "_number", F.posexplode("_o._r").alias("round", "new"))
    moved = F.bool_or(F.col("_number") != F.col("new")).alias("moved")
    names = F.array(*[F.lit(c) for c in each.classes])
    return rows.groupBy("left_out", (F.col("round") + 1).cast("long").alias("round"), names[F.col("new")].alias("label")).agg(F.count("*").alias("n_rows"), moved)


@query("feature_importance")
def _feature_importance(spark, d):
    return rounded(models.feature_importance(_table(spark, d), _FEATURES, "label", "device"))


@query("feature_importance_facts", "SELECT count(*) AS n_features, 6::BIGINT AS n_folds, 1.0::DOUBLE AS total FROM (SELECT unnest(range(64)))")
def _feature_importance_facts(spark, d):
    found = models.feature_importance(_table(spark, d), _FEATURES, "label", "device")
    return found.agg(F.count("*").alias("n_features"), F.max("n_folds").alias("n_folds"), F.round(F.sum("importance"), 6).alias("total"))


@query("permutation_importance")
def _permutation_importance(spark, d):
    drops = models.permutation_importance(_table(spark, d), _FEATURES, "label", "device", "vec_id")
    return rounded(drops)


@query(
    "permutation_importance_facts",
    """SELECT device, 'c' || CAST(label % 4 AS VARCHAR) AS class, 64::BIGINT AS n_features, count(*) AS n_rows, true AS drops_add_up, 1::BIGINT AS n_found
    FROM (SELECT vec_id % 6 AS device, label FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL""",
)
def _permutation_importance_facts(spark, d):
    """Rows by subject and class, each scored once a feature; drops recomputed from the hits; one baseline for all features."""
    drops = models.permutation_importance(_table(spark, d), _FEATURES, "label", "device", "vec_id")
    exact = F.abs(F.col("drop") - (F.col("found") - F.col("found_permuted")) / F.col("n_rows")) < 1e-12
    return drops.groupBy("device", "class").agg(
        F.count_distinct("feature").alias("n_features"), F.max("n_rows").alias("n_rows"), F.bool_and(exact & (F.col("found_permuted") <= F.col("n_rows"))).alias("drops_add_up"),
        F.count_distinct("found").alias("n_found"),
    )


@query("deployment_fit")
def _deployment_fit(spark, d):
    path = scratch_path(spark, "model")
    table = _table(spark, d)
    classes = models.deployment_fit(table, _FEATURES, "label", path)
    return models.routed_scoring(table, {}, (PipelineModel.load(path), classes), "label", "device", keep=["vec_id"])


def _routed(spark, d):
    """Every subject has a model of its own but the last, as a participant without one."""
    table = _table(spark, d)
    known = models.subject_values(table, "device")[:-1]
    fits = models.in_parallel(spark, [lambda: models.fit_forest(table, _FEATURES, "label"), *[lambda s=s: models.fit_forest(table.filter(F.col("device") != s), _FEATURES, "label") for s in known]])
    return models.routed_scoring(table, dict(zip(known, fits[1:])), fits[0], "label", "device", keep=["vec_id"])


@query("routed_scoring")
def _routed_scoring(spark, d):
    return _routed(spark, d)


@query(
    "routed_scoring_facts",
    """SELECT device, CASE WHEN device = max(device) OVER () THEN 'deployment' ELSE 'own' END AS model, n_rows, true AS known_class
    FROM (SELECT vec_id % 6 AS device, count(*) AS n_rows FROM embeddings GROUP BY ALL)""",
)
def _routed_scoring_facts(spark, d):
    return _routed(spark, d).groupBy("device", "model").agg(F.count("*").alias("n_rows"), F.bool_and(F.col("y_pred").isin(*_CL)).alias("known_class"))
