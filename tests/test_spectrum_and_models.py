"""Spectra against numpy, tails against exact sums, and the protocol of tuning and permutations."""

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import evaluation, models, spectrum


@pytest.mark.parametrize("task_rows", [65_536, 5])
def test_spectra_of_any_length(spark, task_rows):
    rng = np.random.default_rng(1)
    lengths = [1, 2, 3, 7, 16, 37, 100, 337] + [50] * 5
    series = {k: rng.normal(size=(n, 2)) + 3 for k, n in enumerate(lengths)}
    rows = [(k, k % 2, int(10 * i), i, float(a), None if i == 1 else float(b)) for k, xs in series.items() for i, (a, b) in enumerate(xs)]
    df = spark.createDataFrame(rows, "seg long, side long, us long, tie long, a double, b double").repartition(5)
    found = spectrum.segment_fft(df, ["a", "b"], ["seg", "side"], tie=["tie"], task_rows=task_rows)
    got = defaultdict(dict)
    for r in found.collect():
        assert r.n_rows == lengths[r.seg] and r.k not in got[r.seg, r.column]
        got[r.seg, r.column][r.k] = r.fft_abs
    for k, xs in series.items():
        xs = xs.copy()
        xs[1:2, 1] = 0
        for j, c in enumerate("ab"):
            want = np.abs(np.fft.rfft(xs[:, j]))
            assert np.allclose([got[k, c][i] for i in range(len(want))], want, atol=1e-9) and len(got[k, c]) == len(want)
    top = {(r.seg, r.column): r.dominant_hz for r in spectrum.dominant_frequency(found, 10, keys=["seg", "side"]).collect()}
    assert top == {(k, c): 10 * min(i for i, v in own.items() if v >= max(own.values()) * (1 - 1e-9)) / lengths[k] for (k, c), own in got.items()}


def test_binomial_tail(spark):
    cases = [(n, x, k) for n in (1, 2, 5, 30, 400) for x in range(0, n + 1, max(1, n // 7)) for k in (1, 2, 3, 7)]
    df = spark.createDataFrame(cases, "n long, x long, k long")
    for r in df.withColumn("p", evaluation.binomial_tail(F.col("x"), F.col("n"), 1 / F.col("k"))).collect():
        p = Fraction(1, r.k)
        want = float(sum(math.comb(r.n, x) * p**x * (1 - p) ** (r.n - x) for x in range(r.x, r.n + 1)))
        assert abs(r.p - want) <= 1e-11 + 1e-9 * want
    n = 10**10
    far = spark.createDataFrame([(n, n // 2 + int(z * math.sqrt(n) / 2)) for z in (-2, 0, 1, 3)], "n long, x long")
    for r in far.withColumn("p", evaluation.binomial_tail(F.col("x"), F.col("n"), F.lit(0.5))).collect():
        z = (r.x - 0.5 - n / 2) / (math.sqrt(n) / 2)
        assert abs(r.p - 0.5 * math.erfc(z / math.sqrt(2))) < 1e-6


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [(k, k % 4, ["x", "y", "z"][k % 3], float((k % 3) * 2 + rng.normal()), float(rng.normal())) for k in range(240)]
    rows += [(1000 + k, 9, "x", 0.0, 0.0) for k in range(5)] + [(2000, 1, None, 0.0, 0.0)]  # one class only; no label
    return spark.createDataFrame(rows, "row long, device long, label string, f double, g double")


def test_loso_and_importance(spark, table):
    got = models.loso_predictions(table, ["f", "g"], "label", "device", keep=["row"], numTrees=5).collect()
    assert sorted(r.row for r in got) == list(range(240))
    assert np.mean([r.y_test == r.y_pred for r in got]) > 0.6
    assert all(abs(r.x + r.y + r.z - 1) < 1e-9 for r in got)
    drops = models.permutation_importance(table, ["f", "g"], "label", "device", "row", numTrees=5)
    worth = {r.feature: r.importance for r in models.mean_importance(drops).collect()}
    assert worth["f"] > 0.2 > abs(worth["g"])
    by_class = {(r.feature, r["class"]): r.n_folds for r in models.mean_importance(drops, ["feature", "class"]).collect()}
    assert by_class == {(f, c): 4 for f in "fg" for c in "xyz"}


def test_tuning_leaves_its_subject_out(spark, table, monkeypatch):
    fits = []
    whole = models.Folds.fit
    monkeypatch.setattr(models.Folds, "fit", lambda self, without, seed, params, *more: fits.append((frozenset(without), str(params))) or whole(self, without, seed, params, *more))
    tuned = models.nested_grid_search(table, ["f", "g"], "label", "device", {"maxDepth": [1, 4], "numTrees": [3]}, inner_out=1, keep=["row"])
    scores = tuned.scores.collect()
    assert len(fits) == len(set(fits))  # a model without {a, b} serves both
    for s in range(4):
        own = sorted((r for r in scores if r.device == s), key=lambda r: r.setting)
        best = max(own, key=lambda r: (r.balanced_accuracy, -r.setting))
        assert [r.chosen for r in own] == [r.setting == best.setting for r in own] and {r.n_folds for r in own} == {4}
        used = {r.setting for r in tuned.predictions.filter(F.col("device") == s).select("setting").distinct().collect()}
        assert used == {best.setting}
    assert sorted(r.row for r in tuned.predictions.collect()) == list(range(240))


def test_permutations_keep_counts_and_the_left_out(spark, table):
    each = models.folds(table, ["f", "g"], "label", "device", ["row"])
    labels = {r.row: r._shuffled for r in models.shuffled_labels(each, "row", [0, 1], 3, 5).collect()}
    rows = {r.row: (r.device, r._number) for r in each.rows.collect()}
    for place, s in enumerate([0, 1]):
        others = [k for k, (d, _) in rows.items() if d != s]
        assert all(place not in labels[k] for k, (d, _) in rows.items() if d == s and k in labels)
        for r in range(3):
            drawn = [labels[k][place][r] for k in others]
            assert sorted(drawn) == sorted(rows[k][1] for k in others) and drawn != [rows[k][1] for k in others]
    found = models.permutation_p_values(models.permutation_test(table, ["f", "g"], "label", "device", "row", rounds=4, numTrees=3), "device").collect()
    assert sorted(r.device for r in found) == [0, 1, 2, 3]
    assert all(r.p_value * 5 == round(r.p_value * 5) and r.rounds == 4 for r in found) and min(r.p_value for r in found) == 0.2
