"""Shuffled labels of the permutation test: permutations that take no shuffle a round."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import models


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 20, 101, 1000, 9_999])
def test_places_are_permuted(n):
    assert sorted(models.shuffled_places(np.arange(n), n, 11, 0, 3)) == list(range(n))


def test_every_order_is_drawn_alike():
    found = Counter(tuple(models.shuffled_places(np.arange(4), 4, 11, 2, r)) for r in range(4800))
    assert len(found) == 24 and min(found.values()) > 140 and max(found.values()) < 260


def test_drawn_labels_keep_counts_and_sort_once(spark, monkeypatch):
    monkeypatch.setattr(models.shuffled_places, "__module__", "__main__")  # workers of this session do not find the package
    label = F.concat(F.lit("c"), F.when(F.col("id") % 7 == 0, 1).otherwise(F.col("id") % 3).cast("string"))
    df = spark.range(600).select(F.col("id").alias("row"), (F.col("id") % 5).alias("who"), label.alias("label"), F.rand(1).alias("x"))
    each = models.folds(df, ["x"], "label", "who", ["row"])
    seen, write = [], models.materialize
    monkeypatch.setattr(models, "materialize", lambda df, *args: (seen.append(df._jdf.queryExecution().executedPlan().toString()), write(df, *args))[1])
    rows = models.with_drawn_labels(each, "row", each.subjects, 12, 11).rows.collect()
    assert len(seen) == 1 and "Generate" not in seen[0]  # no row a round
    assert len(rows) == 600
    for k, s in enumerate(each.subjects):
        others = [r for r in rows if r.who != s]
        assert all(r[f"_drawn{k}"] is None for r in rows if r.who == s)
        assert len({tuple(r[f"_drawn{k}"][i] for r in others) for i in range(12)}) == 12
        for i in range(12):
            assert Counter(r[f"_drawn{k}"][i] for r in others) == Counter(r._number for r in others)


def test_forests_scored_together_score_as_alone(spark):
    df = spark.range(400).select(F.col("id").alias("row"), (F.col("id") % 4).alias("who"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("label"), (F.col("id") % 3 + 2 * F.rand(1)).alias("x"))
    each = models.folds(df, ["x"], "label", "who", ["row"])
    fitted = [each.fit({1}, seed, {}) for seed in (1, 2)]
    together = each.hits_of_all(fitted, {1, 2})
    for model, hits in zip(fitted, together):
        found = model.transform(each.rows.filter("who IN (1, 2)")).filter("prediction = _number")
        assert {(s, c): n for s in hits for c, n in enumerate(hits[s]) if n} == {(r.who, r._number): r["count"] for r in found.groupBy("who", "_number").count().collect()}
