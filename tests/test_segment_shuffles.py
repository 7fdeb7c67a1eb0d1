"""Segment statistics shuffle the rows once, and large segments, scanned in slices, get the same."""

import random

import pytest
from pyspark.sql import functions as F

from sensorloom.operators.features import segment_features_ext

HOUR_US = 3_600_000_000


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    value = lambda: rng.choice([None, float("nan"), 1.5, 2.0, *[rng.uniform(-9, 9) for _ in range(9)]])
    data = []
    for s, n in enumerate([1, 2, 3, 4, 9, 40, 150]):
        times = sorted(rng.randrange(30 * HOUR_US) for _ in range(n))
        clean = rng.random() < 0.5
        data += [(s % 2, 0, s, t if n < 40 else times[i // 3], i, rng.uniform(-9, 9) if clean else value(), float(rng.randrange(3))) for i, t in enumerate(times)]
    return spark.createDataFrame(data, "device long, event_us long, segment long, us long, event_id long, x double, y double").repartition(5)


def test_rows_are_shuffled_once(rows):
    plan = segment_features_ext(rows, ["x", "y"], tie=["event_id"])._jdf.queryExecution().executedPlan().toString()
    shuffles = plan.count("Exchange hashpartitioning")
    assert shuffles == 1, plan


@pytest.mark.parametrize("whole_rows", [0, 5, 60])
def test_large_segments_get_the_same(rows, whole_rows):
    def found(**how):
        out = segment_features_ext(rows, ["x", "y"], tie=["event_id"], **how)
        out = out.select([F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])
        return out.columns, sorted(repr(tuple(r)) for r in out.collect())

    names, whole = found()
    assert len(whole) == 14 and found(whole_rows=whole_rows, slice_us=HOUR_US) == (names, whole)
