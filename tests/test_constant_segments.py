"""Segments whose values are all equal have no variance, however their rows lie."""

from pyspark.sql import functions as F

from sensorloom.operators.features import segment_features_ext


def test_constants_have_no_variance(spark):
    values = [29.27, 0.1, 122.79, 2.11, 560.21, *map(float, range(1, 60))]
    rows = [(s, 0, 0, t, t, v) for s, v in enumerate(values) for t in range(49)]
    df = spark.createDataFrame(rows, "device long, event_us long, segment long, us long, event_id long, x double").repartition(7, F.col("event_id"))
    out = {r["device"]: r for r in segment_features_ext(df, ["x"], tie=["event_id"]).collect()}
    assert len(out) == len(values)
    for r in out.values():
        assert r["variance"] == 0 and r["skewness"] is None and r["kurtosis"] is None and r["autocorrelation_lag_1"] is None
