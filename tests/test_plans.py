"""Plan shapes that must hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sensorloom.operators import asof, identity, ordered, summaries
from sensorloom.session import shared_dir
from sensorloom.sources import files

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    "event_window_join asof_nearest_merge session_bounds clip_to_session stays stay_records tumbling_segments haversine_pairs "
    "static_windows place_visits place_timeslots nearest_place_2 sensor_sanity mann_whitney_u".split(),
)
def test_no_nested_loops(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["nearest_fix_asymmetric", "session_bounds", "distance_speed_accel"])
def test_row_windows_are_sliced(spark, name):
    """Windows over rows are partitioned by device and slice; only per-slice summaries use the device alone."""
    plan = _plan(entry.queries()[name](spark, SF))
    assert re.search(r"hashpartitioning\([^)]*(_slice|_part)", plan)


def test_carry_join_reuses_the_window_shuffle(spark):
    """Between the window on (device, slice) and the join of the carried values rows are not shuffled again."""
    df = spark.range(1000).select((F.col("id") % 3).alias("device"), (F.col("id") * 1_000_000).alias("us"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(ordered.previous_row(df, []))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(re.findall(r"Exchange hashpartitioning\(_part", plan)) == 2  # rows, and the per-slice groups


def test_null_keys_keep_their_neighbours(spark):
    df = spark.createDataFrame([(None, 1), (None, 5), (None, 100), (1, 2)], "device long, us long")
    got = {(r["device"], r["us"]): r["_prev"] for r in ordered.previous_row(df, [], slice_us=10).collect()}
    assert got[None, 100]["us"] == 5 and got[None, 5]["us"] == 1 and got[1, 2] is None


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(entry.queries()["keep_classes"](spark, SF))
    assert "EqualTo(event_type,purchase)" in plan
    assert "value" not in re.search(r"ReadSchema: (\S+)", plan).group(1)


def test_top_per_group_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in _plan(entry.queries()["dedupe_keep_first"](spark, SF))


class _Session:
    """Stands in for a session with given settings."""

    def __init__(self, master, settings):
        self.conf = settings
        self.sparkContext = type("C", (), {"master": master, "applicationId": "app-test"})()


def test_shared_folder_comes_from_the_session():
    assert shared_dir(_Session("yarn", {"spark.checkpoint.dir": "hdfs:///shared"})) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        shared_dir(_Session("yarn", {}))


def test_summary_csv_round_trip(spark, tmp_path):
    files.write_summary_csv(spark.createDataFrame([("a", 1)], "name string, n long"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["n"] == "1"


def test_codes_are_unique_and_kept(spark):
    ids = spark.range(3000).select(F.concat(F.lit("ap"), F.col("id")).alias("bssid"))
    known = identity.anonymize_ids(ids.limit(1000), "bssid")
    both = identity.anonymize_ids(ids, "bssid", known)
    assert both.count() == both.select("code").distinct().count() == 3000
    assert both.join(known, ["bssid", "code"]).count() == 1000


def test_margins(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", None)], "r string, c long")
    got = {r["r"]: (r["1"], r["2"], r["total"]) for r in summaries.contingency_margins(df, "r", "c", [1, 2]).collect()}
    assert got == {"a": (1, 1, 2), "b": (1, 0, 1), "total": (2, 1, 3)}


def test_a_busy_hour_of_one_device_is_split(spark, monkeypatch):
    """As-of merges measure their slices: here one device has nearly all rows, nearly all of them in one hour."""
    monkeypatch.setattr(ordered, "TARGET_ROWS", 500)
    busy = spark.range(20_000).select(F.lit(1).alias("device"), (F.col("id") * 180_000).alias("us"), F.lit(0).alias("event_us"))
    quiet = spark.range(50).select((F.col("id") % 9 + 2).cast("int").alias("device"), (F.col("id") * 3_600_000_000).alias("us"), F.lit(0).alias("event_us"))
    left = busy.unionByName(quiet)
    right = left.withColumn("us", F.col("us") + 40_000).withColumn("v", F.col("us"))
    width = asof.measured_slice([left, right], 100_000, ["device"], "us")
    fullest = left.unionByName(right.drop("v")).groupBy("device", F.floor(F.col("us") / width)).count().agg(F.max("count")).first()[0]
    assert width < 3_600_000_000 and fullest <= 500
    found = asof.asof_nearest(left, right, ["v"], 100_000, 100_000)
    assert found.filter("matched_us = us + 40000 AND v = us + 40000").count() == left.count()
    assert asof.asof_nearest(left, right, ["v"], 100_000, 100_000, slice_us=3_600_000_000).exceptAll(found).isEmpty()
