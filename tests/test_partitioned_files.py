"""Folders of a key are listed by a few tasks, whatever their number."""

import os

import pyarrow.parquet as pq
import pytest

from sensorloom.session import scratch_path
from sensorloom.sources import files


def test_listing_takes_few_tasks(spark):
    keys, name = 300, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    rows = spark.range(2 * keys).selectExpr(f"id % {keys} AS device", "id AS us")
    path = scratch_path(spark, "by-device")
    files.write_partitioned(rows, path)
    before, context = spark.conf.get(name), spark.sparkContext
    context.setJobGroup("listing", "listing")
    found = files.read_partitioned(spark, path, rows.schema, tasks_per_core=1)
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(job).stageIds]
    assert max(tracker.getStageInfo(s).numTasks for s in stages) <= context.defaultParallelism
    assert spark.conf.get(name) == before
    assert sorted(tuple(r) for r in found.select("device", "us").collect()) == sorted((i % keys, i) for i in range(2 * keys))


def _facts(path):
    return {d: sorted(n for n in os.listdir(f"{path}/{d}") if not n.startswith(".")) for d in os.listdir(path) if "=" in d}


def test_folders_are_made_without_a_process_each(spark, tmp_path):
    """Hadoop's local file system starts one for each folder, file and checksum; a checksum beside a file tells that it wrote there."""
    path = str(tmp_path / "out")
    files.write_partitioned(spark.range(40).selectExpr("id % 20 AS device", "id AS us"), path)
    assert len(_facts(path)) == 20
    assert not [n for _, _, names in os.walk(path) for n in names if n.endswith(".crc")]


def test_folders_equal_those_of_spark(spark, tmp_path):
    """Names, rows and types, for odd keys and values of all types; an old table is replaced, and files hold at most so many rows."""
    keys = "'a', 'a b', 'ä/ö', 'x=y%', '', NULL, '[1]:{2}', '#?*^'"
    rows = spark.range(80).selectExpr(
        "id", f"element_at(array({keys}), cast(id % 8 + 1 AS int)) AS device", "if(id % 3 = 0, NULL, id / 7) AS d", "cast(id AS decimal(12, 3)) AS p",
        "timestamp_micros(id * 1234567 - 9000000000000000) AS at", "timestamp_ntz'2020-01-01 00:00:00' AS ntz", "date_add(date'1500-01-01', cast(id AS int)) AS day",
        "array(id, NULL) AS list", "map('k', id) AS m", "named_struct('a', id, 'b', cast(id AS string)) AS s", "cast('x' AS binary) AS raw", "id % 2 = 0 AS flag",
        "cast(id AS float) AS f", "cast(id AS tinyint) AS tiny",
    )
    mine, plain = str(tmp_path / "a" / "out"), str(tmp_path / "out")
    files.write_partitioned(spark.range(9).selectExpr("id AS device", "id AS us"), mine)
    files.write_partitioned(rows, f"file://{mine}", max_rows=4)
    rows.write.partitionBy("device").parquet(plain)
    assert sorted(_facts(mine)) == sorted(_facts(plain))
    assert os.listdir(tmp_path / "a") == ["out"] and os.path.exists(f"{mine}/_SUCCESS")
    found, wanted = (sorted(map(repr, files.read_partitioned(spark, p, rows.schema).collect())) for p in (mine, plain))
    assert found == wanted and len(found) == 80
    bare, wide = (spark.read.parquet(p) for p in (mine, plain))
    assert sorted(bare.dtypes) == sorted(wide.dtypes)
    assert {pq.read_metadata(f"{mine}/{d}/{n}").num_rows for d, names in _facts(mine).items() for n in names} == {4, 2}


def test_a_key_of_several_tasks_keeps_all_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "GROUP_ROWS", 7)
    rows = spark.range(0, 1000, 1, 5).selectExpr("id % 2 AS device", "id AS us")
    files._write_folders(rows, str(tmp_path / "out"), "device", 90)
    names = _facts(tmp_path / "out")
    assert {len(n) for n in names.values()} == {10}  # 100 rows a task, 90 and 10
    assert sorted(r.us for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(1000))


def test_types_that_arrow_writes_otherwise_get_the_writer_of_spark(spark, tmp_path):
    rows = spark.range(3).selectExpr("id AS device", "make_ym_interval(1, 2) AS span")
    files.write_partitioned(rows, str(tmp_path / "out"))
    found = spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).selectExpr("device", "cast(span AS string)").collect()
    assert sorted(tuple(r) for r in found) == [(i, "INTERVAL '1-2' YEAR TO MONTH") for i in range(3)]


def test_nothing_changes_when_a_task_fails(spark, tmp_path):
    path = str(tmp_path / "out")
    files.write_partitioned(spark.range(4).selectExpr("id AS device", "id AS us"), path)
    with pytest.raises(Exception):
        files.write_partitioned(spark.range(9).selectExpr("id AS device", "if(id = 7, raise_error('no'), id) AS us"), path)
    assert os.listdir(tmp_path) == ["out"] and spark.read.parquet(path).count() == 4


def test_paths_of_other_stores_are_left_to_spark(spark):
    local = lambda p: files._local_folder(spark, p)
    assert local("/a/b") == local("file:/a/b") == local("file:///a/b/") == "/a/b"
    assert [local(p) for p in ("s3a://a/b", "hdfs:///a", "file://host/a", "a/b")] == [None] * 4


def test_keys_come_from_paths(spark, tmp_path):
    """Spark's discovery of folders takes time that grows with the square of their number; keys hold what the folders' names escape."""
    keys = ["a+b", "100%", "%41", "a=b", "ü c", None]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "device string, us long")
    files.write_partitioned(rows, str(tmp_path / "out"))
    found = files.read_partitioned(spark, str(tmp_path / "out"), rows.schema)
    assert "file_path" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, rows.collect()))
