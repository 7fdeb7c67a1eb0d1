"""Priority intervals and nearest places against brute force, also where one hour or one device holds most."""

import random

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import nearplaces, ranges
from tests.test_places_and_tests import _km

HOUR = 3_600_000_000


def _wins(intervals, key, t):
    found = [i[1:4] + (i[4],) for i in intervals if i[0] == key and i[1] <= t <= i[2]]
    return max(found, key=lambda i: (i[2], i[0], i[1])) if found else None


@pytest.mark.parametrize("keyed", [False, True])
def test_lookup_of_priority_intervals(spark, keyed):
    rng = random.Random(1)
    intervals = []
    for k in range(300):
        start = rng.randint(-3 * HOUR, 40 * HOUR) if k % 2 else rng.randint(5 * HOUR, 5 * HOUR + 2000)
        length = rng.choice([0, 1, 2, 3, 500, HOUR, 9 * HOUR])
        intervals.append((k % 3 if keyed else 0, start, start + length, rng.randint(0, 9), f"l{k}"))
    intervals.append((0, 10, 5, 99, "never"))
    times = [rng.randint(-4 * HOUR, 50 * HOUR) for _ in range(300)] + [rng.randint(5 * HOUR, 5 * HOUR + 3000) for _ in range(300)]
    times += [t for i in intervals for t in (i[1], i[2], i[2] + 1)]
    rows = [(n, rng.randint(0, 2) if keyed else 0, t) for n, t in enumerate(times)]
    df = spark.createDataFrame(rows, "row long, device long, us long")
    table = spark.createDataFrame(intervals, "device long, start_us long, end_us long, priority long, label string")
    if not keyed:
        table = table.drop("device")
    found = ranges.interval_lookup(df, table, ["label"], keys=["device"] if keyed else [])
    got = {r.row: (r._hit.start_us, r._hit.end_us, r._hit.priority, r._hit.label) for r in found.collect()}
    for n, device, t in rows:
        best = _wins(intervals, device, t)
        assert (n in got) == (best is not None)
        if best:
            assert got[n][:3] == best[:3]


def test_one_hour_with_many_intervals(spark):
    n = 100_000
    table = spark.range(n).select((F.col("id") * 30).alias("start_us"), (F.col("id") * 30 + 3_000).alias("end_us"), F.xxhash64("id").alias("priority"), F.col("id").cast("string").alias("label"))
    cover = ranges.disjoint_cover(table, ["label"])
    assert cover.count() <= 2 * n
    rows = spark.range(2_000).select(F.col("id").alias("row"), (F.col("id") * 1_500).alias("us"))
    found = ranges.interval_lookup(rows, table, ["label"])
    assert found.count() == 2_000
    brute = rows.join(table, rows.us.between(table.start_us, table.end_us)).groupBy("row").agg(F.max("priority").alias("best"))
    assert found.join(brute, "row").filter("_hit.priority <> best").isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "NestedLoop" not in plan


@pytest.fixture(scope="module")
def many_places(spark):
    rng = random.Random(9)
    places = [(1, f"p{k}", 50 + rng.gauss(0, 0.5), 8 + rng.gauss(0, 0.5)) for k in range(400)]
    places += [(2, "a", 10.0, 179.99), (2, "b", 10.0, -179.99), (3, "only", 0.0, 0.0)] + [(4, f"q{k}", 80 + rng.random(), rng.uniform(-180, 180)) for k in range(80)]
    fixes = [(n, rng.choice([1, 1, 1, 2, 3, 4, 5]), rng.uniform(-89, 89) if n % 4 == 0 else 50 + rng.gauss(0, 0.3), rng.uniform(-180, 180) if n % 4 == 0 else 8 + rng.gauss(0, 0.3)) for n in range(300)]
    fixes += [(900, 1, None, None), (901, 1, places[0][2], places[0][3]), (902, 4, 89.9, 100.0)]
    return spark.createDataFrame(fixes, "row long, device long, lat double, lon double"), spark.createDataFrame(places, "device long, place string, lat double, lon double"), fixes, places


def test_two_nearest_places(many_places):
    df, table, fixes, places = many_places
    got = {r.row: r for r in nearplaces.nearest_place_2(df, table).collect()}
    assert set(got) == {f[0] for f in fixes if f[1] != 5}
    one = {r.row: r.frequent_day_m for r in nearplaces.distance_to_frequent_places(df, table, table.filter("device = 2")).collect()}
    assert set(one) == {f[0] for f in fixes}
    for row, device, lat, lon in fixes:
        near = sorted((1000 * _km((lat, lon), p[2:]), p[1]) for p in places if p[0] == device) if lat is not None else []
        assert one[row] == (pytest.approx(near[0][0], abs=1e-3) if near else None)
        if device == 5:
            continue
        r = got[row]
        assert r.place_m == (pytest.approx(near[0][0], abs=1e-3) if near else None)
        assert r.second_place_m == (pytest.approx(near[1][0], abs=1e-3) if len(near) > 1 else None)


def test_labels_by_distance(many_places):
    df, table, fixes, places = many_places
    ranked = table.withColumn("priority", F.xxhash64("place") % 5)
    rank = {r.place: r.priority for r in ranked.collect()}
    got = {r.row: r for r in nearplaces.label_by_place_distance(df, ranked, 20_000, skip=F.col("row") == 8).collect()}
    for row, device, lat, lon in fixes:
        mine = [p for p in places if p[0] == device]
        hits = sorted((rank[p[1]], p[1]) for p in mine if lat is not None and 1000 * _km((lat, lon), p[2:]) < 20_000)
        want = None if row == 8 or not mine else hits[0][1] if hits else "other"
        assert got[row].place_label == want


def test_one_device_with_many_places(spark):
    places = spark.range(100_000).select(F.lit(1).alias("device"), F.col("id").cast("string").alias("place"), (50 + (F.col("id") % 317) / 1000).alias("lat"), (8 + F.floor(F.col("id") / 317) / 1000).alias("lon"))
    fixes = spark.createDataFrame([(k, 1, 50 + 0.00317 * k, 8 + 0.0029 * k) for k in range(40)] + [(99, 1, -20.0, 100.0)], "row long, device int, lat double, lon double")
    got = {r.row: r for r in nearplaces.nearest_place_2(fixes, places).collect()}
    table = [(r.place, r.lat, r.lon) for r in places.collect()]
    for f in fixes.collect():
        close = [p for p in table if abs(p[1] - f.lat) < 0.01 and abs(p[2] - f.lon) < 0.01] or table
        near = sorted(1000 * _km((f.lat, f.lon), p[1:]) for p in close)
        assert (got[f.row].place_m, got[f.row].second_place_m) == (pytest.approx(near[0], abs=1e-3), pytest.approx(near[1], abs=1e-3))
