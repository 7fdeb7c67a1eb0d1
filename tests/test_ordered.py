"""Sliced scans against plain Python, for several slice widths."""

import random

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import asof, ordered, ranges

SLICES = [7, 100, 10_000]


def _series(seed, n=120, devices=3, span=400):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(devices), rng.randrange(-span, span), rng.randrange(3)) for i in range(n)]
    return rows


def _ordered(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("slice_us", [*SLICES, None])
def test_neighbours_sums_and_runs(spark, slice_us):
    rows = _series(1)
    df = spark.createDataFrame(rows, "id long, device long, us long, p long")
    kw = dict(tie=["id"], slice_us=slice_us)
    out = ordered.previous_row(df, ["p"], **kw)
    out = ordered.previous_two_rows(out, ["p"], into=("_a", "_b"), **kw)
    out = ordered.running_sum(out, F.col("p"), "s", **kw)
    out = ordered.run_number(out, "p", "run", **kw)
    out = ordered.row_index(out, "i", **kw)
    got = {r["id"]: r for r in out.collect()}
    for series in _ordered(rows).values():
        total, run = 0, 0
        for i, (ident, _, _, p) in enumerate(series):
            total += p
            run += int(i == 0 or series[i - 1][3] != p)
            r = got[ident]
            assert (r["i"], r["s"], r["run"]) == (i, total, run)
            assert (r["_prev"]["id"] if r["_prev"] else None) == (series[i - 1][0] if i else None)
            assert (r["_a"]["id"] if r["_a"] else None) == (series[i - 1][0] if i else None)
            assert (r["_b"]["id"] if r["_b"] else None) == (series[i - 2][0] if i > 1 else None)


def test_null_starts_its_own_run(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, None), (1, 3, None), (1, 4, 1)], "device long, us long, p long")
    runs = [r["run"] for r in ordered.run_number(df, "p", "run", slice_us=2).orderBy("us").collect()]
    assert runs == [1, 2, 3, 4]


@pytest.mark.parametrize("slice_us", SLICES)
def test_count_within(spark, slice_us):
    rows = _series(2)
    df = spark.createDataFrame(rows, "id long, device long, us long, p long")
    out = ordered.count_within(df, {"b": (-30, -1), "a": (0, 29)}, slice_us=slice_us).collect()
    assert len(out) == len(rows)
    for r in out:
        near = [x[2] - r["us"] for x in rows if x[1] == r["device"]]
        assert r["b"] == sum(-30 <= g <= -1 for g in near)
        assert r["a"] == sum(0 <= g <= 29 for g in near)


def _brute_nearest(at, candidates, before, after):
    """Nearest candidate (us, id); ties go to the earlier time; duplicates: last looking back, first looking ahead."""
    back = [c for c in candidates if 0 <= at - c[0] <= before]
    ahead = [c for c in candidates if 0 <= c[0] - at <= after]
    prev, nxt = (max(back) if back else None), (min(ahead) if ahead else None)
    if prev and nxt:
        return prev if at - prev[0] <= nxt[0] - at else nxt
    return prev or nxt


@pytest.mark.parametrize("slice_us", SLICES)
@pytest.mark.parametrize("before,after", [(20, 20), (15, 40), (25, 0)])
def test_asof_nearest(spark, slice_us, before, after):
    left, right = _series(3), _series(4, n=60)
    ldf = spark.createDataFrame(left, "id long, device long, us long, p long").select("id", "device", "us")
    rdf = spark.createDataFrame(right, "rid long, device long, us long, q long")
    out = asof.asof_nearest(ldf, rdf, ["rid"], before, after, tie=["rid"], slice_us=slice_us).collect()
    assert len(out) == len(left)
    for r in out:
        cands = [(x[2], x[0]) for x in right if x[1] == r["device"]]
        assert ((r["matched_us"], r["rid"]) if r["rid"] is not None else None) == _brute_nearest(r["us"], cands, before, after)


def test_asof_merge_keeps_everything_once(spark):
    base = spark.createDataFrame([(1, 10, 1, 100), (1, 50, 2, None)], "device long, us long, a long, event_us long")
    other = spark.createDataFrame(
        [(1, 12, 7, 5), (1, 55, 8, 6), (1, 90, 9, 7), (2, 10, 4, 8)], "device long, us long, b long, event_us long"
    )
    got = {(r["device"], r["us"]): r for r in asof.asof_nearest_merge(base, other, ["b"], 5, "oth_").collect()}
    assert len(got) == 4
    assert (got[1, 10]["oth_b"], got[1, 10]["event_us"]) == (7, 100)
    assert (got[1, 50]["oth_b"], got[1, 50]["event_us"]) == (8, 6)
    assert (got[1, 90]["a"], got[1, 90]["oth_b"], got[1, 90]["event_us"]) == (None, 9, 7)
    assert got[2, 10]["oth_b"] == 4


def test_asof_with_empty_right_side(spark):
    left = spark.createDataFrame([(1, 10)], "device long, us long")
    right = spark.createDataFrame([], "device long, us long, b long")
    assert asof.asof_nearest(left, right, ["b"], 5, 5).first()["b"] is None


@pytest.mark.parametrize("slice_us", SLICES)
def test_session_bounds(spark, slice_us):
    events, screen = _series(5, n=50), _series(6, n=40)
    edf = spark.createDataFrame(events, "id long, device long, event_us long, p long")
    sdf = spark.createDataFrame(screen, "sid long, device long, us long, status long")
    out = asof.session_bounds(edf, sdf, unlock=2, slice_us=slice_us).collect()
    for r in out:
        times = [x[2] for x in screen if x[1] == r["device"] and x[3] == 2]
        assert r["session_start"] == max((t for t in times if t <= r["event_us"]), default=None)
        assert r["session_end"] == min((t for t in times if t >= r["event_us"]), default=None)


def test_answer_time_moves_the_reference_point(spark):
    events = spark.createDataFrame([(1, 10, 30), (1, 10, None)], "device long, event_us long, answer_us long")
    screen = spark.createDataFrame([(1, 20, 3), (1, 40, 3)], "device long, us long, status long")
    got = {r["answer_us"]: (r["session_start"], r["session_end"]) for r in asof.session_bounds(events, screen, answer_us="answer_us").collect()}
    assert got == {30: (20, 40), None: (None, 20)}


def test_event_window_join_bounds_and_overlaps(spark):
    rows, events = _series(7, n=150), _series(8, n=30)
    rdf = spark.createDataFrame(rows, "id long, device long, us long, p long")
    edf = spark.createDataFrame([(e[1], e[2], e[0]) for e in events], "device long, event_us long, eid long")
    got = sorted((r["id"], r["eid"]) for r in ranges.event_window_join(rdf, edf, 25, 40).collect())
    want = sorted((r[0], e[0]) for r in rows for e in events if r[1] == e[1] and e[2] - 25 <= r[2] <= e[2] + 40)
    assert got == want


def test_first_complete_source(spark):
    rows = [(1, 5, 0)] * 1 + [(1, 5, 1)] * 3 + [(1, 5, 2)] * 2
    df = spark.createDataFrame(rows, "device long, event_us long, source_rank long")
    kept = ranges.first_complete_source(df, expected=3)
    assert sorted(r["source_rank"] for r in kept.collect()) == [0, 1, 1, 1]


def test_choose_slice_splits_a_hot_device(spark):
    df = spark.range(20_000).select(F.lit(1).alias("device"), (F.col("id") * 1_000_000).alias("us"))
    width = ordered.choose_slice(df, target_rows=1000)
    fullest = ordered.with_slice(df, slice_us=width).groupBy("device", "_slice").count().agg(F.max("count")).first()[0]
    assert fullest <= 1000 < 2 * fullest + 1


def test_overlapping_intervals_later_wins(spark):
    rows = spark.createDataFrame([(1, 5), (2, 10), (3, 20), (4, 21)], "event_id long, us long")
    intervals = spark.createDataFrame([("00_a", 0, 10, 0), ("01_b", 10, 20, 1)], "label string, start_us long, end_us long, priority long")
    got = {r["event_id"]: r["label"] for r in ranges.interval_label(rows, intervals).collect()}
    assert got == {1: "a", 2: "b", 3: "b"}
