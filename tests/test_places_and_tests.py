"""Clustering, hulls, graphs, quantiles, tests and assignments against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.functions.geo import geodesic_m, haversine_km
from sensorloom.operators import clustering, evaluation, geogrid, graphs, labels, places, quantiles, selection, static


def _km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def _greedy_complete(points, limit):
    """Textbook complete linkage: merge the closest two groups while they are nearer than the limit."""
    groups = [[p] for p in points]
    while len(groups) > 1:
        d, i, j = min(
            (max(_km(a, b) for a in groups[i] for b in groups[j]), i, j) for i in range(len(groups)) for j in range(i)
        )
        if d >= limit:
            break
        groups[j] += groups[i]
        del groups[i]
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("pairs_per_point", [1000.0, 0.5])
def test_complete_linkage_equals_greedy(spark, pairs_per_point):
    """The small pair budget forces several levels of radii and merging by hulls."""
    rng = random.Random(5)
    data, want = [], {}
    for device in (1, 2):
        pts = [(50 + rng.gauss(0, 0.004), 8 + rng.gauss(0, 0.006)) for _ in range(45)]
        want[device] = _greedy_complete(pts, 0.4)
        data += [(device, *p) for p in pts for _ in range(rng.randrange(1, 3))]
    df = spark.createDataFrame(data, "device long, lat double, lon double")
    out = clustering.place_clusters(df, 0.4, pairs_per_point=pairs_per_point).collect()
    assert len(out) == len(data)
    for device in (1, 2):
        got = {}
        for r in out:
            if r["device"] == device:
                got.setdefault(r["cluster_label"], set()).add((r["lat"], r["lon"]))
        assert {frozenset(g) for g in got.values()} == want[device]


def test_near_pairs_cross_the_date_line_and_high_latitudes(spark):
    rng = random.Random(6)
    pts = [(rng.choice([-78, 0, 60, 84]) + rng.uniform(-0.02, 0.02), ((179.99 + rng.uniform(-0.05, 0.05) + 180) % 360) - 180) for _ in range(90)]
    df = spark.createDataFrame([(1, i, *p) for i, p in enumerate(pts)], "device long, id long, lat double, lon double")
    got = {(r["id_a"], r["id_b"]) for r in geogrid.near_pairs(df, ["device"], "id", 1.0).collect()}
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if _km(pts[i], pts[j]) < 1.0}
    assert got == want and want


def test_hulls_in_parts_keep_the_farthest_distance(spark):
    rng = random.Random(7)
    pts = {k: [(50 + rng.gauss(0, 0.01), 8 + rng.gauss(0, 0.01)) for _ in range(200)] for k in ("a", "b")}
    df = spark.createDataFrame([(k, *p) for k, ps in pts.items() for p in ps], "k string, lat double, lon double")
    hulls = {r["k"]: [(p["lat"], p["lon"]) for p in r["hull"]] for r in geogrid.hulls(df, ["k"], group=32).collect()}
    assert all(len(h) < 40 for h in hulls.values())
    far = max(_km(a, b) for a in hulls["a"] for b in hulls["b"])
    assert far == max(_km(a, b) for a in pts["a"] for b in pts["b"])


def test_connected_components(spark):
    edges = [(1, i, i + 1) for i in range(20)] + [(1, 30, 31), (2, 5, 4)]
    df = spark.createDataFrame(edges, "device long, id_a long, id_b long")
    got = {(r["device"], r["id"]): r["root"] for r in graphs.connected_components(df, ["device"]).collect()}
    assert all(got[1, i] == 0 for i in range(21))
    assert (got[1, 31], got[2, 5]) == (30, 4)


@pytest.mark.parametrize("buffer_values", [40, 1_000_000])
def test_percentiles_are_exact(spark, buffer_values):
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.normal(size=30_000), np.full(15_000, 0.25), [np.nan]])
    rows = [(int(i % 2), None if v != v else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g long, x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["x_q"] for r in quantiles.exact_percentiles(df, ["x"], probs, ["g"], buffer_values=buffer_values).collect()}
    for g in (0, 1):
        want = np.quantile([x for k, x in rows if k == g and x is not None], probs)
        assert np.allclose(got[g], want, atol=1e-12)


@pytest.mark.parametrize("copies", [1, 700])
def test_percentiles_keep_null_groups_and_nan(spark, copies):
    nan = float("nan")
    groups = {"a": [1.0, 2.0, nan], "b": [None, None], None: [3.0, 5.0], "d": [7.0, None], "e": [nan, 1.0, 2.0, 4.0]}
    df = spark.createDataFrame([(g, x, i) for g, xs in groups.items() for x in xs for i in range(copies)], "g string, x double, i long")
    got = {r["g"]: r["x_q"] for r in quantiles.exact_percentiles(df, ["x"], [0.0, 0.5, 1.0], ["g"], buffer_values=50).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        known = sorted((x for x in xs for _ in range(copies) if x is not None), key=lambda x: (x != x, x))
        for p, v in zip([0.0, 0.5, 1.0], got[g]):
            if not known:
                assert v is None
                continue
            at = (len(known) - 1) * p
            a, z = known[int(np.floor(at))], known[int(np.ceil(at))]
            want = a if a == z or at % 1 == 0 else (a + z) / 2
            assert v == want or (v != v and want != want)
    assert quantiles.exact_percentiles(df.limit(0), ["x"], [0.5]).collect()[0]["x_q"] is None


def test_small_exact_percentiles_of_every_size(spark):
    rows = [(n, float((7 * k) % n)) for n in range(1, 40) for k in range(n)]
    probs = [i / 10 for i in range(11)]
    got = {r["n"]: r["x_q"] for r in quantiles.exact_percentiles(spark.createDataFrame(rows, "n long, x double"), ["x"], probs, ["n"]).collect()}
    for n in range(1, 40):
        assert np.allclose(got[n], np.quantile([x for m, x in rows if m == n], probs), atol=1e-9)


def test_segment_features_keep_a_segment_of_nulls(spark):
    from sensorloom.operators.features import segment_features

    df = spark.createDataFrame([("d", 0, 0, 1, 2.0), ("d", 0, 1, 2, None), (None, 0, 0, 3, 4.0)], "device string, event_us long, segment long, us long, x double")
    got = {(r["device"], r["segment"]): r["x__median"] for r in segment_features(df, ["x"]).collect()}
    assert got == {("d", 0): 2.0, ("d", 1): None, (None, 0): 4.0}


def test_left_range_join_keeps_rows_without_event(spark):
    from sensorloom.operators.ranges import event_window_join

    rows = spark.createDataFrame([("a", 5), ("a", 100), ("b", 5)], "device string, us long")
    events = spark.createDataFrame([("a", 6), ("a", 300)], "device string, event_us long")
    got = sorted((r["device"], r["us"], r["event_us"]) for r in event_window_join(rows, events, 3, 3, how="left").fillna(-1).collect())
    assert got == [("a", 5, 6), ("a", 100, -1), ("b", 5, -1)]


def test_synthetic_events_of_two_devices(spark):
    from sensorloom.operators import labels

    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("b", 3, "y")], "device string, us long, label string")
    sessions = spark.createDataFrame([(0, 10, 1)], "start_us long, end_us long, priority int")
    tagged = labels.synthetic_events(rows, sessions, 10)
    assert sorted((r["device"], r["label"]) for r in labels.synthetic_event_labels(tagged).collect()) == [("a", "x"), ("b", "y")]
    own = spark.createDataFrame([("b", 0, 10, 1)], "device string, start_us long, end_us long, priority int")
    assert {r["device"] for r in labels.synthetic_events(rows, own, 10, keys=["device"]).collect()} == {"b"}


def test_unlisted_classes_count_in_totals(spark):
    from sensorloom.operators.summaries import contingency_margins

    df = spark.createDataFrame([("r", 0), ("r", 9), ("s", 1)], "row string, m int")
    got = {r["row"]: (r["0"], r["1"], r["total"]) for r in contingency_margins(df, "row", "m", [0, 1]).collect()}
    assert got == {"r": (1, 0, 2), "s": (0, 1, 1), "total": (1, 1, 3)}


def test_codes_beyond_six_letters(spark):
    from pyspark.sql import functions as F
    from sensorloom.operators.identity import letter_code

    numbers = [0, 1, 26**6 - 1, 26**6, 2 * 26**6, 26**6 + 1]
    codes = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "n long").select(letter_code(F.col("n"))).collect()]
    assert len(set(codes)) == len(numbers) and [len(c) for c in codes] == [6, 6, 6, 12, 12, 12]


def test_geodesic_far_apart(spark):
    from pyspark.sql import functions as F
    from sensorloom.functions.geo import geodesic_m

    df = spark.createDataFrame([(0.0, 0.0, 0.5, 179.7), (0.0, 0.0, 0.5, 179.5), (50.0, 8.0, 50.0, 8.0)], "a double, b double, c double, d double")
    far, near, same = [r[0] for r in df.select(geodesic_m(*map(F.col, "abcd"))).collect()]
    assert same == 0.0
    assert near is None or abs(near - 19_936_288.579) < 0.01
    assert far is None or far > 19_936_000


def test_mann_whitney_against_counts(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), float(rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame(rows, "label string, x double")
    got = {r["class"]: r["u"] for r in selection.mann_whitney_u(df, ["x"], "label", buckets=8).collect()}
    for c in "ab":
        own, rest = [x for k, x in rows if k == c], [x for k, x in rows if k != c]
        assert got[c] == sum((a > b) + 0.5 * (a == b) for a in own for b in rest)


def test_relevant_feature_is_found(spark):
    rng = random.Random(10)
    rows = [(k, rng.gauss(3.0 if k == "a" else 0.0, 1), rng.gauss(0, 1)) for k in "ab" * 60]
    df = spark.createDataFrame(rows, "label string, good double, noise double")
    got = {r["feature"]: r["is_relevant"] for r in selection.relevant_features(df, ["good", "noise"], "label").collect()}
    assert got == {"good": True, "noise": False}


def test_static_windows_against_a_loop(spark):
    rng = random.Random(11)
    rows = [(1, t, rng.random()) for t in sorted(rng.sample(range(0, 3000), 250)) if not 900 < t < 1500]
    df = spark.createDataFrame(rows, "device long, us long, x double")
    out = static.static_windows(df, "x", 0.8, size_us=300, step_us=50, expected=25, min_expected=0.75, min_static=0.8)
    got = {r["start_us"]: (r["actual"], r["static"], r["is_static"]) for r in out.collect()}
    start, last, want = rows[0][1], rows[-1][1], {}
    while start + 300 < last:
        inside = [x for _, t, x in rows if start <= t < start + 300]
        if inside:
            low = sum(x < 0.8 for x in inside)
            want[start] = (len(inside), low, len(inside) >= 25 * 0.75 and low >= len(inside) * 0.8)
        start += 50
    assert got == want
    flagged = sorted(s for s, w in want.items() if w[2])
    periods = []
    for s in flagged:
        if periods and s < periods[-1][1]:
            periods[-1][1] = s + 300
        else:
            periods.append([s, s + 300])
    made = sorted((r["start_us"], r["end_us"]) for r in static.static_periods(out).collect())
    assert made == [tuple(p) for p in periods]


def test_touching_windows_stay_apart(spark):
    rows = [(1, 0, 10, 5, 5.0, 5, True), (1, 10, 20, 5, 5.0, 5, True), (1, 15, 25, 5, 5.0, 5, True)]
    df = spark.createDataFrame(rows, "device long, start_us long, end_us long, actual long, expected double, static long, is_static boolean")
    assert sorted((r["start_us"], r["end_us"]) for r in static.static_periods(df).collect()) == [(0, 10), (10, 25)]


def _assign(rows, classes, limit):
    taken = {}
    for c in classes:
        ranked = sorted(rows, key=lambda r: (-r[c], r["row_id"]))
        for r in ranked[:3]:
            if r["row_id"] not in taken:
                if r[c] >= limit:
                    taken[r["row_id"]] = c
                break
    return taken


@pytest.mark.parametrize("limit", [0.0, 0.5, 0.9, 2.0])
def test_one_per_class(spark, limit):
    rng = random.Random(12)
    classes = ["x", "y", "z", "w"]
    rows = [{"subject": i % 3, "row_id": i, **{c: round(rng.random(), 2) for c in classes}} for i in range(12)]
    got = {r["row_id"]: r["y_pred_final"] for r in evaluation.one_per_class(spark.createDataFrame(rows), classes, limit).collect()}
    for s in range(3):
        own = [r for r in rows if r["subject"] == s]
        want = _assign(own, classes, limit)
        assert all(got[r["row_id"]] == want.get(r["row_id"], "other") for r in own)


def test_binomial_tail_and_log_factorial(spark):
    rows = [(i, "a" if i < 40 else "b", "a") for i in range(60)]
    r = evaluation.binomial_test(spark.createDataFrame(rows, "i long, y_test string, y_pred string")).first()
    want = sum(math.comb(60, x) for x in range(40, 61)) / 2**60
    assert abs(r["p_value"] - want) < 1e-12
    got = [x[0] for x in spark.range(0, 30).orderBy("id").select(evaluation.log_factorial(F.col("id").cast("double"))).collect()]
    assert np.allclose(got, [math.lgamma(i + 1) for i in range(30)], atol=1e-10)


def test_geodesic_of_a_published_line(spark):
    """Flinders Peak to Buninyong: 54 972.271 m on the ellipsoid."""

    def deg(d, m, s):
        return math.copysign(abs(d) + m / 60 + s / 3600, d)

    ends = (deg(-37, 57, 3.72030), deg(144, 25, 29.52440), deg(-37, 39, 10.15610), deg(143, 55, 35.38390))
    row = spark.range(1).select(
        geodesic_m(*[F.lit(x) for x in ends]).alias("m"),
        geodesic_m(F.lit(50.0), F.lit(8.0), F.lit(50.0), F.lit(8.0)).alias("zero"),
        haversine_km(*[F.lit(x) for x in ends]).alias("km"),
    ).first()
    assert abs(row["m"] - 54972.271) < 0.001 and row["zero"] == 0
    assert abs(row["km"] - 54.97) < 0.3


def test_kmeans_finds_two_places(spark):
    rng = random.Random(13)
    rows = [
        (1, 10 * 3_600_000_000, 50 + c * 0.1 + rng.gauss(0, 1e-5), 8 + rng.gauss(0, 1e-5)) for c in (0, 1) for _ in range(40)
    ]
    df = spark.createDataFrame(rows, "device long, us long, lat double, lon double")
    out = places.kmeans_k_sweep(df, 9, 18, min_rows=10).collect()
    assert {r["n_places"] for r in out} == {2}
    assert sorted(r["entries_near"] for r in out) == [40, 40]


def test_one_coordinate_gives_one_place(spark):
    df = spark.createDataFrame([(1, 36_000_000_000, 50.0, 8.0)] * 12, "device long, us long, lat double, lon double")
    out = places.kmeans_k_sweep(df, 9, 18, min_rows=10).collect()
    assert [(r["n_places"], r["entries_near"]) for r in out] == [(1, 12)]


def test_ranks_average_ties_and_keep_nulls(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (1, 3, 9.0), (1, 4, None)], "device long, place long, f double")
    got = {r["place"]: (r["f_rank_ascent"], r["f_rank_descent"]) for r in places.place_feature_ranks(df, ["f"]).collect()}
    assert got == {1: (2.5, 1.5), 2: (2.5, 1.5), 3: (1.0, 3.0), 4: (None, None)}


def test_questionnaire_first_answer_and_missing(spark):
    rows = [
        (1, 0, "Current Location?", '["home"]', 5), (1, 1, "Current Location?", '["office"]', 6), (1, 2, "Physical Activity", '["rest"]', 7),
        (1, 3, "Unknown", '["x"]', 8),
    ]
    df = spark.createDataFrame(rows, "event long, answer_order long, question string, answer string, answer_us long")
    r = labels.questionnaire_pivot(df, keys=["event"]).first()
    assert (r["location"], r["location_time"], r["activity"], r["aligned"]) == ("home", 5, "rest", None)
    dup = labels.duplicate_answers(df, keys=["event"])
    assert sorted(x["answer_order"] for x in dup.collect()) == [1, 3]


def test_synthetic_events_edges(spark):
    sessions = spark.createDataFrame([("00_a", 0, 25, 0)], "label string, start_us long, end_us long, priority long")
    rows = spark.createDataFrame([(t,) for t in (0, 9, 10, 20, 29, 30, 31)], "us long")
    got = {r["us"]: r["event_us"] for r in labels.synthetic_events(rows, sessions, 10).collect()}
    assert got == {0: 5, 9: 5, 10: 15, 20: 25, 29: 25, 30: 25}


def test_routed_scoring_imputes_missing_features(spark):
    from sensorloom.operators import models

    rng = random.Random(12)
    rows = [(k, k % 3, "ab"[k % 2], float(k % 2) * 4 + rng.random(), rng.random()) for k in range(60)]
    df = spark.createDataFrame(rows, "row long, device int, label string, x double, y double")
    fitted = models.fit_forest(df, ["x", "y"], "label", numTrees=3)
    odd = spark.createDataFrame([(100, 7, "a", None, float("nan")), (101, None, "b", float("inf"), None)], df.schema)
    got = models.routed_scoring(df.unionByName(odd), {0: fitted}, fitted, "label", "device", keep=["row"]).collect()
    assert len(got) == 62 and {r["row"]: r["y_pred"] for r in got}[101] == "b"
    assert {r["model"] for r in got if r["row"] in (100, 101)} == {"deployment"}


def test_split_by_subjects(spark):
    from sensorloom.operators import models

    rows = [(k, k % 5, "ab"[k % 2], float(k % 2)) for k in range(50)]
    df = spark.createDataFrame(rows, "row long, device int, label string, x double")
    got = models.split_predictions(df, ["x"], "label", "row", "device", [1, 2], numTrees=2)
    assert sorted(r["row"] for r in got.collect()) == [k for k in range(50) if k % 5 in (1, 2)]
