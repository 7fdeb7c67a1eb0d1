"""Silhouettes against brute force over all rows."""

import numpy as np
import pytest

from sensorloom.operators import places, silhouette


def _brute(x, c, w):
    x, c = np.repeat(x, w, axis=0), np.repeat(c, w)
    if len(set(c)) == 1:
        return 1.0
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    values = []
    for i, own in enumerate(c):
        n = (c == own).sum()
        if n == 1:
            values.append(0.0)
            continue
        a = apart[i, c == own].sum() / (n - 1)
        b = min(apart[i, c == o].mean() for o in set(c) if o != own)
        values.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(values))


@pytest.mark.parametrize(("limit", "block"), [(50_000, 1024), (50_000, 7), (12, 5)])
def test_silhouettes_match_brute_force(spark, limit, block):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for device, spread in enumerate([0.01, 0.3, 1.0, 0.0]):
        x = np.unique(np.round(rng.normal(size=(60, 2)) * spread + rng.integers(0, 3, (60, 1)) * 5.0, 3), axis=0)
        w = rng.integers(1, 4, len(x))
        for k in (1, 2, 3):
            c = np.argsort(np.argsort(x[:, 0] + 0.01 * x[:, 1])) * k // len(x) + 1
            want[device, k] = _brute(x, c, w)
            rows += [(device, k, int(c[i]), float(x[i, 0]), float(x[i, 1]), int(w[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, "device long, k int, c int, lat double, lon double, w long")
    found = silhouette.silhouettes(df.filter("k > 1"), "device", [2, 3], 0.9, limit, block)
    got = {(r.device, r.k): r for r in found.collect()}
    assert set(got) == {key for key in want if key[1] > 1}
    for key, r in got.items():
        assert abs(r.silhouette - want[key]) <= r.silhouette_error + 1e-9
        assert r.silhouette_error == 0 or limit == 12
    for r in silhouette.choose(found, "device", 0.9).collect():
        above = [k for k in (2, 3) if want[r.device, k] > 0.9]
        assert not r.unsure and r.k == (above[0] if above else max((2, 3), key=lambda k: (want[r.device, k], -k)))
    assert {r.silhouette for r in silhouette.silhouettes(df.filter("k = 1"), "device", [1], 0.9).collect()} == {1.0}


def test_kmeans_rows_near_the_places(spark):
    hour = 3_600_000_000
    rows = [(0, 10 * hour + i, 50.0 + 0.00001 * (i % 3), 8.0) for i in range(30)] + [(0, 11 * hour + i, 50.2, 8.0 + 0.00001 * (i % 2)) for i in range(20)]
    rows.append((0, 12 * hour, 50.2, 8.01))  # about 700 m off
    out = places.kmeans_k_sweep(spark.createDataFrame(rows, "device long, us long, lat double, lon double"), 9, 18, min_rows=10).collect()
    assert {(r.n_places, r.n_rows, r.n_rows_near, r.silhouette_error) for r in out} == {(2, 51, 50, 0.0)}
    assert all(r.silhouette > 0.9 for r in out)
