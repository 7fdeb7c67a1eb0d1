"""Participants of few coordinates are clustered and scored many to a call, with the result of the rounds over all rows."""

import numpy as np

from sensorloom.operators import places, silhouette

SCHEMA = "device long, us long, lat double, lon double"


def _rows(participants: int) -> list[tuple]:
    draw = np.random.default_rng(5)
    rows = []
    for device in range(participants):
        spots = draw.uniform(50, 51, (1 + device % 7, 2))
        for i in range(12 + device):
            lat, lon = spots[i % len(spots)] + (draw.normal(0, 0.02, 2) if device % 3 else 0)
            rows.append((device, 10 * 3_600_000_000 + i, float(lat), float(lon)))
    return rows


def _found(frame):
    return {(r.device, r.n_places, r.place): (*np.round([r.lat, r.lon, r.silhouette, r.silhouette_error], 9), r.n_members, r.entries_near, r.n_rows) for r in frame.collect()}


def test_bundles_equal_rounds(spark, monkeypatch):
    rows = spark.createDataFrame(_rows(20), SCHEMA)
    written, write = [], places.materialize
    monkeypatch.setattr(places, "materialize", lambda df, name: (written.append(name), write(df, name))[1])
    monkeypatch.setattr(silhouette, "BUNDLE", 50)
    bundled = _found(places.kmeans_k_sweep(rows, 9, 18, min_rows=10))
    assert written.count("centres") == 1  # no rounds over all rows
    monkeypatch.setattr(places, "BLOCK", 15)  # some participants by rounds, some in bundles
    assert _found(places.kmeans_k_sweep(rows, 9, 18, min_rows=10)) == bundled
    assert written.count("centres") > 2


def test_exact_scores_equal_block_pairs(spark):
    draw = np.random.default_rng(6)
    rows = [(d, k, int(draw.integers(1, k + 1)), float(i), float(draw.normal()), int(draw.integers(1, 4))) for d in range(4) for i in range(12) for k in (1, 2, 3)]
    rows = [(d, k, c, lat, float(np.sin(lat * (d + 2))), 1 + int(lat) % 3) for d, k, c, lat, _, _ in rows]
    members = spark.createDataFrame(rows, "device long, k int, c int, lat double, lon double, w long")
    one, many = ({(r.device, r.k): round(r.silhouette, 12) for r in silhouette.silhouettes(members, "device", [1, 2, 3], 0.9, block=b).collect()} for b in (1024, 5))
    assert len(one) == 12 and one == many
