"""Hulls, clusters and means across the date line and near the poles."""

import math
import random

import numpy as np
import pytest

from sensorloom.operators import clustering, geogrid
from tests.test_places_and_tests import _greedy_complete, _km


def _around(rng, lat, lon, km, n):
    out = []
    for _ in range(n):
        a, r = rng.uniform(0, 2 * math.pi), km * math.sqrt(rng.random()) / 6371.0
        phi = math.asin(math.sin(math.radians(lat)) * math.cos(r) + math.cos(math.radians(lat)) * math.sin(r) * math.cos(a))
        turn = math.atan2(math.sin(a) * math.sin(r) * math.cos(math.radians(lat)), math.cos(r) - math.sin(math.radians(lat)) * math.sin(phi))
        out.append((math.degrees(phi), (lon + math.degrees(turn) + 540) % 360 - 180))
    return out


@pytest.mark.parametrize(("lat", "lon", "km"), [(0, 180, 50), (89.99, 10, 30), (-89.999, 0, 5), (60, -179.999, 0.1), (10, 20, 3000), (45, 0, 12_000), (50, 8, 1e-4)])
def test_farthest_pair_of_corners(lat, lon, km):
    rng = random.Random(7)
    points = _around(rng, lat, lon, km, 120)
    at = geogrid._hull_indices(np.array([p[0] for p in points]), np.array([p[1] for p in points]))
    far = max(_km(a, b) for a in points for b in points)
    assert max(_km(points[i], points[j]) for i in at for j in at) == pytest.approx(far, rel=1e-9)
    assert len(at) < 60 or km > 5000


def test_equal_points_and_lines():
    assert geogrid._hull_indices(np.array([1.0, 1.0, 1.0]), np.array([2.0, 2.0, 2.0]))
    lat = np.linspace(0, 1, 50)
    at = geogrid._hull_indices(lat, np.zeros(50))
    assert {0, 49} <= set(at) and len(at) < 10


@pytest.mark.parametrize(("lat", "lon"), [(3, 180), (89.995, 0)])
def test_clusters_where_longitudes_wrap(spark, lat, lon):
    points = _around(random.Random(3), lat, lon, 1.5, 40)
    df = spark.createDataFrame([(1, *p) for p in points], "device long, lat double, lon double")
    found = clustering.place_clusters(df, 0.8, pairs_per_point=0.5).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.cluster_label, []).append(r)
    assert {frozenset((r.lat, r.lon) for r in g) for g in groups.values()} == _greedy_complete(points, 0.8)
    for g in groups.values():
        middle = (g[0].cluster_lat, g[0].cluster_lon)
        assert max(_km(middle, (r.lat, r.lon)) for r in g) < 0.8
