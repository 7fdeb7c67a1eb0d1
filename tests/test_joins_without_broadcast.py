"""Steps whose tables grow with the input: no broadcast, and results as before."""

import itertools
import math
import random

from pyspark.sql import functions as F

from sensorloom.operators import geogrid
from sensorloom.operators.graphs import connected_components


def _plans(monkeypatch, module):
    """The plans of the tables that ``module`` writes out."""
    seen, write = [], module.materialize

    def kept(df, *args):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *args)

    monkeypatch.setattr(module, "materialize", kept)
    return seen


def _brute(edges):
    root = {}
    for k, a, b in edges:
        root.setdefault((k, a), a), root.setdefault((k, b), b)
    changed = True
    while changed:
        changed = False
        for k, a, b in edges:
            low = min(root[k, a], root[k, b])
            changed |= root[k, a] != low or root[k, b] != low
            root[k, a] = root[k, b] = low
    return {(k, n, r) for (k, n), r in root.items()}


def test_components_broadcast_nothing(spark, monkeypatch):
    from sensorloom.operators import graphs

    random.seed(3)
    edges = [(k, random.randrange(60), random.randrange(60)) for k in range(4) for _ in range(35)]  # a few lead back to themselves
    edges += [(9, n, n + 1) for n in range(40)] + [(8, 7, n) for n in range(30)] + [(7, 5, 5)]
    seen = _plans(monkeypatch, graphs)
    df = spark.createDataFrame(edges, "device long, id_a long, id_b long")
    got = {tuple(r) for r in connected_components(df, ["device"]).select("device", "id", "root").collect()}
    assert got == _brute(edges)
    assert seen and not [p for p in seen if "Broadcast" in p]


def test_candidates_broadcast_nothing(spark, tmp_path):
    df = spark.range(500).select(F.lit(1).alias("device"), "id", (F.col("id") * 0.001).alias("lat"), (F.col("id") * 0.002).alias("lon"))
    df.write.parquet(str(tmp_path / "points"))
    pairs = geogrid.candidate_pairs(spark.read.parquet(str(tmp_path / "points")), ["device"], "id", 1.0)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_few_wide_cells(spark):
    """Around the poles and the date line a band has one, two or three cells; each pair comes once."""
    random.seed(5)
    points = [(1, n, random.choice([89.2, 89.9, -89.9, 0.1, 60.0]) + random.random() * 0.09, random.choice([-180.0, 179.9, 0.0, 90.0, -45.0]) + random.random() * 0.1) for n in range(90)]
    df = spark.createDataFrame(points, "device long, id long, lat double, lon double")

    def km(p, q):
        (a, b), (c, d) = (map(math.radians, p[2:]), map(math.radians, q[2:]))
        chord = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(min(chord, 1.0)))

    for radius in (0.5, 8.0, 60.0, 2000.0):
        got = sorted((r["id_a"], r["id_b"]) for r in geogrid.near_pairs(df, ["device"], "id", radius).collect())
        assert got == [(p[1], q[1]) for p, q in itertools.combinations(points, 2) if km(p, q) < radius]


def test_shuffled_labels_broadcast_no_rows(spark):
    from sensorloom.operators import models

    df = spark.range(240).select(F.col("id").alias("row"), (F.col("id") % 3).alias("who"), F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("label"), F.rand(1).alias("x"))
    each = models.folds(df, ["x"], "label", "who", ["row"])
    drawn = models.shuffled_labels(each, "row", each.subjects, 5, 11)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_out" in plan
    assert drawn.count() == 240
