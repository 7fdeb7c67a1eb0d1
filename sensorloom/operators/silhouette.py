"""Mean silhouettes of several clusterings of the same points, on Euclidean distances.

The mean distance of a point to all members of every cluster is summed over pairs of blocks of weighted distinct points;
a pair of blocks hands on sums, never distances, and serves all clusterings at once. Where a key has more points
than ``limit``, points of the same clusters in one grid cell are first replaced by their mean, which gives each
silhouette an error bound; keys whose choice of a clustering could depend on it are evaluated again on finer cells, at
last on the points themselves. Keys of one block need no pairs: many of them are scored exactly in one call.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorloom.session import materialize

#: Weighted points of a key that are compared with each other; quadratic work is spread over block pairs.
LIMIT = 50_000
BLOCK = 1024
#: Points of many small keys that are handed to one call.
BUNDLE = 5_000


def choose(scores: DataFrame, key: str, stop: float) -> DataFrame:
    """Per key the first ``k`` above ``stop``, otherwise the best (the smallest of equals), and whether errors may change it."""
    above = F.min(F.when(F.col("silhouette") > stop, F.col("k"))).alias("_above")
    best = (F.max(F.struct("silhouette", (-F.col("k")).alias("_k")))["_k"] * -1).alias("_best")
    found = scores.groupBy(key).agg(above, best).select(key, F.coalesce("_above", "_best").alias("k"), F.col("_above").isNull().alias("_none"))
    own = scores.select(key, "k", (F.col("silhouette") - F.col("silhouette_error")).alias("_low"))
    each = scores.withColumnRenamed("k", "_k").join(found, key).join(own, [key, "k"])
    near_stop = (F.abs(F.col("silhouette") - stop) <= F.col("silhouette_error")) & (F.col("_none") | (F.col("_k") <= F.col("k")))
    near_best = F.col("_none") & (F.col("_k") != F.col("k")) & (F.col("silhouette") + F.col("silhouette_error") >= F.col("_low"))
    inexact = F.max("silhouette_error") > 0
    return each.groupBy(key, "k").agg((F.bool_or(near_stop | near_best) & inexact).alias("unsure"))


def each_small_key(points: DataFrame, key: str, n_points: int, solve: Callable[[pa.Table], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``solve`` for the rows of each key; ``schema`` begins with the key, ``solve`` gives the other columns.

    For keys of at most a block of points. A call takes about ``BUNDLE`` rows of whole keys, so that its cost is not paid for each of them.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        keys = table.column(key).to_numpy()
        bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        found = [solve(table.slice(a, b - a)) for a, b in zip(bounds, bounds[1:])]
        columns = {n: np.concatenate([f[n] for f in found]) for n in names[1:]}
        return pa.table({names[0]: np.repeat(keys[bounds[:-1]], [len(f[names[1]]) for f in found]), **columns})

    bundles = F.lit(max(1, -(-n_points // BUNDLE)))
    return points.withColumn("_bundle", F.pmod(F.xxhash64(key), bundles)).groupBy("_bundle").applyInArrow(run, schema)


def _exact(points: DataFrame, key: str, ks: Sequence[int], n_points: int) -> DataFrame:
    """Scores of keys of at most a block of points, from all their distances."""

    def solve(table: pa.Table) -> dict[str, np.ndarray]:
        lat, lon, w = (table.column(c).to_numpy() for c in ("lat", "lon", "w"))
        apart = np.hypot(lat[:, None] - lat, lon[:, None] - lon)
        found = {}
        for k in ks:
            label = table.column(f"_c{k}")
            if label.null_count == 0:
                found[k] = np.average(_values(apart, w, label.to_numpy()), weights=w)
        return {"k": np.array([*found], dtype="int32"), "silhouette": np.array([*found.values()]), "silhouette_error": np.zeros(len(found))}

    kind = dict(points.dtypes)[key]
    return each_small_key(points, key, n_points, solve, f"{key} {kind},k int,silhouette double,silhouette_error double")


def _values(apart: np.ndarray, w: np.ndarray, label: np.ndarray) -> np.ndarray:
    clusters, own = np.unique(label, return_inverse=True)
    if len(clusters) == 1:
        return np.ones(len(w))
    at, weights = np.arange(len(w)), np.zeros((len(w), len(clusters)))
    weights[at, own] = w
    sums, n = apart @ weights, weights.sum(axis=0)
    others = sums / n
    others[at, own] = np.inf
    a, b = sums[at, own] / np.maximum(n[own] - 1, 1), others.min(axis=1)
    top = np.maximum(a, b)
    return np.where((n[own] == 1) | (top == 0), 0.0, (b - a) / np.where(top == 0, 1.0, top))


def silhouettes(members: DataFrame, key: str, ks: Sequence[int], stop: float, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """``key, k, silhouette, silhouette_error`` from ``members`` (key, k, c, lat, lon, w), one row a point and clustering.

    A point alone in its cluster scores 0; a single cluster scores 1.
    """
    label = [F.max(F.when(F.col("k") == k, F.col("c"))).alias(f"_c{k}") for k in ks]
    points = materialize(members.groupBy(key, "lat", "lon").agg(F.max("w").alias("w"), *label), "labelled")
    box = materialize(
        points.groupBy(key).agg(F.count("*").alias("_n"), (F.max("lat") - F.min("lat")).alias("_h"), (F.max("lon") - F.min("lon")).alias("_v")), "boxes"
    )
    small = F.col("_n") <= min(limit, block)
    n_small, n_large = box.agg(F.sum(F.when(small, F.col("_n"))), F.sum(F.when(~small, F.col("_n")))).first()
    done: DataFrame | None = None
    if n_small:
        exact = _exact(points.join(box.filter(small).select(key), key, "left_semi"), key, ks, n_small)
        done = materialize(exact, "silhouettes")
        if not n_large:
            return done
        points, box = points.join(box.filter(~small).select(key), key, "left_semi"), box.filter(~small)
    while True:
        area = F.sqrt(F.col("_h") * F.col("_v") / F.lit(float(limit)))
        size = F.when(F.col("_n") > limit, F.greatest(area, F.greatest("_h", "_v") / F.lit(float(limit)))).otherwise(0.0)
        scores = materialize(_scores(_cells(points.join(box.select(key, size.alias("_size")), key), key, ks), key, ks, block), "silhouettes")
        unsure = materialize(choose(scores, key, stop).filter("unsure").select(key), "unsure")
        sure = scores.join(unsure, key, "left_anti")
        done = sure if done is None else done.unionByName(sure)
        if unsure.isEmpty():
            return done
        box, points, limit = box.join(unsure, key), points.join(unsure, key, "left_semi"), 4 * limit


def _cells(points: DataFrame, key: str, ks: Sequence[int]) -> DataFrame:
    """Points of the same clusters in one cell as their mean, with the sum of their distances from it (size 0: each as it is)."""
    labels = [f"_c{k}" for k in ks]
    exact = F.col("_size") == 0
    at = lambda c: F.when(exact, F.col(c)).otherwise(F.floor(F.col(c) / F.col("_size")))
    placed = points.withColumn("_a", at("lat")).withColumn("_b", at("lon"))
    group = [key, "_a", "_b", *labels]
    mean = lambda c: (F.sum(F.col(c) * F.col("w")) / F.sum("w"))
    same = lambda a, b: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]
    means = placed.groupBy(*group).agg(mean("lat").alias("_mlat"), mean("lon").alias("_mlon"))
    joined = placed.alias("a").join(means.alias("b"), same("a", "b")).select("a.*", "b._mlat", "b._mlon")
    away = F.hypot(F.col("lat") - F.col("_mlat"), F.col("lon") - F.col("_mlon")) * F.col("w")
    cells = joined.groupBy(*group).agg(F.first("_mlat").alias("lat"), F.first("_mlon").alias("lon"), F.sum("w").alias("w"), F.sum(F.when(exact, 0.0).otherwise(away)).alias("spread"))
    return materialize(cells.select(key, "lat", "lon", "w", "spread", *labels).withColumn("_id", F.monotonically_increasing_id()), "cells")


def _scores(cells: DataFrame, key: str, ks: Sequence[int], block: int) -> DataFrame:
    labels = [f"_c{k}" for k in ks]
    width = sum(ks)
    starts = np.cumsum([0, *ks])
    blocks = cells.groupBy(key).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_nb"))
    dealt = cells.join(blocks, key).withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_nb")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
    place = [F.col(c).alias(f"_{c}") for c in ("lat", "lon")]  # names of their own, as both sides come from one table
    left = dealt.select(F.col(key).alias("_a"), "_id", *place, F.col("_own").alias("_i"), every.alias("_j"))
    right = dealt.select(F.col(key).alias("_a"), *place, F.col("w").alias("_w"), *[F.col(c).alias(f"_l{c}") for c in labels], every.alias("_i"), F.col("_own").alias("_j"))
    kind = dict(cells.dtypes)[key]

    def sums(a: pa.Table, b: pa.Table) -> pa.Table:
        """For each left cell the sum of its distances to the members of every cluster in the right block."""
        out = np.zeros((a.num_rows, width))
        if a.num_rows and b.num_rows:
            x, y = (np.stack([t.column(c).to_numpy() for c in ("_lat", "_lon")], axis=1) for t in (a, b))
            apart = np.hypot(x[:, None, 0] - y[None, :, 0], x[:, None, 1] - y[None, :, 1])
            weights = np.zeros((b.num_rows, width))
            for start, name in zip(starts, labels):
                own = b.column(f"_l{name}").fill_null(0).to_numpy().astype(np.int64)
                at = np.flatnonzero(own > 0)
                weights[at, start + own[at] - 1] = b.column("_w").to_numpy()[at]
            out = apart @ weights
        return pa.table({"_id": a.column("_id"), "_s": pa.array(list(out), pa.list_(pa.float64()))})

    parts = left.groupBy("_a", "_i", "_j").cogroup(right.groupBy("_a", "_i", "_j")).applyInArrow(sums, "_id long, _s array<double>")
    total = parts.groupBy("_id").agg(F.array(*[F.sum(F.col("_s")[j]) for j in range(width)]).alias("_s"))
    per_k = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_c{k}").alias("c"), F.slice("_s", int(s) + 1, k).alias("s")) for k, s in zip(ks, starts)])).alias("_x")
    long = cells.join(total, "_id").select(key, "w", "spread", per_k).select(key, "w", "spread", "_x.*").filter("c IS NOT NULL")
    long = materialize(long, "distances")
    sizes = long.groupBy(key, "k", "c").agg(F.sum("w").alias("n"), F.sum("spread").alias("spread"))
    listed = sizes.groupBy(key, "k").agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("n", "spread")))).alias("_n"))
    n = F.col("_n")[F.col("c")]["n"]
    others = F.transform(F.filter(F.map_keys("_n"), lambda c: c != F.col("c")), lambda c: F.col("s")[(c - 1).cast("int")] / F.col("_n")[c]["n"])
    a, b = F.col("s")[(F.col("c") - 1).cast("int")] / (F.col("_own_n") - 1), F.array_min("_others")
    own = F.col("spread") / F.col("w")
    drift = F.array_max(F.transform(F.map_values("_n"), lambda v: v["spread"] / F.greatest(v["n"] - 1, F.lit(1))))
    top = F.greatest(a, b)
    joined = long.join(listed, [key, "k"]).withColumn("_own_n", n).withColumn("_others", others)
    single = F.size("_n") == 1
    value = F.when(single, 1.0).when(F.col("_own_n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(b - a, top), F.lit(0.0)))
    slack = 6 * (own + drift)  # both means move by the points' own and the others' distances from their cells, and so does the larger one
    error = F.when(single | (slack == 0), 0.0).otherwise(F.least(F.lit(2.0), F.coalesce(F.try_divide(slack, top), F.lit(2.0))))
    mean = lambda v: F.sum(v * F.col("w")) / F.sum("w")
    return joined.groupBy(F.col(key).cast(kind).alias(key), "k").agg(mean(value).alias("silhouette"), mean(error).alias("silhouette_error"))

