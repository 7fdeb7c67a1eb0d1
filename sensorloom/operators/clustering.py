"""Place clustering: complete linkage with a distance limit, and merges of close clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sensorloom.functions.geo import haversine_km, mean_position, position_of, unit_vector
from sensorloom.operators.geogrid import candidate_pairs, farthest_km, home_cell, hulls, near_pairs
from sensorloom.operators.graphs import connected_components
from sensorloom.session import by_sorting, materialize

# A level is started at a radius where this many candidate pairs per point are expected at most.
PAIRS_PER_POINT = 48
LEVEL_FACTOR = 4


def _start_radius(points: DataFrame, keys: Sequence[str], limit_km: float, pairs_per_point: float) -> float:
    """Largest limit / 4**m whose grid cells promise few pairs (one number per trial to the driver)."""
    n_points = points.count()
    radius = limit_km
    while radius > 1e-5:
        band, cell = home_cell(F.col("lat"), F.col("lon"), radius)
        load = (
            points.groupBy(*keys, band.alias("_b"), cell.alias("_c"))
            .agg(F.count("*").alias("_n"))
            .agg(F.sum(F.col("_n").cast("double") * F.col("_n")))
            .first()[0]
        ) or 0.0
        if load * 9 <= pairs_per_point * n_points * 2:
            break
        radius /= LEVEL_FACTOR
    return radius


def _agglomerate(pairs: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Merge by complete linkage inside one level: ``keys, id, root`` of every absorbed cluster.

    ``pairs(keys, a, b, d)`` holds all pairs up to the level's radius once. Complete
    linkage is reducible, so all reciprocal nearest neighbours of a round may merge
    at once and give the tree of one-by-one merging (distance ties: the smaller id).
    A merged pair keeps the larger distance and lives on only if both parts had it;
    a missing pair means a distance beyond the radius.
    """
    rounds: list[DataFrame] = []
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        nearest = both.groupBy(*keys, "a").agg(F.min(F.struct("d", "b"))["b"].alias("b"))
        merged = materialize(
            nearest.groupBy(*keys, F.least("a", "b").alias("keep"), F.greatest("a", "b").alias("id"))
            .agg(F.count("*").alias("_votes"))
            .filter("_votes = 2")
            .drop("_votes"),
            "merges",
        )
        moves = merged.unionByName(merged.select(*keys, "keep", F.col("keep").alias("id")))
        left = moves.select(*keys, F.col("id").alias("a"), F.col("keep").alias("_ka"))
        right = moves.select(*keys, F.col("id").alias("b"), F.col("keep").alias("_kb"))
        a, b = F.coalesce("_ka", "a"), F.coalesce("_kb", "b")
        parts = F.when(F.col("_ka").isNotNull(), 2).otherwise(1) * F.when(F.col("_kb").isNotNull(), 2).otherwise(1)
        pairs = materialize(
            pairs.join(by_sorting(left), [*keys, "a"], "left")
            .join(by_sorting(right), [*keys, "b"], "left")
            .select(*keys, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "d", parts.alias("_parts"))
            .filter(F.col("a") != F.col("b"))
            .groupBy(*keys, "a", "b")
            .agg(F.max("d").alias("d"), F.count("*").alias("_found"), F.max("_parts").alias("_parts"))
            .filter(F.col("_found") == F.col("_parts"))
            .drop("_found", "_parts"),
            "pairs",
        )
        rounds.append(merged)
    return _follow(rounds, keys) if rounds else None


def _follow(rounds: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """``keys, id, root``: where each absorbed cluster ends, from the last round back, so that few rows meet often."""
    roots: DataFrame | None = None
    for back, merged in enumerate(reversed(rounds), 1):
        step = merged.select(*keys, "id", F.col("keep").alias("root"))
        if roots is not None:
            onward = by_sorting(roots.select(*keys, F.col("id").alias("root"), F.col("root").alias("_to")))
            step = step.join(onward, [*keys, "root"], "left").select(*keys, "id", F.coalesce("_to", "root").alias("root")).unionByName(roots)
        roots = materialize(step, "roots") if back % 4 == 0 or back == len(rounds) else step
    return roots


def cluster_points(
    points: DataFrame, limit_km: float, keys: Sequence[str] = ("device",), pairs_per_point: float = PAIRS_PER_POINT
) -> DataFrame:
    """Complete-linkage clusters of distinct points ``(keys, point, lat, lon)``: adds ``cluster`` (a point id).

    Members of a cluster are pairwise less than ``limit_km`` apart. Linkage distances
    only grow, so merging runs in levels of growing radius: dense spots collapse at
    small radii, and only cluster corners (hulls) meet at larger ones. That keeps the
    number of pairs near the number of points instead of its square.
    """
    keys = list(keys)
    radius = _start_radius(points, keys, limit_km, pairs_per_point)
    assigned = points.withColumn("cluster", F.col("point"))
    state = points.select(
        *keys, F.col("point").alias("id"), "lat", "lon", F.array(F.struct("lat", "lon")).alias("hull")
    )
    while True:
        pairs = materialize(
            candidate_pairs(state, keys, "id", radius)
            .withColumn("d", farthest_km(F.col("a.hull"), F.col("b.hull")))
            .filter(F.col("d") < radius)
            .select(*keys, F.col("a.id").alias("a"), F.col("b.id").alias("b"), "d"),
            "pairs",
        )
        roots = _agglomerate(pairs, keys)
        if roots is not None:
            to = roots.select(*keys, F.col("id").alias("cluster"), F.col("root").alias("_root"))
            assigned = materialize(
                assigned.join(by_sorting(to), [*keys, "cluster"], "left").withColumn("cluster", F.coalesce("_root", "cluster")).drop("_root"),
                "assigned",
            )
        if radius >= limit_km:
            return assigned
        if roots is not None:
            corners = (
                state.join(by_sorting(roots), [*keys, "id"], "left")
                .select(*keys, F.coalesce("root", "id").alias("id"), F.explode("hull").alias("_p"))
                .select(*keys, "id", "_p.lat", "_p.lon")
            )
            state = materialize(
                hulls(corners, [*keys, "id"]).select(*keys, "id", F.col("hull")[0]["lat"].alias("lat"), F.col("hull")[0]["lon"].alias("lon"), "hull"),
                "hulls",
            )
        radius = min(radius * LEVEL_FACTOR, limit_km)


def place_clusters(
    fixes: DataFrame,
    limit_km: float,
    keys: Sequence[str] = ("device",),
    lat: str = "lat",
    lon: str = "lon",
    pairs_per_point: float = PAIRS_PER_POINT,
) -> DataFrame:
    """Rows with ``cluster_label`` (dense per key, by smallest coordinate) and the cluster's mean position.

    Coordinates are deduplicated before clustering; means are over all rows.
    """
    keys = list(keys)
    counted = fixes.groupBy(*keys, F.col(lat).alias("lat"), F.col(lon).alias("lon")).agg(F.count("*").alias("n"))
    # Ids follow the order of the coordinates, so ties are broken the same way in every run; pairs of longs are half the size of pairs of coordinates.
    ordered = counted.repartitionByRange(*keys, "lat", "lon").sortWithinPartitions(*keys, "lat", "lon")
    points = materialize(ordered.withColumn("point", F.monotonically_increasing_id()), "points")
    assigned = cluster_points(points, limit_km, keys, pairs_per_point)
    summary = _label_clusters(assigned, keys)
    labelled = assigned.join(by_sorting(summary.select(*keys, "cluster", "cluster_label", "cluster_lat", "cluster_lon")), [*keys, "cluster"])
    mapping = labelled.select(
        *keys, F.col("lat").alias(lat), F.col("lon").alias(lon), "cluster_label", "cluster_lat", "cluster_lon"
    )
    return fixes.join(by_sorting(mapping), [*keys, lat, lon])


def _label_clusters(assigned: DataFrame, keys: Sequence[str]) -> DataFrame:
    mean_lat, mean_lon = mean_position(F.col("lat"), F.col("lon"), F.col("n").cast("double"))
    sizes = assigned.groupBy(*keys, "cluster").agg(
        F.min(F.struct("lat", "lon")).alias("_corner"),
        F.sum("n").alias("n_rows"),
        mean_lat.alias("cluster_lat"),
        mean_lon.alias("cluster_lon"),
    )
    w = Window.partitionBy(*keys).orderBy("_corner")
    return sizes.withColumn("cluster_label", (F.row_number().over(w) - 1).cast("long")).drop("_corner")


def place_cluster_summary(
    clustered: DataFrame, keys: Sequence[str] = ("device",), label: str = "cluster_label"
) -> DataFrame:
    """Rows and mean position per cluster."""
    return clustered.groupBy(*keys, label).agg(
        F.count("*").alias("n_rows"), F.first("cluster_lat").alias("cluster_lat"), F.first("cluster_lon").alias("cluster_lon")
    )


# --- merging of clusters ----------------------------------------------------------------------


def chunk_cluster_pairs(
    rows: DataFrame,
    centroid_km: float = 0.1,
    farthest_limit_km: float = 0.15,
    device: str = "device",
    chunk: str = "chunk",
    label: str = "cluster_label",
) -> DataFrame:
    """Clusters of different chunks with close centroids, and whether their farthest members allow a merge."""
    keys = [device, chunk, label]
    mean_lat, mean_lon = mean_position(F.col("lat"), F.col("lon"))
    means = rows.groupBy(*keys).agg(mean_lat.alias("_mlat"), mean_lon.alias("_mlon"))
    shape = hulls(rows.select(*keys, "lat", "lon").distinct(), keys)
    state = materialize(
        means.join(by_sorting(shape), keys).select(
            device, F.struct(F.col(chunk).alias("chunk"), F.col(label).alias("label")).alias("id"),
            F.col("_mlat").alias("lat"), F.col("_mlon").alias("lon"), "hull",
        ),
        "chunks",
    )
    km = haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return (
        candidate_pairs(state, [device], "id", centroid_km)
        .filter((km < centroid_km) & (F.col("a.id.chunk") != F.col("b.id.chunk")))
        .select(
            device,
            F.col("a.id").alias("id_a"),
            F.col("b.id").alias("id_b"),
            km.alias("centroid_km"),
            farthest_km(F.col("a.hull"), F.col("b.hull")).alias("farthest_km"),
        )
        .withColumn("merged", F.col("farthest_km") <= farthest_limit_km)
    )


def merge_chunk_clusters(
    rows: DataFrame,
    centroid_km: float = 0.1,
    farthest_limit_km: float = 0.15,
    device: str = "device",
    chunk: str = "chunk",
    label: str = "cluster_label",
) -> DataFrame:
    """Relabel clusters that continue in another chunk; adds the mean position of the merged cluster.

    Accepted pairs form a graph whose components become one cluster with the
    smallest (chunk, label), independent of any processing order.
    """
    pairs = chunk_cluster_pairs(rows, centroid_km, farthest_limit_km, device, chunk, label).filter("merged")
    roots = connected_components(pairs, [device]).select(
        device, F.col("id.chunk").alias(chunk), F.col("id.label").alias(label), F.col("root")
    )
    moved = (
        rows.join(by_sorting(roots), [device, chunk, label], "left")
        .withColumn("_chunk", F.coalesce("root.chunk", chunk))
        .withColumn("_label", F.coalesce("root.label", label))
        .drop(chunk, label, "root")
        .withColumnsRenamed({"_chunk": chunk, "_label": label})
    )
    return _with_means(moved, [device, chunk, label])


def _with_means(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    mean_lat, mean_lon = mean_position(F.col("lat"), F.col("lon"))
    means = rows.groupBy(*keys).agg(mean_lat.alias("cluster_lat"), mean_lon.alias("cluster_lon"))
    return rows.drop("cluster_lat", "cluster_lon").join(by_sorting(means), list(keys))


def relabel_clusters(
    rows: DataFrame, device: str = "device", chunk: str = "chunk", label: str = "cluster_label"
) -> DataFrame:
    """Dense new label per participant over (chunk, old label); ranks run over clusters, not rows."""
    known = rows.select(device, chunk, label).distinct()
    number = F.dense_rank().over(Window.partitionBy(device).orderBy(chunk, label)) - 1
    numbered = known.withColumn("new_label", number.cast("long"))
    return rows.join(by_sorting(numbered), [device, chunk, label])


def merge_close_places(
    rows: DataFrame, limit_km: float, passes: int = 2, device: str = "device", label: str = "cluster_label"
) -> DataFrame:
    """Merge clusters whose centroids are nearer than the limit, recompute centroids, repeat.

    Centroids are first reduced to one sum of unit vectors per cluster; the rows are
    joined once at the end.
    """
    axes = ("_x", "_y", "_z")
    sums = rows.groupBy(device, label).agg(*[F.sum(p).alias(a) for p, a in zip(unit_vector(F.col("lat"), F.col("lon")), axes)])
    lat, lon = position_of(*[F.col(a) for a in axes])
    mapping = sums.select(device, F.col(label).alias("id"), F.col(label).alias("to"))
    state = sums.withColumnRenamed(label, "id")
    for _ in range(passes):
        placed = state.select(device, "id", lat.alias("lat"), lon.alias("lon"))
        roots = connected_components(near_pairs(placed, [device], "id", limit_km), [device])
        state = materialize(
            state.join(by_sorting(roots), [device, "id"], "left")
            .groupBy(device, F.coalesce("root", "id").alias("id"))
            .agg(*[F.sum(c).alias(c) for c in axes]),
            "places",
        )
        hop = roots.select(device, F.col("id").alias("to"), "root")
        mapping = materialize(
            mapping.join(by_sorting(hop), [device, "to"], "left").select(device, "id", F.coalesce("root", "to").alias("to")), "mapping"
        )
    final = mapping.join(
        by_sorting(state.select(device, F.col("id").alias("to"), lat.alias("cluster_lat"), lon.alias("cluster_lon"))),
        [device, "to"],
    ).withColumnRenamed("id", label)
    return (
        rows.drop("cluster_lat", "cluster_lon")
        .join(by_sorting(final), [device, label])
        .drop(label)
        .withColumnRenamed("to", label)
    )
