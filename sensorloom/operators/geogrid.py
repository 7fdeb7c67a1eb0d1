"""Near pairs of points by grid cells, and convex hulls of point groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from sensorloom.functions.geo import EARTH_RADIUS_KM, haversine_km
from sensorloom.session import by_sorting, materialize

KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180


def _band(lat: Column, radius_km: float) -> Column:
    return F.floor(lat / F.lit(radius_km / KM_PER_DEGREE))


def _cells_around(band: Column, radius_km: float) -> Column:
    """Number of equal longitude cells of a band, each at least ``radius_km`` wide for its neighbours too.

    Kept short on purpose: the expression is inlined several times into generated code.
    """
    edge = F.least((F.abs(band + 0.5) + 1.5) * F.lit(radius_km / KM_PER_DEGREE), F.lit(90.0))
    half_angle = F.lit(math.sin(radius_km / (2 * EARTH_RADIUS_KM)) * (1 + 1e-9))
    return F.floor(F.lit(180.0) / F.degrees(F.asin(F.least(half_angle / F.cos(F.radians(edge)), F.lit(1.0)))))


def _cell(lon: Column, cells: Column) -> Column:
    """Cell of a longitude, wrapping at ±180°."""
    return F.pmod(F.floor((lon + 180.0) * cells / 360.0), cells)


def home_cell(lat: Column, lon: Column, radius_km: float) -> tuple[Column, Column]:
    band = _band(lat, radius_km)
    return band, _cell(lon, _cells_around(band, radius_km))


def cells_around(df: DataFrame, radius_km: float) -> DataFrame:
    """Each point in the at most nine cells (``_band, _cell``) from which it may be within the radius."""
    band, lon = _band(F.col("lat"), radius_km), F.col("lon")
    bands = df.withColumn("_band", F.explode(F.array(band - 1, band, band + 1)))
    sized = bands.withColumn("_n", _cells_around(F.col("_band"), radius_km)).withColumn("_w", F.lit(360.0) / F.col("_n"))
    cells = F.array_distinct(F.array(*[_cell(at, F.col("_n")) for at in (lon - F.col("_w"), lon, lon + F.col("_w"))]))
    return sized.withColumn("_cell", F.explode(cells)).drop("_n", "_w")


def _cells_ahead(df: DataFrame, radius_km: float) -> DataFrame:
    """Each point in its own cell (``_own``) and in those cells around it that come after its own.

    These are the next cell of its band and the cells of the next band: of two neighbouring cells one sees the other.
    """
    band, lon = _band(F.col("lat"), radius_km), F.col("lon")
    bands = df.withColumn("_home", band).withColumn("_band", F.explode(F.array(band, band + 1)))
    sized = bands.withColumn("_n", _cells_around(F.col("_band"), radius_km)).withColumn("_here", _cell(lon, F.col("_n")))
    sized = sized.withColumns({"_after": F.pmod(F.col("_here") + 1, F.col("_n")), "_before": F.pmod(F.col("_here") - 1, F.col("_n"))})
    # A band of two cells has one border twice, and a single cell none.
    onward = (F.col("_n") > 2) | ((F.col("_n") == 2) & (F.col("_here") == 0))
    row = F.when(onward, F.array("_here", "_after")).otherwise(F.array("_here"))
    cells = F.when(F.col("_band") == F.col("_home"), row).otherwise(F.array_distinct(F.array("_before", "_here", "_after")))
    spread = sized.withColumn("_cell", F.explode(cells))
    own = (F.col("_band") == F.col("_home")) & (F.col("_cell") == F.col("_here"))
    return spread.withColumn("_own", own).drop("_home", "_n", "_here", "_after", "_before")


def candidate_pairs(df: DataFrame, keys: Sequence[str], id_column: str, radius_km: float) -> DataFrame:
    """Pairs ``a``/``b`` (structs of all columns, a.id < b.id) of the same keys in neighbouring cells.

    An equi-join on (keys, band, cell): one side stays in its own cell, the other is copied to its own and the at
    most four cells after it, so that a pair of cells meets once. Copies hold no keys twice.
    """
    others = [c for c in df.columns if c not in keys]
    whole = F.struct(*others)
    band, cell = home_cell(F.col("lat"), F.col("lon"), radius_km)
    home = df.select(*keys, band.alias("_band"), cell.alias("_cell"), whole.alias("_p"))
    ahead = _cells_ahead(df.select(*keys, "lat", "lon", whole.alias("_q")), radius_km).drop("lat", "lon")
    pairs = home.join(by_sorting(ahead), [*keys, "_band", "_cell"])
    p, q = F.col(f"_p.{id_column}"), F.col(f"_q.{id_column}")
    pairs = pairs.filter((p < q) | (~F.col("_own") & (p > q)))
    first = lambda c: F.when(p < q, F.col(f"_p.{c}")).otherwise(F.col(f"_q.{c}")).alias(c)
    last = lambda c: F.when(p < q, F.col(f"_q.{c}")).otherwise(F.col(f"_p.{c}")).alias(c)
    return pairs.select(*keys, F.struct(*map(first, others)).alias("a"), F.struct(*map(last, others)).alias("b"))


def near_pairs(df: DataFrame, keys: Sequence[str], id_column: str, radius_km: float) -> DataFrame:
    """Pairs of points nearer than the radius: ``keys, id_a, id_b, km``."""
    km = haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    slim = df.select(*keys, id_column, "lat", "lon")
    return (
        candidate_pairs(slim, keys, id_column, radius_km)
        .select(*keys, F.col(f"a.{id_column}").alias("id_a"), F.col(f"b.{id_column}").alias("id_b"), km.alias("km"))
        .filter(F.col("km") < radius_km)
    )


def haversine_pairs(
    fixes: DataFrame, radius_km: float, device: str = "device", lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Distances below the radius between the distinct coordinates of a device.

    Repeated coordinates are reduced first, so copies of a fix cannot multiply pairs.
    """
    points = fixes.groupBy(device, F.col(lat).alias("lat"), F.col(lon).alias("lon")).agg(F.count("*").alias("n"))
    points = points.withColumn("point", F.struct("lat", "lon"))
    pairs = near_pairs(points, [device], "point", radius_km)
    return pairs.select(
        device,
        F.col("id_a.lat").alias("lat_a"),
        F.col("id_a.lon").alias("lon_a"),
        F.col("id_b.lat").alias("lat_b"),
        F.col("id_b.lon").alias("lon_b"),
        "km",
    )


# --- hulls ------------------------------------------------------------------------------------


#: Points farther from their middle than this keep no hull: beyond it distances need not peak at corners.
WIDEST_DEGREES = 45.0


def _outer(p: np.ndarray) -> np.ndarray:
    """Indices of the corners of points in the plane, side by side (quickhull; each step looks at arrays of points)."""
    order = np.lexsort((p[:, 1], p[:, 0]))
    first, last = int(order[0]), int(order[-1])
    corners = {first, last}
    slack = 1e-14 * float(np.abs(p).max()) ** 2
    sides = [(first, last, order), (last, first, order)]
    while sides:
        a, b, inside = sides.pop()
        edge, away = p[b] - p[a], p[inside] - p[a]
        left = edge[0] * away[:, 1] - edge[1] * away[:, 0]
        beyond = left > slack
        if beyond.any():
            inside, left = inside[beyond], left[beyond]
            top = int(inside[left.argmax()])
            corners.add(top)
            sides += [(a, top, inside), (top, b, inside)]
    return np.array(sorted(corners))


def _hull_indices(lat: np.ndarray, lon: np.ndarray) -> list[int]:
    """Indices of the corners of the convex hull on the sphere.

    Seen from the middle of the points, great circles are straight lines on the tangent plane (gnomonic projection),
    so date line and poles need no care. Points that reach too far from their middle are all kept.
    """
    phi, theta = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float))
    v = np.stack([np.cos(phi) * np.cos(theta), np.cos(phi) * np.sin(theta), np.sin(phi)], axis=1)
    middle = v.mean(axis=0)
    length = np.linalg.norm(middle)
    if len(v) < 3 or length < 1e-6:
        return list(range(len(v)))
    middle /= length
    height = v @ middle
    if height.min() < np.cos(np.radians(WIDEST_DEGREES)):
        return list(range(len(v)))
    east = np.cross([0.0, 0.0, 1.0] if abs(middle[2]) < 0.9 else [1.0, 0.0, 0.0], middle)
    east /= np.linalg.norm(east)
    plane = np.stack([v @ east, v @ np.cross(middle, east)], axis=1) / height[:, None]
    return _outer(plane - plane.mean(axis=0)).tolist()


@F.pandas_udf(ArrayType(IntegerType()))
def _hull_of(lat: pd.Series, lon: pd.Series) -> pd.Series:
    return pd.Series([_hull_indices(a, b) for a, b in zip(lat, lon)])


def _hull_step(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hull corners per key group as an array column ``hull``; groups are bounded by the caller."""
    grouped = points.groupBy(*keys).agg(F.collect_set(F.struct("lat", "lon")).alias("_pts"))
    corners = _hull_of(F.transform("_pts", lambda p: p["lat"]), F.transform("_pts", lambda p: p["lon"]))
    return grouped.withColumn("_at", corners).select(
        *keys, F.transform("_at", lambda i: F.get(F.col("_pts"), i)).alias("hull")
    )


def hulls(points: DataFrame, keys: Sequence[str], group: int = 2048) -> DataFrame:
    """Convex hull on the sphere (array of corner structs) of each key's points.

    The hull of a union is the hull of the hulls, so a large group is cut into
    hashed parts of about ``group`` points, each reduced to its corners, until one
    part per key is left. No task ever holds a whole large group; where every point is a corner, the array holds
    them all. Points on a grid of step s within a distance D have no more than about ``9 (D / s) ** (2 / 3)`` corners.
    """
    current = points.select(*keys, "lat", "lon")
    while True:
        sizes = current.groupBy(*keys).agg(F.count("*").alias("_n"))
        largest = sizes.agg(F.max("_n")).first()[0] or 0
        if largest <= group:
            return _hull_step(current, keys)
        parts = F.pmod(F.xxhash64("lat", "lon"), F.ceil(F.col("_n") / F.lit(group)).cast("long"))
        cut = current.join(by_sorting(sizes), list(keys)).withColumn("_part", parts)
        reduced = materialize(
            _hull_step(cut, [*keys, "_part"]).select(*keys, F.explode("hull").alias("_p")).select(*keys, "_p.lat", "_p.lon"),
            "hull",
        )
        if (reduced.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) >= largest:
            return _hull_step(reduced, keys)  # every point is a corner
        current = reduced


def farthest_km(hull_a: Column, hull_b: Column) -> Column:
    """Largest distance between the members of two groups, from their hull corners."""
    return F.array_max(
        F.transform(
            hull_a,
            lambda p: F.array_max(F.transform(hull_b, lambda q: haversine_km(p["lat"], p["lon"], q["lat"], q["lon"]))),
        )
    )
