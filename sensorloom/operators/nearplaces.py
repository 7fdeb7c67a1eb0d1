"""Nearest named places and labels by distance."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.functions.geo import EARTH_RADIUS_KM, haversine_m
from sensorloom.operators.geogrid import cells_around, home_cell
from sensorloom.session import materialize

Metric = Callable[[Column, Column, Column, Column], Column]


#: Places of a participant that go along with its fixes as one array; participants with more are searched by cells.
LISTED = 64
#: First radius of a ring search, and how much wider each further ring is.
FIRST_KM, WIDER = 0.1, 8.0
#: Beyond this radius every place is a candidate.
WHOLE_KM = math.pi * EARTH_RADIUS_KM


def _split(places: DataFrame, device: str, extra: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Distinct places: the counts, an array per device of at most ``LISTED`` places, and those of the other devices (None: no such device)."""
    entry = [*extra, "place", "lat", "lon"]
    known = materialize(places.select(device, *entry).distinct(), "places")
    counts = known.groupBy(device).agg(F.count(F.lit(1)).alias("_places_n"))
    large = counts.filter(F.col("_places_n") > LISTED)
    if large.isEmpty():
        many, few = None, known
    else:
        large = materialize(large, "many-places")
        many, few = known.join(large, device), known.join(large, device, "left_anti")
    return counts, few.groupBy(device).agg(F.sort_array(F.collect_list(F.struct(*entry))).alias("_places")), many


def _fixes(rows: DataFrame, places: DataFrame, device: str) -> DataFrame:
    """The distinct coordinates of the devices that the places are of."""
    return rows.join(places.select(device).distinct(), device, "left_semi").filter("lat IS NOT NULL AND lon IS NOT NULL").select(device, "lat", "lon").distinct()


def _in_reach(fixes: DataFrame, places: DataFrame, radius_km: float, device: str, metric: Metric) -> DataFrame:
    """Fixes with every place within the radius, and some beyond it: ``…, _p (place columns), _m``."""
    band, cell = home_cell(F.col("lat"), F.col("lon"), radius_km)
    home = fixes.withColumns({"_band": band, "_cell": cell})
    whole = F.struct(*[c for c in places.columns if c not in (device, "_places_n")])
    around = cells_around(places.select(device, "lat", "lon", whole.alias("_p")), radius_km).drop("lat", "lon")
    joined = home.join(around, [device, "_band", "_cell"]).drop("_band", "_cell")
    return joined.withColumn("_m", metric(F.col("lat"), F.col("lon"), F.col("_p.lat"), F.col("_p.lon")))


def ring_search(fixes: DataFrame, places: DataFrame, n: int, device: str, metric: Metric) -> DataFrame:
    """``device, lat, lon, _near`` (the ``n`` nearest places as structs of metres and name) of distinct fixes.

    Places are found by grid cells as wide as a radius. A fix is done once its ``n``-th place lies within the radius, as none
    can be nearer then; the others go on with a wider one. Metrics may differ from the sphere by a hundredth.
    """
    out: DataFrame | None = None
    radius = FIRST_KM
    order = Window.partitionBy(device, "lat", "lon").orderBy("_m", "_p.place")
    while True:
        last = radius >= WHOLE_KM
        found = _in_reach(fixes, places, min(radius, WHOLE_KM), device, metric)
        top = found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n)
        lists = top.groupBy(device, "lat", "lon").agg(F.sort_array(F.collect_list(F.struct(F.col("_m").alias("m"), F.col("_p.place").alias("place")))).alias("_near"))
        lists = materialize(lists, "ring")
        done = lists if last else lists.filter((F.size("_near") == n) & (F.col("_near")[n - 1]["m"] <= 990 * radius))
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        fixes = materialize(fixes.join(done.select(device, "lat", "lon"), [device, "lat", "lon"], "left_anti"), "open-fixes")
        if fixes.isEmpty():
            return out
        radius *= WIDER


def _nearest(rows: DataFrame, places: DataFrame, n: int, device: str, metric: Metric) -> DataFrame:
    """Rows of devices with places, with ``_near``: the ``n`` nearest as structs of metres and name."""
    _, listed, many = _split(places, device)
    entry = lambda p: F.struct(metric(F.col("lat"), F.col("lon"), p["lat"], p["lon"]).alias("m"), p["place"].alias("place"))
    near = rows.join(listed, device).withColumn("_near", F.slice(F.array_sort(F.transform("_places", entry)), 1, n)).drop("_places")
    if many is None:
        return near
    found = ring_search(_fixes(rows, many, device), many, n, device, metric)
    of_many = rows.join(many.select(device).distinct(), device, "left_semi")
    return near.unionByName(of_many.join(found, [device, "lat", "lon"], "left"))


def nearest_place_2(
    rows: DataFrame, places: DataFrame, device: str = "device", metric: Metric = haversine_m
) -> DataFrame:
    """Closest and second-closest named place with their distances in metres.

    ``places(device, place, lat, lon)``; equal distances are ordered by name. Fixes without coordinates have none.
    """
    first, second = F.get(F.col("_near"), F.lit(0)), F.get(F.col("_near"), F.lit(1))
    return (
        _nearest(rows, places, 2, device, metric)
        .withColumns(
            {
                "place": first["place"],
                "place_m": first["m"],
                "second_place": second["place"],
                "second_place_m": second["m"],
            }
        )
        .drop("_near")
    )


def distance_to_frequent_places(
    rows: DataFrame, day_places: DataFrame, night_places: DataFrame, device: str = "device", metric: Metric = haversine_m
) -> DataFrame:
    """Metres to the nearest of a participant's day places and of the night places; NULL without any."""
    out = rows
    for name, places in (("day", day_places), ("night", night_places)):
        near = _nearest(out, places, 1, device, metric).withColumn(f"frequent_{name}_m", F.get(F.col("_near"), F.lit(0))["m"]).drop("_near")
        without = out.join(places.select(device).distinct(), device, "left_anti")
        out = near.unionByName(without.withColumn(f"frequent_{name}_m", F.lit(None).cast("double")))
    return out


def label_by_place_distance(
    rows: DataFrame,
    places: DataFrame,
    threshold_m: float,
    device: str = "device",
    skip: Column | None = None,
    metric: Metric = haversine_m,
) -> DataFrame:
    """Label each fix by the first named place (in ``priority`` order) nearer than the threshold.

    Otherwise "other" for participants with places, NULL where ``skip`` holds.
    ``places(device, priority, place, lat, lon)``.
    """
    counts, listed, many = _split(places, device, ["priority"])
    measured = F.transform(
        "_places",
        lambda p: F.struct(
            p["place"].alias("place"), metric(F.col("lat"), F.col("lon"), p["lat"], p["lon"]).alias("m")
        ),
    )
    hit = F.get(F.filter(measured, lambda x: x["m"] < threshold_m), F.lit(0))
    skipped = F.lit(False) if skip is None else skip
    found = rows.join(counts, device, "left").join(listed, device, "left").withColumn("_hit", hit).drop("_places")
    if many is not None:
        near = _in_reach(_fixes(rows, many, device), many, 1.01 * threshold_m / 1000, device, metric).filter(F.col("_m") < threshold_m)
        first = F.min(F.struct("_p", F.col("_m").alias("m")))
        best = near.groupBy(device, "lat", "lon").agg(first.alias("_first")).select(device, "lat", "lon", F.struct("_first._p.place", "_first.m").alias("_far_hit"))
        found = found.join(best, [device, "lat", "lon"], "left").withColumn("_hit", F.coalesce("_hit", "_far_hit")).drop("_far_hit")
    return (
        found.withColumn("_hit", F.when(~skipped, F.col("_hit")))
        .withColumns(
            {
                "place_label": F.when(
                    ~skipped & F.col("_places_n").isNotNull(), F.coalesce("_hit.place", F.lit("other"))
                ),
                "place_label_m": F.col("_hit.m"),
            }
        )
        .drop("_hit", "_places_n")
    )
