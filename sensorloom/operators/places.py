"""Place features, frequent places and named locations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.functions.geo import haversine_m
from sensorloom.functions.scalars import floor_div, ratio, ratio_or_zero
from sensorloom.functions.timefn import DAY, day_kind, hour_of, time_of_day, weekday_of
from sensorloom.operators.geogrid import near_pairs
from sensorloom.operators.graphs import connected_components
from sensorloom.operators.silhouette import BLOCK, choose, each_small_key, silhouettes
from sensorloom.session import materialize

# --- selection --------------------------------------------------------------------------------


def topn_places(
    rows: DataFrame,
    n: int,
    device: str = "device",
    place: str = "place",
    within: Sequence[str] = (),
    total: str = "records_total",
) -> DataFrame:
    """Rows of the ``n`` largest places per device (and chunk), with the device's record total before the cut.

    Sizes are combined map-side; rows meet them in one join.
    """
    sizes = rows.groupBy(device, *within, place).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(device, *within).orderBy(F.col("_n").desc(), place))
    kept = sizes.withColumn("_rank", rank).filter(F.col("_rank") <= n).select(device, *within, place)
    totals = sizes.groupBy(device).agg(F.sum("_n").alias(total))
    return rows.join(kept.join(totals, device), [device, *within, place])


# --- place features ---------------------------------------------------------------------------


def _days(rows: DataFrame, device: str, us: str) -> DataFrame:
    return rows.select(device, floor_div(F.col(us), DAY).alias("_d")).distinct().groupBy(device).agg(
        F.count("*").alias("_days")
    )


def place_visits(rows: DataFrame, device: str = "device", place: str = "place", us: str = "us") -> DataFrame:
    """Visits per day (over all days of the participant) and share of the visits, plain and trusted.

    ``rows`` as from ``stay_records``. A day without the place counts as 0, so the
    mean over days is the number of visits over the number of days.
    """
    per_place = rows.groupBy(device, place).agg(
        F.sum("stay_first").alias("_v"), F.sum("stay_first_trusted").alias("_vt")
    )
    totals = per_place.groupBy(device).agg(F.sum("_v").alias("_all"), F.sum("_vt").alias("_allt"))
    joined = per_place.join(totals, device).join(_days(rows, device, us), device)
    return joined.select(
        device,
        place,
        ratio(F.col("_v"), F.col("_days")).alias("visits_per_day"),
        ratio(F.col("_vt"), F.col("_days")).alias("visits_per_day_trusted"),
        ratio_or_zero(F.col("_v"), F.col("_all")).alias("visits_fraction"),
        ratio_or_zero(F.col("_vt"), F.col("_allt")).alias("visits_fraction_trusted"),
    )


def place_time(
    rows: DataFrame, device: str = "device", place: str = "place", us: str = "us", total: str | None = None
) -> DataFrame:
    """Records, time per day, stay durations and shares per place, plain and trusted.

    ``total``: column holding the participant's record total before places were
    cut; without it the share is of the given rows.
    """
    whole = F.max(total) if total else F.count("*")
    per_place = rows.groupBy(device, place).agg(
        F.count("*").alias("total_records"),
        whole.alias("_total"),
        *[
            part
            for s, suffix in (("stay_s", ""), ("stay_s_trusted", "_trusted"))
            for part in (
                F.coalesce(F.sum(s), F.lit(0.0)).alias(f"_sum{suffix}"),
                F.max(s).alias(f"stay_duration_max{suffix}"),
                F.avg(s).alias(f"stay_duration_mean{suffix}"),
            )
        ],
    )
    totals = per_place.groupBy(device).agg(
        F.sum("total_records").alias("_rows"),
        F.sum("_sum").alias("_all"),
        F.sum("_sum_trusted").alias("_all_trusted"),
    )
    joined = per_place.join(totals, device).join(_days(rows, device, us), device)
    denominator = F.col("_total") if total else F.col("_rows")
    return joined.select(
        device,
        place,
        "total_records",
        ratio(F.col("total_records"), denominator).alias("total_records_fraction"),
        ratio(F.col("total_records"), F.col("_rows")).alias("biggest_places_fraction"),
        ratio(F.col("_sum"), F.col("_days")).alias("time_per_day"),
        ratio(F.col("_sum_trusted"), F.col("_days")).alias("time_per_day_trusted"),
        "stay_duration_max",
        "stay_duration_max_trusted",
        "stay_duration_mean",
        "stay_duration_mean_trusted",
        ratio_or_zero(F.col("_sum"), F.col("_all")).alias("time_fraction"),
        ratio_or_zero(F.col("_sum_trusted"), F.col("_all_trusted")).alias("time_fraction_trusted"),
    )


SLOTS = {
    "hour": [str(h) for h in range(24)],
    "time_of_day": ["morning", "afternoon", "evening", "night"],
    "weekday": [str(w) for w in range(7)],
    "day_kind": ["weekday", "weekend"],
}
SLOT_FEATURES = ["arrive", "leave", "intersecting", "time_fraction", "time_per_day"]


def place_timeslots(
    rows: DataFrame, hertz: float, only_stays: bool = True, device: str = "device", place: str = "place", us: str = "us"
) -> DataFrame:
    """Features per (device, place, slot type, slot) for hours, day parts, weekdays and weekend.

    Arrivals, departures and stays in the slot over those of the place, share of the
    place's records and seconds per day, each plain and trusted. Records are first
    reduced to (place, hour, weekday, stay), and only those few cells are unfolded
    to the four slot types. A stay is trusted as a whole or not at all. ``only_stays`` = False counts records outside stays too.
    """
    hour, weekday = hour_of(F.col(us)), weekday_of(F.col(us))
    cells = rows.groupBy(device, place, hour.alias("_h"), weekday.alias("_w"), "stay", "stay_trusted").agg(
        F.count("*").alias("_n"),
        *[F.sum(c).alias(c) for c in ("stay_first", "stay_last", "stay_first_trusted", "stay_last_trusted")],
    )
    counted = F.lit(True) if not only_stays else F.col("stay").isNotNull()
    counted_t = F.lit(True) if not only_stays else F.col("stay_trusted").isNotNull()
    cells = cells.withColumns(
        {
            "_rows": F.when(counted, F.col("_n")).otherwise(0),
            "_rows_t": F.when(counted_t, F.col("_n")).otherwise(0),
        }
    )
    sums = {"f": "stay_first", "ft": "stay_first_trusted", "l": "stay_last", "lt": "stay_last_trusted", "r": "_rows", "rt": "_rows_t"}

    def measured(found: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Stays are first one row each, so that counting them needs no copies of the cells for distinct counts."""
        stays = found.groupBy(*keys, "stay").agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.max("stay_trusted").alias("_trusted"))
        return stays.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums], F.count("stay").alias("s"), F.count("_trusted").alias("st"))

    slots = F.array(
        *[
            F.struct(F.lit(t).alias("slot_type"), value.cast("string").alias("slot"))
            for t, value in (
                ("hour", F.col("_h")),
                ("time_of_day", time_of_day(F.col("_h"))),
                ("weekday", F.col("_w")),
                ("day_kind", day_kind(F.col("_w"))),
            )
        ]
    )
    in_slot = measured(cells.select("*", F.inline(slots)), [device, place, "slot_type", "slot"])
    overall = measured(cells, [device, place]).withColumnsRenamed(
        {c: f"{c}_all" for c in ("f", "ft", "l", "lt", "s", "st", "r", "rt")}
    )
    joined = in_slot.join(overall, [device, place]).join(_days(rows, device, us), device)
    share = {
        "arrive": "f", "arrive_trusted": "ft", "leave": "l", "leave_trusted": "lt",
        "intersecting": "s", "intersecting_trusted": "st", "time_fraction": "r", "time_fraction_trusted": "rt",
    }
    per_day = {"time_per_day": "r", "time_per_day_trusted": "rt"}
    return joined.select(
        device,
        place,
        "slot_type",
        "slot",
        *[ratio_or_zero(F.col(c), F.col(f"{c}_all")).alias(n) for n, c in share.items()],
        *[ratio(F.col(c) / F.lit(float(hertz)), F.col("_days")).alias(n) for n, c in per_day.items()],
    )


def place_timeslots_wide(slots: DataFrame, device: str = "device", place: str = "place") -> DataFrame:
    """One row per place with a column per slot and feature; slots without records are 0."""
    names = [f"{f}{t}" for f in SLOT_FEATURES for t in ("", "_trusted")]
    entry = F.struct(F.concat_ws("_", "slot_type", "slot").alias("key"), F.array(*names).alias("value"))
    gathered = slots.groupBy(device, place).agg(F.map_from_entries(F.collect_list(entry)).alias("_slots"))  # at most 37 entries
    cells = [  # SQL text: one call per column instead of a tree of calls for each of the 370
        F.expr(f"coalesce(get(_slots['{kind}_{slot}'], {i}), 0D) AS `{kind}_{slot}_{n}`")
        for kind, values in SLOTS.items()
        for slot in values
        for i, n in enumerate(names)
    ]
    return gathered.select(device, place, *cells)


def places_with_stay(places: DataFrame) -> DataFrame:
    return places.filter(F.col("stay_duration_mean") > 0)


def place_feature_ranks(places: DataFrame, features: Sequence[str], device: str = "device") -> DataFrame:
    """Average rank of each feature over a participant's places.

    ``<f>_rank_ascent`` gives 1 to the largest value, ``<f>_rank_descent`` 1 to the
    smallest; NULL stays NULL. Works on place rows, a few per participant.
    """

    def average(f: str, order: Column) -> Column:
        rank = F.rank().over(Window.partitionBy(device).orderBy(order))
        ties = F.count(F.lit(1)).over(Window.partitionBy(device, f))
        return F.when(F.col(f).isNotNull(), rank + (ties - 1) / 2)

    ranks = {}
    for f in features:
        ranks[f"{f}_rank_ascent"] = average(f, F.col(f).desc_nulls_last())
        ranks[f"{f}_rank_descent"] = average(f, F.col(f).asc_nulls_last())
    return places.withColumns(ranks)


# --- frequent places --------------------------------------------------------------------------


def _small_centres(table: pa.Table, ks: Sequence[int], tolerance: float) -> dict[str, np.ndarray]:
    """The final centres of one participant for every k, from the rows in the order of ``_i``."""
    table = table.sort_by("_i")
    x = np.stack([table.column(c).to_numpy() for c in ("lat", "lon")], axis=1)
    w = table.column("w").to_numpy()
    found = []
    for k in [k for k in ks if k <= len(x)] if len(x) >= ks[0] else [1]:
        ids, centres, own, still = np.arange(1, k + 1), x[:k], None, False
        while not still:
            near = np.square(x[:, None] - centres).sum(axis=2).argmin(axis=1)
            before, own = own, ids[near]
            n = np.bincount(near, w, len(ids))
            kept = n > 0
            means = np.stack([np.bincount(near, x[:, j] * w, len(ids))[kept] / n[kept] for j in (0, 1)], axis=1)
            still = np.array_equal(own, before) or np.abs(means - centres[kept]).max() <= tolerance
            ids, centres = ids[kept], means
        found.append((np.full(len(ids), k), ids, centres))
    k, c, centres = (np.concatenate(part) for part in zip(*found))
    return {"k": k.astype("int32"), "c": c.astype("int32"), "lat": centres[:, 0], "lon": centres[:, 1]}


def kmeans_k_sweep(
    rows: DataFrame,
    start_hour: int,
    end_hour: int,
    ks: Sequence[int] = (2, 3, 4, 5, 6),
    min_rows: int = 3600,
    near_m: float = 50.0,
    stop_silhouette: float = 0.9,
    tolerance: float = 1e-9,
    device: str = "device",
    us: str = "us",
) -> DataFrame:
    """Frequent locations per participant in a day part: the best k-means over several k.

    Participants with at most a block of distinct coordinates are clustered many to a call, for every k. The others run
    together: a row is compared with its own participant's few centres and each round is one map-side combined average.
    The silhouette is the usual one on Euclidean distances (see ``silhouettes``). The first k whose silhouette exceeds the limit wins,
    otherwise the best. Participants with fewer distinct coordinates than the
    smallest k get one location, whose silhouette is 1. Rounds go on until no centre
    moves by more than ``tolerance`` degrees.
    """
    ks = sorted(ks)
    hour = hour_of(F.col(us))
    part = rows.filter((hour >= start_hour) & (hour < end_hour))
    enough = part.groupBy(device).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows)
    points = materialize(
        part.join(enough.select(device), device, "left_semi").groupBy(device, "lat", "lon").agg(F.count("*").alias("w")), "points"
    )
    sizes = materialize(points.groupBy(device).agg(F.count("*").alias("_distinct")), "sizes")
    few = F.col("_distinct") <= BLOCK
    n_few, n_many = sizes.agg(F.sum(F.when(few, F.col("_distinct"))), F.sum(F.when(~few, F.col("_distinct")))).first()
    # Start from the coordinates with the smallest hash: at most max(ks) per participant.
    seed = F.row_number().over(Window.partitionBy(device).orderBy(F.xxhash64("lat", "lon"), "lat", "lon"))

    def of(chosen: Column) -> DataFrame:
        return points.join(sizes.filter(chosen).select(device), device, "left_semi")

    def square(c: Column) -> Column:
        return F.pow(F.col("lat") - c["lat"], F.lit(2)) + F.pow(F.col("lon") - c["lon"], F.lit(2))

    def assign(rows: DataFrame, current: DataFrame) -> DataFrame:
        listed = current.groupBy(device, "k").agg(F.sort_array(F.collect_list(F.struct("c", "lat", "lon"))).alias("_cs"))
        nearest = F.array_min(F.transform("_cs", lambda c: F.struct(square(c).alias("d"), c["c"].alias("c"))))
        return rows.join(listed, device).withColumn("c", nearest["c"]).drop("_cs")

    def centres_of_many() -> DataFrame:
        """Rounds over all rows, for participants with more coordinates than a task should hold."""
        large = materialize(of(~few), "points")
        seeds = large.withColumn("_i", seed).filter(F.col("_i") <= max(ks))
        choices = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k <= F.col("_distinct"))
        usable = F.when(F.col("_distinct") < ks[0], F.array(F.lit(1))).otherwise(choices)
        centres = materialize(
            seeds.join(sizes, device).withColumn("k", F.explode(usable)).filter(F.col("_i") <= F.col("k")).select(device, "k", F.col("_i").alias("c"), "lat", "lon"),
            "centres",
        )

        def moved(current: DataFrame) -> DataFrame:
            return assign(large, current).groupBy(device, "k", "c").agg(
                (F.sum(F.col("lat") * F.col("w")) / F.sum("w")).alias("_lat"), (F.sum(F.col("lon") * F.col("w")) / F.sum("w")).alias("_lon")
            ).withColumnsRenamed({"_lat": "lat", "_lon": "lon"})

        while True:
            before = centres
            for _ in range(4):  # rounds form a short chain between two written tables
                centres = moved(centres)
            centres = materialize(centres, "centres")
            still = (F.abs(F.col("lat") - F.col("_lat")) <= tolerance) & (F.abs(F.col("lon") - F.col("_lon")) <= tolerance)
            if centres.join(before.withColumnsRenamed({"lat": "_lat", "lon": "_lon"}), [device, "k", "c"]).filter(~still).isEmpty():
                return centres

    parts = []
    if n_few:
        kind = dict(points.dtypes)[device]
        solve = lambda table: _small_centres(table, ks, tolerance)
        parts.append(each_small_key(of(few).withColumn("_i", seed), device, n_few, solve, f"{device} {kind},k int,c int,lat double,lon double"))
    if n_many:
        parts.append(centres_of_many())
    if not parts:
        parts.append(points.select(device, F.lit(1).alias("k"), F.lit(1).alias("c"), "lat", "lon"))  # no rows at all
    centres = materialize(reduce(DataFrame.unionByName, parts), "centres")

    members = materialize(assign(points, centres), "members")
    scores = silhouettes(members, device, sorted({1, *ks}), stop_silhouette)
    best = choose(scores, device, stop_silhouette).select(device, "k")
    metres = haversine_m(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    chosen = centres.join(best, [device, "k"]).select(device, "k", "c", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    return (
        members.join(chosen, [device, "k", "c"])
        .groupBy(device, "k", F.col("c").cast("long").alias("c"), "c_lat", "c_lon")
        .agg(F.sum("w").alias("n_members"), F.coalesce(F.sum(F.when(metres < near_m, F.col("w"))), F.lit(0)).alias("entries_near"))
        .join(scores, [device, "k"])
        .join(points.groupBy(device).agg(F.sum("w").alias("n_rows")), device)
        .select(
            device,
            F.col("k").cast("long").alias("n_places"),
            F.col("c").alias("place"),
            F.col("c_lat").alias("lat"),
            F.col("c_lon").alias("lon"),
            "n_members",
            "entries_near",
            F.sum("entries_near").over(Window.partitionBy(device)).alias("n_rows_near"),
            "n_rows",
            "silhouette",
            "silhouette_error",
        )
    )


def merge_frequent_places(places: DataFrame, limit_m: float, device: str = "device") -> DataFrame:
    """Merge frequent places nearer than the limit: mean position, summed counts.

    ``places(device, place, lat, lon, entries_near, entries)``; the merged place keeps the smallest id.
    """
    pairs = near_pairs(places.withColumnRenamed("place", "id"), [device], "id", limit_m / 1000)
    roots = connected_components(pairs, [device]).withColumnRenamed("id", "place")
    return (
        places.join(roots, [device, "place"], "left")
        .groupBy(device, F.coalesce("root", "place").alias("place"))
        .agg(
            F.avg("lat").alias("lat"),
            F.avg("lon").alias("lon"),
            F.sum("entries_near").alias("entries_near"),
            F.sum("entries").alias("entries"),
        )
    )


def drop_infrequent_places(places: DataFrame, device: str = "device") -> DataFrame:
    """Drop places with fewer entries than total / n + 1, but never a participant's last (largest) one.

    Adds the share of the participant's entries.
    """
    w = Window.partitionBy(device)
    rank = F.row_number().over(w.orderBy(F.col("entries_near").desc(), F.col("place").desc()))
    limit = F.sum("entries").over(w) / F.count(F.lit(1)).over(w) + 1
    return (
        places.withColumns(
            {
                "share_near": ratio(F.col("entries_near"), F.sum("entries").over(w)),
                "_keep": (F.col("entries_near") >= limit) | (rank == 1),
            }
        )
        .filter("_keep")
        .drop("_keep")
    )


def classify_frequent_places(
    day: DataFrame, night: DataFrame, limit_m: float, device: str = "device"
) -> DataFrame:
    """Name places: night → home (largest share) and other sleep places; day places not near one of
    these → work (largest share) and other frequent places.

    ``day`` / ``night``: ``(device, place, lat, lon, share_near)``, a few rows per participant.
    """

    def ranked(frame: DataFrame) -> Column:
        return F.row_number().over(Window.partitionBy(device).orderBy(F.col("share_near").desc(), "place"))

    names = night.withColumn("_r", ranked(night)).select(
        device, "lat", "lon", F.when(F.col("_r") == 1, "home").otherwise("other sleep place").alias("location_name")
    )
    sleeping = names.groupBy(device).agg(F.collect_list(F.struct("lat", "lon")).alias("_sleep"))
    near = F.exists("_sleep", lambda s: haversine_m(F.col("lat"), F.col("lon"), s["lat"], s["lon"]) < limit_m)
    free = day.join(sleeping, device, "left").filter(~F.coalesce(near, F.lit(False)))
    work = free.withColumn("_r", ranked(free)).select(
        device, "lat", "lon", F.when(F.col("_r") == 1, "work").otherwise("other frequent place").alias("location_name")
    )
    return names.unionByName(work)


# --- named locations --------------------------------------------------------------------------

# Class names of the questionnaire (fixed values).
HOME, HOME_2, OFFICE = "at home", "at home 2", "in the office"


def class_location_map(clusters: DataFrame, device: str = "device", label: str = "label", home: str = HOME) -> DataFrame:
    """Location of each (device, class): its largest cluster; a second home cluster becomes "<home> 2".

    ``clusters(device, label, cluster_label, n_rows, cluster_lat, cluster_lon)``.
    """
    rank = F.row_number().over(Window.partitionBy(device, label).orderBy(F.col("n_rows").desc(), "cluster_label"))
    kept = clusters.withColumn("_r", rank).filter((F.col("_r") == 1) | ((F.col("_r") == 2) & (F.col(label) == home)))
    name = F.when(F.col("_r") == 2, F.concat(F.col(label), F.lit(" 2"))).otherwise(F.col(label))
    return kept.select(device, name.alias("place"), F.col("cluster_lat").alias("lat"), F.col("cluster_lon").alias("lon"), F.col("n_rows").alias("n"))


def resolve_close_classes(
    places: DataFrame, limit_m: float = 50.0, device: str = "device", home: str = HOME, home_2: str = HOME_2, office: str = OFFICE
) -> DataFrame:
    """Home and office nearer than the limit become home; a second home near the (remaining) office becomes office."""

    def pick(name: str) -> Column:
        return F.max(F.when(F.col("place") == name, F.struct("lat", "lon", "n")))

    def close(a: str, b: str) -> Column:
        m = haversine_m(F.col(f"{a}.lat"), F.col(f"{a}.lon"), F.col(f"{b}.lat"), F.col(f"{b}.lon"))
        return F.coalesce(m < limit_m, F.lit(False))

    sides = places.groupBy(device).agg(pick(home).alias("_h"), pick(home_2).alias("_h2"), pick(office).alias("_o"))
    flags = sides.withColumn("_ho", close("_h", "_o")).select(
        device, "_ho", (~F.col("_ho") & close("_h2", "_o")).alias("_h2o"), F.col("_o.n").alias("_on"), F.col("_h2.n").alias("_h2n")
    )
    at = F.col("place")
    gone = ((at == office) & F.col("_ho")) | ((at == home_2) & F.col("_h2o"))
    extra = F.when((at == home) & F.col("_ho"), F.col("_on")).when((at == office) & F.col("_h2o"), F.col("_h2n")).otherwise(0)
    return places.join(flags, device).filter(~gone).select(device, "place", "lat", "lon", (F.col("n") + extra).alias("n"))
