"""Distances on the earth as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0

# WGS-84 ellipsoid (fixed values).
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_B = WGS84_A * (1 - WGS84_F)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_dlat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_dlon), F.lit(2)
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * 1000.0


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``then`` (a one-element transform)."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, iterations: int = 100, tolerance: float = 1e-13) -> Column:
    """Ellipsoidal distance in metres by Vincenty's inverse formula (1975).

    The fixed-point iteration on the longitude difference runs inside one
    ``aggregate`` over a short sequence, so no Python and no plan blow-up. It stops
    where a round moves by less than ``tolerance``; most pairs need under eight rounds.
    Nearly antipodal points may not converge in ``iterations`` rounds and give NULL.
    """

    def reduced(lat: Column) -> Column:
        return F.atan(F.lit(1 - WGS84_F) * F.tan(F.radians(lat)))

    ends = F.struct(
        F.sin(reduced(lat1)).alias("s1"),
        F.cos(reduced(lat1)).alias("c1"),
        F.sin(reduced(lat2)).alias("s2"),
        F.cos(reduced(lat2)).alias("c2"),
        F.radians(lon2 - lon1).alias("l"),
    )

    def angles(e: Column, lam: Column, then: Callable[[Column], Column]) -> Column:
        """Evaluate the auxiliary angles for ``lam`` step by step, each once."""

        def trig(t: Column) -> Column:
            across = F.hypot(e["c2"] * t["sl"], e["c1"] * e["s2"] - e["s1"] * e["c2"] * t["cl"])
            along = e["s1"] * e["s2"] + e["c1"] * e["c2"] * t["cl"]
            return _let(F.struct(across.alias("ss"), along.alias("cs"), (e["c1"] * e["c2"] * t["sl"]).alias("x")), azimuth)

        def azimuth(t: Column) -> Column:
            sin_alpha = F.coalesce(F.try_divide(t["x"], t["ss"]), F.lit(0.0))
            return _let(
                F.struct(t["ss"].alias("ss"), t["cs"].alias("cs"), F.atan2(t["ss"], t["cs"]).alias("sg"), sin_alpha.alias("sa")), middle
            )

        def middle(t: Column) -> Column:
            c2a = F.lit(1.0) - t["sa"] * t["sa"]
            return _let(
                F.struct(
                    t["ss"].alias("ss"), t["cs"].alias("cs"), t["sg"].alias("sg"), t["sa"].alias("sa"), c2a.alias("c2a"),
                    (t["cs"] - F.coalesce(F.try_divide(2 * e["s1"] * e["s2"], c2a), F.lit(0.0))).alias("cm"),
                ),
                then,
            )

        return _let(F.struct(F.sin(lam).alias("sl"), F.cos(lam).alias("cl")), trig)

    def step(e: Column, lam: Column) -> Column:
        def update(t: Column) -> Column:
            return _let(
                F.lit(WGS84_F / 16) * t["c2a"] * (4 + WGS84_F * (4 - 3 * t["c2a"])),
                lambda c: e["l"]
                + (1 - c) * WGS84_F * t["sa"] * (t["sg"] + c * t["ss"] * (t["cm"] + c * t["cs"] * (2 * t["cm"] * t["cm"] - 1))),
            )

        return angles(e, lam, update)

    def finish(e: Column, lam: Column) -> Column:
        def scale(t: Column) -> Column:
            return _let(t["c2a"] * ((WGS84_A**2 - WGS84_B**2) / WGS84_B**2), lambda u: length(t, u))

        def length(t: Column, u: Column) -> Column:
            big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            cm2 = t["cm"] * t["cm"]
            return _let(
                big_b,
                lambda b: WGS84_B
                * big_a
                * (
                    t["sg"]
                    - b * t["ss"] * (t["cm"] + b / 4 * (t["cs"] * (2 * cm2 - 1) - b / 6 * t["cm"] * (4 * t["ss"] * t["ss"] - 3) * (4 * cm2 - 3)))
                ),
            )

        return angles(e, lam, scale)

    def round_of(e: Column, state: Column) -> Column:
        moved = _let(step(e, state["lam"]), lambda lam: F.struct(lam.alias("lam"), (F.abs(lam - state["lam"]) <= tolerance).alias("still")))
        return F.when(state["still"], state).otherwise(moved)

    return _let(
        ends,
        lambda e: F.aggregate(
            F.sequence(F.lit(1), F.lit(iterations)),
            F.struct(e["l"].alias("lam"), F.lit(False).alias("still")),
            lambda state, _: round_of(e, state),
            lambda state: F.when(state["still"], finish(e, state["lam"])),
        ),
    )


def mean_position(lat: Column, lon: Column, weight: Column | None = None) -> tuple[Column, Column]:
    """Aggregates: latitude and longitude of the mean of unit vectors, which no date line or pole disturbs."""
    x, y, z = (F.sum(p if weight is None else p * weight) for p in unit_vector(lat, lon))
    return position_of(x, y, z)


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    phi, theta = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(theta), F.cos(phi) * F.sin(theta), F.sin(phi)


def position_of(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the direction of a vector."""
    return F.degrees(F.atan2(z, F.hypot(x, y))), F.degrees(F.atan2(y, x))
