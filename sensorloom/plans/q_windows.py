"""Queries: segments, static periods, stays and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.timefn import DAY, HOUR
from sensorloom.operators import segments, static, stays
from sensorloom.plans import views as v
from sensorloom.plans.q_sources import joined, sql_joined
from sensorloom.plans.registry import query
from sensorloom.plans.views import sql_haversine_m, sql_with
from sensorloom.session import materialize

_SEG = """bounds AS (SELECT device, event_us, min(us) AS t0, max(us) AS t1 FROM j GROUP BY ALL),
  placed AS (SELECT j.*, (j.us - t0) // 86400000000 AS segment FROM j JOIN bounds USING (device, event_us)
    WHERE t0 + ((j.us - t0) // 86400000000 + 1) * 86400000000 < t1),
  seg AS (SELECT * FROM placed QUALIFY count(*) OVER (PARTITION BY device, event_us, segment) > 1)"""


def segment_sql() -> str:
    """Table expressions up to ``seg``: rows of complete one-day segments in the ±3 day event windows."""
    return sql_joined(72) + ",\n" + _SEG


def segment_rows(spark, d):
    """The event windows and the kept segment rows are written: later steps read both several times."""
    windows = materialize(joined(spark, d, 72), "windows")
    return materialize(segments.tumbling_segments(windows, DAY, 1), "segments")


@query(
    "tumbling_segments",
    sql_with("sensor esm", "SELECT event_id, device, event_us, segment FROM seg", segment_sql()),
)
def _tumbling_segments(spark, d):
    return segment_rows(spark, d).select("event_id", "device", "event_us", "segment")


MOVE_SQL = f"""jg AS (SELECT g.*, e.event_us FROM gps g JOIN esm e ON g.device = e.device
    AND g.us BETWEEN e.event_us - {72 * HOUR} AND e.event_us + {72 * HOUR}),
  m0 AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, (us - lag(us) OVER w) / 1000000.0::DOUBLE AS gap FROM jg
    WINDOW w AS (PARTITION BY device, event_us ORDER BY us, event_id)),
  m1 AS (SELECT *, coalesce({sql_haversine_m('plat', 'plon', 'lat', 'lon')}, 0) AS distance_m,
    {sql_haversine_m('plat', 'plon', 'lat', 'lon')} / gap * 3.6::DOUBLE AS speed_kmh FROM m0),
  mv AS (SELECT *, (speed_kmh - lag(speed_kmh) OVER (PARTITION BY device, event_us ORDER BY us, event_id)) / gap AS accel_kmhs FROM m1)"""


def movement(spark, d):
    from sensorloom.operators.ranges import event_window_join

    events = v.esm(spark, d).select("device", "event_us")
    fixes = event_window_join(v.gps(spark, d), events, 72 * HOUR, 72 * HOUR)
    return segments.distance_speed_accel(fixes, tie=["event_id"], slice_us=DAY)


@query(
    "distance_speed_accel",
    sql_with(
        "gps esm",
        """SELECT event_id, event_us, round(distance_m, 4) AS distance_m, round(speed_kmh, 6) AS speed_kmh,
        round(accel_kmhs * 1000, 6) AS accel FROM mv""",
        MOVE_SQL,
    ),
)
def _distance_speed_accel(spark, d):
    return movement(spark, d).select(
        "event_id",
        "event_us",
        F.round("distance_m", 4).alias("distance_m"),
        F.round("speed_kmh", 6).alias("speed_kmh"),
        F.round(F.col("accel_kmhs") * 1000, 6).alias("accel"),
    )


STATIC_SQL = """sb AS (SELECT device, min(us) AS t0, max(us) AS t1 FROM sensor GROUP BY device),
  sw AS (SELECT device, t0 + w * 86400000000 AS start_us, t0 + w * 86400000000 + 432000000000 AS end_us
    FROM sb, LATERAL (SELECT unnest(range(0, 60)) AS w) WHERE t0 + w * 86400000000 + 432000000000 < t1),
  swin AS (SELECT sw.device, start_us, end_us, count(*) AS actual, 12.0::DOUBLE AS expected, count(*) FILTER (dv0 < 50) AS static
    FROM sw JOIN sensor s ON s.device = sw.device AND s.us >= start_us AND s.us < end_us GROUP BY ALL),
  swj AS (SELECT *, actual >= 12.0 * 0.75 AND static >= actual * 0.75::DOUBLE AS is_static FROM swin)"""

PERIOD_SQL = (
    STATIC_SQL
    + """,
  isl AS (SELECT *, CASE WHEN start_us < max(end_us) OVER (PARTITION BY device ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    THEN 0 ELSE 1 END AS o FROM swj WHERE is_static),
  isl2 AS (SELECT *, sum(o) OVER (PARTITION BY device ORDER BY start_us) AS p FROM isl),
  periods AS (SELECT device, min(start_us) AS start_us, max(end_us) AS end_us, max(end_us) - min(start_us) AS duration_us,
    CAST(sum(actual) AS BIGINT) AS actual, sum(expected) AS expected, CAST(sum(static) AS BIGINT) AS static FROM isl2 GROUP BY device, p)"""
)


def windows_static(spark, d):
    return static.static_windows(v.sensor(spark, d), "dv0", 50, 5 * DAY, DAY, expected=12, min_static=0.75)


@query(
    "static_windows",
    sql_with(
        "sensor",
        """SELECT device, start_us, end_us, actual, expected, round(actual / expected, 6) AS share_expected, static,
        round(static / actual::DOUBLE, 6) AS share_static, is_static FROM swj""",
        STATIC_SQL,
    ),
)
def _static_windows(spark, d):
    return windows_static(spark, d).withColumns(
        {c: F.round(c, 6) for c in ("share_expected", "share_static")}
    )


@query(
    "static_periods",
    sql_with(
        "sensor",
        """SELECT device, start_us, end_us, duration_us, actual, expected, round(actual / expected, 6) AS share_expected, static,
        round(static / actual::DOUBLE, 6) AS share_static FROM periods""",
        PERIOD_SQL,
    ),
)
def _static_periods(spark, d):
    return static.static_periods(windows_static(spark, d)).withColumns(
        {c: F.round(c, 6) for c in ("share_expected", "share_static")}
    )


@query(
    "static_windows_topk",
    sql_with(
        "sensor",
        """SELECT device, start_us, end_us, CAST(actual AS BIGINT) AS actual, 12.0::DOUBLE AS expected, round(actual / 12.0::DOUBLE, 6) AS share_expected,
        CAST(static AS BIGINT) AS static, round(static / actual::DOUBLE, 6) AS share_static,
        actual >= 9 AND static >= actual * 0.99::DOUBLE AS is_static FROM
        (SELECT device, start_us, end_us, sum(n) AS actual, sum(n) FILTER (rn <= 10) AS static FROM
          (SELECT *, row_number() OVER (PARTITION BY device, start_us ORDER BY n DESC, x) AS rn FROM
            (SELECT sw.device, start_us, end_us, round(dv0 - dv0 % 5, 3) AS x, count(*) AS n
             FROM sw JOIN sensor s ON s.device = sw.device AND s.us >= start_us AND s.us < end_us GROUP BY ALL)) GROUP BY ALL)""",
        STATIC_SQL,
    ),
)
def _static_windows_topk(spark, d):
    coarse = v.sensor(spark, d).withColumn("dv0", F.col("dv0") - F.col("dv0") % 5)
    return static.static_windows_topk(coarse, "dv0", 5 * DAY, DAY, expected=12).withColumns(
        {c: F.round(c, 6) for c in ("share_expected", "share_static")}
    )


# Stays: longer than 60 s, expected rate one record per 12 h, trust horizon one day.
# Slices of a day, because the test users have about two records per day.
STAY_ARGS = dict(hertz=1 / 43200, min_duration_s=60, horizon_us=DAY, tie=["event_id"], slice_us=DAY)
STAY_SQL = """p0 AS (SELECT *, CASE WHEN lag(place) OVER w = place THEN 0 ELSE 1 END AS n0 FROM place_series
    WINDOW w AS (PARTITION BY device ORDER BY us, event_id)),
  p1 AS (SELECT *, CAST(sum(n0) OVER (PARTITION BY device ORDER BY us, event_id) AS BIGINT) AS run,
    count(*) OVER (PARTITION BY device ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS nb,
    count(*) OVER (PARTITION BY device ORDER BY us RANGE BETWEEN CURRENT ROW AND 86399999999 FOLLOWING) AS na FROM p0),
  p2 AS (SELECT device, run, min(place) AS place, min(us) AS start_us, max(us) AS end_us, count(*) AS n_rows,
    (max(us) - min(us)) / 1000000.0::DOUBLE AS duration_s, arg_min(nb, us) AS nb, arg_max(na, us) AS na FROM p1 GROUP BY device, run),
  st AS (SELECT *, nb >= 1 AS start_trusted, na >= 1 AS end_trusted, row_number() OVER (PARTITION BY device ORDER BY start_us) AS stay_no
    FROM p2 WHERE duration_s > 60 AND n_rows >= floor(duration_s / 43200) * 0.5),
  sr AS (SELECT p1.*, st.stay_no AS stay, CAST(coalesce(p1.us = st.start_us, false) AS INTEGER) AS stay_first,
    CAST(coalesce(p1.us = st.end_us, false) AS INTEGER) AS stay_last,
    CASE WHEN p1.us = st.end_us THEN duration_s END AS stay_s,
    CAST(coalesce(p1.us = st.start_us AND start_trusted, false) AS INTEGER) AS stay_first_trusted,
    CAST(coalesce(p1.us = st.end_us AND end_trusted, false) AS INTEGER) AS stay_last_trusted,
    CASE WHEN p1.us = st.end_us AND start_trusted AND end_trusted THEN duration_s END AS stay_s_trusted,
    CASE WHEN start_trusted AND end_trusted THEN stay_no END AS stay_trusted
    FROM p1 LEFT JOIN st ON p1.device = st.device AND p1.run = st.run)"""


def stay_rows(spark, d):
    """Stay records, written once: the place features read them several times."""
    return materialize(stays.stay_records(v.place_series(spark, d), **STAY_ARGS), "stays")


@query(
    "stays",
    sql_with(
        "place_series",
        "SELECT device, run, place, start_us, end_us, n_rows, round(duration_s, 6) AS duration_s, start_trusted, end_trusted, stay_no FROM st",
        STAY_SQL,
    ),
)
def _stays(spark, d):
    return stays.stays(v.place_series(spark, d), **STAY_ARGS).withColumn("duration_s", F.round("duration_s", 6))


@query(
    "stay_records",
    sql_with(
        "place_series",
        """SELECT event_id, device, us, place, stay, stay_first, stay_last, round(stay_s, 6) AS stay_s, stay_first_trusted, stay_last_trusted,
        round(stay_s_trusted, 6) AS stay_s_trusted, stay_trusted FROM sr""",
        STAY_SQL,
    ),
)
def _stay_records(spark, d):
    return (
        stays.stay_records(v.place_series(spark, d), **STAY_ARGS)
        .drop("lat", "lon", "k", "accuracy", "chunk")
        .withColumns({c: F.round(c, 6) for c in ("stay_s", "stay_s_trusted")})
    )


@query(
    "sequence_windows",
    sql_with(
        "sensor",
        """SELECT device, s AS start_row, CAST(to_json(list([CAST(dv1 AS INTEGER), CAST(floor(accuracy) AS INTEGER)] ORDER BY i)) AS VARCHAR) AS sequence, min(lab) AS label FROM (
          SELECT n.*, s,
            (SELECT sensor FROM num m WHERE m.device = n.device AND m.i >= s AND m.i < s + 8 GROUP BY sensor ORDER BY count(*) DESC, sensor LIMIT 1) AS lab
          FROM num n JOIN (SELECT device, unnest(range(0, greatest(cnt - 8, 0), 4)) AS s FROM tot) st
            ON st.device = n.device AND n.i >= s AND n.i < s + 8) GROUP BY device, s""",
        """num AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY us, event_id) - 1 AS i FROM sensor),
        tot AS (SELECT device, count(*) AS cnt FROM sensor GROUP BY device)""",
    ),
)
def _sequence_windows(spark, d):
    rows = v.sensor(spark, d).withColumns(
        {"a": F.floor("dv1").cast("int"), "b": F.floor("accuracy").cast("int")}
    )
    out = segments.sequence_windows(rows, ["a", "b"], "sensor", 8, 4, tie=["event_id"])
    return out.select(
        "device",
        "start_row",
        F.to_json("sequence").alias("sequence"),
        F.col("sensor").alias("label"),
    )


@query(
    "modal_location",
    sql_with(
        "gps",
        """SELECT device, day, lat, lon, n FROM (SELECT *, row_number() OVER (PARTITION BY device, day ORDER BY n DESC, lat, lon) AS rn FROM
        (SELECT device, us // 86400000000 AS day, round(lat, 1) AS lat, round(lon, 1) AS lon, count(*) AS n FROM gps
         WHERE date_part('hour', make_timestamp(us)) >= 0 AND date_part('hour', make_timestamp(us)) < 6 GROUP BY ALL)) WHERE rn = 1""",
    ),
)
def _modal_location(spark, d):
    return segments.modal_location(v.gps(spark, d), 0, 6, decimals=1)
