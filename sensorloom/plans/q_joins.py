"""Queries: interval, as-of, session and nearest-place joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.timefn import DAY, HOUR, MINUTE
from sensorloom.operators import asof, nearplaces, ranges, static
from sensorloom.plans import views as v
from sensorloom.plans.q_sources import joined, sql_joined
from sensorloom.plans.q_windows import PERIOD_SQL, windows_static
from sensorloom.plans.registry import query
from sensorloom.plans.views import sql_haversine_m, sql_with


@query(
    "event_window_join",
    sql_with("sensor esm", "SELECT event_id, device, sensor, us, event_us, label FROM j", sql_joined(12)),
)
def _event_window_join(spark, d):
    return joined(spark, d, 12).select("event_id", "device", "sensor", "us", "event_us", "label")


@query(
    "event_completeness",
    sql_with(
        "sensor esm",
        """SELECT e.device, e.event_us, coalesce(n, 0) AS found, round(coalesce(n, 0) / 3.0::DOUBLE, 6) AS fraction,
        coalesce(n, 0) / 3.0::DOUBLE <= 0.9 AS is_partial FROM (SELECT DISTINCT device, event_us FROM esm) e
        LEFT JOIN (SELECT device, event_us, count(*) AS n FROM j GROUP BY ALL) c USING (device, event_us)""",
        sql_joined(12),
    ),
)
def _event_completeness(spark, d):
    out = ranges.event_completeness(v.esm(spark, d), joined(spark, d, 12), 3)
    return out.withColumn("fraction", F.round("fraction", 6))


@query(
    "first_complete_source",
    sql_with(
        "sensor esm",
        """SELECT event_id, device, event_us, source_rank FROM jr JOIN (
          SELECT device, event_us, source_rank, max(n) OVER (PARTITION BY device, event_us ORDER BY source_rank
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / 2.0::DOUBLE AS done
          FROM (SELECT device, event_us, source_rank, count(*) AS n FROM jr GROUP BY ALL)) c
        USING (device, event_us, source_rank) WHERE done IS NULL OR done <= 0.9""",
        sql_joined(72) + ", jr AS (SELECT *, CASE sensor WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS source_rank FROM j)",
    ),
)
def _first_complete_source(spark, d):
    rank = F.when(F.col("sensor") == "view", 0).when(F.col("sensor") == "click", 1).otherwise(2)
    rows = joined(spark, d, 72).withColumn("source_rank", rank)
    return ranges.first_complete_source(rows, 2).select("event_id", "device", "event_us", "source_rank")


# Base rows lack an event time for every fifth k, so the merge has to restore it.
def _with_event(frame, every: int):
    day_start = F.col("us") - F.pmod("us", F.lit(DAY))
    return frame.withColumn("event_us", F.when(F.col("dv1") % every != 0, day_start)).select(
        "event_id", "device", "us", "event_us", "dv0"
    )


def _sql_side(name: str, every: int) -> str:
    return (
        f"{name}_s AS (SELECT event_id, device, us, CASE WHEN CAST(dv1 AS BIGINT) % {every} <> 0 THEN us - us % {DAY} END AS event_us, dv0 "
        f"FROM sensor WHERE sensor = '{name}')"
    )


def _sql_merge(left: str, right: str, prefix: str, tol: int, cols: str, out: str) -> str:
    """Full-outer nearest merge by brute force: all pairs within the tolerance, ranked."""
    nulls = ", ".join(f"NULL AS {c}" for c in cols.split(", "))
    return f"""{out}_c AS (SELECT l.*, r.us AS rus, r.dv0 AS rdv0, r.event_us AS rev, row_number() OVER (PARTITION BY l.device, l.us, l.event_id, l.dv0
      ORDER BY abs(r.us - l.us), r.us) AS rn FROM {left} l LEFT JOIN {right} r ON l.device = r.device AND abs(r.us - l.us) <= {tol}),
    {out} AS (SELECT {cols}, device, us, coalesce(event_us, rev) AS event_us, rus AS {prefix}timestamp_merged, rdv0 AS {prefix}dv0 FROM {out}_c WHERE rn = 1
      UNION ALL SELECT {nulls}, device, us, event_us, us, dv0 FROM {right} r
      WHERE NOT EXISTS (SELECT 1 FROM {out}_c c WHERE c.rn = 1 AND c.device = r.device AND c.rus = r.us))"""


@query(
    "asof_nearest_merge",
    sql_with(
        "sensor",
        "SELECT * FROM m1",
        _sql_side("view", 5) + ", " + _sql_side("click", 7) + ", "
        + _sql_merge("view_s", "click_s", "cli_", 6 * HOUR, "event_id, dv0", "m1"),
    ),
)
def _asof_nearest_merge(spark, d):
    left = _with_event(v.one_sensor(spark, d, "view"), 5)
    right = _with_event(v.one_sensor(spark, d, "click"), 7)
    return asof.asof_nearest_merge(left, right, ["dv0"], 6 * HOUR, "cli_")


@query(
    "asof_multi_sensor_merge",
    sql_with(
        "sensor",
        "SELECT * FROM m2",
        ", ".join([_sql_side("view", 5), _sql_side("click", 7), _sql_side("signup", 9)])
        + ", "
        + _sql_merge("view_s", "click_s", "cli_", 6 * HOUR, "event_id, dv0", "m1")
        + ", "
        + _sql_merge("m1", "signup_s", "sig_", 6 * HOUR, "event_id, dv0, cli_timestamp_merged, cli_dv0", "m2"),
    ),
)
def _asof_multi_sensor_merge(spark, d):
    frames = {n: _with_event(v.one_sensor(spark, d, n), e) for n, e in (("view", 5), ("click", 7), ("signup", 9))}
    return asof.asof_multi_sensor_merge(
        frames["view"], [("cli_", frames["click"], ["dv0"]), ("sig_", frames["signup"], ["dv0"])], 6 * HOUR
    )


@query(
    "asof_backward",
    sql_with(
        "sensor esm",
        f"""SELECT l.event_id, l.device, l.event_us, l.us, max(r.us) AS matched_us, arg_max(r.dv0, r.us) AS dv0 FROM
        (SELECT * FROM j WHERE sensor = 'view') l LEFT JOIN (SELECT * FROM j WHERE sensor = 'click') r
        ON l.device = r.device AND l.event_us = r.event_us AND r.us BETWEEN l.us - {24 * HOUR} AND l.us GROUP BY ALL""",
        sql_joined(72),
    ),
)
def _asof_backward(spark, d):
    rows = joined(spark, d, 72)
    left = rows.filter("sensor = 'view'").select("event_id", "device", "event_us", "us")
    return asof.asof_backward(left, rows.filter("sensor = 'click'"), ["dv0"], 24 * HOUR)


def session_frame(spark, d):
    """Events with an answer time for even k, and their session bounds."""
    events = v.esm(spark, d).select(
        "event_id", "device", "event_us", F.when(F.col("k") % 2 == 0, F.col("event_us") + F.col("k") * MINUTE).alias("answer_us")
    )
    return asof.session_bounds(events, v.screen(spark, d), answer_us="answer_us")


SESSION_SQL = f"""ea AS (SELECT event_id, device, event_us, CASE WHEN k % 2 = 0 THEN event_us + k * {MINUTE} END AS answer_us FROM esm),
  ses0 AS (SELECT ea.*, (SELECT max(us) FROM screen s WHERE s.device = ea.device AND status = 3 AND us <= coalesce(answer_us, event_us)) AS session_start,
    (SELECT min(us) FROM screen s WHERE s.device = ea.device AND status = 3 AND us >= coalesce(answer_us, event_us)) AS session_end FROM ea),
  ses AS (SELECT *, (session_end - session_start) / 1000000.0::DOUBLE AS session_s FROM ses0)"""


@query(
    "session_bounds",
    sql_with(
        "esm screen",
        "SELECT event_id, device, event_us, answer_us, session_start, session_end, round(session_s, 3) AS session_s FROM ses",
        SESSION_SQL,
    ),
)
def _session_bounds(spark, d):
    return session_frame(spark, d).withColumn("session_s", F.round("session_s", 3))


_CLIP_SQL = f"""cj AS (SELECT j.*, session_start, session_end, j.us BETWEEN session_start AND session_end AS inside,
    (session_start IS NULL OR session_end IS NULL) OR (j.event_us - session_start >= {72 * HOUR} AND session_end - j.event_us >= {72 * HOUR}) AS untouched
    FROM j LEFT JOIN ses USING (device, event_us))"""


@query(
    "clip_to_session",
    sql_with(
        "sensor esm screen",
        "SELECT event_id, device, event_us, us FROM cj WHERE untouched OR inside",
        ", ".join([sql_joined(72), SESSION_SQL, _CLIP_SQL]),
    ),
)
def _clip_to_session(spark, d):
    return asof.clip_to_session(joined(spark, d, 72), session_frame(spark, d), 72 * HOUR).select(
        "event_id", "device", "event_us", "us"
    )


@query(
    "clip_report",
    sql_with(
        "sensor esm screen",
        f"""SELECT device, event_us, n_rows, n_deleted, round(x, 6) AS expected_deleted,
          CASE WHEN x <> 0 THEN round(n_deleted / x * 100, 4) END AS percent_of_expected FROM (
          SELECT device, event_us, count(*) AS n_rows, count(*) FILTER (NOT inside) AS n_deleted,
            ({144 * HOUR} - least(event_us - session_start, {72 * HOUR}) - least(session_end - event_us, {72 * HOUR})) / 1000000.0::DOUBLE * 0.00001::DOUBLE AS x
          FROM cj WHERE NOT untouched GROUP BY device, event_us, session_start, session_end)""",
        ", ".join([sql_joined(72), SESSION_SQL, _CLIP_SQL]),
    ),
)
def _clip_report(spark, d):
    out = asof.clip_report(joined(spark, d, 72), session_frame(spark, d), 0.00001, 72 * HOUR)
    return out.withColumns(
        {"expected_deleted": F.round("expected_deleted", 6), "percent_of_expected": F.round("percent_of_expected", 4)}
    )


@query(
    "label_lookup",
    sql_with(
        "sensor esm",
        """SELECT j.event_id, j.device, j.event_us, l.motion FROM j LEFT JOIN (SELECT device, event_us, 'm' || label AS motion FROM esm
        WHERE label <> 'c1') l USING (device, event_us)""",
        sql_joined(12),
    ),
)
def _label_lookup(spark, d):
    labels = v.esm(spark, d).filter("label <> 'c1'").withColumn("motion", F.concat(F.lit("m"), "label"))
    return asof.label_lookup(joined(spark, d, 12).select("event_id", "device", "event_us"), labels, ["motion"])


@query(
    "interval_label",
    sql_with(
        "sensor lab_session",
        """SELECT event_id, device, us, substr(label, 4) AS label FROM (SELECT s.event_id, s.device, s.us, l.label,
        row_number() OVER (PARTITION BY event_id ORDER BY priority DESC) AS rn
        FROM sensor s JOIN wide l ON s.us BETWEEN l.start_us AND l.end_us) WHERE rn = 1""",
        f"wide AS (SELECT priority, label, start_us, end_us + {18 * HOUR} AS end_us FROM lab_session)",
    ),
)
def _interval_label(spark, d):
    # Sessions stretched by 18 h so that neighbours overlap and the later one has to win.
    wide = v.lab_session(spark, d).withColumn("end_us", F.col("end_us") + 18 * HOUR)
    return ranges.interval_label(v.sensor(spark, d), wide).select("event_id", "device", "us", "label")


def _sql_nearest_end(col: str, sign: str, limit: int) -> str:
    return (
        f"(SELECT {sign} FROM periods p WHERE p.device = e.device AND abs(p.{col} - e.us) < {limit} "
        f"ORDER BY abs(p.{col} - e.us), p.{col} LIMIT 1)"
    )


@query(
    "nearest_static_period",
    sql_with(
        "sensor",
        f"""SELECT e.event_id, e.device, e.us, round({_sql_nearest_end('start_us', '(p.start_us - e.us) / 60000000.0::DOUBLE', 4 * DAY)}, 6) AS static_start_minutes,
        round({_sql_nearest_end('end_us', '(e.us - p.end_us) / 60000000.0::DOUBLE', 4 * DAY)}, 6) AS static_end_minutes FROM sensor e""",
        PERIOD_SQL,
    ),
)
def _nearest_static_period(spark, d):
    periods = static.static_periods(windows_static(spark, d)).select("device", "start_us", "end_us")
    rows = v.sensor(spark, d).select("event_id", "device", "us")
    out = asof.nearest_static_period(rows, periods, 4 * DAY)
    return out.withColumns(
        {c: F.round(c, 6) for c in ("static_start_minutes", "static_end_minutes")}
    )


@query(
    "nearest_fix_asymmetric",
    sql_with(
        "sensor gps",
        f"""SELECT l.event_id, l.device, l.us, arg_min(r.us, (abs(r.us - l.us), r.us)) AS matched_us, round(arg_min(r.lat, (abs(r.us - l.us), r.us)), 6) AS lat
        FROM (SELECT * FROM sensor WHERE sensor = 'view') l LEFT JOIN (SELECT * FROM gps WHERE k % 2 = 0) r
        ON l.device = r.device AND r.us BETWEEN l.us - {3 * HOUR} AND l.us + {6 * HOUR} GROUP BY ALL""",
    ),
)
def _nearest_fix_asymmetric(spark, d):
    left = v.one_sensor(spark, d, "view").select("event_id", "device", "us")
    right = v.gps(spark, d).filter(F.col("k") % 2 == 0)
    out = asof.asof_nearest(left, right, ["lat"], 3 * HOUR, 6 * HOUR, tie=["event_id"])
    return out.withColumn("lat", F.round("lat", 6))


@query(
    "first_after_event",
    sql_with(
        "sensor esm",
        """SELECT device, event_us, min(us) AS us, arg_min(event_id, us) AS event_id FROM j WHERE us >= event_us GROUP BY ALL""",
        sql_joined(72),
    ),
)
def _first_after_event(spark, d):
    rows = joined(spark, d, 72).select("event_id", "device", "event_us", "us")
    return asof.first_after_event(rows, tie=["event_id"])


@query(
    "nearest_to_event",
    sql_with(
        "sensor esm",
        """SELECT device, event_us, us, event_id, strftime(make_timestamp(event_us), '%Y-%m-%d') AS event_date,
        strftime(make_timestamp(event_us), '%H:%M:%S') AS event_time FROM j WHERE label <> 'c3'
        QUALIFY row_number() OVER (PARTITION BY device, event_us ORDER BY abs(us - event_us), us) = 1""",
        sql_joined(72),
    ),
)
def _nearest_to_event(spark, d):
    rows = joined(spark, d, 72).withColumn("label", F.when(F.col("label") != "c3", F.col("label")))
    slim = rows.select("event_id", "device", "event_us", "us", "label")
    return asof.nearest_to_event(slim, tie=["event_id"], label="label").drop("label")


CENTROID_SQL = "pl AS (SELECT device, 'p' || CAST(place AS VARCHAR) AS place, place AS priority, avg(lat) AS plat, avg(lon) AS plon FROM place_series GROUP BY device, place)"


def centroids(spark, d, condition: str = "true"):
    return (
        v.place_series(spark, d)
        .filter(condition)
        .groupBy("device", "place")
        .agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
        .select(
            "device", F.concat(F.lit("p"), F.col("place").cast("string")).alias("place"), F.col("place").alias("priority"), "lat", "lon"
        )
    )


_D = sql_haversine_m("g.lat", "g.lon", "plat", "plon")


@query(
    "nearest_place_2",
    sql_with(
        "place_series",
        """SELECT event_id, max(CASE WHEN rn = 1 THEN place END) AS place, round(max(CASE WHEN rn = 1 THEN m END), 3) AS place_m,
        max(CASE WHEN rn = 2 THEN place END) AS second_place, round(max(CASE WHEN rn = 2 THEN m END), 3) AS second_place_m FROM r GROUP BY event_id""",
        CENTROID_SQL
        + f""", r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY m, place) AS rn FROM
          (SELECT g.event_id, pl.place, {_D} AS m FROM gps g JOIN pl ON pl.device = g.device))""",
    ),
)
def _nearest_place_2(spark, d):
    out = nearplaces.nearest_place_2(v.gps(spark, d).select("event_id", "device", "lat", "lon"), centroids(spark, d))
    return out.select(
        "event_id", "place", F.round("place_m", 3).alias("place_m"), "second_place", F.round("second_place_m", 3).alias("second_place_m")
    )


_PART = "SELECT device, 'p' || CAST(place AS VARCHAR) AS place, avg(lat) AS plat, avg(lon) AS plon FROM place_series WHERE {} GROUP BY device, place"
_HOUR = "date_part('hour', make_timestamp(us))"


@query(
    "distance_to_frequent_places",
    sql_with(
        "place_series",
        f"""SELECT event_id, round((SELECT min({_D}) FROM dayp p WHERE p.device = g.device), 3) AS frequent_day_m,
        round((SELECT min({_D}) FROM nightp p WHERE p.device = g.device), 3) AS frequent_night_m FROM gps g""",
        f"dayp AS ({_PART.format(f'{_HOUR} >= 9 AND {_HOUR} < 18')}), nightp AS ({_PART.format(f'{_HOUR} < 6')})",
    ),
)
def _distance_to_frequent_places(spark, d):
    hour = "hour(timestamp_micros(us))"
    day = centroids(spark, d, f"{hour} >= 9 AND {hour} < 18")
    night = centroids(spark, d, f"{hour} < 6")
    fixes = v.gps(spark, d).select("event_id", "device", "lat", "lon")
    return nearplaces.distance_to_frequent_places(fixes, day, night).select(
        "event_id", F.round("frequent_day_m", 3).alias("frequent_day_m"), F.round("frequent_night_m", 3).alias("frequent_night_m")
    )


@query(
    "label_by_place_distance",
    sql_with(
        "place_series",
        """SELECT g.event_id, CASE WHEN g.device % 11 = 0 THEN NULL ELSE coalesce(h.place, 'other') END AS place_label,
        CASE WHEN g.device % 11 <> 0 THEN round(h.m, 3) END AS place_label_m FROM gps g LEFT JOIN
        (SELECT event_id, arg_min(place, priority) AS place, arg_min(m, priority) AS m FROM r WHERE m < 4000 GROUP BY event_id) h USING (event_id)""",
        CENTROID_SQL + f", r AS (SELECT g.event_id, pl.place, pl.priority, {_D} AS m FROM gps g JOIN pl ON pl.device = g.device)",
    ),
)
def _label_by_place_distance(spark, d):
    fixes = v.gps(spark, d).select("event_id", "device", "lat", "lon")
    out = nearplaces.label_by_place_distance(fixes, centroids(spark, d), 4000, skip=F.col("device") % 11 == 0)
    return out.select("event_id", "place_label", F.round("place_label_m", 3).alias("place_label_m"))


@query(
    "feature_rejoin",
    sql_with("sensor", "SELECT a.event_id, a.device, a.us, a.dv2 FROM sensor a WHERE sensor = 'view' AND dv1 >= 50"),
)
def _feature_rejoin(spark, d):
    rows = v.one_sensor(spark, d, "view").select("event_id", "device", "us")
    features = v.sensor(spark, d).filter(F.col("dv1") >= 50)
    return asof.feature_rejoin(rows, features, ["dv2"])
