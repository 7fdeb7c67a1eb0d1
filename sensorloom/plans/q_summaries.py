"""Queries: data quality, contingency tables and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.timefn import DAY, HOUR
from sensorloom.operators import asof, static, summaries
from sensorloom.plans import views as v
from sensorloom.plans.q_features import rounded
from sensorloom.plans.q_sources import joined, sql_joined
from sensorloom.plans.q_windows import MOVE_SQL, PERIOD_SQL, movement, windows_static
from sensorloom.plans.registry import query
from sensorloom.plans.views import sql_with


def _logged(spark, d):
    """All events as two recording databases; rows with k % 10 = 0 were stored twice in the first."""
    ev = v.ev(spark, d).select(
        F.when(F.col("event_id") % 2 == 0, "db0").otherwise("db1").alias("source"),
        F.col("event_type").alias("sensor"),
        "device",
        "us",
        "value",
        "k",
    )
    return ev.unionByName(ev.filter((F.col("k") % 10 == 0) & (F.col("source") == "db0"))).drop("k")


_LOG_SQL = """lg AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'db0' ELSE 'db1' END AS source, event_type AS sensor, device, us, value, k FROM ev),
  lg2 AS (SELECT source, sensor, device, us, value FROM lg UNION ALL SELECT source, sensor, device, us, value FROM lg WHERE k % 10 = 0 AND source = 'db0'),
  ss0 AS (SELECT source, sensor, device, count(*) - count(DISTINCT (us, value)) AS duplicates, count(DISTINCT (us, value)) AS entries,
    min(us) AS begin_us, max(us) AS end_us, (max(us) - min(us)) / 60000000.0::DOUBLE AS minutes FROM lg2 GROUP BY ALL),
  ss AS (SELECT source, sensor, device, duplicates, entries, begin_us, end_us, minutes, minutes * 60 * hz AS expected,
    CASE WHEN minutes * 60 * hz <> 0 THEN entries / (minutes * 60 * hz) END AS completeness FROM ss0 JOIN sensors USING (sensor))"""


def _sanity(spark, d):
    names = F.array(*[F.lit(s) for s in [*v.SENSOR_HZ, "gravity"]])
    grid = _logged(spark, d).select("source").distinct().withColumn("sensor", F.explode(names))
    return summaries.sensor_sanity(_logged(spark, d), v.sensors(spark), grid)


@query(
    "sensor_sanity",
    sql_with(
        "ev sensors",
        """SELECT source, sensor, device, duplicates, entries, begin_us, end_us, round(minutes, 4) AS minutes, round(expected, 4) AS expected,
        round(completeness, 4) AS completeness FROM ss UNION ALL SELECT s, 'gravity', -1, -1, -1, -1, -1, -1, -1, -1 FROM (VALUES ('db0'), ('db1')) t(s)""",
        _LOG_SQL,
    ),
)
def _sensor_sanity(spark, d):
    return rounded(_sanity(spark, d), 4)


_OVER_SQL = (
    _LOG_SQL
    + """, ov AS (SELECT u.device, s.sensor, s.hz, coalesce(duplicates, 0) AS duplicates, coalesce(entries, 0) AS entries, coalesce(begin_us, 0) AS begin_us,
    coalesce(end_us, 0) AS end_us, coalesce((end_us - begin_us) // 60000000, 0) AS minutes FROM (SELECT DISTINCT device FROM users) u CROSS JOIN sensors s
    LEFT JOIN (SELECT device, sensor, CAST(sum(duplicates) AS BIGINT) AS duplicates, CAST(sum(entries) AS BIGINT) AS entries, min(begin_us) AS begin_us,
      max(end_us) AS end_us FROM ss GROUP BY ALL) m ON m.device = u.device AND m.sensor = s.sensor)"""
)


@query(
    "sensor_overview",
    sql_with(
        "ev users sensors",
        """SELECT *, round(minutes * 60 * hz, 4) AS expected, CASE WHEN minutes * hz <> 0 THEN round(entries / (minutes * 60 * hz), 4) ELSE 0 END AS completeness FROM ov""",
        _OVER_SQL,
    ),
)
def _sensor_overview(spark, d):
    return rounded(summaries.sensor_overview(_sanity(spark, d), v.users(spark, d), v.sensors(spark)), 4, ("hz",))


@query(
    "overview_is_consistent",
    sql_with(
        "ev users sensors",
        """SELECT a AS n_recorded, b AS n_overview, a = b AS consistent FROM (SELECT count(DISTINCT (device, sensor)) AS a FROM ss),
        (SELECT count(*) AS b FROM ov WHERE entries > 0)""",
        _OVER_SQL,
    ),
)
def _overview_is_consistent(spark, d):
    sanity = _sanity(spark, d)
    overview = summaries.sensor_overview(sanity, v.users(spark, d), v.sensors(spark))
    return summaries.overview_is_consistent(sanity, overview)


_KINDS = ["view", "click", "signup"]
_VOL_SQL = f"""vol AS (SELECT e.device, e.event_us, coalesce(view, 0) AS view, coalesce(click, 0) AS click, coalesce(signup, 0) AS signup
  FROM (SELECT DISTINCT device, event_us FROM esm) e LEFT JOIN (SELECT device, event_us, count(*) FILTER (sensor = 'view' AND accuracy <= 100) AS view,
    count(*) FILTER (sensor = 'click') AS click, count(*) FILTER (sensor = 'signup') AS signup FROM j WHERE abs(us - event_us) <= {24 * HOUR} GROUP BY ALL) c
  USING (device, event_us))"""


def _volume(spark, d):
    return summaries.event_sensor_volume(
        v.esm(spark, d), joined(spark, d, 72), _KINDS, 24 * HOUR, {"view": F.col("accuracy") <= 100}
    )


@query("event_sensor_volume", sql_with("sensor esm", "SELECT * FROM vol", sql_joined(72) + ", " + _VOL_SQL))
def _event_sensor_volume(spark, d):
    return _volume(spark, d)


@query(
    "event_sensor_volume_total",
    sql_with(
        "sensor esm",
        "SELECT count(*) FILTER (view > 0) AS view, count(*) FILTER (click > 0) AS click, count(*) FILTER (signup > 0) AS signup FROM vol",
        sql_joined(72) + ", " + _VOL_SQL,
    ),
)
def _event_sensor_volume_total(spark, d):
    return summaries.event_sensor_volume_total(_volume(spark, d), _KINDS)


@query(
    "event_summary_stats",
    sql_with(
        "sensor esm",
        "SELECT device, event_us, count(*) AS n_rows, " + ", ".join(
            f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std" for c in ("dv0", "dv1", "dv2", "accuracy")
        ) + " FROM j GROUP BY device, event_us",
        sql_joined(72),
    ),
)
def _event_summary_stats(spark, d):
    wanted = {c: ["mean", "std"] for c in ("dv0", "dv1", "dv2", "accuracy")}
    return rounded(summaries.event_summary_stats(joined(spark, d, 72), wanted))


@query(
    "event_summary_stats_gps",
    sql_with(
        "gps esm",
        "SELECT device, event_us, count(*) AS n_rows, " + ", ".join(
            f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, round(max({c}), 6) AS {c}_max" for c in ("speed_kmh", "accel_kmhs")
        ) + " FROM mv GROUP BY device, event_us",
        MOVE_SQL,
    ),
)
def _event_summary_stats_gps(spark, d):
    wanted = {c: ["mean", "std", "max"] for c in ("speed_kmh", "accel_kmhs")}
    return rounded(summaries.event_summary_stats(movement(spark, d), wanted))


@query(
    "events_missing_data",
    sql_with(
        "sensor esm",
        "SELECT DISTINCT device, event_us FROM esm e WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.device = e.device AND j.event_us = e.event_us)",
        sql_joined(12),
    ),
)
def _events_missing_data(spark, d):
    return summaries.events_missing_data(v.esm(spark, d), joined(spark, d, 12))


@query(
    "event_trace",
    sql_with(
        "sensor esm",
        f"SELECT device, event_us, sensor, round((us - event_us) / 1000000.0::DOUBLE, 6) AS seconds, dv0 FROM j WHERE abs(us - event_us) <= {6 * HOUR}",
        sql_joined(12),
    ),
)
def _event_trace(spark, d):
    out = summaries.event_trace(joined(spark, d, 12), 6 * HOUR, ["sensor", "dv0"])
    return out.withColumn("seconds", F.round("seconds", 6))


_CL = v.CLASSES


@query(
    "user_class_counts",
    sql_with(
        "esm users",
        """SELECT t.device, c0, c1, c2, c3, c0 + c1 + c2 + c3 AS total, city FROM t LEFT JOIN (SELECT CAST(device AS VARCHAR) AS device, min(city) AS city FROM users GROUP BY 1) USING (device)""",
        """p AS (SELECT CAST(device AS VARCHAR) AS device, count(*) FILTER (label = 'c0') AS c0, count(*) FILTER (label = 'c1') AS c1,
          count(*) FILTER (label = 'c2') AS c2, count(*) FILTER (label = 'c3') AS c3 FROM esm GROUP BY device),
        t AS (SELECT * FROM p UNION ALL SELECT 'total', CAST(sum(c0) AS BIGINT), CAST(sum(c1) AS BIGINT), CAST(sum(c2) AS BIGINT), CAST(sum(c3) AS BIGINT) FROM p)""",
    ),
)
def _user_class_counts(spark, d):
    return summaries.user_class_counts(v.esm(spark, d), _CL, v.users(spark, d))


@query(
    "user_class_minutes",
    sql_with(
        "esm",
        """SELECT device, round(c0, 4) AS c0, round(c1, 4) AS c1, round(c2, 4) AS c2, round(c3, 4) AS c3, round(c0 + c1 + c2 + c3, 4) AS total FROM
        (SELECT * FROM p UNION ALL SELECT 'total', sum(c0), sum(c1), sum(c2), sum(c3) FROM p)""",
        "p AS (SELECT CAST(device AS VARCHAR) AS device, "
        + ", ".join(f"round(count(*) FILTER (label = '{c}') * (50 / 60.0::DOUBLE), 1) AS {c}" for c in _CL)
        + " FROM esm GROUP BY device)",
    ),
)
def _user_class_minutes(spark, d):
    return rounded(summaries.user_class_minutes(v.esm(spark, d), _CL, 50), 4)


@query(
    "contingency_margins",
    sql_with(
        "ev",
        'SELECT event_type, "0", "1", "2", "3", "4", "0" + "1" + "2" + "3" + "4" AS total FROM (SELECT * FROM p UNION ALL SELECT \'total\', '
        + ", ".join(f'CAST(sum("{i}") AS BIGINT)' for i in range(5)) + " FROM p)",
        "p AS (SELECT event_type, " + ", ".join(f'count(*) FILTER (k % 5 = {i}) AS "{i}"' for i in range(5)) + " FROM ev GROUP BY event_type)",
    ),
)
def _contingency_margins(spark, d):
    return summaries.contingency_margins(v.ev(spark, d).withColumn("m", F.col("k") % 5), "event_type", "m", range(5))


@query(
    "value_counts_topn",
    sql_with(
        "ev",
        """SELECT CAST(k AS VARCHAR) AS value, count(*) AS n, round(count(*) * 1.5::DOUBLE, 6) AS scaled FROM ev GROUP BY k HAVING count(*) > 10
        ORDER BY n DESC, value LIMIT 15""",
    ),
)
def _value_counts_topn(spark, d):
    return rounded(summaries.value_counts_topn(v.ev(spark, d), "k", 15, 1.5, 10))


@query(
    "answer_distribution",
    sql_with(
        "wifi",
        """SELECT question, CAST(sum(n) AS BIGINT) AS n_answers, CAST(coalesce(sum(n) FILTER (n > 100), 0) AS BIGINT) AS n_above,
        round(coalesce(sum(n) FILTER (n > 100), 0) / sum(n)::DOUBLE, 6) AS share_above FROM (
        SELECT 'bssid' AS question, bssid AS value, count(*) AS n FROM wifi WHERE bssid IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'device', CAST(device AS VARCHAR), count(*) FROM wifi GROUP BY ALL) GROUP BY question""",
    ),
)
def _answer_distribution(spark, d):
    return rounded(summaries.answer_distribution(v.wifi(spark, d), ["bssid", "device"], 100))


@query(
    "non_null_counts",
    sql_with("wifi", "SELECT 'bssid' AS \"column\", count(bssid) AS n_values FROM wifi UNION ALL SELECT 'device', count(device) FROM wifi"),
)
def _non_null_counts(spark, d):
    return summaries.non_null_counts(v.wifi(spark, d), ["bssid", "device"])


@query(
    "participant_overview",
    sql_with(
        "esm users",
        """SELECT new_id AS participant, city, CAST(sum(n) AS BIGINT) AS n_events, min(f) AS first_us, max(l) AS last_us, CAST(sum(l - f) AS BIGINT) AS duration_us,
        round(sum(l - f) / 3600000000.0::DOUBLE, 1) AS duration_hours, round(sum(l - f) / 3600000000.0::DOUBLE / 24, 1) AS duration_days
        FROM (SELECT device, count(*) AS n, min(event_us) AS f, max(event_us) AS l FROM esm GROUP BY device) JOIN users USING (device) GROUP BY new_id, city""",
    ),
)
def _participant_overview(spark, d):
    return summaries.participant_overview(v.esm(spark, d), v.users(spark, d))


_Q = ", ".join(f"round(quantile_cont({c}, 0.01), 6) AS {c}_01, round(quantile_cont({c}, 0.99), 6) AS {c}_99" for c in ("dv0", "dv2"))


@query("quantile_limits", sql_with("sensor", f"SELECT {_Q} FROM sensor"))
def _quantile_limits(spark, d):
    return rounded(summaries.quantile_limits(v.sensor(spark, d), ["dv0", "dv2"]))


@query("quantile_limits_per_event", sql_with("sensor esm", f"SELECT device, event_us, {_Q} FROM j GROUP BY device, event_us", sql_joined(72)))
def _quantile_limits_per_event(spark, d):
    return rounded(summaries.quantile_limits(joined(spark, d, 72), ["dv0", "dv2"], keys=("device", "event_us")))


@query(
    "point_occurrence",
    sql_with(
        "gps",
        "SELECT *, max(n) OVER () AS n_max FROM (SELECT round(lat, 2) AS lat, round(lon, 2) AS lon, count(*) AS n FROM gps GROUP BY 1, 2)",
    ),
)
def _point_occurrence(spark, d):
    return summaries.point_occurrence(v.gps(spark, d), "lat", "lon", 2)


@query(
    "static_start_histogram",
    sql_with("sensor", "SELECT CAST(date_part('hour', make_timestamp(start_us)) AS INTEGER) AS hour, count(*) AS n_periods FROM periods GROUP BY 1", PERIOD_SQL),
)
def _static_start_histogram(spark, d):
    return summaries.static_start_histogram(static.static_periods(windows_static(spark, d)))


_NEAR_SQL = f"""dist AS (SELECT e.device, e.event_us, e.label,
  (SELECT (p.start_us - e.event_us) / 60000000.0::DOUBLE FROM periods p WHERE p.device = e.device AND abs(p.start_us - e.event_us) < {4 * DAY}
    ORDER BY abs(p.start_us - e.event_us), p.start_us LIMIT 1) AS s,
  (SELECT (e.event_us - p.end_us) / 60000000.0::DOUBLE FROM periods p WHERE p.device = e.device AND abs(p.end_us - e.event_us) < {4 * DAY}
    ORDER BY abs(p.end_us - e.event_us), p.end_us LIMIT 1) AS n FROM esm e)"""


def _distances(spark, d):
    periods = static.static_periods(windows_static(spark, d)).select("device", "start_us", "end_us")
    events = v.esm(spark, d).select("device", F.col("event_us").alias("us"), "label")
    return asof.nearest_static_period(events, periods, 4 * DAY)


@query(
    "static_period_coverage",
    sql_with(
        "sensor esm",
        "SELECT label IN ('c0', 'c1') AS is_target, count(*) AS n_rows, round(avg(CASE WHEN s IS NOT NULL OR n IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS share_near FROM dist GROUP BY 1",
        PERIOD_SQL + ", " + _NEAR_SQL,
    ),
)
def _static_period_coverage(spark, d):
    return rounded(summaries.static_period_coverage(_distances(spark, d), ["c0", "c1"]))


@query(
    "static_distance_histogram",
    sql_with(
        "sensor esm",
        "SELECT CAST(floor((s + 5760) / 480) * 480 - 5760 AS BIGINT) AS bin_start, count(*) AS n FROM dist WHERE s >= -5760 AND s < 5760 GROUP BY 1",
        PERIOD_SQL + ", " + _NEAR_SQL,
    ),
)
def _static_distance_histogram(spark, d):
    return summaries.distance_histogram(_distances(spark, d), "static_start_minutes", -5760, 5760, 480)


@query(
    "days_with_data",
    sql_with(
        "gps",
        "SELECT device, count(*) FILTER (n >= 3) AS n_days FROM (SELECT device, us // 86400000000 AS dy, count(*) AS n FROM gps GROUP BY ALL) GROUP BY device",
    ),
)
def _days_with_data(spark, d):
    return summaries.days_with_data(v.gps(spark, d), 3)


@query(
    "clusters_for_coverage",
    sql_with(
        "gps",
        """SELECT device, count(*) AS n_places, count(*) FILTER (coalesce(bf, 0) < tot * 0.9::DOUBLE) AS n_for_coverage, count(*) FILTER (n > 4) AS n_big FROM (
        SELECT *, sum(n) OVER (PARTITION BY device ORDER BY n DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf, sum(n) OVER (PARTITION BY device) AS tot
        FROM (SELECT device, k // 4 AS place, count(*) AS n FROM gps GROUP BY ALL)) GROUP BY device""",
    ),
)
def _clusters_for_coverage(spark, d):
    rows = v.gps(spark, d).withColumn("place", F.expr("k div 4"))
    return summaries.clusters_for_coverage(rows, 0.9, 4)


@query(
    "column_profile",
    sql_with(
        "sensor",
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, "
            f"round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM sensor"
            for c in ("dv0", "dv1", "dv2")
        ),
    ),
)
def _column_profile(spark, d):
    return rounded(summaries.column_profile(v.sensor(spark, d), ["dv0", "dv1", "dv2"]))
