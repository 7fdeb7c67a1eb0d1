"""Queries: sources, identity, time and scalar functions, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions import scalars, timefn
from sensorloom.functions.geo import geodesic_m, haversine_km
from sensorloom.functions.timefn import DAY, HOUR, MINUTE
from sensorloom.operators import filters, identity, ranges
from sensorloom.plans import views as v
from sensorloom.plans.registry import query
from sensorloom.plans.views import sql_haversine_m, sql_with
from sensorloom.session import scratch_path
from sensorloom.sources import files, json_payload


def _raw_log(spark, d):
    return v.ev(spark, d).select(
        F.col("event_id").alias("id"),
        F.expr("us div 1000").cast("double").alias("ts_ms"),
        F.col("device").cast("string").alias("device"),
        F.col("props").alias("payload"),
        "event_type",
        "k",
    )


@query(
    "union_sensor_files",
    sql_with(
        "ev",
        """SELECT event_id AS id, CAST(us // 1000 AS DOUBLE) AS ts_ms, CAST(device AS VARCHAR) AS device, props AS payload, source
        FROM (SELECT *, 'db0' AS source FROM ev WHERE event_type = 'view' AND (event_id % 2 = 0 OR k % 10 = 0)
        UNION ALL SELECT *, 'db1' AS source FROM ev WHERE event_type = 'view' AND (event_id % 2 = 1 OR k % 10 = 0))""",
    ),
)
def _union_sensor_files(spark, d):
    root = scratch_path(spark, "sensor-files")
    log = _raw_log(spark, d)
    for part in (0, 1):
        half = log.filter((F.col("id") % 2 == part) | (F.col("k") % 10 == 0))
        for kind in ("view", "click"):
            half.filter(F.col("event_type") == kind).select("id", "ts_ms", "device", "payload").write.option(
                "header", True
            ).option("escape", '"').csv(f"{root}/db{part}/{kind}.csv")
    return files.union_sensor_files(spark, root, "view")


@query(
    "union_sensor_files_dedupe",
    sql_with(
        "ev",
        """SELECT DISTINCT event_id AS id, CAST(us // 1000 AS DOUBLE) AS ts_ms, CAST(device AS VARCHAR) AS device, props AS payload
        FROM ev WHERE event_type = 'click' AND device = 3""",
    ),
)
def _union_sensor_files_dedupe(spark, d):
    root = scratch_path(spark, "sensor-files")
    log = _raw_log(spark, d).filter(F.col("event_type") == "click").select("id", "ts_ms", "device", "payload")
    for part in ("db0", "db1"):
        log.write.option("header", True).option("escape", '"').csv(f"{root}/{part}/click_S1.csv")
    return files.union_sensor_files(spark, root, "click", suffix="_S1", device="3", dedupe=True).drop("source")


@query(
    "read_ragged_csv",
    sql_with(
        "ev",
        """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CASE WHEN k % 7 = 0 THEN CAST(device AS VARCHAR) END AS extra_1,
        CASE WHEN k % 14 = 0 THEN CAST(k AS VARCHAR) END AS extra_2 FROM ev""",
    ),
)
def _read_ragged_csv(spark, d):
    path = scratch_path(spark, "ragged")
    line = F.concat_ws(
        ",",
        F.col("event_id").cast("string"),
        "event_type",
        F.when(F.col("k") % 7 == 0, F.col("device").cast("string")),
        F.when(F.col("k") % 14 == 0, F.col("k").cast("string")),
    )
    v.ev(spark, d).select(line.alias("event_id,event_type")).write.option("header", True).option("sep", "\x01").option(
        "quote", "\x00"
    ).csv(path)
    return files.read_ragged_csv(spark, path)


@query("write_partitioned", sql_with("ev sensor", "SELECT event_id, device, sensor, us, dv0 FROM sensor"))
def _write_partitioned(spark, d):
    path = scratch_path(spark, "by-device")
    rows = v.sensor(spark, d).select("event_id", "device", "sensor", "us", "dv0")
    files.write_partitioned(rows, path)
    return files.read_partitioned(spark, path, rows.schema)


@query(
    "harmonize_columns",
    sql_with("ev sensor", "SELECT device AS device_id, us AS timestamp, dv0 AS double_values_0, accuracy FROM sensor"),
)
def _harmonize_columns(spark, d):
    odd = v.sensor(spark, d).select(
        F.col("event_id").alias("Unnamed: 0"),
        F.col("device").alias("acc_device_id"),
        F.col("us").alias("sensor_timestamp"),
        F.col("dv0").alias("acc_double_values_0"),
        F.col("accuracy").alias("acc_accuracy"),
    )
    return files.harmonize_columns(
        odd,
        [("device_id", "device_id"), ("timestamp", "timestamp"), ("double_values_0", "double_values_0"), ("accuracy", "accuracy")],
    )


@query("json_expand", sql_with("ev", "SELECT event_id AS id, device, us, k AS vie_raw_k FROM ev"))
def _json_expand(spark, d):
    log = v.ev(spark, d).select(F.col("event_id").alias("id"), "device", "us", F.col("props").alias("payload"))
    return json_payload.json_expand(log, "view_raw", "k long")


@query("json_expand_discovered", sql_with("ev", "SELECT event_id AS id, device, CAST(k AS VARCHAR) AS cli_k FROM ev"))
def _json_expand_discovered(spark, d):
    log = v.ev(spark, d).select(F.col("event_id").alias("id"), "device", F.col("props").alias("payload"))
    return json_payload.json_expand_discovered(log, "click")


@query(
    "json_pack",
    sql_with(
        "ev sensor",
        """SELECT row_number() OVER (ORDER BY us, device, event_id) - 1 AS id, us // 1000 AS ts_ms, device,
        '{"sensor":"' || sensor || '","event_id":' || CAST(event_id AS VARCHAR) || '}' AS payload FROM sensor""",
    ),
)
def _json_pack(spark, d):
    return json_payload.json_pack(v.sensor(spark, d), ["sensor", "event_id"], tie=["event_id"])


# --- identity, time, scalars ------------------------------------------------------------------


@query(
    "unix_to_ts",
    sql_with(
        "ev",
        """SELECT event_id, make_timestamp((us // 1000) * 1000) AS ts, make_timestamp((us // 1000) * 1000 + 3600000000) AS ts_lab FROM ev""",
    ),
)
def _unix_to_ts(spark, d):
    ms = F.expr("us div 1000").cast("double")
    return v.ev(spark, d).select(
        "event_id",
        timefn.from_epoch_ms(ms).cast("timestamp_ntz").alias("ts"),
        timefn.from_epoch_ms(ms, 1).cast("timestamp_ntz").alias("ts_lab"),
    )


@query(
    "local_timestamp",
    sql_with(
        "ev users",
        """SELECT event_id, device, us, epoch_us(timezone(timezone, to_timestamp(us / 1000000.0))) AS local_us
        FROM ev JOIN users USING (device)""",
    ).replace("to_timestamp(us / 1000000.0)", "timezone('UTC', make_timestamp(us))"),
)
def _local_timestamp(spark, d):
    return identity.local_timestamp(v.ev(spark, d).select("event_id", "device", "us"), v.users(spark, d))


@query(
    "merge_participant_ids",
    sql_with("ev users", "SELECT event_id, new_id AS device, city FROM ev JOIN users USING (device)"),
)
def _merge_participant_ids(spark, d):
    return identity.merge_participant_ids(v.ev(spark, d).select("event_id", "device"), v.users(spark, d), with_city=True)


_CAL = """SELECT event_id, CAST(isodow - 1 AS INTEGER) AS weekday, CASE WHEN isodow >= 6 THEN 'weekend' ELSE 'weekday' END AS day_kind, h AS hour,
  CASE WHEN h < 6 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day
  FROM (SELECT event_id, date_part('isodow', make_timestamp(us)) AS isodow, CAST(date_part('hour', make_timestamp(us)) AS INTEGER) AS h FROM ev)"""


@query("calendar_features", sql_with("ev", _CAL))
def _calendar_features(spark, d):
    hour, weekday = timefn.hour_of(F.col("us")), timefn.weekday_of(F.col("us"))
    return v.ev(spark, d).select(
        "event_id",
        weekday.alias("weekday"),
        timefn.day_kind(weekday).alias("day_kind"),
        hour.alias("hour"),
        timefn.time_of_day(hour).alias("time_of_day"),
    )


@query(
    "decimal_hour",
    sql_with(
        "ev",
        """SELECT event_id, round(date_part('hour', t) + date_part('minute', t) / 60.0::DOUBLE, 6) AS decimal_hour,
        round(date_part('hour', t) + date_part('minute', t) / 60.0::DOUBLE, 6) AS from_text
        FROM (SELECT event_id, make_timestamp(us) AS t FROM ev)""",
    ),
)
def _decimal_hour(spark, d):
    text = F.date_format(F.timestamp_micros("us"), "HH:mm")
    return v.ev(spark, d).select(
        "event_id",
        F.round(timefn.decimal_hour(F.col("us")), 6).alias("decimal_hour"),
        F.round(timefn.decimal_hour_of_text(text), 6).alias("from_text"),
    )


@query(
    "answer_duration",
    sql_with(
        "esm",
        """SELECT event_id, device, round((k * 10 - value) , 6) AS duration_s FROM
        (SELECT event_id, device, k, value, k * 10 - value AS dur FROM esm) WHERE dur < 300""",
    ),
)
def _answer_duration(spark, d):
    # First answer `value` seconds and last answer 10·k seconds after the event.
    events = v.esm(spark, d)
    duration = F.col("k") * 10 - F.col("value")
    return (
        events.withColumn("duration_s", duration)
        .filter(F.col("duration_s") < 300)
        .select("event_id", "device", F.round("duration_s", 6).alias("duration_s"))
    )


@query(
    "haversine",
    sql_with(
        "gps",
        f"SELECT event_id, round({sql_haversine_m('lat', 'lon', '50.0', '8.0')} / 1000, 6) AS km FROM gps",
    ),
)
def _haversine(spark, d):
    return v.gps(spark, d).select(
        "event_id", F.round(haversine_km(F.col("lat"), F.col("lon"), F.lit(50.0), F.lit(8.0)), 6).alias("km")
    )


def _sql_vincenty(steps: int = 12) -> str:
    """Vincenty's inverse formula unrolled into a chain of table expressions, from (lat, lon) to (50, 8)."""
    f, a, b = "(1 / 298.257223563::DOUBLE)", "6378137.0::DOUBLE", "(6378137.0::DOUBLE * (1 - 1 / 298.257223563::DOUBLE))"
    out = [
        f"v0 AS (SELECT event_id, sin(atan((1 - {f}) * tan(radians(lat)))) AS s1, cos(atan((1 - {f}) * tan(radians(lat)))) AS c1, "
        f"sin(atan((1 - {f}) * tan(radians(50.0::DOUBLE)))) AS s2, cos(atan((1 - {f}) * tan(radians(50.0::DOUBLE)))) AS c2, "
        f"radians(8.0::DOUBLE - lon) AS l, radians(8.0::DOUBLE - lon) AS lam FROM gps)"
    ]
    for i in range(1, steps + 2):
        out.append(
            f"a{i} AS (SELECT *, sqrt(power(c2 * sin(lam), 2) + power(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss, "
            f"s1 * s2 + c1 * c2 * cos(lam) AS cs FROM v{i - 1})"
        )
        out.append(
            f"b{i} AS (SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss = 0 THEN 0 ELSE c1 * c2 * sin(lam) / ss END AS sa FROM a{i})"
        )
        out.append(
            f"d{i} AS (SELECT *, cs - CASE WHEN 1 - sa * sa = 0 THEN 0 ELSE 2 * s1 * s2 / (1 - sa * sa) END AS cm, "
            f"{f} / 16 * (1 - sa * sa) * (4 + {f} * (4 - 3 * (1 - sa * sa))) AS cc FROM b{i})"
        )
        out.append(
            f"v{i} AS (SELECT event_id, s1, c1, s2, c2, l, l + (1 - cc) * {f} * sa * "
            f"(sg + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) AS lam FROM d{i})"
        )
    last = steps + 1
    usq = f"((1 - sa * sa) * ({a} * {a} - {b} * {b}) / ({b} * {b}))"
    out.append(
        f"w AS (SELECT *, 1 + {usq} / 16384 * (4096 + {usq} * (-768 + {usq} * (320 - 175 * {usq}))) AS ba, "
        f"{usq} / 1024 * (256 + {usq} * (-128 + {usq} * (74 - 47 * {usq}))) AS bb FROM d{last})"
    )
    body = (
        f"SELECT event_id, round({b} * ba * (sg - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * "
        f"(4 * ss * ss - 3) * (4 * cm * cm - 3)))), 3) AS metres FROM w"
    )
    return sql_with("gps", body, ",\n".join(out))


@query("geodesic", _sql_vincenty())
def _geodesic(spark, d):
    return v.gps(spark, d).select(
        "event_id", F.round(geodesic_m(F.col("lat"), F.col("lon"), F.lit(50.0), F.lit(8.0)), 3).alias("metres")
    )


@query(
    "remap_values",
    sql_with(
        "ev",
        """SELECT event_id, CASE event_type WHEN 'view' THEN 'look' WHEN 'click' THEN 'touch' ELSE event_type END AS event_type FROM ev""",
    ),
)
def _remap_values(spark, d):
    return identity.remap_values(
        v.ev(spark, d).select("event_id", "event_type"), "event_type", {"view": "look", "click": "touch"}
    )


@query(
    "remap_by_table",
    sql_with("ev users", "SELECT event_id, new_id AS device FROM ev JOIN users USING (device)"),
)
def _remap_by_table(spark, d):
    mapping = v.users(spark, d).select(F.col("device").alias("old"), F.col("new_id").alias("new"))
    return identity.remap_by_table(v.ev(spark, d).select("event_id", "device"), "device", mapping)


_LETTERS = " || ".join(f"chr(CAST(97 + (s // {26**i}) % 26 AS INTEGER))" for i in range(6))
_ANON = f"""SELECT bssid, n AS code_number, {_LETTERS} AS code FROM
  (SELECT *, (n * 141650939) % {26**6} AS s FROM numbered)"""


@query(
    "anonymize_ids",
    sql_with(
        "wifi",
        _ANON,
        "numbered AS (SELECT bssid, row_number() OVER (ORDER BY md5(bssid)) - 1 AS n FROM (SELECT DISTINCT bssid FROM wifi WHERE bssid IS NOT NULL))",
    ),
)
def _anonymize_ids(spark, d):
    return identity.anonymize_ids(v.wifi(spark, d), "bssid")


@query(
    "anonymize_ids_extend",
    sql_with(
        "wifi",
        _ANON,
        """firstpart AS (SELECT bssid, row_number() OVER (ORDER BY md5(bssid)) - 1 AS n FROM
             (SELECT DISTINCT bssid FROM wifi WHERE bssid IS NOT NULL AND bssid < 'ap15')),
           numbered AS (SELECT * FROM firstpart UNION ALL
             SELECT bssid, (SELECT max(n) + 1 FROM firstpart) + row_number() OVER (ORDER BY md5(bssid)) - 1 AS n FROM
             (SELECT DISTINCT bssid FROM wifi WHERE bssid IS NOT NULL AND NOT bssid < 'ap15'))""",
    ),
)
def _anonymize_ids_extend(spark, d):
    wifi = v.wifi(spark, d)
    known = identity.anonymize_ids(wifi.filter(F.col("bssid") < "ap15"), "bssid")
    return identity.anonymize_ids(wifi, "bssid", known)


@query(
    "one_hot",
    sql_with(
        "sensor",
        "SELECT event_id, "
        + ", ".join(f"CAST(sensor = '{s}' AS INTEGER) AS sensor_{s}" for s in ("click", "signup", "view"))
        + " FROM sensor",
    ),
)
def _one_hot(spark, d):
    return identity.one_hot(v.sensor(spark, d).select("event_id", "sensor"), ["sensor"])


@query(
    "fill_null_inf",
    sql_with("ev", "SELECT event_id, CASE WHEN k % 10 IN (0, 1, 2) THEN 0.0::DOUBLE ELSE value END AS value FROM ev"),
)
def _fill_null_inf(spark, d):
    tail = F.col("k") % 10
    broken = (
        F.when(tail == 0, None).when(tail == 1, float("inf")).when(tail == 2, float("-inf")).otherwise(F.col("value"))
    )
    return (
        v.ev(spark, d)
        .withColumn("value", broken.cast("double"))
        .select("event_id", scalars.finite_or_zero(F.col("value")).alias("value"))
    )


# --- filters ----------------------------------------------------------------------------------


@query(
    "dedupe_keep_first",
    sql_with(
        "ev",
        """SELECT device, k, event_id, us FROM (SELECT *, row_number() OVER (PARTITION BY device, k ORDER BY us, event_id) AS rn FROM ev)
        WHERE rn = 1""",
    ),
)
def _dedupe_keep_first(spark, d):
    return filters.dedupe_keep_first(
        v.ev(spark, d).select("device", "k", "event_id", "us"), ["device", "k"], ["us", "event_id"]
    )


@query("gps_accuracy_filter", sql_with("gps", "SELECT event_id, device, us, accuracy FROM gps WHERE accuracy <= 100"))
def _gps_accuracy_filter(spark, d):
    return filters.gps_accuracy_filter(v.gps(spark, d), 100).select("event_id", "device", "us", "accuracy")


def _gps_days(spark, d):
    return v.gps(spark, d).withColumn("event_us", F.col("us") - F.pmod("us", F.lit(DAY)))


@query(
    "gps_accuracy_analytics",
    sql_with(
        "gps",
        """SELECT stage, n_rows, 8::BIGINT AS n_columns, n_events,
             CASE WHEN stage = 'after' THEN round((n_rows - r0) / r0::DOUBLE, 6) END AS rows_change,
             CASE WHEN stage = 'after' THEN 0.0::DOUBLE END AS columns_change,
             CASE WHEN stage = 'after' THEN round((n_events - e0) / e0::DOUBLE, 6) END AS events_change
           FROM (SELECT 'before' AS stage, (SELECT count(*) FROM g) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT device, dy FROM g)) AS n_events
             UNION ALL SELECT 'after', (SELECT count(*) FROM g WHERE accuracy <= 100),
               (SELECT count(*) FROM (SELECT DISTINCT device, dy FROM g WHERE accuracy <= 100))),
             (SELECT (SELECT count(*) FROM g) AS r0, (SELECT count(*) FROM (SELECT DISTINCT device, dy FROM g)) AS e0)""",
        "g AS (SELECT *, us // 86400000000 AS dy FROM gps)",
    ),
)
def _gps_accuracy_analytics(spark, d):
    out = filters.gps_accuracy_analytics(_gps_days(spark, d), 100, ["device", "event_us"])
    return out.withColumns(
        {c: F.round(c, 6) for c in ("rows_change", "columns_change", "events_change")}
    )


@query(
    "gps_threshold_sweep",
    sql_with(
        "gps",
        """SELECT t AS threshold, count(*) AS n_rows, count(DISTINCT (device, us // 86400000000)) AS n_events
        FROM gps JOIN (VALUES (10.0::DOUBLE), (35.0::DOUBLE), (50.0::DOUBLE), (100.0::DOUBLE)) th(t) ON accuracy < t
        WHERE k * 4 < 300 GROUP BY t""",
    ),
)
def _gps_threshold_sweep(spark, d):
    frame = _gps_days(spark, d).withColumn("speed", (F.col("k") * 4).cast("double"))
    return filters.gps_threshold_sweep(frame, [10, 35, 50, 100], ["device", "event_us"], speed="speed")


@query(
    "drop_null_rows",
    sql_with("wifi", "SELECT event_id, device, bssid FROM wifi WHERE bssid IS NOT NULL"),
)
def _drop_null_rows(spark, d):
    return filters.drop_null_rows(v.wifi(spark, d).select("event_id", "device", "bssid"), ["bssid"])


@query("drop_null_columns", sql_with("wifi", "SELECT event_id, bssid FROM wifi"))
def _drop_null_columns(spark, d):
    frame = v.wifi(spark, d).select(
        "event_id", "bssid", F.when(F.col("device") < 0, F.col("device")).alias("never_set")
    )
    return filters.drop_null_columns(frame)


_J1 = """j AS (SELECT s.event_id, s.device, s.sensor, s.us, s.dv0, s.dv1, s.dv2, s.accuracy, e.event_us, e.label
  FROM sensor s JOIN esm e ON s.device = e.device AND s.us BETWEEN e.event_us - {n} AND e.event_us + {n})"""


def sql_joined(hours: int) -> str:
    return _J1.format(n=hours * HOUR)


def joined(spark, d, hours: int):
    """Sensor rows within ± ``hours`` of the events, with the event's label."""
    events = v.esm(spark, d).select("device", "event_us", "label")
    return ranges.event_window_join(v.sensor(spark, d), events, hours * HOUR, hours * HOUR)


@query(
    "label_segment_filter",
    sql_with(
        "sensor esm",
        f"""SELECT event_id, device, event_us, us FROM j
        WHERE us >= event_us - {6 * HOUR} AND us <= event_us + {6 * HOUR} - {HOUR}""",
        sql_joined(12),
    ),
)
def _label_segment_filter(spark, d):
    return filters.label_segment_filter(joined(spark, d, 12), 12 * HOUR, HOUR).select(
        "event_id", "device", "event_us", "us"
    )


@query(
    "label_segment_sweep",
    sql_with(
        "sensor esm",
        f"""SELECT l AS length_us, label, count(DISTINCT (device, event_us)) AS n_events
        FROM j JOIN (SELECT unnest(range(4, 25, 2)) * {HOUR} AS l) ON us >= event_us - l // 2 AND us <= event_us + l // 2 - {HOUR}
        GROUP BY ALL""",
        sql_joined(12),
    ),
)
def _label_segment_sweep(spark, d):
    return filters.label_segment_sweep(joined(spark, d, 12), [h * HOUR for h in range(4, 25, 2)], HOUR)


@query("keep_classes", sql_with("esm", "SELECT event_id, label FROM esm WHERE label IN ('c0', 'c2')"))
def _keep_classes(spark, d):
    return filters.keep_classes(v.esm(spark, d).select("event_id", "label"), ["c0", "c2"])


@query(
    "min_records_filter",
    sql_with(
        "sensor",
        "SELECT event_id, device FROM sensor WHERE device IN (SELECT device FROM sensor GROUP BY device HAVING count(*) > 40)",
    ),
)
def _min_records_filter(spark, d):
    return filters.min_records_filter(v.sensor(spark, d).select("event_id", "device"), 40)


@query(
    "sensor_coverage_filter",
    sql_with(
        "sensor esm",
        """SELECT * FROM (SELECT device, event_us, label, count(*) FILTER (sensor = 'view') AS view, count(*) FILTER (sensor = 'click') AS click
        FROM j GROUP BY ALL) WHERE label <> 'c3' AND view >= 0.864 AND view > 0 AND click >= 1.728 AND click > 0""",
        sql_joined(72),
    ),
)
def _sensor_coverage_filter(spark, d):
    kinds = ["view", "click"]
    counts = joined(spark, d, 72).groupBy("device", "event_us", "label").agg(
        *[F.count(F.when(F.col("sensor") == s, 1)).alias(s) for s in kinds]
    )
    return filters.sensor_coverage_filter(
        counts, {s: v.SENSOR_HZ[s] for s in kinds}, segment_s=6 * 86400, min_percent=100 / 6, exclude=["c3"]
    )


@query(
    "cleaning_funnel",
    sql_with(
        "sensor esm",
        f"""SELECT step_no, step, count(DISTINCT device) AS n_participants, count(DISTINCT (device, event_us)) AS n_events,
          count(*) AS n_samples, 10::BIGINT AS n_columns FROM (
          SELECT 0::BIGINT AS step_no, 'joined' AS step, * FROM j
          UNION ALL SELECT 1, 'accurate', * FROM j WHERE accuracy <= 100
          UNION ALL SELECT 2, 'classes', * FROM j WHERE accuracy <= 100 AND label IN ('c0', 'c1')
          UNION ALL SELECT 3, 'segment', * FROM j WHERE accuracy <= 100 AND label IN ('c0', 'c1')
            AND us >= event_us - {6 * HOUR} AND us <= event_us + {6 * HOUR} - {HOUR}) GROUP BY ALL""",
        sql_joined(12),
    ),
)
def _cleaning_funnel(spark, d):
    steps = [
        ("accurate", F.col("accuracy") <= 100),
        ("classes", F.col("label").isin("c0", "c1")),
        ("segment", filters.in_label_segment(12 * HOUR, HOUR)),
    ]
    return filters.cleaning_funnel(joined(spark, d, 12), steps, start="joined")


__all__ = ["joined", "sql_joined", "MINUTE"]
